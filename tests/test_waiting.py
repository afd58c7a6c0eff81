"""Open questions as streaming state: batches of turns give the rows of one batch run."""

from pyspark.sql import functions as F

from corpusmill.streaming import waiting as W

TURNS = "conv_id long, turn long, role string, text string, ts timestamp"
DAY = 24 * 3600


def turns(spark, rows):
    return spark.createDataFrame([(c, t, r, x, None) for c, t, r, x, _ in rows], TURNS.replace("ts timestamp", "ts string")).drop("ts").join(
        spark.createDataFrame([(c, t, s) for c, t, _, _, s in rows], "conv_id long, turn long, s long"), ["conv_id", "turn"]
    ).select("conv_id", "turn", "role", "text", F.timestamp_seconds("s").alias("ts"))


ROWS = [
    (1, 0, "user", "How long may I be unemployed?", 1000), (1, 1, "assistant", "How many days?", 1001), (1, 2, "user", "forty, then 20 days", 1002), (1, 3, "user", "maybe", 1003), (1, 4, "user", "no", 1004), (1, 5, "user", "thanks", 1005),
    (2, 0, "user", "I was unemployed for 100 days", 1000), (2, 1, "user", "yes I am", 1001), (2, 2, "user", "and with 160 days of unemployment?", 1002),
    (3, 0, "user", "Am I unemployed?", 1000), (3, 6, "user", "12 days", 1000 + 20 * DAY), (3, 7, "user", "unemployment again", 1001 + 20 * DAY),
    (4, 0, "user", "hello", 1000), (4, 1, "user", None, 1001), (None, 0, "user", "unemployed for 3 days", 1),
]


def said(rows):
    return sorted((r.conv_id, r.turn, r.kind, r.fact, (r.decision or "")[:14]) for r in rows)


WANT = [
    (1, 0, "needs", "unemployment_days", ""), (1, 2, "needs", "stem_extension", ""), (1, 3, "needs", "stem_extension", ""), (1, 4, "outcome", None, "30 days of une"),
    (2, 0, "needs", "stem_extension", ""), (2, 1, "outcome", None, "50 days of une"), (2, 2, "outcome", None, "OVER THE LIMIT"),
    (3, 0, "needs", "unemployment_days", ""), (3, 7, "needs", "unemployment_days", ""),
]


def test_replayed(spark):
    got = said(W.replayed(turns(spark, ROWS)).collect())
    assert got == WANT
    assert W.replayed(turns(spark, ROWS).limit(0)).count() == 0


def test_a_stream_in_batches_gives_the_same_rows(spark, tmp_path):
    all_turns = turns(spark, ROWS)
    for k in range(8):  # a turn later than the watermark would be dropped
        all_turns.where(F.col("turn") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(all_turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = W.waiting(s).writeStream.format("memory").queryName("waiting").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert said(spark.sql("select * from waiting").collect()) == said(W.replayed(all_turns).collect())


def test_a_replay_walks_over_batches_and_makes_no_group_a_frame(spark):
    rows = [(100 * k + c if c is not None else None, t, r, x, s) for k in range(20) for c, t, r, x, s in ROWS]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")  # conversations go over several batches
    try:
        x = W.replayed(turns(spark, rows))
        assert said(x.collect()) == sorted((100 * k + c, *rest) for k in range(20) for c, *rest in WANT)
        assert "FlatMapGroups" not in x._jdf.queryExecution().toString()
    finally:
        spark.conf.set(key, before)
