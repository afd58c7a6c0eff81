"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Each row gets a hash-random key of its id and text. The key's high bits are a range
bucket, so a source, however hot, spreads over ``BUCKETS`` ranges. Sizes are summed by
(source, bucket) with partial aggregation, prefix sums run over those few sums,
and only the one bucket that holds a source's cut is ordered row by row. The
plan of a source is then a few numbers, and applying it to a row needs no shuffle
of texts.

Rows equal in id and text share a key. If a cut falls among such rows, they are
numbered over ranges (no task gets them all) and the prefix sum runs on inside them,
so the cut is exact to the word there too.

Defined results: a null text has size 0; null sources form one source that comes
last; a source of size 0 has target 0; null ids are kept; of rows equal in id and text,
which ones are taken is not defined, but how many are; a very long text is counted
whole, and cut inside if a source's cut falls there; an empty table gives an empty
result; other columns, whatever their names, pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.numbering import numbered
from corpusmill.plans.staging import cut, small_or_shuffled, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2
BUCKETS = 4096
SEED = "mix-2"
KEY_BITS = 60

_TRIM = r"' \t\n\u000B\u000C\r'"


def n_words(text: str) -> Column:
    t = f"btrim(`{text}`, {_TRIM})"
    return F.expr(f"coalesce(if({t} = '', 0, size(split({t}, '[\\\\x20\\\\x09-\\\\x0D]+'))), 0)").cast("long")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size and hash-random key of every row; no texts."""
    return docs.select("doc_id", "source", n_words(text).alias("size"), order_key("doc_id", text).alias("mix_key"))


def order_key(doc_id: str, text: str) -> Column:
    """A 60-bit key that depends on the row alone, so that reruns (and other engines) agree."""
    body = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.col(f"`{doc_id}`").cast("string"), body))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: one row a source.

    Sources sorted by capacity a weight are filled in order: at each, the level
    is what is left over what weights are left. The greatest level is the one at
    which no target exceeds its capacity and the shares add up. One row a source
    enters the single-partition windows, never documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("room", F.col("source_size") * F.lit(float(epochs)))
    before = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weights_left)
    level = F.max("level").over(everything)
    return by.select("source", "source_size", F.least(F.col("room"), level * F.col("weight")).alias("target"))


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """One row a source: whole epochs, and the key at which the last one stops.

    Of the ``copies`` rows with the key ``cut_key`` the mix takes ``cut_words`` words in all.
    ``sizes`` is read several times; pass a materialised frame.
    """
    t = targets(sizes, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("epochs", whole).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    # pre-aggregate identical keys and then buckets; sources join null-safely
    keys = sizes.groupBy("source", "mix_key").agg(F.sum("size").alias("words"), F.count("*").alias("copies"))
    keys = keys.withColumn("bucket", _bucket(buckets))
    sums = keys.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    rests = t.select(F.col("source").alias("s"), "rest")
    at = sums.join(rests, sums["source"].eqNullSafe(rests["s"])).where("before <= rest and rest < before + words")
    at = at.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "rest")
    inside = keys.join(at, keys["source"].eqNullSafe(at["s"]) & (keys["bucket"] == at["b"])).select("source", "mix_key", "words", "copies", "before", "rest")
    run = Window.partitionBy("source").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(run), F.lit(0)))
    edge = inside.where("before <= rest and rest < before + words").select(
        F.col("source").alias("s"), F.col("mix_key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_words"), "copies"
    )
    return t.join(edge, t["source"].eqNullSafe(edge["s"]), "left").select("source", "source_size", "target", "epochs", "rest", "cut_key", "cut_words", "copies")


def _bucket(buckets: int) -> Column:
    """Range bucket of a key, in the keys' order; ``buckets`` is a power of two."""
    return F.shiftright("mix_key", KEY_BITS - (buckets.bit_length() - 1)).cast("int")


def last_epoch(size: Column, key: Column, earlier: Column) -> Column:
    """Words of the last epoch for a row joined to its source's plan; ``earlier`` equal rows come before it."""
    at_cut = F.greatest(F.lit(0), F.least(size, F.col("cut_words") - earlier * size))
    part = F.when(key < F.col("cut_key"), size).when(key == F.col("cut_key"), at_cut).otherwise(F.lit(0))
    return F.when(F.col("rest") > 0, F.coalesce(part, F.lit(0))).otherwise(F.lit(0)).cast("long")


def _planned(rows: DataFrame, p: DataFrame, source: str, key: str) -> DataFrame:
    """``rows`` with their source's plan and ``_cm_earlier``, the equal rows before each at a cut.

    ``p`` is materialised. Only where a cut falls among several rows of one key are those
    rows numbered.
    """
    p = p.withColumnRenamed("source", "_cm_source")
    x = rows.join(small_or_shuffled(p), rows[source].eqNullSafe(p["_cm_source"]))
    if p.where("copies > 1 and rest > 0").limit(1).count() == 0:
        return x.withColumn("_cm_earlier", F.lit(0).cast("long"))
    tied = F.coalesce((F.col("copies") > 1) & (F.col("rest") > 0) & (F.col(key) == F.col("cut_key")), F.lit(False))
    ties = cut(x.where(tied)).withColumn("_cm_n", F.monotonically_increasing_id())
    ties = numbered(ties, ["_cm_n"], ["_cm_source"], "_cm_earlier").drop("_cm_n")
    return x.where(~tied).withColumn("_cm_earlier", F.lit(0).cast("long")).unionByName(ties)


def decide(sizes: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``sizes``."""
    sizes = cut(sizes)
    x = _planned(sizes, cut(plan(sizes, **options)), "source", "mix_key")
    words = F.col("epochs") * F.col("size") + last_epoch(F.col("size"), F.col("mix_key"), F.col("_cm_earlier"))
    return x.select("doc_id", "size", "source_size", "target", words.cast("long").alias("taken"))


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed rows with the columns of ``docs``: a row an epoch, the last cut at a word.

    Only the row at a source's cut loses words: it keeps the first ones that fit, with
    the white space between. The texts are not shuffled when the plan (one row a source)
    was counted to be small; a larger plan joins as a shuffle.
    """
    cols = docs.columns
    sizes = cut(sized(docs.select("doc_id", "source", F.col(text).alias("text"))))
    p = cut(plan(sizes, **options))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_cm_row"), F.col("source").alias("_cm_s"), F.col(text).alias("_cm_t"), order_key("doc_id", text).alias("_cm_key"))
    x = _planned(rows.withColumn("_cm_size", n_words("_cm_t")), p, "_cm_s", "_cm_key")
    x = x.withColumn("_cm_part", last_epoch(F.col("_cm_size"), F.col("_cm_key"), F.col("_cm_earlier")))
    reps = (F.col("epochs") + F.when((F.col("_cm_part") > 0) & (F.col("_cm_part") == F.col("_cm_size")), 1).otherwise(0)).cast("int")
    short = (F.col("_cm_part") > 0) & (F.col("_cm_part") < F.col("_cm_size"))
    x = x.withColumn("_cm_n", reps + short.cast("int")).where("_cm_n > 0")
    x = x.withColumn("_cm_short", short).withColumn("_cm_i", F.explode(F.sequence(F.lit(1), F.col("_cm_n"))))
    head = F.expr("array_join(slice(regexp_extract_all(_cm_t, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, cast(_cm_part as int)), '')")
    body = F.when(F.col("_cm_short") & (F.col("_cm_i") == F.col("_cm_n")), head).otherwise(F.col("_cm_t"))
    out = [body.alias(c) if c == text else F.col(f"_cm_row.`{c}`").alias(c) for c in cols]
    return x.select(*[F.length(body).cast("long").alias(c) if c == "n_chars" else o for c, o in zip(cols, out)])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(sized(table(spark, sf_dir, "documents")))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', 'mix-2', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source
), w AS (
  SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS room FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(room, max(level) OVER () * weight) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
), r AS (
  SELECT *, floor(target - epochs * source_size)::BIGINT AS rest FROM e
), x AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.epochs, r.rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM x
"""
