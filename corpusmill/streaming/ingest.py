"""Streaming extension: postings kept up to date as passages land, and windowed counts.

The batch engine has no streams; these are additions that reuse its functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions import text as T


def landed(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def postings(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf) of each landing document; a document is one row, so no state is kept."""
    terms = T.tokenize(F.coalesce(F.col(text_col), F.lit("")))
    x = stream.select(F.col(id_col).alias("id"), terms.alias("t")).select("id", "t", F.explode(F.array_distinct("t")).alias("term"))
    return x.select("id", "term", F.size(F.filter("t", lambda y: y == F.col("term"))).cast("long").alias("tf"))


def write_postings(stream: DataFrame, table_dir: str, checkpoint: str, **options) -> StreamingQuery:
    """Append postings by micro-batch under a folder of the batch's number: a batch that
    runs again replaces its own folder, so the table holds each document once."""

    def put(batch: DataFrame, n: int) -> None:
        postings(batch, **options).write.mode("overwrite").parquet(f"{table_dir}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window; rows later than the watermark drop."""
    x = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return x.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
