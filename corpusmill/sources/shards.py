"""Passage shards as one partitioned Parquet table, the vector beside its row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusmill.operators.ingest import COLUMNS


def write(passages: DataFrame, path: str) -> None:
    """Replace the shards that ``passages`` holds, leave others alone; embed_text stays out."""
    cols = [c for c in (*COLUMNS, "embedding") if c in passages.columns]
    passages.select(*cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if lacking := set(COLUMNS) - set(df.columns):
        raise ValueError(f"{path}: columns {sorted(lacking)} are missing")
    return df


def read_all(spark: SparkSession, roots: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Every readable root as one table, and what could not be read (never silently)."""
    out, rejects = None, []
    for r in roots:
        try:
            df = read(spark, r)
        except (AnalysisException, ValueError) as e:
            rejects.append(f"{r}: {str(e).splitlines()[0]}")
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, rejects


def summary(passages: DataFrame, manifests: DataFrame, today: str) -> DataFrame:
    """chunks, age and staleness of each shard (manifest: shard, fetched, refresh_days)."""
    n = passages.groupBy("shard").agg(F.count("*").alias("chunks"))
    age = F.coalesce(F.datediff(F.lit(today).cast("date"), F.col("fetched")), F.lit(9999))
    return manifests.join(n, "shard", "left").select("shard", F.coalesce("chunks", F.lit(0)).alias("chunks"), age.alias("age_days"), (age > F.col("refresh_days")).alias("stale"))


def is_private(tier: str = "tier", private: str = "private"):
    return F.col(private) | (F.col(tier) == 9)
