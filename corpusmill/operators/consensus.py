"""Independent readings of a cut-off cube reconciled, and carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["chart", "category", "area"]
VOTERS = 2


def consensus(readings: DataFrame) -> DataFrame:
    """(chart, category, area, cell, n_values, n_sources, status) of (source, *KEY, cell).

    Over one value: disputed. Under two sources: single source. Else agreed. Only an
    agreed cell has a value. Votes aggregate by source first, so a publisher that
    repeats itself votes once.
    """
    votes = readings.where("cell is not null").groupBy(*KEY, "source", "cell").agg(F.count("*").alias("_n"))
    x = votes.groupBy(*KEY).agg(F.count_distinct("cell").alias("n_values"), F.count_distinct("source").alias("n_sources"), F.min("cell").alias("v"))
    status = F.when(F.col("n_values") > 1, "disputed").when(F.col("n_sources") < VOTERS, "single source").otherwise("agreed")
    return x.select(*KEY, F.when(status == "agreed", F.col("v")).alias("cell"), "n_values", "n_sources", status.alias("status"))


def carry_forward(today: DataFrame, previous: DataFrame) -> DataFrame:
    """Agreed cells of today; cells of the same month from before unless disputed today."""
    t = today.select(*KEY, F.col("cell").alias("now"), "status")
    p = previous.select(*KEY, F.col("cell").alias("before"))
    x = t.join(p, KEY, "full_outer")
    return x.where("status is null or status != 'disputed'").select(*KEY, F.coalesce("now", "before").alias("cell"), F.when(F.col("now").isNotNull(), "today").otherwise("carried").alias("origin")).where("cell is not null")


def newest(versions: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the newest version of each key: an older one never replaces it."""
    rest = [c for c in versions.columns if c not in key]
    return versions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(*key, "r.*")
