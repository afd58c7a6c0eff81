"""Consecutive numbers in a stated order without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.staging import cut


def numbered(rows: DataFrame, order: list[str], within: list[str] | None = None, name: str = "n") -> DataFrame:
    """``rows`` with ``name``: 0, 1, .. by ``order``, starting anew for each ``within``.

    Rows are range-partitioned by the whole order and materialised, so that ranges keep
    their numbers; each range counts its rows, the counts add up to offsets (a row a range
    and group), and a window numbers the rows inside one range. Ties in ``order`` take
    consecutive numbers in no particular order, so it should name a key.
    """
    within = within or []
    x = cut(rows.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()))
    counts = x.groupBy(*within, "_range").agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_w_{c}") for c in within], F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    on = x["_range"] == offsets["_r"]
    for c in within:
        on = on & x[c].eqNullSafe(offsets[f"_w_{c}"])
    inside = Window.partitionBy(*within, "_range").orderBy(*order)
    y = x.join(offsets, on).withColumn(name, (F.col("_before") + F.row_number().over(inside) - 1).cast("long"))
    return y.drop("_range", "_r", "_before", *[f"_w_{c}" for c in within])


def running(rows: DataFrame, value: str, order: list[str], within: list[str], name: str = "total") -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` up to and with each row, by ``order`` in each ``within``.

    As ``numbered``: rows are range-partitioned and materialised, each range sums its
    rows, and a window adds up inside one range, so a group may hold most of the rows.
    """
    x = cut(rows.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()))
    sums = x.groupBy(*within, "_range").agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_w_{c}") for c in within], F.col("_range").alias("_r"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    on = x["_range"] == offsets["_r"]
    for c in within:
        on = on & x[c].eqNullSafe(offsets[f"_w_{c}"])
    inside = Window.partitionBy(*within, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    y = x.join(offsets, on).withColumn(name, F.col("_before") + F.sum(value).over(inside))
    return y.drop("_range", "_r", "_before", *[f"_w_{c}" for c in within])
