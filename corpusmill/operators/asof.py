"""The latest row of a history for each row of a table, by key and time.

Both tables are range-sorted together by key and time and stored, so a key may hold most
of the rows and still be in many ranges. A window carries the history inside a range;
across a range's border goes one row a range and key: the last of the history before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import dates as D
from corpusmill.plans.staging import cut


def as_of(rows: DataFrame, history: DataFrame, keys: list[str], time: str, since: str, tie: str | None = None) -> DataFrame:
    """``rows`` with ``found``: the last row of ``history`` with the same ``keys`` and ``since`` <= ``time``, as a struct.

    Of history rows of one time the one with the largest ``tie`` counts. Rows with a null
    key or time find nothing and stay; history rows with one are never found. Repeated
    rows each stay.
    """
    h = history.dropna(subset=[*keys, since])
    row, seen = rows.schema, h.schema
    a = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_tie"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(seen).alias("_val"))
    b = h.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(since).alias("_t"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(None)).cast("string").alias("_tie"), F.lit(None).cast(row).alias("_row"), F.struct(*h.columns).alias("_val"))
    ks = [f"_k{i}" for i in range(len(keys))]
    order = ["_t", "_side", "_tie"]
    x = a.unionByName(b).withColumn("_uid", F.monotonically_increasing_id())
    x = cut(x.repartitionByRange(*ks, *order, "_uid").withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*ks, "_range").orderBy(*order, "_uid").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*ks).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = x.where("_side = 0").groupBy(*ks, "_range").agg(F.max_by("_val", F.struct(*order[::2], "_uid")).alias("_last"))
    # ranges without history of a key it goes through need what was before them, too
    every = x.select(*ks, "_range").distinct().join(ends, [*ks, "_range"], "left")
    carried = every.select(*ks, "_range", F.last("_last", ignorenulls=True).over(along).alias("_before")).where("_before is not null")
    y = x.withColumn("_here", F.last("_val", ignorenulls=True).over(inside)).where("_side = 1").join(carried, [*ks, "_range"], "left")
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_before"))
    return y.select("_row.*", found.alias("found"))


def cutoffs_as_of(asked: DataFrame, history: DataFrame) -> DataFrame:
    """(id, month, cell, timing, status) for (id, chart, category, area, on, priority): what held on a day.

    ``history`` (chart, category, area, month, cell) keeps every month's chart. The cell of
    the latest month up to ``on`` decides; it is current if it is of that month, else stale.
    """
    x = as_of(asked.withColumn("_m", F.trunc("on", "month").cast("date")), history, ["chart", "category", "area"], "_m", "month")
    month = F.col("found.month")
    timing = F.when(month.isNull(), "none").otherwise(D.timing(month, F.col("on")))
    return x.select("id", month.alias("month"), F.col("found.cell").alias("cell"), timing.alias("timing"), D.compare(F.col("priority"), F.col("found.cell")).alias("status"))
