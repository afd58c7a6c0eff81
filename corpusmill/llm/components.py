"""Connected components by alternating large-star and small-star rounds.

The published two-step contraction: in a large-star round every vertex links its
larger neighbours to its smallest one, in a small-star round it links itself and
its smaller neighbours to the smallest. The edges converge to one star for each
component, whose centre is the smallest id. A round is a grouped minimum (with
partial aggregation) joined back to the edges by a key that adaptive execution can
split, so neither a neighbour list nor the leaves of a large star are ever gathered
in one task. Each round is materialised in the shared folder.

The rounds end when one changes nothing; the contraction is proven to converge in
O(log^2 n) rounds, so no limit is set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.staging import cut, splittable


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (u > v), distinct -> (u > v), distinct."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return splittable(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = splittable(edges, least, ["u"]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node.

    Self-loops and repeated edges are allowed; nulls are dropped. An empty frame
    gives an empty result.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    mark = None
    while True:
        e = cut(_small_star(_large_star(e)))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
