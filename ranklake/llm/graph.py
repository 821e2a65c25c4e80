"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge (columns u, v as long); root is the smallest node reachable.

    Every round hangs each node's larger neighbours under its smallest one, then each node and its
    smaller neighbours under the smallest of those, until nothing changes. A hub's edges are
    joined to one row, so a skewed hub is split by adaptive execution; edges only ever shrink.
    """
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = staged(pairs, "star")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = staged(small, "star")
        drop_staged(now)
        drop_staged(large)
        after = _mark(small)
        if after == mark:
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, mark = small, after


def _mark(pairs: DataFrame) -> tuple:
    r = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]
