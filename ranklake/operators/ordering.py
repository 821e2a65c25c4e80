"""Numbers for rows in a total order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

PLACES = 33  # bits of a row's place within its partition


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with out: 1, 2, 3 and so on (long) in the given order.

    Rows are dealt by ranges of the order and sorted within them, and written once, so that the
    ranges stay as they are; each range then starts behind what the ranges before it hold. The only
    window over everything has a row a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = cut(ranged, "numbered")
    part = F.shiftright("_at", PLACES)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    own = F.col("_at").bitwiseAND(F.lit((1 << PLACES) - 1))
    return ranged.join(F.broadcast(starts), part == F.col("_part")).withColumn(out, F.col("_before") + own + 1).drop("_at", "_part", "_before")
