"""Mixing sources to target weights with hash-threshold histograms.

Each document has a 36-bit hash. A source keeps every document floor(r) times, r being its target
over its size, and once more those whose hash lies below the source's threshold. The threshold
comes from sums of size by (source, hash bucket): the bucket in which the running sum passes the
budget is found among 4,096, then only that bucket's documents are summed at the next 12 bits, and
once more for the last 12. No document is sorted, and a hot source is only ever summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, staged

BITS = 12
LEVELS = 3
#: More sources than this are joined by a shuffle instead of a broadcast (about 60 bytes each).
BROADCAST_SOURCES = 50_000


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and hash of every document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))), 1, 9), 16, 10).cast("long").alias("hash"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, target: one row for each source; no row of the corpus is sorted.

    Sources by code point, null last, weigh `weights` in turn. A source stops at cap times its
    size and what is over goes to the others by weight, so that target = min(cap * size, level *
    weight) for one level; the level is read off the sources ordered by cap * size / weight.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    own = own.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))).over(whole)
    own = own.withColumn("place", F.row_number().over(by_room)).withColumn("level", first["level"])
    return own.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies of every row of docs.

    Documents without words have size 0 and take nothing. A null text counts as empty, a null
    source is a source of its own (the last), a null doc_id is hashed by its text. Rows that
    repeat a doc_id share its hash and so are taken alike. An empty table gives no rows.
    """
    rows = staged(measured(docs), "mix-sizes")
    own = staged(targets(rows, weights, cap), "mix-targets")
    few = own.count() <= BROADCAST_SOURCES
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor(ratio + 1e-12), F.lit(cap)).cast("long")
    own = own.withColumn("base", base).withColumn("budget", F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0)))

    def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed("source", "own_source")
        return left.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("own_source")), how).drop("own_source")

    prefix = own.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = joined(rows.filter("size > 0"), prefix).filter(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "budget", "below", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("below") + F.sum("words").over(up_to))
        prefix = (
            sums.filter(F.col("upto") > F.col("budget"))
            .groupBy("source", "budget")
            .agg(F.min_by(F.struct("bucket", F.col("upto").alias("with"), (F.col("upto") - F.col("words")).alias("without")), "bucket").alias("at"))
            .select("source", "budget", F.col("at.bucket").alias("prefix"), F.col("at.without").alias("below"), F.col("at.with").alias("above"))
        )
    nearer = F.col("above") - F.col("budget") < F.col("budget") - F.col("below")
    edge = prefix.select("source", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("edge"))
    edge = staged(edge, "mix-edges")
    out = joined(joined(rows, own), edge, "left")
    copies = F.col("base") + F.when(F.col("hash") < F.coalesce("edge", F.lit(0)), 1).otherwise(0)
    return out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "hash"
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    The same hash and thresholds are applied to the documents themselves, so that texts are not
    shuffled: the per-source edges are few and broadcast, or joined by source beyond the bound.
    Null and empty texts have no words and go; a null source is a source of its own; a null doc_id
    is hashed by its text; rows that repeat a doc_id are taken alike; an empty table stays empty;
    all columns of docs stay as they are.
    """
    mix_source, mix_base, mix_last, mix_size, mix_hash, mix_copies, mix_copy = free_names(
        docs, "mix_source", "mix_base", "mix_last", "mix_size", "mix_hash", "mix_copies", "mix_copy"
    )
    rules = (
        mix(docs, weights, cap)
        .groupBy("source")
        .agg(
            F.max(F.struct("copies", "hash")).alias("most"),
            F.min(F.when(F.col("size") > 0, F.col("copies"))).alias("base"),
        )
        .select(
            F.col("source").alias(mix_source),
            F.coalesce("base", F.lit(0)).alias(mix_base),
            F.when(F.col("most.copies") > F.col("base"), F.col("most.hash")).alias(mix_last),
        )
    )
    rules = staged(rules, "mix-rules")
    few = rules.count() <= BROADCAST_SOURCES
    sized = docs.withColumn(mix_size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).withColumn(
        mix_hash, F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))), 1, 9), 16, 10).cast("long")
    )
    out = sized.join(F.broadcast(rules) if few else rules, F.col("source").cast("string").eqNullSafe(F.col(mix_source)))
    copies = F.when(F.col(mix_size) > 0, F.col(mix_base) + F.when(F.col(mix_hash) <= F.col(mix_last), 1).otherwise(0)).otherwise(0)
    out = out.withColumn(mix_copies, copies.cast("int")).filter(F.col(mix_copies) > 0)
    return out.withColumn(mix_copy, F.explode(F.sequence(F.lit(1), mix_copies))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 9))::BIGINT AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER ()
     - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER ()
     - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level,
    row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place
  FROM s
), t AS (
  SELECT source, source_size, least(most::DOUBLE, (SELECT arg_min(level, place) FROM l WHERE level * weight <= most) * weight) AS target FROM l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-12), 3)::BIGINT ELSE 0 END AS base FROM t
), r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.base,
    greatest(b.target - b.base * b.source_size, 0) AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.hash) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  (size * (base + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
