"""Order-aware duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def semantic(df: DataFrame, ignored: list[str], seq: str) -> DataFrame:
    """First of the rows that agree in all columns but the ignored ones (and the order)."""
    kept = [c for c in df.columns if c not in ignored and c != seq]
    n = F.row_number().over(Window.partitionBy(*kept).orderBy(seq))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def best_priority(df: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """Rows of the least priority of their key; ties all stay."""
    out = df.withColumn("_p", priority)
    return out.withColumn("_best", F.min("_p").over(Window.partitionBy(*keys))).filter(F.col("_p").eqNullSafe(F.col("_best"))).drop("_p", "_best")


def first_list_wins(df: DataFrame, base: list[str], signature: list[str], list_order: str, seq: str) -> DataFrame:
    """Per base key only the rows of its first list, each signature once: in-list repeats with a signature of their own stay."""
    out = df.withColumn("_first", F.min(list_order).over(Window.partitionBy(*base))).filter(F.col(list_order) == F.col("_first")).drop("_first")
    n = F.row_number().over(Window.partitionBy(*base, *signature).orderBy(seq))
    return out.withColumn("_n", n).filter("_n = 1").drop("_n")


def broadest_owner(df: DataFrame, content: str, owner: str, date: str) -> DataFrame:
    """Of the owners that hold the same content, keep the one with most dates, then documents, then the least id."""
    breadth = df.groupBy(owner).agg(F.count_distinct(date).alias("_dates"), F.count("*").alias("_docs"))
    holders = df.select(content, owner).distinct().join(breadth, owner)
    keep = holders.groupBy(content).agg(F.max_by(owner, F.struct("_dates", "_docs", -F.col(owner))).alias("_keep"))
    return df.join(keep, content).filter(F.col(owner) == F.col("_keep")).drop("_keep")


def merged_snapshot(existing: DataFrame, fetched: DataFrame, key: str, pos: str) -> DataFrame:
    """Existing order kept, values updated in place, new rows appended; last fetched row of a key wins."""
    values = [c for c in existing.columns if c not in (key, pos)]
    one = lambda d, best: d.groupBy(key).agg(*[best(F.col(c), F.col(pos)).alias(c) for c in values], F.min(pos).alias(pos))
    old, new = one(existing, F.min_by), one(fetched, F.max_by)
    old = old.select(key, F.lit(True).alias("_old"), F.col(pos).alias("_pos_old"), *[F.col(c).alias(f"_o_{c}") for c in values])
    new = new.select(key, F.lit(True).alias("_new"), F.col(pos).alias("_pos_new"), *[F.col(c).alias(f"_n_{c}") for c in values])
    both = old.join(new, key, "full_outer")
    both = both.select(key, *[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in values], "_pos_old", "_pos_new")
    out = numbered(both, [F.col("_pos_old").asc_nulls_last(), F.col("_pos_new").asc_nulls_last(), F.col(key).asc()], pos)
    return out.drop("_pos_old", "_pos_new")


def appended_index(existing: DataFrame, fetched: DataFrame, owner: str, key: str, pos: str) -> DataFrame:
    """What is new in fetched, numbered on from each owner's last number; old numbers never change."""
    n = F.row_number().over(Window.partitionBy(owner, key).orderBy(pos))
    new = fetched.withColumn("_n", n).filter("_n = 1").drop("_n").join(existing.select(owner, key), [owner, key], "left_anti")
    last = existing.groupBy(owner).agg((F.max(pos) + 1).alias("_next"))
    number = F.row_number().over(Window.partitionBy(owner).orderBy(pos)) - 1
    return new.withColumn("_k", number).join(last, owner, "left").withColumn(pos, F.col("_k") + F.coalesce("_next", F.lit(0))).drop("_k", "_next")


def upsert(df: DataFrame, keys: list[str], seq: str, replace: bool = False) -> DataFrame:
    """Insert-or-ignore (the first row of a key) or insert-or-replace (the last)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(seq).desc() if replace else F.col(seq)))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def document_order(df: DataFrame, event: str, name: str, kind: str, extract: Column) -> DataFrame:
    """doc_order: by event, split files last, relay lists first, championship extracts first, then by name."""
    split = F.col(name).rlike("(?i)split")
    return numbered(df, [F.col(event).asc(), split.asc(), (F.col(kind) != "relay").asc(), (~extract).asc(), F.col(name).asc()], "doc_order")
