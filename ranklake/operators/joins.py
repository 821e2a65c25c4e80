"""Lookups with rules: validity intervals, unique candidates, fallbacks, coverage and merge chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def valid_on(facts: DataFrame, intervals: DataFrame, key: str, date: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Intervals of a key that hold on the fact's date: an open end is unbounded, a fact without a date matches all.

    An equi-join on the key with the range as its residual condition.
    """
    right = intervals.withColumnRenamed(key, "_key")
    inside = (F.col(start).isNull() | (F.col(start) <= F.col(date))) & (F.col(end).isNull() | (F.col(end) >= F.col(date)))
    return facts.join(right, (F.col(key) == F.col("_key")) & (F.col(date).isNull() | inside), how).drop("_key")


def unique_match(left: DataFrame, right: DataFrame, keys: list[str], value: str, out: str = "matched") -> DataFrame:
    """left with the one value its keys lead to; null where there is none or more than one."""
    one = right.groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(out)).filter("_n = 1").drop("_n")
    return left.join(one, keys, "left")


def fallback_match(left: DataFrame, tiers: list[tuple[DataFrame, list[str], str]], out: str = "matched") -> DataFrame:
    """The value of the first tier (table, keys, value column) that has one."""
    found = []
    for i, (table, keys, value) in enumerate(tiers):
        one = table.groupBy(*keys).agg(F.min(value).alias(f"_v{i}"))
        left = left.join(one, keys, "left")
        found.append(f"_v{i}")
    return left.withColumn(out, F.coalesce(*found)).withColumn(f"{out}_tier", reduce(lambda a, i: F.when(F.col(found[i]).isNotNull(), i).otherwise(a), reversed(range(len(found))), F.lit(None).cast("int"))).drop(*found)


def covered(calendar: DataFrame, key: str, reasons: list[tuple[str, DataFrame]], otherwise: str) -> DataFrame:
    """calendar with `reason`: the first of the named tables that holds the key, else `otherwise`."""
    out = calendar
    for i, (_, table) in enumerate(reasons):
        out = out.join(table.select(F.col(key)).distinct().withColumn(f"_has{i}", F.lit(True)), key, "left")
    reason = F.lit(otherwise)
    for i, (name, _) in reversed(list(enumerate(reasons))):
        reason = F.when(F.col(f"_has{i}"), name).otherwise(reason)
    return out.withColumn("reason", reason).drop(*[f"_has{i}" for i in range(len(reasons))])


def reassigned(df: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """df with column carried over the merge map (old_id, new_id)."""
    m = merges.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    return df.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def resolved_chains(edges: DataFrame) -> DataFrame:
    """old_id, new_id with every chain of edges followed to its end, by pointer jumping.

    A round doubles the distance, so n edges need log2(n) rounds; what still moves then is on a
    cycle, which is refused.
    """
    now = cut(edges.select("old_id", "new_id").distinct(), "chains")
    for _ in range(max(1, now.count()).bit_length() + 1):
        step = now.select(F.col("old_id").alias("_from"), F.col("new_id").alias("_to"))
        after = now.join(step, F.col("new_id") == F.col("_from"), "left").select("old_id", F.coalesce("_to", "new_id").alias("new_id"), F.col("_to").isNotNull().alias("_moved"))
        after = cut(after, "chains")
        seen = after.agg(F.count_if(F.col("old_id") == F.col("new_id")), F.count_if("_moved")).first()
        if seen[0]:
            break
        now = after.drop("_moved")
        if not seen[1]:
            return now
    raise ValueError("the merge edges hold a cycle")


def redirects(history: DataFrame, fresh: DataFrame, current: DataFrame) -> DataFrame:
    """Old ids led to the ids of today: known redirects and new ones joined to chains, ends checked."""
    edges = fresh.unionByName(history.join(fresh.select("old_id"), "old_id", "left_anti"))
    out = resolved_chains(edges.filter("old_id <> new_id"))
    return out.join(current.select(F.col("id").alias("new_id")), "new_id", "left_semi").join(current.select(F.col("id").alias("old_id")), "old_id", "left_anti")


def tombstones(redirected: DataFrame, current: DataFrame) -> DataFrame:
    """Redirects whose end is no one of today."""
    return redirected.join(current.select(F.col("id").alias("new_id")), "new_id", "left_anti")


def without(df: DataFrame, register: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(register, keys, "left_anti")


def exactly(df: DataFrame, register: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose trimmed keys all stand in an exception register."""
    r = register.select(*[F.trim(k).alias(f"_{k}") for k in keys]).distinct()
    on: Column = F.lit(True)
    for k in keys:
        on = on & (F.trim(k) == F.col(f"_{k}"))
    return df.join(r, on, "left_semi")


def prefix_members(labels: DataFrame, members: DataFrame, name_key: str, component: str, club: str, person: str) -> DataFrame:
    """The one person of a name whose club goes with a component of a team label (equal, or a prefix of five letters)."""
    from ..functions.text import component_matches

    m = members.select(F.col(name_key).alias("_name"), F.col(club).alias("_club"), F.col(person).alias("_person"))
    hits = labels.join(m, F.col(name_key) == F.col("_name")).filter(component_matches(F.col(component), F.col("_club")))
    one = hits.groupBy(name_key).agg(F.count_distinct("_person", "_club").alias("_n"), F.min("_person").alias(person)).filter("_n = 1")
    return one.drop("_n")
