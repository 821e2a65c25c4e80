"""Statistics of classes, lists, seasons and medals."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_stats(df: DataFrame, keys: list[str], status: str = "status", rank: str = "rank", time: str = "time_s", kind: str | None = "result_kind") -> DataFrame:
    """starters (DNS too), classified and winner's time; relays and families apart."""
    rows = df.filter(~F.col(kind).isin("relay", "family")) if kind else df
    return rows.groupBy(*keys).agg(
        F.count("*").alias("starters"),
        F.count_if(F.col(status) == "ok").alias("classified"),
        F.min(F.when(F.col(rank) == 1, F.col(time))).alias("winner_time_s"),
    )


def too_few_starters(df: DataFrame, keys: list[str], unit: Column, status: str = "status", ineligible: Column | None = None, least: int = 3) -> DataFrame:
    """Keys with fewer distinct eligible starting units than a podium needs; rows without a unit don't count."""
    started = F.col(status).isin("ok", "dnf", "mp", "dsq")
    if ineligible is not None:
        started = started & ~F.coalesce(ineligible, F.lit(False))
    return df.filter(started).groupBy(*keys).agg(F.count_distinct(unit).alias("units")).filter(F.col("units") < least)


def entries(df: DataFrame, keys: list[str], unit: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(unit).alias("entries"))


def any_known(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_or(F.col(column).isNotNull()).alias(f"has_{column}"))


def coverage(df: DataFrame, keys: list[str], rank: str = "rank", time: str = "time_s") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(F.col(rank).isNotNull()).alias("ranked"), F.count_if(F.col(time).isNotNull()).alias("timed"))


def joined_distinct(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """The distinct values of a column in order, joined by commas."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ",").alias(out))


def rank_minima(df: DataFrame, keys: list[str], rank: str = "rank", time: str = "time_s") -> DataFrame:
    return df.filter(F.col(rank).isNotNull() & F.col(time).isNotNull()).groupBy(*keys, F.col(rank)).agg(F.min(time).alias("least_time"))


def source_units(df: DataFrame, keys: list[str], unit: Column, excluded: Column | None = None) -> DataFrame:
    rows = df.filter(~F.coalesce(excluded, F.lit(False))) if excluded is not None else df
    return rows.groupBy(*keys).agg(F.count_distinct(unit).alias("source_units"))


def document_metrics(df: DataFrame, document: str, category: str = "category", rank: str = "rank", time: str = "time_s", status: str = "status", ooc: str = "out_of_competition") -> DataFrame:
    return df.groupBy(document).agg(
        F.count_distinct(category).alias("categories"),
        F.count("*").alias("n_rows"),
        F.count_if(F.col(rank).isNotNull()).alias("ranked"),
        F.count_if(F.col(time).isNotNull()).alias("timed"),
        F.count_if(F.col(status) == "unknown").alias("unknown"),
        F.count_if(F.col(ooc)).alias("ooc"),
    )


def metrics_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key with the change of every metric; a document in one version only counts as zero in the other."""
    metrics = [c for c in after.columns if c != key]
    b = before.select(key, *[F.col(c).alias(f"_b_{c}") for c in metrics])
    out = b.join(after, key, "full_outer")
    return out.select(key, *[(F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"_b_{c}"), F.lit(0))).alias(f"d_{c}") for c in metrics])


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def rollup_by_jurisdiction(df: DataFrame, jurisdiction: str, stage: str, entry: str, only: Column | None = None) -> DataFrame:
    return (df.filter(only) if only is not None else df).groupBy(jurisdiction).agg(F.count_distinct(stage).alias("stages"), F.count_distinct(entry).alias("entries"))


def season_counts(df: DataFrame, season: Column, stage: str) -> DataFrame:
    return df.groupBy(season.alias("season")).agg(F.count_distinct(stage).alias("stages"))


def roster(members: DataFrame, starts: DataFrame, person: str, out: str = "starts") -> DataFrame:
    """Members with their number of starts, none included."""
    n = starts.groupBy(F.col(person).alias("_p")).agg(F.count("*").alias(out))
    return members.join(n, F.col(person) == F.col("_p"), "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("_p")


def medal_table(podium: DataFrame, who: list[str], place: str, elite: Column | None = None) -> DataFrame:
    """gold, silver, bronze and their elite parts; equal counts share a place."""
    elite = elite if elite is not None else F.lit(False)
    n = [F.count_if((F.col(place) == i) & e).alias(f"{p}{m}") for p, e in (("", F.lit(True)), ("elite_", elite)) for i, m in enumerate(("gold", "silver", "bronze"), 1)]
    out = podium.filter(F.col(place).between(1, 3)).groupBy(*who).agg(*n)
    # equal counts are few against people: places are found between them, and joined back
    medals = [f"{p}{m}" for p in ("", "elite_") for m in ("gold", "silver", "bronze")]
    every = out.groupBy(*medals).agg(F.count("*").alias("_n"))
    better = Window.orderBy(*[F.col(m).desc() for m in medals]).rowsBetween(Window.unboundedPreceding, -1)
    places = every.select(*[F.col(m).alias(f"_{m}") for m in medals], (F.coalesce(F.sum("_n").over(better), F.lit(0)) + 1).cast("int").alias("place"))
    same = reduce(and_, (F.col(m) == F.col(f"_{m}") for m in medals))
    return out.join(places, same).drop(*[f"_{m}" for m in medals])


def canonical_names(df: DataFrame, person: str, name: str, seq: str, authoritative: Column) -> DataFrame:
    """A person's most common authoritative spelling, else the most common; the earliest breaks ties."""
    each = df.groupBy(person, name, authoritative.alias("_a")).agg(F.count("*").alias("_n"), F.min(seq).alias("_first"))
    plain = each.groupBy(person, name).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.sum(F.when(F.col("_a"), F.col("_n"))).alias("_an"), F.min(F.when(F.col("_a"), F.col("_first"))).alias("_af"))
    best = lambda n, f: F.max_by(name, F.when(F.col(n).isNotNull(), F.struct(n, -F.col(f))))
    return plain.groupBy(person).agg(F.coalesce(best("_an", "_af"), best("_n", "_first")).alias("name"))


def associations(df: DataFrame, person: str, club: str, rank: str = "rank") -> DataFrame:
    return df.groupBy(person, club).agg(F.count("*").alias("n"), F.count_if(F.col(rank).isNotNull()).alias("ranked"))


def name_order_votes(df: DataFrame, document: str, signal: Column, least: int = 3, dominance: int = 4) -> DataFrame:
    """Documents that print last names first: enough votes, and far more than against."""
    votes = df.groupBy(document).agg(F.count_if(signal > 0).alias("last_first"), F.count_if(signal < 0).alias("first_last"))
    return votes.withColumn("flip", (F.col("last_first") >= least) & (F.col("last_first") > dominance * F.col("first_last")))
