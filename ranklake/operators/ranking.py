"""Ranks, ties and gaps over the rows of a list: windows, one shuffle for each list key.

Every function takes the names of the columns it works on, so that it runs on results and on any
other table of ordered entries. `seq` is a total order within a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def classified(status: str = "status", ooc: str | None = "out_of_competition") -> Column:
    out = F.col(status) == "ok"
    return out & ~F.coalesce(F.col(ooc), F.lit(False)) if ooc else out


def tie_filled(df: DataFrame, keys: list[str], seq: str, rank: str = "rank", time: str = "time_s", is_classified: Column | None = None, out: str = "rank_filled") -> DataFrame:
    """A blank rank inherits the last printed rank of its run of equal times; an unclassified row ends a run."""
    ok = F.coalesce(is_classified if is_classified is not None else F.lit(True), F.lit(False)) & F.col(time).isNotNull()
    by = Window.partitionBy(*keys).orderBy(seq)
    marked = df.withColumn("_ok", ok)
    change = ~(F.col("_ok") & F.coalesce(F.lag("_ok").over(by), F.lit(False)) & F.coalesce(F.lag(time).over(by) == F.col(time), F.lit(False)))
    marked = marked.withColumn("_run", F.sum(F.when(change, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_run").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_ok"), F.col(rank)), ignorenulls=True).over(run)
    return marked.withColumn(out, F.when(F.col("_ok"), F.coalesce(F.col(rank), last)).otherwise(F.col(rank))).drop("_ok", "_run")


def gap_recovered(df: DataFrame, keys: list[str], seq: str, rank: str = "rank", out: str = "rank_recovered") -> DataFrame:
    """A single blank rank between r and r + 2 is r + 1."""
    by = Window.partitionBy(*keys).orderBy(seq)
    before, after = F.lag(rank).over(by), F.lead(rank).over(by)
    return df.withColumn(out, F.when(F.col(rank).isNull() & (after == before + 2), before + 1).otherwise(F.col(rank)))


def competition_rank(df: DataFrame, keys: list[str], *order: Column, out: str = "place") -> DataFrame:
    """Shared places: equal rows have one place, the next place counts them all."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy(*order)))


def regional_rank(df: DataFrame, instance: str, rank: str = "rank", time: str = "time_s", out: str = "regional_rank") -> DataFrame:
    return competition_rank(df, [instance], F.col(rank).isNull().asc(), F.col(rank).asc_nulls_first(), F.col(time).asc_nulls_first(), out=out)


def time_behind(df: DataFrame, keys: list[str], rank: str = "rank", time: str = "time_s", supplied: str | None = None, counts: Column | None = None, basis: str | None = None, out: str = "behind_s") -> DataFrame:
    """Gap of a ranked, counting row to the winner of its list: only in time lists, never negative."""
    counts = counts if counts is not None else F.lit(True)
    winner = F.min(F.when(counts & (F.col(rank) == 1), F.col(time))).over(Window.partitionBy(*keys))
    own = counts & F.col(rank).isNotNull() & (F.col(time) >= winner)
    if basis:
        own = own & (F.col(basis) == "time")
    gap = F.when(own, F.col(time) - winner)
    return df.withColumn(out, F.coalesce(F.col(supplied), gap) if supplied else gap)


def first_inversion(df: DataFrame, keys: list[str], rank: str = "rank", time: str = "time_s") -> DataFrame:
    """keys, rank, time, best: the first rank of a list whose least time beats the slowest of better ranks."""
    each = df.filter(F.col(rank).isNotNull() & F.col(time).isNotNull()).groupBy(*keys, F.col(rank).alias("rank")).agg(F.min(time).alias("time"))
    by = Window.partitionBy(*keys).orderBy("rank")
    each = each.withColumn("best", F.max("time").over(by.rowsBetween(Window.unboundedPreceding, -1))).filter("time < best")
    return each.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def representative(df: DataFrame, keys: list[str], seq: str, applies: Column | None = None) -> DataFrame:
    """The earliest row of each key; rows to which this doesn't apply, or with a null key, all stay."""
    plain = F.lit(False)
    for k in keys:
        plain = plain | F.col(k).isNull()
    if applies is not None:
        plain = plain | ~F.coalesce(applies, F.lit(False))
    n = F.row_number().over(Window.partitionBy(*keys, plain).orderBy(seq))
    return df.withColumn("_n", n).filter(plain | (F.col("_n") == 1)).drop("_n")


def units_ahead_rank(df: DataFrame, keys: list[str], unit: str, rank: str = "rank", counts: Column | None = None, out: str = "national_rank") -> DataFrame:
    """One more than the number of distinct counting units strictly ahead; units by their best rank.

    A window can't count distinct units, so units are reduced to their best rank first and ranks to
    a running count; the two small tables join back on (keys, rank).
    """
    counts = F.coalesce(counts if counts is not None else F.lit(True), F.lit(False)) & F.col(rank).isNotNull()
    best = df.filter(counts).groupBy(*keys, F.col(unit).alias("_unit")).agg(F.min(rank).alias("_best"))
    per_rank = best.groupBy(*keys, "_best").agg(F.count("_unit").alias("_n"))
    ranks = df.filter(counts).select(*keys, F.col(rank).alias("_best")).distinct()
    upto = Window.partitionBy(*keys).orderBy("_best").rangeBetween(Window.unboundedPreceding, -1)
    ahead = ranks.join(per_rank, [*keys, "_best"], "left").withColumn(out, F.coalesce(F.sum("_n").over(upto), F.lit(0)) + 1)
    ahead = ahead.select(*[F.col(k).alias(f"_{k}") for k in keys], "_best", out)
    on = F.col(rank).eqNullSafe(F.col("_best"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(ahead, on & counts, "left").drop("_best", *[f"_{k}" for k in keys])


def leg_times(df: DataFrame, keys: list[str], seq: str, cumulative: str, out: str = "leg_s") -> DataFrame:
    """Each cumulative time less the last known one before it."""
    by = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.col(cumulative) - F.coalesce(F.last(cumulative, ignorenulls=True).over(by), F.lit(0)))


def winner_recovered(df: DataFrame, keys: list[str], rank: str = "rank", time: str = "time_s", status: str = "status", out: str = "rank_recovered") -> DataFrame:
    """Where ranks exist but no first, the unranked classified rows of least time come first."""
    w = Window.partitionBy(*keys)
    ok = F.col(status) == "ok"
    lacks = (F.count_if(ok & (F.col(rank) == 1)).over(w) == 0) & (F.count_if(ok & F.col(rank).isNotNull()).over(w) > 0)
    least = F.min(F.when(ok, F.col(time))).over(w)
    return df.withColumn(out, F.when(ok & F.col(rank).isNull() & lacks & (F.col(time) == least), 1).otherwise(F.col(rank)))


def champion_boundary(df: DataFrame, keys: list[str], rank: str = "rank", status: str = "status", tag: str = "championship", seq: str = "seq", out: str = "championship_spread") -> DataFrame:
    """A champion's tag spreads to the classified rows of its class at or behind the champion's rank."""
    w = Window.partitionBy(*keys)
    ok = F.col(status) == "ok"
    best = F.min(F.when(ok & F.col(tag).isNotNull(), F.col(rank))).over(w)
    first = F.min_by(tag, F.when(F.col(tag).isNotNull(), F.col(seq))).over(w)
    return df.withColumn(out, F.when(F.col(tag).isNull() & ok & (F.col(rank) >= F.coalesce(best, F.lit(1))), first).otherwise(F.col(tag)))


def bracket_renumbered(df: DataFrame, keys: list[str], seq: str, rank: str = "rank", out: str = "bracket_rank") -> DataFrame:
    """Ranked rows of each bracket numbered anew in source order."""
    n = F.row_number().over(Window.partitionBy(*keys, F.col(rank).isNull()).orderBy(seq))
    return df.withColumn(out, F.when(F.col(rank).isNotNull(), n))


def overall_rederived(df: DataFrame, keys: list[str], seq: str, rank: str = "rank", time: str = "time_s", out: str = "overall_rank") -> DataFrame:
    """Ranks by time, where times ascend in source order but ranks do not or are not unique."""
    by, whole = Window.partitionBy(*keys).orderBy(seq), Window.partitionBy(*keys)
    steps = df.withColumn("_t", F.coalesce(F.col(time) >= F.lag(time).over(by), F.lit(True))).withColumn("_r", F.coalesce(F.col(rank) > F.lag(rank).over(by), F.lit(True)))
    redo = F.min("_t").over(whole) & ~F.min("_r").over(whole)
    return steps.withColumn(out, F.when(redo & F.col(time).isNotNull(), F.rank().over(whole.orderBy(F.col(time).asc_nulls_last()))).otherwise(F.col(rank))).drop("_t", "_r")


def stage_numbers(df: DataFrame, event: str, date: str, out: str = "stage_number") -> DataFrame:
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(event).orderBy(date)))


def team_numbers(df: DataFrame, keys: list[str], seq: str, out: str = "team_sequence") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(seq)))


def rank_consensus(df: DataFrame, keys: list[str], rank: str = "rank", time: str = "time_s", out: str = "time_agreed") -> DataFrame:
    """Rows of one rank take the time that most of them have, if at least two have it."""
    votes = df.filter(F.col(rank).isNotNull() & F.col(time).isNotNull()).groupBy(*keys, F.col(rank).alias("_r"), F.col(time).alias("_v")).agg(F.count("*").alias("_n"))
    best = votes.groupBy(*keys, "_r").agg(F.max_by("_v", F.struct("_n", -F.col("_v"))).alias("_agreed"), F.max("_n").alias("_most"), F.count("*").alias("_values"))
    best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], "_r", "_agreed", "_most", "_values")
    on = F.col(rank) == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out_df = df.join(best, on, "left")
    return out_df.withColumn(out, F.when((F.col("_most") >= 2) & (F.col("_values") > 1), F.col("_agreed")).otherwise(F.col(time))).drop("_r", "_agreed", "_most", "_values", *[f"_{k}" for k in keys])
