"""Predicates and selections over rows, lists and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import _t, is_valid_name


def is_active(classification: str, category: str, club: str) -> Column:
    """Not withdrawn, and not the transport debris whose three signs come together."""
    low = lambda c: F.lower(_t(c))
    debris = (low(category) == "empty") & (low(classification) == "disqualified") & _t(club).rlike(X.CORRUPT_CLUB)
    return (low(classification) != "inactive") & ~debris


def usable_documents(df: DataFrame, document: str, name: str, kind: str) -> DataFrame:
    """Documents with a team row or a valid name other than `empty`."""
    good = F.col(kind).isin("relay", "team") | (is_valid_name(name) & (F.lower(_t(name)) != "empty"))
    return df.groupBy(document).agg(F.bool_or(good).alias("usable"))


def is_clone_title(title: str, mark: str = "bewertung") -> Column:
    return F.lower(F.coalesce(F.col(title), F.lit(""))).contains(mark)


def without_course_views(docs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Course views go where a normal view of the same stage exists."""
    course = _t(name).rlike(X.COURSE_VIEW)
    normal = docs.filter(~course).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return docs.filter(~course).unionByName(docs.filter(course).join(normal, on, "left_anti"))


def minute_precision(df: DataFrame, keys: list[str], rank: str = "rank", time: str = "time_s", status: str = "status", least: int = 20, below: int = 300) -> DataFrame:
    """Lists whose times are minutes: many timed finishers, no rank at all, no value over five minutes."""
    timed = F.col(time).isNotNull() & (F.col(status) == "ok")
    out = df.groupBy(*keys).agg(F.count_if(timed).alias("timed"), F.count_if(F.col(rank).isNotNull()).alias("ranked"), F.max(F.when(timed, F.col(time))).alias("longest"))
    return out.filter((F.col("timed") >= least) & (F.col("ranked") == 0) & (F.col("longest") < below))


def exact_over_lossy(lossy: DataFrame, exact: DataFrame, keys: list[str], seen_in: str = "source") -> DataFrame:
    """Rows of both sources; where the lossy one is minute-marked and the exact one covers it, only the exact.

    lossy and exact: keys, rank, time_s, minute_marked and like columns.
    """
    a = lossy.groupBy(*keys).agg(F.count("*").alias("_a"), F.bool_and(F.coalesce(F.col("minute_marked"), F.lit(False)) & F.col("rank").isNull()).alias("_marked"))
    b = exact.groupBy(*keys).agg(F.count("*").alias("_b"), F.count_if(F.col("rank").isNotNull()).alias("_ranked"), F.max("time_s").alias("_longest"))
    better = a.join(b, keys).filter((F.col("_a") >= 20) & F.col("_marked") & (F.col("_b") >= F.greatest(F.lit(20), F.floor(F.col("_a") * 0.9))) & (F.col("_ranked") >= 5) & (F.col("_longest") >= 300)).select(*keys)
    return lossy.join(better, keys, "left_anti").withColumn(seen_in, F.lit("lossy")).unionByName(exact.withColumn(seen_in, F.lit("exact")))


def of_discipline(df: DataFrame, column: str, excluded: list[str]) -> DataFrame:
    """Rows of other disciplines go; a row without one stays."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*excluded))


def past_public(df: DataFrame, date: str, visibility: str, as_of: str) -> DataFrame:
    return df.filter((F.col(date) < F.lit(as_of)) & (F.col(visibility) == "public"))


def needs_fetch(df: DataFrame, fetched: str, date: str, cutoff: str, force: bool = False) -> DataFrame:
    return df if force else df.filter(F.col(fetched).isNull() | (F.col(date) >= F.lit(cutoff)))


def needs_index(events: DataFrame, date: str, known: str, selected: str, needs: str, today: str, cutoff: str | None = None, force: bool = False) -> DataFrame:
    """Past events whose attachment index is to be read again.

    It is unknown, the event is selected or recent, or all are forced; and the event is selected or
    needs attachments (no usable structured results, or a sign of a championship). A null date is
    in the future; null flags are false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    recent = F.coalesce(F.col(date) >= F.lit(cutoff), F.lit(False)) if cutoff else F.lit(False)
    asked = F.lit(force) | ~flag(known) | flag(selected) | recent
    return events.filter(F.coalesce(F.col(date), F.lit("9999")).substr(1, 10) <= F.lit(today)).filter(asked & (flag(selected) | flag(needs)))


def is_unreadable(value: str, fragments: list[str] | None = None) -> Column:
    """Question marks only, a negative time, or a registered fragment."""
    v = _t(value)
    out = v.rlike(r"^\?+$") | v.rlike(r"^-\d{1,3}:\d{2}")
    return out | v.isin(*fragments) if fragments else out


def ungated(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Rows of classes in which nothing is tagged yet."""
    tagged = df.filter(F.col(tag).isNotNull()).select(*keys).distinct()
    return df.join(tagged, keys, "left_anti")


def review_queue(lists: DataFrame, campaign: str | None = None, date_from: str | None = None, date_to: str | None = None, state: str | None = None, needle: str | None = None) -> DataFrame:
    """Lists of a campaign, a range of dates, a state, with a text in title or category."""
    out = lists
    if campaign:
        out = out.filter(F.col("campaign") == campaign)
    if date_from:
        out = out.filter(F.col("date") >= date_from)
    if date_to:
        out = out.filter(F.col("date") <= date_to)
    if state:
        out = out.filter(F.col("state") == state)
    if needle:
        out = out.filter(F.lower(F.concat_ws(" ", "title", "category")).contains(needle.lower()))
    return out
