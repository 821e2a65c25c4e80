"""Documents to the stages and days they report on, and the audit of what is covered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X

#: Words that name a discipline in titles and file names. Fixed values.
DISCIPLINES = ("sprint", "mittel", "lang", "nacht", "staffel", "ultralang", "mixed")


def discipline(text: Column) -> Column:
    """The one discipline that a text names, else null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(t.rlike(rf"(?<!\p{{L}}){d}"), d) for d in DISCIPLINES]))
    return F.when(F.size(found) == 1, F.get(found, 0))


def round_number(text: Column) -> Column:
    """The number of `3. Lauf`, `Etappe 2`, `E2` or `stage 2`."""
    t = F.coalesce(text, F.lit(""))
    pick = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("int")
    return F.coalesce(*map(pick, X.ROUND_NUMBERS))


#: Stages that an event has by itself are numbered from here on.
DEFAULT_STAGES = 10_000_000


def with_default_stages(events: DataFrame, stages: DataFrame) -> DataFrame:
    """stages, and for every event without any one of its own: first and only, on the event's first day.

    events: event_id, date_from, location. stages: stage_id, event_id, number, title, date, location.
    """
    bare = events.dropDuplicates(["event_id"]).join(stages.select("event_id"), "event_id", "left_anti")
    own = bare.select((F.col("event_id") + DEFAULT_STAGES).alias("stage_id"), "event_id", F.lit(1).alias("number"), F.lit(None).cast("string").alias("title"), F.nullif(F.substring("date_from", 1, 10), F.lit("")).alias("date"), "location")
    return stages.select(*own.columns).unionByName(own)


def mapped_stages(docs: DataFrame, stages: DataFrame) -> DataFrame:
    """docs with stage_id and how: by explicit number, round number, the only stage of its discipline, the only stage of its day.

    docs: event_id, document_id, number, text, day. stages: event_id, stage_id, number, title, day.
    An event counts only if its documents reach two stages; what stays unmatched has no stage.
    """
    st = stages.select(F.col("event_id").alias("_e"), F.col("stage_id").alias("_s"), F.col("number").alias("_n"), discipline(F.col("title")).alias("_d"), F.col("day").alias("_day"))
    one = lambda key: st.filter(F.col(key).isNotNull()).groupBy("_e", key).agg(F.count_distinct("_s").alias("_c"), F.min("_s").alias("_m")).filter("_c = 1").drop("_c")
    out = docs.withColumn("_round", round_number(F.col("text"))).withColumn("_disc", discipline(F.col("text")))
    for i, (own, key) in enumerate((("number", "_n"), ("_round", "_n"), ("_disc", "_d"), ("day", "_day"))):
        table = one(key).select(F.col("_e").alias(f"_e{i}"), F.col(key).alias(f"_k{i}"), F.col("_m").alias(f"_m{i}"))
        out = out.join(table, (F.col("event_id") == F.col(f"_e{i}")) & (F.col(own) == F.col(f"_k{i}")), "left").drop(f"_e{i}", f"_k{i}")
    found = F.coalesce(*[F.col(f"_m{i}") for i in range(4)])
    how = F.when(F.col("_m0").isNotNull(), "number").when(F.col("_m1").isNotNull(), "round").when(F.col("_m2").isNotNull(), "discipline").when(F.col("_m3").isNotNull(), "day")
    out = out.withColumn("_f", found).withColumn("_how", how)
    w = Window.partitionBy("event_id")
    enough = F.size(F.collect_set("_f").over(w)) >= 2
    return out.withColumn("stage_id", F.when(enough, F.col("_f"))).withColumn("mapped_by", F.when(enough, F.col("_how"))).drop("_f", "_how", "_round", "_disc", *[f"_m{i}" for i in range(4)])


def corrected_days(docs: DataFrame, stages: DataFrame) -> DataFrame:
    """day of a document: that of its round, else that of its file name, if the event has a stage on it; else as it was.

    docs: event_id, text, day, name_day.
    """
    by_round = stages.groupBy(F.col("event_id").alias("_e1"), F.col("number").alias("_n")).agg(F.min("day").alias("_round_day"))
    days = stages.select(F.col("event_id").alias("_e2"), F.col("day").alias("_known")).distinct()
    out = docs.withColumn("_r", round_number(F.col("text"))).join(by_round, (F.col("event_id") == F.col("_e1")) & (F.col("_r") == F.col("_n")), "left")
    out = out.join(days, (F.col("event_id") == F.col("_e2")) & (F.col("name_day") == F.col("_known")), "left")
    return out.withColumn("day", F.coalesce("_round_day", "_known", "day")).drop("_r", "_e1", "_n", "_round_day", "_e2", "_known")


def coverage_audit(calendar: DataFrame, snapshot: DataFrame, cached: DataFrame, parsed: DataFrame, published: DataFrame, shadowed: DataFrame, excluded: DataFrame, clones: DataFrame, duplicates: DataFrame, key: str = "event_id") -> DataFrame:
    """key, state and reason of every calendar event: how far it came, and why it came no further.

    Reasons are asked in order: shadowed by another source, excluded, a clone, a duplicate, else unexplained.
    """
    out = calendar.select(key).distinct()
    steps = (("snapshot", snapshot), ("cached", cached), ("parsed", parsed), ("published", published))
    reasons = (("shadowed", shadowed), ("excluded", excluded), ("clone", clones), ("duplicate", duplicates))
    for name, table in (*steps, *reasons):
        out = out.join(table.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    state, reason = F.lit("published"), F.lit("unexplained")
    for name, _ in reversed(steps):
        state = F.when(F.col(f"_{name}").isNull(), f"not_{name}").otherwise(state)
    for name, _ in reversed(reasons):
        reason = F.when(F.col(f"_{name}"), name).otherwise(reason)
    return out.withColumn("state", state).withColumn("reason", F.when(F.col("state") != "published", reason)).select(key, "state", "reason")


def coverage_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("state", "reason").agg(F.count("*").alias("n"))


def source_reasons(sources: DataFrame, events: DataFrame, published: DataFrame, excluded: DataFrame) -> DataFrame:
    """sources with `state` of each: published, one of the reasons why parsed rows weren't published, or why a cached source has none.

    sources: event_id, source_id, cached, skipped, ambiguous, parsed_rows, is_published, digest.
    events: event_id, title. published: event_id of events with results. excluded: event_id.
    Reasons are asked in order: a better source of the event, an excluded event, a clone's title, an
    equal copy published elsewhere, else unexplained. Null flags are false, null counts none.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    mark = lambda t, c: t.select("event_id").distinct().withColumn(c, F.lit(True))
    copies = sources.filter(flag("is_published") & F.col("digest").isNotNull()).select("digest").distinct().withColumn("_copy", F.lit(True))
    out = sources.join(mark(published, "_results"), "event_id", "left").join(mark(excluded, "_excluded"), "event_id", "left")
    out = out.join(events.groupBy("event_id").agg(F.first("title").alias("_title")), "event_id", "left").join(copies, "digest", "left")
    parsed = F.coalesce("parsed_rows", F.lit(0)) > 0
    clone = F.lower(F.coalesce("_title", F.lit(""))).contains("bewertung")
    state = (
        F.when(parsed & flag("is_published"), "published")
        .when(parsed & flag("_results"), "shadowed")
        .when(parsed & flag("_excluded"), "excluded_with_event")
        .when(parsed & clone, "clone")
        .when(parsed & flag("_copy"), "copy")
        .when(parsed, "unexplained")
        .when(flag("cached") & flag("skipped"), "skipped")
        .when(flag("cached") & flag("ambiguous"), "ambiguous_gap")
        .when(flag("cached"), "parser_gap")
        .otherwise("not_cached")
    )
    return out.withColumn("state", state).withColumn("blind", ~flag("_results") & ~flag("_excluded") & ~clone).drop("_results", "_excluded", "_title", "_copy")


def coverage_counters(events: DataFrame, external: DataFrame, published: DataFrame, excluded: DataFrame, sources: DataFrame) -> DataFrame:
    """counter, n: the fourteen counts of an audit, of events and of their sources. See `source_reasons` for the tables.

    external: event_id of a calendar that the snapshot should hold. An empty table counts as none.
    """
    s = source_reasons(sources, events, published, excluded)
    per_event = s.groupBy("event_id").agg(F.bool_or(F.col("state") == "parser_gap").alias("gap"), F.sum(F.coalesce("parsed_rows", F.lit(0))).alias("rows"), F.bool_and("blind").alias("blind"))
    names = {
        "parser_gap": "cached_sources_without_parsed_rows", "ambiguous_gap": "ambiguous_cached_sources_without_parsed_rows", "skipped": "expected_skipped_sources",
        "shadowed": "parsed_sources_shadowed_by_better_source", "copy": "duplicate_sources_published_elsewhere", "clone": "excluded_bewertung_clones",
        "excluded_with_event": "parsed_sources_excluded_with_event", "unexplained": "unexplained_unpublished_sources",
    }
    counts = s.agg(*[F.count_if(F.col("state") == k).alias(n) for k, n in names.items()], F.count_if(F.col("state").isin("shadowed", "copy", "clone", "excluded_with_event", "unexplained")).alias("parsed_sources_not_published"))
    ids = lambda t: t.select("event_id").distinct()
    one = lambda t, n: t.agg(F.count("*").alias("n")).select(F.lit(n).alias("counter"), "n")
    wide = counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, counts.columns)), F.array(*counts.columns))).alias("counter", "n"))
    every = [
        one(ids(events), "calendar_events"), one(ids(external).join(ids(events), "event_id", "left_anti"), "external_events_not_in_snapshot"),
        one(ids(events).join(ids(published), "event_id", "left_anti"), "snapshot_events_not_in_database"), one(ids(excluded), "excluded_events_without_usable_results"),
        one(per_event.filter("gap AND blind AND rows = 0"), "events_with_result_source_but_no_results"),
    ]
    return reduce(DataFrame.unionByName, every, wide)


def fixed_order(column: str, order: list[str]) -> Column:
    """A sort key: the place in a list, what isn't in it last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(place > 0, place).otherwise(len(order) + 1)
