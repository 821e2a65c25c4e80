"""A build: documents and registers to published tables, one pass a rule, in order.

Later rules read what earlier ones decided, so the passes are cut by tables in the shared folder:
each is computed once, and a lost executor costs one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import hash_id, stage_id
from ..functions.text import is_valid_name, name_key, qualitative
from ..operators import championship as C
from ..operators import dedup as D
from ..operators import evidence as EV
from ..operators import identity as E
from ..operators import quality as Q
from ..operators import ranking as W
from ..operators import units as U
from ..operators.lineage import cut
from ..sources import readers, writers


#: Up to this many distinct club names (under 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_CLUBS = 100_000


def build(spark: SparkSession, documents: str, registry: DataFrame, official_clubs: DataFrame, events: DataFrame, ledger: DataFrame | None = None) -> dict[str, DataFrame]:
    """result, result_list, issue, award, check from a folder of normalized documents.

    registry: person_id, name_key, birth_year, club. events: event_id, title, slug.
    """
    docs = readers.documents(spark, documents)
    rows = cut(readers.document_rows(docs), "rows").filter(is_valid_name("name") | F.col("result_kind").isin("relay", "team"))
    rows = rows.withColumn("stage_id", F.when(F.col("stageNumber").isNull(), stage_id("event_id")).otherwise(stage_id("event_id", "stageNumber")))
    rows = rows.withColumn("rank", F.when(~qualitative("observed_time"), F.col("rank")))
    # processing order: relays before others within an event, then by file
    order = F.struct("event_id", (F.col("listType") != "relay").alias("late"), "path", "category_pos", "row_pos")
    rows = rows.withColumn("seq", order).withColumn("source_document_id", hash_id("document", "path")).withColumn("list_id", hash_id("list", "stage_id", "source_document_id", "category"))
    rows = rows.withColumn("result_id", F.abs(F.xxhash64("path", "category_pos", "row_pos"))).withColumn("name_key", name_key("name"))
    clubs = cut(EV.canonical_clubs(rows.select("club"), official_clubs), "clubs")
    rows = cut(rows.join(F.broadcast(clubs) if clubs.count() <= BROADCAST_CLUBS else clubs, "club", "left"), "rows")

    lists = rows.groupBy("list_id").agg(F.first("event_id").alias("event_id"), F.first("stage_id").alias("stage_id"), F.first("category").alias("category"), F.first("declared").alias("declared"), F.first("source").alias("source"), F.min("seq").alias("list_seq"))
    unit = U.source_unit("row_pos", "result_kind", "name", "rank", "status", "time_s", "club", "note", "team_number", "team_name")
    units = rows.groupBy("list_id").agg(F.count_distinct(unit).alias("source_units"))
    prints = Q.list_fingerprint(rows, "list_id", "seq", ["name", "club", "rank", "status", "time_s"])
    lists = lists.join(units, "list_id").join(prints, "list_id").withColumn("ranking_basis", F.lit("time")).withColumn("category_full", F.lit(None).cast("string"))

    rows = rows.join(lists.select("list_id", "list_seq", "fingerprint", "ranking_basis"), "list_id")
    team = U.dedup_unit("result_kind", "rank", "status", "time_s", "club", "note", "team_number", "team_name", "leg_number", F.lit(False))
    rows = rows.withColumn("unit", F.coalesce(team, F.lit("")))
    rows = D.first_list_wins(rows, ["stage_id", "category", "name_key", "result_kind", "unit"], ["name", "rank", "status", "time_s", "observed_time", "club", "note"], "list_seq", "seq")

    rows = W.tie_filled(rows, ["list_id"], "seq", is_classified=W.classified() & (F.col("result_kind") == "individual"), out="filled").withColumn("rank", F.col("filled")).drop("filled")
    rows = W.winner_recovered(rows, ["stage_id", "category"]).withColumn("rank", F.col("rank_recovered")).drop("rank_recovered")
    rows = W.time_behind(rows, ["list_id"], counts=W.classified(), basis="ranking_basis", out="time_behind_s")

    rows = cut(rows, "rows")
    matched = E.registry_match(rows.withColumn("club_raw", F.col("club")).withColumn("club", F.coalesce("official_club", "club")), registry).withColumn("club", F.col("club_raw")).drop("club_raw")
    people = E.resolved(matched.select("result_id", "name_key", "birth_year", "seq", "user_id", "registry_id", "basis"))
    rows = rows.join(people.select("result_id", "person_id", "identity_state", "identity_confidence"), "result_id")
    family = F.col("result_kind") == "family"
    rows = rows.withColumn("person_id", F.when(~family, F.col("person_id"))).withColumn("identity_state", F.when(family, "not_applicable").otherwise(F.col("identity_state"))).withColumn("identity_basis", F.lit("name"))

    rows = cut(rows, "rows")
    stages = rows.select("stage_id", "event_id").distinct().withColumn("stage_title", F.lit(None).cast("string"))
    rows = W.champion_boundary(rows, ["stage_id", "category"]).withColumn("championship", F.col("championship_spread")).drop("championship_spread")
    rows = C.title_fallback(rows, stages, events)
    rows = cut(rows, "rows")
    rows = C.ooc_stripped(C.overlap_stripped(rows))
    rows = rows.withColumn("nationality", F.lit(None).cast("string")).withColumn("eligibility_basis", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "person_id long, event_id long, decision string")
    rows = C.eligibility(rows, ledger if ledger is not None else none)
    rows = C.tainted(rows, C.ineligible_starters(rows, ledger))
    rows = rows.withColumn("individual_status", F.lit(None).cast("string")).withColumn("team_time_s", F.lit(None).cast("int"))
    rows = writers.with_defaults(rows)
    national = F.when(F.col("result_kind").isin("relay", "team"), U.team_key("team_number", "team_name", "club")).otherwise(F.concat(F.lit("row:"), F.col("result_id").cast("string")))
    good = (F.col("status") == "ok") & F.col("championship").isNotNull() & F.col("eligibility").isin("eligible", "provisional")
    rows = W.units_ahead_rank(rows.withColumn("_unit_key", national), ["stage_id", "category"], "_unit_key", counts=good).drop("_unit_key")

    rows = cut(rows, "rows")
    instances = C.national_instances(rows)
    won = C.awards(rows.join(instances.select("stage_id", "category", "championship", "instance_id"), ["stage_id", "category", "championship"]))
    issues = Q.findings(lists, rows.drop("event_id", "category", "source", "ranking_basis", "stage_id"))
    checks = Q.invariants({"result": rows, "result_list": lists, "award": won})
    return {"result": rows, "result_list": lists.drop("list_seq"), "issue": issues, "instance": instances, "award": won, "check": checks}
