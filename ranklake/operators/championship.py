"""National and regional championships: tags, eligibility, units, ranks and awards. One pass a rule, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.numbers import hash_id
from ..functions.text import min_age, open_eligible, state_eligible, title_championships
from .units import team_key


def api_tag(championships: Column) -> Column:
    """The first national type in an array of short names."""
    return F.get(F.filter(championships, lambda c: c.isin("ÖM", "ÖSTM")), 0)


def title_fallback(results: DataFrame, stages: DataFrame, events: DataFrame) -> DataFrame:
    """Results with championship filled from titles in classes where nothing is tagged.

    An event of which any stage title names a championship is judged stage by stage, else by its
    own title and slug. A youth-only title leaves classes `ab ..` out, a senior-only one classes
    under 35. Individuals of overlap classes get no tag.
    """
    s = stages.withColumn("_own", title_championships("stage_title"))
    per_stage = Window.partitionBy("event_id")
    s = s.withColumn("_any", F.max(F.size("_own") > 0).over(per_stage))
    s = s.join(events.select("event_id", "title", "slug"), "event_id").withColumn("_types", F.when(F.col("_any"), F.col("_own")).otherwise(title_championships("title", "slug")))
    text = F.lower(F.concat_ws(" ", "title", "slug", "stage_title"))
    s = s.withColumn("_youth", text.rlike(X.YOUTH_TITLE) & ~text.contains("sen")).withColumn("_senior", text.rlike(X.SENIOR_TITLE) & ~text.rlike(r"(?iu)jugend|nachwuchs|junioren"))
    s = s.select("stage_id", "_types", "_youth", "_senior").filter(F.size("_types") > 0)
    tagged = results.filter(F.col("championship").isNotNull()).select("stage_id", "category").distinct().withColumn("_tagged", F.lit(True))
    out = results.join(s, "stage_id", "left").join(tagged, ["stage_id", "category"], "left")
    allowed = ~(F.col("_youth") & F.col("category").rlike(X.FROM_AGE)) & ~(F.col("_senior") & (F.coalesce(min_age("category"), F.lit(0)) < 35))
    allowed = allowed & ~((F.col("result_kind") == "individual") & F.col("category").rlike(X.AGE_OVERLAP))
    tag = F.when(F.array_contains("_types", "ÖSTM") & state_eligible("category"), "ÖSTM").when(F.array_contains("_types", "ÖM") & open_eligible("category"), "ÖM")
    new = F.when(F.col("_tagged").isNull() & F.col("championship").isNull() & (F.col("status") == "ok") & F.coalesce(allowed, F.lit(False)), tag)
    return out.withColumn("championship", F.coalesce("championship", new)).drop("_types", "_youth", "_senior", "_tagged")


def overlap_stripped(results: DataFrame) -> DataFrame:
    gone = (F.col("result_kind") == "individual") & F.col("category").rlike(X.AGE_OVERLAP)
    return results.withColumn("championship", F.when(~gone, F.col("championship")))


def ooc_stripped(results: DataFrame) -> DataFrame:
    return results.withColumn("championship", F.when(~F.col("out_of_competition"), F.col("championship")))


def overrides_stripped(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tags go where the ledger refuses the person at the event, but never from an official ranking."""
    no = ledger.filter(~F.col("decision").isin("true", "error")).select("person_id", "event_id").distinct().withColumn("_no", F.lit(True))
    out = results.join(no, ["person_id", "event_id"], "left")
    gone = F.coalesce("_no", F.lit(False)) & (F.coalesce("eligibility_basis", F.lit("")) != "official_championship_ranking")
    return out.withColumn("championship", F.when(~gone, F.col("championship"))).drop("_no")


def nation_region(code: Column) -> Column:
    """The region of a printed nation code, null for anything else."""
    c = F.regexp_replace(F.lower(F.regexp_replace(code, r"\s+", "")), r"\.+$", "")
    return F.element_at(F.create_map(*[F.lit(x) for kv in X.REGION_NATION_CODES.items() for x in kv]), c)


def configured_stage(stages: DataFrame, pattern: str) -> DataFrame:
    """The stage of each event whose title fits, where exactly one does."""
    hit = stages.filter(F.col("stage_title").rlike(pattern))
    return hit.groupBy("event_id").agg(F.count_distinct("stage_id").alias("_n"), F.min("stage_id").alias("stage_id")).filter("_n = 1").drop("_n")


def registered_evidence(documents: DataFrame) -> DataFrame:
    """Rows of official ranking documents as evidence, with ids by content.

    documents: stage_id, source_document_id, scope, rows array<struct<category_key, name_key, rank, club>>.
    """
    e = documents.select("stage_id", "source_document_id", "scope", F.posexplode("rows").alias("pos", "r")).select("stage_id", "source_document_id", "scope", "pos", "r.*")
    return e.withColumn("evidence_id", hash_id("evidence", "stage_id", "source_document_id", "category_key", "name_key", "pos"))


def eligibility(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """eligibility and its basis of tagged rows: official ranking, nationality, ledger, club, none — the first that speaks.

    ledger: person_id, event_id, decision (true, false, error).
    """
    d = ledger.select("person_id", "event_id", "decision")
    out = results.join(d, ["person_id", "event_id"], "left")
    official = F.col("eligibility_basis") == "official_championship_ranking"
    basis = (
        F.when(official, F.col("eligibility_basis"))
        .when(F.col("nationality") == "AUT", "nationality")
        .when(F.col("decision") == "true", "ledger")
        .when(F.col("official_club").isNotNull(), "club_inference")
        .otherwise("none")
    )
    state = F.when(official | basis.isin("nationality", "ledger"), "eligible").when(basis == "club_inference", "provisional").otherwise("unknown")
    tagged = F.col("championship").isNotNull()
    return out.withColumn("eligibility", F.when(tagged, state)).withColumn("eligibility_basis", F.when(tagged, basis).otherwise(F.col("eligibility_basis"))).drop("decision")


def ineligible_starters(results: DataFrame, ledger: DataFrame | None = None, keywords: list[str] | None = None, hosts: list[int] | None = None) -> DataFrame:
    """event_id, person_id of starters no title can go to: guest codes and teams, foreign clubs, the clubless, ledger refusals, guests of foreign hosts."""
    club = F.coalesce(F.col("club"), F.lit(""))
    reason = club.rlike(X.GUEST_CODE) | (club.rlike(X.GUEST_TEAM) & ~club.rlike(X.GUEST_TEAM_HOME)) | club.rlike(X.CLUBLESS)
    for k in keywords or []:
        reason = reason | F.lower(club).contains(k)
    if hosts:
        reason = reason | (F.col("event_id").isin(*hosts) & F.col("official_club").isNull())
    out = results.filter(F.col("person_id").isNotNull() & reason).select("event_id", "person_id")
    if ledger is not None:
        official = results.filter(F.col("eligibility_basis") == "official_championship_ranking").select("event_id", "person_id").distinct()
        refused = ledger.filter(~F.col("decision").isin("true", "error")).select("event_id", "person_id")
        out = out.unionByName(refused.join(official, ["event_id", "person_id"], "left_anti"))
    return out.distinct()


def tainted(results: DataFrame, ineligible: DataFrame) -> DataFrame:
    """Tags go from ineligible starters, and from every pair or team with one of them.

    A pair falls with any row of its class that has its rank; a team with its own members only.
    """
    bad = ineligible.select("event_id", "person_id").distinct().withColumn("_bad", F.lit(True))
    out = results.join(bad, ["event_id", "person_id"], "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    out = out.withColumn("_team", F.coalesce(team_key("team_number", "team_name", "club"), F.lit("")))
    by_rank = F.max("_bad").over(Window.partitionBy("stage_id", "category", "rank"))
    by_team = F.max("_bad").over(Window.partitionBy("stage_id", "category", "result_kind", "_team"))
    gone = F.col("_bad") | ((F.col("result_kind") == "pair") & F.col("rank").isNotNull() & by_rank) | (F.col("result_kind").isin("relay", "team") & by_team)
    return out.withColumn("championship", F.when(~gone, F.col("championship"))).drop("_bad", "_team")


def source_evidence(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """Results with evidence_id and scope: by stage, class and name, else for inclusion evidence by rank, then by club where any club fits.

    evidence: evidence_id, stage_id, category_key, name_key, rank, club, scope (inclusion or field).
    """
    e = evidence.select(*[F.col(c).alias(f"e_{c}") for c in ("evidence_id", "stage_id", "category_key", "name_key", "rank", "club", "scope")])
    same = (F.col("stage_id") == F.col("e_stage_id")) & (F.col("category_key") == F.col("e_category_key"))
    by_name = results.join(e, same & (F.col("name_key") == F.col("e_name_key"))).withColumn("_tier", F.lit(0))
    by_rank = results.join(e.filter("e_scope = 'inclusion'"), same & (F.col("rank") == F.col("e_rank"))).withColumn("_tier", F.lit(1))
    every = by_name.unionByName(by_rank)
    w = Window.partitionBy("e_evidence_id")
    every = every.withColumn("_best", F.min("_tier").over(w)).filter("_tier = _best")
    fits = F.coalesce(F.col("club") == F.col("e_club"), F.lit(False))
    every = every.withColumn("_fits", fits).withColumn("_some", F.max("_fits").over(w)).filter("_fits OR NOT _some")
    n = F.row_number().over(w.orderBy("seq"))
    every = every.withColumn("_n", n).filter("e_scope = 'inclusion' OR _n = 1")
    return every.select(*results.columns, F.col("e_evidence_id").alias("evidence_id"), F.col("e_scope").alias("evidence_scope"))


def national_instances(results: DataFrame) -> DataFrame:
    """A championship for each stage, class and type, its lists' fingerprints joined in order."""
    tagged = results.filter(F.col("championship").isNotNull())
    out = tagged.groupBy("stage_id", "category", "championship").agg(F.array_join(F.array_sort(F.collect_set("fingerprint")), ",").alias("fingerprints"))
    return out.withColumn("instance_id", hash_id("championship", F.lit("AUT"), "stage_id", "category", "championship"))


def awards(results: DataFrame, instance: str = "instance_id", place: str = "national_rank", state: str = "eligibility") -> DataFrame:
    """Medals of places 1 to 3; provisional where the eligibility is."""
    medal = F.element_at(F.array(*map(F.lit, X.MEDALS.values())), F.col(place).cast("int"))
    won = results.filter(F.col(place).between(1, 3) & (F.col("status") == "ok") & ~F.col("out_of_competition") & F.col(state).isin("eligible", "provisional"))
    return won.select(hash_id("award", instance, "result_id").alias("award_id"), instance, "result_id", medal.alias("medal"), F.col(place).alias("place"), F.when(F.col(state) == "eligible", "derived").otherwise("provisional").alias("state"))


def partitioned_claims(units: DataFrame) -> DataFrame:
    """One region for each stage and unit: confirmed instances first, then the strongest evidence, then the mapping's id.

    units: stage_id, unit, region, instance_state, evidence, mapping_id.
    """
    strength = F.element_at(F.create_map(*[F.lit(x) for kv in X.EVIDENCE_ORDER.items() for x in kv]), F.col("evidence"))
    by = Window.partitionBy("stage_id", "unit").orderBy((F.col("instance_state") != "confirmed").asc(), strength.desc(), "mapping_id")
    out = units.withColumn("claim", F.row_number().over(by))
    return out.withColumn("accepted", F.col("claim") == 1)


def unit_region(units: DataFrame, club_regions: DataFrame, memberships: DataFrame, date: str = "stage_date") -> DataFrame:
    """region of a unit: the printed nation code, else its club's, else the one its members had on the day."""
    clubs = club_regions.select(F.col("club").alias("_club"), F.col("region").alias("_by_club"))
    m = memberships.join(club_regions.withColumnRenamed("region", "_r"), "club").select(F.col("person_id").alias("_p"), "_r", "valid_from", "valid_to")
    inside = F.col(date).isNull() | ((F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(date))) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col(date))))
    by_member = units.join(m, (F.col("person_id") == F.col("_p")) & inside).groupBy("unit_id").agg(F.collect_set("_r").alias("_rs"))
    by_member = by_member.select(F.col("unit_id").alias("_u"), F.when(F.size("_rs") == 1, F.element_at("_rs", 1)).alias("_by_member"))
    out = units.join(clubs, F.col("club") == F.col("_club"), "left").join(by_member, F.col("unit_id") == F.col("_u"), "left")
    basis = F.when(F.col("source_nat").isNotNull(), "source_nat").when(F.col("_by_club").isNotNull(), "club").when(F.col("_by_member").isNotNull(), "membership").otherwise("unresolved")
    return out.withColumn("region", F.coalesce("source_nat", "_by_club", "_by_member")).withColumn("region_basis", basis).drop("_club", "_by_club", "_u", "_by_member")
