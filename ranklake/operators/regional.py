"""Regional championships: what a list claims, which region a unit belongs to, and the ranks within it.

A list names regions in its class, its document or its titles. Each mapping of a list to a region
has an instance (region, stage, class); the units of the list are dealt to regions by printed
nation code, club or membership; a unit is claimed once a stage. Ranks count within an instance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.numbers import hash_id
from ..functions.text import _c, _t, category_key, compact_regions, folded_latin, regions, stripped
from .championship import nation_region, partitioned_claims
from .lineage import cut

MAPPING_ID, INSTANCE_ID, ENTRY_ID = "regional-map", "champ", "regional-entry"


def title_regions(text: Column | str) -> Column:
    """Regions that a title names, in full or by a code that stands alone."""
    safe = F.coalesce(_c(text), F.lit(""))
    for pattern, to in X.REGION_NOISE:
        safe = F.regexp_replace(safe, pattern, to)
    codes = F.regexp_extract_all(F.upper(folded_latin(safe)), F.lit(X.REGION_CODE_ALONE))
    table = F.create_map(*[F.lit(x) for kv in X.REGION_COMPACT.items() for x in kv])
    return F.array_distinct(F.concat(regions(safe), F.transform(codes, lambda c: F.element_at(table, c))))


def document_regions(file_name: Column | str) -> Column:
    """Regions whose own ranking a file name announces."""
    return F.array_compact(F.array(*[F.when(_t(file_name).rlike(p), code) for code, p in X.REGION_DOCUMENT.items()]))


def is_city_candidate(title: Column | str, stage_title: Column | str | None = None) -> Column:
    """Whether titles speak of a championship of the capital, and of no school or club."""
    text = F.concat_ws(" ", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(stage_title), F.lit("")) if stage_title is not None else F.lit(""))
    return ~text.rlike(X.NOT_CITY_TITLE) & F.array_contains(regions(text), "WIEN") & text.rlike(X.REGIONAL_TITLE)


def segments(category: Column | str) -> Column:
    """A class parted where a slash begins another gender and age."""
    parts = F.transform(F.split(F.coalesce(_c(category), F.lit("")), X.REGION_SEGMENT), stripped)
    return F.filter(parts, lambda p: p != "")


def canonical_category(segment: Column | str, explicit: Column, compact: Column) -> Column:
    """A class without the regions that were read from it: explicit by name or code, compact by code.

    A bracket goes if all it names is explicit; D and H stand for the genders.
    """
    whole = F.coalesce(_c(segment), F.lit(""))
    inner = F.regexp_extract_all(whole, F.lit(r"\(([^)]*)\)"), 1)
    goes = lambda x: (F.size(title_regions(x)) > 0) & (F.size(F.array_except(title_regions(x), explicit)) == 0)
    value = F.aggregate(inner, whole, lambda acc, x: F.when(goes(x), F.replace(acc, F.concat(F.lit("("), x, F.lit(")")), F.lit(""))).otherwise(acc))
    # a pattern that finds nothing where a step doesn't apply: the value stands once in every step
    for code, pattern in X.REGION_PATTERNS.items():
        value = F.regexp_replace(value, F.when(F.array_contains(explicit, code), pattern).otherwise("(?!)"), F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in X.REGION_COMPACT.items() for x in kv])
    codes = sorted(X.REGION_COMPACT, key=lambda c: (-len(c), c))
    accepted = F.array_join(F.filter(F.array(*map(F.lit, codes)), lambda c: F.array_contains(compact, F.element_at(table, c))), "|")
    for before, after in X.REGION_CODE_AROUND:
        value = F.regexp_replace(value, F.when(accepted != "", F.concat(F.lit("(?iuU)" + before), accepted, F.lit(after))).otherwise("(?!)"), F.lit(""))
    value = F.regexp_replace(F.regexp_replace(value, r"\s*[,/]+\s*$", ""), r"(?U)\s+", " ")
    value = F.btrim(value, F.lit(" -/,()"))
    for pattern, to in X.REGION_GENDERS:
        value = F.regexp_replace(value, pattern, to)
    return F.coalesce(F.nullif(value, F.lit("")), stripped(whole))


def regional_key(category: Column | str) -> Column:
    """The class's key, and the division A or B behind its age."""
    key = category_key(category)
    division = F.lower(F.regexp_extract(F.coalesce(_c(category), F.lit("")), X.REGION_DIVISION, 1))
    return F.when((division != "") & (key != ""), F.concat(key, division)).otherwise(key)


def mappings(lists: DataFrame) -> DataFrame:
    """A row for every region that a list claims, with what claims it; the strongest of a list, region and class.

    lists: list_id, category, file_name, event_title, stage_title, fingerprint, nations (the printed
    nation codes of its rows, may be null), others pass through. Region codes in a class count only
    where titles or document name the region too; a printed code confirms the region it names.
    Classes of frames, guests and foreign nations, and school or club titles, claim nothing. A
    class that is null or empty claims nothing.
    """
    titles = F.concat_ws(" ", F.coalesce("event_title", F.lit("")), F.coalesce("stage_title", F.lit("")))
    context = F.concat_ws(" ", titles, F.coalesce("file_name", F.lit("")))
    category = _t("category")
    out_of = category.rlike(X.REGIONAL_FRAME) | category.rlike(X.REGION_FOREIGN) | category.rlike(X.REGION_NO_STATE) | context.rlike(X.REGION_NO_TITLE)
    of_title = F.when(titles.rlike(X.REGION_EAST_TITLE), F.array_union(title_regions(titles), F.array(*map(F.lit, X.REGION_EAST)))).otherwise(title_regions(titles))
    df = lists.withColumn("_title", of_title).withColumn("_document", document_regions("file_name"))
    df = df.filter((category != "") & ~out_of & (context.rlike(X.REGIONAL_TITLE) | (F.size("_document") > 0)))
    df = cut(df.withColumn("_parts", segments(category)).withColumn("_segment", F.explode("_parts")), "regional-segments")
    known = F.array_union("_title", "_document")
    df = df.withColumn("_compact", F.array_intersect(compact_regions("_segment"), known))
    df = df.withColumn("_explicit", F.array_union(regions("_segment"), F.col("_compact")))
    df = df.filter((F.size("_explicit") > 0) | ~F.col("_segment").rlike(X.REGION_RUNDEN))
    df = df.withColumn("canonical_category", canonical_category("_segment", F.col("_explicit"), F.col("_compact")))
    df = cut(df, "regional-classes")  # the long expressions end here, once for each list and class
    df = df.withColumn("category_key", regional_key("canonical_category")).filter("category_key <> ''")
    explicit, document = F.size("_explicit") > 0, F.size("_document") > 0
    df = df.withColumn("evidence", F.when(document & ~explicit, "document").when(explicit, "category").when(F.size("_title") > 0, "event_title"))
    claimed = F.when(F.col("evidence") == "document", F.col("_document")).when(F.col("evidence") == "category", F.col("_explicit")).otherwise(F.col("_title"))
    df = df.withColumn("_several", F.size("_parts") > 1).withColumn("region", F.explode(F.array_sort(claimed)))
    text = F.when(F.col("evidence") == "category", F.col("_segment")).when(F.col("evidence") == "document", F.col("file_name")).otherwise(F.trim(titles))
    df = df.withColumn("evidence_text", text).withColumn("state", F.when(F.col("evidence") == "event_title", "candidate").otherwise("confirmed"))
    df = df.withColumn("confidence", F.when(F.col("evidence") == "event_title", 0.55).otherwise(1.0))
    many = F.size(F.collect_set("region").over(Window.partitionBy("list_id"))) > 1
    df = df.withColumn("partition_required", (F.col("evidence") != "document") | F.col("_several") | many)
    if "nations" in lists.columns:
        printed = F.array_join(F.array_sort(F.filter("nations", lambda n: nation_region(n) == F.col("region"))), ", ")
        df = cut(df.withColumn("_printed", F.nullif(printed, F.lit(""))), "regional-nations")
        said = F.col("_printed").isNotNull()
        df = df.withColumns({
            "evidence_text": F.when(said, F.concat(F.lit("Nat: "), "_printed")).otherwise(F.col("evidence_text")),
            "state": F.when(said, "confirmed").otherwise(F.col("state")),
            "confidence": F.when(said, 1.0).otherwise(F.col("confidence")),
            "partition_required": said | F.col("partition_required"),
            "evidence": F.when(said, "source_nat").otherwise(F.col("evidence")),
        }).drop("_printed")
    df = df.withColumn("mapping_id", hash_id(MAPPING_ID, "list_id", "region", "category_key"))
    n = F.row_number().over(Window.partitionBy("mapping_id").orderBy(strength().desc(), F.col("evidence_text")))
    out = df.withColumn("_n", n).filter("_n = 1").drop("_n", "_title", "_document", "_parts", "_segment", "_compact", "_explicit", "_several")
    return cut(out, "regional-mappings")


def strength(evidence: str = "evidence") -> Column:
    """How much a kind of evidence weighs."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in X.EVIDENCE_ORDER.items() for x in kv]), F.col(evidence))


def instances(claims: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """An instance for each region, stage and class, its state from the strongest claim or from a review of just these lists.

    claims: what `mappings` gives, with stage_id and fingerprint. decisions: instance_id,
    input_fingerprint, state; one on other fingerprints than today's is not asked.
    """
    best = F.max_by(F.struct("state", "evidence", "canonical_category"), F.struct((F.col("state") == "confirmed"), strength(), F.col("mapping_id")))
    out = claims.groupBy("region", "stage_id", "category_key").agg(best.alias("_b"), F.sha2(F.array_join(F.array_sort(F.collect_list("fingerprint")), "\0"), 256).alias("input_fingerprint"))
    out = out.withColumn("instance_id", hash_id(INSTANCE_ID, "region", "stage_id", "category_key", F.lit("LMS"))).select("instance_id", "region", "stage_id", "category_key", "input_fingerprint", F.col("_b.*"))
    if decisions is None:
        return out
    d = decisions.filter(F.col("state").isin("candidate", "confirmed", "rejected")).select(F.col("instance_id").alias("_i"), F.col("input_fingerprint").alias("_f"), F.col("state").alias("_s"))
    out = out.join(d, (F.col("instance_id") == F.col("_i")) & (F.col("input_fingerprint") == F.col("_f")), "left")
    return out.withColumn("state", F.coalesce("_s", "state")).drop("_i", "_f", "_s")


def claims_in_order(claims: DataFrame, lists: DataFrame, every: DataFrame) -> DataFrame:
    """Claims with their list's stage and day and their instance's id and state; `claim_order` puts confirmed instances, then strong evidence first.

    lists: list_id, stage_id, stage_date. Rejected claims and instances are left out.
    """
    own = lists.select("list_id", "stage_id", "stage_date")
    inst = every.filter("state <> 'rejected'").select("instance_id", "region", "stage_id", "category_key", F.col("state").alias("instance_state"))
    out = claims.filter("state <> 'rejected'").drop("stage_id", "stage_date").join(own, "list_id").join(inst, ["region", "stage_id", "category_key"])
    return out.withColumn("claim_order", F.struct((F.col("instance_state") != "confirmed").alias("late"), (-strength()).alias("weak"), F.col("mapping_id").alias("id")))


def unresolved_club(club: Column | str, known: Column, foreign: list[str] | None = None) -> Column:
    """Whether a unit carries a club that might be one of a region, but leads to none: not clubless, not foreign."""
    c = _t(club)
    abroad = F.lit(False)
    for word in foreign or []:
        abroad = abroad | F.lower(c).contains(word)
    return known.isNull() & (c != "") & ~c.rlike(X.CLUBLESS) & ~abroad


def unit_key(result: str = "result_id", person: str = "person_id", kind: str = "result_kind", number: str = "team_number", team_name_key: str = "team_key", rank: str = "rank", time: str = "time_s") -> Column:
    """A unit within a stage: a person, a team by number and name, or by name and result; else the row."""
    c, text = F.col, lambda x: F.coalesce(F.col(x).cast("string"), F.lit("None"))
    label = F.when(F.coalesce(c(number).cast("string"), F.lit("")) != "", F.concat_ws(":", F.lit("n"), F.trim(c(number).cast("string")), F.lit("t"), F.coalesce(c(team_name_key), F.lit("")))).otherwise(
        F.concat_ws(":", F.lit("t"), F.coalesce(c(team_name_key), F.lit("")), F.lit("r"), text(rank), F.lit("time"), text(time))
    )
    team = c(kind).isin("relay", "team", "pair")
    return F.when(team, F.concat_ws(":", c(kind), label)).when(c(person).isNotNull(), F.concat(F.lit("person:"), c(person).cast("string"))).otherwise(F.concat(F.lit("result:"), c(result).cast("string")))


def entries(ordered: DataFrame, results: DataFrame, club_regions: DataFrame, memberships: DataFrame, foreign: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries of instances with their units' regional ranks, and the issues met on the way.

    ordered: what `claims_in_order` gives. results: result_id, list_id, person_id, result_kind, unit,
    club, rank, status, time_s, out_of_competition, observed_nation. club_regions: club, region.
    memberships: person_id, club, valid_from, valid_to. Families, and units with a member out of
    competition, are no entries. Where the list must be parted, a unit goes to the one region that
    its printed codes name, else its clubs, else its members' clubs on the day; a unit of none or
    several is no entry, and an issue if a club of it may be one of a region.
    """
    rows = results.filter("result_kind <> 'family'").join(club_regions.select(F.col("club").alias("_club"), F.col("region").alias("_by_club")), F.col("club") == F.col("_club"), "left")
    rows = rows.withColumn("_nat", nation_region(F.col("observed_nation"))).withColumn("_open", unresolved_club("club", F.col("_by_club"), foreign))
    u = rows.groupBy("list_id", "unit").agg(
        F.array_sort(F.collect_list("result_id")).alias("result_ids"),
        F.collect_set("person_id").alias("_people"),
        F.collect_set("_nat").alias("_nats"),
        F.collect_set("_by_club").alias("_clubs"),
        F.bool_or("_open").alias("_open"),
        F.bool_or(F.coalesce("out_of_competition", F.lit(False))).alias("_out"),
        F.bool_or(F.col("status") == "ok").alias("_ok"),
        F.min(F.when(F.col("status") == "ok", F.col("rank"))).alias("source_rank"),
        F.min(F.when(F.col("status") == "ok", F.col("time_s"))).alias("time_s"),
    )
    c = ordered.join(u.filter("NOT _out"), "list_id")
    # members' regions on the day of the stage
    m = memberships.join(club_regions, "club").select(F.col("person_id").alias("_p"), F.col("region").alias("_r"), "valid_from", "valid_to")
    day = F.col("stage_date")
    inside = day.isNull() | ((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))
    asked = c.filter("partition_required AND size(_nats) = 0 AND size(_clubs) = 0").select("list_id", "unit", "stage_date", F.explode("_people").alias("_q")).distinct()
    by_member = asked.join(m, (F.col("_q") == F.col("_p")) & inside).groupBy("list_id", "unit").agg(F.collect_set("_r").alias("_members"))
    c = c.join(by_member, ["list_id", "unit"], "left").withColumn("_members", F.coalesce("_members", F.array().cast("array<string>")))
    only = lambda x: (F.size(x) == 1) & F.array_contains(x, F.col("region"))
    basis = (
        F.when(~F.col("partition_required"), F.concat(F.lit("explicit-regional-"), "evidence"))
        .when(F.size("_nats") > 0, F.when(only("_nats"), "explicit-source-nat"))
        .when(only("_clubs"), "event-time-club-jurisdiction")
        .when((F.size("_clubs") == 0) & only("_members"), "event-time-person-club-membership")
    )
    c = c.withColumn("basis", basis)
    taken = partitioned_claims(c.filter("basis IS NOT NULL").withColumn("_in", F.array_min("result_ids")))
    won = taken.filter("accepted").withColumn("entry_id", hash_id(ENTRY_ID, "instance_id", "unit"))
    # ranks among the entries of an instance: equal source ranks and times share one
    placed = Window.partitionBy("instance_id", "_ok").orderBy(F.col("source_rank").asc_nulls_last(), F.col("time_s").asc_nulls_first())
    sure = F.col("instance_state") == "confirmed"
    out = won.withColumn("regional_rank", F.when(F.col("_ok"), F.rank().over(placed)))
    out = out.select(
        "entry_id", "instance_id", "region", "stage_id", "unit", "list_id", "result_ids", F.col("basis").alias("eligibility_basis"),
        F.when(sure, "eligible").otherwise("provisional").alias("eligibility_state"), F.when(sure, "derived").otherwise("provisional").alias("entry_state"), "regional_rank",
    )
    # a row that two regions claim, and lists whose units nothing parts
    double = taken.filter("NOT accepted").join(won.select("stage_id", "unit", F.col("region").alias("_won"), F.col("result_ids").alias("_rows")), ["stage_id", "unit"])
    double = double.filter((F.col("region") != F.col("_won")) & F.arrays_overlap("result_ids", "_rows"))
    double = double.select("list_id", F.lit("regional_double_assignment").alias("code"), F.lit("blocker").alias("severity")).distinct()
    lost = c.filter("partition_required AND basis IS NULL AND size(_nats) = 0 AND size(_clubs) = 0 AND size(_members) = 0 AND _open")
    lost = lost.groupBy("list_id", "instance_id", F.col("state").alias("_state")).agg(F.bool_or("_ok").alias("_any_ok"))
    lost = lost.join(out.groupBy("instance_id").agg(F.count("*").alias("_assigned")), "instance_id", "left")
    warned = (F.col("_state") == "confirmed") & F.col("_assigned").isNull() & F.col("_any_ok")
    lost = lost.select("list_id", F.lit("regional_membership_unresolved").alias("code"), F.when(warned, "warning").otherwise("info").alias("severity"))
    return out, double.unionByName(lost)


def podiums(entered: DataFrame, results: DataFrame, region: str | None = None, club: str | None = None, person_id: int | None = None) -> DataFrame:
    """entry_id, rank, region and each member's result of places 1 to 3 of confirmed instances; a member of two legs once."""
    won = entered.filter("eligibility_state = 'eligible' AND regional_rank BETWEEN 1 AND 3")
    if region:
        won = won.filter(F.col("region") == region)
    rows = won.select("entry_id", "instance_id", "region", "stage_id", F.col("regional_rank").alias("rank"), F.explode("result_ids").alias("result_id"))
    rows = rows.join(results.select("result_id", "person_id", "official_club", "result_kind", "category"), "result_id")
    if club:
        rows = rows.filter(F.col("official_club") == club)
    if person_id is not None:
        rows = rows.filter(F.col("person_id") == person_id)
    return rows.drop("result_id").distinct()
