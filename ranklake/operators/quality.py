"""Findings, reports, invariants, fingerprints and review decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.numbers import hash_id
from ..functions.text import _t, family_class
from .filters import is_unreadable
from .ordering import numbered
from .units import team_key

FINDING = ("list_id", "result_id", "code", "severity", "auto_resolvable")


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _finding(df: DataFrame, code: str | Column, severity: str | Column, result: str | None = None, auto: bool = False) -> DataFrame:
    return df.select("list_id", (F.col(result).cast("long") if result else F.lit(None).cast("long")).alias("result_id"), _lit(code).alias("code"), _lit(severity).alias("severity"), F.lit(auto).alias("auto_resolvable"))


def _marked(df: DataFrame, register: DataFrame | None, keys: list[str], out: str) -> DataFrame:
    """df with a flag for rows whose keys stand in a register of exact cases."""
    if register is None:
        return df.withColumn(out, F.lit(False))
    r = register.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn(f"_{out}", F.lit(True))
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(r, on, "left").withColumn(out, F.coalesce(f"_{out}", F.lit(False))).drop(f"_{out}", *[f"_{k}" for k in keys])


def findings(lists: DataFrame, results: DataFrame, registers: dict[str, DataFrame] | None = None) -> DataFrame:
    """list_id, result_id, code, severity, auto_resolvable, issue_id of every rule that applies.

    lists: list_id, event_id, stage_id, category, category_full, declared, source_units, source,
    ranking_basis. results: result_id, list_id, status, rank, time_s, out_of_competition,
    result_kind, name, person_id, observed_status, observed_time, individual_status, note,
    identity_state, championship. registers: exact reviewed cases by name (recovered, confirmed
    and count_anomaly by event_id, category, declared, source_units; missing_value by event_id,
    category, name; unreadable by event_id, category, name, value; rank_anomaly by event_id,
    category; missing_category by event_id).
    """
    known = registers or {}
    api = F.col("source") == "api"
    individual = F.col("result_kind") == "individual"
    fair = (F.col("status") == "ok") & ~F.coalesce(F.col("out_of_competition"), F.lit(False))
    counted = ~F.coalesce(F.col("out_of_competition"), F.lit(False)) & individual
    # one pass over results for all that lists are judged by: counts by list and rank, and each rank's least fair time
    raced = fair & ~F.col("result_kind").isin("relay", "team", "family") & F.col("rank").isNotNull()
    per_rank = results.groupBy("list_id", "rank").agg(
        F.count("*").alias("persisted"),
        F.count_if(individual).alias("individuals"),
        F.count_if(counted & F.col("time_s").isNotNull()).alias("timed"),
        F.count_if(counted & F.col("rank").isNotNull()).alias("ranked"),
        F.count_if(counted & F.col("time_s").isNotNull() & (F.col("status") == "ok")).alias("timed_ok"),
        F.count_if(F.col("rank").isNull() & fair & F.col("result_kind").isin("individual", "family")).alias("unranked_ok"),
        F.count_if(F.coalesce(F.col("note"), F.lit("")).contains("minutengenau")).alias("minute_rows"),
        F.min(F.when(raced, F.col("time_s"))).alias("least_time"),
    )
    before = Window.partitionBy("list_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    counts = ["persisted", "individuals", "timed", "ranked", "timed_ok", "unranked_ok", "minute_rows"]
    per_list = per_rank.withColumn("turned", F.col("least_time") < F.max("least_time").over(before)).groupBy("list_id").agg(*[F.sum(c).alias(c) for c in counts], F.bool_or("turned").alias("turned"))
    li = lists.join(per_list, "list_id", "left").na.fill(0, counts)
    li = li.withColumn("family", family_class("category", "category_full"))
    case = ["event_id", "category", "declared", "source_units"]
    for name in ("recovered", "confirmed", "count_anomaly"):
        li = _marked(li, known.get(name), case, f"is_{name}")
    li = _marked(li, known.get("missing_category"), ["event_id"], "is_missing_category")
    li = li.withColumn("stage_rows", F.sum("individuals").over(Window.partitionBy("stage_id", "category")))
    li = _marked(li, known.get("rank_anomaly"), ["event_id", "category"], "is_reviewed")
    course = _t("category").rlike(X.COURSE_CLASS)
    unranked = (F.col("ranking_basis") == "other") | _t("category_full").rlike(X.CANCELLED_CLASS)
    fewer, more = F.col("source_units") < F.col("declared"), F.col("source_units") > F.col("declared")
    anomaly = more & (F.col("unranked_ok") == 0) & F.col("is_count_anomaly")
    recovered = F.col("is_recovered") & (F.coalesce("stage_rows", F.lit(0)) >= F.col("declared"))
    code = (
        F.when(fewer & recovered, "source_omission_recovered")
        .when(fewer & F.col("is_confirmed"), "source_declared_omission_confirmed")
        .when(fewer, "source_declared_omission")
        .when(anomaly, "source_count_anomaly")
        .when(more, "entry_count_mismatch")
    )
    severity = F.when(code == "source_declared_omission", "warning").when(code == "entry_count_mismatch", "blocker").otherwise("info")
    rule = lambda cond, code, severity, auto=False: F.when(cond, F.struct(_lit(code).alias("code"), _lit(severity).alias("severity"), F.lit(auto).alias("auto_resolvable")))
    of_list = [
        rule(F.col("family") == "ambiguous", "ambiguous_family_category", "warning"),
        rule((F.col("persisted") > 0) & F.lower(_t("category")).isin("", "empty", "unknown"), F.when(F.col("is_missing_category"), "source_category_missing").otherwise("api_missing_category"), "warning"),
        rule(code.isNotNull(), code, severity),
        rule(~api & (F.col("timed") >= 3) & (F.col("ranked") == 0) & (F.col("family") == "ordinary") & ~unranked & ~course, "missing_ranking", "blocker"),
        rule(F.col("minute_rows") > 0, "minute_precision", "warning"),
        rule(~api & (F.col("timed_ok") >= 3) & (F.col("ranked") > 0) & (F.col("ranked") < F.col("timed_ok")) & ~course & ~unranked, "partial_ranking_coverage", "warning"),
        rule(
            F.col("turned") & ~api & (F.col("ranking_basis") == "time"),
            F.when(F.col("is_reviewed"), "source_rank_anomaly").otherwise("rank_time_inversion"),
            F.when(F.col("is_reviewed"), "info").otherwise("warning"),
        ),
    ]
    # and one more for what single rows are judged by
    r = results.join(lists.select("list_id", "event_id", "category", "source", "ranking_basis"), "list_id").withColumn("value", _t("observed_time"))
    r = _marked(r, known.get("unreadable"), ["event_id", "category", "name", "value"], "is_confirmed_value")
    r = _marked(r, known.get("missing_value"), ["event_id", "category", "name"], "is_missing_value")
    like_time = F.col("value").rlike(r"^\d{1,3}:\d{2}(?::\d{2})?$")
    unknown = F.col("status") == "unknown"
    plain_ok = (F.col("status") == "ok") & (F.coalesce("individual_status", F.lit("ok")) == "ok") & F.col("time_s").isNull() & (F.col("value") != "") & ~api & (F.col("ranking_basis") == "time")
    unreadable = is_unreadable("value")
    of_row = [
        rule(F.col("person_id").isNotNull() & ~F.col("identity_state").isin("resolved", "not_applicable") & F.col("championship").isNotNull(), "provisional_championship_identity", "warning"),
        rule((unknown | plain_ok) & unreadable, "source_value_unreadable", F.when(F.col("is_confirmed_value"), "info").otherwise("warning")),
        rule(unknown & ~unreadable & like_time, "time_text_unparsed", "blocker", True),
        rule(unknown & ~unreadable & ~like_time & F.col("is_missing_value"), "source_value_missing", "info"),
        rule(unknown & ~unreadable & ~like_time & ~F.col("is_missing_value"), "unknown_status", "blocker"),
        rule(plain_ok & ~unreadable & ~like_time & ~F.col("value").rlike(X.QUALITATIVE_OK), "result_value_unparsed", "blocker", True),
    ]
    by_list = li.select("list_id", F.lit(None).cast("long").alias("result_id"), F.explode(F.array_compact(F.array(*of_list))).alias("f"))
    by_row = r.select("list_id", F.col("result_id").cast("long").alias("result_id"), F.explode(F.array_compact(F.array(*of_row))).alias("f"))
    return with_issue_ids(by_list.unionByName(by_row).select("list_id", "result_id", "f.*"))


def with_issue_ids(df: DataFrame) -> DataFrame:
    """An id by content; equal findings are one."""
    return df.withColumn("issue_id", hash_id("issue", "list_id", "result_id", "code")).dropDuplicates(["issue_id"])


def stale_reviews(assertions: DataFrame, lists: DataFrame, issues: DataFrame) -> DataFrame:
    """Findings for reviews whose list has changed since, if they were flagged or the list has open issues."""
    open_ = issues.filter(F.col("severity").isin("blocker", "warning") & (F.col("code") != "provisional_championship_identity")).select("list_id").distinct().withColumn("_open", F.lit(True))
    a = assertions.join(lists.select("list_id", "fingerprint"), "list_id").filter(F.col("input_fingerprint") != F.col("fingerprint")).join(open_, "list_id", "left")
    return with_issue_ids(_finding(a.filter((F.col("state") == "flagged") | F.col("_open")), "stale_verification", "blocker"))


def accepted_reviews(assertions: DataFrame, lists: DataFrame) -> DataFrame:
    """Reviews of the list as it is; the last of a dimension wins."""
    a = assertions.join(lists.select("list_id", "fingerprint"), "list_id").filter(F.col("input_fingerprint") == F.col("fingerprint"))
    n = F.row_number().over(Window.partitionBy("list_id", "dimension").orderBy(F.col("reviewed_at").desc_nulls_last()))
    return a.withColumn("_n", n).filter("_n = 1").drop("_n", "fingerprint")


def confirmed(lists: DataFrame, reviews: DataFrame, required: list[str]) -> DataFrame:
    """list_id, confirmed: every required dimension confirmed or not applicable."""
    good = reviews.filter(F.col("state").isin("confirmed", "not_applicable") & F.col("dimension").isin(*required)).groupBy("list_id").agg(F.count_distinct("dimension").alias("_n"))
    return lists.select("list_id").join(good, "list_id", "left").select("list_id", (F.coalesce("_n", F.lit(0)) == len(required)).alias("confirmed"))


def decided(assertions: DataFrame, decisions: DataFrame, lists: DataFrame) -> DataFrame:
    """assertions after decisions; a decision on another fingerprint than the list's is refused (accepted false)."""
    d = decisions.join(lists.select("list_id", "fingerprint"), "list_id", "left").withColumn("accepted", F.coalesce(F.col("input_fingerprint") == F.col("fingerprint"), F.lit(False))).drop("fingerprint")
    keep = assertions.join(d.filter("accepted").select("list_id", "dimension"), ["list_id", "dimension"], "left_anti").withColumn("accepted", F.lit(True))
    return keep.unionByName(d.select(*keep.columns))


def _scored(issues: DataFrame, catalog: DataFrame) -> DataFrame:
    """list_id, score, issues, blockers: weights by severity (unknown: 1) and by owner of the rule (unknown: none)."""
    weight = lambda table, c, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c)), F.lit(other))
    scored = issues.join(F.broadcast(catalog.select("code", "owner", "domain")), "code", "left").withColumn("w", weight(X.SEVERITY_WEIGHT, "severity", 1) + weight(X.OWNER_WEIGHT, "owner", 0))
    return scored.groupBy("list_id").agg(F.sum("w").alias("score"), F.count("*").alias("issues"), F.count_if(F.col("severity") == "blocker").alias("blockers"))


def report_by_source(issues: DataFrame, lists: DataFrame, catalog: DataFrame, source: list[str]) -> DataFrame:
    """Sources with their lists that have issues: score, issues and lists."""
    return _scored(issues, catalog).join(lists, "list_id").groupBy(*source).agg(F.sum("score").alias("score"), F.sum("issues").alias("issues"), F.count("*").alias("lists"))


def report(issues: DataFrame, lists: DataFrame, catalog: DataFrame, campaign: str | None = None) -> DataFrame:
    """Lists with issues: score by severity and owner of the rule, most urgent first (place).

    campaign names a column of tiers that go before the score (null last); with it, date, event_id
    and category, where lists have them, break ties before the list's id does.
    """
    out = _scored(issues, catalog).join(lists, "list_id")
    if campaign:
        ties = [F.col(c).asc_nulls_first() for c in ("date", "event_id", "category") if c in lists.columns]
        return numbered(out, [F.col(campaign).asc_nulls_last(), F.col("score").desc(), *ties, F.col("list_id").asc()], "place")
    return numbered(out, [F.col("score").desc(), F.col("list_id").asc()], "place")


def summary(issues: DataFrame, catalog: DataFrame) -> DataFrame:
    return issues.join(F.broadcast(catalog.select("code", "domain")), "code", "left").groupBy("severity", "domain", "code").agg(F.count("*").alias("n"))


def auto_confirmable(lists: DataFrame, issues: DataFrame) -> DataFrame:
    """Lists without a blocker or warning need no one's eye."""
    bad = issues.filter(F.col("severity") != "info").select("list_id").distinct()
    return lists.join(bad, "list_id", "left_anti")


def invariants(t: dict[str, DataFrame]) -> DataFrame:
    """check, violations: what a build must never hold. t: result and
    result_list, and of award, entry, evidence with evidence_match, membership with person those present.
    """
    rules: list[tuple[str, DataFrame]] = []
    r = t["result"]
    rules += [
        ("missing_provenance", r.filter(F.col("source").isNull() | F.col("source_document_id").isNull())),
        ("missing_identity_basis", r.filter(F.col("person_id").isNotNull() & F.coalesce("identity_basis", F.lit("unknown")).isin("unknown", ""))),
        ("missing_list", r.join(t["result_list"].select("list_id"), "list_id", "left_anti")),
        ("status_domain", r.filter(~F.col("status").isin(*X.STATUSES))),
        ("negative_time", r.filter((F.col("time_s") < 0) | (F.col("time_behind_s") < 0) | (F.col("team_time_s") < 0))),
        ("eligibility_domain", r.filter(F.col("eligibility").isNotNull() & ~F.col("eligibility").isin("eligible", "ineligible", "provisional", "unknown"))),
        ("family_with_person", r.filter((F.col("result_kind") == "family") & F.col("person_id").isNotNull())),
        ("personless_individual", r.filter((F.col("result_kind") == "individual") & F.col("person_id").isNull())),
        ("ooc_championship", r.filter(F.col("out_of_competition") & F.col("championship").isNotNull())),
    ]
    if "award" in t:
        a = t["award"].join(r.select("result_id", "person_id", "eligibility", "result_kind", team_key("team_number", "team_name", "club").alias("_team")), "result_id", "left")
        rules += [
            ("duplicate_relay_award", a.filter("result_kind = 'relay'").groupBy("instance_id", "person_id", "_team").count().filter("count > 1")),
            ("duplicate_individual_award", a.filter("result_kind = 'individual'").groupBy("instance_id", "person_id").count().filter("count > 1")),
            ("award_without_eligibility", a.filter(~F.coalesce("eligibility", F.lit("")).isin("eligible", "provisional"))),
            ("award_without_result", a.filter(F.col("result_kind").isNull())),
        ]
    if "entry" in t:
        rules += [
            ("double_region", t["entry"].groupBy("result_id").agg(F.count_distinct("region").alias("n")).filter("n > 1")),
            ("entry_without_result", t["entry"].join(r.select("result_id"), "result_id", "left_anti")),
            ("family_in_region", t["entry"].join(r.filter("result_kind = 'family'").select("result_id"), "result_id", "left_semi")),
        ]
    if "evidence" in t:
        rules.append(("unmatched_inclusion", t["evidence"].filter("scope = 'inclusion'").join(t["evidence_match"].select("evidence_id"), "evidence_id", "left_anti")))
    exact = ["list_id", "person_id", "observed_name", "observed_club", "rank", "observed_status", "observed_time"]
    if set(exact) <= set(r.columns):
        rules.append(("duplicate_individual_result", r.filter("result_kind = 'individual'").groupBy(*exact).count().filter("count > 1")))
    if "membership" in t and "person" in t:
        rules.append(("membership_without_person", t["membership"].join(t["person"].select("person_id"), "person_id", "left_anti")))
    one = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in rules]
    return reduce(DataFrame.unionByName, one)


def demand(checks: DataFrame) -> None:
    """Raise if any invariant is broken."""
    bad = checks.filter("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))


def regression(current: dict[str, int], baseline: dict[str, int], max_drop: float = X.MAX_CORE_DROP, never_less: tuple[str, ...] = ("ledger",), never_more: tuple[str, ...] = ("conflicts",)) -> list[str]:
    """What a build has lost against the last one."""
    out = []
    for key, was in baseline.items():
        now = current.get(key, 0)
        if key in never_more:
            if now > was:
                out.append(f"{key} grew from {was} to {now}")
        elif key in never_less:
            if now < was:
                out.append(f"{key} shrank from {was} to {now}")
        elif now < was * (1 - max_drop):
            out.append(f"{key} fell from {was} to {now}")
    return out


def fingerprint(df: DataFrame, keys: list[str] | None = None, out: str = "fingerprint") -> DataFrame:
    """A digest of a table, or of each group, that doesn't depend on the order of rows.

    Rows are hashed one by one and the hashes summed as 128-bit numbers in two halves, so no group
    is ever sorted or gathered; equal rows count as often as they occur.
    """
    cols = sorted(c for c in df.columns if c not in (keys or []))
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)")
    grouped = df.groupBy(*(keys or []))
    sums = grouped.agg(F.sum(part(1)).alias("_a"), F.sum(part(16)).alias("_b"), F.sum(part(31)).alias("_c"), F.count("*").alias("_n"))
    return sums.select(*(keys or []), F.sha2(F.concat_ws("|", "_a", "_b", "_c", "_n"), 256).alias(out))


def list_fingerprint(rows: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """A digest of a list's rows in their order (a list is small; its rows meet in one group)."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(seq, text.alias("t")))), lambda x: x["t"])
    return rows.groupBy(key).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("fingerprint"))
