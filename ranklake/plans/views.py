"""The read API: what a reader asks of a built result base. Each view is a function of its tables and parameters.

Tables: event(event_id, title, date, sport), stage(stage_id, event_id, number, stage_title, date),
result (result_id, list_id, stage_id, event_id, person_id, category, club, official_club, rank,
national_rank, status, time_s, result_kind, team_number, team_name, leg_number, championship, source,
observed_name), person(person_id, name), redirect(old_id, new_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import season_year
from ..functions.text import category_order, gender_base, is_course_list
from ..operators import aggregates as A
from ..operators import ranking as W
from ..operators import regional
from ..operators.lineage import cut
from ..operators.filters import of_discipline
from ..operators.units import display_unit


def _of_season(df: DataFrame, year: int | None) -> DataFrame:
    out = df.withColumn("season", season_year("date", "sport"))
    return out.filter(F.col("season") == year) if year is not None else out


#: Addresses of views and what their parts are, in order; the first that begins an address reads it. Fixed values.
ROUTES = (
    ("runner", r"^#/runner/(-?\d+)(?:/(\d{4}))?", ("id", "year")),
    ("event", r"^#/event/(\d+)(?:/stage/(\d+))?(?:(?:/(om))|(?:/lm/(WIEN|NOE|BGLD|STMK|OOE|SBG|TIR|KTN|VBG)))?", ("id", "stage", "scope", "region")),
    ("club_non_starters", r"^#/club/([^/]+)/dns(?:/(\d{4}|alle))?(?:/(event|runner))?", ("id", "year", "scope")),
    ("club", r"^#/club/([^/]+)(?:/(\d{4}))?/lm/(WIEN|NOE|BGLD|STMK|OOE|SBG|TIR|KTN|VBG)/?$", ("id", "year", "region")),
    ("club", r"^#/club/([^/]+)(?:/(\d{4}))?(?:/(om))?(?:/(members))?", ("id", "year", "scope", "scope")),
    ("clubs", r"^#/clubs(?:/(\d{4}))?/lm/(WIEN|NOE|BGLD|STMK|OOE|SBG|TIR|KTN|VBG)/?$", ("year", "region")),
    ("clubs", r"^#/clubs(?:/(\d{4}))?(?:/(om))?(?:/(members))?", ("year", "scope", "scope")),
    ("runners", r"^#/runners(?:/(\d{4}))?/lm/(WIEN|NOE|BGLD|STMK|OOE|SBG|TIR|KTN|VBG)/medals/?$", ("year", "region")),
    ("runners", r"^#/runners(?:/(\d{4}))?(?:/(om))?(?:/(medals))?", ("year", "scope", "scope")),
    ("events", r"^#/events(?:/(\d{4}))?/lm/(WIEN|NOE|BGLD|STMK|OOE|SBG|TIR|KTN|VBG)(?:/(top3))?/?$", ("year", "region", "scope")),
    ("events", r"^#/events(?:/(\d{4}))?(?:/(om))?(?:/(top3))?", ("year", "scope", "scope")),
)


def route(address: Column) -> dict[str, Column]:
    """view, id, stage, year, scope, region that an address asks for; what no route begins is the list of events.

    scope is the last word of the address that narrows the view (members, medals, top3, om, a grouping).
    """
    out = {"view": F.lit("events"), **{k: F.lit(None).cast("int" if k in ("year", "stage") else "string") for k in ("id", "stage", "year", "scope", "region")}}
    for view, pattern, parts in reversed(ROUTES):
        hit = address.rlike(pattern)
        found: dict[str, Column] = {}
        for i, part in enumerate(parts, 1):
            value = F.nullif(F.regexp_extract(address, pattern, i), F.lit(""))
            value = value.try_cast("int") if part in ("year", "stage") else F.url_decode(value) if part == "id" else value
            found[part] = F.coalesce(value, found[part]) if part in found else value
        out = {k: F.when(hit, F.lit(view) if k == "view" else found.get(k, F.lit(None))).otherwise(v) for k, v in out.items()}
    return out


def person_results(result: DataFrame) -> DataFrame:
    """Results of people, a relay once for each team."""
    team = F.coalesce(F.concat(F.lit("n:"), "team_number"), F.concat(F.lit("t:"), "team_name"))
    r = result.filter(F.col("person_id").isNotNull()).withColumn("_team", team)
    return W.representative(r, ["person_id", "list_id", "_team"], "result_id", F.col("result_kind") == "relay").drop("_team")


def events(event: DataFrame, stage: DataFrame, result: DataFrame, year: int | None = None, championships: bool = False, excluded_sports: list[str] | None = None) -> DataFrame:
    """One row a stage, newest first, with whether it has championships and how many entries."""
    e = of_discipline(event, "sport", excluded_sports) if excluded_sports else event
    s = _of_season(stage.drop("date").join(e, "event_id").join(stage.select("stage_id", F.col("date").alias("stage_date")), "stage_id").withColumn("date", F.coalesce("stage_date", "date")), year)
    n = result.groupBy("stage_id").agg(F.count("*").alias("n_results"), F.bool_or(F.col("championship").isNotNull()).alias("has_championship"))
    out = s.join(n, "stage_id", "left")
    if championships:
        out = out.filter("has_championship")
    return out.select("event_id", "stage_id", "title", "stage_title", "date", "season", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("has_championship", F.lit(False)).alias("has_championship")).orderBy(F.col("date").desc(), "event_id", "stage_id")


def event_categories(result: DataFrame, stage_id: int) -> DataFrame:
    """The classes of a stage in reading order, with entries and starters."""
    r = result.filter(F.col("stage_id") == stage_id)
    unit = display_unit("result_id", "result_kind", "rank", "status", "time_s", "team_number", "team_name", "club")
    return r.groupBy("category").agg(F.count_distinct(unit).alias("entries"), F.count("*").alias("n_rows"), F.count_if(F.col("status") == "ok").alias("classified")).orderBy(*category_order("category"))


def event_results(result: DataFrame, stage_id: int, medals_only: bool = False) -> DataFrame:
    """Results of a stage: class by class, ranked first, teams together."""
    r = result.filter(F.col("stage_id") == stage_id)
    if medals_only:
        r = r.filter(F.coalesce("national_rank", "rank").between(1, 3))
    return r.orderBy(*category_order("category"), F.col("rank").isNull(), "rank", F.col("team_number").asc_nulls_first(), F.col("leg_number").asc_nulls_first(), "time_s", "result_id")


def runner_rows(result: DataFrame, stage: DataFrame, event: DataFrame, person_id: int) -> DataFrame:
    """A person's results with the statistics of their classes; course lists don't count where the stage has classes."""
    own = person_results(result.filter(F.col("person_id") == person_id))
    stats = A.category_stats(result.join(own.select("stage_id", "category").distinct(), ["stage_id", "category"], "left_semi"), ["stage_id", "category"])
    plain = result.filter(~is_course_list("category")).select("stage_id").distinct().withColumn("_has", F.lit(True))
    own = own.join(plain, "stage_id", "left").withColumn("counts", ~(is_course_list("category") & F.coalesce("_has", F.lit(False)))).drop("_has")
    s = stage.select("stage_id", F.col("date").alias("stage_date"))
    return own.join(stats, ["stage_id", "category"], "left").join(s, "stage_id", "left").join(event.select("event_id", "title", "date", "sport"), "event_id", "left").withColumn("date", F.coalesce("stage_date", "date")).drop("stage_date").orderBy(F.col("date").desc(), "result_id")


def runner_statistics(rows: DataFrame) -> DataFrame:
    """starts, finishes, wins, podiums of a person's rows."""
    ok = F.col("counts") & (F.col("status") == "ok")
    return rows.agg(F.count_if(F.col("counts") & (F.col("status") != "dns")).alias("starts"), F.count_if(ok).alias("finishes"), F.count_if(ok & (F.col("rank") == 1)).alias("wins"), F.count_if(ok & F.col("rank").between(1, 3)).alias("podiums"))


def podiums(result: DataFrame, stage: DataFrame, event: DataFrame, club: str | None = None, person_id: int | None = None, year: int | None = None) -> DataFrame:
    """Places 1 to 3, overall or national, a relay once a team; course lists are left out where the stage has classes."""
    has = Window.partitionBy("stage_id")
    r = result.withColumn("_course", is_course_list("category")).withColumn("_plain", F.count_if(~is_course_list("category")).over(has)).filter("NOT _course OR _plain = 0")
    r = r.filter((F.col("status") == "ok") & (F.col("rank").between(1, 3) | F.col("national_rank").between(1, 3)))
    if club is not None:
        r = r.filter(F.col("official_club") == club)
    if person_id is not None:
        r = r.filter(F.col("person_id") == person_id)
    team = F.coalesce(F.concat(F.lit("n:"), "team_number"), F.concat(F.lit("t:"), "team_name"))
    r = W.representative(r.withColumn("_team", team), ["list_id", "_team"], "result_id", F.col("result_kind").isin("relay", "team"))
    s = stage.select("stage_id", F.col("date").alias("stage_date"), "stage_title")
    out = r.join(s, "stage_id").join(event.select("event_id", "title", "date", "sport"), "event_id").withColumn("date", F.coalesce("stage_date", "date"))
    return _of_season(out, year).drop("_course", "_plain", "_team", "stage_date")


def runner_medals(podium: DataFrame, person: DataFrame, cap: int | None = None, place: str = "national_rank") -> DataFrame:
    """Medals by person; names only break ties in the display, never places. The cap comes after the tally."""
    elite = F.col("championship") == "ÖSTM"
    won = cut(podium.filter(F.col("person_id").isNotNull()).select("person_id", place, "championship"), "podium")  # counted, and its counts placed
    t = A.medal_table(won, ["person_id"], place, F.coalesce(elite, F.lit(False)))
    out = t.join(person.select("person_id", "name"), "person_id", "left").orderBy("place", "name", "person_id")
    return out.limit(cap) if cap else out


def club_medals(podium: DataFrame, cap: int | None = None, place: str = "national_rank") -> DataFrame:
    elite = F.coalesce(F.col("championship") == "ÖSTM", F.lit(False))
    won = cut(podium.filter(F.col("official_club").isNotNull()).select("official_club", place, "championship"), "podium")
    out = A.medal_table(won, ["official_club"], place, elite).orderBy("place", "official_club")
    return out.limit(cap) if cap else out


def regional_podiums(entered: DataFrame, result: DataFrame, stage: DataFrame, event: DataFrame, region: str | None = None, club: str | None = None, person_id: int | None = None, year: int | None = None) -> DataFrame:
    """Places 1 to 3 of confirmed regional championships with their event and day, a row a member."""
    won = regional.podiums(entered, result, region, club, person_id).withColumn("championship", F.col("region"))
    s = stage.select("stage_id", "event_id", F.col("date").alias("stage_date"), "stage_title")
    out = won.join(s, "stage_id").join(event.select("event_id", "title", "date", "sport"), "event_id").withColumn("date", F.coalesce("stage_date", "date"))
    return _of_season(out, year).drop("stage_date")


def regional_club_medals(podium: DataFrame, cap: int | None = None) -> DataFrame:
    """Medals of regional championships by club: an entry counts once for each club that is in it."""
    return club_medals(podium.select("entry_id", "official_club", "rank", F.lit(None).cast("string").alias("championship")).distinct(), cap, "rank")


def regional_runner_medals(podium: DataFrame, person: DataFrame, cap: int | None = None) -> DataFrame:
    return runner_medals(podium.select("entry_id", "person_id", "rank", F.lit(None).cast("string").alias("championship")).distinct(), person, cap, "rank")


def regional_stages(entered: DataFrame) -> DataFrame:
    """region, stage_id, entries, eligible, champions of every stage that has a regional championship."""
    ok = F.col("eligibility_state") == "eligible"
    return entered.groupBy("region", "stage_id").agg(F.count("*").alias("entries"), F.count_if(ok).alias("eligible"), F.count_if(ok & (F.col("regional_rank") == 1)).alias("champions"))


def regional_event(entered: DataFrame, result: DataFrame, stage_id: int, region: str) -> DataFrame:
    """A stage's results as a regional championship: by class, placed ones first, who may not be placed last; a row a member."""
    own = entered.filter((F.col("stage_id") == stage_id) & (F.col("region") == region)).select("entry_id", "instance_id", "regional_rank", "eligibility_state", F.explode("result_ids").alias("result_id"))
    rows = own.join(result.drop("stage_id"), "result_id")
    return rows.orderBy(*category_order("category"), F.col("regional_rank").isNull(), "regional_rank", "rank", "entry_id", F.col("leg_number").asc_nulls_first(), "result_id")


def medal_chronicle(podium: DataFrame) -> DataFrame:
    return podium.orderBy(F.col("date").desc(), "stage_id", *category_order("category"), F.coalesce("national_rank", "rank"))


def champions(podium: DataFrame) -> DataFrame:
    """Winners by class without its gender: women and men side by side, elite first, then by age."""
    g = gender_base("category")
    p = podium.filter(F.coalesce("national_rank", "rank") == 1).withColumn("base", g["base"]).withColumn("gender", F.coalesce(g["gender"], F.lit("open")))
    each = p.groupBy("base").pivot("gender", ["women", "men", "open"]).agg(F.array_join(F.array_sort(F.collect_set("observed_name")), ", "))
    return each.orderBy(~F.col("base").rlike("(?i)elite|\\d-?e$"), F.coalesce(F.nullif(F.regexp_extract("base", r"(\d+)", 1), F.lit("")).cast("int"), F.lit(999)), "base")


def club_roster(result: DataFrame, person: DataFrame, club: str) -> DataFrame:
    own = person_results(result.filter(F.col("official_club") == club))
    return A.roster(person.join(own.select("person_id").distinct(), "person_id", "left_semi"), own, "person_id").orderBy(F.desc("starts"), "name")


def non_starters(result: DataFrame, event: DataFrame, club: str, since: str, by: str = "event") -> DataFrame:
    """A club's non-starters in API lists since a day, by event or by person."""
    r = result.filter((F.col("source") == "api") & (F.col("status") == "dns") & (F.col("official_club") == club)).join(event.select("event_id", "title", "date"), "event_id").filter(F.col("date") >= since)
    keys = ["event_id", "title", "date"] if by == "event" else ["person_id", "observed_name"]
    return r.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def _contains(column: str, needle: str) -> Column:
    return F.lower(column).contains(needle.lower())


def club_search(result: DataFrame, needle: str, most: int = 12) -> DataFrame:
    """Official clubs by part of a name, with distinct performances, most first."""
    unit = display_unit("result_id", "result_kind", "rank", "status", "time_s", "team_number", "team_name", "club")
    return result.filter(_contains("official_club", needle)).groupBy("official_club").agg(F.count_distinct("list_id", unit).alias("n")).orderBy(F.desc("n"), "official_club").limit(most)


def runner_search(result: DataFrame, person: DataFrame, needle: str, most: int = 10) -> DataFrame:
    """People of the registry (positive ids) by part of a name, with results, most first."""
    p = person.filter((F.col("person_id") > 0) & _contains("name", needle))
    n = person_results(result.join(F.broadcast(p.select("person_id")), "person_id", "left_semi")).groupBy("person_id").agg(F.count("*").alias("n"))
    return p.join(n, "person_id").select("person_id", "name", "n").orderBy(F.desc("n"), "name", "person_id").limit(most)


def runner_by_id(person: DataFrame, redirect: DataFrame, person_id: int) -> DataFrame:
    """The person of an id, or of the id it was merged into."""
    ask = person.sparkSession.createDataFrame([(person_id,)], "asked long")
    now = ask.join(redirect, F.col("asked") == F.col("old_id"), "left").select("asked", F.coalesce("new_id", "asked").alias("person_id"))
    return now.join(person, "person_id")


def review_detail(result: DataFrame, issues: DataFrame, assertions: DataFrame, list_id) -> DataFrame:
    """A list's rows with its codes and decided dimensions."""
    codes = A.joined_distinct(issues.filter(F.col("list_id") == list_id), ["list_id"], "code", "codes")
    done = A.joined_distinct(assertions.filter(F.col("list_id") == list_id), ["list_id"], "dimension", "reviewed")
    return result.filter(F.col("list_id") == list_id).join(codes, "list_id", "left").join(done, "list_id", "left").orderBy("result_id")


def review_base(lists: DataFrame, issues: DataFrame, assertions: DataFrame, result: DataFrame) -> DataFrame:
    """The review queue's base: lists with counts of issues, reviews and championship rows, none as zero."""
    i = issues.groupBy("list_id").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "blocker").alias("blockers"))
    a = assertions.groupBy("list_id").agg(F.count("*").alias("reviews"))
    c = result.groupBy("list_id").agg(F.count_if(F.col("championship").isNotNull()).alias("championship_rows"))
    out = lists.join(i, "list_id", "left").join(a, "list_id", "left").join(c, "list_id", "left")
    return out.na.fill(0, ["issues", "blockers", "reviews", "championship_rows"])
