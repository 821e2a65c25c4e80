"""The read views over the benchmark tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .queries import query
from .tables import R, read, results


def _tables(spark, sf):
    r = results(spark, sf).withColumn("official_club", F.when(F.col("club") != "Club 0", F.col("club"))).withColumn("national_rank", F.col("rank")).withColumn("leg_number", F.lit(None).cast("int")).withColumn("observed_name", F.concat(F.lit("P"), F.col("person_id").cast("string")))
    event = r.select("event_id").distinct().select("event_id", F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("title"), F.expr("date_add(date'2020-01-01', cast(event_id % 900 as int))").cast("string").alias("date"), F.when(F.col("event_id") % 2 == 0, "skiOrienteering").otherwise("foot-o").alias("sport"))
    stage = r.select("stage_id", "event_id").distinct().select("stage_id", "event_id", F.lit(1).alias("number"), F.lit("Stage").alias("stage_title"), F.lit(None).cast("string").alias("date"))
    person = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
    return r, event, stage, person


_E = R + """, ev AS (SELECT DISTINCT event_id, DATE '2020-01-01' + CAST(event_id % 900 AS INT) AS day, event_id % 2 = 0 AS ski FROM r)
, es AS (SELECT *, year(day) + CASE WHEN ski AND month(day) >= 11 THEN 1 ELSE 0 END AS season FROM ev)
, n AS (SELECT stage_id, event_id, count(*) AS n_results, bool_or(championship IS NOT NULL) AS has_championship FROM r GROUP BY ALL)"""


@query(_E + "SELECT event_id, stage_id, season, n_results, has_championship FROM n JOIN es USING (event_id)", whole="season")
def r1_events(spark, sf):
    r, event, stage, _ = _tables(spark, sf)
    return V.events(event, stage, r).select("event_id", "stage_id", "season", "n_results", "has_championship")


_REP = """, p AS (SELECT *, coalesce('n:' || team_number, 't:' || team_name) AS team FROM r)
, pr AS (SELECT * FROM p WHERE result_kind <> 'relay' OR team IS NULL UNION ALL SELECT * FROM p WHERE result_kind = 'relay' AND team IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person_id, list_id, team ORDER BY result_id) = 1)"""


@query(R + _REP + "SELECT person_id, count(*) AS n FROM pr GROUP BY ALL")
def r3_person_results(spark, sf):
    r, _, _, _ = _tables(spark, sf)
    return V.person_results(r).groupBy("person_id").agg(F.count("*").alias("n"))


@query(R + _REP + """SELECT count(*) FILTER (status <> 'dns') AS starts, count(*) FILTER (status = 'ok') AS finishes, count(*) FILTER (status = 'ok' AND rank = 1) AS wins, count(*) FILTER (status = 'ok' AND rank BETWEEN 1 AND 3) AS podiums FROM pr WHERE person_id = 7""")
def r4_runner_statistics(spark, sf):
    r, event, stage, _ = _tables(spark, sf)
    return V.runner_statistics(V.runner_rows(r, stage, event, 7))


_POD = R + """, p AS (SELECT *, coalesce('n:' || team_number, 't:' || team_name) AS team FROM r WHERE status = 'ok' AND rank BETWEEN 1 AND 3)
, po AS (SELECT * FROM p WHERE result_kind NOT IN ('relay', 'team') OR team IS NULL UNION ALL SELECT * FROM p WHERE result_kind IN ('relay', 'team') AND team IS NOT NULL QUALIFY row_number() OVER (PARTITION BY list_id, team ORDER BY result_id) = 1)"""


@query(_POD + "SELECT result_id, rank FROM po")
def s5_podiums(spark, sf):
    r, event, stage, _ = _tables(spark, sf)
    return V.podiums(r, stage, event).select("result_id", "rank")


_M = "count(*) FILTER (rank = 1) AS gold, count(*) FILTER (rank = 2) AS silver, count(*) FILTER (rank = 3) AS bronze"


@query(_POD + f", m AS (SELECT person_id, {_M} FROM po GROUP BY ALL) SELECT *, rank() OVER (ORDER BY gold DESC, silver DESC, bronze DESC) AS place FROM m", whole="place")
def r5_runner_medals(spark, sf):
    r, event, stage, person = _tables(spark, sf)
    return V.runner_medals(V.podiums(r, stage, event), person).select("person_id", "gold", "silver", "bronze", "place")


@query(_POD + f", m AS (SELECT club AS official_club, {_M} FROM po WHERE club <> 'Club 0' GROUP BY ALL) SELECT *, rank() OVER (ORDER BY gold DESC, silver DESC, bronze DESC) AS place FROM m", whole="place")
def r7_clubs_ranking(spark, sf):
    r, event, stage, _ = _tables(spark, sf)
    return V.club_medals(V.podiums(r, stage, event)).select("official_club", "gold", "silver", "bronze", "place")


@query(R + _REP + ", c AS (SELECT person_id, count(*) AS starts FROM pr WHERE club = 'Club 5' GROUP BY ALL) SELECT person_id, s_name AS name, starts FROM c JOIN supplier ON s_suppkey = person_id")
def r6_club_roster(spark, sf):
    r, _, _, person = _tables(spark, sf)
    return V.club_roster(r, person, "Club 5")


@query(R + "SELECT event_id, count(*) AS n FROM r WHERE source = 'api' AND status = 'mp' AND club = 'Club 5' AND DATE '2020-01-01' + CAST(event_id % 900 AS INT) >= DATE '2021-01-01' GROUP BY ALL")
def r8_non_starters(spark, sf):
    r, event, _, _ = _tables(spark, sf)
    return V.non_starters(r.withColumn("status", F.when(F.col("status") == "mp", "dns").otherwise(F.col("status"))), event, "Club 5", "2021-01-01").select("event_id", "n")


_DISPLAY = "CASE WHEN result_kind = 'pair' THEN coalesce(rank::VARCHAR, '') || ':' || status || ':' || time_s::VARCHAR || ':' || club WHEN result_kind IN ('relay', 'team') THEN coalesce('n:' || team_number, 't:' || team_name, 'c:' || club) ELSE 'r:' || result_id::VARCHAR END"


@query(R + f"SELECT club AS official_club, count(DISTINCT list_id::VARCHAR || '#' || {_DISPLAY}) AS n FROM r WHERE club <> 'Club 0' AND club LIKE '%1%' GROUP BY ALL ORDER BY n DESC, official_club LIMIT 12")
def r9_club_search(spark, sf):
    r, _, _, _ = _tables(spark, sf)
    return V.club_search(r, "1")


@query(R + _REP + "SELECT person_id, s_name AS name, count(*) AS n FROM pr JOIN supplier ON s_suppkey = person_id WHERE person_id > 0 AND lower(s_name) LIKE '%1%' GROUP BY ALL ORDER BY n DESC, name, person_id LIMIT 10")
def r10_runner_search(spark, sf):
    r, _, _, person = _tables(spark, sf)
    return V.runner_search(r, person, "1")


@query(R + f"SELECT category, count(DISTINCT {_DISPLAY}) AS entries, count(*) AS n_rows, count(*) FILTER (status = 'ok') AS classified FROM r WHERE stage_id = 3 GROUP BY ALL")
def r2_event_categories(spark, sf):
    r, _, _, _ = _tables(spark, sf)
    return V.event_categories(r, 3)


@query("SELECT p_partkey AS asked, CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 2 ELSE p_partkey END AS person_id FROM part WHERE p_partkey = 40")
def r14_redirected(spark, sf):
    p = read(spark, sf, "part")
    redirect = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("old_id"), F.expr("p_partkey div 2").alias("new_id"))
    return V.runner_by_id(p.select(F.col("p_partkey").alias("person_id")), redirect, 40).select("asked", "person_id")


@query(R + """, i AS (SELECT list_id, count(*) AS issues, count(*) FILTER (rank IS NULL) AS blockers FROM r WHERE status = 'mp' GROUP BY ALL), a AS (SELECT list_id, count(*) AS reviews FROM r WHERE status = 'dnf' GROUP BY ALL), c AS (SELECT list_id, count(championship) AS championship_rows FROM r GROUP BY ALL)
SELECT o_orderkey AS list_id, coalesce(issues, 0) AS issues, coalesce(blockers, 0) AS blockers, coalesce(reviews, 0) AS reviews, coalesce(championship_rows, 0) AS championship_rows FROM orders LEFT JOIN i ON i.list_id = o_orderkey LEFT JOIN a ON a.list_id = o_orderkey LEFT JOIN c ON c.list_id = o_orderkey""")
def v5_review_base(spark, sf):
    r, _, _, _ = _tables(spark, sf)
    lists = read(spark, sf, "orders").select(F.col("o_orderkey").alias("list_id"))
    issues = r.filter("status = 'mp'").withColumn("severity", F.when(F.col("rank").isNull(), "blocker").otherwise("info"))
    return V.review_base(lists, issues, r.filter("status = 'dnf'"), r)
