"""Further operators over the benchmark tables: stages, coverage, evidence, identities, units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import championship as C
from ..operators import identity as E
from ..operators import stages as ST
from ..operators import units as U
from .queries import QUERIES, SQL, query
from .tables import R, read, results


def _stage_tables(spark, sf):
    o = read(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey")
    docs = o.select(F.col("o_custkey").alias("event_id"), k.alias("document_id"), F.when(k % 5 == 0, (k % 3 + 1).cast("int")).alias("number"), F.when(k % 5 == 1, F.concat((k % 3 + 1).cast("string"), F.lit(". Lauf"))).when(k % 5 == 2, "Sprint erg").otherwise("erg").alias("text"), day.alias("day"), F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd").alias("name_day"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("event_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("number"))
    st = c.select("event_id", (F.col("event_id") * 10 + F.col("number")).alias("stage_id"), "number", F.when(F.col("number") == 2, "Sprint").otherwise("Mittel").alias("title"), F.date_format(F.date_add(F.lit("1996-01-01").cast("date"), (F.col("event_id") % 900 + F.col("number")).cast("int")), "yyyy-MM-dd").alias("day"))
    return docs, st


_ST = """WITH d AS (SELECT o_custkey AS event_id, o_orderkey AS document_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 + 1 END AS number, CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey % 3 + 1 END AS rnd, o_orderkey % 5 = 2 AS sprint, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS name_day FROM orders)
, s AS (SELECT c_custkey AS event_id, c_custkey * 10 + n AS stage_id, n AS number, strftime(DATE '1996-01-01' + CAST(c_custkey % 900 + n AS INT), '%Y-%m-%d') AS day FROM customer, (VALUES (1), (2), (3)) t(n))"""


@query(_ST + """, m AS (SELECT d.*, coalesce(a.stage_id, b.stage_id, CASE WHEN sprint THEN c.stage_id END, e.stage_id) AS f FROM d LEFT JOIN s a ON a.event_id = d.event_id AND a.number = d.number LEFT JOIN s b ON b.event_id = d.event_id AND b.number = d.rnd LEFT JOIN s c ON c.event_id = d.event_id AND c.number = 2 LEFT JOIN s e ON e.event_id = d.event_id AND e.day = d.day)
, k AS (SELECT event_id, count(DISTINCT f) AS n FROM m GROUP BY ALL)
SELECT document_id, CASE WHEN n >= 2 THEN f END AS stage_id FROM m JOIN k USING (event_id)""")
def j15_stage_mapping(spark, sf):
    docs, st = _stage_tables(spark, sf)
    return ST.mapped_stages(docs, st).select("document_id", "stage_id")


@query(_ST + """SELECT document_id, coalesce(a.day, b.day, d.day) AS day FROM d LEFT JOIN s a ON a.event_id = d.event_id AND a.number = d.rnd LEFT JOIN s b ON b.event_id = d.event_id AND b.day = d.name_day""")
def j16_corrected_days(spark, sf):
    docs, st = _stage_tables(spark, sf)
    return ST.corrected_days(docs, st).select("document_id", "day")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o, bool_or(o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY ALL)
, x AS (SELECT c.k, CASE WHEN o.k IS NULL THEN 'not_snapshot' WHEN NOT f THEN 'not_cached' WHEN NOT o THEN 'not_parsed' WHEN NOT u THEN 'not_published' ELSE 'published' END AS state FROM c LEFT JOIN o USING (k))
SELECT k AS event_id, state, CASE WHEN state <> 'published' THEN CASE WHEN k % 11 = 0 THEN 'shadowed' WHEN k % 7 = 0 THEN 'excluded' WHEN k % 5 = 0 THEN 'clone' WHEN k % 3 = 0 THEN 'duplicate' ELSE 'unexplained' END END AS reason FROM x""")
def q5_coverage_audit(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("event_id"))
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "event_id")
    mod = lambda n: c.filter(F.col("event_id") % n == 0)
    return ST.coverage_audit(c, o, o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), o.filter("o_orderpriority = '1-URGENT'"), mod(11), mod(7), mod(5), mod(3))


@query("""WITH s AS (SELECT o_custkey AS event_id, o_orderkey AS k, o_orderkey % 4 <> 3 AS cached, o_orderkey % 5 = 1 AS skipped, o_orderkey % 5 = 2 AS ambiguous, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 3 ELSE 0 END AS n, o_orderkey % 7 = 0 AS pub, o_orderpriority || (o_orderkey % 11)::VARCHAR AS digest FROM orders)
, ev AS (SELECT c_custkey AS event_id, c_custkey % 9 = 0 AS clone FROM customer WHERE c_custkey % 2 = 0), d AS (SELECT DISTINCT digest FROM s WHERE pub)
, x AS (SELECT s.*, s.event_id % 10 = 1 AS res, s.event_id % 8 = 3 AS exc, coalesce(clone, false) AS clone, d.digest IS NOT NULL AS cp FROM s LEFT JOIN ev USING (event_id) LEFT JOIN d USING (digest))
, y AS (SELECT *, CASE WHEN n > 0 THEN CASE WHEN pub THEN 'p' WHEN res THEN 'shadowed' WHEN exc THEN 'excluded' WHEN clone THEN 'clone' WHEN cp THEN 'copy' ELSE 'unexplained' END WHEN cached AND skipped THEN 'skipped' WHEN cached AND ambiguous THEN 'amb' WHEN cached THEN 'gap' ELSE 'no' END AS st FROM x)
, g AS (SELECT event_id FROM y GROUP BY event_id HAVING bool_or(st = 'gap') AND sum(n) = 0 AND bool_and(NOT res AND NOT exc AND NOT clone))
SELECT 'calendar_events' AS counter, (SELECT count(*) FROM ev) AS n UNION ALL SELECT 'external_events_not_in_snapshot', (SELECT count(*) FROM customer WHERE c_custkey % 2 <> 0)
UNION ALL SELECT 'snapshot_events_not_in_database', (SELECT count(*) FROM ev WHERE event_id % 10 <> 1) UNION ALL SELECT 'excluded_events_without_usable_results', (SELECT count(*) FROM customer WHERE c_custkey % 8 = 3)
UNION ALL SELECT 'events_with_result_source_but_no_results', (SELECT count(*) FROM g) UNION ALL SELECT 'cached_sources_without_parsed_rows', count(*) FILTER (st = 'gap') FROM y UNION ALL SELECT 'ambiguous_cached_sources_without_parsed_rows', count(*) FILTER (st = 'amb') FROM y
UNION ALL SELECT 'expected_skipped_sources', count(*) FILTER (st = 'skipped') FROM y UNION ALL SELECT 'parsed_sources_not_published', count(*) FILTER (st IN ('shadowed', 'excluded', 'clone', 'copy', 'unexplained')) FROM y
UNION ALL SELECT 'parsed_sources_shadowed_by_better_source', count(*) FILTER (st = 'shadowed') FROM y UNION ALL SELECT 'duplicate_sources_published_elsewhere', count(*) FILTER (st = 'copy') FROM y UNION ALL SELECT 'excluded_bewertung_clones', count(*) FILTER (st = 'clone') FROM y
UNION ALL SELECT 'parsed_sources_excluded_with_event', count(*) FILTER (st = 'excluded') FROM y UNION ALL SELECT 'unexplained_unpublished_sources', count(*) FILTER (st = 'unexplained') FROM y""")
def q5_coverage_counters(spark, sf):
    k, e = F.col("o_orderkey"), F.col("o_custkey")
    sources = read(spark, sf, "orders").select(
        e.alias("event_id"), k.alias("source_id"), (k % 4 != 3).alias("cached"), (k % 5 == 1).alias("skipped"), (k % 5 == 2).alias("ambiguous"), F.when(F.col("o_orderstatus") != "P", k % 3).alias("parsed_rows"), (k % 7 == 0).alias("is_published"), F.concat("o_orderpriority", (k % 11).cast("string")).alias("digest")
    )
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("event_id"))
    events = c.filter("event_id % 2 = 0").withColumn("title", F.when(F.col("event_id") % 9 == 0, "Cup Bewertung").otherwise("Cup"))
    return ST.coverage_counters(events, c, sources.filter("event_id % 10 = 1"), c.filter("event_id % 8 = 3"), sources)


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END::BIGINT AS place FROM orders")
def s9_fixed_order(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", ST.fixed_order("o_orderpriority", ["5-LOW", "1-URGENT"]).cast("long").alias("place"))


@query(R + ", n AS (SELECT DISTINCT person_id, event_id FROM r WHERE club = 'Club 4') SELECT result_id, CASE WHEN n.person_id IS NULL OR source = 'api' THEN championship END AS championship FROM r LEFT JOIN n USING (person_id, event_id)")
def c7_override_strip(spark, sf):
    r = results(spark, sf).withColumn("eligibility_basis", F.when(F.col("source") == "api", "official_championship_ranking"))
    ledger = r.filter("club = 'Club 4'").select("person_id", "event_id").distinct().withColumn("decision", F.lit("null"))
    return C.overrides_stripped(r, ledger).select("result_id", "championship")


@query(R + """, t AS (SELECT DISTINCT stage_id, category FROM r WHERE championship IS NOT NULL)
SELECT result_id, CASE WHEN championship IS NOT NULL THEN championship WHEN t.stage_id IS NULL AND status = 'ok' AND event_id % 3 = 0 AND category IN ('Herren ab 35', 'H-14') THEN 'ÖM' WHEN t.stage_id IS NULL AND status = 'ok' AND event_id % 3 = 1 AND category IN ('Damen 21 Elite', 'Herren 21 Elite') THEN 'ÖSTM' WHEN t.stage_id IS NULL AND status = 'ok' AND event_id % 3 = 1 AND category = 'D21 Kurz' AND result_kind <> 'individual' THEN NULL END AS championship FROM r LEFT JOIN t USING (stage_id, category)""")
def c2_title_fallback(spark, sf):
    r = results(spark, sf)
    st = r.select("stage_id", "event_id").distinct().withColumn("stage_title", F.lit(None).cast("string"))
    e = r.select("event_id").distinct().select("event_id", F.when(F.col("event_id") % 3 == 0, "ÖM Sprint").when(F.col("event_id") % 3 == 1, "ÖSTM Lang").otherwise("Austria Cup").alias("title"), F.lit("x").alias("slug"))
    return C.title_fallback(r, st, e).select("result_id", "championship")


@query(R + """, e AS (SELECT p_partkey AS evidence_id, p_partkey % 2000 AS stage_id, p_partkey % 7 AS rank, 'Club ' || (p_partkey % 20)::VARCHAR AS club, CASE WHEN p_partkey % 2 = 0 THEN 'inclusion' ELSE 'field' END AS scope, p_partkey % 50 AS person FROM part)
, c AS (SELECT e.evidence_id, r.result_id, r.club = e.club AS fits, 0 AS tier, e.scope FROM e JOIN r ON r.stage_id = e.stage_id AND r.person_id = e.person UNION ALL SELECT e.evidence_id, r.result_id, r.club = e.club, 1, e.scope FROM e JOIN r ON r.stage_id = e.stage_id AND r.rank = e.rank WHERE e.scope = 'inclusion')
, b AS (SELECT * FROM c QUALIFY tier = min(tier) OVER (PARTITION BY evidence_id)), f AS (SELECT * FROM b QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY evidence_id))
SELECT evidence_id, result_id FROM f QUALIFY scope = 'inclusion' OR row_number() OVER (PARTITION BY evidence_id ORDER BY result_id) = 1""")
def j4_source_evidence(spark, sf):
    r = results(spark, sf).drop("seq").withColumn("seq", F.col("result_id")).withColumn("category_key", F.lit("k")).withColumn("name_key", F.col("person_id").cast("string"))
    k = F.col("p_partkey")
    e = read(spark, sf, "part").select(k.alias("evidence_id"), (k % 2000).alias("stage_id"), F.lit("k").alias("category_key"), (k % 50).cast("string").alias("name_key"), (k % 7).cast("int").alias("rank"), F.concat(F.lit("Club "), (k % 20).cast("string")).alias("club"), F.when(k % 2 == 0, "inclusion").otherwise("field").alias("scope"))
    return C.source_evidence(r, e).select("evidence_id", "result_id")


@query(R + "SELECT result_id, CASE WHEN result_kind IN ('relay', 'team') AND team_name IS NOT NULL THEN 'Verein' ELSE 'Verein ' || (person_id % 9)::VARCHAR END AS club FROM r")
def u13_team_club(spark, sf):
    label = F.concat(F.lit("Verein "), (F.col("person_id") % 9).cast("string"))
    team = F.when(F.col("team_name").isNotNull(), label)
    return results(spark, sf).select("result_id", T.team_club(label, team, "result_kind").alias("club"))


@query(R + "SELECT result_id, CASE WHEN result_kind = 'pair' THEN coalesce(rank::VARCHAR, '') || ':' || status || ':' || time_s::VARCHAR || ':' || club ELSE coalesce(team_number, team_name) END AS unit FROM r")
def u2_dedup_units(spark, sf):
    r = results(spark, sf).withColumn("note", F.lit(None).cast("string")).withColumn("leg", F.lit(None).cast("int"))
    return r.select("result_id", U.dedup_unit("result_kind", "rank", "status", "time_s", "club", "note", "team_number", "team_name", "leg", F.lit(False)).alias("unit"))


@query(R + "SELECT result_id, CASE WHEN result_kind IN ('individual', 'family') THEN 'row:' || result_id::VARCHAR ELSE result_kind || ':' || coalesce('n:' || team_number, 't:' || lower(team_name), 'r:' || coalesce(rank::VARCHAR, '') || ':' || time_s::VARCHAR) END AS unit FROM r")
def u9_regional_units(spark, sf):
    r = results(spark, sf).withColumn("key", F.lower("team_name"))
    return r.select("result_id", U.regional_unit("result_id", "result_kind", "key", "rank", "time_s", "team_number").alias("unit"))


def _pending(spark, sf, orders):
    rows = orders.select(F.col("o_orderkey").alias("seq"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("name_key"))
    reg = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("person_id"), F.concat_ws(" ", F.when(F.col("s_suppkey") % 2 == 0, "5-LOW").otherwise("1-URGENT"), F.when(F.col("s_suppkey") % 3 == 0, "F").otherwise("O")).alias("name_key"))
    rows = rows.withColumn("name_key", F.regexp_replace("name_key", "NOT SPECIFIED", "NOT_SPECIFIED"))
    return E.pending_candidates(rows, reg).select("seq", "person_id", "shared")


@query("""WITH a AS (SELECT p, s, unnest([p, s]) AS w FROM (SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS s FROM orders)), b AS (SELECT s_suppkey AS person_id, unnest([CASE WHEN s_suppkey % 2 = 0 THEN '5-LOW' ELSE '1-URGENT' END, CASE WHEN s_suppkey % 3 = 0 THEN 'F' ELSE 'O' END]) AS w FROM supplier)
, n AS (SELECT p, s, person_id, count(*) AS shared FROM a JOIN b USING (w) GROUP BY p, s, person_id)
, t AS (SELECT p, s, person_id, shared FROM n QUALIFY row_number() OVER (PARTITION BY p, s ORDER BY shared DESC, person_id) <= 4)
SELECT o_orderkey AS seq, person_id, shared FROM orders JOIN t ON o_orderpriority = p AND o_orderstatus = s""")
def e9_pending_candidates(spark, sf):
    return _pending(spark, sf, read(spark, sf, "orders"))


#: The name that the query over all orders had beside one over some.
QUERIES["e9_pending_candidates_all"], SQL["e9_pending_candidates_all"] = e9_pending_candidates, SQL["e9_pending_candidates"]


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'WIEN' WHEN 1 THEN 'STMK' WHEN 2 THEN 'NOE' END AS region FROM supplier")
def t22_nation_regions(spark, sf):
    k = F.col("s_suppkey") % 4
    return read(spark, sf, "supplier").select("s_suppkey", C.nation_region(F.when(k == 0, " W.").when(k == 1, "ST").when(k == 2, "N Ö").otherwise("GER")).alias("region"))
