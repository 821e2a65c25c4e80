"""Registered queries: each applies one operator to a whole table; SQL says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import championship as C
from ..operators import dedup as D
from ..operators import filters as FI
from ..operators import identity as E
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import ranking as W
from ..operators import units as U
from ..sources import html, layout
from ..streaming import sync, windows
from .tables import R, read, results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, whole: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL; whole names a column that Spark gives as a 32-bit integer."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"SELECT * REPLACE (CAST({whole} AS INT) AS {whole}) FROM ({sql})" if whole else sql
        return f

    return add


def _order(*names: str) -> Window:
    return Window.orderBy(*names)


# windows -----------------------------------------------------------------------------------------

_OK = "(status = 'ok' AND NOT out_of_competition)"
_TIE = f"""
, m AS (SELECT *, {_OK} AND time_s IS NOT NULL AS good FROM r)
, c AS (SELECT *, CASE WHEN good AND coalesce(lag(good) OVER w, false) AND coalesce(lag(time_s) OVER w = time_s, false) THEN 0 ELSE 1 END AS change FROM m WINDOW w AS (PARTITION BY list_id ORDER BY seq))
, g AS (SELECT *, sum(change) OVER (PARTITION BY list_id ORDER BY seq) AS run FROM c)
, tied AS (SELECT *, CASE WHEN good THEN coalesce(rank, last_value(CASE WHEN good THEN rank END IGNORE NULLS) OVER (PARTITION BY list_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) ELSE rank END AS rank_filled FROM g)
"""


@query(R + _TIE + "SELECT result_id, rank, rank_filled FROM tied")
def w1_tie_fill(spark, sf):
    return W.tie_filled(results(spark, sf), ["list_id"], "seq", is_classified=W.classified()).select("result_id", "rank", "rank_filled")


@query(R + "SELECT result_id, CASE WHEN rank IS NULL AND lead(rank) OVER w = lag(rank) OVER w + 2 THEN lag(rank) OVER w + 1 ELSE rank END AS rank_recovered FROM r WINDOW w AS (PARTITION BY list_id ORDER BY seq)")
def w1b_gap_recovery(spark, sf):
    return W.gap_recovered(results(spark, sf), ["list_id"], "seq").select("result_id", "rank_recovered")


@query(R + "SELECT result_id, rank() OVER (PARTITION BY stage_id ORDER BY (rank IS NULL), rank ASC NULLS FIRST, time_s ASC NULLS FIRST) AS regional_rank FROM r", whole="regional_rank")
def w2_regional_rank(spark, sf):
    return W.regional_rank(results(spark, sf), "stage_id").select("result_id", "regional_rank")


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place FROM customer", whole="place")
def w2_customer_places(spark, sf):
    return W.competition_rank(read(spark, sf, "customer"), ["c_nationkey"], F.col("c_acctbal").desc()).select("c_custkey", "place")


_BEHIND = f"CASE WHEN {_OK} AND rank IS NOT NULL AND time_s >= min(CASE WHEN {_OK} AND rank = 1 THEN time_s END) OVER (PARTITION BY list_id) THEN time_s - min(CASE WHEN {_OK} AND rank = 1 THEN time_s END) OVER (PARTITION BY list_id) END"


@query(R + f"SELECT result_id, {_BEHIND} AS behind_s FROM r")
def w3_time_behind(spark, sf):
    return W.time_behind(results(spark, sf), ["list_id"], counts=W.classified()).select("result_id", "behind_s")


@query(R + """, e AS (SELECT list_id, rank, min(time_s) AS time FROM r WHERE rank IS NOT NULL GROUP BY ALL)
, b AS (SELECT *, max(time) OVER (PARTITION BY list_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e)
SELECT list_id, rank, time, best FROM b WHERE time < best QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY rank) = 1""")
def w4_rank_time_inversion(spark, sf):
    return W.first_inversion(results(spark, sf), ["list_id"])


@query(R + """SELECT result_id FROM r WHERE result_kind <> 'relay' OR team_number IS NULL
UNION ALL SELECT min_by(result_id, result_id) FROM r WHERE result_kind = 'relay' AND team_number IS NOT NULL GROUP BY person_id, list_id, team_number""")
def w5_person_result(spark, sf):
    return W.representative(results(spark, sf), ["person_id", "list_id", "team_number"], "result_id", F.col("result_kind") == "relay").select("result_id")


_UNIT = "CASE WHEN result_kind IN ('relay', 'team') THEN coalesce('n:' || team_number, 't:' || team_name, 'c:' || club) ELSE 'row:' || result_id::VARCHAR END"


@query(R + f""", u AS (SELECT *, {_UNIT} AS unit, status = 'ok' AND eligibility IN ('eligible', 'provisional') AND rank IS NOT NULL AS good FROM r)
, b AS (SELECT stage_id, category, unit, min(rank) AS best FROM u WHERE good GROUP BY ALL)
SELECT u.result_id, CASE WHEN u.good THEN 1 + (SELECT count(*) FROM b WHERE b.stage_id = u.stage_id AND b.category = u.category AND b.best < u.rank) END AS national_rank FROM u""")
def w6_national_rank(spark, sf):
    df = results(spark, sf).withColumn("unit", F.when(F.col("result_kind").isin("relay", "team"), U.team_key("team_number", "team_name", "club")).otherwise(F.concat(F.lit("row:"), F.col("result_id").cast("string"))))
    good = (F.col("status") == "ok") & F.col("eligibility").isin("eligible", "provisional")
    return W.units_ahead_rank(df, ["stage_id", "category"], "unit", counts=good).select("result_id", "national_rank")


@query("SELECT event_id, floor(epoch(ts))::BIGINT - coalesce(lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS leg_s FROM events")
def w7_leg_times(spark, sf):
    ev = read(spark, sf, "events").withColumn("cum", F.unix_timestamp("ts")).withColumn("at", F.struct("ts", "event_id"))
    return W.leg_times(ev, ["user_id"], "at", "cum").select("event_id", "leg_s")


@query(R + """SELECT result_id, CASE WHEN status = 'ok' AND rank IS NULL AND count(*) FILTER (status = 'ok' AND rank = 1) OVER w = 0 AND count(*) FILTER (status = 'ok' AND rank IS NOT NULL) OVER w > 0
  AND time_s = min(CASE WHEN status = 'ok' THEN time_s END) OVER w THEN 1 ELSE rank END AS rank_recovered FROM r WINDOW w AS (PARTITION BY stage_id, category)""")
def w8_winner_recovery(spark, sf):
    return W.winner_recovered(results(spark, sf), ["stage_id", "category"]).select("result_id", "rank_recovered")


@query(R + """SELECT result_id, CASE WHEN championship IS NULL AND status = 'ok' AND rank >= coalesce(min(CASE WHEN status = 'ok' AND championship IS NOT NULL THEN rank END) OVER w, 1)
  THEN max(championship) OVER w ELSE championship END AS championship_spread FROM r WINDOW w AS (PARTITION BY stage_id, category)""")
def w9_champion_boundary(spark, sf):
    return W.champion_boundary(results(spark, sf), ["stage_id", "category"], seq="result_id").select("result_id", "championship_spread")


@query(R + "SELECT result_id, CASE WHEN rank IS NOT NULL THEN row_number() OVER (PARTITION BY list_id, category, rank IS NULL ORDER BY seq) END AS bracket_rank FROM r")
def w10_bracket_renumber(spark, sf):
    return W.bracket_renumbered(results(spark, sf), ["list_id", "category"], "seq").select("result_id", "bracket_rank")


@query(R + """, s AS (SELECT *, coalesce(time_s >= lag(time_s) OVER w, true) AS t, coalesce(rank > lag(rank) OVER w, true) AS k FROM r WINDOW w AS (PARTITION BY list_id ORDER BY seq))
SELECT result_id, CASE WHEN bool_and(t) OVER p AND NOT bool_and(k) OVER p AND time_s IS NOT NULL THEN rank() OVER (PARTITION BY list_id ORDER BY time_s) ELSE rank END AS overall_rank FROM s WINDOW p AS (PARTITION BY list_id)""")
def w11_overall_rederived(spark, sf):
    return W.overall_rederived(results(spark, sf), ["list_id"], "seq").select("result_id", "overall_rank")


@query(R + "SELECT DISTINCT event_id, day::VARCHAR AS day, dense_rank() OVER (PARTITION BY event_id ORDER BY day) AS stage_number FROM r", whole="stage_number")
def w13_stage_numbers(spark, sf):
    return W.stage_numbers(results(spark, sf), "event_id", "day").select("event_id", F.col("day").cast("string").alias("day"), "stage_number").distinct()


@query(R + """, k AS (SELECT *, CASE status WHEN 'ok' THEN 1 WHEN 'dnf' THEN 3 WHEN 'mp' THEN 4 END AS k FROM r)
, t AS (SELECT list_id, club, max(k) AS worst, max(rank) AS team_legs FROM k GROUP BY ALL)
SELECT result_id, CASE worst WHEN 1 THEN 'ok' WHEN 3 THEN 'dnf' ELSE 'mp' END AS team_status, team_legs FROM r JOIN t USING (list_id, club)""")
def w14_team_status(spark, sf):
    df = results(spark, sf).withColumn("leg_count", F.col("rank"))
    return U.normalized_teams(df, ["list_id", "club"], leg="rank").select("result_id", "team_status", "team_legs")


@query(R + "SELECT result_id, row_number() OVER (PARTITION BY list_id, club ORDER BY seq) AS team_sequence FROM r", whole="team_sequence")
def w15_team_numbers(spark, sf):
    return W.team_numbers(results(spark, sf), ["list_id", "club"], "seq").select("result_id", "team_sequence")


# aggregates --------------------------------------------------------------------------------------

_STATS = "count(*) AS starters, count(*) FILTER (status = 'ok') AS classified, min(CASE WHEN rank = 1 THEN time_s END) AS winner_time_s"


@query(R + f"SELECT stage_id, category, {_STATS} FROM r WHERE result_kind NOT IN ('relay', 'family') GROUP BY ALL")
def a1_category_stats(spark, sf):
    return A.category_stats(results(spark, sf), ["stage_id", "category"])


_STARTER = "CASE WHEN result_kind = 'individual' THEN 'p:' || person_id::VARCHAR WHEN result_kind IN ('relay', 'team') THEN coalesce('n:' || team_number, 't:' || team_name, 'c:' || club) ELSE 'c:' || club END"


@query(R + f"SELECT stage_id, category, count(DISTINCT {_STARTER}) AS units FROM r WHERE status IN ('ok', 'dnf', 'mp', 'dsq') AND eligibility <> 'ineligible' GROUP BY ALL HAVING count(DISTINCT {_STARTER}) < 3")
def a2_too_few_starters(spark, sf):
    unit = U.starter_unit("result_kind", "person_id", "team_number", "team_name", "club")
    return A.too_few_starters(results(spark, sf), ["stage_id", "category"], unit, ineligible=F.col("eligibility") == "ineligible")


_DISPLAY = "CASE WHEN result_kind = 'pair' THEN coalesce(rank::VARCHAR, '') || ':' || status || ':' || time_s::VARCHAR || ':' || club WHEN result_kind IN ('relay', 'team') THEN coalesce('n:' || team_number, 't:' || team_name, 'c:' || club) ELSE 'r:' || result_id::VARCHAR END"


@query(R + f"SELECT stage_id, category, count(DISTINCT {_DISPLAY}) AS entries FROM r GROUP BY ALL")
def a3_entries(spark, sf):
    return A.entries(results(spark, sf), ["stage_id", "category"], U.display_unit("result_id", "result_kind", "rank", "status", "time_s", "team_number", "team_name", "club"))


@query(R + "SELECT stage_id, bool_or(championship IS NOT NULL) AS has_championship FROM r GROUP BY ALL")
def a4_any_championship(spark, sf):
    return A.any_known(results(spark, sf), ["stage_id"], "championship")


@query(R + "SELECT list_id, count(*) AS n_rows, count(rank) AS ranked, count(time_s) AS timed FROM r GROUP BY ALL")
def a5_coverage(spark, sf):
    return A.coverage(results(spark, sf), ["list_id"])


@query(R + "SELECT stage_id, string_agg(DISTINCT list_id::VARCHAR, ',' ORDER BY list_id::VARCHAR) AS lists FROM r GROUP BY ALL")
def a6_joined_lists(spark, sf):
    return A.joined_distinct(results(spark, sf), ["stage_id"], "list_id", "lists")


@query(R + "SELECT list_id, rank, min(time_s) AS least_time FROM r WHERE rank IS NOT NULL GROUP BY ALL")
def a7_rank_minima(spark, sf):
    return A.rank_minima(results(spark, sf), ["list_id"])


_SOURCE_UNIT = "CASE WHEN result_kind IN ('individual', 'family') THEN 'row:' || seq::VARCHAR WHEN result_kind = 'pair' AND team_number IS NOT NULL THEN 'pair:n:' || team_number WHEN result_kind = 'pair' THEN 'pair:r:' || coalesce(rank::VARCHAR, '') || ':' || status || ':' || time_s::VARCHAR || ':' || club ELSE result_kind || ':' || coalesce(team_number, team_name, '') END"


@query(R + f"SELECT list_id, count(DISTINCT {_SOURCE_UNIT}) AS source_units FROM r WHERE NOT out_of_competition GROUP BY ALL")
def a8_source_units(spark, sf):
    df = results(spark, sf).withColumn("note", F.lit(None).cast("string"))
    unit = U.source_unit("seq", "result_kind", "club", "rank", "status", "time_s", "club", "note", "team_number", "team_name")
    return A.source_units(df, ["list_id"], unit, F.col("out_of_competition"))


_METRICS = "count(DISTINCT category) AS categories, count(*) AS n_rows, count(rank) AS ranked, count(time_s) AS timed, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (out_of_competition) AS ooc"


@query(R + f"SELECT document_id, {_METRICS} FROM r GROUP BY ALL")
def a9_document_metrics(spark, sf):
    return A.document_metrics(results(spark, sf), "document_id")


@query(R + "SELECT source, result_kind, count(*) AS n FROM r GROUP BY ALL")
def a12_counts(spark, sf):
    return A.counts(results(spark, sf), "source", "result_kind")


@query(R + "SELECT eligibility, count(DISTINCT stage_id) AS stages, count(DISTINCT person_id) AS entries FROM r WHERE club <> 'Club 0' GROUP BY ALL")
def a11_jurisdiction_rollup(spark, sf):
    return A.rollup_by_jurisdiction(results(spark, sf), "eligibility", "stage_id", "person_id", F.col("club") != "Club 0")


_SEASON = "year({d}) + CASE WHEN month({d}) >= 11 AND {s} THEN 1 ELSE 0 END"


@query(f"SELECT o_orderkey, {_SEASON.format(d='o_orderdate', s=chr(34) + 'o_orderpriority' + chr(34) + ' = ' + chr(39) + '1-URGENT' + chr(39))} AS season FROM orders", whole="season")
def m5_season_year(spark, sf):
    sport = F.when(F.col("o_orderpriority") == "1-URGENT", "skiOrienteering").otherwise("foot-o")
    return read(spark, sf, "orders").select("o_orderkey", N.season_year("o_orderdate", sport).alias("season"))


@query(R + "SELECT year(day) + CASE WHEN month(day) >= 11 THEN 1 ELSE 0 END AS season, count(DISTINCT stage_id) AS stages FROM r GROUP BY ALL", whole="season")
def a13_season_counts(spark, sf):
    return A.season_counts(results(spark, sf), N.season_year("day", F.lit("skiOrienteering")), "stage_id")


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS starts FROM customer")
def a14_roster(spark, sf):
    return A.roster(read(spark, sf, "customer").select("c_custkey", "c_name"), read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


_PODIUM = "SELECT o_custkey, rank() OVER (PARTITION BY year(o_orderdate), o_orderpriority ORDER BY o_totalprice DESC) AS won, o_orderpriority = '1-URGENT' AS elite FROM orders"
_MEDALS = "count(*) FILTER (won = 1) AS gold, count(*) FILTER (won = 2) AS silver, count(*) FILTER (won = 3) AS bronze, count(*) FILTER (won = 1 AND elite) AS elite_gold, count(*) FILTER (won = 2 AND elite) AS elite_silver, count(*) FILTER (won = 3 AND elite) AS elite_bronze"


def _podium(spark, sf):
    o = read(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return W.competition_rank(o, ["year", "o_orderpriority"], F.col("o_totalprice").desc(), out="won")


@query(f"WITH p AS ({_PODIUM}), m AS (SELECT o_custkey, {_MEDALS} FROM p WHERE won <= 3 GROUP BY ALL) SELECT *, rank() OVER (ORDER BY gold DESC, silver DESC, bronze DESC, elite_gold DESC, elite_silver DESC, elite_bronze DESC) AS place FROM m", whole="place")
def g1_medal_table(spark, sf):
    return A.medal_table(_podium(spark, sf), ["o_custkey"], "won", F.col("o_orderpriority") == "1-URGENT")


@query(f"WITH p AS (SELECT c_nationkey, won, elite FROM ({_PODIUM}) JOIN customer ON o_custkey = c_custkey), m AS (SELECT c_nationkey, {_MEDALS} FROM p WHERE won <= 3 GROUP BY ALL) SELECT *, rank() OVER (ORDER BY gold DESC, silver DESC, bronze DESC, elite_gold DESC, elite_silver DESC, elite_bronze DESC) AS place FROM m", whole="place")
def g1b_club_medals(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    p = _podium(spark, sf).filter("won <= 3").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return A.medal_table(p, ["c_nationkey"], "won", F.col("o_orderpriority") == "1-URGENT")


@query("""WITH e AS (SELECT p_size, p_brand AS name, count(*) AS n, min(p_partkey) AS f, sum(CASE WHEN p_partkey % 3 = 0 THEN 1 END) AS an, min(CASE WHEN p_partkey % 3 = 0 THEN p_partkey END) AS af FROM part GROUP BY ALL)
SELECT p_size, coalesce((SELECT name FROM e x WHERE x.p_size = e.p_size AND x.an IS NOT NULL ORDER BY an DESC, af LIMIT 1), (SELECT name FROM e x WHERE x.p_size = e.p_size ORDER BY n DESC, f LIMIT 1)) AS name FROM e GROUP BY p_size""")
def g2_canonical_names(spark, sf):
    p = read(spark, sf, "part").withColumnRenamed("p_brand", "name")
    return A.canonical_names(p, "p_size", "name", "p_partkey", F.col("p_partkey") % 3 == 0)


@query(R + "SELECT person_id, club, count(*) AS n, count(rank) AS ranked FROM r GROUP BY ALL")
def g3_associations(spark, sf):
    return A.associations(results(spark, sf), "person_id", "club")


@query(R + """, v AS (SELECT list_id, rank, time_s AS v, count(*) AS n FROM r WHERE rank IS NOT NULL GROUP BY ALL)
, b AS (SELECT list_id, rank, arg_max(v, n * 1000 - v) AS agreed, max(n) AS most, count(*) AS vals FROM v GROUP BY ALL)
SELECT result_id, CASE WHEN most >= 2 AND vals > 1 THEN agreed ELSE time_s END AS time_agreed FROM r LEFT JOIN b USING (list_id, rank)""")
def g5_rank_consensus(spark, sf):
    return W.rank_consensus(results(spark, sf), ["list_id"]).select("result_id", "time_agreed")


@query("""WITH s AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 ELSE -1 END AS s FROM orders)
SELECT o_custkey, count(*) FILTER (s > 0) AS last_first, count(*) FILTER (s < 0) AS first_last, count(*) FILTER (s > 0) >= 3 AND count(*) FILTER (s > 0) > 4 * count(*) FILTER (s < 0) AS flip FROM s GROUP BY ALL""")
def g6_name_order_vote(spark, sf):
    s = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(-1)
    return A.name_order_votes(read(spark, sf, "orders"), "o_custkey", s)


# duplicates --------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang, n_chars")
def d1_semantic_duplicates(spark, sf):
    return D.semantic(read(spark, sf, "documents").drop("source"), [], "doc_id").select("doc_id")


@query("SELECT o_orderkey FROM orders QUALIFY o_orderpriority = min(o_orderpriority) OVER (PARTITION BY o_custkey)")
def d2_best_priority(spark, sf):
    return D.best_priority(read(spark, sf, "orders"), ["o_custkey"], F.col("o_orderpriority")).select("o_orderkey")


@query(R + """, f AS (SELECT *, min(list_id) OVER (PARTITION BY stage_id, category, person_id) AS first FROM r)
SELECT result_id FROM f WHERE list_id = first QUALIFY row_number() OVER (PARTITION BY stage_id, category, person_id, rank, status, time_s, club ORDER BY result_id) = 1""")
def d3_first_list_wins(spark, sf):
    return D.first_list_wins(results(spark, sf), ["stage_id", "category", "person_id"], ["rank", "status", "time_s", "club"], "list_id", "result_id").select("result_id")


@query("""WITH d AS (SELECT doc_id, md5(text) AS content, CAST(substr(source, 4) AS BIGINT) AS owner, n_chars // 100 AS day FROM documents)
, b AS (SELECT owner, count(DISTINCT day) AS dates, count(*) AS docs FROM d GROUP BY ALL)
, h AS (SELECT DISTINCT content, owner, dates, docs FROM d JOIN b USING (owner))
, k AS (SELECT content, owner AS keep FROM h QUALIFY row_number() OVER (PARTITION BY content ORDER BY dates DESC, docs DESC, owner) = 1)
SELECT doc_id FROM d JOIN k USING (content) WHERE owner = keep""")
def d4_broadest_owner(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.md5("text").alias("content"), F.substring("source", 4, 9).cast("long").alias("owner"), F.expr("n_chars div 100").alias("day"))
    return D.broadest_owner(d, "content", "owner", "day").select("doc_id")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderpriority = '5-LOW', o_orderstatus <> 'F', o_totalprice <= 200000, o_orderkey) AS doc_order FROM orders""")
def d5_document_order(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("split"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))).otherwise(F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("name"), F.when(F.col("o_orderstatus") == "F", "relay").otherwise("race").alias("kind"), (F.col("o_totalprice") > 200000).alias("extract"))
    return D.document_order(o, "o_custkey", "name", "kind", F.col("extract")).select("o_orderkey", "doc_order")


@query(R + """SELECT result_id FROM r WHERE result_kind = 'family' QUALIFY row_number() OVER (PARTITION BY stage_id, category, club ORDER BY result_id) = 1""")
def d6_special_rows(spark, sf):
    return D.upsert(results(spark, sf).filter("result_kind = 'family'"), ["stage_id", "category", "club"], "result_id").select("result_id")


@query("""WITH o AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderkey AS pos FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, o_totalprice + 1 AS price, -o_orderkey AS pos FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.price, o.price) AS price, row_number() OVER (ORDER BY o.pos ASC NULLS LAST, n.pos ASC NULLS LAST) AS pos FROM o FULL JOIN n USING (id)""")
def d7_snapshot_merge(spark, sf):
    o = read(spark, sf, "orders")
    old = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("pos"))
    new = o.filter("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + 1).alias("price"), (-F.col("o_orderkey")).alias("pos"))
    return D.merged_snapshot(old, new, "id", "pos").select("id", "price", "pos")


@query("""WITH e AS (SELECT o_custkey AS event_id, o_orderkey AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderkey % 2 = 0)
, l AS (SELECT event_id, max(position) + 1 AS nxt FROM e GROUP BY ALL)
SELECT o_custkey AS event_id, o_orderkey AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + coalesce(nxt, 0) AS position FROM orders LEFT JOIN l ON event_id = o_custkey WHERE o_orderkey % 2 = 1""")
def d8_appended_index(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("url"))
    number = (F.row_number().over(Window.partitionBy("event_id").orderBy("url")) - 1).cast("long")
    old = o.filter("url % 2 = 0").withColumn("position", number)
    return sync.index_additions(old, o.withColumn("position", F.col("url"))).select("event_id", "url", "position")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def d9_insert_or_replace(spark, sf):
    return D.upsert(read(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", replace=True)


# joins -------------------------------------------------------------------------------------------

_INTERVALS = "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN DATE '1995-01-01' + CAST(c_custkey % 900 AS INT) END AS valid_from, CASE WHEN c_custkey % 7 <> 0 THEN DATE '1995-01-01' + CAST(c_custkey % 900 + 700 AS INT) END AS valid_to FROM customer"


@query(f"WITH i AS ({_INTERVALS}) SELECT o_orderkey FROM orders JOIN i ON o_custkey = c_custkey WHERE (valid_from IS NULL OR valid_from <= o_orderdate::DATE) AND (valid_to IS NULL OR valid_to >= o_orderdate::DATE)")
def j1_valid_on(spark, sf):
    i = read(spark, sf, "customer").selectExpr("c_custkey as o_custkey", "if(c_custkey % 5 <> 0, date_add(date'1995-01-01', cast(c_custkey % 900 as int)), null) as valid_from", "if(c_custkey % 7 <> 0, date_add(date'1995-01-01', cast(c_custkey % 900 + 700 as int)), null) as valid_to")
    o = read(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return J.valid_on(o, i, "o_custkey", "day", "valid_from", "valid_to").select("o_orderkey")


@query("WITH u AS (SELECT s_nationkey, min(s_suppkey) AS matched FROM supplier WHERE s_acctbal > 7000 GROUP BY ALL HAVING count(*) = 1) SELECT c_custkey, matched FROM customer LEFT JOIN u ON s_nationkey = c_nationkey")
def j2_unique_match(spark, sf):
    s = read(spark, sf, "supplier").filter("s_acctbal > 7000").withColumnRenamed("s_nationkey", "c_nationkey")
    return J.unique_match(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), s, ["c_nationkey"], "s_suppkey").select("c_custkey", "matched")


@query(R + """SELECT stage_id, n_name, count(*) AS n FROM r JOIN orders ON list_id = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def j3_lookups(spark, sf):
    r, o, c, n = results(spark, sf), read(spark, sf, "orders"), read(spark, sf, "customer"), read(spark, sf, "nation")
    return A.counts(r.join(o, F.col("list_id") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")), "stage_id", "n_name")


@query("""WITH a AS (SELECT s_nationkey AS k, min(s_suppkey) AS v FROM supplier WHERE s_suppkey % 9 = 0 GROUP BY ALL), b AS (SELECT n_nationkey AS k, min(n_regionkey) AS v FROM nation WHERE n_nationkey % 2 = 0 GROUP BY ALL)
SELECT c_custkey, coalesce(a.v, b.v) AS matched, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 END AS matched_tier FROM customer LEFT JOIN a ON a.k = c_nationkey LEFT JOIN b ON b.k = c_nationkey""")
def j4_fallback_tiers(spark, sf):
    a = read(spark, sf, "supplier").filter("s_suppkey % 9 = 0").withColumnRenamed("s_nationkey", "c_nationkey")
    b = read(spark, sf, "nation").filter("n_nationkey % 2 = 0").withColumnRenamed("n_nationkey", "c_nationkey").withColumn("n_regionkey", F.col("n_regionkey").cast("long"))
    return J.fallback_match(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), [(a, ["c_nationkey"], "s_suppkey"), (b, ["c_nationkey"], "n_regionkey")]).select("c_custkey", "matched", "matched_tier")


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'partial' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'ordered' ELSE 'unexplained' END AS reason FROM customer""")
def j8_coverage_reasons(spark, sf):
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.covered(read(spark, sf, "customer").select("c_custkey"), "c_custkey", [("partial", o.filter("o_orderstatus = 'P'")), ("ordered", o)], "unexplained")


@query(R + "SELECT DISTINCT person_id, event_id FROM r WHERE eligibility <> 'eligible' AND championship IS NOT NULL")
def j9_candidate_scan(spark, sf):
    r = results(spark, sf).withColumn("nationality", F.when(F.col("eligibility") == "eligible", "AUT").otherwise("XXX"))
    return sync.foreign_candidates(r)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS old_id, p_partkey // 2 AS new_id FROM part WHERE p_partkey > 1), w AS (SELECT old_id, new_id FROM e UNION ALL SELECT w.old_id, e.new_id FROM w JOIN e ON w.new_id = e.old_id) SELECT old_id, min(new_id) AS new_id FROM w GROUP BY old_id""")
def x1_merge_chains(spark, sf):
    p = read(spark, sf, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("old_id"), F.expr("p_partkey div 2").alias("new_id"))
    return J.resolved_chains(p)


@query(R + "SELECT result_id, CASE WHEN person_id % 3 = 0 THEN person_id // 3 ELSE person_id END AS person_id FROM r")
def j13_reassigned(spark, sf):
    m = read(spark, sf, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("old_id"), F.expr("s_suppkey div 3").alias("new_id"))
    return J.reassigned(results(spark, sf).select("result_id", "person_id"), m, "person_id")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def j8_never_sold(spark, sf):
    sold = read(spark, sf, "lineitem").filter("l_quantity > 45").withColumnRenamed("l_partkey", "p_partkey")
    return J.without(read(spark, sf, "part").select("p_partkey"), sold.select("p_partkey"), ["p_partkey"])


# filters -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')")
def f1_active_rows(spark, sf):
    o = read(spark, sf, "orders").withColumn("cls", F.when(F.col("o_orderstatus") == "P", "inactive").when(F.col("o_orderstatus") == "F", "Disqualified").otherwise("classified")).withColumn("cat", F.when(F.col("o_orderpriority") == "5-LOW", " EMPTY ").otherwise("H21")).withColumn("club", F.lit("27:16:00 0"))
    return o.filter(FI.is_active("cls", "cat", "club")).select("o_orderkey")


@query(R + "SELECT list_id, bool_or(result_kind IN ('relay', 'team') OR time_s > 20) AS usable FROM r GROUP BY ALL")
def f2_usable_documents(spark, sf):
    r = results(spark, sf).withColumn("name", F.when(F.col("time_s") > 20, "Anna Muster").when(F.col("time_s") > 10, "EMPTY").otherwise("4,950 km"))
    return FI.usable_documents(r, "list_id", "name", "result_kind")


@query(R + "SELECT result_id, CASE WHEN category = 'Familie' THEN 'family' ELSE 'ordinary' END AS family FROM r")
def f5_family_class(spark, sf):
    return results(spark, sf).select("result_id", T.family_class("category").alias("family"))


@query(R + "SELECT result_id FROM r WHERE category NOT IN ('Familie') AND NOT (championship IS NOT NULL)")
def f12_discipline(spark, sf):
    return FI.of_discipline(results(spark, sf), "category", ["Familie"]).filter(F.col("championship").isNull()).select("result_id")


@query(R + """SELECT result_id, category IN ('Herren ab 35', 'H-14') AS open_title, category IN ('Damen 21 Elite', 'Herren 21 Elite') AS state_title FROM r""")
def f14_title_classes(spark, sf):
    return results(spark, sf).select("result_id", T.open_eligible("category").alias("open_title"), T.state_eligible("category").alias("state_title"))


@query(R + """SELECT person_id, day::VARCHAR AS day, count(*) FILTER (status = 'ok') AS timed, count(rank) AS ranked, max(CASE WHEN status = 'ok' THEN time_s END) AS longest FROM r GROUP BY ALL HAVING count(*) FILTER (status = 'ok') >= 2 AND count(rank) = 0""")
def f9_minute_precision(spark, sf):
    return FI.minute_precision(results(spark, sf).withColumn("day", F.col("day").cast("string")), ["person_id", "day"], least=2)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1998-01-01' AND o_orderstatus = 'O'")
def f16_past_public(spark, sf):
    o = read(spark, sf, "orders").withColumn("visibility", F.when(F.col("o_orderstatus") == "O", "public").otherwise("draft"))
    return FI.past_public(o, "o_orderdate", "visibility", "1998-01-01").select("o_orderkey")


@query(R + "SELECT result_id FROM r WHERE (stage_id, category) NOT IN (SELECT stage_id, category FROM r WHERE championship IS NOT NULL)")
def f23_ungated(spark, sf):
    return FI.ungated(results(spark, sf), ["stage_id", "category"], "championship").select("result_id")


@query("""SELECT o_orderkey FROM orders o WHERE o_orderstatus <> 'P' OR NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus <> 'P')""")
def f8_course_views(spark, sf):
    o = read(spark, sf, "orders").withColumn("name", F.when(F.col("o_orderstatus") == "P", "ergebnis-nach-bahnen.html").otherwise("ergebnis.html"))
    return FI.without_course_views(o, ["o_custkey"], "name").select("o_orderkey")


# sorts, sets, scalars ----------------------------------------------------------------------------


@query(R + "SELECT result_id, row_number() OVER (PARTITION BY list_id ORDER BY rank IS NULL, rank, team_number NULLS FIRST, time_s, seq) AS place FROM r", whole="place")
def s1_result_order(spark, sf):
    w = Window.partitionBy("list_id").orderBy(F.col("rank").isNull(), "rank", F.col("team_number").asc_nulls_first(), "time_s", "seq")
    return results(spark, sf).select("result_id", F.row_number().over(w).alias("place"))


@query(R + """SELECT category, row_number() OVER (ORDER BY CASE WHEN category LIKE 'D%' THEN 0 WHEN category LIKE 'H%' THEN 1 ELSE 2 END, coalesce(nullif(regexp_extract(category, '(\\d+)', 1), '')::INT, 999), lower(category), category) AS place FROM (SELECT DISTINCT category FROM r)""", whole="place")
def s2_category_order(spark, sf):
    c = results(spark, sf).select("category").distinct()
    return c.select("category", F.row_number().over(Window.orderBy(*T.category_order("category"))).alias("place"))


@query("SELECT c_custkey, n FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY ALL) ORDER BY n DESC, c_custkey LIMIT 10")
def s3_search_hits(spark, sf):
    return A.counts(read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").orderBy(F.desc("n"), "c_custkey").limit(10)


@query("(SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION (SELECT s_suppkey FROM supplier INTERSECT SELECT p_partkey FROM part)")
def s8_set_operations(spark, sf):
    a = read(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    b = read(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey")
    return a.subtract(b).union(read(spark, sf, "supplier").select("s_suppkey").intersect(read(spark, sf, "part").select("p_partkey"))).distinct()


@query("SELECT c_custkey, array_to_string(list_sort(regexp_extract_all(lower(c_name || ' Élan Zoë'.replace('É', 'E').replace('ë', 'e')), '([a-zäöüß]+)')), ' ') AS key FROM customer")
def t1_name_key(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", T.name_key(F.concat("c_name", F.lit(" Élan Zoë"))).alias("key"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name FROM part")
def t2_clean_name(spark, sf):
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)"))
    return read(spark, sf, "part").select("p_partkey", T.clean_name(F.concat((F.col("p_partkey") % 90 + 1).cast("string"), F.lit(" "), name)).alias("name"))


@query("SELECT s_suppkey, s_name AS club FROM supplier")
def t5_clean_club(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", T.clean_club(F.concat(F.lit("Empty  "), "s_name")).alias("club"))


@query(R + "SELECT result_id, CASE category WHEN 'Damen 21 Elite' THEN 21 WHEN 'Herren 21 Elite' THEN 21 WHEN 'Herren ab 35' THEN 35 WHEN 'H-14' THEN 14 WHEN 'D21 Kurz' THEN 21 END AS age FROM r")
def t14_min_age(spark, sf):
    return results(spark, sf).select("result_id", T.min_age("category").alias("age"))


@query(R + "SELECT result_id, CASE status WHEN 'dnf' THEN 'dnf' WHEN 'mp' THEN 'mp' WHEN 'ok' THEN CASE WHEN out_of_competition THEN 'ok' END END AS parsed FROM r")
def t26_parse_status(spark, sf):
    text = F.when(F.col("status") == "dnf", "Aufgegeben.").when(F.col("status") == "mp", "Posten 31 fehlt").otherwise(F.when(F.col("out_of_competition"), "AK").otherwise("Slovakia"))
    return results(spark, sf).select("result_id", T.parse_status(text).alias("parsed"))


@query(R + "SELECT result_id, CASE WHEN status = 'dnf' THEN 'dns' WHEN out_of_competition AND status = 'mp' THEN 'ok' WHEN status = 'mp' THEN 'unknown' ELSE 'ok' END AS status, out_of_competition AS ooc FROM r")
def t29_normalized_status(spark, sf):
    raw = F.when(F.col("status") == "dnf", "n. ang.").when(F.col("status") == "mp", "?").otherwise("ok")
    st = F.when(F.col("status") == "ok", "ok").otherwise("weird")
    s = T.normalized_status(st, raw, F.col("out_of_competition"))
    return results(spark, sf).select("result_id", s["status"].alias("status"), s["ooc"].alias("ooc"))


@query(R + "SELECT result_id, CASE WHEN time_s % 2 = 0 THEN 'relay' WHEN time_s % 3 = 0 THEN 'overall' ELSE 'race' END AS kind FROM r")
def t30_list_type(spark, sf):
    name = F.when(F.col("time_s") % 2 == 0, "erg-staffel.html").when(F.col("time_s") % 3 == 0, "splits.html").otherwise("ergebnis.html")
    return results(spark, sf).select("result_id", T.list_type(name, F.lit("")).alias("kind"))


@query(R + "SELECT result_id, CASE WHEN rank IS NULL THEN NULL ELSE rank END AS declared FROM r")
def t37_declared_count(spark, sf):
    return results(spark, sf).select("result_id", T.declared_count(F.concat(F.lit("H 21 ("), F.col("rank").cast("string"), F.lit(" / 99)"))).alias("declared"))


@query("SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp(;|$|[^;])', '&\\1', 'g').replace('&;', '&'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g')), '') AS title, len(regexp_extract_all(html, '(?i)<a\\b')) AS n_links FROM pages", whole="n_links")
def t38_page_titles(spark, sf):
    return html.links(read(spark, sf, "pages"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity::INT * 60 + l_linenumber)::INT AS s, (l_quantity::INT * 3600 + l_linenumber)::INT AS h FROM lineitem")
def m1_parse_time(spark, sf):
    m = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":0"), F.col("l_linenumber").cast("string"))
    h = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":00:0"), F.col("l_linenumber").cast("string"), F.lit(" (*)"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.parse_time(m).alias("s"), N.parse_time_loose(h).alias("h"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '20' || strftime(o_orderdate, '%y-%m-%d') WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def m6_document_date(spark, sf):
    o = read(spark, sf, "orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "'Erg'ddMMyy'-a.html'")).otherwise("x.html")
    return o.select("o_orderkey", N.document_date(name, F.date_format("o_orderdate", "'am' d.M.yyyy 'in'")).alias("day"))


@query("SELECT p_partkey, p_size * 1000 AS length_m, p_size AS climb_m, (p_partkey % 30)::INT AS controls FROM part")
def m7_course_info(spark, sf):
    c = N.course_info(F.concat(F.col("p_size").cast("string"), F.lit(",0 km  "), F.col("p_size").cast("string"), F.lit(" Hm  "), (F.col("p_partkey") % 30).cast("string"), F.lit(" P")))
    return read(spark, sf, "part").select("p_partkey", c["length_m"].alias("length_m"), c["climb_m"].alias("climb_m"), c["controls"].alias("controls"))


@query("SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS t FROM (SELECT o_orderkey, (o_orderkey % 9000)::BIGINT AS s FROM orders)")
def m8_format_time(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", N.format_time(F.col("o_orderkey") % 9000).alias("t"))


@query("SELECT o_orderkey, 'list:' || substr(sha256(o_orderkey::VARCHAR || chr(0) || o_custkey::VARCHAR || chr(0) || o_orderpriority), 1, 24) AS id FROM orders")
def m10_list_ids(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", N.hash_id("list", "o_orderkey", "o_custkey", "o_orderpriority").alias("id"))


@query("SELECT c_custkey, -((('0x' || substr(sha256('person-v1' || chr(0) || lower(c_name) || chr(0) || '1990' || chr(0) || '0'), 1, 16))::UHUGEINT % 4611686018427387904)::BIGINT + 1) AS id FROM customer")
def m11_synthetic_ids(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", N.synthetic_id(F.lower("c_name"), F.lit(1990)).alias("id"))


@query("SELECT c_custkey, CASE WHEN y <= 26 THEN 2000 + y ELSE 1900 + y END AS year FROM (SELECT c_custkey, (c_custkey % 100)::INT AS y FROM customer)")
def m13_birth_years(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", N.birth_year((F.col("c_custkey") % 100).cast("int")).alias("year"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def m14_event_props(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# units, identity ---------------------------------------------------------------------------------

_AUDIT = "CASE WHEN result_kind IN ('individual', 'family') THEN 'row:' || result_id::VARCHAR WHEN result_kind = 'pair' AND team_number IS NOT NULL THEN 'pair:number:' || team_number WHEN result_kind = 'pair' THEN 'pair:' || coalesce(rank::VARCHAR, 'None') || ':' || status || ':' || time_s::VARCHAR || ':' || club WHEN team_number IS NOT NULL THEN result_kind || ':number:' || team_number WHEN team_name IS NOT NULL THEN result_kind || ':name:' || lower(team_name) ELSE result_kind || ':legacy:' || lower(club) END"


@query(R + f"SELECT result_id, {_AUDIT} AS unit FROM r")
def u1_audit_units(spark, sf):
    r = results(spark, sf).withColumn("note", F.lit(None).cast("string")).withColumn("name", F.lit(None).cast("string"))
    return r.select("result_id", U.audit_key("result_id", "name", "result_kind", "rank", "status", "time_s", "club", "note", "team_number", "team_name").alias("unit"))


@query(R + """SELECT stage_id, string_agg(DISTINCT club, ' + ' ORDER BY club) AS names FROM r WHERE result_kind = 'family' GROUP BY ALL""")
def u5_family_collapse(spark, sf):
    r = results(spark, sf).filter("result_kind = 'family'")
    return U.collapsed_family(r.withColumn("k", F.struct("club", "result_id")), ["stage_id"], "club", "k").select("stage_id", "names")


@query(R + """SELECT list_id, club, string_agg(result_id::VARCHAR, ',' ORDER BY coalesce(rank, 2147483647), result_id::VARCHAR) AS members FROM r GROUP BY ALL""")
def u11_member_order(spark, sf):
    r = results(spark, sf).withColumn("name", F.col("result_id").cast("string"))
    return U.ordered_members(r, ["list_id", "club"], "rank", "name").select("list_id", "club", F.array_join("members", ",").alias("members"))


@query("""SELECT l_orderkey AS list_id, list_pos - 1 AS member_pos, name, leg_number, leg_s FROM (
  SELECT l_orderkey, row_number() OVER w AS list_pos, l_partkey::VARCHAR AS name, l_linenumber AS leg_number, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity::INT END - coalesce(last_value(CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity::INT END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS leg_s
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity))""")
def u4_relay_explode(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    m = F.struct("l_linenumber", "l_partkey", "l_quantity")
    member = lambda x: F.struct(x["l_partkey"].cast("string").alias("name"), x["l_partkey"].alias("person_id"), x["l_linenumber"].alias("leg"), F.when(x["l_linenumber"] % 4 != 0, x["l_quantity"].cast("int")).alias("cumulative_s"))
    t = li.groupBy(F.col("l_orderkey").alias("list_id")).agg(F.transform(F.array_sort(F.collect_list(m)), member).alias("members"))
    return U.exploded_relay(t).select("list_id", F.col("member_pos").cast("long").alias("member_pos"), "name", "leg_number", "leg_s")


@query("""SELECT c_custkey, unnest([split_part(c_name, '#', 1) || 'A Huber', 'Eva Huber']) AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'Solo Person' FROM customer WHERE c_custkey % 2 = 1""")
def u6_pair_expansion(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.split("c_name", "#")[0], F.lit("A / Eva Huber"))).otherwise("Solo Person").alias("name"))
    return U.expanded_pairs(c).select("c_custkey", "name")


@query("""WITH y AS (SELECT c_nationkey AS k, (c_custkey % 40)::INT AS y, min(c_custkey) AS p FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL HAVING count(DISTINCT c_custkey) = 1)
, yy AS (SELECT DISTINCT c_nationkey AS k, (c_custkey % 40)::INT AS y FROM customer WHERE c_custkey % 3 = 0)
, c AS (SELECT c_nationkey AS k, c_mktsegment AS c, min(c_custkey) AS p FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL HAVING count(DISTINCT c_custkey) = 1)
SELECT s_suppkey, CASE WHEN yy.k IS NOT NULL THEN y.p ELSE c.p END AS registry_id, CASE WHEN y.p IS NOT NULL THEN 'registry_year' WHEN yy.k IS NULL AND c.p IS NOT NULL THEN 'registry_club' END AS basis
FROM supplier LEFT JOIN yy ON yy.k = s_nationkey AND yy.y = s_suppkey % 40 LEFT JOIN y ON y.k = s_nationkey AND y.y = s_suppkey % 40 LEFT JOIN c ON c.k = s_nationkey AND c.c = 'MACHINERY'""")
def e2_registry_match(spark, sf):
    reg = read(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").cast("string").alias("name_key"), (F.col("c_custkey") % 40).cast("int").alias("birth_year"), F.col("c_mktsegment").alias("club"))
    rows = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("name_key"), (F.col("s_suppkey") % 40).cast("int").alias("birth_year"), F.lit("MACHINERY").alias("club"))
    return E.registry_match(rows, reg).select("s_suppkey", "registry_id", "basis")


@query()
def e3_resolved_identities(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("name_key"), F.when(F.col("o_orderkey") % 3 != 0, 1950 + (F.col("o_orderkey") % 4)).cast("int").alias("birth_year"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey")).alias("user_id"), F.lit(None).cast("long").alias("registry_id"), F.lit(None).cast("string").alias("basis"))
    return E.resolved(o).select("seq", "person_id", "identity_state", "identity_confidence")


@query("""WITH p AS (SELECT c_custkey + 1 AS id, c_nationkey % 7 || '-' || c_mktsegment AS k, CASE WHEN c_custkey % 3 = 0 THEN (c_nationkey % 2)::INT END AS y, c_acctbal > 5000 AS v FROM customer)
, n AS (SELECT k, count(DISTINCT y) AS years FROM p GROUP BY ALL), g AS (SELECT p.*, CASE WHEN years <= 1 THEN -1 ELSE y END AS grp FROM p JOIN n USING (k))
, b AS (SELECT k, grp, first(id ORDER BY v DESC, y IS NOT NULL DESC, id) AS new_id FROM g WHERE grp IS NOT NULL GROUP BY ALL)
SELECT id AS old_id, new_id FROM g JOIN b USING (k, grp) WHERE id <> new_id""")
def e7_merge_edges(spark, sf):
    p = read(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("person_id"), F.concat_ws("-", (F.col("c_nationkey") % 7).cast("string"), "c_mktsegment").alias("name_key"), F.when(F.col("c_custkey") % 3 == 0, (F.col("c_nationkey") % 2).cast("int")).alias("birth_year"), (F.col("c_acctbal") > 5000).alias("verified"))
    return E.merge_edges(p)


@query(R + "SELECT person_id, count(DISTINCT club) AS names, count(DISTINCT eligibility) AS years FROM r GROUP BY ALL HAVING count(DISTINCT club) > 1 OR count(DISTINCT eligibility) > 1")
def e10_merge_conflicts(spark, sf):
    return E.merge_conflicts(results(spark, sf), "person_id", "club", "eligibility")


@query("""WITH b AS (SELECT o_custkey AS p, o_orderkey // 4 AS s FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 = 0), a AS (SELECT o_custkey AS p, o_orderkey // 4 AS s FROM orders WHERE o_custkey % 3 <> 0)
, bb AS (SELECT DISTINCT p, s FROM b), aa AS (SELECT DISTINCT p, s FROM a), v AS (SELECT bb.p AS old_id, aa.p AS new_id, count(*) AS votes FROM bb JOIN aa USING (s) GROUP BY ALL), t AS (SELECT p AS old_id, count(*) AS al FROM bb GROUP BY ALL)
, m AS (SELECT *, max(votes) OVER (PARTITION BY old_id) AS top FROM v JOIN t USING (old_id)), q AS (SELECT *, count(*) OVER (PARTITION BY old_id) AS ties FROM m WHERE votes = top)
SELECT old_id, new_id, votes FROM q WHERE ties = 1 AND (votes >= 2 OR votes = al)""")
def e12_redirect_votes(spark, sf):
    o = read(spark, sf, "orders").withColumn("person_id", F.col("o_custkey")).withColumn("s", F.expr("o_orderkey div 4"))
    before = E.signatures(o.filter("o_orderkey % 2 = 0 AND o_custkey % 3 = 0"), "person_id", "s")
    return E.voted_redirects(before, E.signatures(o.filter("o_custkey % 3 <> 0"), "person_id", "s"))


@query("SELECT o_custkey, o_orderpriority AS name, o_orderstatus AS source, count(*) AS occurrences FROM orders GROUP BY ALL")
def e14_aliases(spark, sf):
    return E.published_aliases(read(spark, sf, "orders").withColumnRenamed("o_orderpriority", "name").withColumnRenamed("o_orderstatus", "source"), "o_custkey", "name", "source")


@query("SELECT p_partkey // 2 AS new_id, p_partkey AS old_id FROM part WHERE p_partkey // 2 > 500")
def e15_tombstones(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("old_id"), F.expr("p_partkey div 2").alias("new_id"))
    return J.tombstones(p, read(spark, sf, "part").filter("p_partkey <= 500 OR p_partkey > 100000000").select(F.col("p_partkey").alias("id")).union(spark.createDataFrame([(0,)], "id long")))


# championship ------------------------------------------------------------------------------------


@query(R + "SELECT result_id, CASE WHEN NOT out_of_competition THEN championship END AS championship FROM r")
def c9_ooc_strip(spark, sf):
    return C.ooc_stripped(results(spark, sf)).select("result_id", "championship")


@query(R + "SELECT result_id, CASE WHEN NOT (result_kind = 'individual' AND category = 'D21 Kurz') THEN championship END AS championship FROM r")
def c3_overlap_strip(spark, sf):
    return C.overlap_stripped(results(spark, sf)).select("result_id", "championship")


@query(R + "SELECT DISTINCT event_id, person_id FROM r WHERE club IN ('Club 3', 'Club 7')")
def c10_ineligible(spark, sf):
    r = results(spark, sf).withColumn("club", F.when(F.col("club") == "Club 3", "0392 - A.S.D.").when(F.col("club") == "Club 7", "vereinslos").when(F.col("club") == "Club 8", "AA Team Kärnten").otherwise(F.col("club")))
    return C.ineligible_starters(r)


@query(R + """, b AS (SELECT DISTINCT event_id, person_id FROM r WHERE club = 'Club 3'), x AS (SELECT r.*, b.person_id IS NOT NULL AS bad, coalesce('n:' || team_number, 't:' || team_name, 'c:' || club, '') AS team FROM r LEFT JOIN b USING (event_id, person_id))
SELECT result_id, CASE WHEN NOT (bad OR (result_kind = 'pair' AND rank IS NOT NULL AND bool_or(bad) OVER (PARTITION BY stage_id, category, rank)) OR (result_kind IN ('relay', 'team') AND bool_or(bad) OVER (PARTITION BY stage_id, category, result_kind, team))) THEN championship END AS championship FROM x""")
def c11_unit_taint(spark, sf):
    r = results(spark, sf)
    return C.tainted(r, r.filter("club = 'Club 3'").select("event_id", "person_id")).select("result_id", "championship")


@query(R + """, l AS (SELECT DISTINCT person_id, event_id FROM r WHERE club = 'Club 1'), x AS (SELECT r.*, l.person_id IS NOT NULL AS led FROM r LEFT JOIN l USING (person_id, event_id))
SELECT result_id, CASE WHEN championship IS NULL THEN NULL WHEN person_id % 2 = 0 OR led THEN 'eligible' WHEN person_id % 3 = 0 THEN 'provisional' ELSE 'unknown' END AS eligibility FROM x""")
def c8_eligibility_evidence(spark, sf):
    r = results(spark, sf).drop("eligibility").withColumn("nationality", F.when(F.col("person_id") % 2 == 0, "AUT")).withColumn("official_club", F.when(F.col("person_id") % 3 == 0, F.col("club"))).withColumn("eligibility_basis", F.lit(None).cast("string"))
    ledger = r.filter("club = 'Club 1'").select("person_id", "event_id").distinct().withColumn("decision", F.lit("true"))
    return C.eligibility(r, ledger).select("result_id", "eligibility")


@query(R + """SELECT 'championship:' || substr(sha256('AUT' || chr(0) || stage_id::VARCHAR || chr(0) || category || chr(0) || championship), 1, 24) AS instance_id, stage_id, category, string_agg(DISTINCT source, ',' ORDER BY source) AS fingerprints FROM r WHERE championship IS NOT NULL GROUP BY stage_id, category, championship""")
def c13_national_instances(spark, sf):
    return C.national_instances(results(spark, sf).withColumnRenamed("source", "fingerprint")).select("instance_id", "stage_id", "category", "fingerprints")


@query(R + "SELECT result_id, list_extract(['gold', 'silver', 'bronze'], rank) AS medal, rank AS place, CASE WHEN eligibility = 'eligible' THEN 'derived' ELSE 'provisional' END AS state FROM r WHERE rank BETWEEN 1 AND 3 AND status = 'ok' AND NOT out_of_competition AND eligibility IN ('eligible', 'provisional')")
def c13_awards(spark, sf):
    r = results(spark, sf).withColumn("instance_id", F.col("stage_id").cast("string"))
    return C.awards(r, place="rank").select("result_id", "medal", "place", "state")


@query(R + """SELECT result_id, row_number() OVER (PARTITION BY stage_id, person_id ORDER BY eligibility <> 'eligible', CASE source WHEN 'api' THEN 4 ELSE 3 END DESC, result_id) AS claim FROM r""", whole="claim")
def c15_claims(spark, sf):
    r = results(spark, sf).select("stage_id", F.col("person_id").alias("unit"), F.lit("WIEN").alias("region"), F.when(F.col("eligibility") == "eligible", "confirmed").otherwise("draft").alias("instance_state"), F.when(F.col("source") == "api", "source_nat").otherwise("document").alias("evidence"), F.col("result_id").alias("mapping_id"), "result_id")
    return C.partitioned_claims(r).select("result_id", "claim")


# quality -----------------------------------------------------------------------------------------

_LISTS = """, li AS (SELECT list_id, any_value(event_id) AS event_id, any_value(stage_id) AS stage_id, min(category) AS category, count(*) AS n, any_value(source) AS source FROM r GROUP BY list_id)
, ls AS (SELECT *, CASE WHEN list_id % 4 = 0 THEN n WHEN list_id % 4 = 1 THEN n + 1 WHEN list_id % 4 = 2 THEN n - 1 END AS declared, 'time' AS ranking_basis FROM li)"""


def _lists(spark, sf):
    r = results(spark, sf)
    li = r.groupBy("list_id").agg(F.first("event_id").alias("event_id"), F.first("stage_id").alias("stage_id"), F.min("category").alias("category"), F.count("*").alias("source_units"), F.first("source").alias("source"))
    k = F.col("list_id") % 4
    return li.withColumn("declared", F.when(k == 0, F.col("source_units")).when(k == 1, F.col("source_units") + 1).when(k == 2, F.col("source_units") - 1)).withColumn("ranking_basis", F.lit("time")).withColumn("category_full", F.lit(None).cast("string"))


def _quality_rows(spark, sf):
    r = results(spark, sf)
    return r.select("result_id", "list_id", F.when(F.col("status") == "mp", "unknown").otherwise(F.col("status")).alias("status"), "rank", "time_s", "out_of_competition", "result_kind", F.lit("Anna").alias("name"), "person_id", F.col("status").alias("observed_status"), F.when(F.col("time_s") > 40, "114:08").when(F.col("time_s") > 30, "??").otherwise("").alias("observed_time"), F.lit(None).cast("string").alias("individual_status"), F.lit(None).cast("string").alias("note"), F.when(F.col("eligibility") == "eligible", "resolved").otherwise("candidate").alias("identity_state"), "championship")


_COUNTED = "NOT out_of_competition AND result_kind = 'individual'"
_ISSUES = R + _LISTS + f""", x AS (SELECT r.*, CASE WHEN status = 'mp' THEN 'unknown' ELSE status END AS st, CASE WHEN time_s > 40 THEN 'time' WHEN time_s > 30 THEN 'bad' ELSE 'none' END AS ov FROM r)
, p AS (SELECT list_id, count(*) FILTER ({_COUNTED}) AS timed, count(*) FILTER ({_COUNTED} AND rank IS NOT NULL) AS ranked, count(*) FILTER ({_COUNTED} AND st = 'ok') AS timed_ok FROM x GROUP BY ALL)
, q AS (SELECT * FROM ls JOIN p USING (list_id))
, e AS (SELECT x.list_id, rank, min(time_s) AS t FROM x WHERE st = 'ok' AND NOT out_of_competition AND result_kind NOT IN ('relay', 'team', 'family') AND source <> 'api' AND rank IS NOT NULL GROUP BY ALL)
, i AS (
 SELECT list_id, 'source_declared_omission' AS code, 'warning' AS severity FROM q WHERE declared > n
 UNION ALL SELECT list_id, 'entry_count_mismatch', 'blocker' FROM q WHERE declared < n
 UNION ALL SELECT list_id, 'missing_ranking', 'blocker' FROM q WHERE source <> 'api' AND timed >= 3 AND ranked = 0 AND category <> 'Familie'
 UNION ALL SELECT list_id, 'partial_ranking_coverage', 'warning' FROM q WHERE source <> 'api' AND timed_ok >= 3 AND ranked > 0 AND ranked < timed_ok
 UNION ALL SELECT list_id, 'provisional_championship_identity', 'warning' FROM x WHERE eligibility <> 'eligible' AND championship IS NOT NULL
 UNION ALL SELECT list_id, 'source_value_unreadable', 'warning' FROM x WHERE st = 'unknown' AND ov = 'bad'
 UNION ALL SELECT list_id, 'time_text_unparsed', 'blocker' FROM x WHERE st = 'unknown' AND ov = 'time'
 UNION ALL SELECT list_id, 'unknown_status', 'blocker' FROM x WHERE st = 'unknown' AND ov = 'none'
 UNION ALL SELECT DISTINCT list_id, 'rank_time_inversion', 'warning' FROM (SELECT list_id, t < max(t) OVER (PARTITION BY list_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turned FROM e) WHERE turned)
"""


@query(_ISSUES + "SELECT list_id, code, severity, count(*) AS n FROM i GROUP BY ALL")
def q1_findings(spark, sf):
    return Q.findings(_lists(spark, sf), _quality_rows(spark, sf)).groupBy("list_id", "code", "severity").agg(F.count("*").alias("n"))


def _catalog(spark):
    return spark.createDataFrame([("entry_count_mismatch", "parser", "lists"), ("source_declared_omission", "source", "lists"), ("unknown_status", "parser", "values")], "code string, owner string, domain string")


@query(_ISSUES + """, w AS (SELECT list_id, sum(CASE severity WHEN 'blocker' THEN 10000 WHEN 'warning' THEN 100 ELSE 1 END + CASE code WHEN 'entry_count_mismatch' THEN 50 WHEN 'unknown_status' THEN 50 WHEN 'source_declared_omission' THEN 2 ELSE 0 END)::BIGINT AS score, count(*) AS issues, count(*) FILTER (severity = 'blocker') AS blockers FROM i GROUP BY ALL)
SELECT list_id, score, issues, blockers, row_number() OVER (ORDER BY score DESC, list_id) AS place FROM w""")
def q4_report(spark, sf):
    li = _lists(spark, sf)
    return Q.report(Q.findings(li, _quality_rows(spark, sf)), li, _catalog(spark)).select("list_id", F.col("score").cast("long").alias("score"), "issues", "blockers", "place")


@query(R + """, b AS (SELECT document_id, count(*) AS n_rows, count(rank) AS ranked FROM r WHERE list_id % 3 <> 0 GROUP BY ALL), a AS (SELECT document_id, count(*) AS n_rows, count(rank) AS ranked FROM r WHERE list_id % 3 <> 1 GROUP BY ALL)
SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.n_rows, 0) - coalesce(b.n_rows, 0) AS d_n_rows, coalesce(a.ranked, 0) - coalesce(b.ranked, 0) AS d_ranked FROM b FULL JOIN a USING (document_id)""")
def q6_parser_diff(spark, sf):
    r = results(spark, sf)
    m = lambda k: A.document_metrics(r.filter(f"list_id % 3 <> {k}"), "document_id")
    return A.metrics_diff(m(0), m(1), "document_id").select("document_id", "d_n_rows", "d_ranked")


@query(R + """SELECT 'missing_provenance' AS "check", 0::BIGINT AS violations UNION ALL SELECT 'missing_identity_basis', 0 UNION ALL SELECT 'missing_list', count(*) FROM r WHERE list_id % 7 = 0 UNION ALL SELECT 'status_domain', 0
UNION ALL SELECT 'negative_time', count(*) FROM r WHERE time_s < 5 UNION ALL SELECT 'eligibility_domain', 0 UNION ALL SELECT 'family_with_person', count(*) FROM r WHERE result_kind = 'family'
UNION ALL SELECT 'personless_individual', 0 UNION ALL SELECT 'ooc_championship', count(*) FROM r WHERE out_of_competition AND championship IS NOT NULL""")
def v1_invariants(spark, sf):
    r = results(spark, sf).withColumn("source_document_id", F.col("document_id")).withColumn("identity_basis", F.lit("direct")).withColumn("time_behind_s", F.col("time_s") - 5).withColumn("team_time_s", F.lit(None).cast("int"))
    return Q.invariants({"result": r, "result_list": r.select("list_id").distinct().filter("list_id % 7 <> 0")})


@query(R + "SELECT list_id, sha256(string_agg('{\"person_id\":' || person_id::VARCHAR || ',\"status\":\"' || status || '\"}', chr(10) ORDER BY seq)) AS fingerprint FROM r GROUP BY ALL")
def h1_list_fingerprints(spark, sf):
    return Q.list_fingerprint(results(spark, sf), "list_id", "seq", ["person_id", "status"])


@query(R + _LISTS + """, a AS (SELECT list_id, CASE WHEN list_id % 2 = 0 THEN source ELSE 'old' END AS f FROM ls) SELECT count(*) FILTER (f = source) AS accepted, count(*) FILTER (f <> source) AS stale FROM a JOIN ls USING (list_id)""")
def q3_review_states(spark, sf):
    li = _lists(spark, sf).withColumn("fingerprint", F.col("source"))
    a = li.select("list_id", F.lit("ranking").alias("dimension"), F.lit("flagged").alias("state"), F.when(F.col("list_id") % 2 == 0, F.col("source")).otherwise("old").alias("input_fingerprint"), F.lit("2024-01-01").alias("reviewed_at"))
    none = spark.createDataFrame([], "list_id long, code string, severity string")
    ok, stale = Q.accepted_reviews(a, li), Q.stale_reviews(a, li, none)
    return ok.agg(F.count("*").alias("accepted")).crossJoin(stale.agg(F.count("*").alias("stale")))


# incremental and streams -------------------------------------------------------------------------


@query("SELECT o_custkey AS event_id, o_orderkey AS position FROM orders WHERE o_orderkey % 4 = 0")
def i1_delta_selection(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("position"))
    return sync.selected_jobs(o, o.filter("position % 4 = 0"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate >= DATE '2000-01-01'")
def i2_refresh_window(spark, sf):
    o = read(spark, sf, "orders").withColumn("fetched", F.when(F.col("o_orderstatus") != "P", F.lit(1)))
    return FI.needs_fetch(o, "fetched", "o_orderdate", "2000-01-01").select("o_orderkey")


@query(R + """, c AS (SELECT DISTINCT person_id, event_id FROM r) SELECT * FROM c WHERE NOT (event_id % 3 = 0)""")
def i6_undecided(spark, sf):
    c = results(spark, sf).select("person_id", "event_id").distinct()
    return sync.undecided(c, c.filter("event_id % 3 <> 2").withColumn("decision", F.when(F.col("event_id") % 3 == 1, "error").otherwise("true")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def x_tumbling_windows(spark, sf):
    return windows.tumbling(read(spark, sf, "events"), "1 hour").withColumn("value", F.round("value", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def x_session_windows(spark, sf):
    return windows.sessions(read(spark, sf, "events"), "30 minutes")


# parsers and views -------------------------------------------------------------------------------


@query()
def p1_html_classes(spark, sf):
    """Every list written as an HTML table, then parsed back to rows."""
    r = results(spark, sf)
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(c.cast("string"), F.lit("")))
    tr = F.concat(F.lit("<tr>"), cell(F.col("rank")), cell(F.concat(F.lit("Person "), F.col("person_id").cast("string"))), cell(F.col("club")), cell(N.format_time("time_s")))
    doc = r.withColumn("tr", tr).groupBy("list_id").agg(F.min("category").alias("c"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tr"))), lambda x: x["tr"]), "").alias("rows"))
    page = doc.select("list_id", F.concat(F.lit("<table><tr><td>"), "c", F.lit(" ("), F.col("n").cast("string"), F.lit(")</td></tr><tr><th>Pl<th>Name<th>Verein<th>Zeit</tr>"), "rows", F.lit("</table>")).alias("html"))
    return html.parsed(page, "html", "list_id", fields=("category", "declared", "row_pos", "rank", "name", "club", "time_text"))


SQL["p1_html_classes"] = R + """, c AS (SELECT list_id, min(category) AS category, count(*) AS n FROM r GROUP BY ALL)
SELECT list_id, c.category, n::INT AS declared, (seq - 1)::INT AS row_pos, rank, 'Person ' || person_id::VARCHAR AS name, club, (time_s // 60)::VARCHAR || ':' || lpad((time_s % 60)::VARCHAR, 2, '0') AS time_text FROM r JOIN c USING (list_id)"""


@query()
def p10_fixed_width(spark, sf):
    """Every list written as a fixed-width report, then parsed back."""
    r = results(spark, sf)
    line = F.concat(F.rpad(F.coalesce(F.col("rank").cast("string"), F.lit("")), 5, " "), F.rpad(F.concat(F.lit("Person "), F.col("person_id").cast("string")), 25, " "), F.rpad("club", 25, " "), F.lpad(N.format_time("time_s"), 8, " "))
    doc = r.withColumn("line", line).groupBy("list_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("rows"))
    head = F.concat(F.rpad(F.lit("Pl"), 5, " "), F.rpad(F.lit("Name"), 25, " "), F.rpad(F.lit("Verein"), 25, " "), F.lit("   Zeit\n"))
    page = doc.select("list_id", F.concat(F.lit("Klasse A ("), F.col("n").cast("string"), F.lit(")\n"), head, "rows").alias("html"))
    return html.parsed(page, "html", "list_id", layout.parse_text, fields=("row_pos", "rank", "name", "club", "time_text"))


SQL["p10_fixed_width"] = R + "SELECT list_id, (seq - 1)::INT AS row_pos, rank, 'Person ' || person_id::VARCHAR AS name, club, (time_s // 60)::VARCHAR || ':' || lpad((time_s % 60)::VARCHAR, 2, '0') AS time_text FROM r"


_STANDINGS = R + _TIE + """, b AS (SELECT stage_id, category, """ + _STATS + """ FROM r WHERE result_kind NOT IN ('relay', 'family') GROUP BY ALL)
, g AS (SELECT *, CASE WHEN good AND rank_filled IS NOT NULL AND time_s >= min(CASE WHEN good AND rank_filled = 1 THEN time_s END) OVER (PARTITION BY list_id) THEN time_s - min(CASE WHEN good AND rank_filled = 1 THEN time_s END) OVER (PARTITION BY list_id) END AS behind_s FROM tied)
SELECT g.list_id, g.result_id, g.stage_id, g.category, g.rank_filled AS place, g.time_s, g.behind_s, b.starters, b.classified, b.winner_time_s FROM g JOIN b USING (stage_id, category) WHERE g.rank_filled <= 3"""
_STANDINGS = _STANDINGS.replace(", g AS (SELECT *, CASE WHEN good AND rank_filled", ", gg AS (SELECT *, CASE WHEN good AND rank_filled").replace("SELECT g.list_id, g.result_id, g.stage_id, g.category, g.rank_filled AS place, g.time_s, g.behind_s", "SELECT gg.list_id, gg.result_id, gg.stage_id, gg.category, gg.rank_filled AS place, gg.time_s, gg.behind_s").replace("FROM g JOIN b USING (stage_id, category) WHERE g.rank_filled", "FROM gg JOIN b USING (stage_id, category) WHERE gg.rank_filled")


@query(_STANDINGS)
def standings(spark, sf):
    """Top three of every list: ties filled, gaps to the winner, statistics of the class."""
    r = results(spark, sf)
    tied = W.tie_filled(r, ["list_id"], "seq", is_classified=W.classified())
    gaps = W.time_behind(tied, ["list_id"], rank="rank_filled", counts=W.classified())
    stats = A.category_stats(r, ["stage_id", "category"])
    return gaps.filter("rank_filled <= 3").join(stats, ["stage_id", "category"]).select("list_id", "result_id", "stage_id", "category", F.col("rank_filled").alias("place"), "time_s", "behind_s", "starters", "classified", "winner_time_s")
