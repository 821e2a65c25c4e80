"""Profiles, default stages, gates, regional views, atomic files and API documents, over whole benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import identity as E
from ..operators import quality as Q
from ..operators import regional as RG
from ..operators.lineage import new_folder
from ..operators.stages import with_default_stages
from ..sources import writers
from ..streaming import sync
from . import views as V
from .queries import SQL, query
from .tables import R, read, results
from .view_queries import _tables

# identities ----------------------------------------------------------------------------------------

_PROFILES = """WITH p AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN -c_custkey ELSE c_custkey END AS id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Berg' END AS last, CASE c_custkey % 4 WHEN 0 THEN 1900 WHEN 1 THEN NULL ELSE 1950 + c_custkey % 50 END::INT AS yob, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'AUT' END AS nat, c_custkey FROM customer)
, x AS (SELECT id AS person_id, 'Anna Berg' AS name, 'anna berg' AS name_key, CASE WHEN yob <> 1900 THEN yob END AS birth_year, nullif(nat, '') AS nationality FROM p WHERE id > 0 AND last <> '')"""


def _profiles(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    last = F.when(k % 7 == 0, "").otherwise("Berg")
    year = F.when(k % 4 == 0, 1900).when(k % 4 != 1, 1950 + k % 50).cast("int")
    p = read(spark, sf, "customer").select(
        F.when(k % 11 == 0, "x").when(k % 13 == 0, (-k).cast("string")).otherwise(k.cast("string")).alias("person_id"), F.when(k % 7 == 0, "7").otherwise(" Anna").alias("first_name"), last.alias("last_name"), year.alias("birth_year"), F.when(k % 2 == 0, "").otherwise("AUT").alias("nationality")
    )
    return E.profile_index(p)


@query(_PROFILES + " SELECT * FROM x")
def e1_profile_index(spark, sf):
    """Profiles of customers, of which some have no id, a negative one, no name or a placeholder for a year."""
    return _profiles(spark, sf).select("person_id", "name", "name_key", "birth_year", "nationality")


@query(_PROFILES + """, o AS (SELECT o_orderkey AS seq, o_custkey AS id, 'Name ' || o_orderstatus AS name, CASE WHEN o_orderkey % 3 = 0 THEN 1960 + o_orderkey % 9 END AS yob FROM orders)
, s AS (SELECT id, arg_min(name, seq) AS name, arg_min(yob, seq) FILTER (yob IS NOT NULL) AS yob FROM o GROUP BY id)
SELECT id AS person_id, coalesce(x.name, s.name) AS name, coalesce(x.birth_year, yob)::INT AS birth_year, x.nationality FROM s LEFT JOIN x ON x.person_id = id WHERE id > 0""")
def e4_direct_ids(spark, sf):
    """Ids that orders name: the profile's values count, and rows fill what it lacks."""
    k = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(k.alias("seq"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("Name "), "o_orderstatus").alias("name"), F.when(k % 3 == 0, 1960 + k % 9).cast("int").alias("birth_year"), F.lit(None).cast("string").alias("nationality"))
    return E.directly_known(rows, _profiles(spark, sf))


_MINTED = "-((('0x' || substr(sha256('person-v1' || chr(0) || k || chr(0) || coalesce(y::VARCHAR, '') || chr(0) || '0'), 1, 16))::UHUGEINT % 4611686018427387904)::BIGINT + 1)"


@query(f"""WITH o AS (SELECT o_orderkey AS seq, 'name ' || o_custkey::VARCHAR AS k, CASE WHEN o_custkey % 3 <> 0 THEN 1950 + o_custkey % 40 END AS y, 'Club ' || (o_custkey % 5)::VARCHAR AS club, o_custkey AS c FROM orders)
, g AS (SELECT c_custkey AS id, 'name ' || c_custkey::VARCHAR AS k, CASE WHEN c_custkey % 2 = 0 THEN 1950 + c_custkey % 40 END AS y, 'Club ' || (c_custkey % 10)::VARCHAR AS club FROM customer WHERE c_custkey % 4 <> 0)
SELECT o.seq, CASE WHEN a.id IS NOT NULL THEN a.id WHEN b.id IS NOT NULL THEN b.id ELSE {_MINTED.replace('|| k ||', '|| o.k ||').replace('(y::', '(o.y::')} END AS person_id, CASE WHEN a.id IS NOT NULL OR b.id IS NOT NULL THEN 'resolved' ELSE 'candidate' END AS identity_state,
  CASE WHEN a.id IS NOT NULL THEN 0.99 WHEN b.id IS NOT NULL THEN 0.95 WHEN o.y IS NOT NULL THEN 0.75 ELSE 0.55 END::DOUBLE AS identity_confidence
FROM o LEFT JOIN g a ON a.k = o.k AND a.y = o.y LEFT JOIN g b ON a.id IS NULL AND b.k = o.k AND b.club = o.club""")
def e5_legacy_ids(spark, sf):
    """Rows without ids: the only profile of a name and year, else of a name and club, else a person of their own."""
    k, c = F.col("o_custkey"), F.col("c_custkey")
    named = lambda x: F.concat(F.lit("name "), x.cast("string")).alias("name_key")
    club = lambda x, n: F.concat(F.lit("Club "), (x % n).cast("string")).alias("club")
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), named(k), F.when(k % 3 != 0, 1950 + k % 40).cast("int").alias("birth_year"), club(k, 5), F.lit(None).cast("long").alias("user_id"))
    registry = read(spark, sf, "customer").filter("c_custkey % 4 <> 0").select(c.alias("person_id"), named(c), F.when(c % 2 == 0, 1950 + c % 40).cast("int").alias("birth_year"), club(c, 10))
    return E.resolved(E.registry_match(rows, registry)).select("seq", "person_id", "identity_state", "identity_confidence")


#: The walk through a name's rows in order, as a recursion that carries what is known of the name.
SQL["e3_resolved_identities"] = f"""WITH RECURSIVE o AS (SELECT o_custkey::VARCHAR AS k, CASE WHEN o_orderkey % 3 <> 0 THEN (1950 + o_orderkey % 4)::INT END AS y, o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey END AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
, w AS (SELECT k, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BIGINT AS p, false AS direct, false AS dated, NULL::BIGINT AS reg, []::STRUCT(y INT, p BIGINT)[] AS years, []::STRUCT(p BIGINT, y INT)[] AS people FROM (SELECT DISTINCT k FROM o)
UNION ALL
SELECT k, n, seq, p, u IS NOT NULL, y IS NOT NULL, coalesce(reg, CASE WHEN p > 0 THEN p END),
  CASE WHEN y IS NULL OR len(list_filter(years, lambda x: x.y = y)) > 0 THEN years ELSE list_append(years, {{'y': y, 'p': p}}) END,
  CASE WHEN len(list_filter(people, lambda c: c.p = p)) = 0 THEN list_append(people, {{'p': p, 'y': y}}) ELSE list_transform(people, lambda c: CASE WHEN c.p = p AND c.y IS NULL THEN {{'p': c.p, 'y': y}} ELSE c END) END
FROM (SELECT o.k, o.n, o.seq, o.y, o.u, w.reg, w.years, w.people,
  coalesce(o.u, list_extract(list_filter(w.years, lambda x: x.y = o.y), 1).p, w.reg, list_extract(list_filter(w.people, lambda c: c.y IS NULL OR o.y IS NULL OR c.y = o.y), 1).p, {_MINTED.replace('|| k ||', '|| o.k ||').replace('(y::', '(o.y::')}) AS p
  FROM w JOIN o ON o.k = w.k AND o.n = w.n + 1))
SELECT seq, p AS person_id, CASE WHEN direct THEN 'resolved' ELSE 'candidate' END AS identity_state, CASE WHEN direct THEN 1.0 WHEN dated THEN 0.75 ELSE 0.55 END::DOUBLE AS identity_confidence FROM w WHERE n > 0"""


@query("""WITH p AS (SELECT lower(trim(CASE c_custkey % 3 WHEN 0 THEN ' Anna' WHEN 1 THEN c_mktsegment ELSE 'Jana' END)) AS f, lower(CASE c_custkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'Novakova' ELSE 'Berg' || (c_custkey % 9)::VARCHAR END) AS l FROM customer)
SELECT DISTINCT f AS name FROM p WHERE f NOT IN (SELECT l FROM p)""")
def t43_first_names(spark, sf):
    """First names that are nobody's last name."""
    k = F.col("c_custkey")
    first = F.when(k % 3 == 0, " Anna").when(k % 3 == 1, F.col("c_mktsegment")).otherwise("Jana")
    last = F.when(k % 5 == 0, "BUILDING").when(k % 5 == 1, "Novakova").otherwise(F.concat(F.lit("Berg"), (k % 9).cast("string")))
    return E.first_names(read(spark, sf, "customer").select(first.alias("first"), last.alias("last")), "first", "last")


@query("""WITH e AS (SELECT o_custkey AS event_id, min(o_orderdate)::DATE::VARCHAR AS d FROM orders GROUP BY ALL), s AS (SELECT o_orderkey AS stage_id, o_custkey AS event_id, 2 AS number FROM orders WHERE o_custkey % 3 = 0)
SELECT stage_id, event_id, number, NULL::VARCHAR AS date FROM s UNION ALL SELECT event_id + 10000000, event_id, 1, CASE WHEN event_id % 5 <> 0 THEN d END FROM e WHERE event_id NOT IN (SELECT event_id FROM s)""")
def c18_default_stages(spark, sf):
    o = read(spark, sf, "orders")
    e = o.groupBy(F.col("o_custkey").alias("event_id")).agg(F.min("o_orderdate").cast("string").alias("d")).select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("d")).otherwise("").alias("date_from"), F.lit("Wien").alias("location"))
    s = o.filter("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("stage_id"), F.col("o_custkey").alias("event_id"), F.lit(2).alias("number"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("date"), F.lit("Graz").alias("location"))
    return with_default_stages(e.union(e), s).select("stage_id", "event_id", "number", "date")


# gates, steps, freshness ---------------------------------------------------------------------------


@query("""WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM orders WHERE o_orderkey % 100 <> 0) AS o1, (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0) AS o5, (SELECT count(*) FROM customer) AS c)
SELECT 'result fell from ' || o::VARCHAR || ' to ' || o5::VARCHAR AS finding FROM n WHERE o5 < o * 0.98 UNION ALL SELECT 'person fell from ' || o::VARCHAR || ' to ' || o1::VARCHAR FROM n WHERE o1 < o * 0.98 UNION ALL SELECT 'ledger shrank from ' || c::VARCHAR || ' to ' || (c - 1)::VARCHAR FROM n UNION ALL SELECT 'conflicts grew from ' || c::VARCHAR || ' to ' || (c + 1)::VARCHAR FROM n""")
def v2_regression_gate(spark, sf):
    """A build that lost a fifth of its results, a decision, and won a conflict; a hundredth fewer people pass."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer").count()
    n = o.agg(F.count("*").alias("all"), F.count_if(F.col("o_orderkey") % 5 != 0).alias("fifth"), F.count_if(F.col("o_orderkey") % 100 != 0).alias("hundredth")).first()
    found = Q.regression({"result": n["fifth"], "person": n["hundredth"], "ledger": c - 1, "conflicts": c + 1}, {"result": n["all"], "person": n["all"], "ledger": c, "conflicts": c})
    return spark.createDataFrame([(f,) for f in found], "finding string")


@query("SELECT 'lists' AS step, count(DISTINCT l_orderkey) AS rows FROM lineitem UNION ALL SELECT 'places', count(*) FROM (SELECT DISTINCT l_orderkey % 100 FROM lineitem)")
def i3_orchestrated(spark, sf):
    """Two steps, the second reading what the first has written."""
    target = new_folder(spark, "steps")
    steps = [("lists", lambda s: read(s, sf, "lineitem").select("l_orderkey").distinct()), ("places", lambda s: s.read.parquet(f"{target}/lists").select((F.col("l_orderkey") % 100).alias("p")).distinct())]
    return spark.createDataFrame(list(sync.orchestrated(spark, steps, target).items()), "step string, rows long")


@query("SELECT user_id, coalesce(TIMESTAMP '2024-01-15 12:00:00' - max(ts) FILTER (event_type <> 'error') < INTERVAL 240 HOURS, false) AS fresh FROM events GROUP BY ALL")
def i7_fresh_snapshots(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("at"))
    return sync.with_freshness(e, "at", "2024-01-15 12:00:00", 240).select("user_id", "fresh")


# files ---------------------------------------------------------------------------------------------


@query("SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def snk3_atomic_json(spark, sf):
    """Counts by nation in a JSON file that is written twice; the second one stands."""
    path = f"{new_folder(spark, 'counts')}/counts.json"
    n = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"))
    writers.json_file(spark, path, [])
    writers.json_file(spark, path, [r.asDict() for r in n.collect()])  # a row a nation
    return spark.read.schema("name string, n long").option("multiLine", True).json(path)


@query("SELECT 'api-results:' || c_custkey::VARCHAR AS source_document_id, c_custkey AS event_id, 'https://api.example/' || c_custkey::VARCHAR AS source_url, c_custkey::VARCHAR || '.json' AS file_name, sha256(c_mktsegment) AS snapshot_sha256 FROM customer WHERE c_custkey % 4 <> 0")
def snk6_api_documents(spark, sf):
    k = F.col("c_custkey")
    c = read(spark, sf, "customer")
    events = c.select(k.alias("event_id"), F.concat(F.lit("https://api.example/"), k.cast("string")).alias("url"))
    files = c.filter(k % 4 != 0).select(F.concat(F.lit("raw/results/"), k.cast("string"), F.lit(".json")).alias("path"), F.encode("c_mktsegment", "UTF-8").alias("content"))
    notes = c.select(F.lit("raw/results/notes.txt").alias("path"), F.encode("c_name", "UTF-8").alias("content"))
    return writers.registered_api(events.union(events), files.union(notes), "api-1").select("source_document_id", "event_id", "source_url", "file_name", "snapshot_sha256")


# regional views ------------------------------------------------------------------------------------

_REGIONS = ("WIEN", "NOE", "STMK", "TIR")
_ENTERED = R + """, u AS (SELECT *, list_extract(['WIEN', 'NOE', 'STMK', 'TIR'], (person_id % 4)::INT + 1) AS region, CASE WHEN result_kind IN ('relay', 'team') AND team_number IS NOT NULL THEN 'n:' || team_number ELSE 'r:' || result_id::VARCHAR END AS unit FROM r)
, e AS (SELECT list_id || region || unit AS entry_id, list_id, stage_id, region, min(time_s) AS t, CASE WHEN bool_or(eligibility = 'ineligible') THEN 'ineligible' ELSE 'eligible' END AS eligibility_state, list(result_id) AS ids FROM u GROUP BY list_id, stage_id, region, unit)
, n AS (SELECT *, CASE WHEN eligibility_state = 'eligible' THEN rank() OVER (PARTITION BY list_id, region, eligibility_state ORDER BY t) END AS regional_rank FROM e)
, w AS (SELECT DISTINCT entry_id, region, stage_id, regional_rank AS rank, person_id, CASE WHEN club <> 'Club 0' THEN club END AS official_club, result_kind, category FROM (SELECT *, unnest(ids) AS result_id FROM n WHERE eligibility_state = 'eligible' AND regional_rank <= 3) JOIN (SELECT result_id, person_id, club, result_kind, category FROM r) USING (result_id))"""


def _entered(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    r, event, stage, person = _tables(spark, sf)
    team = F.col("result_kind").isin("relay", "team") & F.col("team_number").isNotNull()
    unit = F.when(team, F.concat(F.lit("n:"), "team_number")).otherwise(F.concat(F.lit("r:"), F.col("result_id").cast("string")))
    u = r.withColumn("region", F.element_at(F.array(*map(F.lit, _REGIONS)), (F.col("person_id") % 4 + 1).cast("int"))).withColumn("unit", unit)
    state = F.when(F.bool_or(F.col("eligibility") == "ineligible"), "ineligible").otherwise("eligible")
    e = u.groupBy("list_id", "stage_id", "region", "unit").agg(F.min("time_s").alias("t"), state.alias("eligibility_state"), F.collect_list("result_id").alias("result_ids"))
    place = F.rank().over(Window.partitionBy("list_id", "region", "eligibility_state").orderBy("t"))
    e = e.withColumn("regional_rank", F.when(F.col("eligibility_state") == "eligible", place)).withColumn("instance_id", F.concat(F.col("list_id").cast("string"), "region"))
    return e.withColumn("entry_id", F.concat("instance_id", "unit")), r, stage, event, person


@query(_ENTERED + "SELECT entry_id, region, stage_id, rank, person_id, official_club, result_kind, category FROM w", whole="rank")
def s6_regional_podiums(spark, sf):
    entered, r, _, _, _ = _entered(spark, sf)
    return RG.podiums(entered, r).select("entry_id", "region", "stage_id", "rank", "person_id", "official_club", "result_kind", "category")


_COUNTS = "count(*) FILTER (rank = 1) AS gold, count(*) FILTER (rank = 2) AS silver, count(*) FILTER (rank = 3) AS bronze"


@query(_ENTERED + f", x AS (SELECT DISTINCT entry_id, official_club, rank FROM w WHERE official_club IS NOT NULL AND region = 'WIEN'), m AS (SELECT official_club, {_COUNTS} FROM x GROUP BY ALL) SELECT *, rank() OVER (ORDER BY gold DESC, silver DESC, bronze DESC) AS place FROM m", whole="place")
def r7_regional_clubs(spark, sf):
    entered, r, stage, event, _ = _entered(spark, sf)
    return V.regional_club_medals(V.regional_podiums(entered, r, stage, event, "WIEN")).select("official_club", "gold", "silver", "bronze", "place")


@query(_ENTERED + f", x AS (SELECT DISTINCT entry_id, person_id, rank FROM w WHERE region = 'NOE'), m AS (SELECT person_id, {_COUNTS} FROM x GROUP BY ALL) SELECT *, rank() OVER (ORDER BY gold DESC, silver DESC, bronze DESC) AS place FROM m", whole="place")
def r5_regional_runners(spark, sf):
    entered, r, stage, event, person = _entered(spark, sf)
    return V.regional_runner_medals(V.regional_podiums(entered, r, stage, event, "NOE"), person).select("person_id", "gold", "silver", "bronze", "place")


@query(_ENTERED + "SELECT region, stage_id, count(*) AS entries, count(*) FILTER (eligibility_state = 'eligible') AS eligible, count(*) FILTER (regional_rank = 1) AS champions FROM n GROUP BY ALL")
def r1_regional_stages(spark, sf):
    return V.regional_stages(_entered(spark, sf)[0])


@query(_ENTERED + "SELECT entry_id, regional_rank, result_id, r.category FROM (SELECT entry_id, regional_rank, unnest(ids) AS result_id FROM n WHERE stage_id = 3 AND region = 'TIR') JOIN r USING (result_id)", whole="regional_rank")
def r2_regional_event(spark, sf):
    """One stage and one region, as asked."""
    entered, r, _, _, _ = _entered(spark, sf)
    return V.regional_event(entered, r, 3, "TIR").select("entry_id", "regional_rank", "result_id", "category")
