import random

import pytest
from pyspark.sql import functions as F

from ranklake.operators import championship as C
from ranklake.operators import evidence as EV
from ranklake.operators import identity as E
from ranklake.operators import joins as J
from ranklake.operators import quality as Q
from ranklake.operators import ranking as W
from ranklake.operators import units as U
from ranklake.sources import html, layout, readers
from ranklake.streaming import sync

ROWS = "list_id int, seq int, rank int, time_s int, status string"


def test_tie_fill_equals_the_loop(spark):
    r = random.Random(1)
    rows = [(li, s, r.choice([None, None, 1, 2, 3]), r.choice([100, 100, 120, None]), r.choice(["ok", "ok", "ok", "dnf"])) for li in range(200) for s in range(r.randrange(1, 9))]
    want = {}
    for li in range(200):
        run_time = last = None
        for _, s, rank, t, status in (x for x in rows if x[0] == li):
            if status != "ok" or t is None:
                run_time = last = None
                want[li, s] = rank
                continue
            if t != run_time:
                run_time, last = t, None
            if rank is not None:
                last = rank
            want[li, s] = rank if rank is not None else last
    got = W.tie_filled(spark.createDataFrame(rows, ROWS), ["list_id"], "seq", is_classified=F.col("status") == "ok").collect()
    assert {(x.list_id, x.seq): x.rank_filled for x in got} == want


def test_units_ahead_equals_counting(spark):
    r = random.Random(2)
    rows = [(c, f"u{r.randrange(6)}", r.choice([None, 1, 2, 3, 4]), r.random() < 0.8) for c in range(30) for _ in range(8)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, c int, unit string, rank int, good boolean")
    got = {x.i: x.national_rank for x in W.units_ahead_rank(df, ["c"], "unit", counts=F.col("good")).collect()}
    for i, (c, _, rank, good) in enumerate(rows):
        want = 1 + len({u for cc, u, k, g in rows if cc == c and g and k is not None and k < rank}) if good and rank is not None else None
        assert got[i] == want


def test_time_behind_needs_a_time_list(spark):
    df = spark.createDataFrame([(1, 1, 1, 100, "time"), (1, 2, 2, 130, "time"), (1, 3, None, 90, "time"), (2, 1, 1, 100, "score"), (2, 2, 2, 130, "score")], "list_id int, seq int, rank int, time_s int, basis string")
    got = {(r.list_id, r.seq): r.behind_s for r in W.time_behind(df, ["list_id"], basis="basis").collect()}
    assert got == {(1, 1): 0, (1, 2): 30, (1, 3): None, (2, 1): None, (2, 2): None}


def test_chains_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 4)], "old_id long, new_id long")
    assert {(r.old_id, r.new_id) for r in J.resolved_chains(e).collect()} == {(1, 4), (2, 4), (3, 4), (9, 4)}
    for cycle in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            J.resolved_chains(spark.createDataFrame(cycle, "old_id long, new_id long"))


def walked(rows):
    """Every row in order, with all that is known of its name: what `resolved` must equal."""
    known, out = {}, {}
    for seq, name, year, user, registry, basis in sorted(rows):
        by_year, registered, years = known.setdefault(name, ({}, [], {}))
        fits = [c for c, y in years.items() if y is None or year is None or y == year]
        if user is not None or registry is not None:
            p = user if user is not None else registry
        elif year is not None and year in by_year:
            p = by_year[year]
        else:
            p = registered[0] if registered else fits[0] if fits else ("new", name, year)
        if not isinstance(p, tuple) and p not in registered:
            registered.append(p)
        if year is not None:
            by_year.setdefault(year, p)
        if years.get(p) is None:
            years[p] = year
        out[seq] = p
    return out


def test_identities_equal_a_walk_through_all_rows(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a b", "c d", "e f", ""]), r.choice([None, None, 1990, 1991, 1992]), r.choice([None] * 8 + [5, 6]), r.choice([None] * 5 + [7, 8]), "registry_year") for i in range(400)]
    rows = [(*x[:5], x[5] if x[4] is not None else None) for x in rows if x[1] != "c d" or x[3] is None and x[4] is None]
    df = spark.createDataFrame(rows, "seq int, name_key string, birth_year int, user_id long, registry_id long, basis string")
    want = walked(rows)
    for seq in ("seq", "struct(seq, 'x' AS path)"):  # builds order by a struct
        got = {x.i: x.person_id for x in E.resolved(df.selectExpr("seq AS i", f"{seq} AS seq", "name_key", "birth_year", "user_id", "registry_id", "basis")).collect()}
        assert set(got) == set(want)
        fresh = {}
        for i, p in want.items():
            assert got[i] == p or isinstance(p, tuple) and got[i] < 0 and fresh.setdefault(p, got[i]) == got[i]


def test_identities(spark):
    rows = [("anna berg", 1990, 1, 77, None, None), ("anna berg", None, 2, None, None, None), ("eva x", 1980, 3, None, None, None), ("eva x", 1981, 4, None, None, None), ("eva x", None, 5, None, None, None), ("ida y", 2000, 6, None, 5, "registry_year")]
    df = spark.createDataFrame(rows, "name_key string, birth_year int, seq int, user_id long, registry_id long, basis string")
    got = {r.seq: r for r in E.resolved(df).collect()}
    assert got[1].person_id == got[2].person_id == 77 and got[1].identity_state == "resolved" and got[2].identity_confidence == 0.55
    assert got[3].person_id != got[4].person_id and got[5].person_id == got[3].person_id < 0
    assert got[6].person_id == 5 and got[6].identity_confidence == 0.99


def test_canonical_clubs(spark):
    official = spark.createDataFrame([("Naturfreunde Wien",), ("LZ OMAHA",), ("OC Ost",), ("HSV OL Wiener Neustadt",)], "name string")
    names = ["Naturfreunde Wien 2", "lz omaha", "NF Wien 1", "NWN Naturfreunde Wien", "HSV OL Wiener Neus", "OC Ost*", "Unknown", None]
    got = {r.club: r.official_club for r in EV.canonical_clubs(spark.createDataFrame([(n,) for n in names], "club string"), official).collect()}
    assert got == {"Naturfreunde Wien 2": "Naturfreunde Wien", "lz omaha": "LZ OMAHA", "NF Wien 1": "Naturfreunde Wien", "NWN Naturfreunde Wien": "Naturfreunde Wien", "HSV OL Wiener Neus": "HSV OL Wiener Neustadt", "OC Ost*": "OC Ost", "Unknown": None, None: None}


def test_pairs(spark):
    df = spark.createDataFrame([("Anna / Eva Huber",), ("Ida Berg + Ute Tal",), ("Anna Berg Eva Tal",), ("Solo Person",)], "name string")
    got = sorted((r.name, r.partner_note) for r in U.expanded_pairs(df).collect())
    assert got == sorted([("Anna Huber", "Partner: Eva Huber"), ("Eva Huber", "Partner: Anna Huber"), ("Ida Berg", "Partner: Ute Tal"), ("Ute Tal", "Partner: Ida Berg"), ("Anna Berg", "Partner: Eva Tal"), ("Eva Tal", "Partner: Anna Berg"), ("Solo Person", None)])


def test_fingerprints_ignore_row_order(spark):
    rows = [(1, "a"), (2, "b"), (2, "b")]
    one = lambda r: Q.fingerprint(spark.createDataFrame(r, "i int, s string")).first()[0]
    assert one(rows) == one(rows[::-1]) != one(rows[:2])


def test_regression_gate():
    assert Q.regression({"result": 95, "ledger": 3}, {"result": 100, "ledger": 3}) == ["result fell from 100 to 95"]
    assert Q.regression({"result": 99, "ledger": 2, "conflicts": 1}, {"result": 100, "ledger": 3, "conflicts": 0}) == ["ledger shrank from 3 to 2", "conflicts grew from 0 to 1"]


def test_title_fallback(spark):
    r = spark.createDataFrame([(1, "D21E", None, "ok", "individual"), (1, "H-14", None, "ok", "individual"), (2, "H-14", None, "ok", "individual"), (3, "H-14", None, "ok", "individual"), (1, "H-16", "ÖM", "ok", "individual"), (1, "H-16", None, "ok", "individual")], "stage_id int, category string, championship string, status string, result_kind string")
    s = spark.createDataFrame([(1, 10, "ÖSTM/ÖM Lang"), (2, 10, "Austria Cup"), (3, 11, None)], "stage_id int, event_id int, stage_title string")
    e = spark.createDataFrame([(10, "Weekend", "weekend"), (11, "ÖM Sprint", "om-sprint")], "event_id int, title string, slug string")
    got = sorted((x.stage_id, x.category, x.championship or "") for x in C.title_fallback(r, s, e).collect())
    assert got == [(1, "D21E", "ÖSTM"), (1, "H-14", "ÖM"), (1, "H-16", ""), (1, "H-16", "ÖM"), (2, "H-14", ""), (3, "H-14", "ÖM")]


def test_html_documents():
    individual = "<table><tr><td>H 21 (3)<tr><th>Pl<th>Name<th>Verein<th>Zeit<tr><td>1<td>Anna B<td>NF<td>26:21<tr><td>AK<td>Eva C<td>OL<td>27:00<tr><td><td>Ida D<td>OL<td>Fehlst</table>"
    c = html.parse_document(individual)
    assert [(r["name"], r["rank"], r["time_text"]) for r in c[0]["results"]] == [("Anna B", 1, "26:21"), ("Eva C", None, "27:00"), ("Ida D", None, "Fehlst")]
    assert (c[0]["name"], c[0]["declared"]) == ("H 21", 3)
    relay = "<table><tr><td>Staffel (1)<tr><th>Pl<th>Stnr<th>Staffel<th>Name<th>Zeit<tr><td>1<td>7<td>NF 1<td><td>53:04<tr><td><td><td><td>Anna B<td>26:00<tr><td><td><td><td>Eva C<td>27:04</table>"
    c = html.parse_document(relay)
    assert [(r["name"], r["kind"], r["team"], r["leg"], r["rank"]) for r in c[0]["results"]] == [("Anna B", "relay", "NF 1", 1, 1), ("Eva C", "relay", "NF 1", 2, 1)]
    placed = "".join(f'<div style="position:absolute; top:{t}px; left:{x}px">{s}</div>' for t, x, s in [(10, 5, "D 21 (1)"), (30, 5, "Pl"), (30, 50, "Name"), (31, 150, "Verein"), (30, 250, "Zeit"), (50, 5, "1"), (50, 50, "Anna B"), (49, 150, "NF"), (50, 250, "26:21")])
    assert layout.dispatched(placed)[0]["results"][0]["time_text"] == "26:21"


def test_text_and_words():
    text = "H 21 (2)\nPl   Name                Verein        Zeit\n1    Anna Berg           NF Wien      26:21\n     Eva Tal             OL Ost     1:02:33\n"
    c = layout.parse_text(text)
    assert [(r["name"], r["club"], r["time_text"]) for r in c[0]["results"]] == [("Anna Berg", "NF Wien", "26:21"), ("Eva Tal", "OL Ost", "1:02:33")]
    words = [(10, 10, "H"), (20, 10, "21"), (40, 10.5, "(1)"), (10, 30, "Pl"), (60, 30, "Name"), (200, 30, "Verein"), (300, 30, "Zeit"), (10, 50, "1"), (60, 50.4, "Anna"), (95, 49.8, "Berg"), (205, 50, "NF"), (305, 50, "26:21")]
    r = layout.parse_words(words)[0]["results"][0]
    assert (r["rank"], r["name"], r["club"], r["time_text"]) == (1, "Anna Berg", "NF", "26:21")
    assert layout.dispatched("<pre>" + text + "</pre>")[0]["name"] == "H 21"


def test_documents_are_read(spark, tmp_path):
    import json

    doc = {"eventId": 7, "source": "html", "fileName": "erg.html", "listType": "race", "categories": [{"name": "H 21", "declaredStarters": 2, "results": [{"name": "1 Anna Berg", "club": "empty NF", "timeText": "26:21", "status": "ok", "rank": 1}, {"name": "Eva", "club": "OL", "timeText": "Aufg.", "status": "dnf"}]}]}
    two = {"eventId": 8, "source": "html", "fileName": "x.html", "stageDocuments": [{"stageNumber": n, "stageDate": f"2024-05-0{n}", "stageTitle": "t", "categories": doc["categories"]} for n in (1, 2)]}
    (tmp_path / "7-0.json").write_text(json.dumps(doc))
    (tmp_path / "8-0.json").write_text(json.dumps(two))
    (tmp_path / "notes.json").write_text("{}")
    rows = readers.document_rows(readers.documents(spark, str(tmp_path))).orderBy("event_id", "stageNumber", "row_pos").collect()
    assert [(r.event_id, r.stageNumber, r.name, r.club, r.status, r.time_s) for r in rows][:2] == [(7, None, "Anna Berg", "NF", "ok", 1581), (7, None, "Eva", "OL", "dnf", None)]
    assert len(rows) == 6


def test_ledger_only_grows(spark, tmp_path):
    led = sync.Ledger(spark, f"file://{tmp_path}/ledger")
    a = spark.createDataFrame([(1, 1, "true"), (2, 1, "error")], "person_id long, event_id long, decision string")
    assert led.write(a) == 1 and led.write(a) == 1
    assert led.write(a.union(spark.createDataFrame([(3, 1, "true")], a.schema))) == 2
    with pytest.raises(ValueError, match="shrink"):
        led.write(a)
    assert led.restore(1) == 3 and led.read().count() == 2
    assert sync.undecided(a.select("person_id", "event_id"), led.read()).collect()[0].person_id == 2


def test_stream_follows_files_once(spark, tmp_path):
    src = f"{tmp_path}/in"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    for _ in range(2):
        sync.follow(stream, lambda b: b, f"{tmp_path}/out", ["id"], f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_flow_rows():
    clubs = layout.Clubs({"NF Wien", "OL Ost Graz"})
    assert layout.flow_row("1. Anna Berg NF Wien 26:21", clubs) == {"rank": 1, "ooc": False, "name": "Anna Berg", "club": "NF Wien", "time_text": "26:21"}
    assert layout.flow_row("Eva Tal OL Ost Graz Aufg.", clubs)["club"] == "OL Ost Graz"
    assert layout.flow_row("nothing here", clubs) is None


def test_title_words(spark):
    from ranklake.operators.stages import discipline, round_number

    df = spark.createDataFrame([("Sprint Ost",), ("Sprint und Mittel",), ("3. Lauf",), ("erg-e2.html",)], "t string")
    assert [tuple(r) for r in df.select(discipline(F.col("t")), round_number(F.col("t"))).collect()] == [("sprint", None), (None, None), (None, 3), (None, 2)]


def test_pending_candidates_equal_brute_force(spark):
    r = random.Random(4)
    words = ["anna", "berg", "eva", "tal", "hot"]
    name = lambda: " ".join(["hot", *r.sample(words, r.randrange(0, 4))])
    rows = [(i, name()) for i in range(120)] + [(0, "anna tal"), (500, None), (501, "nobody"), (502, "")]
    registry = [(p, name()) for p in range(60)] + [(3, "eva berg"), (700, None), (701, "")]
    got = E.pending_candidates(spark.createDataFrame(rows, "seq int, name_key string"), spark.createDataFrame(registry, "person_id int, name_key string")).collect()
    want = {}
    for s, a in rows:
        for p, b in registry:
            if a is not None and b is not None and (n := len(set(a.split(" ")) & set(b.split(" ")))):
                want[s, p] = want.get((s, p), 0) + n
    best = []
    for s in {s for s, _ in want}:
        own = sorted((-n, p) for (t, p), n in want.items() if t == s)[:4]
        best += [(s, p, -n, i + 1) for i, (n, p) in enumerate(own)]
    assert sorted((x.seq, x.person_id, x.shared, x.choice) for x in got) == sorted(best)


def test_pending_candidates_of_every_order(spark):
    import os

    from ranklake.plans import more_queries  # noqa: F401  it registers itself
    from ranklake.plans.queries import QUERIES

    if not os.path.isdir(sf := "/root/testdata/sf0.001"):
        pytest.skip("no tables")
    orders = spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderpriority IN ('1-URGENT', '5-LOW') OR o_orderstatus IN ('F', 'O')")
    got = QUERIES["e9_pending_candidates_all"](spark, sf)
    assert got.select("seq").distinct().count() == orders.count()
