"""Crossed ids by evidence, clubs by index, digests in order, versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ranklake.operators import evidence, history

PEOPLE = "id long, name_key string, club string"


def crossed(spark, rows, members=(), profiles=(), aliases=()):
    def table(data, name):
        return spark.createDataFrame(list(data), PEOPLE).withColumnRenamed("id", name)

    r = spark.createDataFrame(rows, "row_id long, user_id long, name_key string, club string, result_kind string")
    a = spark.createDataFrame(list(aliases), "name_key string, member_id long")
    got = evidence.crossed_ids(r, table(members, "member_id"), table(profiles, "person_id"), a)
    return {x.row_id: (x.target_id, x.basis, x.confidence, x.proof) for x in got.collect()}


def test_a_member_of_the_observed_name(spark):
    rows = [(1, 20, "berg anna", "NF", "individual"), (2, 20, "tal eva", "NF", "individual"), (3, 20, "berg anna", "NF", "family"), (4, None, "berg anna", "NF", "individual"), (5, 99, "berg anna", "NF", "individual")]
    assert crossed(spark, rows, members=[(10, "berg anna", "NF"), (20, "tal eva", "OL")]) == {1: (10, "book_of_record", 1.0, "other name")}


def test_a_shared_word_needs_a_second_proof(spark):
    members = [(10, "berg anna", "NF"), (20, "berg eva", "OL"), (30, "see ida", "OL")]
    rows = [(1, 20, "berg anna", "OL", "individual"), (2, 20, "berg anna", "NF", "individual"), (3, 20, "berg ida", "XX", "individual"), (4, 20, "berg ute", None, "individual")]
    got = crossed(spark, rows, members, aliases=[("berg ida", 30), ("berg ute", 77)])
    assert got == {2: (10, "book_of_record", 1.0, "club"), 3: (30, "book_of_record", 1.0, "alias")}


def test_the_registry_and_the_fallback(spark):
    profiles = [(50, "see ida", "OL"), (51, "see ida", "NF"), (52, "see ida", "NF"), (20, "see ute", "OL")]
    rows = [(1, 20, "see ida", "OL", "individual"), (2, 20, "see ida", "NF", "individual"), (3, 20, "moos pia", "NF", "individual"), (4, 20, "moos pia", "NF", "relay"), (5, 20, "moos pia", None, "relay"), (6, 51, "see ute", "NF", "individual")]
    got = crossed(spark, rows, profiles=profiles)
    assert got[1] == (50, "registry", 0.95, "registry") and 2 not in got and 6 not in got
    assert got[3] == got[4] and got[3][0] < 0 and got[3][1:] == ("fallback", 0.55, "other name") and got[5][0] != got[3][0]


def test_several_members_of_a_name_prove_nothing(spark):
    members = [(i, "berg anna", "NF") for i in range(10, 15)] + [(20, "tal eva", "NF"), (21, "tal ida", "OL"), (22, "tal ida", "NF")]
    rows = [(1, 20, "berg anna", "NF", "individual"), (2, 21, "berg anna", "NF", "individual"), (3, 22, "tal ida", "NF", "individual")]
    got = crossed(spark, rows, members)
    assert {k: v[1] for k, v in got.items()} == {1: "fallback", 2: "fallback"}


def test_repairs_keep_what_was_read(spark):
    rows = spark.createDataFrame([(1, 20, 20, "id"), (2, 21, 21, "id")], "row_id long, user_id long, person_id long, identity_basis string")
    repairs = spark.createDataFrame([(1, 10, "registry", 0.95, "resolved")], "row_id long, target_id long, basis string, confidence double, state string")
    got = [tuple(r) for r in evidence.repaired_ids(rows, repairs).orderBy("row_id").collect()]
    assert got == [(1, 20, 10, "registry", 0.95, "resolved"), (2, 21, 21, "id", None, None)]


def test_clubs_by_index(spark):
    official = ["Naturfreunde Wien", "Naturfreunde Villach", "LZ OMAHA", "OC Fürstenfeld", "ASKÖ Henndorf Orienteering", "HSV OL Wiener Neustadt", "SU Schöckl Orienteering", "OLC Graz", "Graz"]
    want = {
        "naturfreunde wien": "Naturfreunde Wien", "NF Wien": "Naturfreunde Wien", "NF Wien 2": "Naturfreunde Wien", "Naturfreunde Wien *": "Naturfreunde Wien", "NWN Naturfreunde Wien": "Naturfreunde Wien", "Boris Naturfreunde Wien": "Naturfreunde Wien",
        "lz omaha": "LZ OMAHA", "OC Fürstenfeld": "OC Fürstenfeld", "ASKÖ Henndorf Orientee": "ASKÖ Henndorf Orienteering", "HSV OL Wiener Neustad": "HSV OL Wiener Neustadt", "SUSO SU SCHÖCKL ORIENTEERING": "SU Schöckl Orienteering",
        "Naturfreun": None, "Naturfreunde Wien/Naturfreunde Villach": None, "Unbekannt": None, "Alt": "OLC Graz", "": None, None: None, "Graz": "Graz",
    }
    got = evidence.canonical_clubs(spark.createDataFrame([(c,) for c in [*want, "NF Wien"]], "club string"), spark.createDataFrame([(c,) for c in [*official, None, ""]], "name string"), {"ALT": "OLC Graz"})
    assert {r.club: r.official_club for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def tree(rows, fan):
    level = list(rows)
    while True:
        level = [hashlib.sha256("\n".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)] or [hashlib.sha256(b"").hexdigest()]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 17])
def test_ordered_fingerprint_is_a_hash_tree(spark, n):
    rows = [(i % 5, f"t{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "k int, t string")
    want = tree([f"{k}|{t}" for k, t in sorted(rows, key=lambda r: (r[0], f"{r[0]}|{r[1]}"))], 4)
    for parts in (1, 3):
        assert history.ordered_fingerprint(df.repartition(parts), [F.col("k").asc()], F.concat_ws("|", "k", "t"), fan=4) == want
    if n > 1:
        assert history.ordered_fingerprint(df.filter("t <> 't1'"), [F.col("k").asc()], F.concat_ws("|", "k", "t"), fan=4) != want


def test_versions(spark, tmp_path):
    v = history.Versions(spark, f"file://{tmp_path}/v", ["id"])
    make = lambda *rows: spark.createDataFrame(list(rows), "id long, t string")
    assert v.read() is None and v.log() == []
    assert v.write(make((1, "a"))) == 1
    assert v.write(make((1, "a"))) == 1  # equal rows are no version
    assert v.write(make((2, "b"), (1, "A"))) == 2
    with pytest.raises(history.Conflict):
        v.write(make((2, "b")))
    assert v.write(make((1, "A"), (2, "b")).repartition(2)) == 2
    assert v.restore(1) == 3
    assert [(c["version"], c["rows"], c["reason"]) for c in v.log()] == [(1, 1, "update"), (2, 2, "update"), (3, 1, "restore 1")]
    assert [tuple(r) for r in v.read().collect()] == [(1, "a")] and v.read(2).count() == 2
    assert len(list((tmp_path / "v" / "data").iterdir())) == 2  # refused and equal data is gone
    other = history.Versions(spark, f"file://{tmp_path}/v", ["id"])
    log = other.log()
    v.write(make((1, "a"), (3, "c")))
    with pytest.raises(history.Conflict):  # a writer that began before
        other._commit(log, "x", 0, "f", "late")
    with pytest.raises(ValueError, match="no version 9"):
        v.restore(9)
    (tmp_path / "v" / "log" / "00000005.json").write_text('{"version": 5, ')
    assert v.log()[-1]["version"] == 4


def test_a_scan_is_merged_into_versions(spark, tmp_path):
    v = history.Versions(spark, f"file://{tmp_path}/v", ["id"])
    scan = lambda *rows: spark.createDataFrame(list(rows), "id long, t string, pos long")
    assert history.merged_version(v, scan((5, "a", 1), (3, "b", 2)), "id", "pos") == 1
    assert history.merged_version(v, scan((7, "c", 1), (3, "B", 2)), "id", "pos") == 2
    assert [tuple(r) for r in v.read().orderBy("pos").collect()] == [(5, "a", 1), (3, "B", 2), (7, "c", 3)]
    assert history.merged_version(v, scan((3, "B", 1)), "id", "pos") == 2


def test_candidates_equal_all_pairs(spark):
    """The best by shared words, found by sets of words, against every pair; half of the names have one word."""
    import random

    from ranklake.operators import identity

    r = random.Random(5)
    word = lambda: "hot" if r.random() < 0.5 else f"w{r.randrange(12)}"
    name = lambda: " ".join(word() for _ in range(r.choice([1, 2, 3, 4, 11])))
    rows = [(i, name()) for i in range(60)] + [(60, None)]
    people = [(i, name()) for i in range(90)]
    got = identity.pending_candidates(spark.createDataFrame(rows, "seq long, name_key string"), spark.createDataFrame(people, "person_id long, name_key string"))
    want = set()
    for seq, n in rows:
        shared = sorted((-len(set(n.split()) & set(p.split())), i) for i, p in people if n and set(n.split()) & set(p.split()))
        want |= {(seq, i, -s, k) for k, (s, i) in enumerate(shared[:4], 1)}
    assert {(x.seq, x.person_id, x.shared, x.choice) for x in got.collect()} == want


def test_hot_words_make_no_pairs(spark):
    """A word that every name has: what is joined grows with the names, not with their product."""
    from ranklake.operators import identity

    n = 3000
    rows = spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("hot a"), F.col("id").cast("string")).alias("name_key"))
    people = spark.range(n).select(F.col("id").alias("person_id"), F.concat(F.lit("hot b"), F.col("id").cast("string")).alias("name_key"))
    got = identity.pending_candidates(rows, people)
    assert got.count() == 4 * n and {r.person_id for r in got.select("person_id").distinct().collect()} == {0, 1, 2, 3}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_json_files_are_replaced(spark, tmp_path):
    from ranklake.sources import writers

    path = f"file://{tmp_path}/a/x.json"
    for value in ({"a": "ü"}, [1, 2]):
        writers.json_file(spark, path, value)
        import json

        assert json.loads((tmp_path / "a" / "x.json").read_text()) == value
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.endswith(".crc")] == ["x.json"]


def test_a_tree_of_two_levels_ends_in_its_least_digest(spark):
    """Beyond fan * fan rows a tree of two levels has several digests left, as the SQL of m15_table_fingerprint has it."""
    import hashlib

    from ranklake.operators.history import ordered_fingerprint

    sha = lambda texts: hashlib.sha256("\n".join(texts).encode()).hexdigest()
    tree = lambda texts: [sha(texts[i : i + 3]) for i in range(0, len(texts), 3)]
    for n in (0, 2, 9, 10, 40):
        texts = [str(i) for i in range(n)]
        df = spark.range(n).repartition(3)
        a = tree(texts)
        b = tree(a)
        two = min(b) if len(a) > 1 else a[0] if a else sha([])
        assert ordered_fingerprint(df, [F.col("id").asc()], F.col("id").cast("string"), 3, levels=2) == two
        top = a
        while len(top) > 1:
            top = tree(top)
        assert ordered_fingerprint(df, [F.col("id").asc()], F.col("id").cast("string"), 3) == (top[0] if top else sha([]))


def test_the_fingerprint_of_a_table_counts_every_row(spark, tmp_path):
    """Beyond 1024 * 1024 orders two levels leave several digests; the tree goes on, in the query and in its SQL."""
    import duckdb

    from ranklake.plans import evidence_queries, queries

    n = 1024 * 1024 + 1500
    orders = spark.range(n).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "if(id = 5, 'X', 'F') as o_orderstatus", "'1-URGENT' as o_orderpriority", "timestamp'2024-01-01 00:00:00' as o_orderdate")
    path = f"{tmp_path}/orders.parquet"
    orders.write.parquet(path)
    want = tree([f"{i}|{i % 7}|{'X' if i == 5 else 'F'}|1-URGENT" for i in range(n)], 1024)
    got = evidence_queries.m15_table_fingerprint(spark, str(tmp_path)).first()["fingerprint"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    assert got == con.execute(queries.SQL["m15_table_fingerprint"]).fetchall()[0][0] == want
