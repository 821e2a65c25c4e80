import hashlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from ranklake.llm import mixing


def corpus():
    rows = [(i, "w " * (1 + i * 7 % 23), "en", ["b", "a", "ä", None, "big", "big", "big"][i % 7]) for i in range(400)]
    return [*rows, (900, None, "en", "a"), (901, "", "en", "only-empty"), (None, "x y z", "en", "a"), (5, rows[5][1], "en", rows[5][3])]


def water_filled(sizes, cap=3):
    """Targets by resharing the excess until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        share = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_taken(make):
    rows = corpus()
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = water_filled(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= 23
    # within a source the hash alone decides
    for r in got:
        digest = hashlib.md5((str(r.doc_id) if r.doc_id is not None else hashlib.md5(b"x y z").hexdigest()).encode()).hexdigest()
        assert r.hash == int(digest[:9], 16)
    assert sorted(map(str, mixing.mix(make(rows)).collect())) == sorted(map(str, got))


def test_documents_are_repeated_as_taken(make):
    rows = corpus()
    docs = make(rows)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        if r.size:
            copies[r.doc_id] += r.copies
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +copies


def test_sql_and_empty(make):
    rows = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t, s) for i, t, _, s in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    columns = "doc_id, size, source_size, target, taken"
    want = con.execute(f"SELECT {columns} FROM ({mixing.OP10_SQL})").fetchall()
    got = mixing.mix(make(rows)).select(*columns.split(", ")).collect()
    near = lambda rows: sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in rows), key=repr)
    assert near(got) == near(want)
    assert mixing.mix(make([])).collect() == []
    assert mixing.mixed_documents(make([])).collect() == []


def test_clashing_columns(make):
    from pyspark.sql import functions as F

    docs = make(corpus()).withColumn("size", F.lit("x")).withColumn("hash", F.lit(1)).withColumn("copies", F.lit(2))
    assert mixing.mix(docs).count() == len(corpus())
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_clashing_names_stay(make):
    docs = make(corpus()).selectExpr("*", *[f"'kept' AS {c}" for c in ("mix_size", "MIX_HASH", "mix_copies", "mix_copy", "mix_base", "mix_last", "mix_source", "base", "last", "copies", "_mix_size")])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == mixing.mixed_documents(make(corpus())).count()
    assert all(r[c] == "kept" for r in rows for c in docs.columns[5:])
