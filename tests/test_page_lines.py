"""Pages of words: lines cut from columns, documents that stand together instead of being collected, and the same results."""

import random

import numpy as np
import pyarrow as pa

from ranklake.sources import layout

WORD = "array<struct<x0:double,top:double,text:string>>"
KIND = pa.list_(pa.struct([("x0", pa.float64()), ("top", pa.float64()), ("text", pa.string())]))


def words(*lines):
    return [(float(x), float(top), t) for top, text in lines for x, t in text]


def structs(own):
    return [{"x0": x, "top": t, "text": s} for x, t, s in own]


def document(n, start=0):
    """Pages of two rows each, with a title and a page number that are no rows."""
    rows = [(40 + 12 * (i % 2), [(10, str(i + 1)), (60, "Anna"), (80, chr(65 + i % 26)), (200, "NF"), (230, "Wien"), (300, f"{i % 60}:{start % 60:02d}")]) for i in range(n)]
    head = [(5, [(10, "Cup")]), (30, [(10, "Pl"), (60, "Name"), (200, "Verein"), (300, "Zeit")]), (800, [(10, "Seite")])]
    pages = [words(*head, *rows[i : i + 2]) + [(50.0, 800.0, str(i))] for i in range(0, n, 2)]
    pages[0] += words((20, [(10, "Klasse"), (40, "A"), (60, f"({n})")]))
    return pages


def test_lines_of_all_pages_at_once():
    draw = random.Random(7)
    texts = ["Pl", "Name", "1", "26:21", "(3)", "Aufg.", "x y", "", "A"]
    pages = [[(float(draw.randrange(0, 90, 10)), draw.choice([1.0, 1.0, 2.5, 4.0, 20.0, 20.1]) if n % 2 else float(draw.randrange(0, 60, 12)), draw.choice(texts)) for _ in range(draw.randrange(9))] for n in range(300)]
    got = layout.page_lines(pa.array([structs(p) for p in pages], KIND), np.arange(len(pages)), len(pages))
    for page, lines in zip(pages, got, strict=True):
        want = [layout._line(own) for own in layout.group_lines(page)]
        assert [(x.lefts, x.texts, x.top, x.labels, x.tells, x.parts) for x in lines] == [(x.lefts, x.texts, x.top, x.labels, x.tells, x.parts) for x in want]
    # a word without a place or text is none
    holes = pa.array([[{"x0": None, "top": 1.0, "text": "A"}, {"x0": 1.0, "top": 1.0, "text": "B"}, None, {"x0": 2.0, "top": 1.0, "text": None}], None], KIND)
    assert [[x.texts for x in lines] for lines in layout.page_lines(holes, np.array([1, 0]), 2)] == [[], [["B"]]]


def test_documents_stand_together(spark):
    """Documents beyond a batch, pages in parts and in any order: read without a list of rows or pages in one place."""
    docs = {k: document(n, k) for k, n in enumerate((1, 2, 7, 40, 3))} | {None: document(4, 9)}
    whole = [(k, n, structs(p)) for k, d in docs.items() for n, p in enumerate(d)]
    parts = [(k, n, [w]) for k, n, own in whole for w in own]
    random.Random(3).shuffle(whole)
    random.Random(3).shuffle(parts)
    fields = ("row_pos", "rank", "name", "club", "time_text")
    want = sorted(((k, i, *(r[f] for f in fields[1:])) for k, d in docs.items() for c in layout.parse_pages(d) for i, r in enumerate(c["results"])), key=repr)
    assert len(want) == 57
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for rows, cut in ((whole, False), (parts, True)):
                df = spark.createDataFrame(rows, f"doc int, page int, words {WORD}").repartition(3)
                got = layout.parsed_pages(df, "doc", fields=fields, parts=cut)
                assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
                assert sorted(map(tuple, got.collect()), key=repr) == want
                classes = layout.parsed_pages(df, "doc", parts=cut).collect()
                assert sorted((r.doc is None, r.doc or 0, sum(len(c.results) for c in r.classes)) for r in classes) == [(False, 0, 1), (False, 1, 2), (False, 2, 7), (False, 3, 40), (False, 4, 3), (True, 0, 4)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_pages_of_one_number_follow_in_the_order_of_their_words():
    rows = pa.array([structs([(1.0, 1.0, t)]) if t else None for t in ("c", "b", "a", None, "d")], KIND)
    numbers = pa.array([2, 1, 2, 2, None], pa.int32())
    texts = lambda docs: [[[x.texts for x in page] for page in d] for d in docs]
    assert texts(layout.document_lines(numbers, rows, [5])) == [[[["d"]], [["b"]], [], [["a"]], [["c"]]]]
    assert texts(layout.document_lines(numbers, rows, [1, 4])) == [[[["c"]]], [[["d"]], [["b"]], [], [["a"]]]]
    assert [len(d) for d in layout.document_lines(numbers, rows, [5], parts=True)] == [3]
