"""Rows that come straight from the parsers are those of the nested classes; rows that recur are read as often as they come."""

import random

from ranklake.sources import brackets, html, layout
from ranklake.sources.clubs import Clubs

FIELDS = ("category_pos", "category", "declared", "row_pos", "rank", "name", "club", "time_text", "kind", "team", "leg", "out_of_competition")


def test_rows_equal_the_flattened_classes(spark):
    table = "<table><tr><td>A (2)</td></tr><tr><th>Pl<th>Name<th>Verein<th>Zeit</tr><tr><td>1.</td><td>Anna B</td><td>Wien</td><td>1:00</td></tr><tr><td></td><td>Eva C</td><td></td><td>Aufg.</td></tr>"
    texts = [(i, t) for i, t in enumerate([table, None, "", table + "<tr><td>B (0)</td></tr><tr><td>C (1)</td></tr><tr><td>7</td><td>Ida &amp; D</td><td>Graz</td><td>2:00</td></tr></table>", "<p>", table] * 300)]
    docs = spark.createDataFrame(texts, "page_id long, html string")
    for f in (html.parsed, layout.parsed_texts):
        nested = html.flattened(f(docs), "page_id").select("page_id", *FIELDS)
        flat = f(docs, fields=FIELDS)
        assert flat.dtypes == nested.dtypes
        assert sorted(map(repr, flat.collect())) == sorted(map(repr, nested.collect()))


def test_rows_in_arrow_columns_skip_classes_without_rows():
    row = {"rank": 1, "name": "Anna"}
    of, columns = html.flat_rows([[], [{"name": "A", "declared": 0, "results": []}, {"name": "B", "declared": 2, "results": [row, {**row, "rank": None}]}], []], ("row_pos", "category_pos", "category", "rank"))
    assert of.to_pylist() == [1, 1] and [c.to_pylist() for c in columns] == [[0, 1], [1, 1], ["B", "B"], [1, None]]
    of, columns = html.flat_rows([], ("row_pos", "name"))
    assert of.to_pylist() == [] and [c.to_pylist() for c in columns] == [[], []]


def test_kept_rows_are_not_shared():
    """A row that was kept is not changed by what is done with an earlier document's."""
    text = "<table><tr><td>A (1)</td></tr><tr><th>Pl<th>Name<th>Zeit</tr><tr><td>1</td><td>Anna B</td><td>1:00</td></tr></table>"
    first = html.parse_document(text)
    first[0]["results"][0]["name"] = "changed"
    html.tables(text + " ")[0][2][1] = "changed"
    assert html.parse_document(text + "  ")[0]["results"][0]["name"] == "Anna B"
    heats = "<table><tr><td>Finale</td><td>(1)</td></tr><tr><td>1</td><td>Anna B</td><td>Wien</td><td>1:00</td></tr></table>"
    brackets.parse_bracket(heats)[0]["results"][0]["name"] = "changed"
    assert brackets.parse_bracket(heats + " ")[0]["results"][0]["name"] == "Anna B"


def test_recurring_rows_are_read_once():
    """Each row of every document was read anew."""
    html._kept_cells.cache_clear(), html._kind_of.cache_clear(), html._read_row.cache_clear()
    rows = "".join(f"<tr><td>{i}</td><td>Anna B</td><td>1:{i:02d}</td></tr>" for i in range(1, 9))
    for n in range(50):
        text = f"<table><tr><td>A {n} (8)</td></tr><tr><th>Pl<th>Name<th>Zeit</tr>{rows}"
        assert [r["rank"] for r in html.parse_document(text)[0]["results"]] == list(range(1, 9))
    assert html._kept_cells.cache_info().misses <= 60 and html._read_row.cache_info().misses == 8


def test_odd_text_between_rows_equals_the_tolerant_parser():
    rng = random.Random(11)
    parts = ["<table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", '<td class="a">', "&nbsp;", "&#xFFFF;", "x &amp; y", "  ", "<br>", "</table>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        p = html.Tables()
        p.feed(text)
        p.close()
        assert html.tables(text) == p.done(), text


def test_signatures_are_those_of_the_whole_patterns():
    for text in ("<TABLE><TR><TD>A</TD><TD>(1 / 1)</TD></TR></TABLE>", "<Pre>x</Pre>", "<H2>A</H2><TABLE></TABLE>", "(1/1)</TD>", "plain"):
        assert isinstance(layout.dispatched(text, Clubs(["Wien"])), list)
    fits = {name: f for name, f, _ in layout.SIGNATURES}
    assert fits["tables"]("<TABLE>") and fits["preformatted"]("<PRE>") and fits["club table"]("(1/1)</TD>") and fits["knock-out"]("<TH> (2) <") and not fits["tables"]("table")
