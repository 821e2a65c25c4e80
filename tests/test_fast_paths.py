"""What is read at once must be what the tolerant parser and the whole patterns read."""

import random
import time

from ranklake.sources import clubs, html, positioned, relays


def tolerant(text):
    p = html.Tables()
    p.feed(text)
    p.close()
    return p.done()


def test_tables_equal_the_tolerant_parser():
    rng = random.Random(7)
    parts = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", '<td class="a b">', "<TD>", "<br>", "<b>", "</b>", " ", "Anna  B", "1.", "A &amp; B", "&nbsp;x", "\n", "a > b", "<p>"]
    odd = ["<", "a < b", "<!-- <td> -->", "<br/>", "<script>", "<td", "&am", "<td class=x>", "</td x>", "<title>", "<td title='<'>"]
    for n in range(3000):
        text = "".join(rng.choice(parts if n % 2 or rng.random() < 0.9 else odd) for _ in range(rng.randint(0, 25)))
        assert html.tables(text) == tolerant(text), text


def test_placed_elements_equal_the_tolerant_parser():
    rng = random.Random(8)
    parts = ['<div style="left:48px; top:60px">Anna  B</div>', '<div style="position:absolute; left:78px; top:60px">Wien</div>', '<span style="left:1px">x</span>', "\n", "text", '<div style="top:1px;left:2px"> </div>']
    odd = ['<div style="left:48px; top:60px">A &amp; B</div>', '<div style="left:1px; top:2px">a<br>b</div>', '<div style="left:1px; top:2px">open', "<b>", "</div>"]
    for n in range(2000):
        text = "".join(rng.choice(parts if n % 2 or rng.random() < 0.8 else odd) for _ in range(rng.randint(0, 9)))
        p = positioned.Elements()
        p.feed(text)
        p.close()
        p.finish()
        assert positioned.cells_of(text) == p.cells, text


def test_results_at_the_end_equal_the_whole_patterns():
    rng = random.Random(9)
    words = ["Anna", "Wien", "12:34", "(1:02:03)", "+0:01", "Aufg.", "Fehlst.", "nicht", "angetreten", "n. Ang.", "AK", "1.", "dnf", "x12:34", "außer", "Konkurrenz", *list(clubs._PHRASES)[:40]]
    for _ in range(5000):
        line = " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))
        plain = " ".join(line.split())
        m = clubs.RESULT_END.match(plain)
        assert clubs.result_end(plain) == ((m["body"], m["value"]) if m else None), plain
        wide = line.replace(" ", rng.choice([" ", "  ", "\t"])).strip()
        m = relays.VALUE_AT_END.match(wide)
        assert relays.value_at_end(wide) == ((m["body"], m["value"]) if m else None), wide


def test_classes_in_arrow_columns():
    docs = [[], [{"name": "A", "declared": 2, "results": [relays.row("Anna", "Wien", "1:00", 1), {"rank": None, "name": "B", "club": "", "time_text": ""}]}, {"name": "B", "declared": None, "results": []}]]
    got = html.arrow_classes(docs).to_pylist()
    assert got[0] == [] and [c["name"] for c in got[1]] == ["A", "B"] and got[1][1]["results"] == [] and got[1][1]["declared"] is None
    assert {k: v for k, v in got[1][0]["results"][0].items() if v is not None} == {k: v for k, v in relays.row("Anna", "Wien", "1:00", 1).items() if v is not None}
    assert got[1][0]["results"][1]["bib"] is None


def test_a_long_relay_class_takes_no_longer_a_row_than_a_short_one():
    """Legs were counted over all earlier rows of the class."""

    def took(n):
        rows = [["A (9)"], ["Pl", "Staffel", "Name", "Zeit"]] + [r for i in range(n) for r in ([f"{i + 1}.", f"Team {i}", "", "1:00"], ["", "", "Anna B", "0:30"], ["", "", "Eva C", "0:30"])]
        start = time.process_time()
        found = html.parse_rows(rows)[0]["results"]
        assert [r["leg"] for r in found] == [1, 2] * n
        return time.process_time() - start

    took(100)
    assert took(8000) < 40 * max(took(800), 0.01)
