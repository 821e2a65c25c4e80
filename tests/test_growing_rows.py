"""Work that grows with what is new in rows, not with their number, and the same results."""

import gc

import pytest

from ranklake.sources import clubs, html, layout, relays

KNOWN = ["OLC Graz Nord", "HSV Wiener Neustadt", "Union Nord", "SK Brno"]


@pytest.fixture
def counted(monkeypatch):
    calls = []
    plain = clubs.resegmented
    monkeypatch.setattr(clubs, "resegmented", lambda cells, known: calls.append(cells) or plain(cells, known))
    return calls


def test_rows_that_recur_are_put_right_once(counted):
    known = clubs.Clubs(KNOWN)
    rows = [{"name": "Eva", "club": "Berg Union Nord", "time_text": "0:41", "n": n} for n in range(50)]
    assert [clubs.proven(r, known) for r in rows] == [{"name": "Eva Berg", "club": "Union Nord", "time_text": "0:41", "n": n} for n in range(50)]
    assert len(counted) == 1


def test_rows_that_prove_nothing_are_looked_at_once(counted):
    known = clubs.Clubs(KNOWN)
    row = {"name": None, "club": "No Club", "time_text": "0:41"}
    assert all(clubs.proven(row, known) is row for _ in range(9))
    assert len(counted) == 1


def test_lines_of_empty_cells_are_cut_once(monkeypatch):
    ends = []
    plain = clubs.result_end
    monkeypatch.setattr(clubs, "result_end", lambda line: ends.append(line) or plain(line))
    known = clubs.Clubs(KNOWN)
    assert clubs.resegmented(("Eva Berg", "SK Brno 0:41", ""), known) == ("Eva Berg", "SK Brno", "0:41")
    assert len(ends) == len(set(ends)) == 2


def test_proven_rows_keep_other_columns(spark):
    rows = [(1, "Eva", "Berg Union Nord", "0:41", [1.5]), (2, "Ida", "HSV", "W0i:e2ne3rNeustadt", None), (3, None, None, "Aufg.", []), (4, "Eva", "Berg Union Nord", "0:41", [2.5])]
    df = spark.createDataFrame(rows, "id long, name string, club string, time_text string, more array<double>")
    got = {r["id"]: tuple(r)[1:] for r in clubs.proven_rows(df, KNOWN).collect()}
    assert got == {1: ("Eva Berg", "Union Nord", "0:41", [1.5]), 2: ("Ida", "HSV Wiener Neustadt", "0:23", None), 3: ("", "", "Aufg.", []), 4: ("Eva Berg", "Union Nord", "0:41", [2.5])}
    assert clubs.proven_rows(df.filter("id > 9"), KNOWN).count() == 0


def _count(monkeypatch, module, name):
    calls = []
    plain = getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a: calls.append(a) or plain(*a))
    return calls


def test_relay_lines_that_recur_are_read_once(monkeypatch):
    calls = _count(monkeypatch, relays, "value_at_end")
    relays._relay_line.cache_clear()
    text = "Klasse A (1)\nPl Stnr Staffel Zeit\n1 101 Team Q 1:30\nName Jg Zeit\nAnna Q 13 0:45\nEva Q 0:45"
    found = [relays.parse_relay_text(text) for _ in range(5)]
    assert all(f == found[0] for f in found) and len({id(f[0]["results"][0]) for f in found}) == 5
    assert [(r["team"], r["rank"], r["bib"], r["name"], r["time_text"], r["team_time"], r["leg"]) for r in found[0][0]["results"]] == [("Team Q", 1, "101", "Anna Q", "0:45", "1:30", 1), ("Team Q", 1, "101", "Eva Q", "0:45", "1:30", 2)]
    assert len(calls) == 3
    assert relays.parse_relay_text(text.split("\n", 2)[2]) == []  # teams and members above the first class are none


def test_flowing_lines_that_recur_are_read_once(monkeypatch):
    calls = _count(monkeypatch, clubs, "flow_row")
    known = clubs.Clubs(KNOWN)
    found = [layout.parse_flowing("Klasse A (2)\n1. Eva Berg Union Nord 0:41\n2. Ida Union Nord Aufg.", known) for _ in range(5)]
    assert all(f == found[0] for f in found) and [(r["rank"], r["name"], r["club"], r["time_text"]) for r in found[0][0]["results"]] == [(1, "Eva Berg", "Union Nord", "0:41"), (2, "Ida", "Union Nord", "Aufg.")]
    assert len(calls) == 2


def test_tasks_share_a_dictionary():
    assert clubs.shared(tuple(KNOWN)) is clubs.shared(tuple(KNOWN)) is not clubs.shared(("OLC Graz",))


@pytest.mark.parametrize("front", ["<h2>Klasse A</h2>\n", "Klasse A\n<H3>Klasse A</H3>"])
def test_a_heading_and_its_table_are_one_table(monkeypatch, front):
    calls = _count(monkeypatch, html, "_plain_tables")
    html._tables.cache_clear()
    text = front + "<table><tr><th>Pl<th>Name<th>Zeit</tr><tr><td>1</td><td>Eva</td><td>0:41</td></tr></table>"
    assert [(c["name"], c["declared"], [r["name"] for r in c["results"]]) for c in html.parse_document(text)] == [("Klasse A", 1, ["Eva"])]
    assert len(calls) == 1


@pytest.mark.parametrize("front", ["", "x ", "<h2>A</h2>", "<tr><td>no table", "<!-- <table> -->", "<script>", "a &amp; b <h1>", "<h2 id='x'>A</h2>", "<table><tr><td>first</table>"])
@pytest.mark.parametrize("behind", ["", " \n", "tail", "<tr><td>more", "</table> <p>x"])
def test_what_stands_before_a_table_changes_none(front, behind):
    text = front + "<table><tr><td>1</td><td> Eva </td></tr><tr><td>2 " + behind
    p = html.Tables()
    p.feed(text)
    p.close()
    assert html.tables(text) == p.done()


def test_no_collection_while_documents_are_read():
    seen = []
    assert html.uncollected(lambda x: seen.append(gc.isenabled()) or x, 7) == 7
    with pytest.raises(ZeroDivisionError):
        html.uncollected(lambda: 1 / 0)
    assert seen == [False] and gc.isenabled()


def test_flow_rows_move_no_row_for_a_small_dictionary(spark, monkeypatch):
    """Beyond what is read, only the distinct clubs are shuffled; a large dictionary, joined by a shuffle, gives the same."""
    lines = ["1 Eva Berg Union Nord 0:41", "2. Ida SK Brno (Aufg.)", "2. Ida SK Brno Aufg.", "Max Union  Nord 1:00 +0:19", "footer", None, "Nord 0:10", "AK Eva 0:41\u2028", "a\u2028b 0:41", "1 2 0:41"]
    df = spark.createDataFrame(list(enumerate(lines)), "line int, text string")
    names = spark.createDataFrame([(k,) for k in [*KNOWN, "Nord", "Union  Nord"]], "club string")
    small = clubs.flow_rows(df, names, ["line"])
    got = sorted(map(tuple, small.collect()))
    assert got == [(0, 1, "Eva Berg", "Union Nord", "0:41"), (2, 2, "Ida", "SK Brno", "Aufg."), (3, None, "Max", "Union Nord", "1:00"), (6, None, "Nord", "", "0:10"), (7, None, "AK Eva", "", "0:41")]
    assert "SortMergeJoin" not in (plan := small._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan
    monkeypatch.setattr(clubs, "BROADCAST_CLUBS", 0)
    assert sorted(map(tuple, clubs.flow_rows(df, names, ["line"]).collect())) == got
