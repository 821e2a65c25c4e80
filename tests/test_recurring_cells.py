"""Cells, rows and teams that recur are looked at once, with the results of a reading that keeps nothing."""

import random

from ranklake.sources import brackets, clubs, layout, positioned, relays


def _placed(left, top, text):
    return f'<div style="position:absolute; left:{left}px; top:{top}px">{text}</div>'


def _page(n):
    head = _placed(48, 20, f"Klasse {n}") + _placed(384, 20, "(2 / 2)")
    team = lambda i: _placed(48, i * 90, f"{i}.") + _placed(78, i * 90, f"Team {i}") + _placed(528, i * 90, "0:10")
    member = lambda top, name: _placed(102, top, name) + _placed(384, top, "0:05")
    return head + "".join(team(i) + member(i * 90 + 20, "Anna B") + member(i * 90 + 40, "Eva C") for i in (1, 2))


def test_placed_elements_are_read_once():
    """Each element of every page was placed anew."""
    positioned.place_of.cache_clear()
    for n in range(50):
        (found,) = layout.dispatched(_page(n))
        assert [(r["rank"], r["team"], r["leg"], r["name"], r["time_text"], r["team_time"], r["legs"]) for r in found["results"]] == [
            (i, f"Team {i}", leg, name, "0:05", "0:10", 2) for i in (1, 2) for leg, name in ((1, "Anna B"), (2, "Eva C"))
        ]
    seen = positioned.place_of.cache_info()
    assert seen.hits + seen.misses <= 70  # 65 elements differ, of 800


def test_columns_hold_what_their_cells_are():
    """Kinds are counted together; the shares are those of each kind by itself."""
    rng = random.Random(3)
    texts = ["1.", "AK", "Anna B", "0:10", "+0:10", "(0:10)", "-", "Aufg.", "x", "7", "Team A", ""]
    for _ in range(500):
        rows = [{c: rng.choice(texts) for c in range(5) if rng.random() < 0.7} for _ in range(rng.randint(1, 9))]
        shares = {}
        for c in sorted({c for r in rows for c in r}):
            kinds = [positioned.kinds_of(r[c]) for r in rows if c in r]
            shares[c] = [sum(k[i] for k in kinds) / len(kinds) for i in range(4)]
        values = tuple(c for c, s in shares.items() if s[0] >= positioned.MOSTLY and s[1] < 0.5)
        words = tuple(c for c, s in shares.items() if s[2] >= positioned.MOSTLY and c not in values)
        own = positioned.roles(rows)
        assert (own.values, own.words) == (values, words)


def test_rows_of_one_top_are_in_order():
    rng = random.Random(5)
    for _ in range(500):
        cells = [positioned.Cell(rng.choice((0.0, 2.0, 3.0, 7.0, -1.0)), float(rng.randint(0, 4)), rng.choice("ab")) for _ in range(rng.randint(0, 12))]
        rows = positioned.rows_of(cells)
        assert sorted(c for r in rows for c in r) == sorted(cells)
        assert all([c.left for c in r] == sorted(c.left for c in r) and max(c.top for c in r) - min(c.top for c in r) <= positioned.ROW_ROOM for r in rows)


def test_rows_are_judged_once():
    """The agreement of a reading asked for every row of every document whether its cells are results."""
    clubs.is_result.cache_clear()
    row = "<tr><td></td><td>{0}.</td><td>Team {0}</td><td>0:10</td></tr><tr><td></td><td>1.</td><td>Anna B</td><td>0:05</td><td>x</td><td></td></tr><tr><td></td><td>2.</td><td>Eva C</td><td>0:05</td><td>x</td><td></td></tr>"
    for n in range(50):
        (found,) = layout.dispatched(f"<table><tr><td></td><td>Klasse {n}</td><td>(2 / 2)</td></tr>" + row.format(1) + row.format(2))
        assert len(found["results"]) == 4 and layout.agreement([found]) == (1.0, 1.0, 4)
    seen = clubs.is_result.cache_info()
    assert seen.hits + seen.misses <= 16  # two questions for each of four rows that differ


def test_teams_lose_no_hour_and_share_no_row():
    out = relays.Teams()
    out.category("A", 3)
    out.team("X", "10:00", 1, "7")
    out.member("Anna", "35:00"), out.member("Eva", "35:00")
    out.team("X", "(1:00)", 2, ooc=True)
    out.category("A", 3)
    out.team("Y", "Aufg.")
    out.member("Ida", "")
    (found,) = out.done()
    first, second, alone, last = found["results"]
    assert first["team_time"] == second["team_time"] == "1:10:00" and (first["leg"], second["leg"], second["legs"], first["bib"]) == (1, 2, 2, "7")
    assert (alone["team"], alone["time_text"], alone["rank"], alone["leg"], alone["legs"], alone["out_of_competition"]) == ("X 2", "1:00", None, None, None, True)
    assert (last["name"], last["team_time"], last["leg"], last["rank_text"]) == ("Ida", "Aufg.", 1, "")
    first["name"] = "changed"
    assert second["name"] == "Eva"


def test_heats_ask_for_non_starters_only_beyond_their_count(monkeypatch):
    """Every result of every heat was searched for the words of a non-starter."""
    asked = []

    class Pattern:
        def search(self, text):
            asked.append(text)
            return text == "DNS"

    monkeypatch.setattr(brackets, "_DNS", Pattern())
    heat = "<table><tr><td>Finale</td><td>(1)</td></tr><tr><td>1</td><td>Anna B</td><td>Wien</td><td>1:00</td></tr>"
    assert [r.get("uncounted") for h in brackets.parse_bracket(heat) for r in h["results"]] == [None] and not asked
    more = heat + "<tr><td></td><td>Eva C</td><td>Wien</td><td>DNS</td></tr>"
    assert [r.get("uncounted") for h in brackets.parse_bracket(more) for r in h["results"]] == [False, True] and asked
