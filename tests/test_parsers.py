"""Invented documents of every shape that a parser tells apart."""

from ranklake.sources import html, layout, relays


def short(classes):
    return [(c["name"], c["declared"], [(r["rank"], r["team"], r["leg"], r["name"], r["time_text"]) for r in c["results"]]) for c in classes]


RELAY = """Pl Stnr Staffel Zeit
Damen 105- (3)
Pl Stnr Staffel Zeit
1 24 NF Kitz/HSV Neust. 39:06
Name Jg Zeit
Berg Anna 13 13:28
Tal Eva 13 12:30
See Ida 13:08
2 25 OL Ost 45:00 +5:54
Moos Ute 20:00
Wald Pia Fehlst.
Damen 105- (3)
26 Klub 3 N Ang
Herren (1)
AK 30 OL Ost 01:01
Feld Uwe 31:00
Rain Tom 30:01
"""


def test_relay_text():
    got = relays.parse_relay_text(RELAY)
    assert short(got) == [
        ("Damen 105-", 3, [
            (1, "NF Kitz/HSV Neust.", 1, "Berg Anna", "13:28"), (1, "NF Kitz/HSV Neust.", 2, "Tal Eva", "12:30"), (1, "NF Kitz/HSV Neust.", 3, "See Ida", "13:08"),
            (2, "OL Ost", 1, "Moos Ute", "20:00"), (2, "OL Ost", 2, "Wald Pia", "Fehlst."), (None, "Klub 3", None, "", "N Ang"),
        ]),
        ("Herren", 1, [(None, "OL Ost 2", 1, "Feld Uwe", "31:00"), (None, "OL Ost 2", 2, "Rain Tom", "30:01")]),
    ]
    first, last = got[0]["results"][0], got[1]["results"][0]
    assert (first["bib"], first["club"], first["team_time"], first["legs"]) == ("24", "NF Kitz/HSV Neust.", "39:06", 3)
    assert (last["team_time"], last["out_of_competition"], last["club"]) == ("1:01:01", True, "OL Ost")  # the hour that the field lost
    assert [r["leg"] for r in relays.parse_relay_text(RELAY, "team")[0]["results"]] == [None] * 6


def tr(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def test_numbered_relay():
    page = "<table>" + tr("", "Senior 33-80", "(2 / 3)", "") + tr("", "1.", "Team Nord", "1:00:00") + tr("", "1.", "Anna B", "30:00", "x", "") + tr("", "2.", "Eva C", "30:00", "x") + tr("", "2.", "Team Süd", "(1:05:00)", "+5:00") + tr("", "1", "Ida D", "1:05:00", "x", "") + tr("", "Team West", "Aufg.") + tr("", "footer", "text") + "</table>"
    assert short(relays.parse_numbered_relay(page)) == [
        ("Senior 33-80", 2, [(1, "Team Nord", 1, "Anna B", "30:00"), (1, "Team Nord", 2, "Eva C", "30:00"), (None, "Team Süd", 1, "Ida D", "1:05:00"), (None, "Team West", None, "", "Aufg.")])
    ]
    assert layout.dispatched(page)[0]["name"] == "Senior 33-80"
    assert relays.parse_numbered_relay(page + page) == []


def test_club_tables():
    counted = "<table>" + tr("Damen", "(2 / 3)", "Zeit") + tr("1.", "Anna B", "OK gittis", "Ost", "26:21") + tr("", "Eva C", "OL Ost", "Aufg.") + tr("AK", "Ida D", "NF", "30:00") + tr("foot", "note", "x") + "</table>"
    got = relays.parse_club_table(counted)
    assert [(r["rank"], r["name"], r["club"], r["time_text"], r["out_of_competition"]) for r in got[0]["results"]] == [(1, "Anna B", "OK gittis Ost", "26:21", False), (None, "Eva C", "OL Ost", "Aufg.", False), (None, "Ida D", "NF", "30:00", True)]
    assert got[0]["declared"] == 3
    simple = "<table>" + tr("Herren", "", "Zeit") + tr("1", "Max B", "NF", "26:21") + "</table>"
    assert [(c["name"], c["declared"]) for c in relays.parse_club_table(simple)] == [("Herren", 1)]
    fixed = "<table>" + tr("H 21 (1 / 2)", "") + tr("1", "7", "Max B", "90", "NF", "26:21") + tr("2", "8", "Ed C") + "</table>"
    assert [(r["name"], r["club"], r["time_text"]) for r in relays.parse_club_table(fixed)[0]["results"]] == [("Max B", "NF", "26:21")]
    assert layout.dispatched(counted)[0]["results"][0]["club"] == "OK gittis Ost"


def page(rows, number, title="Cup 2024"):
    """Words of a page: a title, labels, rows and a footer with the page's number."""
    lines = [(5, [(10, title), (60, "Wien")]), (20, [(10, "Pl"), (60, "Name"), (200, "Verein"), (300, "Zeit")])] + [(40 + 12 * i, r) for i, r in enumerate(rows)] + [(800, [(10, "Seite"), (50, str(number))])]
    return [(x, top, t) for top, words in lines for x, t in words]


def test_pages_without_furniture():
    one = [[(10, "H"), (25, "21"), (50, "(3)")], [(10, "1"), (60, "Anna"), (95, "Berg"), (205, "NF"), (305, "26:21")]]
    two = [[(10, "2"), (60, "Eva"), (95, "Tal"), (205, "OL"), (305, "27:00")], [(10, "3"), (60, "Ida"), (95, "See"), (205, "OL"), (305, "28:00")]]
    got = layout.parse_pages([page(one, 1), page(two, 2)])
    assert [(c["name"], [(r["rank"], r["name"], r["club"], r["time_text"]) for r in c["results"]]) for c in got] == [("H 21", [(1, "Anna Berg", "NF", "26:21"), (2, "Eva Tal", "OL", "27:00"), (3, "Ida See", "OL", "28:00")])]


def test_flowing_lines_count_where_columns_do_not():
    rows = [[(10, "H"), (25, "21"), (50, "(2)")], [(10, "1"), (20, "Anna"), (30, "Berg"), (40, "NF"), (50, "26:21")], [(10, "2"), (20, "Eva"), (30, "Tal"), (40, "OL"), (50, "27:00")], [(10, "Bahn"), (60, "lang"), (90, "oder"), (200, "kurz")]]
    got = layout.parse_pages([page(rows, 1)])
    assert [(r["rank"], r["name"], r["club"]) for r in got[0]["results"]] == [(1, "Anna Berg", "NF"), (2, "Eva Tal", "OL")]


def test_repairs():
    fixed = lambda **x: {k: layout.repaired({"club": "", "time_text": "", "name": "Anna"} | x)[k] for k in ("club", "time_text")}
    assert fixed(club="26:21") == {"club": "", "time_text": "26:21"}
    assert fixed(club="NF Wien Aufg.") == {"club": "NF Wien", "time_text": "Aufg."}
    assert fixed(club="In Beweg2u:0n4g:58") == {"club": "In Bewegung", "time_text": "2:04:58"}
    assert fixed(club="OL 2000 Graz") == {"club": "OL 2000 Graz", "time_text": ""}
    assert fixed(club="NF", time_text="26:21") == {"club": "NF", "time_text": "26:21"}


def test_stages(spark):
    table = "<table>" + tr("H 21 (1)") + "<tr><th>Pl<th>Name<th>Verein<th>Zeit 1<th>Zeit 2</tr>" + tr("1", "Anna B", "NF", "26:21", "30:00") + "</table>"
    docs = spark.createDataFrame([(1, table), (2, None)], "page_id int, html string")
    got = [(r.page_id, r.stage, [(x.name, x.time_text) for c in r.classes for x in c.results]) for r in html.parsed_stages(docs, 2).orderBy("stage").collect()]
    assert got == [(1, 1, [("Anna B", "26:21")]), (1, 2, [("Anna B", "30:00")])]


def test_pages_by_document(spark):
    rows = [(7, n, [{"x0": float(x), "top": float(t), "text": s} for x, t, s in page(r, n)]) for n, r in ((2, [[(10, "2"), (60, "Eva"), (95, "Tal"), (205, "OL"), (305, "27:00")]]), (1, [[(10, "H"), (25, "21"), (50, "(2)")], [(10, "1"), (60, "Anna"), (95, "Berg"), (205, "NF"), (305, "26:21")]]))]
    docs = spark.createDataFrame(rows, "page_id int, page int, words array<struct<x0:double,top:double,text:string>>")
    r = layout.parsed_pages(docs).first()
    assert [x.name for x in r.classes[0].results] == ["Anna Berg", "Eva Tal"]
