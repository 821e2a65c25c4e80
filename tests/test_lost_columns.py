"""Documents whose columns are lost or doubtful: placed elements, knock-outs, flowing rows, mixed letters, two columns."""

import pytest

from ranklake.sources import brackets, layout, positioned
from ranklake.sources.clubs import Clubs, disentangled, flow_classes, flow_row, flow_rows, looks_named, resegmented

KNOWN = [
    "Orienteering Innsbruck Imst", "Naturfreunde Villach - Orienteering", "BG/BRG Zehnergasse Wiener Neustadt", "Naturfreunde Bad Vöslau", "HSV OL Wiener Neustadt",
    "SK Zabrovesky Brno", "SKV OLG Deutsch Kaltenbrunn", "NF Wien", "NF", "Orienteering Klosterneuburg", "OLC Graz", "INNSBRUCK IMST", "Verein der Freunde des Laufs im Wald Nord",
]
CLUBS = Clubs(KNOWN)


def short(classes):
    return [(c["name"], c["declared"], [(r["rank"], r["name"], r["club"], r["time_text"]) for r in c["results"]]) for c in classes]


def placed(*rows, tag="div"):
    out = []
    for n, cells in enumerate(rows):
        out += [f"<{tag} style='position:absolute; left:{x}px; top:{20 * n + (i % 2)}px'>{t}</{tag}>" for i, (x, t) in enumerate(cells)]
    return "<html><body>" + "".join(reversed(out)) + "</body></html>"


def test_placed_elements_keep_empty_cells():
    labelled = placed([(10, "H 21 (3)")], [(10, "Pl"), (40, "Name"), (200, "Verein"), (300, "Zeit")], [(10, "1"), (40, "Max Berg"), (200, "NF"), (290, "1:02:03")], [(40, "Eva Tal"), (200, "NF Wien"), (300, "Aufg")], [(10, "3"), (40, "Ida See"), (300, "30:00")])
    want = [("H 21", 3, [(1, "Max Berg", "NF", "1:02:03"), (None, "Eva Tal", "NF Wien", "Aufg"), (3, "Ida See", "", "30:00")])]
    assert short(positioned.parse_positioned(labelled)) == short(layout.dispatched(labelled)) == want


def test_placed_elements_without_labels():
    page = placed(
        [(48, "Cup 2024")], [(48, "D 21"), (280, "(2 / 4)"), (483, "Zeit")], [(48, "1."), (78, "Eva Tal"), (280, "NF"), (483, "26:21")], [(48, "10."), (78, "Ida &amp; Co See"), (483, "27:00"), (531, "+0:39")],
        [(78, "Ute Moos"), (280, "NF Wien"), (483, "Fehlst")], [(48, "AK"), (78, "Pia Wald"), (280, "NF"), (483, "(30:00)")], [(78, "Uta Rain"), (280, "NF"), (483, "-")], tag="span",
    )
    got = positioned.parse_positioned(page)
    assert short(got) == [("D 21", 2, [(1, "Eva Tal", "NF", "26:21"), (10, "Ida & Co See", "", "27:00"), (None, "Ute Moos", "NF Wien", "Fehlst"), (None, "Pia Wald", "NF", "30:00"), (None, "Uta Rain", "NF", "-")])]
    assert [r["out_of_competition"] for r in got[0]["results"]] == [False, False, False, True, False]


def test_placed_relay():
    page = placed(
        [(48, "Damen 105-"), (384, "(2 / 3)")], [(48, "1."), (78, "OL Ost"), (528, "1:00:00")], [(102, "Anna B"), (384, "30:00")], [(102, "Eva C"), (384, "30:00")],
        [(78, "NF Wien"), (528, "Fehlst")], [(102, "Ida D"), (384, "31:00")], [(102, "Ute E"), (384, "Fehlst")], [(78, "Klub 3"), (528, "N Ang")],
    )
    got = positioned.parse_positioned(page)
    assert [(r["rank"], r["team"], r["leg"], r["name"], r["time_text"], r["team_time"]) for r in got[0]["results"]] == [
        (1, "OL Ost", 1, "Anna B", "30:00", "1:00:00"), (1, "OL Ost", 2, "Eva C", "30:00", "1:00:00"), (None, "NF Wien", 1, "Ida D", "31:00", "Fehlst"), (None, "NF Wien", 2, "Ute E", "Fehlst", "Fehlst"), (None, "Klub 3", None, "", "N Ang", "N Ang"),
    ]
    assert positioned.parse_positioned("") == positioned.parse_positioned("<p>nothing placed</p>") == []


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) + "</tr>" for r in rows) + "</table>"


KNOCK_OUT = table(
    ["", "KO-Sprint", "2024-05-01"], ["", "Viertelfinal A", "(2 / 2)", "Time", "Behind"], ["", "1.", "Anna Maria Berg", "NF Wien", "6:21"], ["", "2.", "Eva Tal", "OK Jihlava", "6:30", "+0:09"],
    ["", "Viertelfinal B", "(2 / 3)", "Time"], ["", "1.", "Ida See", "6:20"], ["", "AK", "Ute Moos", "NF", "(6:40)"], ["", "Pia Wald", "NF", "nicht angetreten"],
    ["", "Final", "(2 / 2)", "Time"], ["", "1. und Österreichische Meisterin 2024", "Ida See", "NF", "6:00"], ["", "2.", "Anna Maria Berg", "NF Wien", "AUT", "6:10"],
)


def test_knock_out_page():
    got = brackets.parse_bracket(KNOCK_OUT)
    assert short(got) == [
        ("Viertelfinal A", 2, [(1, "Anna Maria Berg", "NF Wien", "6:21"), (2, "Eva Tal", "OK Jihlava", "6:30")]),
        ("Viertelfinal B", 2, [(1, "Ida See", "", "6:20"), (None, "Ute Moos", "NF", "6:40"), (None, "Pia Wald", "NF", "nicht angetreten")]),
        ("Final", 2, [(1, "Ida See", "NF", "6:00"), (2, "Anna Maria Berg", "NF Wien", "6:10")]),
    ]
    assert [r.get("uncounted") for r in got[1]["results"]] == [False, False, True]
    assert short(layout.dispatched(KNOCK_OUT)) == short(got)


def test_places_over_all_heats(spark):
    rows = [
        (1, "Viertelfinale A", "a", 1, 60), (1, "Viertelfinale A", "b", 2, 61), (1, "Viertelfinale A", "c", 3, 62), (1, "Viertelfinale B", "d", 1, 60), (1, "Viertelfinale B", "e", 2, 61), (1, "Viertelfinale B", "f", 3, 62),
        (1, "Halbfinale", "a", 1, 50), (1, "Halbfinale", "d", 2, 51), (1, "Halbfinale", "e", 3, 52), (1, "Halbfinale", "b", None, None), (1, "A-Final", "d", 1, 40), (1, "A-Final", "a", 2, 41), (1, "B-Final", "e", 1, 39), (1, "Herren 21", "z", 1, 10), (2, "Final", "a", None, None),
    ]
    got = brackets.overall(spark.createDataFrame(rows, "k int, category string, name string, rank int, time_s int"), "k").collect()
    assert sorted((r.k, r.place, r.person, r.heat, r.from_heat) for r in got) == [
        (1, 1, "d", "A-Final", "Halbfinale"), (1, 2, "a", "A-Final", "Halbfinale"), (1, 3, "e", "B-Final", "Halbfinale"), (1, 4, "b", "Halbfinale", "Viertelfinale A"),
        (1, 5, "c", "Viertelfinale A", None), (1, 5, "f", "Viertelfinale B", None), (2, 1, "a", "Final", None),
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 Anna Maria Berg NF Wien 26:21", (1, "Anna Maria Berg", "NF Wien", "26:21")),
        ("2. Eva NF 26:21 +0:05", (2, "Eva", "NF", "26:21")),
        ("Eva von der Tal Orienteering Innsbruck Imst Fehlst.", (None, "Eva von der Tal", "Orienteering Innsbruck Imst", "Fehlst.")),
        ("3 Max Berg Verein der Freunde des Laufs im Wald Nord 1:02:03", (3, "Max Berg", "Verein der Freunde des Laufs im Wald Nord", "1:02:03")),
        ("4 Eva Tal XY Klub 5:00", (4, "Eva Tal", "XY Klub", "5:00")),
        ("Anna Berg 26:21", (None, "Anna Berg", "", "26:21")),
        ("SCHMID Michael NF 26:21", (None, "SCHMID Michael", "NF", "26:21")),
        ("der 2024 lauf 5:00", None),
        ("Anna Berg NF Wien", None),
    ],
)
def test_flow_row(text, want):
    got = flow_row(text, CLUBS)
    assert (got and (got["rank"], got["name"], got["club"], got["time_text"])) == want


def test_flowing_list_without_a_dictionary():
    text = "H 21 (4)\n1 Anna Maria Berg Klub Nord 26:21\n2 Eva Tal Klub Nord 27:00\n1. und Österreichischer Meister\nIda See Klub Süd 28:00\nUte Moos Klub Süd Aufg."
    assert short(layout.parse_flowing(text)) == [("H 21", 4, [(1, "Anna Maria Berg", "Klub Nord", "26:21"), (2, "Eva Tal", "Klub Nord", "27:00"), (1, "Ida See", "Klub Süd", "28:00"), (None, "Ute Moos", "Klub Süd", "Aufg.")])]


@pytest.mark.parametrize(
    ("club", "value", "want"),
    [
        ("INNSBRUCK", "3IM8:S2T8", ("INNSBRUCK IMST", "38:28")),
        ("ORIENTEERING", "INNSBRUCK 3IM8:S2T8", ("Orienteering Innsbruck Imst", "38:28")),
        ("ORIENTEERING", "INNSBRUCKF IeMhSlsTt", ("Orienteering Innsbruck Imst", "Fehlst")),
        ("Naturfreunde Villach", "- Orie1n3te:37,05", ("Naturfreunde Villach - Orienteering", "13:37")),
        ("BG/BRG Zehnergasse", "Wie3n7e:4r0 Neus140", ("BG/BRG Zehnergasse Wiener Neustadt", "37:40")),
        ("Naturfreunde Bad", "Vöslau, 2R9e:j3o9i,00", ("Naturfreunde Bad Vöslau", "29:39")),
        ("HSV OL Wiener", "Neustad Gut", ("HSV OL Wiener Neustadt", "Gut")),
        ("SKV OLG Deutsch Kaltenbr1u:n0n", "2:33", ("SKV OLG Deutsch Kaltenbrunn", "1:02:33")),
        ("Orienteering Klosterneubur", "g Fehlst", ("Orienteering Klosterneuburg", "Fehlst")),
        ("NF Wien", "26:21", None),
        ("Unbekannt", "3IM8:S2T8", None),
        ("NF", "Linz 26:21", None),
    ],
)
def test_letters_drawn_apart(club, value, want):
    assert disentangled(club, value, CLUBS) == want


def test_two_clubs_that_fit_alike_prove_nothing():
    assert disentangled("HSV", "No2r6d:21", Clubs(["HSV Nord", "HSV Nordwest"])) == ("HSV Nord", "26:21")
    assert disentangled("HSV", "N2o6:r21", Clubs(["HSV Nord", "HSV Nort"])) is None


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        (("Kaltenbacher", "Pierre HSV OL Wiener Neustadt", "59:18"), ("Kaltenbacher Pierre", "HSV OL Wiener Neustadt", "59:18")),
        (("Max Mustermann-Ho", "fer OLC Graz", "26:21"), ("Max Mustermann-Hofer", "OLC Graz", "26:21")),
        (("Anna Berg", "NF", "Wien 26:21"), ("Anna Berg", "NF Wien", "26:21")),
        (("Anna Berg NF W", "ien 26:", "21"), ("Anna Berg", "NF Wien", "26:21")),
        (("Anna", "Berg NF Wien Aufg.", ""), ("Anna Berg", "NF Wien", "Aufg.")),
        (("Anna Berg NF", "", "26:21"), ("Anna Berg", "NF", "26:21")),
        (("Anna NF", "", "26:21"), None),
        (("Anna Berg", "NF Wien", "26:21"), None),
        (("Anna Berg", "", "26:21"), None),
        (("Anna Berg", "Unbekannt", "26:21"), None),
    ],
)
def test_cells_cut_anew(cells, want):
    assert resegmented(cells, CLUBS) == want


def test_names():
    assert all(looks_named(x.split()) for x in ("Anna", "Anna Maria Berg", "Eva von der Tal", "O'Neil Mc", "SCHMID Michael", "Müller-Lüdenscheidt"))
    assert not any(looks_named(x.split()) for x in ("", "anna berg", "Anna berg", "A B C D E", "HoFer", "2024 Lauf", "von"))


def page(*lines):
    return [(float(at + 22 * i), 12.0 * n, w) for n, line in enumerate(lines, 1) for at, text in line for i, w in enumerate(text.split())]


def test_two_columns_over_pages():
    one = page([(10, "HA (3)"), (300, "HB (2)")], [(10, "1 Anna Berg NF 26:21"), (300, "1 Ida See NF 20:00")], [(10, "2 Eva Tal OLC Graz 27:00"), (300, "2 Ute Moos OLC Graz 21:00")], [(300, "C (2)")])
    two = page([(10, "3 Max Feld NF 28:00"), (300, "1 Pia Wald NF 22:00")], [(10, "DB (1)"), (300, "2 Uta Rain NF 23:00")], [(10, "1 Ed Bach NF 30:00")])
    got = layout.parse_pages([one, two], clubs=CLUBS)
    assert short(got) == [
        ("HA", 3, [(1, "Anna Berg", "NF", "26:21"), (2, "Eva Tal", "OLC Graz", "27:00"), (3, "Max Feld", "NF", "28:00")]), ("DB", 1, [(1, "Ed Bach", "NF", "30:00")]),
        ("HB", 2, [(1, "Ida See", "NF", "20:00"), (2, "Ute Moos", "OLC Graz", "21:00")]), ("C", 2, [(1, "Pia Wald", "NF", "22:00"), (2, "Uta Rain", "NF", "23:00")]),
    ]
    assert layout.gutter([[(10, 1, "HA"), (30, 1, "(1)")], [(10, 2, "1"), (30, 2, "Anna"), (50, 2, "26:21")]]) is None


def test_dispatch_by_agreement():
    two_blanks = "H 21 (2)\n1 Anna Berg  NF Wien  26:21\n2 Eva Tal  NF  27:00"
    assert short(layout.dispatched(two_blanks)) == [("H 21", 2, [(1, "Anna Berg", "NF Wien", "26:21"), (2, "Eva Tal", "NF", "27:00")])]
    # one blank alone: lines cut at blanks would lose a row, so the flowing reading stands
    mixed = "H 21 (2)\n1 Anna Berg  NF Wien  26:21\n2 Eva Tal NF 27:00"
    assert short(layout.dispatched(mixed, CLUBS)) == short(layout.dispatched(two_blanks))
    separated = "H 21 (1);;;\nPl;Name;Verein;Zeit\n1;Anna Berg;NF Wien;26:21"
    assert short(layout.dispatched(separated)) == [("H 21", 1, [(1, "Anna Berg", "NF Wien", "26:21")])]
    by_class = "Kat;Pl;Name;Verein;Zeit\nH 21;1;Anna Berg;NF Wien;26:21\nD 21;1;Eva Tal;NF;27:00\nH 21;2;Ida See;NF;28:00"
    assert [(c["name"], len(c["results"])) for c in layout.dispatched(by_class)] == [("H 21", 2), ("D 21", 1)]
    assert layout.dispatched("") == layout.dispatched("nothing here") == []


def test_flow_rows_as_a_join(spark):
    lines = ["H 21 (2)", "1 Anna Maria Berg NF Wien 26:21", "2. Eva Tal  Orienteering  Innsbruck Imst Fehlst.", None, "footer", "D (1)", "Max Berg 30:00", "AB Verein der Freunde des Laufs im Wald Nord (31:00)"]
    docs = spark.createDataFrame([(7, i, t) for i, t in enumerate(lines)], "doc int, line int, text string")
    clubs = spark.createDataFrame([(c,) for c in [*KNOWN, None, "", "NF Wien"]], "club string")
    classed = flow_classes(docs, "doc", "line")
    got = flow_rows(classed, clubs, ["doc", "line", "category"]).orderBy("line").collect()
    assert [tuple(r)[1:] for r in got] == [
        (1, "H 21", 1, "Anna Maria Berg", "NF Wien", "26:21"), (2, "H 21", 2, "Eva Tal", "Orienteering Innsbruck Imst", "Fehlst."), (6, "D", None, "Max Berg", "", "30:00"), (7, "D", None, "AB", "Verein der Freunde des Laufs im Wald Nord", "31:00"),
    ]


def test_columns_of_stages():
    from ranklake.sources import html

    assert html.stage_columns(["Pl", "Name", "Zeit 1", "Zeit 2"]) == {1: {"time": 2}, 2: {"time": 3}}
    assert html.stage_columns(["Pl", "Name", "1. Lauf", "Pl 1", "2. Lauf", "Pl 2"]) == {1: {"time": 2, "rank": 3}, 2: {"time": 4, "rank": 5}}
    assert html.stage_columns(["Pl", "Name", "Zeit", "Zeit"]) == {1: {"time": 2}, 2: {"time": 3}}
    assert html.stage_columns(["Pl", "Name", "Zeit"]) == html.stage_columns(["E1", "Name"]) == {}
    page = table(["H 21 (2)"], ["Pl", "Name", "Verein", "E1", "Pl 1", "E2", "Pl 2"], ["1", "Anna Berg", "NF", "10:00", "2", "11:00", "1"], ["2", "Eva Tal", "OL", "9:00", "1", "Aufg.", ""])
    assert [short(c) for c in html.parse_multistage(page)] == [
        [("H 21", 2, [(2, "Anna Berg", "NF", "10:00"), (1, "Eva Tal", "OL", "9:00")])], [("H 21", 2, [(1, "Anna Berg", "NF", "11:00"), (None, "Eva Tal", "OL", "Aufg.")])],
    ]
    assert html.parse_multistage("<table></table>") == [] and html.parse_multistage("<table></table>", 2) == [[], []]


def test_clubs_that_go_on_below():
    text = "H 21 (2)\nPl   Name                Verein        Zeit\n1    Anna Berg           Laufklub      26:21\n                         Kompass\n2    Eva Tal             OL Ost        27:00\n"
    assert short(layout.parse_text(text)) == [("H 21", 2, [(1, "Anna Berg", "Laufklub Kompass", "26:21"), (2, "Eva Tal", "OL Ost", "27:00")])]
