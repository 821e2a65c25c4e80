"""Rules of texts over composed texts: every row of a table puts its text together from parts and numbers of its own.

A part comes with what a rule must see in it (a gender, a region, whether it marks a title). The SQL
decides from these and from the table's numbers, never from the text, so a pattern that sees too
much or too little in any combination shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import units as U
from .queries import QUERIES, SQL
from .rule_queries import quoted
from .tables import read

#: A part that is the row's size, 1 to 50.
SIZE = "size"


def composed(name: str, parts: list, rule: Callable[[Column], Column], sql: str, kind: str = "VARCHAR") -> None:
    """Register a rule over all parts: their texts run together, each picked by another digit of the key.

    parts: lists of (text, a, b), or SIZE. sql gives the expected value from a0, b0, a1, b1 and so on
    (of the lists, in order), t0, t1 (their texts), size and key.
    """
    lists = [p for p in parts if p != SIZE]

    def run(spark, sf):
        pieces, step = [], 1
        for p in parts:
            if p == SIZE:
                pieces.append(F.col("p_size").cast("string"))
                continue
            at = F.expr(f"cast(p_partkey div {step} % {len(p)} as int) + 1")
            pieces.append(F.element_at(F.array(*[F.lit(x[0]) for x in p]), at))
            step *= len(p)
        return read(spark, sf, "part").select("p_partkey", rule(F.concat(*pieces)).alias("value"))

    tables, joins, step = [], [], 1
    for i, p in enumerate(lists):
        rows = ", ".join(f"({j}, " + ", ".join(quoted(v) for v in (*x, None, None)[:3]) + ")" for j, x in enumerate(p))
        tables.append(f"c{i}(i{i}, t{i}, a{i}, b{i}) AS (VALUES {rows})")
        joins.append(f"JOIN c{i} ON i{i} = p_partkey // {step} % {len(p)}")
        step *= len(p)
    QUERIES[name] = run
    SQL[name] = f"WITH {', '.join(tables)} SELECT p_partkey, CAST({sql} AS {kind}) AS value FROM (SELECT *, p_size AS size FROM part) {' '.join(joins)}"


# classes -------------------------------------------------------------------------------------------

#: Genders, with their letter, and whether they are spelled out.
_GENDERS = [("Damen", "d", True), ("herren", "h", True), ("D", "d", False), ("h", "h", False), ("Offen", None, True)]
_AGES = [(" bis ", "upto"), (" ab ", "from"), ("-", "plain"), (" ", "plain")]
_ENDS = [("", ""), (" Elite", "e"), (" lang", "lang")]

composed(
    "t12_composed_keys", [_GENDERS, _AGES, SIZE, _ENDS], T.category_key,
    # a number directly behind the letter is an age; behind a spelled gender only `bis` and `ab` say so
    "CASE WHEN a0 IS NOT NULL AND (a1 <> 'plain' OR NOT b0) THEN a0 || size::VARCHAR || CASE WHEN a2 = 'e' THEN 'e' ELSE '' END WHEN a0 IS NOT NULL AND a2 = 'e' THEN a0 || '21e' "
    "ELSE lower(t0) || trim(replace(t1, '-', '')) || size::VARCHAR || CASE a2 WHEN 'e' THEN 'elite' ELSE a2 END END",
)
composed(
    "t31_composed_names", [[("D", "Damen"), ("H", "Herren"), ("X", None)], [("", 0), ("-", 1), (" ", 0), (" - ", 1)], SIZE, [("", 0), ("-", 1)], [("", 0), ("E", 1), (" E", 1)]], T.class_name,
    "CASE WHEN a0 IS NULL THEN t0 || t1 || size::VARCHAR || t2 || t3 ELSE a0 || CASE WHEN a1 = 1 THEN ' bis ' WHEN a2 = 1 OR a3 = 1 THEN ' ab ' ELSE ' ' END || size::VARCHAR || CASE WHEN a3 = 1 THEN ' Elite' ELSE '' END END",
)
composed(
    "t39_composed_bases", [[("Damen", "women"), ("d", "women"), ("HERREN", "men"), ("H", "men"), ("Dame", None), ("Hobby", None)], [(" ",), ("-",), (" - ",)], SIZE, [(" E",), ("",), (" kurz",)]],
    lambda x: F.concat_ws("|", T.gender_base(x)["gender"], T.gender_base(x)["base"]),
    "CASE WHEN a0 IS NOT NULL THEN a0 || '|' || size::VARCHAR || t2 ELSE t0 || t1 || size::VARCHAR || t2 END",
)
composed(
    "t41_composed_groups", [[("", 0), ("ab ", 1), ("Damen ab ", 1), ("bis ", 0), ("H-", 0)], SIZE, [("", 0), ("-", 1), (" Elite", 0), (" - ", 1)]], T.age_group,
    "CASE WHEN a0 = 1 OR a1 = 1 THEN CASE WHEN size >= 21 THEN 'senior' END WHEN size <= 20 THEN 'youth' END",
)

# titles and regions --------------------------------------------------------------------------------

_WORDS = [("",), ("Lauf ",), ("Sprint & ",), ("MTBO ",)]
#: Marks of titles: whether they say ÖM, and ÖSTM.
_TITLES = [
    ("ÖM", 1, 0), ("ÖSTM", 0, 1), ("ö(st)m", 1, 1), ("Österr. Meisterschaft", 1, 0), ("Österreichische Meisterschaften", 1, 0), ("Staatsmeisterschaft", 0, 1), ("OESTM", 0, 1), ("oem", 1, 0),
    ("Wiener Meisterschaft", 0, 0), ("LÖM", 0, 0), ("Meisterschaft", 0, 0), ("ÖMV Cup", 0, 0),
]
composed(
    "t15_composed_titles", [_WORDS, _TITLES, [(" ",), (" 20",)], SIZE, [("",), (" Nacht",)]], lambda x: F.array_join(T.title_championships(x), "+"),
    "concat_ws('+', CASE WHEN a1 = 1 THEN 'ÖM' END, CASE WHEN b1 = 1 THEN 'ÖSTM' END)",
)
_REGIONS = [
    ("Wiener", "WIEN", 1), ("NÖ", "NOE", 2), ("niederösterreichische", "NOE", 2), ("Burgenland", "BGLD", 3), ("steirischer", "STMK", 4), ("Stmk.", "STMK", 4), ("OÖ", "OOE", 5), ("Salzburger", "SBG", 6), ("Tiroler", "TIR", 7),
    ("Kärntner", "KTN", 8), ("Vorarlberg", "VBG", 9), ("Wiener Neustadt", None, 0), ("Tirolina", None, 0), ("Union", None, 0),
]
_TWO = "CASE WHEN a0 IS NULL AND a1 IS NULL THEN '' WHEN a0 IS NULL THEN a1 WHEN a1 IS NULL OR a0 = a1 THEN a0 WHEN b0 < b1 THEN a0 || '+' || a1 ELSE a1 || '+' || a0 END"
composed("t17_composed_regions", [_REGIONS, [(f" und {t}", a, b) for t, a, b in _REGIONS], [(" LM ",), (" Meisterschaft ",), (", ",)], SIZE], lambda x: F.array_join(T.regions(x), "+"), _TWO)
composed(
    "t24_composed_champions", [[("1. und ",), ("Die ",), ("",)], [("Österr. Meister", "ÖM"), ("österreichische Meisterin", "ÖM"), ("Staatsmeister", "ÖSTM"), ("ÖSTM", "ÖSTM"), ("ÖM", "ÖM"), ("Niederösterreichischer Meister", None), ("Vereinsmeister", None)], [(" 20",), (" ",)], SIZE],
    T.championship_of, "a1",
)

# clubs and names -----------------------------------------------------------------------------------

_LETTERS = [("ä", "a"), ("Ö", "o"), ("ß", "ss"), ("é", "e"), ("č", "c"), ("X", "x")]
composed(
    "t7_composed_keys", [[("OC ", "oc"), ("NF-", "nf"), ("Klub. ", "klub")], _LETTERS, _LETTERS, [("rn ",), ("RN/",)], SIZE], T.club_key,
    "a0 || a1 || a2 || 'rn' || size::VARCHAR",
)
composed(
    "t5_composed_clubs", [[("empty ", 1), ("Leer ", 1), ("frei  ", 1), (". ", 1), ("Freistadt ", 0), ("Emptyx ", 0), ("", 0)], [("NF ",), ("OLC ",)], SIZE, [("",), (" ",), ("\t",)]], T.clean_club,
    "CASE WHEN a0 = 1 THEN '' ELSE t0 END || t1 || size::VARCHAR",
)
composed(
    "t11_composed_orders", [[("Novaková", 1), ("Berg", 0), ("PROKOPOVA", 1)], [(" ",), ("  ",), (" Eva ",)], [("Petra", 0), ("Dvořáková", 1), ("Ida", 0)]], T.reordered,
    "CASE WHEN t1 <> ' Eva ' AND a0 = 1 AND a2 = 0 THEN t2 || ' ' || t0 ELSE t0 || t1 || t2 END",
)
composed(
    "t33_composed_junk", [[("Etappe ", 1), ("Results (stage ", 1), ("Anna ", 0), ("", 2), ("(", 2)], SIZE, [("",), (":30",), (")",)]], T.is_junk_name,
    "a0 > 0", "BOOLEAN",
)
composed(
    "u8_composed_pairs", [[("Anna-Eva", 1), ("Anna", 0)], [(" Berg",)], [("-Tal", 1), ("", 0)]], lambda x: F.array_join(U.hyphen_pair(x), " + "),
    "CASE WHEN a0 = 1 AND a2 = 1 THEN 'Anna Berg + Eva Tal' END",
)
composed(
    "u7_composed_pairs", [[("Anna", 0), ("Max Berg", 1)], [(" / ",), (" & ",), (" + ",)], [("Eva Tal",), ("Ida Moos",)]], lambda x: F.array_join(U.pair_names(x), " + "),
    "CASE WHEN a0 = 1 THEN t0 ELSE t0 || ' ' || split_part(t2, ' ', 2) END || ' + ' || t2",
)

# times, years, ids ---------------------------------------------------------------------------------

composed(
    "m2_composed_times", [[("", 1), ("Zeit ", 1), ("-", 0), ("  ", 1), (" -", 0), ("(", 1)], [("", 0), ("1:", 1), ("12:", 12)], [("07", 7), ("30", 30)], [(":",)], [("05", 5), ("59", 59)], [("",), (" (*)",), (" +1:00",)]], N.parse_time_loose,
    "CASE WHEN a0 = 1 THEN a1 * 3600 + a2 * 60 + a4 END", "INT",
)
composed(
    "t28_composed_brackets", [[("(", 1), ("( ", 1), ("", 0)], SIZE, [(":05", 1), (":59:00", 1), ("", 0)], [(")", 1), (" )", 1), ("", 0), (") x", 0)]], T.is_ooc_time,
    "a0 = 1 AND a1 = 1 AND a2 = 1", "BOOLEAN",
)
composed("t27_composed_marks", [[("",), (" ",)], [("AK", 1), ("a.k.", 1), ("Außer Konkurrenz", 1), ("ausser konkurrenz", 1), ("OHNE WERTUNG", 1), ("wertungsfrei", 1), ("Bank", 0), ("mit Wertung", 0), ("12:30", 0)], [("",), (" ",)]], T.is_ooc_text, "a1 = 1", "BOOLEAN")
composed("m3_composed_durations", [SIZE, [(":07", 7), (":59", 59)], [(":00", 0), ("", 1), (":01", 2)]], N.sheet_duration, "CASE WHEN a1 < 2 THEN size * 60 + a0 ELSE size * 3600 + a0 * 60 + 1 END", "INT")
composed("m16_composed_ids", [[("", 1), (" ", 1), ("-", -1), ("x", None)], SIZE, [("", 1), ("00", 100), (" ", 1), ("a", None)]], N.user_id, "a0 * size * a1", "BIGINT")
composed("t44_composed_years", [[("19", 1900), ("18", 1800), ("2", 200), ("x", None)], [("0", 0), ("5", 5)], [("0", 0), ("1", 1), ("7", 7)]], N.clean_year, "CASE WHEN a0 = 200 THEN NULL WHEN a0 + a1 * 10 + a2 NOT IN (1900, 1901) THEN a0 + a1 * 10 + a2 END", "INT")
composed(
    "m17_composed_years", [[("Anna B",), ("Eva C ",)], [(" (", 1), (" ", 0), ("  (", 1)], [("19", 1), ("9", 0)], [("87",), ("03",)], [(")", 1), ("", 0)]], lambda x: F.concat_ws("|", N.name_and_year(x)["name"], N.name_and_year(x)["year"].cast("string")),
    "CASE WHEN a1 = 1 AND a2 = 1 AND a4 = 1 THEN trim(t0) || '|' || t2 || t3 ELSE t0 || t1 || t2 || t3 || t4 END",
)

# documents -----------------------------------------------------------------------------------------

_KINDS = [("ergebnis", "result"), ("results", "result"), ("gesamtwertung", "result"), ("notiz", None), ("meisterschaftswertung", "ranking")]
_SPOILS = [("", 0), ("-split", 1), ("-zwischenzeiten", 1), ("_startliste", 1), ("-einladung", 1)]
composed("f20_composed_attachments", [_KINDS, _SPOILS, SIZE, [(".pdf",), (".HTML",)]], T.is_result_attachment, "coalesce(a0, '') = 'result' AND a1 = 0", "BOOLEAN")
composed("f21_composed_rankings", [[("Meisterschafts", 1), ("meister", 0)], [("-wertung", 1), ("_Wertung", 1), (" wertung", 1), ("-liste", 0)], _SPOILS[:2], SIZE], T.is_ranking_attachment, "a0 = 1 AND a1 = 1 AND a2 = 0", "BOOLEAN")
composed("f7_composed_documents", [[("erg", 0), ("x-split", 1), ("results-after-e", 2)], SIZE, [(".html",), (".pdf",)]], T.is_junk_document, "a0 = 2", "BOOLEAN")
composed("f13_composed_lists", [[("Bahn ", 1), ("BAHN", 1), ("Herren Bahn ", 0), ("Viertelfinale ", 2), ("1. Halbfinale ", 2), ("B-Finale ", 2), ("A-Finale ", 0)], SIZE], lambda x: T.is_course_list(x) | T.is_heat(x), "a0 > 0", "BOOLEAN")
composed(
    "t16_composed_stages", [[("Weekend",), ("",)], [(" - Ergebnis", 1), (" - Ergebnis nach Klassen", 1), (" - Liste", 0)], [(" - ÖM Nacht ",), ("",)]], T.stage_title,
    "CASE WHEN a1 = 1 THEN nullif(CASE WHEN t2 <> '' THEN 'ÖM Nacht' ELSE t0 END, '') END",
)


#: Names and heads of documents, and what each is to the ladder of kinds.
_FILES = [("erg", "none"), ("si_log", "si"), ("lauf-bericht", "report"), ("zwischenzeiten", "split"), ("einzel", "individual"), ("wiener-wertung", "city"), ("meisterschafts_wertung", "title"), ("staffel", "relay"), ("gesamt", "sum"), ("endergebnis 2. lauf", "sum")]
_HEADS = [
    ("", "none"), ("Pl Stnr Name X Verein Kat Zeit", "labels"), ("Pl Name Verein Zeit", "labels"), ("ERGEBNISSE SURPISE MANNSCHAFT\n und TEAMWERTUNG", "labels"), ("Zwischenzeiten", "split"), ("<th>N1</th><th> n2 </th>", "controls"), ("<th>N1</th>", "none"),
    ("<th class=a>Staffel</th>", "relay"), ("<th>Team</th><th>Leg</th>", "relay"), ("<th>Team</th>", "none"), ("Gesamtwertung", "sum"), ("Overall results", "sum"), ("Endergebnis nach dem 3. Lauf", "sum"), ("x" * 4000 + " Gesamtwertung", "none"),
]
_LADDER = """CASE WHEN h = 'labels' THEN 'race' WHEN f = 'si' AND NOT sole THEN 'overall' WHEN f = 'report' THEN 'overall' WHEN f = 'split' OR h = 'split' THEN 'overall' WHEN h = 'controls' THEN 'overall'
  WHEN f IN ('individual', 'city', 'title') THEN 'race' WHEN f = 'relay' OR h = 'relay' THEN 'relay' WHEN (f = 'sum' OR h = 'sum') AND NOT sole THEN 'overall' ELSE 'race' END"""


def t30_composed_ladder(spark, sf):
    k = F.col("p_partkey")
    pick = lambda values, step: F.element_at(F.array(*[F.lit(v[0]) for v in values]), F.expr(f"cast(p_partkey div {step} % {len(values)} as int) + 1"))
    name = F.concat(pick(_FILES, 1), F.lit("_"), F.col("p_size").cast("string"), F.lit(".html"))
    return read(spark, sf, "part").select("p_partkey", T.list_type(name, pick(_HEADS, len(_FILES)), k % 3 == 0).alias("value"))


QUERIES["t30_composed_ladder"] = t30_composed_ladder
SQL["t30_composed_ladder"] = (
    f"WITH a(i, f) AS (VALUES {', '.join(f'({i}, {quoted(x[1])})' for i, x in enumerate(_FILES))}), b(j, h) AS (VALUES {', '.join(f'({i}, {quoted(x[1])})' for i, x in enumerate(_HEADS))}) "
    f"SELECT p_partkey, {_LADDER} AS value FROM (SELECT p_partkey, f, h, p_partkey % 3 = 0 AS sole FROM part JOIN a ON i = p_partkey % {len(_FILES)} JOIN b ON j = p_partkey // {len(_FILES)} % {len(_HEADS)})"
)
