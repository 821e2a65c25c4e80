"""Rules of texts, registers and reviews over whole benchmark tables: every row takes one of the forms that a rule tells apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import numbers as N
from ..functions import text as T
from ..operators import championship as C
from ..operators import dedup as D
from ..operators import evidence as EV
from ..operators import filters as FI
from ..operators import history as H
from ..operators import identity as E
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import regional as RG
from ..operators import units as U
from ..operators.lineage import new_folder
from ..operators.ordering import numbered
from ..sources import html, layout, readers, writers
from . import views as V
from .queries import QUERIES, SQL, query
from .tables import R, read, results
from .view_queries import _tables


def quoted(x) -> str:
    if x is None:
        return "NULL"
    return str(x) if isinstance(x, (bool, int, float)) else "'" + str(x).replace("'", "''") + "'"


def in_turn(forms: list, key: str) -> Column:
    """One of the forms for each key, in turn."""
    return F.element_at(F.array(*map(F.lit, forms)), (F.col(key) % len(forms) + 1).cast("int"))


def forms(name: str, f: Callable[[Column], Column], cases: list[tuple], kind: str = "VARCHAR") -> None:
    """Register f over all parts, each with one of the cases' texts; the SQL says what each text must give."""

    def run(spark, sf):
        return read(spark, sf, "part").select("p_partkey", f(in_turn([c[0] for c in cases], "p_partkey")).alias("value"))

    rows = ", ".join(f"({i}, {quoted(c[1])})" for i, c in enumerate(cases))
    QUERIES[name] = run
    SQL[name] = f"WITH v(i, want) AS (VALUES {rows}) SELECT p_partkey, CAST(want AS {kind}) AS value FROM part JOIN v ON i = p_partkey % {len(cases)}"


# texts -------------------------------------------------------------------------------------------

forms("t4_mojibake", T.mojibake_repaired, [("MÃ¼ller", "Müller"), ("Müller", "Müller"), ("Ã ok", "Ã ok"), ("KÃ¤rnten Â½", "Kärnten ½"), ("plain", "plain")])
forms("t2_clean_name_rules", T.clean_name, [("#NAME? Anna B", "Anna B"), ("A.K. Eva C", "Eva C"), ("AK Eva C", "Eva C"), ("(note) Ida D", "Ida D"), ("8 Robert E", "Robert E"), ("1Löwenstein", "Löwenstein"), ("A lexander Grill", "Alexander Grill"), ("\tplain ", "plain"), ("MÃ¼ller Ute", "Müller Ute")])
forms("t5_clean_club_rules", T.clean_club, [("empty NF Wien", "NF Wien"), ("Leer OL Ost", "OL Ost"), ("vacant  X", "X"), ("frei Y", "Y"), (". OL Ost", "OL Ost"), ("Freistadt OL", "Freistadt OL"), (" Klub\t", "Klub")])
forms("t7_club_keys", T.club_key, [("OLG Groß", "olggross"), ("OLG GROSS", "olggross"), ("Óc-Fürst. 1", "ocfurst1"), ("", ""), ("NF Wien", "nfwien")])
forms("t8_relay_club_keys", T.relay_club_key, [("Naturfreunde Wiener Neustadt", "nfwrneust"), ("Laufklub Kompass Innsbruck", "lkinnsbruck"), ("ASKÖ Henndorf Orienteering", "ahdo"), ("NF Kitzbühl", "nfkitzbuhel"), ("OL Graz Oriente", "graz"), ("OC Fürstenfeld", "ocff")])
forms("t9_component_match", lambda x: T.component_matches(x, F.lit("nfwien")), [("nfwien", True), ("nfwie", True), ("nfwi", False), ("nfwien2", True), ("olost", False), ("", False)], "BOOLEAN")
forms("t10_order_signal", lambda x: T.order_signal(F.split_part(x, F.lit(" "), F.lit(1)), F.split_part(x, F.lit(" "), F.lit(2))), [("Novaková Petra", 1), ("Petra Novaková", -1), ("Anna Berg", 0), ("Nová Dvořáková", 0)], "INT")
forms("t11_reordered", T.reordered, [("Novaková Petra", "Petra Novaková"), ("Petra Novaková", "Petra Novaková"), ("Anna Berg", "Anna Berg"), ("Eva Maria Novaková", "Eva Maria Novaková")])
forms("t12_category_keys", T.category_key, [("D21E", "d21e"), ("Damen ab 21 Elite", "d21e"), ("H-14", "h14"), ("Herren bis 12", "h12"), ("Herren", "h21e"), ("Damen Elite", "d21e"), ("Offen Lang", "offenlang"), ("", "")])
forms("t13_regional_keys", RG.regional_key, [("D19 A", "d19a"), ("H21-B-", "h21b"), ("D45", "d45"), ("H 40", "h40"), ("Herren bis 12", "h12")])
forms("t15_title_types", lambda x: F.array_join(T.title_championships(x), "+"), [("ÖSTM & ÖM Lang", "ÖM+ÖSTM"), ("Ö(ST)M", "ÖM+ÖSTM"), ("ÖM Nacht", "ÖM"), ("Wiener Meisterschaft", ""), ("Österr. Meisterschaft", "ÖM"), ("Staatsmeisterschaft Sprint", "ÖSTM"), ("OESTM", "ÖSTM"), ("oem Mittel", "ÖM"), ("", "")])
forms("t16_stage_titles", T.stage_title, [("Weekend - Ergebnis - ÖM Nacht", "ÖM Nacht"), ("ÖM Mittel 2016 - Ergebnis", "ÖM Mittel 2016"), ("Lauf", None)])
forms("t17_regions", lambda x: F.array_join(T.regions(x), "+"), [("Wiener Neustadt", ""), ("Wiener MS", "WIEN"), ("NÖ und Steiermark", "NOE+STMK"), ("Burgenländische LM", "BGLD"), ("OÖ Meisterschaft", "OOE"), ("Salzburger MS", "SBG"), ("Tirolerische", "TIR"), ("Kärntner LM", "KTN"), ("Vorarlberg", "VBG"), ("Landesmeister", "")])
forms("t18_compact_regions", lambda x: F.array_join(T.compact_regions(x), "+"), [("W D-14", "WIEN"), ("D45-W", "WIEN"), ("D19ST", "STMK"), ("H35(W,NÖ)", "WIEN"), ("H19 N", "NOE"), ("D40-(St,B)", "STMK+BGLD"), ("W -14", ""), ("D-14", "")])
forms("t19_segments", lambda x: F.array_join(RG.segments(x), " | "), [("D40-(St,B)/D45-(NÖ,W)", "D40-(St,B) | D45-(NÖ,W)"), ("D19-Bgld/NÖ", "D19-Bgld/NÖ"), ("H35", "H35"), ("Damen 12/Herren 12", "Damen 12 | Herren 12"), ("", "")])
forms("t21_city_titles", RG.is_city_candidate, [("Wiener Meisterschaft", True), ("Wiener Neustädter Meisterschaft", False), ("Wien Schulmeisterschaft", False), ("Lauf in Wien", False), ("LM Wien", True), ("LM Steiermark", False)], "BOOLEAN")
forms("t20_canonical_classes", lambda x: RG.canonical_category(x, F.array(F.lit("STMK"), F.lit("BGLD")), F.array(F.lit("STMK"), F.lit("BGLD"))), [("D40-(St,B)", "D40"), ("Damen 40 Steiermark", "D 40"), ("ST H 21", "H 21"), ("D35 B", "D35"), ("Damen + Herren 12", "DH 12"), ("H21", "H21")])
forms("t23_champion_notes", lambda x: F.concat_ws(":", T.champion_annotation(x)["rank"].cast("string"), T.champion_annotation(x)["championship"]), [("1. und Österr.Meister 2022", "1:ÖM"), ("1 Österreichischer Staatsmeister", "1:ÖSTM"), ("1 und österr. Meister 31 NF 53:04", ""), ("Anna", "")])
forms("t24_championship_of", T.championship_of, [("Österr. Meister 2022", "ÖM"), ("Staatsmeisterin", "ÖSTM"), ("Niederösterreichischer Meister", None), ("und ÖM", "ÖM"), ("ÖSTM", "ÖSTM")])
forms("t25_stripped_champion", lambda x: F.concat_ws("|", T.stripped_champion(x)["name"], T.stripped_champion(x)["championship"]), [("Österr. Staatsmeister Andreas W", "Andreas W|ÖSTM"), ("Österreichischer Meister Max B", "Max B|ÖM"), ("Anna B", "Anna B")])
forms("t27_ooc_texts", T.is_ooc_text, [("AK", True), ("a.k.", True), ("außer Konkurrenz", True), ("wertungsfrei", True), ("NC", True), ("Bank", False), ("ohne Wertung", True), ("12:30", False)], "BOOLEAN")
forms("t28_ooc_times", T.is_ooc_time, [("(39:58)", True), ("( 1:02:33 )", True), ("39:58", False), ("(39)", False)], "BOOLEAN")
forms("t31_class_names", T.class_name, [("D21E", "Damen ab 21 Elite"), ("H-14", "Herren bis 14"), ("D35-", "Damen ab 35"), ("H 12", "Herren 12"), ("Open", "Open")])
forms("t32_person_like", T.looks_like_person, [("Anna Šimková", True), ("Anna 3", False), ("a b c d e", False), ("O'Neil", True), ("", False), ("Jean-Luc St. Claire", True)], "BOOLEAN")
forms("t33_junk_names", T.is_junk_name, [("", True), ("12:30 (4)", True), ("Etappe 3", True), ("Bib. Name", True), ("Results (stage 1)", True), ("mit weniger", True), ("Austria Cup", True), ("Anna Berg", False)], "BOOLEAN")
forms("t39_gender_base", lambda x: F.concat_ws("|", T.gender_base(x)["gender"], T.gender_base(x)["base"]), [("Damen 21 Elite", "women|21 Elite"), ("H-14", "men|14"), ("D 35", "women|35"), ("Offen", "Offen"), ("Hobby", "Hobby")])
forms("t41_age_groups", T.age_group, [("D-14", "youth"), ("H35-", "senior"), ("ab 45", "senior"), ("H 21", None), ("Elite", None), ("H 18", "youth"), ("ab 15", None)])
forms("t42_regional_labels", lambda x: T.regional_label(F.lit("NOE"), x), [("D 14", "NÖ Damen -14"), ("H 45", "NÖ Herren 45-"), ("H21 E", "NÖ Herren 21 Elite"), ("DH -12", "NÖ Damen und Herren -12"), ("Offen", "NÖ Offen"), ("D", "NÖ Damen")])
forms("t44_clean_years", N.clean_year, [("1900", None), ("1901", None), ("1987", 1987), ("x", None), ("2150", None)], "INT")
forms("t45_qualitative", T.qualitative, [("gut", True), ("sehr gut", True), ("erfolgreich teilgenommen", True), ("teilg", True), ("12:30", False), ("gute Zeit", False)], "BOOLEAN")
forms("f4_placeholders", T.is_relay_placeholder, [("N.N.", True), ("n n", True), ("N.N. N ang", True), ("NN NN", True), ("Nina N", False), ("", False)], "BOOLEAN")
forms("f5_family_forms", T.family_class, [("Familie", "family"), ("F", "ambiguous"), ("AT-F", "ambiguous"), ("Rahmenbewerb Familie", "family"), ("fam.", "family"), ("H 21", "ordinary"), (" Family ", "family")])
forms("f7_junk_documents", T.is_junk_document, [("x-split.html", True), ("results-after-e3.html", True), ("erg.html", False), ("split.html", False)], "BOOLEAN")
forms("f13_course_lists", lambda x: T.is_course_list(x) | T.is_heat(x), [("Bahn 3", True), ("bahn lang", True), ("Viertelfinale 2", True), ("B-Finale", True), ("Herren 21", False)], "BOOLEAN")
forms("f14_open_classes", T.open_eligible, [("D-12", True), ("H-10", False), ("D21E", False), ("Damen bis 16 Elite", True), ("Bahn 3", False), ("Allgemein", True), ("Mixed Jugend", True), ("Neulinge", False), ("H 21 Kurz", False), ("D35-", True), ("CZ-H21", False)], "BOOLEAN")
forms("f15_state_classes", T.state_eligible, [("D21E", True), ("Damen bis 16 Elite", False), ("H19-", True), ("H-20", False), ("Allgemeine Klasse", True), ("Staatsmeisterschaft", True), ("D35-", False), ("Hobby", False), ("H 21", True)], "BOOLEAN")
forms("f20_result_attachments", T.is_result_attachment, [("ergebnisliste.pdf", True), ("ergebnis-split.html", False), ("results.html", True), ("startliste.pdf", False), ("oem_sprint_erg.html", True), ("gesamtwertung.pdf", True), ("einladung-ergebnis.pdf", False)], "BOOLEAN")
forms("f21_ranking_attachments", T.is_ranking_attachment, [("meisterschaftswertung.pdf", True), ("Meisterschafts_Wertung.html", True), ("meisterschafts-wertung-split.html", False), ("wertung.pdf", False)], "BOOLEAN")
forms("f22_other_attachments", T.is_auxiliary_attachment, [("bericht.pdf", True), ("zwischenzeiten.html", True), ("bahnen.pdf", True), ("bahndaten.pdf", True), ("erg-bahnen.html", True), ("ergebnis.html", False)], "BOOLEAN")
forms("m2_loose_times", N.parse_time_loose, [("19:24 (*)", 1164), ("-32:10", None), ("Zeit 22:46 (+)", 1366), ("1:02:33", 3753), (" 26:21", 1581), ("x", None), ("", None)], "INT")
forms("m3_sheet_durations", N.sheet_duration, [("32:10:00", 1930), ("26:21", 1581), ("1:02:33", 3753), ("x", None)], "INT")
forms("m16_user_ids", N.user_id, [("12", 12), (" 7 ", 7), ("", None), ("x", None), ("-5", -5)], "BIGINT")
forms("m17_names_and_years", lambda x: F.concat_ws("|", N.name_and_year(x)["name"], N.name_and_year(x)["year"].cast("string")), [("Anna B (1990)", "Anna B|1990"), ("Eva C", "Eva C"), ("Ida (x)", "Ida (x)")])
forms("u8_hyphen_pairs", lambda x: F.array_join(U.hyphen_pair(x), " + "), [("Anna-Eva Berg-Tal", "Anna Berg + Eva Tal"), ("Anna Berg", None), ("Anna-Eva Berg", None)])
forms("u7_pair_names", lambda x: F.array_join(U.pair_names(x), " + "), [("Anna Berg / Eva Tal", "Anna Berg + Eva Tal"), ("Anna & Eva Tal", "Anna Tal + Eva Tal"), ("Anna Berg Eva Tal", "Anna Berg + Eva Tal"), ("Anna Berg + Ida Moos", "Anna Berg + Ida Moos"), ("Anna Berg", None)])


# every phrase of the ladder, in three dresses; the SQL asks the phrases in order
_PHRASES = [d.replace("?", k) for k in X.STATUS_PHRASES for d in ("?", "  ?. ", "x ? y")] + ["Nr.10 fehlt", "Posten 54 falsch", "Slovakia", "12:30", ""]
_KEYS = ", ".join(f"({i}, {quoted(k)}, {quoted(v)})" for i, (k, v) in enumerate(X.STATUS_PHRASES.items()))
_TEXTS = ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(_PHRASES))


@query(rf"""WITH k(o, key, status) AS (VALUES {_KEYS}), t(i, x) AS (VALUES {_TEXTS}), n AS (SELECT i, rtrim(lower(trim(x)), '.') AS x FROM t)
, hit AS (SELECT i, arg_min(status, o) AS status FROM n JOIN k ON CASE WHEN length(key) > 3 THEN contains(x, key) ELSE regexp_matches(x, '(^|[^\pL\pN_])' || replace(key, '.', '\.') || '($|[^\pL\pN_])') END GROUP BY i)
, v AS (SELECT n.i, CASE WHEN regexp_matches(x, '(^|[^\pL\pN_])(nr\.?\s*\d+|posten\s*\d*)\s+(fehlt|falsch)($|[^\pL\pN_])') THEN 'mp' ELSE status END AS parsed FROM n LEFT JOIN hit USING (i))
SELECT p_partkey, parsed FROM part JOIN v ON i = p_partkey % {len(_PHRASES)}""")
def t26_every_phrase(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.parse_status(in_turn(_PHRASES, "p_partkey")).alias("parsed"))


_RAW = ["ok", "nc", "AK", "ohne Wertung", "außer konkurrenz", "(12:30)", "omt.", "n. ang", "ang", "missing punch", "3 Posten fehlen", "Ziel fehlt", "not finished", "verletzt", "dis.", "teilgenommen", "weird", ""]
_ST = ["ok", "dnf", "unknown", "nc", "weird", None]


@query(rf"""WITH t(i, raw) AS (VALUES {", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(_RAW))}), s(j, st) AS (VALUES {", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(_ST))})
, x AS (SELECT p_partkey, trim(raw) AS r, st, p_partkey % 7 = 0 AS flag FROM part JOIN t ON i = p_partkey % {len(_RAW)} JOIN s ON j = p_partkey % {len(_ST)})
, y AS (SELECT *, flag OR regexp_matches(r, '(?i)^(ak|au(ß|ss)er konkurrenz|ohne wertung|wertungsfrei)$') OR regexp_matches(r, '^\(\s*\d{{1,3}}:\d{{2}}(:\d{{2}})?\s*\)$') OR coalesce(lower(st) = 'nc', false) OR lower(r) = 'nc' AS ooc,
  CASE WHEN st IN ('ok', 'dnf', 'dsq', 'mp', 'dns') THEN st WHEN regexp_matches(r, '(?i)^(omt\.?|(n\.?\s*)?ang\.?)$') THEN 'dns' WHEN regexp_matches(r, '(?i)^(missing\s+punch|\d+\s+posten\s+fehl(t|en)|ziel\s+fehlt)$') THEN 'mp' WHEN regexp_matches(r, '(?i)^(not\s+finish(ed)?|verletzt)$') THEN 'dnf' WHEN regexp_matches(r, '(?i)^dis\.?$') THEN 'dsq' WHEN lower(r) = 'teilgenommen' THEN 'ok' ELSE 'unknown' END AS st2 FROM x)
SELECT p_partkey, CASE WHEN ooc AND st2 = 'unknown' THEN 'ok' ELSE st2 END AS status, ooc FROM y""")
def t29_every_form(spark, sf):
    p = read(spark, sf, "part")
    s = T.normalized_status(in_turn(_ST, "p_partkey"), in_turn(_RAW, "p_partkey"), F.col("p_partkey") % 7 == 0)
    return p.select("p_partkey", s["status"].alias("status"), s["ooc"].alias("ooc"))


_NAMES = ["erg.html", "erg-staffel.html", "splits.html", "gesamt.html", "si_log.html", "bericht.pdf", "einzel.html", "wiener-wertung.html", "meisterschafts_wertung.pdf", "oe-stm.html", "endergebnis 2. lauf.html", "zwischenzeiten.html", "ergebnis-bahnen.html", "relay.html"]
_HEADS = ["", "Pl Stnr Name X Verein Kat Zeit", "Pl Name Verein Zeit", "ERGEBNISSE SURPISE MANNSCHAFT\n und TEAMWERTUNG", "Zwischenzeiten", "<th>N1</th><th> n2 </th>", "<th>N1</th>", "<th class=a>Staffel</th>", "<th>Team</th><th>Leg</th>", "Gesamtwertung", "Overall results", "Endergebnis nach dem 3. Lauf", "x" * 4000 + " Gesamtwertung"]


def _list_type_sql() -> str:
    part = {"name": "f", "text": "t", "head": "substr(t, 1, 4000)"}
    plain = lambda p: p.replace("(?iusU)", "(?is)").replace("(?iuU)", "(?i)").replace("(?iu)", "(?i)").replace("(?U)", "").replace("'", "''")
    out = []
    for kind, exempt, alternatives in X.LIST_TYPE_RULES:
        found = " OR ".join("(" + " AND ".join(f"regexp_matches({part[k]}, '{plain(p)}')" for k, p in every) + ")" for every in alternatives)
        out.append(f"WHEN ({found}){' AND NOT sole' if exempt else ''} THEN '{kind}'")
    return "CASE " + " ".join(out) + " ELSE 'race' END"


@query(f"""WITH a(i, f) AS (VALUES {", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(_NAMES))}), b(j, t) AS (VALUES {", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(_HEADS))})
SELECT p_partkey, {_list_type_sql()} AS kind FROM (SELECT p_partkey, f, t, p_partkey % 3 = 0 AS sole FROM part JOIN a ON i = p_partkey % {len(_NAMES)} JOIN b ON j = p_partkey % {len(_HEADS)})""")
def t30_every_rule(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.list_type(in_turn(_NAMES, "p_partkey"), in_turn(_HEADS, "p_partkey"), F.col("p_partkey") % 3 == 0).alias("kind"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Anna Berg' WHEN c_custkey % 4 = 1 THEN 'Fixed Name' ELSE 'Ann? B' END AS name FROM customer")
def t3_name_repairs(spark, sf):
    typos = F.create_map(F.lit("1:Ann? B"), F.lit("Fixed Name"), F.lit("0:Other"), F.lit("No One"))
    k = F.col("c_custkey") % 4
    return read(spark, sf, "customer").select("c_custkey", T.clean_result_name(F.when(k == 0, "8 Anna Berg").otherwise("Ann? B"), k, typos).alias("name"))


# filters, joins and registers --------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW'")
def f6_clone_events(spark, sf):
    o = read(spark, sf, "orders").withColumn("title", F.when(F.col("o_orderpriority") == "5-LOW", "Cup - BEWERTUNG 2").otherwise("Cup"))
    return o.filter(~FI.is_clone_title("title")).select("o_orderkey")


@query(R + """, l AS (SELECT event_id, rank, time_s, source FROM r WHERE source = 'html'), a AS (SELECT event_id, count(*) AS n, bool_and(rank IS NULL OR event_id % 2 = 0) AS marked FROM l GROUP BY ALL)
, b AS (SELECT event_id, count(*) AS n, count(rank) AS ranked, max(time_s * 20) AS longest FROM r WHERE source = 'html' GROUP BY ALL)
, better AS (SELECT event_id FROM a JOIN b USING (event_id) WHERE a.n >= 20 AND marked AND b.n >= greatest(20, floor(a.n * 0.9)) AND ranked >= 5 AND longest >= 300)
SELECT event_id, count(*) AS n, 'lossy' AS source FROM l WHERE event_id NOT IN (SELECT event_id FROM better) GROUP BY ALL UNION ALL SELECT event_id, count(*), 'exact' FROM l GROUP BY ALL""")
def f10_exact_over_lossy(spark, sf):
    r = results(spark, sf).filter("source = 'html'")
    lossy = r.select("event_id", F.when(F.col("event_id") % 2 != 0, F.col("rank")).alias("rank"), "time_s", F.lit(True).alias("minute_marked"), F.lit("").alias("source"))
    exact = r.select("event_id", "rank", (F.col("time_s") * 20).alias("time_s"), F.lit(False).alias("minute_marked"), F.lit("").alias("source"))
    return FI.exact_over_lossy(lossy, exact, ["event_id"]).groupBy("event_id", "source").agg(F.count("*").alias("n"))


@query(R + "SELECT result_id FROM r WHERE club = 'Club 4' AND status = 'mp'")
def f19_exact_cases(spark, sf):
    register = spark.createDataFrame([(" Club 4", "mp "), ("Club 99", "ok")], "club string, status string")
    return J.exactly(results(spark, sf), register, ["club", "status"]).select("result_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND o_orderpriority LIKE '%URGENT%'")
def f24_review_queue(spark, sf):
    li = read(spark, sf, "orders").select("o_orderkey", F.lit("spring").alias("campaign"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("state"), F.lit("Cup").alias("title"), F.col("o_orderpriority").alias("category"))
    return FI.review_queue(li, "spring", "1995-01-01", "1997-12-31", "O", "urgent").select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE (c_custkey % 3 = 0 OR c_custkey % 2 <> 0) AND (c_custkey % 3 = 0 OR c_custkey % 5 < 2)""")
def f17_index_refresh(spark, sf):
    k = F.col("c_custkey")
    e = read(spark, sf, "customer").select("c_custkey", F.lit("2024-05-01").alias("date"), (k % 2 == 0).alias("known"), (k % 3 == 0).alias("selected"), F.when(k % 5 != 4, k % 5 < 2).alias("needs"))
    return FI.needs_index(e, "date", "known", "selected", "needs", today="2025-01-01").select("c_custkey")


@query("""WITH m AS (SELECT 'name ' || (c_custkey // 2)::VARCHAR AS name_key, c_custkey AS person_id, CASE c_custkey % 3 WHEN 0 THEN 'nfwien' WHEN 1 THEN 'olost' ELSE 'nfwiennord' END AS club FROM customer)
, l AS (SELECT 'name ' || c_custkey::VARCHAR AS name_key, list_extract(['nfwie', 'nfwi', 'nfwien', 'olostgraz', 'olos', '', 'xy'], (c_custkey % 7)::INT + 1) AS part FROM customer)
SELECT name_key, min(person_id) AS person_id FROM l JOIN m USING (name_key) WHERE part <> '' AND (part = club OR length(part) >= 5 AND starts_with(club, part) OR length(club) >= 5 AND starts_with(part, club)) GROUP BY name_key HAVING count(DISTINCT person_id) = 1""")
def j11_prefix_members(spark, sf):
    """Parts of team labels, too short, too long or of another club, against the clubs of the two members of a name."""
    k = F.col("c_custkey")
    c = read(spark, sf, "customer")
    labels = c.select(F.concat(F.lit("name "), k.cast("string")).alias("name_key"), in_turn(["nfwie", "nfwi", "nfwien", "olostgraz", "olos", "", "xy"], "c_custkey").alias("part"))
    members = c.select(F.concat(F.lit("name "), F.expr("c_custkey div 2").cast("string")).alias("name_key"), in_turn(["nfwien", "olost", "nfwiennord"], "c_custkey").alias("club"), k.alias("person_id"))
    return J.prefix_members(labels, members, "name_key", "part", "club", "person_id").select("name_key", "person_id")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ÖM' WHEN 1 THEN 'ÖSTM' END AS tag FROM orders")
def c1_api_tags(spark, sf):
    k = F.col("o_orderkey") % 4
    names = F.when(k == 0, F.array(F.lit("LM"), F.lit("ÖM"), F.lit("ÖSTM"))).when(k == 1, F.array(F.lit("ÖSTM"))).when(k == 2, F.array(F.lit("LM"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf, "orders").select("o_orderkey", C.api_tag(names).alias("tag"))


@query(R + "SELECT DISTINCT stage_id, rank AS pos, club, 'evidence:' || substr(sha256(stage_id::VARCHAR || chr(0) || 'doc' || chr(0) || 'h21' || chr(0) || club || chr(0) || '0'), 1, 24) AS evidence_id FROM r WHERE rank = 1 AND seq = 1")
def c4_evidence_rows(spark, sf):
    r = results(spark, sf).filter("rank = 1 AND seq = 1").select("stage_id", "rank", "club").distinct()
    d = r.select("stage_id", F.lit("doc").alias("source_document_id"), F.lit("field").alias("scope"), F.array(F.struct(F.lit("h21").alias("category_key"), F.col("club").alias("name_key"), "rank", "club")).alias("rows"))
    return C.registered_evidence(d).select("stage_id", F.col("rank").alias("pos"), "club", "evidence_id")


@query("SELECT o_custkey AS event_id, min(o_orderkey) AS stage_id FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL HAVING count(DISTINCT o_orderkey) = 1")
def c5_configured_stages(spark, sf):
    st = read(spark, sf, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("stage_id"), F.col("o_orderpriority").alias("stage_title"))
    return C.configured_stage(st, "(?i)urgent")


@query("""SELECT o_orderkey AS list_id, unnest(CASE o_orderkey % 6 WHEN 0 THEN ['BGLD', 'STMK'] WHEN 1 THEN ['WIEN'] WHEN 2 THEN ['STMK'] WHEN 3 THEN []::VARCHAR[] WHEN 4 THEN ['WIEN'] ELSE []::VARCHAR[] END) AS region,
  CASE o_orderkey % 6 WHEN 0 THEN 'category' WHEN 1 THEN 'document' WHEN 2 THEN 'event_title' WHEN 4 THEN 'category' END AS evidence, CASE o_orderkey % 6 WHEN 2 THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
  CASE o_orderkey % 6 WHEN 0 THEN 'd40' WHEN 1 THEN 'h21' WHEN 2 THEN 'h35' ELSE 'h14' END AS category_key FROM orders""")
def c14_regional_mappings(spark, sf):
    return RG.mappings(_region_lists(spark, sf)).select("list_id", "region", "evidence", "confidence", "category_key")


def _region_lists(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("list_id"), F.expr("o_orderkey div 6").alias("stage_id"))
    pick = lambda *x: in_turn(list(x), "list_id")
    return o.select(
        "list_id", "stage_id",
        pick("D40-(St,B)", "Herren 21", "H 35", "Familie", "Wiener H-14", "H 14").alias("category"),
        pick("erg.html", "wiener-wertung.html", "erg.html", "erg.html", "erg.html", "erg.html").alias("file_name"),
        pick("LM St, B", "Lauf", "Steirische Meisterschaft", "Steirische Meisterschaft", "Landesmeisterschaft", "Lauf in Wien").alias("event_title"),
        F.lit("").alias("stage_title"), F.col("list_id").cast("string").alias("fingerprint"),
    )


@query("""WITH m(k, region, key, kind) AS (VALUES (0, 'BGLD', 'd40', 'category'), (0, 'STMK', 'd40', 'category'), (1, 'WIEN', 'h21', 'document'), (2, 'STMK', 'h35', 'event_title'), (4, 'WIEN', 'h14', 'category'))
SELECT o_orderkey // 6 AS stage_id, region, key AS category_key, CASE WHEN kind = 'event_title' THEN 'candidate' ELSE 'confirmed' END AS state, kind AS evidence, count(*) AS lists FROM orders JOIN m ON k = o_orderkey % 6 GROUP BY ALL""")
def j14_ordered_claims(spark, sf):
    li = _region_lists(spark, sf)
    claims = RG.mappings(li)
    ordered = RG.claims_in_order(claims, li.select("list_id", "stage_id", F.lit("2024-05-01").alias("stage_date")), RG.instances(claims))
    return ordered.groupBy("stage_id", "region", "category_key", F.col("instance_state").alias("state"), "evidence").agg(F.count("*").alias("lists"))


@query(R + """, u AS (SELECT list_id, person_id, min(result_id) AS first, bool_or(out_of_competition) AS out, min(CASE WHEN status = 'ok' THEN rank END) AS rk, min(CASE WHEN status = 'ok' THEN time_s END) AS t, bool_or(status = 'ok') AS ok, list_distinct(list(CASE club WHEN 'Club 1' THEN 'BGLD' WHEN 'Club 2' THEN 'STMK' END)) AS g FROM r WHERE result_kind <> 'family' GROUP BY ALL)
, c AS (SELECT list_id, list_id // 6 AS stage_id, person_id, first, ok, rk, t, CASE WHEN list_id % 6 = 1 THEN 'WIEN' WHEN list_id % 6 = 2 AND g = ['STMK'] THEN 'STMK' WHEN list_id % 6 = 0 AND len(g) = 1 THEN g[1] END AS region, CASE WHEN list_id % 6 = 1 THEN 3 WHEN list_id % 6 = 0 THEN 2 ELSE 1 END AS power FROM u WHERE NOT out AND list_id % 6 IN (0, 1, 2))
, w AS (SELECT * FROM c WHERE region IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stage_id, person_id ORDER BY power = 1, power DESC, list_id) = 1)
SELECT stage_id, region, person_id, CASE WHEN ok THEN rank() OVER (PARTITION BY stage_id, region, list_id, ok ORDER BY rk NULLS LAST, t) END AS regional_rank FROM w""", whole="regional_rank")
def c15_regional_entries(spark, sf):
    li = _region_lists(spark, sf)
    claims = RG.mappings(li)
    ordered = RG.claims_in_order(claims, li.select("list_id", "stage_id", F.lit("2024-05-01").alias("stage_date")), RG.instances(claims))
    r = results(spark, sf).withColumn("unit", F.col("person_id").cast("string")).withColumn("observed_nation", F.lit(None).cast("string"))
    clubs = spark.createDataFrame([("Club 1", "BGLD"), ("Club 2", "STMK")], "club string, region string")
    none = spark.createDataFrame([], "person_id long, club string, valid_from string, valid_to string")
    return RG.entries(ordered, r, clubs, none)[0].select("stage_id", "region", F.col("unit").cast("long").alias("person_id"), "regional_rank")


@query(R + "SELECT result_id, club NOT IN ('Club 1', 'Club 2', 'Club 3', 'Club 4') AS open FROM r")
def c16_unresolved_clubs(spark, sf):
    club = F.when(F.col("club") == "Club 3", "vereinslos").when(F.col("club") == "Club 4", "SK Praha").otherwise(F.col("club"))
    known = F.when(F.col("club").isin("Club 1", "Club 2"), "WIEN")
    return results(spark, sf).select("result_id", RG.unresolved_club(club, known, ["praha"]).alias("open"))


@query(R + """, u AS (SELECT result_id, person_id, club, day FROM r)
SELECT result_id, CASE WHEN person_id % 5 = 0 THEN 'TIR' WHEN club = 'Club 1' THEN 'WIEN' WHEN person_id % 2 = 0 AND day >= DATE '1995-01-01' THEN 'NOE' END AS region, CASE WHEN person_id % 5 = 0 THEN 'source_nat' WHEN club = 'Club 1' THEN 'club' WHEN person_id % 2 = 0 AND day >= DATE '1995-01-01' THEN 'membership' ELSE 'unresolved' END AS region_basis FROM u""")
def c17_unit_regions(spark, sf):
    r = results(spark, sf).select(F.col("result_id").alias("unit_id"), "person_id", "club", F.col("day").cast("string").alias("stage_date"), F.when(F.col("person_id") % 5 == 0, "TIR").alias("source_nat"))
    clubs = spark.createDataFrame([("Club 1", "WIEN"), ("Home", "NOE")], "club string, region string")
    m = r.filter("person_id % 2 = 0").select("person_id").distinct().select("person_id", F.lit("Home").alias("club"), F.lit("1995-01-01").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    return C.unit_region(r, clubs, m).select(F.col("unit_id").alias("result_id"), "region", "region_basis")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS old_id, p_partkey - 1 AS new_id FROM part WHERE p_partkey % 4 <> 1), c AS (SELECT old_id, new_id FROM e UNION ALL SELECT c.old_id, e.new_id FROM c JOIN e ON c.new_id = e.old_id)
SELECT old_id, min(new_id) AS new_id FROM c GROUP BY ALL HAVING min(new_id) IN (SELECT p_partkey FROM part WHERE p_partkey % 4 = 1)""")
def e11_redirects(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") - 1).alias("new_id")).filter("old_id % 4 <> 1")
    history, fresh = p.filter("old_id % 4 = 2"), p.filter("old_id % 4 <> 2")
    current = read(spark, sf, "part").filter("p_partkey % 4 = 1").select(F.col("p_partkey").alias("id"))
    return J.redirects(history, fresh, current).select("old_id", "new_id")


# units, reviews and quality ----------------------------------------------------------------------


@query(R + """SELECT result_id, CASE WHEN result_kind IN ('relay', 'team', 'pair') THEN coalesce(team_name, 'NF 2') END AS team_name, CASE WHEN result_kind IN ('relay', 'team', 'pair') THEN coalesce(rank, 3) END AS leg_number, CASE WHEN result_kind IN ('relay', 'team', 'pair') AND rank IS NULL THEN 4 END AS leg_count FROM r""")
def u3_relay_metadata(spark, sf):
    r = results(spark, sf).withColumn("note", F.lit("Staffel: NF 2 · Leg 3/4")).withColumn("legs", F.lit(None).cast("int"))
    m = U.relay_metadata("result_kind", "note", "club", "team_number", "team_name", "rank", "legs")
    return r.select("result_id", m["team_name"].alias("team_name"), m["leg_number"].alias("leg_number"), m["leg_count"].alias("leg_count"))


@query(R + "SELECT result_id, unnest(CASE WHEN person_id % 10 = 3 THEN [person_id * 100, person_id * 100 + 1] ELSE [person_id] END) AS person_id FROM r")
def u12_split_identities(spark, sf):
    m = read(spark, sf, "supplier").filter("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("old_id"), F.array(F.col("s_suppkey") * 100, F.col("s_suppkey") * 100 + 1).alias("person_ids"))
    return U.split_overrides(results(spark, sf), m).select("result_id", "person_id")


@query("""WITH t AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS team_sequence FROM orders) SELECT o_orderkey, team_sequence, i AS member_pos, 'M' || (o_orderkey + i)::VARCHAR AS name FROM t, (VALUES (0), (1), (2)) v(i)""")
def u14_team_rows(spark, sf):
    k = F.col("o_orderkey")
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.array(*[F.concat(F.lit("M"), (k + i).cast("string")) for i in range(3)]).alias("members"))
    t = U.team_rows(o, "members", ["o_custkey"], "o_orderkey")
    return t.select("o_orderkey", F.col("team_sequence").cast("long").alias("team_sequence"), "member_pos", "name")


@query(R + "SELECT severity, 'd' AS domain, code, count(*) AS n FROM (SELECT CASE WHEN rank IS NULL THEN 'blocker' ELSE 'info' END AS severity, status AS code FROM r) GROUP BY ALL")
def a10_summary(spark, sf):
    issues = results(spark, sf).select(F.when(F.col("rank").isNull(), "blocker").otherwise("info").alias("severity"), F.col("status").alias("code"))
    return Q.summary(issues, spark.createDataFrame([(s, "d") for s in X.STATUSES], "code string, domain string"))


@query(R + "SELECT DISTINCT list_id, status AS code, 'issue:' || substr(sha256(list_id::VARCHAR || chr(0) || '' || chr(0) || status), 1, 24) AS issue_id FROM r")
def q2_issue_ids(spark, sf):
    r = results(spark, sf).select("list_id", F.lit(None).cast("long").alias("result_id"), F.col("status").alias("code"))
    return Q.with_issue_ids(r).select("list_id", "code", "issue_id")


@query(R + "SELECT o_orderkey AS list_id FROM orders WHERE o_orderkey NOT IN (SELECT list_id FROM r WHERE status = 'mp')")
def v3_auto_confirmable(spark, sf):
    lists = read(spark, sf, "orders").select(F.col("o_orderkey").alias("list_id"))
    issues = results(spark, sf).select("list_id", F.when(F.col("status") == "mp", "warning").otherwise("info").alias("severity"))
    return Q.auto_confirmable(lists, issues)


_REVIEWS = "(SELECT list_id, CASE seq % 3 WHEN 0 THEN 'ranking' WHEN 1 THEN 'identity' ELSE 'club' END AS dimension, CASE WHEN status = 'ok' THEN 'confirmed' WHEN status = 'dnf' THEN 'not_applicable' ELSE 'flagged' END AS state FROM r)"


@query(R + f"SELECT o_orderkey AS list_id, coalesce(n, 0) = 2 AS confirmed FROM orders LEFT JOIN (SELECT list_id, count(DISTINCT dimension) AS n FROM {_REVIEWS} WHERE state IN ('confirmed', 'not_applicable') AND dimension IN ('ranking', 'identity') GROUP BY ALL) ON list_id = o_orderkey")
def v4_confirmed_lists(spark, sf):
    k = F.col("seq") % 3
    reviews = results(spark, sf).select("list_id", F.when(k == 0, "ranking").when(k == 1, "identity").otherwise("club").alias("dimension"), F.when(F.col("status") == "ok", "confirmed").when(F.col("status") == "dnf", "not_applicable").otherwise("flagged").alias("state"))
    return Q.confirmed(read(spark, sf, "orders").select(F.col("o_orderkey").alias("list_id")), reviews, ["ranking", "identity"])


@query("""SELECT o_orderkey AS list_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS state, true AS accepted FROM orders UNION ALL SELECT o_orderkey, 'new', false FROM orders WHERE o_orderkey % 3 = 1""")
def v6_decisions(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("list_id"), F.col("o_orderstatus").alias("fingerprint"))
    a = o.select("list_id", F.lit("ranking").alias("dimension"), F.lit("old").alias("state"), F.col("fingerprint").alias("input_fingerprint"))
    d = o.filter("list_id % 3 <> 2").select("list_id", F.lit("ranking").alias("dimension"), F.lit("new").alias("state"), F.when(F.col("list_id") % 3 == 0, F.col("fingerprint")).otherwise("stale").alias("input_fingerprint"))
    return Q.decided(a, d, o).select("list_id", "state", "accepted")


@query(R + """, e AS (SELECT result_id, list_id, category, result_kind FROM r WHERE championship IS NOT NULL)
SELECT 'missing_provenance' AS "check", 0::BIGINT AS violations UNION ALL SELECT 'missing_identity_basis', 0 UNION ALL SELECT 'missing_list', 0 UNION ALL SELECT 'status_domain', 0 UNION ALL SELECT 'negative_time', 0 UNION ALL SELECT 'eligibility_domain', 0
UNION ALL SELECT 'family_with_person', count(*) FROM r WHERE result_kind = 'family' UNION ALL SELECT 'personless_individual', 0 UNION ALL SELECT 'ooc_championship', count(*) FROM r WHERE out_of_competition AND championship IS NOT NULL
UNION ALL SELECT 'duplicate_individual_award', count(*) FROM (SELECT stage_id, person_id FROM r WHERE rank = 1 AND result_kind = 'individual' GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_relay_award', count(*) FROM (SELECT stage_id, person_id, coalesce('n:' || team_number, 't:' || team_name, 'c:' || club) AS team FROM r WHERE rank = 1 AND result_kind = 'relay' GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'award_without_eligibility', count(*) FROM r WHERE rank = 1 AND eligibility IN ('unknown', 'ineligible') UNION ALL SELECT 'award_without_result', 0
UNION ALL SELECT 'double_region', 0 UNION ALL SELECT 'entry_without_result', 0 UNION ALL SELECT 'family_in_region', count(*) FROM r WHERE championship IS NOT NULL AND result_kind = 'family'
UNION ALL SELECT 'unmatched_inclusion', count(*) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey NOT IN (SELECT list_id FROM r WHERE championship IS NOT NULL)
UNION ALL SELECT 'membership_without_person', count(*) FROM customer WHERE c_custkey % 3 = 0""")
def v1_every_invariant(spark, sf):
    r = results(spark, sf).withColumn("source_document_id", F.col("document_id")).withColumn("identity_basis", F.lit("direct")).withColumn("time_behind_s", F.lit(None).cast("int")).withColumn("team_time_s", F.lit(None).cast("int"))
    award = r.filter("rank = 1").select("result_id", F.col("stage_id").alias("instance_id"))
    tagged = r.filter("championship is not null")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"))
    evidence = read(spark, sf, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.when(F.col("o_orderkey") % 5 == 0, "inclusion").otherwise("field").alias("scope"))
    return Q.invariants({
        "result": r, "result_list": r.select("list_id").distinct(), "award": award, "entry": tagged.select("result_id", F.lit("WIEN").alias("region")),
        "membership": c, "person": c.filter("person_id % 3 <> 0"), "evidence": evidence, "evidence_match": tagged.select(F.col("list_id").alias("evidence_id")),
    })


@query(R + """, x AS (SELECT list_id, stage_id, source AS src, sum(CASE WHEN status = 'mp' THEN 10000 ELSE 1 END + CASE WHEN status = 'mp' THEN 50 ELSE 2 END) AS score, count(*) AS issues FROM r WHERE status <> 'ok' GROUP BY ALL)
SELECT stage_id, src AS source, sum(score)::BIGINT AS score, sum(issues)::BIGINT AS issues, count(*) AS lists FROM x GROUP BY ALL""")
def q4_report_by_source(spark, sf):
    r = results(spark, sf)
    lists = r.select("list_id", "stage_id", "source").distinct()
    issues = r.filter("status <> 'ok'").select("list_id", F.col("status").alias("code"), F.when(F.col("status") == "mp", "blocker").otherwise("info").alias("severity"))
    catalog = spark.createDataFrame([("mp", "parser", "d"), ("dnf", "source", "d")], "code string, owner string, domain string")
    return Q.report_by_source(issues, lists, catalog, ["stage_id", "source"])


@query(R + """, w AS (SELECT list_id, sum(CASE WHEN status = 'mp' THEN 10000 ELSE 1 END) AS score FROM r WHERE status <> 'ok' GROUP BY ALL)
SELECT list_id, row_number() OVER (ORDER BY CASE list_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 99 END, score DESC, (list_id % 900)::VARCHAR, list_id // 32, list_id) AS place FROM w""")
def s7_priorities(spark, sf):
    r = results(spark, sf)
    issues = r.filter("status <> 'ok'").select("list_id", F.col("status").alias("code"), F.when(F.col("status") == "mp", "blocker").otherwise("info").alias("severity"))
    lists = r.select("list_id", "event_id").distinct().withColumn("date", (F.col("list_id") % 900).cast("string")).withColumn("tier", F.when(F.col("list_id") % 3 == 0, 1).when(F.col("list_id") % 3 == 1, 2))
    none = spark.createDataFrame([], "code string, owner string, domain string")
    return Q.report(issues, lists, none, campaign="tier").select("list_id", "place")


# sources and sinks: written below the shared folder, read back, compared --------------------------


def _lines(df: DataFrame, name: str, by: str | None = None) -> str:
    """A register or a scan as JSON, a record a line, written by as many tasks as hold it; by names its folders."""
    path = new_folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).json(path)
    return path


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'skiOrienteering' ELSE 'foot-o' END AS sport, '2024-05-01' AS date_from FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0")
def src1_calendar(spark, sf):
    k = F.col("c_custkey")
    c = read(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 == 0, "Cup Bewertung").otherwise("Cup").alias("title"), F.lit("2024-05-01T10:00:00Z").alias("dateFrom"), F.lit("foot-o").alias("sportType"))
    excluded = read(spark, sf, "customer").filter(k % 7 == 0).select(k.alias("event_id"))
    sports = read(spark, sf, "customer").filter(k % 5 == 0).select(k.alias("event_id"), F.lit("skiOrienteering").alias("sport"))
    return readers.calendar(spark, _lines(c, "calendar"), excluded, sports, lines=True).select("id", F.col("sportType").alias("sport"), "date_from")


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 4 = 0 THEN 'doubled' END AS reason FROM orders WHERE o_orderkey % 4 <> 1")
def src2_missing_register(spark, sf):
    """Events marked by one register and thinned out by another one; a third that is missing changes nothing."""
    k = F.col("o_orderkey")
    o = read(spark, sf, "orders").select(k.alias("event_id"))
    schema = "event_id long, reason string"
    out = _lines(o.filter("event_id % 4 = 1").withColumn("reason", F.lit("out")), "excluded")
    marks = _lines(o.filter("event_id % 4 = 0").withColumn("reason", F.lit("doubled")), "marked")
    gone = readers.optional_json(spark, new_folder(spark, "no-such"), schema, lines=True)
    kept = o.join(readers.optional_json(spark, out, schema, lines=True), "event_id", "left_anti").join(gone, "event_id", "left_anti")
    return kept.join(readers.optional_json(spark, marks, schema, lines=True), "event_id", "left").select("event_id", "reason")


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS p FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT k % 16 AS event_id, k AS category, count(*) AS n, min(CASE WHEN o_orderkey % 2 = 0 THEN 'mp' ELSE 'ok' END) AS first_status FROM (SELECT * FROM o QUALIFY p = min(p) OVER (PARTITION BY k)) GROUP BY ALL""")
def src3_api_rows(spark, sf):
    """API rows in a folder an event, a row a line; the event is told by the folder."""
    k = F.col("o_orderkey")
    o = read(spark, sf, "orders").select(
        k.alias("id"), F.lit("u").alias("userId"), k.cast("string").alias("firstName"), F.col("o_custkey").cast("string").alias("categoryShortTitle"), F.lit(1).cast("long").alias("eventStageId"), F.lit("Klub").alias("clubName"),
        F.when(F.col("o_orderpriority") == "5-LOW", "inactive").when(k % 2 == 0, "missingPunch").otherwise("classified").alias("classification"),
        F.when(k % 3 == 0, "official").when(k % 3 == 1, "unofficial").otherwise("live").alias("resultType"), (F.col("o_custkey") % 16).alias("event_id"),
    )
    twice = o.unionByName(o.filter("id % 10 = 0").withColumn("id", F.col("id") + 1_000_000_000))  # duplicates but for their ids
    got = readers.api_rows(spark, _lines(twice.repartition("event_id"), "api", "event_id"), lines=True)
    return got.groupBy("event_id", F.col("categoryShortTitle").cast("long").alias("category")).agg(F.count("*").alias("n"), F.min("status").alias("first_status"))


@query(R + "SELECT list_id, category, seq - 1 AS row_pos, 'Person ' || person_id::VARCHAR AS name, club, CASE status WHEN 'dnf' THEN 'dnf' WHEN 'mp' THEN 'mp' ELSE 'ok' END AS status, time_s * 60 + 5 AS time_s, out_of_competition AS ooc FROM r")
def src4_document_rows(spark, sf):
    """Results as nested documents in JSON, read by the declared schema and flattened again."""
    from .. import schemas as S

    r = results(spark, sf)
    time = F.concat(F.col("time_s").cast("string"), F.lit(":05"))
    row = F.struct(F.col("seq"), F.concat(F.lit("Person "), F.col("person_id").cast("string")).alias("name"), F.concat(F.lit("empty "), "club").alias("club"), time.alias("timeText"), F.when(F.col("status") == "ok", F.lit(None)).otherwise(F.col("status")).alias("status"), F.when(F.col("status") == "ok", "ok").alias("note"), F.col("category").alias("c"), F.col("out_of_competition").alias("outOfCompetition"))
    docs = r.groupBy("list_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    cats = F.transform("rows", lambda x: F.struct(x["c"].alias("name"), F.array(F.struct(x["name"].alias("name"), x["club"].alias("club"), x["timeText"].alias("timeText"), F.coalesce(x["status"], F.lit("ok")).alias("status"), x["outOfCompetition"].alias("outOfCompetition"))).alias("results")))
    text = docs.select("list_id", F.to_json(F.struct(F.col("list_id").alias("eventId"), F.lit("html").alias("source"), cats.alias("categories"))).alias("t"))
    d = text.select(F.from_json("t", S.DOCUMENT).alias("d")).select("d.*").withColumn("path", F.lit("p"))
    got = readers.document_rows(readers.multistage(d))
    return got.select(F.col("event_id").alias("list_id"), "category", F.col("category_pos").cast("long").alias("row_pos"), "name", "club", "status", "time_s", F.col("out_of_competition").alias("ooc"))


@query("SELECT c_custkey AS member_id, c_name AS name, (1950 + c_custkey % 50)::INT AS birth_year, c_mktsegment AS club FROM customer")
def src5_member_csv(spark, sf):
    path = new_folder(spark, "members")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("member_id"), F.col("c_name").alias("name"), (1950 + F.col("c_custkey") % 50).cast("int").alias("birth_year"), F.col("c_mktsegment").alias("club"))
    c.write.option("sep", ";").option("header", True).csv(path)
    return readers.member_registry(spark, path)


@query("SELECT key, kind, target FROM (SELECT c_name AS key, 'alias' AS kind, c_custkey::VARCHAR AS target FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_name, 'not_member', NULL FROM customer WHERE c_custkey % 2 = 1)")
def src6_member_mapping(spark, sf):
    """The ledger in pieces, an entry a line."""
    even, name = F.col("c_custkey") % 2 == 0, F.col("c_name")
    m = read(spark, sf, "customer").select(F.when(even, F.create_map(name, F.col("c_custkey").cast("string"))).alias("aliases"), F.when(~even, F.array(name)).alias("not_member"))
    return readers.member_mapping(spark, _lines(m, "mapping"), lines=True).select("key", "kind", "target")


@query("SELECT DISTINCT name FROM (SELECT c_mktsegment AS name FROM customer UNION SELECT 'Old ' || c_mktsegment FROM customer)")
def src7_official_clubs(spark, sf):
    c = read(spark, sf, "customer")
    return readers.official_clubs(c.select(F.col("c_mktsegment").alias("name")), c.select(F.concat(F.lit("Old "), "c_mktsegment").alias("name")))


@query("SELECT c_name AS club, CASE c_custkey % 3 WHEN 0 THEN 'WIEN' ELSE 'NOE' END AS region FROM customer WHERE c_custkey % 3 <> 2")
def src8_club_regions(spark, sf):
    k = F.col("c_custkey") % 3
    c = read(spark, sf, "customer").select(F.col("c_name").alias("club"), F.when(k == 0, "WIEN").when(k == 1, "NOE").otherwise("XX").alias("jurisdiction"))
    path = _lines(c.select(F.array(F.struct("club", "jurisdiction")).alias("clubs")), "regions")
    return readers.club_jurisdictions(spark, path, lines=True).select("club", "region")


@query("SELECT c_custkey AS person_id, 'A ' || c_name AS name, c_custkey % 2 = 0 AS verified FROM customer")
def src9_person_registry(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("A").alias("first_name"), F.col("c_name").alias("last_name"), (F.col("c_custkey") % 2 == 0).alias("is_verified"))
    users = F.array(F.struct(*c.columns)).alias("users")
    path = _lines(c.select(F.lit(1).alias("schema_version"), users).unionByName(c.select(F.lit(2).alias("schema_version"), users)), "users")
    return readers.person_registry(spark, path, lines=True).select("person_id", "name", "verified")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'later' ELSE o_orderpriority END AS title FROM orders")
def src10_pages(spark, sf):
    """A scan in pages of a hundred rows, many pages a file; every tenth row stands on a later page again, where it counts."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    rows = _paged(o, ["id"], F.col("id") % 10 == 0)
    got = readers.stored_pages(spark, _lines(rows, "pages"), "id long, title string")
    return D.upsert(got, ["id"], "pos", replace=True).select("id", "title")


def _paged(rows: DataFrame, order: list[str], again: Column, size: int = 100) -> DataFrame:
    """rows by pages in an order, those of `again` once more at the end with another title."""
    first = numbered(rows, [F.col(c).asc() for c in order], "_no")
    more = numbered(rows.filter(again).withColumn("title", F.lit("later")), [F.col(c).asc() for c in order], "_no").withColumn("_no", F.col("_no") + rows.count())
    every = first.unionByName(more).withColumn("page", F.expr(f"cast((_no - 1) div {size} + 1 as int)")).withColumn("at", F.expr(f"cast((_no - 1) % {size} as int)"))
    return every.withColumn("last_page", F.lit(every.agg(F.max("page")).first()[0])).drop("_no")


@query("""WITH e AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_orderkey AS p FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'later' ELSE o_orderstatus END AS title, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS q FROM orders WHERE o_orderkey % 4 <> 1)
SELECT id, coalesce(f.title, e.title) AS title, row_number() OVER (ORDER BY e.p NULLS LAST, q NULLS LAST, id) AS pos FROM e FULL JOIN f USING (id)""")
def src11_durable_calendar(spark, sf):
    """A calendar of an earlier scan, and the pages of a new one, merged and committed as the next version."""
    o = read(spark, sf, "orders")
    versions = H.Versions(spark, new_folder(spark, "calendar"), ["id"])
    before = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("pos"))
    H.merged_version(versions, before, "id", "pos")
    fetched = o.filter("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), "o_custkey")
    path = _lines(_paged(fetched, ["o_custkey", "id"], F.col("id") % 10 == 0).drop("o_custkey"), "pages")
    H.merged_version(versions, readers.stored_pages(spark, path, "id long, title string"), "id", "pos")
    return versions.read()


@query(R + "SELECT result_id, CASE WHEN status = 'ok' THEN time_s END AS time_s, CASE status WHEN 'ok' THEN 'ok' WHEN 'mp' THEN 'mp' ELSE 'dnf' END AS status, CASE WHEN status = 'ok' THEN rank END AS rank FROM r")
def src12_live_results(spark, sf):
    r = results(spark, sf).select("result_id", F.when(F.col("status") == "ok", 0).when(F.col("status") == "mp", 3).otherwise(2).alias("code"), (F.col("time_s") * 100 + 99).alias("centiseconds"), F.col("rank").cast("string").alias("place"))
    return readers.live_results(r).select("result_id", "time_s", "status", "rank")


@query("SELECT c_custkey, 'Anna B' AS name, (1950 + c_custkey % 50)::INT AS birth_year, (c_custkey % 9)::INT * 1000 + 300 AS course_length_m FROM customer")
def src13_timing_snapshot(spark, sf):
    k = F.col("c_custkey")
    c = read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Anna B ("), (1950 + k % 50).cast("string"), F.lit(")")).alias("name_year"), (k % 9 + F.lit(0.3)).alias("kilometres"), F.lit("ok").alias("state"))
    return readers.timing_snapshot(c).select("c_custkey", "name", "birth_year", "course_length_m")


@query("SELECT c_name AS path, CASE WHEN c_custkey % 5 = 0 THEN 'no source' WHEN c_custkey % 7 = 0 THEN 'other source' WHEN c_custkey % 3 <> 0 THEN 'other count' END AS refused FROM customer")
def src14_locked_transcripts(spark, sf):
    """Transcripts of which some have no file, some another one, and some more or fewer rows than they declare."""
    k = F.col("c_custkey")
    c = read(spark, sf, "customer").withColumn("path", F.col("c_name")).withColumn("content", F.encode("c_mktsegment", "UTF-8"))
    t = c.select("path", F.sha2(F.when(k % 7 == 0, F.encode(F.lower("c_mktsegment"), "UTF-8")).otherwise(F.col("content")), 256).alias("source_sha256"), (k % 3).alias("declared"), F.lit(0).cast("long").alias("n_rows"))
    return readers.checked_transcripts(t, c.filter(k % 5 != 0).select("path", "content")).select("path", "refused")


@query("SELECT DISTINCT club FROM (SELECT trim(c_mktsegment) AS club FROM customer UNION SELECT trim(s_name) FROM supplier) WHERE length(club) >= 3 AND regexp_matches(club, '\\pL{2}')")
def src15_club_dictionary(spark, sf):
    a = read(spark, sf, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("n"))
    return readers.club_dictionary(a, read(spark, sf, "supplier").select("s_name"), spark.createDataFrame([("x1",), ("12345",)], "n string"))


@query("""WITH o AS (SELECT o_custkey AS event_id, o_orderkey // 3 AS entry_id, count(*) AS n, bool_or(o_orderpriority = '5-LOW') AS other FROM orders GROUP BY ALL)
SELECT event_id, count(*) FILTER (n = 1 AND NOT other) AS recovered, count(*) FILTER (n > 1) AS twice, count(*) FILTER (n = 1 AND other) AS others FROM o GROUP BY ALL""")
def src16_omission_recovery(spark, sf):
    """Non-starters to be recovered; entries that stand twice, or that are none, are refused and the rest recovered."""
    status = F.when(F.col("o_orderpriority") == "5-LOW", "ok").otherwise("dns")
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("event_id"), F.lit("H21").alias("category"), F.expr("o_orderkey div 3").alias("entry_id"), status.alias("status"), F.lit("n").alias("name"), F.lit("c").alias("club"))
    bad = readers.refused_omissions(o)
    good = readers.omission_recovery(o.join(bad, ["event_id", "category", "entry_id"], "left_anti")).select("event_id", F.size("results").cast("long").alias("n"))
    refused = bad.groupBy("event_id").agg(F.count_if(F.col("refused") == "twice").alias("twice"), F.count_if(F.col("refused") != "twice").alias("others"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return good.join(refused, "event_id", "full").select("event_id", zero(F.col("n")).alias("recovered"), zero(F.col("twice")).alias("twice"), zero(F.col("others")).alias("others"))


@query(R + """SELECT result_id, CASE WHEN status = 'mp' AND rank IS NOT NULL THEN 'ok' WHEN status = 'mp' THEN 'unknown' ELSE status END AS status, CASE WHEN time_s >= 10 THEN time_s - 10 END AS time_s, CASE WHEN person_id % 2 = 0 THEN 'resolved' ELSE 'candidate' END AS identity_state,
CASE WHEN championship IS NULL THEN 'inferred' WHEN source = 'api' THEN 'full_field' ELSE 'winner_only' END AS championship_scope, CASE WHEN championship IS NULL THEN 'none' WHEN source = 'api' THEN 'official_api_championship' ELSE 'official_champion_annotation' END AS eligibility_basis FROM r""")
def snk1_defaults(spark, sf):
    r = results(spark, sf).withColumn("time_s", F.col("time_s") - 10).withColumn("status", F.when(F.col("status") == "mp", "unknown").otherwise(F.col("status"))).withColumn("observed_status", F.lit("")).withColumn("identity_confidence", F.when(F.col("person_id") % 2 == 0, 1.0).otherwise(0.5))
    r = r.withColumn("identity_state", F.lit(None).cast("string")).withColumn("eligibility", F.lit(None).cast("string")).withColumn("eligibility_basis", F.lit(None).cast("string"))
    return writers.with_defaults(r).select("result_id", "status", "time_s", "identity_state", "championship_scope", "eligibility_basis")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def snk2_gzipped_export(spark, sf):
    path = new_folder(spark, "export")
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    writers.export(c, path)
    return spark.read.schema(c.schema).json(path)


@query("SELECT o_orderstatus AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL")
def snk4_replaced_partitions(spark, sf):
    """A table by status, of which one partition is written wrong first and then replaced."""
    path = new_folder(spark, "partitions")
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("part"))
    writers.table(o.withColumn("o_orderkey", F.when(F.col("part") == "F", 0).otherwise(F.col("o_orderkey"))), path, ["part"])
    writers.partitions(o.filter("part = 'F'"), path, "part")
    return spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o_orderkey, 'document:' || substr(sha256('p/' || o_orderkey::VARCHAR), 1, 24) AS source_document_id, sha256('{\"categories\":\"' || o_orderpriority || '\"}') AS normalized_sha256, sha256('parser-1') AS parser_sha256 FROM orders")
def snk5_registered_documents(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("path"), F.lit("u").alias("source_url"), F.col("o_orderpriority").alias("categories"))
    d = writers.registered(o.unionByName(o), "parser-1")
    return d.select(F.substring("path", 3, 20).cast("long").alias("o_orderkey"), "source_document_id", "normalized_sha256", "parser_sha256")


@query("SELECT c_name AS path, sha256(c_mktsegment) AS sha256 FROM customer")
def m12_file_hashes(spark, sf):
    return writers.file_hashes(read(spark, sf, "customer").select(F.col("c_name").alias("path"), F.encode("c_mktsegment", "UTF-8").alias("content")))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey::VARCHAR || ',"o_orderpriority":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || '}') AS hash FROM orders""")
def m14_content_hashes(spark, sf):
    o = read(spark, sf, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    return o.select("o_orderkey", N.content_hash("o_custkey", "o_orderpriority").alias("hash"))


# views -------------------------------------------------------------------------------------------


@query(R + "SELECT result_id, category, rank, n_codes, n_done FROM (SELECT r.*, (SELECT count(DISTINCT status) FROM r x WHERE x.list_id = 33) AS n_codes, (SELECT count(DISTINCT club) FROM r x WHERE x.list_id = 33) AS n_done FROM r) WHERE list_id = 33")
def r13_review_detail(spark, sf):
    r = results(spark, sf)
    issues, done = r.select("list_id", F.col("status").alias("code")), r.select("list_id", F.col("club").alias("dimension"))
    d = V.review_detail(r, issues, done, 33)
    return d.select("result_id", "category", "rank", F.size(F.split("codes", ",")).cast("long").alias("n_codes"), F.size(F.split("reviewed", ",")).cast("long").alias("n_done"))


_POD = R + """, p AS (SELECT *, coalesce('n:' || team_number, 't:' || team_name) AS team FROM r WHERE status = 'ok' AND rank BETWEEN 1 AND 3)
, po AS (SELECT * FROM p WHERE result_kind NOT IN ('relay', 'team') OR team IS NULL UNION ALL SELECT * FROM p WHERE result_kind IN ('relay', 'team') AND team IS NOT NULL QUALIFY row_number() OVER (PARTITION BY list_id, team ORDER BY result_id) = 1)"""


@query(_POD + """, w AS (SELECT CASE WHEN category LIKE 'Damen%' THEN 'women' WHEN category = 'D21 Kurz' THEN 'open' WHEN category LIKE 'H%' THEN 'men' ELSE 'open' END AS gender, CASE category WHEN 'Damen 21 Elite' THEN '21 Elite' WHEN 'Herren 21 Elite' THEN '21 Elite' WHEN 'Herren ab 35' THEN 'ab 35' WHEN 'H-14' THEN '14' WHEN 'D21 Kurz' THEN 'D21 Kurz' ELSE category END AS base, 'P' || person_id::VARCHAR AS who FROM po WHERE rank = 1)
SELECT base, string_agg(DISTINCT who, ', ' ORDER BY who) FILTER (gender = 'women') AS women, string_agg(DISTINCT who, ', ' ORDER BY who) FILTER (gender = 'men') AS men FROM w WHERE base <> 'D21 Kurz' GROUP BY ALL""")
def r11_champions(spark, sf):
    r, event, stage, _ = _tables(spark, sf)
    c = V.champions(V.podiums(r, stage, event)).filter("base <> 'D21 Kurz' AND base <> '21 Kurz'")
    return c.select("base", F.nullif("women", F.lit("")).alias("women"), F.nullif("men", F.lit("")).alias("men"))


@query(_POD + "SELECT event_id, count(*) AS n, min(rank) AS best FROM po GROUP BY ALL")
def r12_chronicle(spark, sf):
    r, event, stage, _ = _tables(spark, sf)
    return V.medal_chronicle(V.podiums(r, stage, event)).groupBy("event_id").agg(F.count("*").alias("n"), F.min("rank").alias("best"))


@query(_POD + ", m AS (SELECT person_id, count(*) FILTER (rank = 1) AS gold, count(*) FILTER (rank = 2) AS silver, count(*) FILTER (rank = 3) AS bronze FROM po GROUP BY ALL) SELECT person_id, rank() OVER (ORDER BY gold DESC, silver DESC, bronze DESC) AS place FROM m JOIN supplier ON s_suppkey = person_id ORDER BY place, s_name, person_id LIMIT 7", whole="place")
def s4_capped_ranking(spark, sf):
    r, event, stage, person = _tables(spark, sf)
    return V.runner_medals(V.podiums(r, stage, event).withColumn("championship", F.lit(None).cast("string")), person, cap=7).select("person_id", "place")


@query("""WITH v(i, view, id, year, scope, region) AS (VALUES (0, 'runner', '12', 2024, NULL, NULL), (1, 'event', '7', NULL, 'om', NULL), (2, 'event', '7', NULL, NULL, 'WIEN'), (3, 'club', 'NF Wien', 2023, 'members', NULL), (4, 'club_non_starters', 'NF Wien', NULL, NULL, NULL), (5, 'clubs', NULL, 2024, NULL, 'TIR'), (6, 'runners', NULL, 2024, 'medals', NULL), (7, 'events', NULL, NULL, 'top3', NULL), (8, 'events', NULL, NULL, NULL, NULL))
SELECT p_partkey, view, id, CAST(year AS INT) AS year, scope, region FROM part JOIN v ON i = p_partkey % 9""")
def r15_routes(spark, sf):
    hashes = ["#/runner/12/2024", "#/event/7/om", "#/event/7/stage/3/lm/WIEN", "#/club/NF%20Wien/2023/members", "#/club/NF%20Wien/dns", "#/clubs/2024/lm/TIR", "#/runners/2024/medals", "#/events/top3", "#/nothing"]
    r = V.route(in_turn(hashes, "p_partkey"))
    return read(spark, sf, "part").select("p_partkey", *[r[c].alias(c) for c in ("view", "id", "year", "scope", "region")])


# parsers: lists written in a shape, then read back ------------------------------------------------


def _pages(r: DataFrame, line: Column, head: Column, key: str = "list_id") -> DataFrame:
    """A document a list: a head, then a line a row in order."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))), lambda x: x["t"]), "\n")
    return r.groupBy(key).agg(F.count("*").alias("n"), lines.alias("lines")).select(key, F.concat(head, F.col("lines")).alias("html"))


_TIME_SQL = "(time_s // 60)::VARCHAR || ':' || lpad((time_s % 60)::VARCHAR, 2, '0')"
_AS = "list_id, (seq - 1)::INT AS row_pos, rank, 'Person ' || chr(65 + (person_id % 26)::INT) AS name, club"


def _person() -> Column:
    return F.concat(F.lit("Person "), F.chr(65 + F.col("person_id") % 26))


def _td(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(c.cast("string"), F.lit("")), F.lit("</td>")) for c in cells], F.lit("</tr>"))


@query(R + f"SELECT {_AS}, {_TIME_SQL} AS time_text FROM r")
def p22_dispatched_shapes(spark, sf):
    """Lists in four shapes in turn: a table of labels, a fixed-width report, a club table, the report within a page."""
    r = results(spark, sf)
    rank, time = F.coalesce(F.col("rank").cast("string"), F.lit("")), N.format_time("time_s")
    n, lit = F.col("n").cast("string"), F.lit
    fixed = F.concat(F.rpad(rank, 5, " "), F.rpad(_person(), 25, " "), F.rpad("club", 25, " "), F.lpad(time, 8, " "))
    report = F.concat(lit("Klasse A ("), n, lit(")\n"), lit("Pl".ljust(5) + "Name".ljust(25) + "Verein".ljust(25) + "   Zeit\n"))
    table = F.concat(lit("<table><tr><td>Klasse A ("), n, lit(")</td></tr><tr><th>Pl<th>Name<th>Verein<th>Zeit</tr>"))
    counted = F.concat(lit("<table><tr><td>Klasse A</td><td>("), n, lit("/"), n, lit(")</td><td>Zeit</td></tr>"))
    cells = _td(rank, _person(), F.col("club"), time)
    shapes = [_pages(r.filter("list_id % 4 = 0"), cells, table), _pages(r.filter("list_id % 4 = 1"), fixed, report), _pages(r.filter("list_id % 4 = 2"), cells, counted)]
    inside = _pages(r.filter("list_id % 4 = 3"), fixed, report)
    docs = shapes[0].union(shapes[1]).union(shapes[2]).union(inside.select("list_id", F.concat(lit("<html><pre>"), "html", lit("</pre></html>"))))
    return html.parsed(docs, "html", "list_id", layout.dispatched, fields=("row_pos", "rank", "name", "club", "time_text"))


_TEAM_ROWS = R + f""", t AS (SELECT *, {_TIME_SQL} AS time_text, 'Team ' || chr(65 + (seq - 1)::INT % 26) || repeat('x', ((seq - 1) // 26)::INT) AS team FROM r)
SELECT list_id, (2 * (seq - 1) + i - 1)::INT AS row_pos, seq::INT AS rank, team, i::INT AS leg, CASE WHEN i = 1 THEN 'Anna B' ELSE 'Eva C' END AS name, time_text, (time_s * 2 // 60)::VARCHAR || ':' || lpad((time_s * 2 % 60)::VARCHAR, 2, '0') AS team_time FROM t, (VALUES (1), (2)) v(i)"""


def _teams(spark, sf) -> tuple[DataFrame, Column, Column, Column]:
    r = results(spark, sf)
    return r, F.concat(F.lit("Team "), F.expr("chr(65 + (seq - 1) % 26)"), F.expr("repeat('x', cast((seq - 1) div 26 as int))")), N.format_time("time_s"), N.format_time(F.col("time_s") * 2)


@query(_TEAM_ROWS)
def p21_relay_text(spark, sf):
    r, team, time, both = _teams(spark, sf)
    line = F.concat(F.col("seq").cast("string"), F.lit(" "), (F.col("seq") + 100).cast("string"), F.lit(" "), team, F.lit(" "), both, F.lit("\nName Jg Zeit\nAnna B 13 "), time, F.lit("\nEva C "), time)
    docs = _pages(r, line, F.concat(F.lit("Klasse A ("), F.col("n").cast("string"), F.lit(")\nPl Stnr Staffel Zeit\n")))
    return html.parsed(docs, "html", "list_id", layout.dispatched, fields=("row_pos", "rank", "team", "leg", "name", "time_text", "team_time"))


@query(_TEAM_ROWS)
def p6_numbered_relay(spark, sf):
    r, team, time, both = _teams(spark, sf)
    none, lit = F.lit(""), F.lit
    member = lambda n, name: _td(none, lit(f"{n}."), lit(name), time, lit("x"), none)
    line = F.concat(_td(none, F.concat(F.col("seq").cast("string"), lit(".")), team, both), member(1, "Anna B"), member(2, "Eva C"))
    docs = _pages(r, line, F.concat(lit("<table><tr><td></td><td>Klasse A</td><td>("), F.col("n").cast("string"), lit(" / "), F.col("n").cast("string"), lit(")</td></tr>")))
    return html.parsed(docs, "html", "list_id", layout.dispatched, fields=("row_pos", "rank", "team", "leg", "name", "time_text", "team_time"))


@query(R + f"SELECT list_id, i::INT AS stage, {_AS.removeprefix('list_id, ')}, CASE WHEN i = 1 THEN {_TIME_SQL} ELSE (time_s * 2 // 60)::VARCHAR || ':' || lpad((time_s * 2 % 60)::VARCHAR, 2, '0') END AS time_text FROM r, (VALUES (1), (2)) v(i)")
def p9_multistage(spark, sf):
    r = results(spark, sf)
    cells = _td(F.col("rank"), _person(), F.col("club"), N.format_time("time_s"), N.format_time(F.col("time_s") * 2))
    docs = _pages(r, cells, F.concat(F.lit("<table><tr><td>Klasse A ("), F.col("n").cast("string"), F.lit(")</td></tr><tr><th>Pl<th>Name<th>Verein<th>Zeit 1<th>Zeit 2</tr>")))
    return html.parsed_stages(docs, 2, "html", "list_id", fields=("row_pos", "rank", "name", "club", "time_text"))


@query(R + f"SELECT {_AS}, {_TIME_SQL} AS time_text FROM r")
def p18_positioned_pages(spark, sf):
    """Lists as pages of positioned words, three rows a page, with titles and page numbers that are no rows."""
    r = results(spark, sf).withColumn("page", F.expr("(seq - 1) div 3"))
    word = lambda x, top, t: F.struct(F.lit(float(x)).alias("x0"), top.cast("double").alias("top"), t.cast("string").alias("text"))
    top = 60 + (F.col("seq") - 1) % 3 * 12
    rank = F.when(F.col("rank").isNotNull(), F.array(word(10, top, F.col("rank"))))
    club = [F.split_part("club", F.lit(" "), F.lit(i)) for i in (1, 2)]
    row = F.concat(F.coalesce(rank, F.array().cast("array<struct<x0:double,top:double,text:string>>")), F.array(word(60, top, F.lit("Person")), word(110, top, F.chr(65 + F.col("person_id") % 26)), word(200, top, club[0]), word(230, top, club[1]), word(300, top, N.format_time("time_s"))))
    at = lambda t: F.lit(float(t))
    labels = F.array(*[word(x, at(40), F.lit(t)) for x, t in ((10, "Pl"), (60, "Name"), (200, "Verein"), (300, "Zeit"))])
    head = F.when(F.col("page") == 0, F.array(word(10, at(20), F.lit("Klasse")), word(40, at(20), F.lit("A")), word(60, at(20), F.concat(F.lit("("), F.col("n").cast("string"), F.lit(")")))))
    plain = F.array(word(10, at(5), F.lit("Cup")), word(10, at(800), F.lit("Seite")), word(50, at(800), F.col("page") + 1))
    keep = F.when(F.col("n") > 3, plain)  # a document of one page has no furniture to tell
    none = F.array().cast("array<struct<x0:double,top:double,text:string>>")
    above = F.when(F.col("seq") % 3 == 1, F.concat(F.coalesce(keep, none), F.coalesce(head, none), labels)).otherwise(none)
    parts = r.withColumn("n", F.count("*").over(Window.partitionBy("list_id"))).select("list_id", "page", F.concat(above, row).alias("words"))
    return layout.parsed_pages(parts, "list_id", fields=("row_pos", "rank", "name", "club", "time_text"), parts=True)
