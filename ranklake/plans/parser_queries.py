"""Lists written in the shapes that result documents have, and read back: every row of every list, in each shape.

`printed` says what a document shows of a result: names of one to four words, clubs of one to eight
(some of them the end of others), no place or club here and there, a status in place of a time. The
SQL of every query says the same of the table itself, so it knows nothing of shapes and parsers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..sources import brackets, html, layout
from ..sources.clubs import dictionary, flow_classes, flow_rows, proven_rows
from .queries import query
from .rule_queries import _pages, _td, _teams, _TEAM_ROWS, in_turn
from .tables import R, results

GIVEN = ("Anna", "Max", "Eva", "Ida", "Ute", "Karl", "Ed")
#: Clubs of one to eight words; each is the end of no name, and some end others.
CLUBS = (
    "Wien", "NF Wien", "HSV NF Wien", "OLC Graz", "Graz", "Orienteering Innsbruck Imst", "Naturfreunde Villach - Orienteering", "BG/BRG Zehnergasse Wiener Neustadt", "SK Brno",
    "Klub der Freunde des Laufs im Wald", "Laufklub Kompass Innsbruck Imst", "Ost", "SV Ost", "Verein für Sport und Spiel in Tirol Nord", "ASKÖ Henndorf", "TSV 1860", "Union Nord", "Turnverein Bad Ischl", "Waldläufer", "Sokol Kremze",
)


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: What the printed rows say, as SQL.
P = (
    R
    + f""", p AS (
  SELECT list_id, seq, CASE WHEN status = 'ok' THEN rank END AS rank, time_s,
    list_extract({_list(GIVEN)}, (person_id % {len(GIVEN)})::INT + 1) || list_extract(['', ' Berg', ' Maria Berg', ' Maria von Berg'], (person_id % 4)::INT + 1) AS name,
    CASE WHEN seq % 7 = 6 THEN '' ELSE list_extract({_list(CLUBS)}, substr(club, 6)::INT + 1) END AS club,
    CASE status WHEN 'ok' THEN (time_s // 60)::VARCHAR || ':' || lpad((time_s % 60)::VARCHAR, 2, '0') WHEN 'dnf' THEN 'Aufg.' ELSE 'Fehlst.' END AS value
  FROM r)
"""
)
ROWS = P + "SELECT list_id, (seq - 1)::INT AS row_pos, rank, name, club, value AS time_text FROM p"


def _club() -> Column:
    return F.element_at(F.array(*map(F.lit, CLUBS)), F.substring("club", 6, 9).cast("int") + 1)


def printed(spark, sf) -> DataFrame:
    return results(spark, sf).select(
        "list_id",
        "seq",
        F.when(F.col("status") == "ok", F.col("rank")).alias("rank"),
        "time_s",
        F.concat(in_turn(list(GIVEN), "person_id"), in_turn(["", " Berg", " Maria Berg", " Maria von Berg"], "person_id")).alias("name"),
        F.when(F.col("seq") % 7 == 6, "").otherwise(_club()).alias("club"),
        F.when(F.col("status") == "ok", N.format_time("time_s")).when(F.col("status") == "dnf", "Aufg.").otherwise("Fehlst.").alias("value"),
    )


def _text(*parts: Column | str) -> Column:
    """Columns and texts in one run; a null is empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _c(name: str) -> Column:
    return F.col(name)


def _known(p: DataFrame) -> list[str]:
    return dictionary(p.select("club"))


def _read(docs: DataFrame, clubs: list[str] | None = None) -> DataFrame:
    return layout.parsed_texts(docs, clubs, "html", "list_id", fields=("row_pos", "rank", "name", "club", "time_text"))


# placed elements ---------------------------------------------------------------------------------


def _at(left: int, top: Column, text: Column | str) -> Column:
    """A placed element, nothing for an empty text."""
    out = _text(f'<div style="position:absolute; left:{left}px; top:', top, 'px">', text, "</div>")
    return out if isinstance(text, str) else F.when(F.coalesce(text.cast("string"), F.lit("")) != "", out).otherwise("")


@query(ROWS)
def p5_placed_lists(spark, sf):
    """Lists as placed elements, every other one with labels; places and clubs are missing here and there."""
    p = printed(spark, sf)
    top, n = F.col("seq") * 20 + 100, F.col("n")
    rows = _text(_at(528, top, F.when(F.col("seq") > 1, "+0:01")), _at(483, top, _c("value")), _at(280, top, _c("club")), _at(78, top, _c("name")), _at(48, top, _c("rank")))
    labels = _text(*[_at(x, F.lit(80), t) for x, t in ((48, "Pl"), (78, "Name"), (280, "Verein"), (483, "Zeit"), (528, "Diff"))])
    head = _text(_at(48, F.lit(20), "Cup"), F.when(F.col("list_id") % 2 == 0, labels).otherwise(""), _at(48, F.lit(60), "Klasse A"), _at(280, F.lit(60), _text("(", n, " / ", n, ")")))
    return _read(_pages(p, rows, head))


@query(_TEAM_ROWS)
def p5_placed_relays(spark, sf):
    """Relays as placed elements: a row a team, rows of members below with cells of their own places."""
    r, team, time, both = _teams(spark, sf)
    top, n = F.col("seq") * 90 + 100, F.col("n")
    member = lambda i, name: _text(_at(102, top + 20 * i, name), _at(384, top + 20 * i, time))
    rows = _text(_at(48, top, _text(_c("seq"), ".")), _at(78, top, team), _at(528, top, both), member(1, "Anna B"), member(2, "Eva C"))
    docs = _pages(r, rows, _text(_at(48, F.lit(20), "Klasse A"), _at(384, F.lit(20), _text("(", n, " / ", n, ")"))))
    return layout.parsed_texts(docs, None, "html", "list_id", fields=("row_pos", "rank", "team", "leg", "name", "time_text", "team_time"))


# knock-out ---------------------------------------------------------------------------------------

_HEATS = P + """, q AS (SELECT list_id, seq, time_s, 'Anna ' || chr(65 + ((seq - 1) // 26)::INT % 26) || chr(97 + (seq - 1)::INT % 26) AS person, seq % 2 AS h,
  row_number() OVER (PARTITION BY list_id, seq % 2 ORDER BY seq) AS q_place FROM p)
, s AS (SELECT list_id, seq, row_number() OVER (PARTITION BY list_id ORDER BY time_s, seq) AS s_place FROM q WHERE q_place <= 2)
, f AS (SELECT list_id, seq, row_number() OVER (PARTITION BY list_id ORDER BY seq DESC) AS f_place FROM s WHERE s_place <= 2)
, a AS (SELECT q.*, s_place, f_place, CASE WHEN f_place IS NOT NULL THEN 4 WHEN s_place IS NOT NULL THEN 3 ELSE 2 END AS round FROM q LEFT JOIN s USING (list_id, seq) LEFT JOIN f USING (list_id, seq))
SELECT list_id, person, round::INT AS round, CASE round WHEN 4 THEN 'Finale' WHEN 3 THEN 'Halbfinale' WHEN 2 THEN 'Viertelfinale ' || CASE h WHEN 1 THEN 'A' ELSE 'B' END END AS heat,
  CASE round WHEN 4 THEN 'Halbfinale' WHEN 3 THEN 'Viertelfinale ' || CASE h WHEN 1 THEN 'A' ELSE 'B' END END AS from_heat,
  rank() OVER (PARTITION BY list_id ORDER BY round DESC, coalesce(f_place, s_place, q_place), time_s)::INT AS place FROM a"""


@query(_HEATS)
def p7_knock_out(spark, sf):
    """Lists as knock-out pages: two quarter finals, a semi-final and a final in one table, read back and put together."""
    by = lambda *keys: Window.partitionBy("list_id", *keys)
    q = printed(spark, sf).withColumn("h", F.col("seq") % 2).withColumn("person", F.concat(F.lit("Anna "), F.expr("chr(65 + (seq - 1) div 26 % 26)"), F.expr("chr(97 + (seq - 1) % 26)")))
    q = q.withColumn("q_place", F.row_number().over(by("h").orderBy("seq")))
    q = q.withColumn("s_place", F.when(F.col("q_place") <= 2, F.row_number().over(by(F.col("q_place") <= 2).orderBy("time_s", "seq"))))
    q = q.withColumn("f_place", F.when(F.col("s_place") <= 2, F.row_number().over(by(F.coalesce(F.col("s_place") <= 2, F.lit(False))).orderBy(F.desc("seq")))))
    heats = [(1, "Viertelfinale A", "q_place", F.col("h") == 1), (2, "Viertelfinale B", "q_place", F.col("h") == 0), (3, "Halbfinale", "s_place", F.lit(True)), (4, "Finale", "f_place", F.lit(True))]
    rows = [F.when(F.col(place).isNotNull() & inside, F.struct(F.lit(n).alias("heat"), F.col(place).alias("place"), F.lit(name).alias("title"))) for n, name, place, inside in heats]
    each = q.select("list_id", "person", "club", "time_s", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("list_id", "person", "club", "time_s", "x.*")
    none, value = F.lit(""), N.format_time("time_s")
    line = F.when(F.col("place") == 1, _td(none, F.lit("1. und Österreichische Meisterin"), _c("person"), _c("club"), value)).otherwise(_td(none, _text(_c("place"), "."), _c("person"), _c("club"), value, F.lit("+0:01")))
    cells = each.groupBy("list_id", "heat", "title").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))), lambda x: x["t"]), "").alias("rows"))
    block = F.concat(_td(none, _c("title"), _text("(", _c("n"), " / ", _c("n"), ")"), F.lit("Time"), F.lit("Behind")), "rows")
    docs = cells.groupBy("list_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("heat", block.alias("t")))), lambda x: x["t"]), "").alias("t"))
    docs = docs.select("list_id", _text("<table>", _td(none, F.lit("KO-Sprint"), F.lit("2024-05-01")), _c("t"), "</table>").alias("html"))
    got = html.parsed(docs, "html", "list_id", brackets.parse_bracket, fields=("category", "rank", "name", "time_text")).withColumn("time_s", N.parse_time("time_text"))
    return brackets.overall(got, "list_id").select("list_id", "person", "round", "heat", "from_heat", "place")


# flowing rows ------------------------------------------------------------------------------------


def _flow() -> Column:
    return F.regexp_replace(_text(F.when(F.col("rank").isNotNull(), _text(_c("rank"), ". ")), _c("name"), " ", _c("club"), " ", _c("value")), " +", " ")


@query(P + "SELECT list_id, seq::INT AS line, 'Klasse A' AS category, rank, name, club, value AS time_text FROM p")
def p19_flowing_rows(spark, sf):
    """Lists as lines of words, joined to the dictionary of all clubs: the longest club that ends a line is its club."""
    p = printed(spark, sf)
    rows = p.select("list_id", F.col("seq").cast("int").alias("line"), _flow().alias("text"))
    heads = p.groupBy("list_id").agg(F.count("*").alias("n")).select("list_id", F.lit(0).alias("line"), _text("Klasse A (", F.col("n"), ")").alias("text"))
    got = flow_rows(flow_classes(rows.union(heads), "list_id", "line"), p.select("club"), ["list_id", "line", "category"])
    return got.select("list_id", "line", "category", "rank", "name", "club", "time_text")


@query(ROWS)
def p19_flowing_documents(spark, sf):
    """The same lines as a document a list, read by the trie of the clubs."""
    p = printed(spark, sf)
    return _read(_pages(p, _flow(), _text("Klasse A (", F.col("n"), ")\n")), _known(p))


# cells that lost their borders --------------------------------------------------------------------

#: Clubs whose beginnings tell them apart, for cells that are cut off and mixed.
MIXED = ("Orienteering Innsbruck Imst", "Naturfreunde Villach", "HSV Wiener Neustadt", "OLC Graz Nord", "Laufklub Kompass", "SKV Deutsch Kaltenbrunn", "Sportunion Hall")
_MIXED_SQL = P + f"SELECT list_id, seq::INT AS line, name, list_extract({_list(MIXED)}, (time_s % {len(MIXED)})::INT + 1) AS club, value AS time_text FROM p"


@query(_MIXED_SQL)
def p23_mixed_letters(spark, sf):
    """The end of every club stands letter by letter between the characters of its result, and is drawn out again."""
    p = printed(spark, sf).withColumn("club", in_turn(list(MIXED), "time_s"))
    # a column of its own, or it would be worked out for every letter
    p = p.withColumn("rest", F.replace(F.expr("substring(club, instr(club, ' '))"), F.lit(" "), F.lit("")))
    rest, value = F.col("rest"), F.col("value")
    steps = F.sequence(F.lit(1), F.greatest(F.length(rest), F.length(value)))
    mixed = F.array_join(F.transform(steps, lambda i: F.concat(F.substring(rest, i, F.lit(1)), F.substring(value, i, F.lit(1)))), "")
    rows = p.withColumn("time_text", mixed).withColumn("club", F.expr("substring(club, 1, instr(club, ' ') - 1)"))
    return proven_rows(rows.select("list_id", F.col("seq").cast("int").alias("line"), "name", "club", "time_text"), sorted(MIXED))


_SHIFTED = P + "SELECT list_id, seq::INT AS line, CASE WHEN name NOT LIKE '% %' THEN name || ' Tal' ELSE name END AS name, CASE WHEN club = '' THEN 'Union Nord' ELSE club END AS club, value AS time_text FROM p"


@query(_SHIFTED)
def p24_shifted_cells(spark, sf):
    """Cells whose borders moved in one of five ways, cut anew where the dictionary proves how."""
    p = printed(spark, sf).withColumn("club", F.when(F.col("club") == "", "Union Nord").otherwise(F.col("club"))).withColumn("name", F.when(F.instr("name", " ") == 0, F.concat("name", F.lit(" Tal"))).otherwise(F.col("name")))
    first, last = F.expr("substring(name, 1, instr(name, ' ') - 1)"), F.expr("substring(name, instr(name, ' ') + 1)")
    blank = F.lit("")
    ways = [
        (first, F.concat(last, F.lit(" "), F.col("club")), F.col("value")),  # a name's words in the club's cell
        (F.col("name"), F.concat("club", F.lit(" "), "value"), blank),  # all behind the name in one cell
        (F.expr("substring(name, 1, length(name) - 2)"), F.concat(F.expr("substring(name, length(name) - 1)"), F.lit(" "), F.col("club")), F.col("value")),  # a name cut within a word
        (F.concat("name", F.lit(" "), "club"), blank, F.col("value")),  # a club in the name's cell
        (F.col("name"), F.expr("substring(club, 1, length(club) - 1)"), F.concat(F.expr("substring(club, length(club))"), F.lit(" "), F.col("value"))),  # a club's last letter before the result
    ]
    pick = lambda k: F.element_at(F.array(*[w[k] for w in ways]), (F.col("seq") % len(ways) + 1).cast("int"))
    rows = p.select("list_id", F.col("seq").cast("int").alias("line"), pick(0).alias("name"), pick(1).alias("club"), pick(2).alias("time_text"))
    return proven_rows(rows, sorted(CLUBS))


# pages of two columns ------------------------------------------------------------------------------


@query(P + "SELECT list_id, CASE seq % 2 WHEN 1 THEN 'HA' ELSE 'HB' END AS category, ((seq - 1) // 2)::INT AS row_pos, rank, name, club, value AS time_text FROM p")
def p20_two_columns(spark, sf):
    """Every list as two classes side by side, two rows of each a page; a class goes on at the top of its own side."""
    p = printed(spark, sf).withColumn("side", (F.col("seq") + 1) % 2).withColumn("nth", F.expr("(seq - 1) div 2"))
    p = p.withColumn("page", F.expr("nth div 2")).withColumn("n", F.count("*").over(Window.partitionBy("list_id"))).withColumn("n", F.expr("(n + 1 - side) div 2"))
    word = lambda left, top, t: F.struct(left.cast("double").alias("x0"), top.cast("double").alias("top"), t.alias("text"))
    words = F.split(_flow(), " ")
    line = lambda texts, top: F.transform(texts, lambda t, i: word(F.col("side") * 400 + 10 + i * 20, top, t))
    row = line(words, 40 + F.col("nth") % 2 * 12)
    head = F.when(F.col("nth") == 0, line(F.array(F.when(F.col("side") == 0, "HA").otherwise("HB"), _text("(", F.col("n"), ")")), F.lit(20)))
    none = F.array().cast("array<struct<x0:double,top:double,text:string>>")
    parts = p.select("list_id", "page", F.concat(F.coalesce(head, none), row).alias("words"))
    known = dictionary(results(spark, sf).select(_club().alias("club")))  # whether a row prints it or not, so no rows have to be ordered
    return layout.parsed_pages(parts, "list_id", clubs=known, fields=("category", "row_pos", "rank", "name", "club", "time_text"), parts=True)


# shapes told apart by what they give ---------------------------------------------------------------


def _shapes(n: Column) -> list[tuple[Column, Column, Column]]:
    """Head, line and end of each shape."""
    rank, name, club, value = _c("rank"), _c("name"), _c("club"), _c("value")
    lit, none = F.lit, F.lit("")
    count, counts = _text("Klasse A (", n, ")"), _text("(", n, " / ", n, ")")
    labelled = "<tr><th>Pl<th>Name<th>Verein<th>Zeit</tr>"
    pad = lambda c, w: F.rpad(_text(c), w, " ")
    fixed = F.concat(pad(rank, 5), pad(name, 30), pad(club, 50), F.lpad(value, 8, " "))
    report = _text(count, "\n", "Pl".ljust(5) + "Name".ljust(30) + "Verein".ljust(50) + "    Zeit\n")
    cells = _td(rank, name, club, value)
    top = F.col("seq") * 20 + 100
    at = _text(_at(48, top, rank), _at(78, top, name), _at(280, top, club), _at(483, top, value))
    return [
        (_text("<table><tr><td>", count, "</td></tr>", labelled), cells, none),
        (_text("<table><tr><td>Klasse A</td><td>", counts, "</td><td>Zeit</td></tr>"), cells, none),
        (_text("<table><tr><td>Klasse A ", counts, "</td></tr>"), _td(rank, lit("7"), name, lit("90"), club, value), none),
        (_text("<h3>Klasse A</h3>\n<table>", labelled), cells, lit("</table>")),
        (_text("<table><tr><td></td><td>Klasse A</td><td>", counts, "</td><td>Time</td></tr>"), _td(none, rank, name, club, value), none),
        (_text("<table><tr><th>Kat<th>Pl<th>Name<th>Verein<th>Zeit</tr>"), _td(lit("Klasse A"), rank, name, club, value), none),
        (_text(_at(48, F.lit(60), "Klasse A"), _at(280, F.lit(60), counts), *[_at(x, F.lit(80), t) for x, t in ((48, "Pl"), (78, "Name"), (280, "Verein"), (483, "Zeit"))]), at, none),
        (_text(_at(48, F.lit(60), "Klasse A"), _at(280, F.lit(60), counts)), at, none),
        (_text("<html><pre>\n", report), fixed, lit("\n</pre></html>")),
        (report, fixed, none),
        (_text(count, ";;;\nPl;Name;Verein;Zeit\n"), _text(rank, ";", name, ";", club, ";", value), none),
        (_text(count, "\nPl\tName\tVerein\tZeit\n"), _text(rank, "\t", name, "\t", club, "\t", value), none),
        (_text("Kat;Pl;Name;Verein;Zeit\n"), _text("Klasse A;", rank, ";", name, ";", club, ";", value), none),
        (_text(count, "\n"), _flow(), none),
        (_text(count, "\n", count, "\n"), _text("  ", _flow(), " +0:01"), none),
        (_text("<table><tr><td>", count, "</td></tr><tr><th>Rang<th>Stnr<th>Teilnehmer<th>Jg<th>Klub<th>Laufzeit</tr>"), _td(rank, lit("7"), name, lit("90"), club, value), none),
    ]


@query(ROWS)
def p22_arbitrated_shapes(spark, sf):
    """Lists in sixteen shapes in turn; of the parsers that a shape's marks allow, the counts choose."""
    p = printed(spark, sf)
    every = _shapes(F.col("n"))
    shape = (F.col("list_id") % len(every) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[s[i] for s in every]), shape)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", pick(1).alias("t")))), lambda x: x["t"]), "\n")
    docs = p.groupBy("list_id").agg(F.count("*").alias("n"), lines.alias("lines"))
    return _read(docs.select("list_id", F.concat(pick(0), "lines", pick(2)).alias("html")), _known(p))


@query(P + "SELECT list_id, ((seq - 1) * 2 + i - 1)::INT AS row_pos, rank, CASE i WHEN 1 THEN name ELSE 'Eva C' END AS name, club, value AS time_text, i::INT AS leg, name || ' / Eva C' AS team FROM p, (VALUES (1), (2)) v(i)")
def p2_team_tables(spark, sf):
    """Tables with a column of names for each member: a row a member, with the team's place and time."""
    head = _text("<table><tr><td>Klasse A (", F.col("n"), ")</td></tr><tr><th>Pl<th>Name<th>Name<th>Verein<th>Zeit</tr>")
    docs = _pages(printed(spark, sf), _td(_c("rank"), _c("name"), F.lit("Eva C"), _c("club"), _c("value")), head)
    return html.parsed(docs, "html", "list_id", fields=("row_pos", "rank", "name", "club", "time_text", "leg", "team"))


@query(_TEAM_ROWS.rpartition(", (time_s * 2")[0] + " FROM t, (VALUES (1), (2)) v(i)")
def p3_relay_tables(spark, sf):
    """Relay tables: a row a team with place and number, rows of its members below without."""
    r, team, time, both = _teams(spark, sf)
    head = _text("<table><tr><td>Klasse A (", F.col("n"), ")</td></tr><tr><th>Pl<th>Stnr<th>Staffel<th>Name<th>Zeit</tr>")
    none = F.lit("")
    line = F.concat(_td(_text(_c("seq"), "."), F.col("seq") + 100, team, none, both), _td(none, none, none, F.lit("Anna B"), time), _td(none, none, none, F.lit("Eva C"), time))
    return html.parsed(_pages(r, line, head), "html", "list_id", fields=("row_pos", "rank", "team", "leg", "name", "time_text"))


@query(ROWS)
def p8_headed_tables(spark, sf):
    docs = _pages(printed(spark, sf), _td(_c("rank"), _c("name"), _c("club"), _c("value")), _text("<h2>Klasse A</h2>\n<table><tr><th>Pl<th>Name<th>Verein<th>Zeit</tr>"))
    return _read(docs.withColumn("html", F.concat("html", F.lit("</table>"))))


@query(_TEAM_ROWS.replace("i::INT AS leg", "NULL::INT AS leg"))
def p12_team_blocks(spark, sf):
    """Text blocks: a team's line, its members' lines below and further in."""
    r, team, time, both = _teams(spark, sf)
    line = _text(_c("seq"), ". ", team, "   ", both, "\n    Anna B   ", time, "\n    Eva C   ", time)
    docs = _pages(r, line, _text("Klasse A (", F.col("n"), ")\n"))
    return html.parsed(docs, "html", "list_id", layout.parse_team_blocks, fields=("row_pos", "rank", "team", "leg", "name", "time_text", "team_time"))


@query(P + "SELECT list_id, (seq - 1)::INT AS row_pos, seq::INT AS rank, name, club, value AS time_text FROM p")
def p13_numbered_lines(spark, sf):
    """Text without labels: numbered lines whose columns are parted by two blanks."""
    line = _text(_c("seq"), ". ", _c("name"), F.when(F.col("club") != "", _text("  ", _c("club"))), "   ", _c("value"))
    docs = _pages(printed(spark, sf), line, _text("Klasse A (", F.col("n"), ")\n"))
    return html.parsed(docs, "html", "list_id", layout.parse_headerless, fields=("row_pos", "rank", "name", "club", "time_text"))


@query(P + "SELECT list_id, 'Damen ab 35 lang und weit' AS category, n::INT AS declared, (seq - 1)::INT AS row_pos, seq::INT AS rank, name, club, value AS time_text FROM p JOIN (SELECT list_id, count(*) AS n FROM p GROUP BY ALL) USING (list_id)")
def u16_continued_classes(spark, sf):
    """A class that goes on behind another title line, its name cut off there, is one class again."""
    again = F.when(F.col("seq") == 3, _text("Damen ab 35 lang u (", F.col("n"), ")\n"))
    p = printed(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("list_id")))
    line = _text(again, _c("seq"), ". ", F.regexp_replace(_text(_c("name"), " ", _c("club"), " ", _c("value")), " +", " "))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))), lambda x: x["t"]), "\n")
    docs = p.groupBy("list_id", "n").agg(lines.alias("lines")).select("list_id", _text("Damen ab 35 lang und weit (", F.col("n"), ")\n", F.col("lines")).alias("html"))
    known = _known(p)
    return layout.parsed_texts(docs, known, "html", "list_id", fields=("category", "declared", "row_pos", "rank", "name", "club", "time_text"))


# stages, long clubs, long names ----------------------------------------------------------------------


@query(P + """SELECT list_id, i::INT AS stage, (seq - 1)::INT AS row_pos, CASE WHEN list_id % 4 = 2 THEN (seq + i)::INT ELSE rank END AS rank, name, club, CASE WHEN i = 1 THEN value ELSE (time_s * 2 // 60)::VARCHAR || ':' || lpad((time_s * 2 % 60)::VARCHAR, 2, '0') END AS time_text FROM p, (VALUES (1), (2)) v(i)""")
def p9_stage_columns(spark, sf):
    """Two stages in one table, labelled in four ways in turn, once with a place of its own for each."""
    p = printed(spark, sf)
    second, count = N.format_time(F.col("time_s") * 2), _text("<table><tr><td>Klasse A (", F.col("n"), ")</td></tr>")
    heads = ["<th>Pl<th>Name<th>Verein<th>Zeit 1<th>Zeit 2", "<th>Pl<th>Name<th>Verein<th>E1<th>E2", "<th>Pl<th>Name<th>Verein<th>1. Lauf<th>Pl 1<th>2. Lauf<th>Pl 2", "<th>Pl<th>Name<th>Verein<th>Zeit<th>Zeit"]
    line = F.when(F.col("list_id") % 4 == 2, _td(_c("rank"), _c("name"), _c("club"), _c("value"), F.col("seq") + 1, second, F.col("seq") + 2)).otherwise(_td(_c("rank"), _c("name"), _c("club"), _c("value"), second))
    head = _text(count, "<tr>", in_turn(heads, "list_id"), "</tr>")
    return html.parsed_stages(_pages(p, line, head), None, "html", "list_id", fields=("row_pos", "rank", "name", "club", "time_text"))


@query(ROWS)
def p18_wrapped_clubs(spark, sf):
    """Pages of words whose long clubs go on in a line of their own; the labels stand on the first page alone."""
    p = printed(spark, sf).withColumn("page", F.expr("(seq - 1) div 3"))
    n = F.count("*").over(Window.partitionBy("list_id"))
    kind = "array<struct<x0:double,top:double,text:string>>"
    none = F.array().cast(kind)
    word = lambda left, top, t: F.struct(left.cast("double").alias("x0"), top.cast("double").alias("top"), t.alias("text"))
    run = lambda left, top, texts: F.transform(texts, lambda t, i: word(F.lit(left) + i, top, t))
    top = 60 + (F.col("seq") - 1) % 3 * 24
    texts = lambda c: F.when(F.col(c) != "", F.split(c, " ")).otherwise(F.array().cast("array<string>"))
    p = p.withColumn("words", texts("club"))  # a column of its own, as it is cut twice
    first, rest = F.slice("words", 1, 2), F.slice(F.col("words"), F.lit(3), F.greatest(F.size("words") - 2, F.lit(0)))
    place = F.when(F.col("rank").isNotNull(), F.array(word(F.lit(10.0), top, _text(_c("rank"))))).otherwise(none)
    row = F.concat(place, run(60.0, top, F.split("name", " ")), run(200.0, top, first), F.array(word(F.lit(300.0), top, _c("value"))), F.when(F.size(rest) > 0, run(200.0, top + 10, rest)).otherwise(none))
    labels = F.array(*[word(F.lit(x), F.lit(40), F.lit(t)) for x, t in ((10.0, "Pl"), (60.0, "Name"), (200.0, "Verein"), (300.0, "Zeit"))])
    head = F.concat(run(10.0, F.lit(20), F.split(_text("Klasse A (", F.col("n"), ")"), " ")), labels)
    parts = p.withColumn("n", n).select("list_id", "page", F.concat(F.when(F.col("seq") == 1, head).otherwise(none), row).alias("words"))
    return layout.parsed_pages(parts, "list_id", fields=("row_pos", "rank", "name", "club", "time_text"), parts=True)


@query(P + "SELECT list_id, (seq - 1)::INT AS row_pos, rank, CASE WHEN name NOT LIKE '% %' THEN name || ' Tal' ELSE name END AS name, CASE WHEN club = '' THEN 'Union Nord' ELSE club END AS club, value AS time_text FROM p")
def p10_overflowing_names(spark, sf):
    """Fixed-width reports whose columns are too narrow: what is longer pushes the rest of its line to the right."""
    p = printed(spark, sf).withColumn("club", F.when(F.col("club") == "", "Union Nord").otherwise(F.col("club"))).withColumn("name", F.when(F.instr("name", " ") == 0, F.concat("name", F.lit(" Tal"))).otherwise(F.col("name")))
    wide = lambda c, w: F.when(F.length(c) < w, F.rpad(c, w, " ")).otherwise(F.concat(c, F.lit(" ")))
    line = F.concat(F.rpad(_text(_c("rank")), 5, " "), wide(F.col("name"), 14), wide(F.col("club"), 20), _c("value"))
    head = _text("Klasse A (", F.col("n"), ")\n", "Pl".ljust(5) + "Name".ljust(14) + "Verein".ljust(20) + "Zeit\n")
    return _read(_pages(p, line, head), sorted(CLUBS))
