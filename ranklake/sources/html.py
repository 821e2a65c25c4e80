"""HTML result documents: tolerant tables, positioned rows, and the state machines that read classes from them.

Parsing is row by row work on whole documents, so it runs as Arrow-batched functions over a
column of HTML; everything after the nested result is column expressions again.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: what headers, times, ranks and labels look like ---
HEADER = re.compile(r"^(?P<name>.*\S)\s*\(\s*(?P<n>\d+)\s*(?:/\s*\d+\s*)?\)")
TIME = re.compile(r"^\(?\s*\d{1,3}:\d{2}(?::\d{2})?")
RANK = re.compile(r"^(\d{1,4})\.?$")
_CHAMPION = re.compile(r"(?i)^(\d+)\.?\s+(?:und|&)\s+")

#: Column labels and what they hold.
LABELS = {
    "pl": "rank", "pl.": "rank", "platz": "rank", "pos": "rank", "place": "rank", "rang": "rank", "hely": "rank",
    "stnr": "bib", "st. no.": "bib", "rajtsz": "bib", "name": "name", "runner": "name", "név": "name", "teilnehmer": "name",
    "jg": "born", "szül": "born", "verein": "club", "club": "club", "klub": "club", "staffel": "team", "team": "team", "mannschaft": "team",
    "zeit": "time", "time": "time", "idõ": "time", "idő": "time", "laufzeit": "time", "leg": "leg", "kat": "kat", "punkte": "points",
}


# --- end of fixed values ---


def header(text: str) -> re.Match | None:
    """A class's line; without a bracket there is none to look for."""
    return HEADER.match(text) if "(" in text else None


class Tables(HTMLParser):
    """Rows of every table as lists of cell texts; open rows and cells are closed by the next one, rows without cells are kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.text: list[str] = []

    def _close_cell(self):
        if self.cell is not None and self.row is not None:
            self.row.append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
        self.cell = None

    def _close_row(self):
        self._close_cell()
        if self.row is not None and self.tables:
            self.tables[-1].append(self.row)
        self.row = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._close_row()
            self.tables.append([])
        elif tag == "tr":
            self._close_row()
            self.row = []
        elif tag in ("td", "th"):
            self._close_cell()
            if self.row is None:
                self.row = []
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._close_cell()
        elif tag == "tr":
            self._close_row()
        elif tag == "table":
            self._close_row()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        elif self.row is not None and data.strip():
            self.row.append(re.sub(r"\s+", " ", data).strip())

    def done(self) -> list[list[list[str]]]:
        self._close_row()
        return self.tables


#: A tag of plain writing, and the tags between which text is text; all else is left to the tolerant parser.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s+[a-zA-Z-]+="[^"<>]*")*\s*>""")
_PLAIN = frozenset("table thead tbody tfoot tr td th br b i u p div span a font center strong em small sup sub h1 h2 h3 h4 h5 h6 html body pre hr nobr".split())


@lru_cache(maxsize=1 << 12)
def _plain_tag(inside: str) -> str | None:
    """What a tag of plain writing does to a table, by the text between its brackets; None for any other tag. Tags recur, so the last ones are kept."""
    m = _TAG.fullmatch(f"<{inside}>")
    name = m[2].lower() if m else ""
    if name not in _PLAIN:
        return None
    if name in ("td", "th"):
        return "/cell" if m[1] else "cell"
    return m[1] + name if name in ("tr", "table", "br") else ""


#: Text and headings without attributes: in front of a table they tell nothing of it.
_FRONT = re.compile(r"[^<&]*(?:</?[hH][1-6]>[^<&]*)*")


def tables(html: str) -> list[list[list[str]]]:
    """The tables of a text; those of the text asked for last are kept, as several parsers may read one document.

    Headings in front are left out, so that a document and its only table are one text.
    """
    html = html or ""
    at = html.find("<table")
    return _tables(html[at:] if at > 0 and _FRONT.fullmatch(html, 0, at) else html)


@lru_cache(maxsize=1)
def _tables(html: str) -> list[list[list[str]]]:
    found = _plain_tables(html)
    if found is not None:
        return found
    p = Tables()
    p.feed(html)
    p.close()
    return p.done()


#: Cells of plain writing, and no more, up to the next row.
_OPEN = r"""<t[dh](?:\s+[a-zA-Z-]+="[^"<>]*")*\s*>"""
_CELLS = re.compile(rf"\s*(?:{_OPEN}[^<]*(?:</t[dh]>\s*)?)*(?:</tr>\s*)?")
_CELL = re.compile(rf"{_OPEN}([^<]*)")
#: A row of at most so many characters is kept with its cells, as rows of members, labels and heads recur.
LONGEST_KEPT = 600


def _cells(text: str) -> tuple[str, ...] | None:
    """The cells of a row's text behind its tag; None where it holds anything but cells."""
    if not _CELLS.fullmatch(text):
        return None
    return tuple([" ".join((unescape(c) if "&" in c else c).split()) if c else "" for c in _CELL.findall(text)])


#: Rows that are kept with what they were found to be: those of labels, heads and members recur.
_KEPT_ROWS = 1 << 14
_kept_cells = lru_cache(maxsize=_KEPT_ROWS)(_cells)


def _plain_tables(html: str) -> list[list[list[str]]] | None:
    """The tables of a text whose tags are all plain ones; None where it holds anything else."""
    out: list[list[list[str]]] = []
    row: list[str] | None = None
    cell: str | None = None
    for n, text in enumerate(html.split("<tr>")):
        if n:
            if cell is not None:
                row.append(" ".join(cell.split()) if cell else "")
                cell = None
            if row is not None and out:
                out[-1].append(row)
            cells = _kept_cells(text) if len(text) <= LONGEST_KEPT else _cells(text)
            if cells is not None:
                row = list(cells)
                continue
            row = []
        first, *pieces = text.split("<")
        if n and (before := " ".join(unescape(first).split())):
            row.append(before)
        for piece in pieces:
            inside, closed, data = piece.partition(">")
            tag = _plain_tag(inside) if closed else None
            if tag is None:
                return None
            if tag == "/cell":
                if cell is not None:
                    row.append(" ".join(cell.split()) if cell else "")
                    cell = None
            elif tag == "cell":
                if cell is not None:
                    row.append(" ".join(cell.split()) if cell else "")
                elif row is None:
                    row = []
                cell = ""
            elif tag == "br":
                if cell is not None:
                    cell += " "
            elif tag and tag != "/br":
                if cell is not None:
                    row.append(" ".join(cell.split()) if cell else "")
                    cell = None
                if row is not None and out:
                    out[-1].append(row)
                row = [] if tag == "tr" else None
                if tag == "table":
                    out.append([])
            if data:
                if "&" in data:
                    data = unescape(data)
                if cell is not None:
                    cell += data
                elif row is not None and data.strip():
                    row.append(" ".join(data.split()))
    if cell is not None:
        row.append(" ".join(cell.split()))
    if row is not None and out:
        out[-1].append(row)
    return out


@lru_cache(maxsize=1 << 15)
def label_of(text: str) -> str | None:
    """What a label stands for; cells recur, so the last ones are kept."""
    return LABELS.get(text.strip().lower())


def _labels(row: list[str]) -> list[str] | None:
    found = list(map(label_of, row))
    return found if ("name" in found or "team" in found) and len(found) - found.count(None) >= 2 else None


@lru_cache(maxsize=1 << 12)
def _rank(place: str) -> int | None:
    m = RANK.match(place)
    return int(m[1]) if m else None


def _row(cells: dict[str | None, str]) -> dict:
    place, born, leg = cells.get("rank", ""), cells.get("born", ""), cells.get("leg", "")
    return {
        "rank": _rank(place) if place else None,
        "name": cells.get("name") or cells.get("team") or "",
        "club": cells.get("club", ""),
        "time_text": cells.get("time", ""),
        "rank_text": place,
        "bib": cells.get("bib", ""),
        "born": int(born) if born.isdigit() else None,
        "kind": "individual",
        "team": None,
        "leg": int(leg) if leg.isdigit() else None,
    }


def parse_rows(rows: list[list[str]]) -> list[dict]:
    """Classes of a sequence of rows: a class header `name (n)`, a row of labels, then result rows.

    In a relay (a team label) a row with a rank or more cells than a member's is the team; the rows
    under it are its members. Ranks of champions (`1. und ...`) are carried to the row that follows.
    """
    classes: list[dict] = []
    labels: tuple[str | None, ...] | None = None
    team: dict | None = None
    carried: int | None = None
    relay = False
    members: dict[str, int] = {}  # rows of each team in the last class
    for cells in map(tuple, rows):
        kind, what, more = _kind_of(cells)
        if kind == "class":
            classes.append({"name": what, "declared": more, "results": []})
            team = carried = None
            members = {}
            continue
        if kind == "labels":
            labels, relay = what, "team" in what
            continue
        if kind == "none" or labels is None or not classes:
            continue
        champion = what
        if champion is not None and more <= 2:
            carried = champion
            continue
        read = _read_row(labels, cells)
        if read is None:
            continue
        out, numbered, own_team, own_name, names = read  # kept, so what is given out is a copy
        if out["rank"] is None and (champion is not None or carried is not None):
            out = {**out, "rank": champion if champion is not None else carried}
            carried = carried if champion is not None else None
        if relay:
            if numbered or team is None:
                team = {**out, "name": own_team or own_name}
                continue
            legs = members[team["name"]] = members.get(team["name"], 0) + 1
            classes[-1]["results"].append({**out, "kind": "relay", "name": own_name or own_team or "", "rank": team["rank"], "club": team["club"] or team["name"], "team": team["name"], "leg": out["leg"] or legs})
        elif names:  # several name columns: one team, a row a member
            own = own_team or " / ".join(names)
            members[own] = members.get(own, 0) + len(names)
            classes[-1]["results"] += [{**out, "kind": "team", "name": n, "leg": i, "team": own} for i, n in enumerate(names, 1)]
        else:
            classes[-1]["results"].append({**out})
    return classes


#: Rows of cells that are kept with their kinds, and with their results, at most (some 400 and 800 bytes each).
_KEPT_RESULTS = 1 << 16


@lru_cache(maxsize=_KEPT_RESULTS)
def _kind_of(cells: tuple[str, ...]) -> tuple:
    """A row's kind, what it says, and more: a class (name, count), labels (of each cell), none, or a row (a champion's place, filled cells)."""
    filled = [c for c in cells if c]
    if not filled:
        return "none", None, 0
    head = header(filled[0]) if len(filled) <= 4 else None
    if head and not TIME.match(filled[-1]):
        return "class", head["name"].strip(), int(head["n"])
    if own := _labels(cells):
        return "labels", tuple(own), len(filled)
    champion = _CHAMPION.match(filled[0]) if filled[0][0].isdecimal() else None
    return "row", int(champion[1]) if champion else None, len(filled)


@lru_cache(maxsize=_KEPT_RESULTS)
def _read_row(labels: tuple[str | None, ...], cells: tuple[str, ...]) -> tuple | None:
    """A row below labels: its result, whether it has a place or number, its team, its name, and its names if they are several."""
    named = dict(zip(labels, cells, strict=False))
    if not (named.get("name") or named.get("team")):
        return None
    names = tuple(c for k, c in zip(labels, cells, strict=False) if k == "name" and c) if labels.count("name") > 1 else ()
    return _row(named), bool(named.get("rank") or named.get("bib")), named.get("team"), named.get("name"), names if len(names) > 1 else ()


def parse_document(html: str) -> list[dict]:
    """Classes of an HTML document: from the rows of its tables, else from a table below each heading."""
    return parse_rows([r for t in tables(html) for r in t]) or parse_simple(html)


def parse_simple(html: str) -> list[dict]:
    """A heading, then a table of its class."""
    out = []
    for m in re.finditer(r"<h[1-6][^>]*>(.*?)</h[1-6]>\s*(<table.*?</table>)", html or "", re.I | re.S):
        name = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", m[1])).strip()
        rows = [r for t in tables(m[2]) for r in t]
        out += parse_rows([[f"{name} ({max(len(rows) - 1, 0)})"], *rows])
    return out


#: Labels of a stage's own columns: a word and the stage's number, or the number first. Fixed values.
STAGE_TIME = re.compile(r"(?i)^(?:(?:zeit|z|n|time|e|etappe|lauf|tag|stage)\s*\.?\s*(\d{1,2})|(\d{1,2})\.\s*(?:zeit|lauf|etappe|tag|stage))$")
STAGE_RANK = re.compile(r"(?i)^(?:pl\.?|platz|rang)\s*(\d{1,2})$")


def stage_columns(labels: list[str]) -> dict[int, dict[str, int]]:
    """The columns of each stage in a row of labels: its time, and its place if it has one of its own.

    Labels bear the stage's number; labels of time that come several times without one are the
    stages in their order. A row of less than two stages has none.
    """
    # labels of other rows are told by their cells alone, so only rows with two of them are looked at whole
    return _stage_columns(labels) if sum(map(_may_label, labels)) > 1 else {}


@lru_cache(maxsize=1 << 14)
def _may_label(label: str) -> bool:
    return bool(STAGE_TIME.match(label.strip())) or LABELS.get(label.strip().lower()) == "time"


def _stage_columns(labels: list[str]) -> dict[int, dict[str, int]]:
    out: dict[int, dict[str, int]] = {}
    for i, label in enumerate(labels):
        if m := STAGE_TIME.match(label.strip()):
            out.setdefault(int(m[1] or m[2]), {}).setdefault("time", i)
        elif m := STAGE_RANK.match(label.strip()):
            out.setdefault(int(m[1]), {}).setdefault("rank", i)
    out = {s: c for s, c in sorted(out.items()) if "time" in c}
    if len(out) < 2:
        plain = [i for i, label in enumerate(labels) if LABELS.get(label.strip().lower()) == "time"]
        out = {s: {"time": i} for s, i in enumerate(plain, 1)} if len(plain) > 1 else {}
    return out


def parse_multistage(html: str, stages: int | None = None) -> list[list[dict]]:
    """A table with columns of its own for each stage: classes by stage, as many as the labels show.

    A stage takes its own time and place; without a place of its own it takes the row's. Given a
    number, that many stages come back, empty ones too.
    """
    rows = [r for t in tables(html) for r in t]
    each = [stage_columns(r) for r in rows]
    found = {s for here in each for s in here}
    out = []
    for s in range(1, (stages if stages is not None else max(found, default=0)) + 1):
        own: list[list[str]] = []
        columns: dict[int, dict[str, int]] = {}
        for r, here in zip(rows, each, strict=True):
            columns = here or columns
            if here and s in here:
                mine, others = here[s], {i for t, c in here.items() if t != s for i in c.values()}
                labels = ["" if i in others or "rank" in mine and i != mine["rank"] and LABELS.get(c.strip().lower()) == "rank" else c for i, c in enumerate(r)]
                labels[mine["time"]] = "Zeit"
                if "rank" in mine:
                    labels[mine["rank"]] = "Pl"
                own.append(labels)
            elif not here:
                own.append(r)
        out.append(parse_rows(own) if s in columns else [])
    return out


CLASSES = (
    "array<struct<name:string,declared:int,results:array<struct<rank:int,name:string,club:string,time_text:string,"
    "rank_text:string,bib:string,born:int,kind:string,team:string,leg:int,team_time:string,out_of_competition:boolean,legs:int,uncounted:boolean>>>>"
)


_STRINGS = ("name", "club", "time_text", "rank_text", "bib", "kind", "team", "team_time")
_FLAGS = ("out_of_competition", "uncounted")
_FIELDS = [(f.split(":")[0], pa.string() if f.split(":")[0] in _STRINGS else pa.bool_() if f.split(":")[0] in _FLAGS else pa.int32()) for f in CLASSES.split("results:array<struct<")[1].rstrip(">").split(",")]


def _offsets(lists: Iterable[list]) -> pa.Array:
    return pa.array(accumulate(map(len, lists), initial=0), pa.int32())


def arrow_classes(docs: list[list[dict]]) -> pa.Array:
    """The classes of many documents as one Arrow column, put together column by column."""
    classes = [c for d in docs for c in d]
    rows = [r for c in classes for r in c["results"]]
    results = pa.StructArray.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in _FIELDS], [k for k, _ in _FIELDS])
    lists = pa.ListArray.from_arrays(_offsets(c["results"] for c in classes), results)
    heads = [pa.array([c["name"] for c in classes], pa.string()), pa.array([c["declared"] for c in classes], pa.int32())]
    return pa.ListArray.from_arrays(_offsets(docs), pa.StructArray.from_arrays([*heads, lists], ["name", "declared", "results"]))


#: Documents that are read and given on at once: their rows are many small objects, and should not all live together.
TOGETHER = 500
#: What a row of `flat_rows` says beside the key, and the fields of its result.
_HEADS = [("category_pos", pa.int32()), ("category", pa.string()), ("declared", pa.int32()), ("row_pos", pa.int32())]
_SQL = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}


def flat_rows(docs: list[list[dict]], fields: Iterable[str]) -> tuple[pa.Array, list[pa.Array]]:
    """The rows of many documents as Arrow columns: the document of each, and what `fields` name of its class and itself."""
    each = [(d, i, c) for d, classes in enumerate(docs) for i, c in enumerate(classes) if c["results"]]
    rows = [r for _, _, c in each for r in c["results"]]
    counts = [len(c["results"]) for _, _, c in each]
    of_class = np.repeat(np.arange(len(each)), counts)
    heads = {
        "category_pos": lambda: [i for _, i, _ in each],
        "category": lambda: [c["name"] for _, _, c in each],
        "declared": lambda: [c["declared"] for _, _, c in each],
    }
    kinds = dict(_HEADS + _FIELDS)
    out = []
    for f in fields:
        if f in heads:
            out.append(pa.array(heads[f](), kinds[f]).take(pa.array(of_class)))
        elif f == "row_pos":
            starts = np.cumsum([0, *counts[:-1]]) if counts else np.zeros(0, int)
            out.append(pa.array((np.arange(len(rows)) - np.repeat(starts, counts)).astype("int32")))
        else:
            out.append(pa.array([r.get(f) for r in rows], kinds[f]))
    return pa.array(np.repeat(np.array([d for d, _, _ in each], "int64"), counts)), out


def uncollected(f: Callable, *args):
    """f's result, without the collector at work: it would walk through all rows that are kept, again and again, and find no rings."""
    on = gc.isenabled()
    gc.disable()
    try:
        return f(*args)
    finally:
        if on:
            gc.enable()


def read_documents(docs: DataFrame, key: str, column: str, reader: Callable, fields: Iterable[str] | None = None) -> DataFrame:
    """What a reader gives for the values of column, in Arrow batches: key and classes, or, given fields, a row for each result.

    `reader()` is called once a task and gives the function that takes the Arrow values of some
    documents and returns the classes of each. Fields are those of `flattened`, in any order; a
    result's row then comes straight from the parser, without the nested column between.
    """
    fields = list(fields) if fields is not None else None

    def one(read: Callable, part: pa.RecordBatch) -> pa.RecordBatch:
        return given(part.column(key), read(part.column(column)), key, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                yield uncollected(one, read, b.slice(at, TOGETHER))

    return docs.select(key, column).mapInArrow(run, given_kind(docs, key, fields))


def given(keys: pa.Array, found: list[list[dict]], key: str, fields: list[str] | None) -> pa.RecordBatch:
    """The classes of documents with their keys or, given fields, their rows."""
    if fields is None:
        return pa.RecordBatch.from_arrays([keys, arrow_classes(found)], [key, "classes"])
    of, columns = flat_rows(found, fields)
    return pa.RecordBatch.from_arrays([keys.take(of), *columns], [key, *fields])


def given_kind(docs: DataFrame, key: str, fields: list[str] | None) -> str:
    """The schema of `given`."""
    kinds = dict(_HEADS + _FIELDS)
    what = f"classes {CLASSES}" if fields is None else ", ".join(f"`{f}` {_SQL[kinds[f]]}" for f in fields)
    return f"`{key}` {docs.schema[key].dataType.simpleString()}, {what}"


def each_parsed(docs: DataFrame, key: str, column: str, parser, fields: Iterable[str] | None = None) -> DataFrame:
    """key, classes (or, given fields, rows): what parser gives for the values of column."""
    return read_documents(docs, key, column, lambda: lambda values: [parser(x) for x in values.to_pylist()], fields)


def parsed(docs: DataFrame, html: str = "html", key: str = "page_id", parser=parse_document, fields: Iterable[str] | None = None) -> DataFrame:
    """key, classes (array) of every document, a null one has none; given fields, key and these of every row, as `flattened` has them."""
    return each_parsed(docs, key, html, lambda h: parser(h or ""), fields)


def parsed_stages(docs: DataFrame, stages: int | None = None, html: str = "html", key: str = "page_id", fields: Iterable[str] | None = None) -> DataFrame:
    """key, stage, classes of documents whose rows have a time for each stage (of `stages`, or as many as they show); stages without classes are left out.

    Given fields, key, stage and these of every row.
    """
    fields = list(fields) if fields is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                found = [(i, n, c) for i, h in enumerate(part.column(html).to_pylist()) for n, c in enumerate(parse_multistage(h or "", stages), 1) if c]
                keys, numbers, classes = part.column(key).take(pa.array([i for i, _, _ in found], pa.int64())), pa.array([n for _, n, _ in found], pa.int32()), [c for _, _, c in found]
                if fields is None:
                    yield pa.RecordBatch.from_arrays([keys, numbers, arrow_classes(classes)], [key, "stage", "classes"])
                else:
                    of, columns = flat_rows(classes, fields)
                    yield pa.RecordBatch.from_arrays([keys.take(of), numbers.take(of), *columns], [key, "stage", *fields])

    kind = docs.schema[key].dataType.simpleString()
    kinds = dict(_HEADS + _FIELDS)
    what = f"classes {CLASSES}" if fields is None else ", ".join(f"`{f}` {_SQL[kinds[f]]}" for f in fields)
    return docs.select(key, html).mapInArrow(run, f"`{key}` {kind}, stage int, {what}")


def flattened(classes: DataFrame, key: str) -> DataFrame:
    """A row for each result, with the places that order them."""
    c = classes.select(key, F.posexplode("classes").alias("category_pos", "c"))
    return c.select(key, "category_pos", F.col("c.name").alias("category"), F.col("c.declared").alias("declared"), F.posexplode("c.results").alias("row_pos", "r")).select(key, "category_pos", "category", "declared", "row_pos", "r.*")


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, n_links, title: what a page shows without a parser, in built-in functions."""
    from ..functions.text import html_title

    return pages.select(key, F.regexp_count(html, F.lit(r"(?i)<a\b")).alias("n_links"), html_title(html).alias("title"))


def decoded(raw: bytes) -> str:
    """Bytes as UTF-8, else as Windows-1252."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")
