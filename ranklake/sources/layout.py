"""Text reports and pages of positioned words: lines, columns, and the classes they spell."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .brackets import parse_bracket
from .clubs import Clubs, flow_row, is_result, looks_named, proven, result_end, shared  # noqa: F401  flow_row is given out here too
from .html import HEADER, LABELS, TOGETHER, each_parsed, given, given_kind, header, parse_document, parse_rows, parse_simple, read_documents, tables, uncollected
from .positioned import parse_positioned
from .relays import Teams, parse_club_table, parse_numbered_relay, parse_relay_text, row

TIME_ROOM = 6  # characters a time may reach left of its label
LINE_ROOM = 16.0  # a line this far below one with a time may go on with it


def pre_blocks(html: str) -> list[str]:
    return [m[1] for m in re.finditer(r"<pre[^>]*>(.*?)</pre>", html or "", re.I | re.S)]


def column_bounds(labels: list[str], starts: list[int]) -> list[tuple[int, int | None]]:
    """Slices of a fixed-width line: each column runs to the next label; a time column begins earlier."""
    begin = [max(0, s - (TIME_ROOM if LABELS.get(x.lower()) == "time" and i else 0)) for i, (x, s) in enumerate(zip(labels, starts, strict=True))]
    return [(b, begin[i + 1] if i + 1 < len(begin) else None) for i, b in enumerate(begin)]


def parse_text(text: str) -> list[dict]:
    """A fixed-width report: a class line `name (n)`, a line of labels, then lines cut at the labels' places."""
    rows: list[list[str]] = []
    bounds: tuple[tuple[int, int | None], ...] | None = None
    for line in (text or "").expandtabs(8).splitlines():
        kind, said, places = _report_line(line)
        if kind == "labels":
            labels, bounds = list(said), places
            rows.append(labels)
        elif kind == "class":
            rows.append([said])
        elif kind == "row" and bounds:
            _add(rows, _slices(line, bounds), labels)
    return parse_rows(rows)


#: Lines of text that are kept with what they were found to be, at most: they recur.
_KEPT_LINES = 1 << 15


@lru_cache(maxsize=_KEPT_LINES)
def _report_line(line: str) -> tuple:
    """A line's kind, what it says and where: labels with their columns' bounds, a class, a row, or nothing."""
    if not line.strip():
        return "", None, None
    several = sum(w.lower() in LABELS for w in line.split()) >= 2
    known = [(m[0], m.start()) for m in _WORD.finditer(line) if m[0].lower() in LABELS] if several else []
    if len(known) >= 2 and any(LABELS[w.lower()] in ("name", "team") for w, _ in known):
        labels = [w for w, _ in known]
        return "labels", tuple(labels), tuple(column_bounds(labels, [s for _, s in known]))
    if header(line.strip()) and not re.search(r"\d:\d{2}\s*$", line):
        return "class", line.strip(), None
    return "row", None, None


@lru_cache(maxsize=_KEPT_LINES)
def _slices(line: str, bounds: tuple[tuple[int, int | None], ...]) -> list[str]:
    """A line's cells; no one changes them."""
    return [line[a:b].strip() for a, b in bounds]


@lru_cache(maxsize=1 << 10)
def _kinds(labels: tuple[str, ...]) -> list[str | None]:
    return [LABELS.get(x.lower()) for x in labels]


def _add(rows: list[list[str]], cells: list[str], labels: list[str]) -> None:
    """Add a line's cells; one that has a club and nothing else goes on with the club of the row above."""
    kinds = _kinds(tuple(labels))
    if cells.count("") < len(cells) - kinds.count("club"):  # more cells than clubs
        rows.append(cells)
        return
    held = {k for k, c in zip(kinds, cells, strict=True) if c}
    above = rows[-1] if rows else []
    if held == {"club"} and len(above) == len(cells) and above[kinds.index("club")] and "name" in kinds and above[kinds.index("name")] and above != labels:
        at = kinds.index("club")
        rows[-1] = [f"{c} {cells[i]}" if i == at else c for i, c in enumerate(above)]
    else:
        rows.append(cells)


def parse_headerless(text: str) -> list[dict]:
    """Numbered lines `1. Name  Club  12:34` under class lines, columns parted by two blanks."""
    rows: list[list[str]] = [["Pl", "Name", "Verein", "Zeit"]]
    rows += [r for line in (text or "").splitlines() if (r := _numbered_line(line))]
    return parse_rows(rows)


@lru_cache(maxsize=_KEPT_LINES)
def _numbered_line(line: str) -> list[str] | None:
    """A class line, or the cells of a numbered one; no one changes them."""
    parts = [p for p in re.split(r"\s{2,}|\t", line.strip()) if p]
    if header(line.strip()) and len(parts) == 1:
        return [line.strip()]
    if m := re.match(r"^(\d+)[.)]?\s+(.*)$", line.strip()):
        rest = [p for p in re.split(r"\s{2,}|\t", m[2]) if p]
        if len(rest) >= 2:
            return [m[1], rest[0], rest[1] if len(rest) > 2 else "", rest[-1]]
    return None


_WORD = re.compile(r"\S+")
Word = tuple[float, float, str]  # left edge, top, text
#: What a word tells of its line: a label, a result, a time, an opening bracket, a closing one at its end, blanks within or nothing at all.
_LABEL, _RESULT, _TIME, _OPEN, _CLOSE, _BLANK = 1, 2, 4, 8, 16, 32


@lru_cache(maxsize=_KEPT_LINES)
def _tells(text: str) -> int:
    own = (text.lower() in LABELS) * _LABEL | is_result(text) * _RESULT | bool(_CLOCK.search(text)) * _TIME
    return own | ("(" in text) * _OPEN | (text[-1:] == ")") * _CLOSE | (text.split() != [text]) * _BLANK


@lru_cache(maxsize=1 << 12)
def _marks(each: bytes) -> tuple[int, int, bool]:
    """Of words that tell so much each: the labels, all that they tell, and whether their line may part columns."""
    inner = 0
    for e in each[:-1]:
        inner |= e
    tells = inner | each[-1]
    labels = sum([e & _LABEL for e in each])
    return labels, tells, labels > 1 or inner & (_RESULT | _CLOSE) > 0


class Line:
    """Words of a line from left to right, and what they tell of it: how many labels, any of the marks, and whether it may part columns."""

    __slots__ = ("lefts", "texts", "each", "top", "labels", "tells", "parts")

    def __init__(self, lefts: list[float], texts: list[str], each: bytes, top: float, labels: int, tells: int, parts: bool):
        self.lefts, self.texts, self.each, self.top, self.labels, self.tells, self.parts = lefts, texts, each, top, labels, tells, parts

    @classmethod
    def of(cls, lefts: list[float], texts: list[str], each: bytes, top: float) -> Line:
        return cls(lefts, texts, each, top, *_marks(each))

    def plain(self) -> str:
        return " ".join(self.texts)

    def height(self) -> float:
        """The mean top of its words."""
        n = len(self.texts)
        return sum([self.top] * n) / n if n > 1 else self.top

    def cut(self, at: int) -> tuple[Line | None, Line | None]:
        """Its words before one, and from it on."""
        left = Line.of(self.lefts[:at], self.texts[:at], self.each[:at], self.top) if at else None
        return left, Line.of(self.lefts[at:], self.texts[at:], self.each[at:], self.top) if at < len(self.texts) else None


class _Uneven(Line):
    """A line whose words have tops of their own."""

    __slots__ = ("mean",)

    def height(self) -> float:
        return self.mean


def _line(words: list[Word]) -> Line:
    out = _Uneven.of([w[0] for w in words], [w[2] for w in words], bytes([_tells(w[2]) for w in words]), words[0][1])
    out.mean = sum(w[1] for w in words) / len(words)
    return out


def group_lines(words: list[Word], tolerance: float = 3.0) -> list[list[Word]]:
    """Words as lines: a word joins a line while its top is near the line's running mean."""
    lines: list[tuple[float, list[Word]]] = []
    for w in sorted(words, key=lambda w: (w[1], w[0])):
        if lines and abs(w[1] - lines[-1][0]) <= tolerance:
            top, own = lines[-1]
            own.append(w)
            lines[-1] = (top + (w[1] - top) / len(own), own)
        else:
            lines.append((w[1], [w]))
    return [sorted(own) for _, own in lines]


def parse_words(words: list[Word], tolerance: float = 3.0) -> list[dict]:
    """A page of positioned words."""
    return parse_pages([words], tolerance)


def without_furniture(pages: list[list[Line]], tolerance: float = 3.0) -> list[list[Line]]:
    """Pages of lines without those that stand on most pages at the same height: titles, footers, page numbers.

    Digits count as alike, so that a page number is furniture too; lines of labels and of classes,
    those that hold a result, and what stands between such or just below one, are none. A document
    of one page has none.
    """
    if len(pages) < 2:
        return pages
    spot = lambda line: round(line.height() / (2 * tolerance))
    rest: list[tuple[Line, str, int]] = []  # lines that are not told by themselves or by where they stand
    others: list[tuple[Line, int]] = []
    wanted: dict[str, dict[int, set[int]]] = {}
    for n, lines in enumerate(pages):
        inside = [line.top for line in lines if line.tells & _RESULT]
        for line in lines:
            tells = line.tells
            if tells & _TIME or line.labels > 1 or inside and inside[0] <= line.top <= inside[-1] + LINE_ROOM or tells & _OPEN and header(line.plain()):
                others.append((line, n))
            else:
                text, at = _alike(line.plain()), spot(line)
                rest.append((line, text, at))
                wanted.setdefault(text, {}).setdefault(at, set()).add(n)
    if not rest:
        return pages
    timed = any([":" in text for text in wanted])  # else no line with a time is like one of them
    for line, n in others:
        if (timed or not line.tells & _TIME) and (spots := wanted.get(_alike(line.plain()))) is not None:
            spots.setdefault(spot(line), set()).add(n)
    most = {(text, at): 2 * len(spots[at].union(spots.get(at - 1, ()), spots.get(at + 1, ()))) > len(pages) for text, spots in wanted.items() for at in spots}
    gone = {id(line) for line, text, at in rest if most[text, at]}
    return [[line for line in lines if id(line) not in gone] for lines in pages] if gone else pages


@lru_cache(maxsize=1 << 13)
def _alike(text: str) -> str:
    """A line's text with all figures as one."""
    return _FIGURES.sub("0", text)


def parse_pages(pages: list[list[Word]], tolerance: float = 3.0, clubs: Clubs | None = None) -> list[dict]:
    """Pages of positioned words as one document: furniture goes, labels hold on until the next ones.

    Pages of two columns are two streams of lines, each over all pages with a class of its own.
    Where a class has another number of rows than it declares, and its lines read as a flowing list
    give just that number, the flowing list counts.
    """
    return _parse_lines([[_line(words) for words in group_lines(p, tolerance)] for p in pages], tolerance, clubs)


def _parse_lines(pages: list[list[Line]], tolerance: float, clubs: Clubs | None) -> list[dict]:
    """`parse_pages` of pages whose words are lines already."""
    every = [line for page in without_furniture(pages, tolerance) for line in page]
    border = _border(every)
    if border is None:
        return _stream(every, clubs)
    cuts = [line.cut(bisect_left(line.lefts, border)) for line in every]
    return merged_continuations([c for side in (0, 1) for c in _stream([cut[side] for cut in cuts if cut[side]], clubs)])


def page_lines(rows: pa.ListArray, of_page: np.ndarray, pages: int, tolerance: float = 3.0) -> list[list[Line]]:
    """The lines of each page, of rows of words (struct<x0, top, text>) and the page of each row.

    The words of all pages are sorted, and cut into lines, at once; only pages where the tops of
    neighbours differ by less than the tolerance, or two words share a place, are walked through.
    A word without a place or text is none.
    """
    words, counts = rows.flatten(), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    left, top = (pc.struct_field(words, f).cast(pa.float64()) for f in ("x0", "top"))
    text = pc.struct_field(words, "text").dictionary_encode()
    page = np.repeat(of_page, counts)
    if words.null_count or left.null_count or top.null_count or text.null_count:
        there = np.flatnonzero(pc.and_(pc.and_(left.is_valid(), top.is_valid()), text.is_valid()).to_numpy(zero_copy_only=False))
        left, top, text, page = left.take(there), top.take(there), text.take(there), page[there]
    known = text.dictionary.to_pylist()
    found: list[list[Line]] = [[] for _ in range(pages)]
    if len(page):
        left, top, of = left.to_numpy(zero_copy_only=False), top.to_numpy(zero_copy_only=False), text.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((left, top, page))
        left, top, of, page = left[order], top[order], of[order], page[order]
        same, step = page[1:] == page[:-1], top[1:] - top[:-1]
        uneven = same & ((step > 0) & (step <= tolerance) | (step == 0) & (left[1:] == left[:-1]))
        walked = set(page[1:][uneven].tolist())
        starts = np.flatnonzero(np.concatenate([[True], ~same | (step != 0)]))
        ends = np.append(starts[1:], len(page))
        tells = np.array([_tells(t) for t in known], "uint8")[of]
        marks = tells.tobytes()
        lefts, texts = left.tolist(), np.array(known, object)[of].tolist()
        for p, a, b, at in zip(page[starts].tolist(), starts.tolist(), ends.tolist(), top[starts].tolist(), strict=True):
            found[p].append(Line.of(lefts[a:b], texts[a:b], marks[a:b], at))
        for p in walked:
            own = [(x, line.top, t) for line in found[p] for x, t in zip(line.lefts, line.texts, strict=True)]
            found[p] = [_line(words) for words in group_lines(own, tolerance)]
    return found


def _stream(lines: list[Line], clubs: Clubs | None) -> list[dict]:
    """Classes of lines that follow each other, by their columns or, where the counts say so, as flowing rows."""
    labels: list[str] = []
    middles: tuple[float, ...] = ()
    least = 0
    rows: list[list[str]] = []
    for line in lines:
        if line.labels > 1 and (heads := _heads(tuple(line.lefts), tuple(line.texts))):
            middles, least = heads[1:]
            labels = list(heads[0])
            rows.append(labels)
        elif line.tells & _OPEN and header(plain := line.plain()) and not re.search(r"\d:\d{2}$", line.texts[-1]):
            rows.append([plain])
        elif labels:
            lefts, texts, cells, at = line.lefts, line.texts, [], 0
            for middle in middles:
                to = bisect_left(lefts, middle, at)
                cells.append(" ".join(texts[at:to]))
                at = to
            cells.append(" ".join(texts[at:]))
            if cells.count("") < least:  # more cells than clubs
                rows.append(cells)
            else:
                _add(rows, cells, labels)
    found = merged_continuations(parse_rows(rows))
    if found and all(len(c["results"]) == c["declared"] for c in found):
        return found
    flowing = _flowing([s for line in lines for s in (_plain_lines(line.plain()) if line.tells & _BLANK else (line.plain(),))], clubs)
    if not any(c["results"] for c in found):
        return flowing
    by_name = {c["name"]: c for c in flowing}
    exact = lambda c: c["name"] in by_name and len(by_name[c["name"]]["results"]) == c["declared"] != len(c["results"])
    return [by_name[c["name"]] if exact(c) else c for c in found]


@lru_cache(maxsize=1 << 12)
def _heads(lefts: tuple[float, ...], texts: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[float, ...], int] | None:
    """The labels of a line, the borders of their columns, each midway between two labels, and how many of them are no clubs."""
    heads = [(x, t) for x, t in zip(lefts, texts, strict=True) if t.lower() in LABELS]
    if not any(LABELS[t.lower()] in ("name", "team") for _, t in heads):
        return None
    labels = tuple([t for _, t in heads])
    return labels, tuple([(a[0] + b[0]) / 2 for a, b in zip(heads, heads[1:], strict=False)]), len(labels) - _kinds(labels).count("club")


def gutter(lines: list[list[Word]], room: float = 6.0) -> float | None:
    """Where the right one of two columns of classes begins; None for pages of one column.

    A line votes for the left edge of a word that begins anew behind something complete: a place
    behind a result, a class behind a result or a class, a label that the line had before. The edge
    of most votes counts if both sides then have a line that is a class.
    """
    return _border([_line(words) for words in lines if words], room)


def _border(lines: list[Line], room: float = 6.0) -> float | None:
    votes: dict[float, int] = {}
    for line in lines:
        at = (_kept_vote(tuple(line.texts), line.each) if line.labels > 1 or line.tells & _OPEN else _vote(line.texts, line.each)) if line.parts else 0
        if at:
            votes[line.lefts[at]] = votes.get(line.lefts[at], 0) + 1
    if not votes:
        return None
    best = max(sorted(votes), key=lambda x: sum([n for v, n in votes.items() if abs(x - v) <= room])) if len(votes) > 1 else next(iter(votes))
    border = min([v for v in votes if abs(v - best) <= room]) - room
    left = right = False
    for line in lines:
        if line.tells & _CLOSE and not (left and right):
            at = bisect_left(line.lefts, border)
            left, right = left or _is_class(line.texts[:at]), right or _is_class(line.texts[at:])
    return border if left and right else None


def _is_class(texts: list[str]) -> bool:
    return bool(texts) and texts[-1][-1:] == ")" and _is_head(" ".join(texts))


@lru_cache(maxsize=1 << 12)
def _is_head(text: str) -> bool:
    return bool(HEADER.fullmatch(text))


def _vote(texts: list[str] | tuple[str, ...], each: bytes) -> int:
    """The word of a line that begins anew, 0 for none."""
    first = texts[0].lower() if each[0] & _LABEL else None
    for i, before in enumerate(each[:-1], 1):
        if before & _RESULT or before & _CLOSE and HEADER.fullmatch(" ".join(texts[:i])):
            # of what begins with a place three words tell
            if _BEGINS.match(" ".join(texts[i : i + 3])) or each[-1] & _CLOSE and HEADER.fullmatch(" ".join(texts[i:])):
                return i
        if first is not None and texts[i].lower() == first:
            return i
    return 0


@lru_cache(maxsize=1 << 12)
def _kept_vote(texts: tuple[str, ...], each: bytes) -> int:
    return _vote(texts, each)


_PLACE = re.compile(r"^\d{1,4}\.?\s+")
_CHAMPION = re.compile(r"(?i)^(\d+)\.?\s+(?:und|&)\s+\D*(?:meister\w*)(?:\s+\d{4})?$")
_CLOCK = re.compile(r"\d:\d{2}")
_BEGINS = re.compile(r"\d{1,3}\.?\s+\D")
_LETTER = re.compile(r"[^\W\d_]")
_TEAM_LINE = re.compile(r"^(?:(\d+)\.?\s+)?(\S.*?)\s{2,}(\S.*)$")
_MEMBER_LINE = re.compile(r"^\s+(\S.*?)(?:\s{2,}(\S.*))?$")
_FIGURES = re.compile(r"\d+")


def document_clubs(lines: list[str]) -> Clubs:
    """Clubs that a document shows itself: the words that end several rows behind different names.

    Of a row's endings that leave a name of two words or more, the one that is longest for its
    number of rows counts.
    """
    bodies = [end[0] for line in lines if (end := result_end(" ".join(line.split())))]
    each = [_PLACE.sub("", b).split() for b in bodies]
    ends: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for words in each:
        for n in range(1, len(words) - 1):
            if looks_named(words[:-n]):
                ends.setdefault(tuple(words[-n:]), set()).add(tuple(words[:-n]))
    found = set()
    for words in each:
        own = [tuple(words[-n:]) for n in range(1, len(words) - 1) if len(ends.get(tuple(words[-n:]), ())) > 1]
        if own:
            found.add(max(own, key=lambda e: len(ends[e]) * len(e)))
    return Clubs(" ".join(f) for f in found)


def parse_flowing(text: str, clubs: Clubs | None = None) -> list[dict]:
    """A list that flows in one run of words: class lines, then rank, name, club, time or status.

    The border of name and club is where a known club begins; without a dictionary the document's
    own repetitions are one. A champion's place on a line of its own goes to the row below.
    """
    return _flowing(_plain_lines(text or ""), clubs)


def _plain_lines(text: str) -> list[str]:
    """The lines of a text, their words parted by single blanks."""
    return [" ".join(line.split()) for line in text.splitlines()]


def _flowing(lines: list[str], clubs: Clubs | None) -> list[dict]:
    clubs = clubs or document_clubs(lines)
    flowing, out, results = clubs.flowing, [], None
    carried: int | None = None
    for s in lines:
        if "(" in s and (head := _flowing_head(s)):
            results = []
            out.append({"name": head[0], "declared": head[1], "results": results})
            carried = None
        elif results is None:
            continue
        elif s[:1].isdecimal() and (m := _CHAMPION.match(s)):
            carried = int(m[1])
        elif found := flowing(s):
            rank = found["rank"] if found["rank"] is not None else carried
            results.append(row(found["name"], found["club"], found["time_text"], None if found["ooc"] else rank, out_of_competition=found["ooc"]))
            carried = None
    return merged_continuations(out)


@lru_cache(maxsize=1 << 12)
def _flowing_head(text: str) -> tuple[str, int] | None:
    m = HEADER.match(text)
    return (m["name"].strip(), int(m["n"])) if m and (_is_head(text) or not _CLOCK.search(text)) else None


def parse_separated(text: str) -> list[dict]:
    """Values parted by semicolons or tabs: class lines, a line of labels, result lines; a class may be a column too."""
    rows: list[list[str]] = []
    for line in (text or "").splitlines():
        if line.strip():
            rows.append([c.strip().strip('"') for c in re.split(r"[;\t]", line)])
    return parse_by_column(rows) or parse_rows([[r[0]] if len([c for c in r if c]) == 1 else r for r in rows])


def parse_by_column(rows: list[list[str]]) -> list[dict]:
    """Rows whose class stands in a column of its own (labelled Kat), in the order of their first rows."""
    at, kinds, groups = None, [], {}
    for r in rows:
        own = [LABELS.get(c.strip().lower()) for c in r]
        if "kat" in own and "name" in own:
            at, kinds = own.index("kat"), r
        elif at is not None and len(r) == len(kinds) and r[at]:
            groups.setdefault(r[at], []).append(r)
    return [c for k, own in groups.items() for c in parse_rows([[f"{k} ({len(own)})"], kinds, *own])]


def parse_team_blocks(text: str) -> list[dict]:
    """Blocks of a ranked team line and indented member lines, each with its value behind two blanks."""
    out = Teams("team")
    for line in (text or "").splitlines():
        if not line.strip():
            continue
        if (m := header(line.strip())) and not _CLOCK.search(line):
            out.category(m["name"].strip(), int(m["n"]))
        elif m := _TEAM_LINE.match(line):
            if is_result(m[3].strip()):
                out.team(m[2], m[3].strip(), int(m[1]) if m[1] else None)
        elif out.open and (m := _MEMBER_LINE.match(line)):
            out.member(m[1], (m[2] or "").strip())
    return out.done()


def merged_continuations(classes: list[dict]) -> list[dict]:
    """A class that goes on (same name, or one of fifteen letters that begins it; equal count; other ranks) joins its first part."""
    if len(classes) < 2:
        return classes
    out: list[dict] = []
    for c in classes:
        for o in out:
            same = o["name"] == c["name"] or (min(len(o["name"]), len(c["name"])) >= 15 and (o["name"].startswith(c["name"]) or c["name"].startswith(o["name"])))
            ranks = {r["rank"] for r in o["results"]} & {r["rank"] for r in c["results"]} - {None}
            if same and o["declared"] == c["declared"] and not ranks:
                o["results"] = o["results"] + c["results"]
                break
        else:
            out.append(c)
    return out


_lowered = lru_cache(maxsize=1)(str.lower)


def _has(pattern: str, *needs: str) -> Callable[[str], bool]:
    """Whether a text has a pattern; without one of the plain beginnings it needs it is not searched."""
    find = re.compile(pattern).search

    def fits(t: str) -> bool:
        if needs:
            low = _lowered(t)
            for n in needs:
                if n in low:
                    break
            else:
                return False
        return find(t) is not None

    return fits


Parser = Callable[[str, Clubs | None], list[dict]]


def _of(parser: Callable[[str], list[dict]]) -> Parser:
    return lambda t, _: parser(t)


#: Signatures: a name, what a document must look like, and its parser. Where several fit, the rows they read decide (`dispatched`); of equals the first counts.
SIGNATURES: list[tuple[str, Callable[[str], bool], Parser]] = [
    ("numbered relay", _has(r"(?is)<t[dh][^>]*>\s*\(\d+\s*/\s*\d+\)\s*<.*<t[dh][^>]*>\s*1\.?\s*<", "<td", "<th"), _of(parse_numbered_relay)),
    ("club table", _has(r"(?is)\(\d+\s*/\s*\d+\)\s*</?t[dhr]|<t[dh][^>]*>\s*Zeit\s*</?t", "<t", "</t"), _of(parse_club_table)),
    ("knock-out", _has(r"(?is)<t[dh][^>]*>\s*\(\d+(?:\s*/\s*\d+)?\)\s*<", "<td", "<th"), _of(parse_bracket)),
    ("class column", _has(r"(?is)<t[dh][^>]*>\s*kat\s*<", "<td", "<th"), _of(lambda t: parse_by_column([r for x in tables(t) for r in x]))),
    ("tables", _has(r"(?i)<table", "<table"), _of(parse_document)),
    ("heading and table", _has(r"(?is)<h[1-6].*<table", "<h"), _of(parse_simple)),
    ("placed elements", _has(r"(?is)style\s*=[^>]*\bleft\s*:"), _of(parse_positioned)),
    ("preformatted", _has(r"(?i)<pre", "<pre"), lambda t, clubs: [c for block in pre_blocks(t) for c in dispatched(block, clubs)]),
    ("separated", _has(r"(?m)^[^<\n]*[;\t][^<\n]*[;\t]"), _of(parse_separated)),
    ("relay text", _has(r"(?im)^\s*pl(?:atz)?\b.*\b(?:staffel|team|mannschaft)\b.*\b(?:zeit|time)\b"), _of(parse_relay_text)),
    ("fixed width", _has(r"(?im)^\s*pl\.?\s+.*\bname\b"), _of(parse_text)),
    ("team blocks", _has(r"(?m)^\d+\.?\s+.+\s{2,}\S+\s*\n\s+\S"), _of(parse_team_blocks)),
    ("numbered lines", _has(r"(?m)^\d+[.)]?\s+\S+.*\s{2,}"), _of(parse_headerless)),
    ("flowing", lambda t: "<t" not in t.lower(), parse_flowing),
]


@lru_cache(maxsize=1 << 15)
def _sound(name: str, value: str | None, club: str | None) -> bool:
    """Whether a row has a name and a result, and no result for a club; rows recur, so the last ones are kept."""
    return bool(_LETTER.search(name)) and is_result(value) and not is_result(club)


def _units(rows: list[dict]) -> int:
    """Teams where all rows have one, else rows that are not left out of the count."""
    teams = {r.get("team") for r in rows}
    return len(teams) if all(teams) else len([r for r in rows if not r.get("uncounted")])


def agreement(classes: list[dict]) -> tuple[float, float, int]:
    """How far a reading of a document bears itself out: the share of classes with as many units as they
    declare, the share of rows with a name and a result, and the number of rows."""
    if not any(c["results"] for c in classes):
        return (0.0, 0.0, 0)
    rows = [r for c in classes for r in c["results"]]
    sound = sum([_sound(r["name"] or r.get("team") or "", r["time_text"], r["club"]) for r in rows])
    return (sum([_units(c["results"]) == c["declared"] for c in classes]) / len(classes), sound / len(rows), len(rows))


def dispatched(text: str, clubs: Clubs | None = None) -> list[dict]:
    """Classes of a document by the parser whose reading agrees best with the counts that it declares.

    Every signature that fits is read; one that agrees in all classes and rows ends the search, as
    none can do better. Rows are put right by the dictionary, if there is one, and by the repairs.
    """
    best, score = [], (0.0, 0.0, 0)
    for _, fits, parser in SIGNATURES:
        if not fits(text or ""):
            continue
        found = parser(text or "", clubs)
        own = agreement(found)
        if own > score:
            best, score = found, own
        if score[:2] == (1.0, 1.0):
            break
    return [{**c, "results": [repaired(proven(r, clubs) if clubs else r) for r in c["results"]]} for c in best]


def parsed_pages(pages: DataFrame, key: str = "page_id", page: str = "page", words: str = "words", clubs: list[str] | None = None, fields: Iterable[str] | None = None, parts: bool = False) -> DataFrame:
    """key, classes of documents given as a row a page, with words as array<struct<x0, top, text>>; clubs is a dictionary of bounded size.

    With parts, rows of one number are parts of one page. Given fields, key and these of every row,
    as `flattened` has them.
    """
    names = tuple(clubs or ())
    fields = list(fields) if fields is not None else None
    # the rows of a document come to stand together, each with their number, so none are collected into lists
    rows = pages.select(key, F.col(page).alias("_page"), F.col(words).alias("_words"), F.count("*").over(Window.partitionBy(key)).alias("_rows"))

    def one(known: Clubs | None, part: pa.RecordBatch, sizes: list[int]) -> pa.RecordBatch:
        docs = document_lines(part.column("_page"), part.column("_words"), sizes, parts)
        starts = np.cumsum([0, *sizes[:-1]])
        return given(part.column(key).take(pa.array(starts)), [_parse_lines(d, 3.0, known) for d in docs], key, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared(names) if names else None
        for part, sizes in whole_documents(batches, "_rows"):
            yield uncollected(one, known, part, sizes)

    return rows.mapInArrow(run, given_kind(pages, key, fields))


def whole_documents(batches: Iterable[pa.RecordBatch], rows: str) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of whole documents, `TOGETHER` at most, and the rows of each; rows of one stand together, and say how many they are."""
    held, missing = [], 0  # a document that goes on in the next batch
    for b in batches:
        at = min(missing, b.num_rows)
        if missing:
            held.append(b.slice(0, at))
            missing -= at
            if missing:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
            yield whole, [whole.num_rows]
        counts, begin, sizes = b.column(rows).to_pylist(), at, []
        while at < b.num_rows and at + counts[at] <= b.num_rows:
            sizes.append(counts[at])
            at += counts[at]
            if len(sizes) == TOGETHER:
                yield b.slice(begin, at - begin), sizes
                begin, sizes = at, []
        if sizes:
            yield b.slice(begin, at - begin), sizes
        if at < b.num_rows:
            held, missing = [b.slice(at)], counts[at] - (b.num_rows - at)


def document_lines(numbers: pa.Array, rows: pa.ListArray, sizes: list[int], parts: bool = False) -> list[list[list[Line]]]:
    """The lines of each page of documents that have so many rows each, in the order of page numbers (no number first).

    A row is a page, and of equal numbers the lesser words come first; with parts, rows of one number are one page.
    """
    doc, number = np.repeat(np.arange(len(sizes)), sizes), pc.rank(numbers, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
    order = np.lexsort((number, doc))
    new = np.concatenate([[True], (np.diff(doc[order]) != 0) | (number[order][1:] != number[order][:-1])])
    if not parts and not new.all():
        ends = np.append(np.flatnonzero(new)[1:], len(new))
        for a, b in zip(np.flatnonzero(new).tolist(), ends.tolist(), strict=True):
            if b - a > 1:
                order[a:b] = sorted(order[a:b].tolist(), key=lambda i: _nulls_first(rows[i].as_py()))
        new[:] = True
    of_page = np.empty(len(order), "int64")
    of_page[order] = np.cumsum(new) - 1
    pages = page_lines(rows, of_page, int(new.sum()))
    out, at = [], 0
    for n in np.bincount(doc[order][new], minlength=len(sizes)).tolist():
        out.append(pages[at : at + n])
        at += n
    return out


def _nulls_first(value: object) -> tuple:
    """What sorts nested values as Spark does."""
    if value is None:
        return (0,)
    each = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
    return (1, value if each is None else [_nulls_first(x) for x in each])


def parsed_words(pages: DataFrame, key: str = "page_id", words: str = "words") -> DataFrame:
    """key, classes of pages with words as array<struct<x0, top, text>>."""
    return each_parsed(pages, key, words, lambda ws: parse_words([(w["x0"], w["top"], w["text"]) for w in ws] if ws is not None else []))


def parsed_texts(docs: DataFrame, clubs: list[str] | None = None, text: str = "html", key: str = "page_id", fields: Iterable[str] | None = None) -> DataFrame:
    """key, classes of documents of any shape, read by agreement; clubs is a dictionary of bounded size.

    A null document has no classes; repeated keys repeat. Given fields, key and these of every row,
    as `flattened` has them.
    """

    names = tuple(clubs or ())

    def reader() -> Callable[[pa.Array], list[list[dict]]]:
        known = shared(names) if names else None
        return lambda values: [dispatched(t or "", known) for t in values.to_pylist()]

    return read_documents(docs, key, text, reader, fields)


REPAIRS: dict[str, Callable[[dict], dict]] = {}


def repaired(row: dict) -> dict:
    """A row after every registered repair, in the order they were registered."""
    for fix in REPAIRS.values():
        row = fix(row)
    return row


def repair(name: str) -> Callable:
    """Register a repair of a row, to be applied by name."""

    def add(f: Callable[[dict], dict]) -> Callable[[dict], dict]:
        REPAIRS[name] = f
        return f

    return add


@repair("shifted")
def unshifted(row: dict) -> dict:
    """A club cell that is a time and an empty time cell have changed places."""
    if not row["time_text"] and re.fullmatch(r"\d{1,3}:\d{2}(?::\d{2})?", row["club"] or ""):
        return {**row, "time_text": row["club"], "club": ""}
    return row


@repair("overflow")
def unoverflowed(row: dict) -> dict:
    """A status at the end of the club cell belongs into the empty result cell."""
    if row["time_text"]:
        return row
    m = re.match(r"(?i)^(.*?)\s+(aufg\.?|disq?\.?|fehlst\.?|n\.?\s*ang\.?|dnf|dns|mp)$", row["club"] or "")
    return {**row, "club": m[1], "time_text": m[2]} if m else row


@repair("interleaved")
def untangled(row: dict) -> dict:
    """A time whose figures stand between the letters of the club (`Beweg2u:0n4g:58`) is drawn out of it."""
    club = row["club"] or ""
    if row["time_text"] or not re.search(r"[^\W\d_]\d[^\W\d_]|[^\W\d_][\d:]+[^\W\d_]+[\d:]", club):
        return row
    at = re.search(r"\S*[^\W\d_][\d:]\S*$", club)
    value = re.sub(r"[^\d:]", "", at[0]) if at else ""
    if not re.fullmatch(r"\d{1,3}:\d{2}(?::\d{2})?", value):
        return row
    return {**row, "club": (club[: at.start()] + re.sub(r"[\d:]", "", at[0])).strip(), "time_text": value}
