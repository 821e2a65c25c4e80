"""Pages without tables: elements placed by left and top, read by the columns that their places form.

Lefts are clustered into columns over the whole document, and a cell keeps its column, so an empty
cell stays empty. A row of labels names the columns. Without one the columns are told apart by what
they hold: numbers in front are places, times and statuses are results, words are names; two columns
of words that meet in a row are name and club, two that never do are teams and their members.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from html.parser import HTMLParser
from operator import itemgetter
from typing import NamedTuple

from .html import LABELS, RANK, header, parse_rows
from .relays import COUNTS, Teams, row, says_result

#: Lefts nearer than this are one column; tops nearer than this are one row.
COLUMN_ROOM = 12.0
ROW_ROOM = 3.0
#: The share of a column's cells that must be of a kind.
MOSTLY = 0.75
_AWAY = re.compile(r"(?i)^a\.?\s*k\.?$")
_WORDS = re.compile(r"[^\W\d_]{2}")
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr"}


class Cell(NamedTuple):
    top: float
    left: float
    text: str


class Elements(HTMLParser):
    """Texts of the elements whose style gives left and top; one that is still open ends where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[Cell] = []
        self.place: tuple[float, float] | None = None
        self.text: list[str] = []
        self.inside: list[str] = []

    def finish(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if self.place and text:
            self.cells.append(Cell(*self.place, text))
        self.place, self.text, self.inside = None, [], []

    def handle_starttag(self, tag, attrs):
        at = place_of(dict(attrs).get("style") or "")
        if at:
            self.finish()
            self.place = at
        if self.place:
            if tag in _VOID:
                self.text.append(" ")
            else:
                self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass
            if not self.inside:
                self.finish()

    def handle_data(self, data):
        if self.place:
            self.text.append(data)


_SIDES = [re.compile(rf"(?i)(?:^|[;\s]){side}\s*:\s*(-?[\d.]+)") for side in ("top", "left")]


@lru_cache(maxsize=1 << 15)
def place_of(style: str) -> tuple[float, float] | None:
    """Top and left of a style that gives both."""
    at = [side.search(style) for side in _SIDES]
    return (float(at[0][1]), float(at[1][1])) if all(at) else None


#: An element that holds nothing but text.
_FLAT = re.compile(r"""<(div|span|p)\s+style="([^"<>&]*)"\s*>([^<>&]*)</\1>""")


@lru_cache(maxsize=1 << 15)
def _element(style: str, text: str) -> Cell | None:
    """The placed text of an element; None where it has no place or no text. Places, results and members recur, so the last ones are kept."""
    place, text = place_of(style), " ".join(text.split())
    return Cell(*place, text) if place and text else None


def cells_of(html: str) -> list[Cell]:
    """The placed texts; elements that hold nothing but text are read at once, any other document by the tolerant parser."""
    flat = _FLAT.findall(html or "")
    if (html or "").count("<") == 2 * len(flat):
        return [c for _, style, text in flat if (c := _element(style, text))]
    found = Elements()
    found.feed(html or "")
    found.close()
    found.finish()
    return found.cells


_LEFT = itemgetter(1)


def rows_of(cells: list[Cell], room: float = ROW_ROOM) -> list[list[Cell]]:
    """Cells by rows: those whose tops lie within room of the row's first one, from left to right."""
    rows: list[list[Cell]] = []
    first, own = 0.0, None
    for c in sorted(cells):
        if own is not None and c[0] - first <= room:
            own.append(c)
        else:
            first, own = c[0], [c]
            rows.append(own)
    # cells of one top are in order already
    return [r if r[0][0] == r[-1][0] else sorted(r, key=_LEFT) for r in rows]


def clustered(lefts: list[float], room: float = COLUMN_ROOM) -> dict[float, int]:
    """The column of every left: a new one begins behind a gap of more than room."""
    return dict(_clustered(tuple(sorted(set(lefts))), room))


@lru_cache(maxsize=1 << 12)
def _clustered(lefts: tuple[float, ...], room: float) -> dict[float, int]:
    """The columns of lefts in order; documents of one origin have the same ones, so the last ones are kept (and not to be changed)."""
    out: dict[float, int] = {}
    column, last = -1, None
    for x in lefts:
        if last is None or x - last > room:
            column += 1
        out[x], last = column, x
    return out


@lru_cache(maxsize=1 << 15)
def _told(texts: tuple[str, ...]) -> tuple[tuple[str | None, ...] | None, tuple[str, int] | None]:
    """What a row's labels stand for, and the class it names; None for what it is not."""
    return _label_kinds(texts), class_of(texts)


def class_of(texts: tuple[str, ...]) -> tuple[str, int] | None:
    """Name and count of a class's row: `name (n / m)` in one cell or in two, before nothing that is a result."""
    if any(map(says_result, texts)):
        return None
    for i, t in enumerate(texts):
        if i and t[:1] == "(" and (m := COUNTS.match(t)):
            return " ".join(texts[:i]).strip(), int(m[1])
    m = header(texts[0]) if texts else None
    return (m["name"].strip(), int(m["n"])) if m and len(texts) <= 3 else None


def _label_kinds(texts: tuple[str, ...]) -> tuple[str | None, ...] | None:
    """What the cells of a row of labels stand for; None for any other row."""
    kinds = tuple(LABELS.get(t.lower()) for t in texts)
    return kinds if len(kinds) - kinds.count(None) >= 2 and ("name" in kinds or "team" in kinds) else None


def _texts(rows: list[list[Cell]]) -> list[tuple[str, ...]]:
    return [tuple([text for _, _, text in r]) for r in rows]


def by_labels(rows: list[list[Cell]], every: list[tuple[str, ...]] | None = None) -> list[dict] | None:
    """Classes where a row of labels names the columns; None without one.

    A cell belongs to the last label that begins at or before it. A result that begins before its
    label (it is set to the right) goes to that label if its cell is still free.
    """
    heads: list[Cell] = []
    out: list[list[str]] = []
    every = _texts(rows) if every is None else every
    told = list(map(_told, every))
    if not any([kinds for kinds, _ in told]):
        return None
    for r, texts, (kinds, found) in zip(rows, every, told, strict=True):
        if kinds:
            heads, lefts, timed = r, [c.left for c in r], [k == "time" for k in kinds]
            out.append(list(texts))
        elif found:
            out.append([f"{found[0]} ({found[1]})"])
        elif heads:
            filled = [""] * len(heads)
            for c in r:
                i = max(bisect_right(lefts, c.left + COLUMN_ROOM) - 1, 0)
                if not timed[i] and True in timed[i + 1 :]:
                    later = timed.index(True, i + 1)
                    if not filled[later] and says_result(c.text):
                        i = later
                filled[i] = f"{filled[i]} {c.text}".strip()
            out.append(filled)
    return parse_rows(out)


class Roles(NamedTuple):
    rank: int | None
    words: tuple[int, ...]
    values: tuple[int, ...]
    teams: bool


#: Each of the four kinds is counted in so many bits of one number, behind the number of cells.
_KIND_BITS = 40


@lru_cache(maxsize=1 << 15)
def _counted_kinds(text: str) -> int:
    """A cell, to be summed with others: one, and one for each kind it is of, each in bits of its own."""
    return 1 + sum(1 << _KIND_BITS * i for i, kind in enumerate(kinds_of(text), 1) if kind)


@lru_cache(maxsize=1 << 15)
def kinds_of(text: str) -> tuple[bool, bool, bool, bool]:
    """Whether a cell is a result, a distance behind, words, a place."""
    value = says_result(text.strip("()+")) or text in ("-", "–")
    place = bool(RANK.match(text) or _AWAY.match(text))
    return value, text.startswith("+"), bool(_WORDS.search(text)) and not value and not place, place


def roles(rows: list[dict[int, str]]) -> Roles:
    """What the columns hold, by the share of their cells that are places, results or words."""
    held: dict[int, int] = {}
    for r in rows:
        for c, t in r.items():
            held[c] = held.get(c, 0) + _counted_kinds(t)
    of, each = (1 << _KIND_BITS) - 1, range(_KIND_BITS, 5 * _KIND_BITS, _KIND_BITS)
    shares = {c: [(own >> bits & of) / (own & of) for bits in each] for c, own in sorted(held.items())}
    values = [c for c, (value, plus, _, _) in shares.items() if value >= MOSTLY and plus < 0.5]
    words = [c for c, (_, _, word, _) in shares.items() if word >= MOSTLY and c not in values]
    ranks = [c for c, (_, _, _, place) in shares.items() if place >= MOSTLY and c not in values and (not words or c < words[0])]
    teams = len(words) >= 2 and not any(words[0] in r and words[1] in r for r in rows)
    return Roles(ranks[0] if ranks else None, tuple(words), tuple(values), teams)


@lru_cache(maxsize=1 << 12)
def _place(text: str) -> tuple[int | None, bool]:
    """The place that a cell says, and whether it says that there is none."""
    rank = RANK.match(text)
    return int(rank[1]) if rank else None, bool(_AWAY.match(text))


def by_content(rows: list[list[Cell]], room: float = COLUMN_ROOM, every: list[tuple[str, ...]] | None = None) -> list[dict]:
    """Classes of rows without labels."""
    at = _clustered(tuple(sorted({left for r in rows for _, left, _ in r})), room)
    lines: list[tuple[str, int] | dict[int, str]] = []
    for r, texts in zip(rows, _texts(rows) if every is None else every, strict=True):
        _, found = _told(texts)
        if found:
            lines.append(found)
        elif lines:  # what stands before the first class is no result
            line: dict[int, str] = {}
            for _, left, text in r:
                column = at[left]
                line[column] = f"{line[column]} {text}" if column in line else text
            lines.append(line)
    body = [x for x in lines if isinstance(x, dict)]
    own = roles(body)
    if not own.words:
        return []
    first, second = own.words[0], own.words[1] if len(own.words) > 1 else None
    out: list[dict] = []
    relay = Teams()
    for line in lines:
        if isinstance(line, tuple):
            relay.category(*line)
            if not (out and out[-1]["name"] == line[0]):
                out.append({"name": line[0], "declared": line[1], "results": []})
            continue
        name, value = line.get(first, ""), ""
        for c in own.values:
            if c in line:
                value = line[c]
                break
        if name and value:
            place = line.get(own.rank, "")
            rank, away = _place(place) if place else (None, False)
            away = away or value[0] == "("
            if own.teams:
                relay.team(name, value, rank, ooc=away)
            else:
                out[-1]["results"].append(row(name, line.get(second, ""), value.strip("()"), None if away else rank, rank_text=place, out_of_competition=away))
        elif own.teams and second in line and relay.open:
            relay.member(line[second], value)
    return relay.done() if own.teams else [c for c in out if c["results"]]


def parse_positioned(html: str) -> list[dict]:
    """Classes of a page of placed elements, by its labels or by what its columns hold."""
    rows = rows_of(cells_of(html))
    every = _texts(rows)
    found = by_labels(rows, every)
    return found if found is not None else by_content(rows, every=every)
