"""Teams and their members: relay tables, relay text, and club tables with counted classes.

Each reader turns its document into calls of `Teams`, which keeps one open team at a time and
writes its rows when the next one begins.
"""

from __future__ import annotations

import re
from functools import lru_cache

from ..functions import fixed as X
from .html import header, tables

TIME = re.compile(r"\d{1,3}:\d{2}(?::\d{2})?")
#: What a result cell may say in place of a time: the status phrases, longest first.
STATUS = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(k) + r"\.?" for k in sorted(X.STATUS_PHRASES, key=len, reverse=True)) + r")(?!\w)\.?", re.I)
VALUE_AT_END = re.compile(rf"^(?P<body>.*?\S)\s+(?P<value>\(?{TIME.pattern}\)?|{STATUS.pattern})(?:\s+\+?{TIME.pattern})?$", re.I)
COUNTS = re.compile(r"^\((\d+)\s*/\s*(\d+)\)$")
NAMED_COUNTS = re.compile(r"^(?P<name>.+?)\s+\((?P<finished>\d+)\s*/\s*(?P<entered>\d+)\)$")
HEAD_LINES = re.compile(X.RELAY_HEAD_LINES, re.I)


_VALUE = re.compile(rf"(\(?{TIME.pattern}\)?|{STATUS.pattern})(?:\s+\+?{TIME.pattern})?", re.I)
_BLANKS = re.compile(r"\s+")
#: The words that a value may have, with the time behind it.
_VALUE_WORDS = max(len(k.split()) for k in X.STATUS_PHRASES) + 1
_LEAD = re.compile(r"^(?:(?P<ooc>AK|--|—)\s+)?(?P<numbers>(?:\d+\.?\s+){0,2})(?P<name>\D.*)$", re.I)
_NUMBER_BEHIND = re.compile(r"\s+\d{1,4}$")
_RANK = re.compile(r"^(\d+)\.?$")
_LETTER = re.compile(r"[^\W\d_]")
_NEGATIVE = re.compile(r"\s*-")
#: Texts that are kept with what was found for them, at most.
KEPT = 1 << 15


@lru_cache(maxsize=KEPT)
def _value(text: str) -> str | None:
    m = _VALUE.fullmatch(text)
    return m[1] if m else None


def value_at_end(line: str) -> tuple[str, str] | None:
    """Body and value of a stripped line, as `VALUE_AT_END` has them; only as many words from the end are looked at as a value can have."""
    for blanks in list(_BLANKS.finditer(line))[-_VALUE_WORDS:]:
        value = _value(line[blanks.end() :])
        if value is not None:
            return line[: blanks.start()], value
    return None


@lru_cache(maxsize=KEPT)
def seconds(value: str) -> int | None:
    m = TIME.search(value or "")
    if not m or _NEGATIVE.match(value):
        return None
    parts = list(map(int, m[0].split(":")))
    return parts[0] * 3600 + parts[1] * 60 + parts[2] if len(parts) == 3 else parts[0] * 60 + parts[1]


@lru_cache(maxsize=KEPT)
def says_result(value: str) -> bool:
    return seconds(value) is not None or bool(STATUS.fullmatch((value or "").strip()))


def clock(s: int) -> str:
    return f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60}:{s % 60:02d}"


def row(name: str, club: str = "", time_text: str = "", rank: int | None = None, **more) -> dict:
    return {"rank": rank, "name": name, "club": club, "time_text": time_text, "rank_text": "" if rank is None else str(rank), "bib": "", "born": None, "kind": "individual", "team": None, "leg": None, **more}


class Teams:
    """Classes of teams. A team that is named again within the document gets a number behind its name."""

    def __init__(self, kind: str = "relay"):
        self.kind, self.classes, self.open, self.members, self.seen = kind, [], None, [], {}

    def category(self, name: str, declared: int | None) -> None:
        self.close()
        if not (self.classes and self.classes[-1]["name"] == name):  # a class goes on behind a page break
            self.classes.append({"name": name, "declared": declared, "results": []})

    def team(self, name: str, value: str, rank: int | None = None, number: str = "", ooc: bool = False) -> None:
        self.close()
        again = self.seen[name] = self.seen.get(name, 0) + 1
        label = name if again == 1 else f"{name} {again}"
        # what all rows of the team say
        self.open = row("", name, "", None if ooc else rank, bib=number, kind=self.kind, team=label, team_time=value.strip("() "), out_of_competition=ooc, legs=None)
        self.members = []

    def member(self, name: str, value: str) -> None:
        self.members.append((name, value.strip("() ")))

    def close(self) -> None:
        t, self.open = self.open, None
        if not t or not self.classes:
            return
        if not self.members:
            self.classes[-1]["results"].append({**t, "time_text": t["team_time"]})
            return
        legs = [seconds(v) for _, v in self.members]
        printed = seconds(t["team_time"])
        # a time field of minutes and seconds wraps at the hour; the legs give back what it lost
        if printed is not None and None not in legs and (whole := sum(legs)) >= 3600 > printed == whole % 3600:
            t["team_time"] = clock(whole)
        t["legs"] = len(legs)
        relay = self.kind == "relay"
        self.classes[-1]["results"] += [{**t, "name": n, "time_text": v, "leg": i if relay else None} for i, (n, v) in enumerate(self.members, 1)]

    def done(self) -> list[dict]:
        self.close()
        return [c for c in self.classes if c["results"]]


def parse_relay_text(text: str, kind: str = "relay") -> list[dict]:
    """Lines of a class `name (n)`, of teams that begin with rank and number, and of their members below.

    One leading number is a rank where the team has a time, else its start number. A team without
    members stays as one row without a name.
    """
    out = Teams(kind)
    for line in (text or "").splitlines():
        what, said = _relay_line(line)
        if what == "class":
            out.category(*said)
        elif what == "team" and out.classes:
            out.team(*said)
        elif what == "member" and out.open:
            out.member(*said)
    return out.done()


@lru_cache(maxsize=KEPT)
def _relay_line(line: str) -> tuple[str, tuple]:
    """Whether a line is a class, a team, a member or nothing, and what `Teams` is told of it; lines recur, so the last ones are kept."""
    line = line.strip()
    head = header(line)
    if not line or HEAD_LINES.match(line):
        return "", ()
    if head and not TIME.search(line):
        return "class", (head["name"].strip(), int(head["n"]))
    m = value_at_end(line)
    lead = _LEAD.match(m[0] if m else line)
    numbers = [n.rstrip(".") for n in lead["numbers"].split()] if lead else []
    if m and lead and (numbers or lead["ooc"]):
        timed = seconds(m[1]) is not None
        rank = int(numbers[0]) if numbers and (len(numbers) == 2 or timed) and not lead["ooc"] else None
        number = numbers[-1] if len(numbers) == 2 or numbers and rank is None else ""
        return "team", (lead["name"].strip(), m[1], rank, number, bool(lead["ooc"]) or m[1].startswith("("))
    return "member", (_NUMBER_BEHIND.sub("", (m[0] if m else line).strip()), m[1] if m else "")


def parse_numbered_relay(html: str) -> list[dict]:
    """One table of classes `name (n / m)`, team rows `rank name time [behind]` and member rows that count the legs."""
    found = tables(html)
    if len(found) != 1:
        return []
    out = Teams()
    for cells in found[0]:
        if not any(cells):  # cells of tables are stripped
            continue
        if len(cells) > 2 and cells[2][:1] == "(" and (counts := COUNTS.match(cells[2])):
            out.category(cells[1], int(counts[1]))
            continue
        if not out.classes:
            continue
        place = cells[1].rstrip(".") if len(cells) > 1 else ""
        if out.open and place.isdigit() and (len(cells) >= 6 or len(cells) == 5 and not cells[4].startswith("+")):
            if cells[2]:
                out.member(cells[2], cells[3])
        elif len(cells) >= 4 and place.isdigit() and says_result(cells[3].strip("()")):
            out.team(cells[2], cells[3], int(place), ooc=cells[3].startswith("("))
        elif len(cells) == 3 and cells[1] and says_result(cells[2].strip("()")):
            out.team(cells[1], cells[2], ooc=cells[2].startswith("("))
    return out.done()


def parse_club_table(html: str) -> list[dict]:
    """Tables whose classes stand in a row of their own: `name (n / m)` alone, beside a count, or before the label of the times.

    Rows begin with a rank, nothing or AK. Behind the first shape cells have fixed places; in the
    others the result is the first time to the right of the name, else the last status, and what
    stands between is the club.
    """
    classes: list[dict] = []
    fixed_places = False
    for cells in (r for t in tables(html) for r in t):
        cells = [c.strip() for c in cells]
        if not any(cells):
            continue
        if m := cells[0][-1:] == ")" and NAMED_COUNTS.match(cells[0]):
            classes.append({"name": m["name"].strip(), "declared": int(m["entered"]), "results": []})
            fixed_places = True
            continue
        if len(cells) >= 3 and cells[2] == "Zeit" and cells[0].lower() not in ("", "pl", "platz"):
            counted = COUNTS.match(cells[1])
            classes.append({"name": cells[0], "declared": int(counted[2]) if counted else None, "results": []})
            fixed_places = False
            continue
        rank = _RANK.match(cells[0])
        if not classes or len(cells) < (6 if fixed_places else 3) or not (rank or cells[0] == "" or cells[0].lower() == "ak"):
            continue
        if fixed_places:
            name, club, value = cells[2], cells[4], cells[5]
        else:
            at = next((i for i in range(2, len(cells)) if seconds(cells[i]) is not None), None)
            if at is None:
                at = max((i for i in range(2, len(cells)) if STATUS.search(cells[i])), default=None)
            if at is None:
                continue
            name, club, value = cells[1], " ".join(c for c in cells[2:at] if c), cells[at]
        if _LETTER.search(name):
            classes[-1]["results"].append(row(name, club, value, int(rank[1]) if rank else None, rank_text=cells[0], out_of_competition=cells[0].lower() == "ak"))
    for c in classes:
        c["declared"] = len(c["results"]) if c["declared"] is None else c["declared"]
    return [c for c in classes if c["results"]]
