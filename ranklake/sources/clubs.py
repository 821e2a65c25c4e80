"""Where a name ends and a club begins: a dictionary of clubs as evidence for rows whose columns are lost.

The dictionary is a trie of its clubs' tokens from the last to the first, so the longest known club
that ends a run of words is found in one walk. It answers three questions: which words of a flowing
row are the club, which cut of shifted cells is proven, and which letters of a result cell belong
to a club that its column cut off. `flow_rows` asks the first one of whole tables, as a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X

#: A club of the dictionary has this many words at most.
MOST_WORDS = 8
#: Clubs that are broadcast to the rows, at most (some 100 bytes each); more are joined by a shuffle.
BROADCAST_CLUBS = 50_000

# --- fixed values: what stands for a result, and the small words within names ---
CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?"
NAME_WORDS = {"von", "van", "der", "den", "de", "di", "da", "del", "la", "le", "zu", "zum", "ten", "vom"}
# --- end of fixed values ---

_PHRASES = sorted(X.STATUS_PHRASES, key=len, reverse=True)
_STATUS = r"(?:" + "|".join(re.escape(p).replace(r"\ ", r"\s+") + r"\.?" for p in _PHRASES) + ")"
RESULT_END = re.compile(rf"(?i)^(?P<body>.*?\S)\s+(?P<value>\(?{CLOCK}\)?|{_STATUS})(?:\s+\+?{CLOCK})?$")
RESULT = re.compile(rf"(?i)^(?:\(?{CLOCK}\)?|{_STATUS})$")
_TAIL = re.compile(rf"(?i)(\(?{CLOCK}\)?|{_STATUS})(?:\s+\+?{CLOCK})?")
#: The words that a result may have, with the time behind it.
_TAIL_WORDS = max(len(p.split()) for p in _PHRASES) + 1
_INNER_CAPITAL = re.compile(r"[a-zäöüß][A-ZÄÖÜ]")
_PREFIXED = re.compile(r"^(?:Mc|Mac|O')")
_LEAD = re.compile(r"(?i)^(?:(?P<rank>\d{1,4})\.?\s+|(?P<ooc>AK)\s+)?(?P<words>\D.*)$")
_SHORT = re.compile(r"[A-ZÄÖÜ]{2,6}")
#: Texts of one kind that are kept with what was found for them, at most.
KEPT = 1 << 15
#: Lines and rows of three cells that are kept with how they were read or put right, at most (some 600 bytes each).
KEPT_ROWS = 1 << 17
_NAME_WORD = re.compile(r"^(?:[^\W\d_][^\W\d_]*['’.-]?)+$")


@lru_cache(maxsize=KEPT)
def is_result(text: str) -> bool:
    return bool(RESULT.match((text or "").strip()))


@lru_cache(maxsize=KEPT)
def _tail(text: str) -> str | None:
    m = _TAIL.fullmatch(text)
    return m[1] if m else None


def result_end(line: str) -> tuple[str, str] | None:
    """Body and value of a line whose words are parted by single blanks, as `RESULT_END` has them: the longest value counts.

    Only as many words from the end are looked at as a result can have.
    """
    words = line.split(" ")
    for i in range(max(1, len(words) - _TAIL_WORDS), len(words)):
        value = _tail(" ".join(words[i:]))
        if value is not None:
            return " ".join(words[:i]), value
    return None


def looks_named(words: list[str]) -> bool:
    """One to four words that can be a person: letters that begin in capitals, no capital within small letters, small words in between."""
    if not 1 <= len(words) <= 4:
        return False
    return all(_named_word(w) and (w[0].isupper() or 0 < i < len(words) - 1 and w in NAME_WORDS) for i, w in enumerate(words))


@lru_cache(maxsize=KEPT)
def _named_word(w: str) -> bool:
    return bool(_NAME_WORD.match(w)) and not _INNER_CAPITAL.search(_PREFIXED.sub("", w))


class Clubs:
    """Known clubs, as a trie of their casefolded words from the last to the first."""

    def __init__(self, names: Iterable[str]):
        self.root: dict = {}
        self.by_start: dict[str, list[str]] = {}
        self.holds = lru_cache(maxsize=KEPT)(self._holds)
        self.drawn = lru_cache(maxsize=KEPT)(lambda club, value: _disentangled(club, value, self))
        self.flowing = lru_cache(maxsize=KEPT_ROWS)(lambda text: flow_row(text, self))
        self.put_right = lru_cache(maxsize=KEPT_ROWS)(lambda name, club, value: _put_right(name, club, value, self))
        for name in dict.fromkeys(" ".join(n.split()) for n in names if n and n.strip()):
            at = self.root
            for w in reversed(name.casefold().split()):
                at = at.setdefault(w, {})
            at.setdefault(None, name)
            self.by_start.setdefault(_letters(name)[:3], []).append(name)

    def trailing(self, words: list[str], leave: int = 1) -> tuple[int, str] | None:
        """How many words at the end are the longest known club, and the club; `leave` words stay in front."""
        at, found = self.root, None
        for n, w in enumerate(reversed(words[leave:]), 1):
            at = at.get(w.casefold())
            if at is None:
                break
            if None in at:
                found = (n, at[None])
        return found

    def __contains__(self, name: str) -> bool:
        return self.holds(name)

    def _holds(self, name: str) -> bool:
        words = (name or "").split()
        found = self.trailing(words, 0)
        return bool(found) and found[0] == len(words)


@lru_cache(maxsize=2)
def shared(names: tuple[str, ...]) -> Clubs:
    """The clubs of a dictionary that was asked for lately: tasks of one worker share it, with what it keeps."""
    return Clubs(names)


def flow_row(text: str, clubs: Clubs) -> dict | None:
    """A result in one run of words: rank or nothing, name, a club of the dictionary or nothing, time or status.

    Without a known club the words are a name only if they look like one; the first word in
    capitals alone (two to six letters) else begins the club. What proves no border is no row.
    """
    end = result_end(" ".join((text or "").split()))
    if not end:
        return None
    body, value = end
    lead = _LEAD.match(body)
    if not lead:
        return None
    words = lead["words"].split()
    found = clubs.trailing(words)
    if found:
        name, club = words[: -found[0]], " ".join(words[-found[0] :])
    else:
        at = next((i for i, w in enumerate(words) if i and _SHORT.fullmatch(w) and not words[i - 1].isupper()), None)
        if at is not None:
            name, club = words[:at], " ".join(words[at:])
        elif looks_named(words):
            name, club = words, ""
        else:
            return None
    return {"rank": int(lead["rank"]) if lead["rank"] else None, "ooc": bool(lead["ooc"]) or value.startswith("("), "name": " ".join(name), "club": club, "time_text": value.strip("()")}


# cells -------------------------------------------------------------------------------------------


def resegmented(cells: tuple[str, str, str], clubs: Clubs) -> tuple[str, str, str] | None:
    """Name, club and result of three cells whose borders are wrong, if just one cut of their text is proven.

    The cells are run together with or without a blank at each border; a cut counts if its end is a
    result, the words before that end with a known club, and the rest looks like a name. Cells that
    are right already, and cuts that contradict each other, give None. A name without a club's cell
    gives words to a club only if two stay.
    """
    name, club, value = (" ".join((c or "").split()) for c in cells)
    inside = None if club else clubs.trailing(name.split(), 2)
    if is_result(value) and looks_named(name.split()) and (club in clubs if club else not inside):
        return None
    found: dict[tuple[str, str, str], int] = {}
    # with an empty cell several ways give one line
    for line in {" ".join(f"{name}{first}{club}{second}{value}".split()) for first, second in product((" ", ""), repeat=2)}:
        end = result_end(line)
        if not end:
            continue
        words = end[0].split()
        hit = clubs.trailing(words)
        if hit and looks_named(words[: -hit[0]]):
            found[" ".join(words[: -hit[0]]), hit[1], end[1]] = hit[0]
    best = [k for k, n in found.items() if n == max(found.values())]
    return best[0] if len(best) == 1 else None


def _letters(text: str) -> str:
    return "".join(text.casefold().split())


@lru_cache(maxsize=1)
def _openings() -> frozenset[str]:
    """Every beginning of a status phrase, without blanks."""
    return frozenset(p[:i] for phrase in _PHRASES for p in (_letters(phrase) + ".",) for i in range(len(p) + 1))


@lru_cache(maxsize=KEPT)
def _may_become_result(text: str) -> bool:
    return bool(re.fullmatch(r"\d{0,3}|\d{1,3}:\d{0,2}|\d{1,3}:\d{2}:?\d{0,2}|\d{1,3}:\d{2}(?::\d{2})?,?\d{0,4}", text)) or text.casefold() in _openings()


def _left_over(text: str, club: str) -> tuple[int, int, list[str]]:
    """The most letters of club that can be drawn out of text in order, the fewest others to drop, and what is left of text then.

    Letters are walked one by one; a state is the number of letters drawn, of letters dropped, and
    what was left so far. Only beginnings of a time or a status stay; a letter is dropped only
    behind the whole club (a longer name than the dictionary's, cut off anywhere).
    """
    states = {(0, 0, "")}
    for c in text:
        after = set()
        for drawn, dropped, left in states:
            if drawn < len(club) and club[drawn] == c.casefold():
                after.add((drawn + 1, dropped, left))
            if len(left) < 16 and _may_become_result(left + c):
                after.add((drawn, dropped, left + c))
            if drawn == len(club) and dropped < 8 and not c.isdigit() and c != ":":
                after.add((drawn, dropped + 1, left))
        states = after
    ends = [(d, -n, left) for d, n, left in states if re.fullmatch(rf"{CLOCK}(?:,?\d{{2,4}})?", left) or left.casefold().rstrip(".") in _whole()]
    most, fewest = max(((d, n) for d, n, _ in ends), default=(0, 0))
    same: dict[str, str] = {}
    for _, _, left in sorted(e for e in ends if e[:2] == (most, fewest)):
        # of writings in other cases the one that looks like a word: capitals in front alone
        capitals = lambda x: sum(ch.isupper() for ch in x[1:])
        if capitals(left) < capitals(same.setdefault(left.casefold(), left)):
            same[left.casefold()] = left
    return most, -fewest, list(same.values())


@lru_cache(maxsize=1)
def _whole() -> frozenset[str]:
    return frozenset(_letters(p).rstrip(".") for p in _PHRASES)


def disentangled(club: str, value: str, clubs: Clubs) -> tuple[str, str] | None:
    """The known club that both cells spell letter by letter, and the result that stands between its letters.

    The club's cell holds its beginning; its other letters are drawn out of the cells, in order, and
    what is left must be a time (a year or number may follow) or a status. All letters of the club,
    or its longest beginning, count; two clubs or two results that do equally well give None.
    """
    return clubs.drawn(club or "", value or "")


def _disentangled(club: str, value: str, clubs: Clubs) -> tuple[str, str] | None:
    club, value = " ".join((club or "").split()), " ".join((value or "").split())
    text = "".join(f"{club}{value}".split())
    if len(_letters(club)) < 3 or club in clubs and is_result(value):
        return None
    found = []
    for known in clubs.by_start.get(_letters(club)[:3], []):
        letters = _letters(known)
        drawn, dropped, left = _left_over(text, letters)
        # the cell's own letters are all the club's, and the result's cell gives letters too
        own = sum(not c.isdigit() and c != ":" for c in _letters(club))
        if left and (drawn == len(letters) or drawn > own):
            clean = [m[0] for x in left if (m := re.match(CLOCK, x))] or left
            found += [((drawn == len(letters), -dropped, drawn), known, v) for v in dict.fromkeys(clean)]
    best = {(k, v) for score, k, v in found if score == max(s for s, _, _ in found)}
    return best.pop() if len(best) == 1 else None


def proven(row: dict, clubs: Clubs) -> dict:
    """A row whose cells the dictionary puts right, or as it is."""
    right = clubs.put_right(row["name"], row["club"], row["time_text"])
    return {**row, "name": right[0], "club": right[1], "time_text": right[2]} if right else row


def _put_right(name: str | None, club: str | None, value: str | None, clubs: Clubs) -> tuple[str | None, str, str] | None:
    """Name, club and result as the dictionary proves them, None where it proves nothing; `Clubs` keeps them, as rows recur."""
    cut = resegmented((name, club, value), clubs)
    if cut:
        return cut
    drawn = disentangled(club, value, clubs)
    return (name, *drawn) if drawn else None


# whole tables ------------------------------------------------------------------------------------


def dictionary(clubs: DataFrame, club: str = "club", most: int = BROADCAST_CLUBS) -> list[str]:
    """The distinct clubs, for parsers that carry them to their workers; more than `most` are refused.

    `flow_rows` joins a larger dictionary. Nulls and blanks are no clubs.
    """
    found = clubs.select(F.trim(club).alias("club")).filter("club <> ''").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} clubs: join them with flow_rows")
    return sorted(r["club"] for r in found)


def proven_rows(rows: DataFrame, clubs: list[str], name: str = "name", club: str = "club", value: str = "time_text") -> DataFrame:
    """rows whose name, club and result cells the dictionary puts right where it proves how; all other columns stay.

    Null cells count as empty ones; a row that nothing proves stays as it is.
    """

    three, names = (name, club, value), tuple(clubs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared(names)
        for b in batches:
            cells = list(zip(*[b.column(c).fill_null("").to_pylist() for c in three], strict=True))
            right = zip(*[known.put_right(*c) or c for c in cells], strict=True) if cells else ((), (), ())
            new = {c: pa.array(v, b.schema.field(c).type) for c, v in zip(three, right, strict=True)}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else b.column(i) for i, f in enumerate(b.schema)], schema=b.schema)

    return rows.mapInArrow(run, rows.schema)


def _key(words: Column) -> Column:
    return F.lower(F.array_join(words, " "))


def flow_rows(lines: DataFrame, clubs: DataFrame, key: list[str], text: str = "text", club: str = "club") -> DataFrame:
    """key, rank, name, club, time_text of every line that is a result in one run of words.

    The last one to eight words before the result are joined to the dictionary, and the longest that
    it knows is the club; a line without one is all name. Lines that end in no result are left out.
    The dictionary is broadcast only if it is counted to be small. Null lines give no rows; repeated
    clubs count once; lines are told by key.
    """
    # matched once: a plain line has no line feed, so one parts what its groups hold; a last terminator is none of them
    pattern = rf"(?i)^(?:(\d{{1,4}})\.?\s+)?(\D.*?)\s+(\(?{CLOCK}\)?|{_STATUS})(?:\s+\+?{CLOCK})?[\u0085\u2028\u2029]?$"
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    rows = lines.select(*key, F.split(F.regexp_replace(plain, pattern, "$1\n$2\n$3"), "\n").alias("_parts")).filter(F.size("_parts") == 3)
    part = lambda i: F.col("_parts")[i - 1]
    rows = rows.select(*key, F.when(part(1) != "", part(1)).cast("int").alias("rank"), F.split(part(2), " ").alias("_words"), part(3).alias("time_text"))
    known = clubs.filter(F.col(club).isNotNull()).select(F.lower(F.trim(F.regexp_replace(club, r"\s+", " "))).alias("_known")).filter("_known <> ''").distinct()
    if known.limit(BROADCAST_CLUBS + 1).count() <= BROADCAST_CLUBS:
        # a lookup a length, as no row has to be moved for it
        found = rows
        for n in range(1, MOST_WORDS + 1):
            own = F.when(F.size("_words") > n, _key(F.slice(F.col("_words"), -n, n)))
            found = found.join(F.broadcast(known.withColumnRenamed("_known", f"_known{n}")), own == F.col(f"_known{n}"), "left")
        hit = F.coalesce(*[F.when(F.col(f"_known{n}").isNotNull(), n) for n in range(MOST_WORDS, 0, -1)], F.lit(0))
        return _flowed(found.withColumn("_n", hit), key)
    longest = F.least(F.lit(MOST_WORDS), F.size("_words") - 1)
    tails = F.when(longest > 0, F.transform(F.sequence(F.lit(1), longest), lambda n: F.struct(n.alias("n"), _key(F.slice(F.col("_words"), -n, n)).alias("k"))))
    hits = rows.select(*key, F.explode(tails).alias("_t")).join(known, F.col("_t.k") == F.col("_known"))
    hits = hits.groupBy(*key).agg(F.max("_t.n").alias("_n"))
    return _flowed(rows.join(hits, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0))), key)


def _flowed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Name and club of rows whose last _n words are the club."""
    words = F.col("_words")
    return rows.select(
        *key,
        "rank",
        F.array_join(F.slice(words, F.lit(1), F.size(words) - F.col("_n")), " ").alias("name"),
        F.when(F.col("_n") > 0, F.array_join(F.slice(words, F.size(words) - F.col("_n") + 1, F.col("_n")), " ")).otherwise("").alias("club"),
        F.regexp_replace("time_text", r"[()]", "").alias("time_text"),
    )


def flow_classes(lines: DataFrame, doc: str, line: str, text: str = "text") -> DataFrame:
    """lines with the class that each stands under (null before the first) and its declared count; class lines themselves are left out."""
    head = r"^\s*(.*\S)\s*\(\s*(\d+)\s*(?:/\s*\d+\s*)?\)\s*$"
    is_head = F.col(text).rlike(head)
    over = Window.partitionBy(doc).orderBy(line)
    held = F.last(F.when(is_head, F.struct(F.regexp_extract(text, head, 1).alias("name"), F.regexp_extract(text, head, 2).cast("int").alias("declared"))), True).over(over)
    out = lines.withColumn("_class", held).filter(~F.coalesce(is_head, F.lit(False)))
    return out.withColumn("category", F.col("_class.name")).withColumn("declared", F.col("_class.declared")).drop("_class")
