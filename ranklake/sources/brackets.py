"""Knock-out pages: heats one below the other, and the places over all of them.

A page has heats in one table or in several. A heat begins with its name and a count; its rows have a
place, AK, a champion's line or nothing in front of name, club and result, and may begin with an
empty spacer cell. `overall` puts the heats together: who came further stands before who did not.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .html import RANK, tables
from .relays import row, says_result, seconds

# --- fixed values: the rounds of a knock-out, from the first to the last ---
ROUNDS = ((0, r"(?iu)prolog|qualifi|vorlauf|heat"), (1, r"(?iu)achtel|eighth"), (2, r"(?iu)viertel|quarter"), (3, r"(?iu)halb|semi"))
FINAL = r"(?iu)final"
GROUP = r"(?u)(?:\b([A-Z])[- ]?Final|[Ff]inale?\s+([A-Z])\b|\s([A-Z]|\d{1,2})$)"
# --- end of fixed values ---

_COUNT = re.compile(r"^\((\d+)(?:\s*/\s*\d+)?\)$")
_CHAMPION = re.compile(r"(?iu)^(\d+)\.?(?:\s+(?:und|&)\s+|\s+öster)")
_AWAY = re.compile(r"(?iu)^(?:a\.?\s*k\.?|au(?:ß|ss)er konkurrenz|ohne wertung|nc)$")
_WORDS = re.compile(r"[^\W\d_]{2}")
_DNS = re.compile(r"(?iu)n\.?\s*ang|dns|nicht angetreten|did not start")


def parse_bracket(html: str) -> list[dict]:
    """The heats of a page as classes.

    The result is the first time behind the name, else the first cell that is a status; the cell
    behind the name is the club unless it is that result. Where a heat has more rows than it counts,
    and just as many without those who did not start, the latter are marked as uncounted.
    """
    heats: list[dict] = []
    for cells in (r for t in tables(html) for r in t):
        kind, what = _heat_row(tuple(cells))
        if kind == "heat":
            if not (heats and heats[-1]["name"] == what[0]):
                heats.append({"name": what[0], "declared": what[1], "results": []})
        elif kind == "row" and heats:
            heats[-1]["results"].append({**what})
    for h in heats:
        if len(h["results"]) <= h["declared"]:
            continue
        absent = [bool(_DNS.search(r["time_text"])) for r in h["results"]]
        if len(absent) - sum(absent) == h["declared"]:
            h["results"] = [{**r, "uncounted": a} for r, a in zip(h["results"], absent, strict=True)]
    return [h for h in heats if h["results"]]


@lru_cache(maxsize=1 << 14)
def _heat_row(cells: tuple[str, ...]) -> tuple[str, tuple | dict | None]:
    """A heat's name and count, a result, or nothing. Rows of a heat recur in later rounds' pages, so the last ones are kept."""
    cells = tuple(c.strip() for c in cells)
    while cells and not cells[0]:
        cells = cells[1:]
    if len(cells) >= 2 and (m := _COUNT.match(cells[1])):
        return "heat", (cells[0], int(m[1]))
    if len(cells) < 2:
        return "none", None
    place, champion = RANK.match(cells[0]), _CHAMPION.match(cells[0])
    rank = int(place[1]) if place else int(champion[1]) if champion else None
    away = bool(_AWAY.match(cells[0]))
    name, *rest = cells[1:] if rank is not None or away else cells
    if not _WORDS.search(name) or says_result(name) or not rest:
        return "none", None
    at = next((i for i, c in enumerate(rest) if seconds(c) is not None and not c.startswith("+")), None)
    if at is None:
        at = next((i for i, c in enumerate(rest) if says_result(c.strip("()"))), None)
    club = rest[0] if at != 0 else ""
    value = rest[at] if at is not None else ""
    return "row", row(name, club, value.strip("()"), rank, rank_text=cells[0] if rank is not None or away else "", out_of_competition=away or value.startswith("("))


def round_of(heat: Column) -> Column:
    """The round of a heat's name: 0 a prologue, 1 to 3 up to the semi-final, 4 a final; null for any other."""
    out = F
    for n, pattern in ROUNDS:
        out = out.when(heat.rlike(pattern), n)
    return out.when(heat.rlike(FINAL), 4)


def group_of(heat: Column) -> Column:
    """The letter or number of a heat within its round, empty for the only one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(heat, GROUP, i), F.lit("")) for i in (1, 2, 3)], F.lit(""))


def overall(rows: DataFrame, key: str, heat: str = "category", person: str = "name", rank: str = "rank", time: str = "time_s") -> DataFrame:
    """A row for each person of a key: its last round and heat, the heat before, and the place over all heats.

    A later round stands before an earlier one, and the final A before B; within a round the place
    in the heat decides, then the time. Who has no place stands behind those of the round who have
    one. Equals share a place. Heats of no known round are left out; a person named twice in a round
    counts with the better row. Null times come last.
    """
    h = F.col(heat)
    known = rows.select(key, F.col(person).alias("person"), h.alias("heat"), round_of(h).alias("round"), group_of(h).alias("group"), F.col(rank).alias("heat_rank"), F.col(time).alias("heat_time")).filter("round is not null and person is not null")
    # one struct orders a person's rows: later round, then the better final, place and time
    best = F.struct((-F.col("round")).alias("r"), F.when(F.col("round") == 4, F.col("group")).otherwise("").alias("g"), F.coalesce("heat_rank", F.lit(2**31 - 1)).alias("p"), F.coalesce(F.col("heat_time").cast("double"), F.lit(float("inf"))).alias("t"), F.col("heat").alias("h"))
    # all groups and places are within a key: rows are dealt by it once
    by_round = known.repartition(key).withColumn("best", best).groupBy(key, "person", "round").agg(F.min("best").alias("best"))
    each = by_round.groupBy(key, "person").agg(F.array_sort(F.collect_list("best")).alias("way"))
    last = F.col("way")[0]
    places = Window.partitionBy(key).orderBy(last["r"], last["g"], last["p"], last["t"])
    return each.select(
        key,
        "person",
        (-last["r"]).alias("round"),
        last["h"].alias("heat"),
        F.when(F.size("way") > 1, F.get("way", F.lit(1))["h"]).alias("from_heat"),
        F.rank().over(places).cast("int").alias("place"),
    )
