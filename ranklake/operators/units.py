"""Competitor units: who counts as one entry, and rows to units and back. Keys differ by consumer on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import team_status


def _members(name: Column, note: Column, fold: bool = True) -> Column:
    """Sorted distinct members of a pair whose note names the partners."""
    partners = F.filter(F.transform(F.split(F.substring(note, 10, 100000), ","), F.trim), lambda x: x != "")
    every = F.filter(F.concat(F.array(F.coalesce(name, F.lit(""))), partners), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(every, F.lower) if fold else every))


def has_partner(note: Column) -> Column:
    return F.coalesce(note.startswith("Partner: "), F.lit(False))


def audit_key(id_: str, name: str, kind: str, rank: str, status: str, time: str, club: str, note: str, number: str, team: str) -> Column:
    """Unit of a persisted row: a row, a pair by number, members or result, a team by number, name or label."""
    c = F.col
    text = lambda x: F.coalesce(c(x).cast("string"), F.lit("None"))
    blank = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    label = F.coalesce(F.nullif(F.trim(F.regexp_extract(blank(note), r"Staffel:\s*([^·]+)", 1)), F.lit("")), F.nullif(blank(club), F.lit("")), blank(note))
    return (
        F.when(c(kind).isin("individual", "family"), F.concat(F.lit("row:"), c(id_).cast("string")))
        .when((c(kind) == "pair") & (blank(number) != ""), F.concat(F.lit("pair:number:"), blank(number)))
        .when((c(kind) == "pair") & has_partner(c(note)), F.concat(F.lit("pair:members:"), F.array_join(_members(c(name), c(note)), ":")))
        .when(c(kind) == "pair", F.concat_ws(":", F.lit("pair"), text(rank), text(status), text(time), blank(club)))
        .when(blank(number) != "", F.concat(c(kind), F.lit(":number:"), blank(number)))
        .when(blank(team) != "", F.concat(c(kind), F.lit(":name:"), F.lower(F.trim(blank(team)))))
        .otherwise(F.concat(c(kind), F.lit(":legacy:"), F.lower(F.trim(label))))
    )


def source_unit(pos: str, kind: str, name: str, rank: str, status: str, time: str, club: str, note: str, number: str, team: str) -> Column:
    """Unit of a source row, before any duplicate is removed."""
    c = F.col
    blank = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    k = F.coalesce(c(kind), F.lit("individual"))
    return (
        F.when(k.isin("individual", "family"), F.concat(F.lit("row:"), c(pos).cast("string")))
        .when((k == "pair") & (blank(number) != ""), F.concat(F.lit("pair:n:"), blank(number)))
        .when((k == "pair") & has_partner(c(note)), F.concat(F.lit("pair:m:"), F.array_join(_members(c(name), c(note)), "|")))
        .when(k == "pair", F.concat_ws(":", F.lit("pair:r"), blank(rank), blank(status), blank(time), blank(club)))
        .otherwise(F.concat(k, F.lit(":"), F.coalesce(F.nullif(blank(number), F.lit("")), F.nullif(blank(team), F.lit("")), blank(note))))
    )


def dedup_unit(kind: str, rank: str, status: str, time: str, club: str, note: str, number: str, team: str, leg: str, keep_legs: Column) -> Column:
    c = F.col
    blank = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    team_id = F.coalesce(F.nullif(blank(number), F.lit("")), c(team))
    return (
        F.when((c(kind) == "relay") & keep_legs & c(leg).isNotNull(), F.concat_ws("#", team_id, c(leg).cast("string")))
        .when(c(kind) == "pair", F.coalesce(F.nullif(blank(note), F.lit("")), F.concat_ws(":", blank(rank), blank(status), blank(time), blank(club))))
        .otherwise(team_id)
    )


def team_key(number: str, team: str, club: str) -> Column:
    """n:number, else t:name, else c:club; null parts fall through."""
    part = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    return F.coalesce(part("n:", number), part("t:", team), part("c:", club))


def starter_unit(kind: str, person: str, number: str, team: str, club: str) -> Column:
    return (
        F.when(F.col(kind) == "individual", F.concat(F.lit("p:"), F.col(person).cast("string")))
        .when(F.col(kind).isin("relay", "team"), team_key(number, team, club))
        .otherwise(F.concat(F.lit("c:"), F.col(club)))
    )


def national_unit(id_: str, kind: str, key: str, partner_keys: str, number: str, team: str, club: str) -> Column:
    """A row, a pair by its members' sorted name keys, a team by number, name or club."""
    pair = F.when(F.size(partner_keys) > 0, F.array_join(F.array_sort(F.concat(F.array(F.col(key)), F.col(partner_keys))), "|")).otherwise(F.concat(F.lit("solo-"), F.col(id_).cast("string")))
    return F.when(F.col(kind) == "pair", pair).when(F.col(kind).isin("relay", "team"), team_key(number, team, club)).otherwise(F.concat(F.lit("row:"), F.col(id_).cast("string")))


def regional_unit(id_: str, kind: str, key: str, rank: str, time: str, number: str) -> Column:
    c = F.col
    blank = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    who = F.when(blank(number) != "", F.concat(F.lit("n:"), blank(number))).when(blank(key) != "", F.concat(F.lit("t:"), blank(key))).otherwise(F.concat_ws(":", F.lit("r"), blank(rank), blank(time)))
    return F.when(c(kind).isin("individual", "family"), F.concat(F.lit("row:"), c(id_).cast("string"))).otherwise(F.concat(c(kind), F.lit(":"), who))


def display_unit(id_: str, kind: str, rank: str, status: str, time: str, number: str, team: str, club: str) -> Column:
    c = F.col
    blank = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    return (
        F.when(c(kind) == "pair", F.concat_ws(":", blank(rank), blank(status), blank(time), blank(club)))
        .when(c(kind).isin("relay", "team"), F.coalesce(team_key(number, team, club), F.concat(F.lit("r:"), c(id_).cast("string"))))
        .otherwise(F.concat(F.lit("r:"), c(id_).cast("string")))
    )


def relay_metadata(kind: str, note: str, club: str, number: str, team: str, leg: str, legs: str) -> Column:
    """struct(team_number, team_name, leg_number, leg_count): fields where given, else read from the note."""
    c = F.col
    applies = c(kind).isin("relay", "team", "pair")
    text = F.coalesce(c(note), F.lit(""))
    name = F.coalesce(F.nullif(c(team), F.lit("")), F.nullif(F.trim(F.regexp_extract(text, r"Staffel:\s*([^·]+)", 1)), F.lit("")), c(club))
    by_note = lambda i: F.nullif(F.regexp_extract(text, r"Leg\s+(\d+)(?:/(\d+))?", i), F.lit("")).cast("int")
    return F.when(
        applies,
        F.struct(F.nullif(c(number).cast("string"), F.lit("")).alias("team_number"), name.alias("team_name"), F.coalesce(c(leg), by_note(1)).alias("leg_number"), F.coalesce(c(legs), F.when(c(leg).isNull(), by_note(2))).alias("leg_count")),
    )


def exploded_relay(teams: DataFrame, members: str = "members") -> DataFrame:
    """One row for each member (array of struct(name, person_id, leg, cumulative_s)) with its leg time and mates.

    A row keeps the team's rank, club and time; leg times are cumulative times less the last known one.
    """
    base = teams.withColumn("_team", F.xxhash64(*[c for c in teams.columns if c != members]))
    each = base.select(*[c for c in base.columns if c != members], F.col(members).alias("_all"), F.posexplode(members).alias("member_pos", "_m"))
    each = each.select("*", F.col("_m.name").alias("name"), F.col("_m.person_id").alias("person_id"), F.coalesce(F.col("_m.leg"), F.col("member_pos") + 1).alias("leg_number"), F.col("_m.cumulative_s").alias("cumulative_s"))
    before = F.filter(F.slice("_all", F.lit(1), F.col("member_pos")), lambda m: m["cumulative_s"].isNotNull())
    last = F.when(F.size(before) > 0, F.element_at(before, -1)["cumulative_s"]).otherwise(0)
    mates = F.array_distinct(F.array_remove(F.transform("_all", lambda m: m["name"]), F.col("name")))
    return each.withColumn("leg_s", F.col("cumulative_s") - last).withColumn("mates", mates).withColumn("leg_count", F.size("_all")).drop("_m", "_all", "_team")


def collapsed_family(df: DataFrame, keys: list[str], name: str = "name", seq: str = "seq") -> DataFrame:
    """Rows that share the keys as one, names joined in order, each once."""
    names = F.transform(F.array_sort(F.collect_list(F.struct(seq, name))), lambda x: x[name])
    return df.groupBy(*keys).agg(F.array_join(F.array_distinct(names), " + ").alias("names"), F.min(seq).alias(seq))


def ordered_members(df: DataFrame, keys: list[str], leg: str, name: str) -> DataFrame:
    """members: the names of each unit by leg, then name (no leg last)."""
    entry = F.struct(F.coalesce(F.col(leg), F.lit(2**31 - 1)).alias("leg"), F.col(name).alias("name"))
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["name"]).alias("members"))


def normalized_teams(df: DataFrame, keys: list[str], status: str = "status", legs: str = "leg_count", leg: str = "leg_number") -> DataFrame:
    """team_status and team_legs of a unit, given to all its members."""
    w = Window.partitionBy(*keys)
    return df.withColumn("team_status", team_status(F.collect_set(status).over(w))).withColumn("team_legs", F.greatest(F.max(legs).over(w), F.max(leg).over(w)))


def pair_names(text: Column) -> Column:
    """The two names of a joined field: parted by / + or &, a lone surname shared, or four bare tokens halved."""
    parts = F.filter(F.transform(F.split(text, r"\s*[/+&]\s*"), F.trim), lambda x: x != "")
    tokens = F.split(F.trim(text), r"\s+")
    a, b = F.get(parts, 0), F.get(parts, 1)
    words = lambda x: F.size(F.split(x, r"\s+"))
    shared = F.array(F.concat_ws(" ", a, F.element_at(F.split(b, r"\s+"), -1)), b)
    halves = F.array(F.concat_ws(" ", F.get(tokens, 0), F.get(tokens, 1)), F.concat_ws(" ", F.get(tokens, 2), F.get(tokens, 3)))
    return F.when(F.size(parts) == 2, F.when((words(a) == 1) & (words(b) >= 2), shared).otherwise(parts)).when((F.size(parts) == 1) & (F.size(tokens) == 4), halves)


def hyphen_pair(text: Column) -> Column:
    """Two names of 'Aa-Bb Cc-Dd' (first names, then surnames, hyphened)."""
    t = F.split(F.trim(text), r"\s+")
    first, last = F.split(F.get(t, 0), "-"), F.split(F.get(t, 1), "-")
    return F.when((F.size(t) == 2) & (F.size(first) == 2) & (F.size(last) == 2), F.zip_with(first, last, lambda x, y: F.concat_ws(" ", x, y)))


def expanded_pairs(df: DataFrame, name: str = "name", applies: Column | None = None) -> DataFrame:
    """Rows of two names as a row each, the other in `note` as partner; other rows as they are."""
    from ..functions.text import looks_like_person

    own = F.when(applies if applies is not None else F.lit(True), pair_names(F.col(name)))
    own = F.when(F.forall(own, looks_like_person), own)
    out = df.withColumn("_pair", own).withColumn("_each", F.coalesce(F.col("_pair"), F.array(F.col(name))))
    out = out.withColumn("_one", F.explode("_each"))
    partner = F.when(F.col("_pair").isNotNull(), F.concat(F.lit("Partner: "), F.array_join(F.array_remove("_pair", F.col("_one")), ", ")))
    return out.withColumn(name, F.col("_one")).withColumn("partner_note", partner).drop("_pair", "_each", "_one")


def split_overrides(df: DataFrame, mapping: DataFrame, person: str = "person_id") -> DataFrame:
    """Results of an id that stands for several people, once for each of them (mapping: old_id, person_ids)."""
    m = mapping.select(F.col("old_id").alias("_old"), F.explode("person_ids").alias("_new"))
    return df.join(m, F.col(person) == F.col("_old"), "left").withColumn(person, F.coalesce("_new", person)).drop("_old", "_new")


def team_rows(df: DataFrame, members: str, keys: list[str], seq: str) -> DataFrame:
    """Rows with an array of member names as a row a member, teams numbered by club in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(seq))
    return df.withColumn("team_sequence", n).select("*", F.posexplode(members).alias("member_pos", "name")).drop(members)
