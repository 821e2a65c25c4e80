"""Who is who: registry matches, stateful resolution by name, merges and signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.fixed import IDENTITY_CONFIDENCE
from ..functions.numbers import synthetic_id
from ..functions.text import clean_name, is_valid_name, name_key
from .lineage import cut


def registry_match(rows: DataFrame, registry: DataFrame, key: str = "name_key", year: str = "birth_year", club: str = "club") -> DataFrame:
    """rows with registry_id and basis: the only profile of the name and year, else of the name and club.

    A name and year that several profiles share is settled as unresolved: the club isn't asked then.
    """
    by_year = registry.filter(F.col(year).isNotNull()).groupBy(F.col(key).alias("_k1"), F.col(year).alias("_y")).agg(F.count_distinct("person_id").alias("_ny"), F.min("person_id").alias("_py"))
    by_club = registry.filter(F.col(club).isNotNull()).groupBy(F.col(key).alias("_k2"), F.col(club).alias("_c")).agg(F.count_distinct("person_id").alias("_nc"), F.min("person_id").alias("_pc"))
    out = rows.join(by_year, (F.col(key) == F.col("_k1")) & (F.col(year) == F.col("_y")), "left").join(by_club, (F.col(key) == F.col("_k2")) & (F.col(club) == F.col("_c")), "left")
    year_hit = F.col("_ny").isNotNull()
    found = F.when(year_hit, F.when(F.col("_ny") == 1, F.col("_py"))).when(F.col("_nc") == 1, F.col("_pc"))
    basis = F.when(year_hit & (F.col("_ny") == 1), "registry_year").when(~year_hit & (F.col("_nc") == 1), "registry_club")
    return out.withColumn("registry_id", found).withColumn("basis", basis).drop("_k1", "_y", "_ny", "_py", "_k2", "_c", "_nc", "_pc")


def resolved(rows: DataFrame, key: str = "name_key", year: str = "birth_year", seq: str = "seq") -> DataFrame:
    """person_id, identity_state, confidence of every row, resolved within its name in the order of seq.

    rows: name key, birth year, seq (unique, of any type that has an order), user_id (direct, may be
    null), registry_id and basis (from registry_match). A direct id is certain. A registry match is
    resolved. Else the name and year seen before, any registered id of the name, a candidate of
    compatible year, or a new id. State never crosses names.

    Only the first of the rows that agree in year and ids changes what is known of a name, so that
    first rows alone are walked through, a name at a time; the others take their outcome. The one
    exception, rows without year and ids, go to the first registered id once there is one.
    """
    own = [key, year, "user_id", "registry_id", "basis"]
    first = rows.groupBy(*own).agg(F.min(seq).alias("_first")).withColumn("_fresh", synthetic_id(F.col(key), F.col(year)))
    kind = ", ".join(f"`{c}` {first.schema[c].dataType.simpleString()}" for c in [*own, "_first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_year: dict = {}
        registered: dict[int, None] = {}
        years: dict[int, object] = {}
        last: object = run  # no name is equal to it
        none = lambda v: v is None or v != v
        for b in batches:
            out = []
            for name, y, user, registry, basis, fresh in zip(*[b.column(c).to_pylist() for c in [*own, "_fresh"]], strict=True):
                if name != last:
                    by_year, registered, years, last = {}, {}, {}, name
                y = None if none(y) else int(y)
                if not none(user):
                    p, state, sure = int(user), "resolved", IDENTITY_CONFIDENCE["direct"]
                elif not none(registry):
                    p, state, sure = int(registry), "resolved", IDENTITY_CONFIDENCE[basis]
                else:
                    sure = IDENTITY_CONFIDENCE["with_year" if y is not None else "without_year"]
                    state = "candidate"
                    if y is not None and y in by_year:
                        p = by_year[y]
                    elif registered:
                        p = next(iter(registered))
                    else:
                        p = next((c for c, known in years.items() if known is None or y is None or known == y), int(fresh))
                if p > 0:
                    registered.setdefault(p)
                if y is not None:
                    by_year.setdefault(y, p)
                if years.get(p) is None:
                    years[p] = y
                out.append((p, state, sure))
            more = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.float64()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in [*own, "_first"]], *more], [*own, "_first", "person_id", "identity_state", "identity_confidence"])

    # a name's rows lie in one task, one behind the other: names are walked through without a frame for each
    walked = first.repartition(key).sortWithinPartitions(key, "_first").mapInArrow(run, f"{kind}, person_id bigint, identity_state string, identity_confidence double")
    solved = cut(walked, "identity-outcomes")
    since = solved.filter("person_id > 0").groupBy(F.col(key).alias("_key")).agg(F.min("_first").alias("_since"), F.min_by("person_id", "_first").alias("_registered"))
    solved = solved.select(*[F.col(c).alias(f"_{c}") for c in own], "person_id", "identity_state", "identity_confidence")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own))
    out = rows.join(solved, same).join(since, F.col(key).eqNullSafe(F.col("_key")), "left")
    late = F.col(year).isNull() & F.col("user_id").isNull() & F.col("registry_id").isNull() & F.coalesce(F.col(seq) > F.col("_since"), F.lit(False))
    return out.withColumn("person_id", F.when(late, F.col("_registered")).otherwise(F.col("person_id"))).drop(*[f"_{c}" for c in own], "_key", "_since", "_registered")


def merge_edges(persons: DataFrame, key: str = "name_key", year: str = "birth_year", verified: str = "verified") -> DataFrame:
    """old_id, new_id: accounts of one name and compatible years under the best of them.

    Best: verified, then with a year, then the least id. Names with two known years merge only
    within a year; synthetic ids (negative) join the account of their own year.
    """
    w = Window.partitionBy(key)
    years = F.size(F.collect_set(F.when(F.col("person_id") > 0, F.col(year))).over(w))
    p = persons.withColumn("_years", years)
    group = F.when(F.col("_years") <= 1, F.lit(-1)).otherwise(F.col(year))
    p = p.withColumn("_group", group).filter(F.col("_group").isNotNull())
    order = F.struct((F.col("person_id") > 0).alias("a"), F.col(verified).alias("b"), F.col(year).isNotNull().alias("c"), (-F.col("person_id")).alias("d"))
    best = F.max_by("person_id", order).over(Window.partitionBy(key, "_group"))
    return p.withColumn("new_id", best).filter("person_id <> new_id").select(F.col("person_id").alias("old_id"), "new_id")


def merge_conflicts(df: DataFrame, person: str, key: str, year: str) -> DataFrame:
    """Ids under which two names, or two known birth years, would meet."""
    out = df.groupBy(person).agg(F.count_distinct(key).alias("names"), F.count_distinct(year).alias("years"))
    return out.filter("names > 1 OR years > 1")


#: Names of more words than this are compared word by word; all others by their subsets of words.
MOST_WORDS = 8


def pending_candidates(rows: DataFrame, registry: DataFrame, key: str = "name_key", most: int = 4) -> DataFrame:
    """Up to `most` profiles for each row that share words with its name: most shared words first, then the least id.

    Names are joined by the sets of words that they share. Who is among the best by sharing k words
    is among the least `most` ids of those who have these k words, for any more of the others would
    come first; so a set keeps `most` profiles, and a word that half of all names have makes no more
    pairs than any other. Names of more than MOST_WORDS words, which have too many subsets, and
    those of a row or person that has several names with a word in common, are joined word by word.
    A word counts once in a name, and once more for each further name; rows without a name have no
    candidates.
    """
    words = F.array_distinct(F.split(key, " "))
    bag = lambda df, own: df.filter(F.col(key).isNotNull()).groupBy(own).agg(F.array_sort(F.flatten(F.collect_list(words))).alias("_bag"))
    named, people = bag(rows, "seq"), bag(registry, "person_id")
    narrow = (F.size("_bag") <= MOST_WORDS) & (F.size(F.array_distinct("_bag")) == F.size("_bag"))
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("_bag")).cast("int") - 1)
    inside = lambda m: F.filter("_bag", lambda _, i: m.bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0)
    sets = F.transform(masks, lambda m: F.struct(F.array_join(inside(m), " ").alias("set"), F.bit_count(m).alias("shared")))
    asked = named.select("_bag").distinct()
    a = asked.filter(narrow).select("_bag", F.explode(sets).alias("_s")).select("_bag", "_s.*")
    first = Window.partitionBy("set").orderBy("person_id")
    b = people.filter(narrow).select("person_id", F.explode(sets).alias("_s")).select("person_id", F.col("_s.set").alias("set"))
    b = b.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= most).groupBy("set").agg(F.collect_list("person_id").alias("_people"))
    by_sets = a.join(b, "set").select("_bag", F.explode("_people").alias("person_id"), "shared")
    wide = lambda df, at: df.select(at, F.explode("_bag").alias("_w"))
    one = wide(asked.filter(~narrow), "_bag").join(wide(people, "person_id"), "_w").unionByName(wide(asked.filter(narrow), "_bag").join(wide(people.filter(~narrow), "person_id"), "_w"))
    by_words = one.groupBy("_bag", "person_id").agg(F.count("*").alias("shared"))
    n = by_sets.groupBy("_bag", "person_id").agg(F.max("shared").cast("long").alias("shared")).unionByName(by_words)
    by = Window.partitionBy("_bag").orderBy(F.col("shared").desc(), "person_id")
    chosen = n.withColumn("choice", F.row_number().over(by)).filter(F.col("choice") <= most)
    return named.join(chosen, "_bag").select("seq", "person_id", "shared", "choice")


def profile_index(profiles: DataFrame) -> DataFrame:
    """person_id, name, name_key, birth_year, nationality of the registry's usable profiles, one a person.

    Names are cleaned as those of results are; placeholder years are none. Profiles without a
    positive id or a name that can be one are left out; of repeated ids the last name counts.
    """
    name = clean_name(F.concat_ws(" ", F.trim("first_name"), F.trim("last_name")))
    out = profiles.select(F.col("person_id").try_cast("long").alias("person_id"), name.alias("name"), F.when(~F.col("birth_year").isin(1900, 1901), F.col("birth_year")).alias("birth_year"), F.nullif(F.col("nationality"), F.lit("")).alias("nationality"))
    out = out.filter((F.col("person_id") > 0) & is_valid_name("name")).withColumn("name_key", name_key("name"))
    best = F.max(F.struct("name", "name_key", "birth_year", "nationality")).alias("_p")
    return out.groupBy("person_id").agg(best).select("person_id", "_p.*")


def directly_known(rows: DataFrame, index: DataFrame, user: str = "user_id") -> DataFrame:
    """person_id, name, birth_year, nationality of every id that rows name: the profile's values, else the first row's that has one.

    rows: seq, user_id, name, birth_year, nationality. Only positive ids are anyone's.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    seen = rows.filter(F.col(user) > 0).groupBy(F.col(user).alias("person_id")).agg(*[first(c).alias(f"_{c}") for c in ("name", "birth_year", "nationality")])
    out = seen.join(index, "person_id", "left")
    return out.select("person_id", *[F.coalesce(c, f"_{c}").alias(c) for c in ("name", "birth_year", "nationality")])


def member_match(rows: DataFrame, members: DataFrame, aliases: DataFrame, key: str = "name_key", year: str = "birth_year") -> DataFrame:
    """member_id by a confirmed alias, else by the one member of that name, else of that name and year."""
    a = aliases.groupBy(F.col(key).alias("_ka")).agg(F.min("member_id").alias("_a"))
    one = members.groupBy(F.col(key).alias("_kn")).agg(F.count_distinct("member_id").alias("_n"), F.min("member_id").alias("_m")).filter("_n = 1").drop("_n")
    tie = members.groupBy(F.col(key).alias("_kt"), F.col(year).alias("_yt")).agg(F.count_distinct("member_id").alias("_n"), F.min("member_id").alias("_t")).filter("_n = 1").drop("_n")
    out = rows.join(a, F.col(key) == F.col("_ka"), "left").join(one, F.col(key) == F.col("_kn"), "left").join(tie, (F.col(key) == F.col("_kt")) & (F.col(year) == F.col("_yt")), "left")
    return out.withColumn("member_id", F.coalesce("_a", "_m", "_t")).drop("_ka", "_a", "_kn", "_m", "_kt", "_yt", "_t")


def signatures(df: DataFrame, person: str, *parts: str) -> DataFrame:
    """A person's results as rows to compare builds by."""
    return df.select(person, F.xxhash64(*parts).alias("signature")).distinct()


def voted_redirects(before: DataFrame, after: DataFrame, person: str = "person_id", least: int = 2) -> DataFrame:
    """old_id, new_id, votes: ids that vanished, led to the one id that shares most of their signatures."""
    gone = before.join(after.select(person).distinct(), person, "left_anti").withColumnRenamed(person, "old_id")
    votes = gone.join(after.withColumnRenamed(person, "new_id"), "signature").groupBy("old_id", "new_id").agg(F.count("*").alias("votes"))
    total = gone.groupBy("old_id").agg(F.count("*").alias("_all"))
    w = Window.partitionBy("old_id")
    votes = votes.join(total, "old_id").withColumn("_top", F.max("votes").over(w)).filter("votes = _top").withColumn("_ties", F.count("*").over(w))
    return votes.filter(f"_ties = 1 AND (votes >= {least} OR votes = _all)").select("old_id", "new_id", "votes")


def published_aliases(df: DataFrame, person: str, name: str, source: str) -> DataFrame:
    return df.groupBy(person, name, source).agg(F.count("*").alias("occurrences"))


def first_names(people: DataFrame, first: str, last: str) -> DataFrame:
    """Lower-cased first names that are no one's last name and end like none."""
    low = lambda c: people.select(F.lower(F.trim(c)).alias("name")).filter("name <> ''")
    return low(first).exceptAll(low(first).join(low(last), "name", "left_semi")).distinct().filter(~F.col("name").rlike("(?iu)ov[áa]$"))


def eligible_identity(kind: Column, person: Column, confidence: Column) -> Column:
    return F.when(kind.isin("family"), "not_applicable").when(person.isNull(), "unresolved").when(confidence >= 0.95, "resolved").otherwise("candidate")
