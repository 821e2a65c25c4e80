"""Who a row is and which club it means, decided by evidence: edges from a name to the people it may be, and indexes of official names.

Everything is a join on a key that both sides hold whole (a name, a beginning, a run of eight
letters), between distinct names, so nothing is searched row by row and no list rides in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.numbers import synthetic_id
from ..functions.text import caseless

#: Official clubs of this many letters are found inside longer names, and names of so many as the beginning of one.
INSIDE, BEGUN = 8, 10

#: How sure a repair is, by its basis.
CONFIDENCE = {"book_of_record": 1.0, "registry": X.IDENTITY_CONFIDENCE["registry_club"], "fallback": X.IDENTITY_CONFIDENCE["without_year"]}


def crossed_ids(rows: DataFrame, members: DataFrame, profiles: DataFrame, aliases: DataFrame, key: str = "name_key", club: str = "club") -> DataFrame:
    """Rows whose id belongs to someone of another name, and whom they are: row_id, user_id, source_name, target_id, basis, confidence, state, proof.

    rows: row_id, user_id, name key, official club, result_kind. members (member_id, name key, club)
    are the book of record, profiles (person_id, name key, club) the registry, aliases (name key,
    member_id) confirmed by hand. Evidence for another person is, in this order: the only member of
    that name or confirmed alias; the only profile of that name and club; or, where the two names
    share no word, that the id is crossed, which makes a person of the name and club of its own.

    Names that share a word may be one person's: they need a second proof, which an alias or the
    registry is, and for a member of that name the row's own club. Rows without an id or a name,
    family rows, ids that nobody has, and names that fit are left out. user_id stays as it was read.
    """
    who = members.select(F.col("member_id").alias("id"), F.col(key).alias("own"), F.lit(0).alias("order")).unionByName(profiles.select(F.col("person_id").alias("id"), F.col(key).alias("own"), F.lit(1).alias("order")))
    source = who.filter("id is not null and own is not null").groupBy("id").agg(F.min(F.struct("order", "own"))["own"].alias("source_name"))
    named = rows.filter((F.col("result_kind") != "family") & F.col("user_id").isNotNull() & F.col(key).isNotNull())
    # what decides is the same for all rows of an id, a name and a club
    cases = named.select("user_id", F.col(key).alias("name"), F.col(club).alias("own_club")).distinct()
    cases = cases.join(source, F.col("user_id") == F.col("id")).drop("id").filter("name <> source_name")
    cases = cases.withColumn("shares", F.arrays_overlap(F.split("name", " "), F.split("source_name", " ")))

    m = members.select(F.col("member_id").alias("target"), F.col(key).alias("edge_name"), F.col(club).alias("target_club"))
    a = aliases.select(F.col("member_id").alias("target"), F.col(key).alias("edge_name")).distinct()
    edges = m.withColumn("alias", F.lit(False)).unionByName(a.join(m.select("target", "target_club"), "target").withColumn("alias", F.lit(True)).select("target", "edge_name", "target_club", "alias"))
    edges = edges.groupBy("edge_name", "target").agg(F.max("target_club").alias("target_club"), F.max("alias").alias("alias"))
    # three of a name at most tell the only one apart from several, whichever id the row has itself
    order = Window.partitionBy("edge_name").orderBy("target")
    edges = edges.withColumn("_n", F.row_number().over(order)).filter("_n <= 3").groupBy("edge_name").agg(F.collect_list(F.struct("target", "target_club", "alias")).alias("_people"))
    registry = profiles.filter(F.col(club).isNotNull()).select(F.col(key).alias("r_name"), F.col(club).alias("r_club"), F.col("person_id").alias("r_id")).distinct()
    order = Window.partitionBy("r_name", "r_club").orderBy("r_id")
    registry = registry.withColumn("_n", F.row_number().over(order)).filter("_n <= 3").groupBy("r_name", "r_club").agg(F.collect_list("r_id").alias("_ids"))

    out = cases.join(edges, F.col("name") == F.col("edge_name"), "left").join(registry, (F.col("name") == F.col("r_name")) & (F.col("own_club") == F.col("r_club")), "left")
    others = F.filter("_people", lambda p: p["target"] != F.col("user_id"))
    profiled = F.filter("_ids", lambda i: i != F.col("user_id"))
    book = F.when(F.size(others) == 1, others[0])
    listed = F.when(F.size(profiled) == 1, profiled[0])
    out = out.withColumn("_book", book).withColumn("_listed", listed)
    by_book, by_registry = F.col("_book").isNotNull(), F.col("_listed").isNotNull()
    basis = F.when(by_book, "book_of_record").when(by_registry, "registry").when(~F.col("shares"), "fallback")
    proof = F.when(by_book & F.col("_book.alias"), "alias").when(by_book & ~F.col("shares"), "other name").when(by_book & (F.col("_book.target_club") == F.col("own_club")), "club")
    proof = F.when(by_book, proof).when(by_registry, "registry").when(~F.col("shares"), "other name")
    target = F.when(by_book, F.col("_book.target")).when(by_registry, F.col("_listed")).otherwise(_fallback("name", "own_club"))
    sure = F.coalesce(*[F.when(F.col("basis") == k, v) for k, v in CONFIDENCE.items()])
    out = out.select("user_id", F.col("name").alias("_name"), F.col("own_club").alias("_club"), "source_name", target.alias("target_id"), basis.alias("basis"), proof.alias("proof")).filter("proof is not null")
    out = out.withColumn("confidence", sure).withColumn("state", F.when(F.col("confidence") >= 0.95, "resolved").otherwise("candidate"))
    found = named.join(out.withColumnRenamed("user_id", "_user"), (F.col("user_id") == F.col("_user")) & (F.col(key) == F.col("_name")) & F.col(club).eqNullSafe(F.col("_club")))
    return found.select("row_id", "user_id", "source_name", "target_id", "basis", "confidence", "state", "proof")


def _fallback(name: str, club: str) -> Column:
    """The id of a person known by a name and club alone: negative, the same in every build."""
    return synthetic_id(F.concat_ws("|", F.col(name), F.coalesce(club, F.lit(""))), F.lit(None).cast("int"))


def repaired_ids(rows: DataFrame, repairs: DataFrame, person: str = "person_id") -> DataFrame:
    """rows with the person, basis, confidence and state of their repairs; what no repair names stays, and user_id always does."""
    r = repairs.select("row_id", F.col("target_id").alias("_t"), F.col("basis").alias("_b"), F.col("confidence").alias("_c"), F.col("state").alias("_s"))
    out = rows.join(r, "row_id", "left")
    pick = lambda new, old: F.coalesce(F.col(new), F.col(old) if old in rows.columns else F.lit(None))
    return out.withColumns({person: pick("_t", person), "identity_basis": pick("_b", "identity_basis"), "identity_confidence": pick("_c", "identity_confidence"), "identity_state": pick("_s", "identity_state")}).drop("_t", "_b", "_c", "_s")


# clubs -------------------------------------------------------------------------------------------


def canonical_clubs(names: DataFrame, official: DataFrame, aliases: dict[str, str] | None = None, name: str = "club") -> DataFrame:
    """club and official_club of every distinct club name; null where no rule leads to an official one.

    A name loses marks and a squad number, takes its alias, and is compared without case. Else it is
    official without a short code before it, or with its abbreviation spelled out, or if just one
    official name of eight letters or more stands in it, or if its ten letters or more begin just
    one. Every rule is an equality join: a beginning is looked up among all beginnings of official
    names; an official name inside another one is found by its rarest run of eight letters and then
    compared whole. aliases is a short list, in one expression.
    """
    table = official.select(F.trim(official.columns[0]).alias("official")).filter("official <> ''").distinct().withColumn("low", caseless("official"))
    given = names.select(F.col(name).alias("club")).distinct()
    now = F.trim(F.regexp_replace("club", r"\*+$", ""))
    now = F.coalesce(F.nullif(F.trim(F.regexp_extract(now, X.CLUB_NUMBER_SUFFIX, 1)), F.lit("")), now)
    for a, b in (aliases or {}).items():
        now = F.when(caseless(now) == a.casefold(), b).otherwise(now)
    own = given.select("club", now.alias("now")).withColumn("low", caseless("now"))

    # one official spelling for each spelling without case, the least
    exact = table.groupBy("low").agg(F.min("official").alias("official"))
    code = F.nullif(F.trim(F.regexp_extract("now", X.CLUB_CODE_PREFIX, 2)), F.lit(""))
    spelled = F.nullif(F.trim(F.regexp_extract("now", X.CLUB_ABBREVIATED, 1)), F.lit(""))
    forms = F.array(F.struct(F.lit(1).alias("rule"), F.col("low").alias("form"), F.lit(None).cast("string").alias("plain")), F.struct(F.lit(2).alias("rule"), caseless(code).alias("form"), code.alias("plain")), F.struct(F.lit(3).alias("rule"), caseless(F.concat(F.lit("Naturfreunde "), spelled)).alias("form"), F.concat(F.lit("Naturfreunde "), spelled).alias("plain")))
    looked = own.select("club", F.explode(forms).alias("f")).select("club", "f.*").filter("form <> ''").join(exact, F.col("form") == exact["low"])
    # behind a code, and spelled out, the case counts
    direct = looked.filter("rule = 1 OR plain = official").select("club", "rule", "official")

    # the only official name that stands in a longer one
    runs = F.transform(F.sequence(F.lit(1), F.length("low") - INSIDE + 1), lambda i: F.substring("low", i, F.lit(INSIDE)))
    long = table.filter(F.length("low") >= INSIDE).select("official", "low", F.posexplode(runs).alias("at", "run"))
    rare = long.join(long.groupBy("run").agg(F.count("*").alias("n")), "run").groupBy("official", "low").agg(F.min(F.struct("n", "at", "run")).alias("r"))
    index = rare.select("official", F.col("low").alias("whole"), F.col("r.at").alias("skip"), F.col("r.run").alias("run"))
    tried = own.filter(F.length("low") >= INSIDE).select("club", "low", F.posexplode(runs).alias("pos", "run"))
    hits = tried.join(index, "run").filter(F.substring(F.col("low"), F.col("pos") - F.col("skip") + 1, F.length("whole")) == F.col("whole")).filter("pos >= skip")
    inside = hits.groupBy("club").agg(F.count_distinct("official").alias("n"), F.min("official").alias("official")).filter("n = 1").select("club", F.lit(4).alias("rule"), "official")

    # the only official name that a cut one begins
    starts = F.transform(F.sequence(F.lit(BEGUN), F.length("low")), lambda n: F.substring("low", F.lit(1), n))
    begun = table.filter(F.length("low") >= BEGUN).select("official", F.explode(starts).alias("start")).groupBy("start").agg(F.count_distinct("official").alias("n"), F.min("official").alias("official")).filter("n = 1")
    cut = own.join(begun, F.col("low") == F.col("start")).select("club", F.lit(5).alias("rule"), "official")

    best = direct.unionByName(inside).unionByName(cut).groupBy("club").agg(F.min(F.struct("rule", "official"))["official"].alias("official_club"))
    return given.join(best, "club", "left").select(F.col("club").alias(name), "official_club")
