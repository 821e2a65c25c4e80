"""Scans of result documents, API rows, calendars and registers; each returns a flat table with its order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import fixed as X
from ..functions.numbers import parse_time_loose
from ..functions.text import api_status, clean_club, clean_name, is_junk_document, live_status, normalized_status, parse_status
from ..operators.filters import is_active, is_clone_title


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) is not None and len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []) > 0


def optional_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON register, one value a file or (lines) one a line, which large ones are split by; a missing file is an empty one."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def calendar(spark: SparkSession, path: str, excluded: DataFrame | None = None, sport_overrides: DataFrame | None = None, lines: bool = False) -> DataFrame:
    """Events without clones and excluded ids; dates cut to days; sport types corrected by a register (event_id, sport)."""
    e = spark.read.schema(S.EVENT).option("multiLine", not lines).json(path).filter(~is_clone_title("title"))
    if excluded is not None:
        e = e.join(excluded.select(F.col("event_id").alias("id")), "id", "left_anti")
    e = e.withColumn("date_from", F.substring("dateFrom", 1, 10)).withColumn("date_to", F.substring("dateTo", 1, 10))
    if sport_overrides is not None:
        e = e.join(F.broadcast(sport_overrides.select(F.col("event_id").alias("id"), "sport")), "id", "left").withColumn("sportType", F.coalesce("sport", "sportType")).drop("sport")
    return e


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Normalized documents whose names have the right form, stage documents apart; split times and the like are left out."""
    d = spark.read.schema(S.DOCUMENT).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    d = d.withColumn("_name", F.element_at(F.split("path", "/"), -1)).filter(F.col("_name").rlike(X.DOCUMENT_NAME) & ~is_junk_document("fileName"))
    return multistage(d).drop("_name")


def multistage(d: DataFrame) -> DataFrame:
    """A document with stage documents as one row for each of them."""
    plain = d.filter(F.coalesce(F.size("stageDocuments"), F.lit(0)) <= 0).withColumn("stageNumber", F.lit(None).cast("int"))
    staged = d.filter(F.size("stageDocuments") > 0).withColumn("s", F.explode("stageDocuments"))
    staged = staged.withColumn("categories", F.col("s.categories")).withColumn("docDate", F.col("s.stageDate")).withColumn("docTitle", F.col("s.stageTitle")).withColumn("listType", F.coalesce("s.listType", "listType")).withColumn("stageNumber", F.col("s.stageNumber")).drop("s")
    return plain.drop("stageDocuments").unionByName(staged.drop("stageDocuments"))


def document_rows(d: DataFrame) -> DataFrame:
    """A row for each result with path, category_pos and row_pos, its values cleaned and normalized."""
    c = d.select("eventId", "source", "path", "fileName", "listType", "docDate", "docTitle", "stageNumber", F.posexplode("categories").alias("category_pos", "c"))
    r = c.select("*", F.posexplode("c.results").alias("row_pos", "r"))
    st = normalized_status(F.coalesce(F.col("r.status"), parse_status("r.timeText")), F.col("r.timeText"), F.coalesce(F.col("r.outOfCompetition"), F.lit(False)))
    time = F.coalesce(F.col("r.timeS"), parse_time_loose("r.timeText"))
    return r.select(
        F.col("eventId").alias("event_id"), "source", "path", "listType", "docDate", "stageNumber", "category_pos", "row_pos",
        F.col("c.name").alias("category"), F.col("c.declaredStarters").alias("declared"), F.col("c.sourceUnitCount").alias("source_unit_count"),
        F.col("r.name").alias("observed_name"), clean_name("r.name").alias("name"), F.col("r.club").alias("observed_club"), clean_club("r.club").alias("club"),
        F.col("r.rank").alias("rank"), st["status"].alias("status"), st["ooc"].alias("out_of_competition"),
        F.when(time >= 0, time).alias("time_s"), F.col("r.timeText").alias("observed_time"), F.col("r.status").alias("observed_status"),
        F.coalesce(F.col("r.resultKind"), F.when(F.col("listType") == "relay", "relay").otherwise("individual")).alias("result_kind"),
        F.col("r.yearOfBirth").alias("birth_year"), F.col("r.userId").try_cast("long").alias("user_id"), F.col("r.teamNumber").alias("team_number"), F.col("r.teamName").alias("team_name"),
        F.col("r.leg").alias("leg_number"), F.col("r.legCount").alias("leg_count"), F.col("r.note").alias("note"), F.col("r.championship").alias("championship"), F.col("r.sourceNat").alias("source_nat"),
    )


def sequenced(rows: DataFrame, *order: Column | str, out: str = "seq") -> DataFrame:
    """Rows with an order that the input alone decides (never a generated id): a struct, to sort and compare by."""
    return rows.withColumn(out, F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order]))


def api_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """API result rows that are active, semantic duplicates once, best result type of each class, with status and tag.

    An event is a file (`17.json`, one array) or a folder of files (`event_id=17`, a row a line).
    """
    from ..operators.championship import api_tag
    from ..operators.dedup import best_priority, semantic

    raw = spark.read.schema(S.API_ROW).option("multiLine", not lines).json(path).withColumn("path", F.input_file_name())
    event = [F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")) for pattern in (r"event_id=(\d+)/", r"(\d+)\.json$")]
    raw = raw.withColumn("event_id", F.coalesce(*event).try_cast("long"))
    raw = raw.filter(is_active("classification", "categoryShortTitle", "clubName"))
    raw = semantic(raw, ["id", "updatedAt"], "id")
    kind = F.when(F.col("resultType") == "official", 0).when(F.col("resultType") == "unofficial", 1).when(F.col("resultType") == "live", 2).otherwise(3)
    raw = best_priority(raw, ["event_id", "eventStageId", "categoryShortTitle"], kind)
    return raw.withColumn("status", api_status("classification")).withColumn("championship_tag", api_tag(F.transform("championship", lambda c: c["championshipShortName"])))


def relay_members(api: DataFrame) -> DataFrame:
    """API rows with team members as a row a member (see units.exploded_relay for the leg times)."""
    name = lambda m: F.concat_ws(" ", m["firstName"], m["lastName"])
    m = F.transform("teamMembers", lambda x: F.struct(name(x).alias("name"), x["userId"].try_cast("long").alias("person_id"), x["leg"].alias("leg"), x["overall"]["time"].cast("int").alias("cumulative_s")))
    return api.filter(F.size("teamMembers") > 0).withColumn("members", m).drop("teamMembers")


def member_registry(spark: SparkSession, csv: str, json: str | None = None) -> DataFrame:
    """The private member list: semicolon CSV, else JSON, else empty."""
    if exists(spark, csv):
        return spark.read.schema(S.MEMBERS).option("sep", ";").option("header", True).csv(csv)
    return optional_json(spark, json, S.MEMBERS) if json else spark.createDataFrame([], S.MEMBERS)


def member_mapping(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """key, kind, target, targets of a hand-kept ledger of members: one row an entry; a missing or unreadable file is an empty one.

    Kinds: alias (a name key to a member id), not_member, internal_member, club_override (to a
    club; null for none) and split_override (one garbled name to several people).
    """
    schema = "aliases map<string,string>, not_member array<string>, internal_member map<string,string>, club_override map<string,string>, split_override map<string,array<struct<name:string,id:string>>>"
    m = optional_json(spark, path, schema, lines)
    none = F.lit(None).cast("array<struct<name:string,id:string>>").alias("targets")
    out = [m.select(F.explode(c).alias("key", "target")).select("key", F.lit(kind).alias("kind"), "target", none) for c, kind in (("aliases", "alias"), ("internal_member", "internal_member"), ("club_override", "club_override"))]
    out.append(m.select(F.explode("not_member").alias("key")).select("key", F.lit("not_member").alias("kind"), F.lit(None).cast("string").alias("target"), none))
    out.append(m.select(F.explode("split_override").alias("key", "targets")).select("key", F.lit("split_override").alias("kind"), F.lit(None).cast("string").alias("target"), "targets"))
    return reduce(DataFrame.unionByName, out)


def official_clubs(current: DataFrame, historical: DataFrame) -> DataFrame:
    return current.select("name").union(historical.select("name")).distinct()


def club_jurisdictions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """club, region, validity; codes that are no region are skipped."""
    j = optional_json(spark, path, S.JURISDICTION, lines).select(F.explode("clubs").alias("c")).select(F.col("c.club").alias("club"), F.col("c.jurisdiction").alias("region"), F.col("c.valid_from").alias("valid_from"), F.col("c.valid_to").alias("valid_to"))
    return j.filter(F.col("region").isin(*X.REGIONS))


def person_registry(spark: SparkSession, path: str, version: int = 1, lines: bool = False) -> DataFrame:
    """Profiles of a registry snapshot of the right version, else none."""
    u = optional_json(spark, path, S.USERS, lines).filter(F.col("schema_version") == version).select(F.explode("users").alias("u"))
    return u.select(F.col("u.user_id").alias("person_id"), F.concat_ws(" ", "u.first_name", "u.last_name").alias("name"), F.col("u.year_of_birth").alias("birth_year"), F.col("u.nationality").alias("nationality"), F.col("u.is_verified").alias("verified"), F.col("u.active_memberships").alias("memberships")).filter("person_id is not null")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """person_id, event_id, decision of a nested map {person: {event: true | null | "error"}}."""
    if not exists(spark, path):
        return spark.createDataFrame([], S.LEDGER)
    text = spark.read.text(path, wholetext=True)
    m = text.select(F.from_json("value", "map<string,map<string,string>>").alias("m")).select(F.explode("m").alias("p", "e")).select("p", F.explode("e").alias("event", "decision"))
    return m.select(F.col("p").cast("long").alias("person_id"), F.col("event").cast("long").alias("event_id"), F.coalesce("decision", F.lit("null")).alias("decision"))


def pages(spark: SparkSession, fetch: Callable[[int], dict], schema: str, key: str = "id", rows: str = "data", last: str = "lastPage") -> DataFrame:
    """A paginated scan: fetch(page) until its last page; the last row of a key wins. The driver only walks the pages."""
    found: list[tuple[int, dict]] = []
    page = 1
    while True:
        body = fetch(page)
        found += [(page * 1_000_000 + i, r) for i, r in enumerate(body.get(rows, []))]
        if page >= int(body.get(last, page)):
            break
        page += 1
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    df = spark.createDataFrame([(n, *[r.get(c) for c in names]) for n, r in found], f"_pos long, {schema}")
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_pos").desc()))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n", "_pos")


def stored_pages(spark: SparkSession, path: str, schema: str, page: str = "page", at: str = "at", last: str = "last_page") -> DataFrame:
    """A paginated scan, a row a line: its rows with pos, their place in the scan.

    Rows lie in folders `page=N`, or say their page themselves; then many pages share a file, and the
    driver has not to list as many folders as there are pages.
    Every row says which page is the last; a scan that lacks a page, or says two things, is refused.
    A row that moved on while pages were fetched stands on two; `dedup.merged_snapshot` takes the
    later one's values at the earlier one's place.
    """
    rows = spark.read.schema(f"{schema}, {at} int, {last} int, {page} int").json(path)
    seen = rows.agg(F.count_distinct(page).alias("pages"), F.min(page).alias("first"), F.max(last).alias("last"), F.min(last).alias("least")).first()
    if seen["pages"] and not (seen["first"] == 1 and seen["pages"] == seen["last"] == seen["least"]):
        raise ValueError(f"{seen['pages']} pages of {seen['last']}")
    return rows.withColumn("pos", F.col(page).cast("long") * (1 << 32) + F.col(at)).drop(page, at, last)


def live_results(rows: DataFrame) -> DataFrame:
    """Live timing rows (class, name, club, place, centiseconds, code) with seconds and status."""
    return rows.withColumn("time_s", F.when(F.col("code") == 0, F.floor(F.col("centiseconds") / 100).cast("int"))).withColumn("status", live_status("code")).withColumn("rank", F.when(F.col("code") == 0, F.col("place").try_cast("int")))


def timing_snapshot(rows: DataFrame) -> DataFrame:
    """Timing-centre rows (name_year, kilometres, seconds, state) as normalized columns; metres are rounded."""
    from ..functions.numbers import name_and_year

    n = name_and_year("name_year")
    return rows.select("*", n["name"].alias("name"), n["year"].alias("birth_year"), F.round(F.col("kilometres") * 1000).cast("int").alias("course_length_m"), normalized_status("state")["status"].alias("status")).drop("name_year")


def checked_transcripts(transcripts: DataFrame, files: DataFrame) -> DataFrame:
    """Transcripts with refused: why one isn't of its file (path, content) byte for byte, or not whole; null where it is."""
    f = files.select(F.col("path").alias("_path"), F.sha2("content", 256).alias("_sha"))
    t = transcripts.join(f, F.col("path") == F.col("_path"), "left")
    why = F.when(F.col("_sha").isNull(), "no source").when(~F.col("_sha").eqNullSafe(F.col("source_sha256")), "other source").when(~F.col("declared").eqNullSafe(F.col("n_rows")), "other count")
    return t.withColumn("refused", why).drop("_path", "_sha")


def locked_transcripts(transcripts: DataFrame, files: DataFrame) -> DataFrame:
    """Transcripts that are all of their files and whole; one that isn't is an error, not a gap."""
    t = checked_transcripts(transcripts, files)
    said = F.raise_error(F.concat(F.lit("transcript does not match its source: "), F.col("path"), F.lit(", "), F.col("refused")))
    return t.withColumn("verified", F.when(F.col("refused").isNull(), True).otherwise(said.cast("boolean"))).drop("refused")


def club_dictionary(*names: DataFrame) -> DataFrame:
    """Every club name seen anywhere that has three characters and two letters in a row."""
    every = reduce(DataFrame.union, [n.select(F.trim(n.columns[0]).alias("club")) for n in names]).distinct()
    return every.filter((F.length("club") >= 3) & F.col("club").rlike(r"(?U)\p{L}{2}"))


def refused_omissions(rows: DataFrame) -> DataFrame:
    """event_id, category, entry_id, refused: entries that stand twice, or with another status than `dns`."""
    n = rows.groupBy("event_id", "category", "entry_id").agg(F.count("*").alias("n"), F.count_if(~F.col("status").eqNullSafe("dns")).alias("other"))
    return n.filter("n > 1 OR other > 0").select("event_id", "category", "entry_id", F.when(F.col("n") > 1, "twice").otherwise("no non-starter").alias("refused"))


def omission_recovery(rows: DataFrame) -> DataFrame:
    """Reviewed non-starters by event and class; anything else than `dns`, or an entry twice, is an error."""
    if refused_omissions(rows).limit(1).count():
        raise ValueError("a recovery holds an entry twice, or one that is no non-starter")
    return rows.groupBy("event_id", "category").agg(F.sort_array(F.collect_list(F.struct("entry_id", "name", "club"))).alias("results"))


def exclusions(rows: Iterable[tuple[int, str]], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(rows), "event_id long, reason string")
