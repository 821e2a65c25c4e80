"""Tables, documents and registers written so that a reader never sees half of them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import content_hash, hash_id


def table(df: DataFrame, path: str, by: list[str] | None = None, codec: str = "zstd") -> None:
    """A whole table; the commit protocol puts it in place when all tasks are done."""
    w = df.write.mode("overwrite").option("compression", codec)
    (w.partitionBy(*by) if by else w).parquet(path)


def partitions(df: DataFrame, path: str, by: str) -> None:
    """Only the partitions that df holds are replaced; a document that became empty loses its partition's rows."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.mode("overwrite").partitionBy(by).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def export(df: DataFrame, path: str) -> None:
    """One gzipped JSON file set for readers without Parquet; one task writes it, so for small tables."""
    df.coalesce(1).write.mode("overwrite").option("compression", "gzip").json(path)


def file_hashes(files: DataFrame) -> DataFrame:
    """path and SHA-256 of binary files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def normalized(df: DataFrame, path: str) -> None:
    """Documents as JSON, absent fields left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def json_file(spark: SparkSession, path: str, value) -> None:
    """A small JSON file in any folder that Spark reaches, replaced in one step: readers see the former file or the whole new one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    to = hadoop.Path(path)
    own = hadoop.Path(to.getParent(), f".{to.getName()}.{uuid.uuid4().hex}")
    system = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = system.create(own, False)
    stream.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    stream.close()
    options = gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(system.makeQualified(own), system.makeQualified(to), options)


def with_defaults(r: DataFrame) -> DataFrame:
    """Result rows as they are stored: negative durations are none, a rank is a classification where nothing else was read, states follow from what is known."""
    for c in ("time_s", "time_behind_s", "team_time_s"):
        if c in r.columns:
            r = r.withColumn(c, F.when(F.col(c) >= 0, F.col(c)))
    blank = F.col("observed_status").isNull() | F.col("observed_status").isin("", "unknown")
    r = r.withColumn("status", F.when((F.col("status") == "unknown") & F.col("rank").isNotNull() & blank, "ok").otherwise(F.col("status")))
    sure = F.coalesce("identity_confidence", F.lit(0.0))
    r = r.withColumn("identity_state", F.coalesce("identity_state", F.when(sure >= 1, "resolved").when(F.col("person_id").isNotNull(), "candidate").otherwise("unresolved")))
    tagged = F.col("championship").isNotNull()
    api = F.col("source") == "api"
    r = r.withColumn("eligibility", F.coalesce("eligibility", F.when(tagged, "eligible").otherwise("unknown")))
    r = r.withColumn("eligibility_basis", F.coalesce("eligibility_basis", F.when(tagged & api, "official_api_championship").when(tagged, "official_champion_annotation").otherwise("none")))
    return r.withColumn("championship_scope", F.when(tagged & api, "full_field").when(tagged, "winner_only").otherwise("inferred"))


def registered(docs: DataFrame, parser: str) -> DataFrame:
    """source_document rows: id, path, url, hashes of content and of the parser; the first of an id stays."""
    d = docs.select(hash_id("document", "path").alias("source_document_id"), "path", "source_url", content_hash("categories").alias("normalized_sha256"), F.sha2(F.lit(parser), 256).alias("parser_sha256"))
    return d.dropDuplicates(["source_document_id"])


def registered_api(events: DataFrame, files: DataFrame, parser: str) -> DataFrame:
    """source_document rows of API results, one an event: the address they come from, the snapshot and its hash.

    events: event_id, url. files: path, content; a snapshot is named by its event (`17.json`). An
    event without a snapshot isn't registered; of repeated ones the first path stays.
    """
    f = files.select(F.regexp_extract("path", r"(\d+)\.json$", 1).try_cast("long").alias("event_id"), "path", F.sha2("content", 256).alias("snapshot_sha256"))
    f = f.filter("event_id is not null").groupBy("event_id").agg(F.min(F.struct("path", "snapshot_sha256")).alias("f"))
    return events.dropDuplicates(["event_id"]).join(f, "event_id").select(
        F.concat(F.lit("api-results:"), F.col("event_id").cast("string")).alias("source_document_id"), "event_id", F.lit("api").alias("source_type"), F.col("url").alias("source_url"),
        F.element_at(F.split("f.path", "/"), -1).alias("file_name"), F.col("f.path").alias("snapshot_path"), "f.snapshot_sha256", F.sha2(F.lit(parser), 256).alias("parser_sha256"),
    )
