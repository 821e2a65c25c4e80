"""Incremental work: what to fetch, snapshots that only grow, decisions made once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import appended_index, merged_snapshot
from ..operators.history import Versions


def selected_jobs(jobs: DataFrame, manifest: DataFrame | None = None, event_id: int | None = None) -> DataFrame:
    """Jobs of one event, and of a delta manifest where there is one (event_id, position)."""
    out = jobs.filter(F.col("event_id") == event_id) if event_id is not None else jobs
    return out.join(manifest.select("event_id", "position").distinct(), ["event_id", "position"], "left_semi") if manifest is not None else out


def refreshed(existing: DataFrame, fetched: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    return merged_snapshot(existing, fetched, key, pos)


def index_additions(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    return appended_index(existing, fetched, "event_id", "url", "position")


class Ledger(Versions):
    """Decisions (person_id, event_id, decision) in versions that never shrink; an equal one is no write."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, ["person_id", "event_id"])

    def read(self, version: int | None = None) -> DataFrame:
        found = super().read(version)
        return self.spark.createDataFrame([], "person_id long, event_id long, decision string") if found is None else found

    def write(self, decisions: DataFrame, reason: str = "update") -> int:
        return super().write(decisions.select("person_id", "event_id", "decision"), reason)


def undecided(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pairs to decide: those never decided, and those that only met an error."""
    return candidates.join(ledger.filter("decision <> 'error'"), ["person_id", "event_id"], "left_anti")


def foreign_candidates(results: DataFrame, home: str = "AUT") -> DataFrame:
    return results.filter((F.col("nationality") != home) & F.col("championship").isNotNull()).select("person_id", "event_id").distinct()


def is_fresh(snapshot: DataFrame, at: str, now: str, hours: int) -> bool:
    r = snapshot.agg(F.max(F.to_timestamp(at)).alias("t")).select((F.to_timestamp(F.lit(now)) - F.col("t") < F.expr(f"INTERVAL {hours} HOURS")).alias("fresh")).first()
    return bool(r and r["fresh"])


def with_freshness(snapshots: DataFrame, at: str, now: str, hours: int) -> DataFrame:
    """snapshots with fresh: whether each was fetched within so many hours of now; one never fetched isn't."""
    return snapshots.withColumn("fresh", F.coalesce(F.to_timestamp(F.lit(now)) - F.to_timestamp(at) < F.expr(f"INTERVAL {hours} HOURS"), F.lit(False)))


def follow(source: DataFrame, apply: Callable[[DataFrame], DataFrame], target: str, keys: list[str], checkpoint: str):
    """A stream of new files: each batch is applied and written once, by its number, however often it is tried."""

    def write(batch: DataFrame, number: int) -> None:
        apply(batch).dropDuplicates(keys).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def orchestrated(spark: SparkSession, steps: list[tuple[str, Callable[[SparkSession], DataFrame]]], target: str) -> dict[str, int]:
    """Steps in order, each written before the next; returns their row counts."""
    out = {}
    for name, step in steps:
        step(spark).write.mode("overwrite").parquet(f"{target}/{name}")
        out[name] = spark.read.parquet(f"{target}/{name}").count()
    return out
