"""Tables that must be told apart and brought back: digests in order, and versions in a commit log."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut
from .ordering import numbered

#: Rows, and then digests, of a node of the hash tree.
FAN = 1024


def ordered_fingerprint(df: DataFrame, order: list[Column], row: Column | None = None, fan: int = FAN, levels: int | None = None) -> str:
    """A digest of a table's rows in a canonical order, whatever order and partitions they come in.

    Rows are numbered by ranges (each range is sorted in a task of its own), every `fan` of them give
    a digest of their texts in order, every `fan` digests one more, until one is left: no task holds
    more than `fan` texts at once, and the driver holds the last digest. row is the text of a row,
    its JSON in the order of column names by default; rows that the order doesn't tell apart are
    ordered by it. An empty table has the digest of nothing.

    Given a number of levels the tree ends there, and where digests are left then, the least of them
    counts, which does not stand for the rows of the others: with two levels, that is so beyond
    fan * fan rows. No query asks for it; left open, every row counts.
    """
    text = row if row is not None else F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    rows = df.withColumn("_text", text)
    level = numbered(rows, [*order, F.col("_text").asc()], "_no").select((F.col("_no") - 1).alias("no"), F.col("_text").alias("text"))
    node, at = F.expr(f"no div {fan}"), 0
    while True:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"])
        level, at = level.groupBy(node.alias("no")).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("text")), at + 1
        found = level.agg(F.count("*").alias("n"), F.min("text").alias("least")).first()
        if found["n"] <= 1 or at == levels:
            return found["least"] or _EMPTY
        level = cut(level, "digests")


_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


class Conflict(ValueError):
    """A version that may not be written: rows would be lost, or another writer was first."""


class Versions:
    """Versions of a table that only grows, in a commit log.

    A version is a small commit file `log/N.json` that names a data folder, which is written whole
    before; the file is created only if no other writer has it, so readers see a version whole or
    not at all, and a lost writer leaves data that no commit names. Restoring is a commit that names
    an old folder: nothing is copied, and no version is ever changed.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> list[dict]:
        """Commits from the first to the last: version, data, rows, fingerprint, reason."""
        found = self._fs.globStatus(self._path(f"{self.root}/log/*.json")) or []
        out = []
        for f in found:
            stream = self._fs.open(f.getPath())
            raw = bytes(stream.readAllBytes())
            stream.close()
            if raw.endswith(b"}"):  # a writer that was lost while committing left no version
                out.append(json.loads(raw))
        return sorted(out, key=lambda c: c["version"])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the last one by default; None before the first."""
        log = self.log()
        if version is not None:
            log = [c for c in log if c["version"] == version]
            if not log:
                raise ValueError(f"no version {version}")
        return self.spark.read.parquet(log[-1]["data"]) if log else None

    def write(self, df: DataFrame, reason: str = "update") -> int:
        """The number of the new version, or of the present one if its rows are the same; Conflict if a key would be lost."""
        log = self.log()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        new = self.spark.read.schema(df.schema).parquet(folder)
        fingerprint, rows = self._fingerprint(new), new.count()
        if log:
            if log[-1]["fingerprint"] == fingerprint:
                self._drop(folder)
                return log[-1]["version"]
            if self.read().join(new.select(*self.keys), self.keys, "left_anti").limit(1).count():
                self._drop(folder)
                raise Conflict("the table would shrink: rows of its last version would be lost")
        return self._commit(log, folder, rows, fingerprint, reason)

    def restore(self, version: int) -> int:
        """An old version as the newest one; later ones stay in the log."""
        log = self.log()
        old = next((c for c in log if c["version"] == version), None)
        if old is None:
            raise ValueError(f"no version {version}")
        return self._commit(log, old["data"], old["rows"], old["fingerprint"], f"restore {version}")

    def _fingerprint(self, df: DataFrame) -> str:
        return ordered_fingerprint(df, [F.col(k).asc_nulls_first() for k in self.keys])

    def _commit(self, log: list[dict], data: str, rows: int, fingerprint: str, reason: str) -> int:
        version = (log[-1]["version"] if log else 0) + 1
        body = json.dumps({"version": version, "data": data, "rows": rows, "fingerprint": fingerprint, "reason": reason})
        path = self._path(f"{self.root}/log/{version:08d}.json")
        try:
            stream = self._fs.create(path, False)
        except Exception as e:
            raise Conflict(f"version {version} is another writer's") from e
        stream.write(bytearray(body.encode()))
        stream.close()
        return version

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)


def merged_version(versions: Versions, fetched: DataFrame, key: str, pos: str) -> int:
    """A scan merged into the last version and committed: known rows keep their order and take new values, new ones follow."""
    from .dedup import merged_snapshot

    before = versions.read()
    existing = before if before is not None else fetched.limit(0)
    return versions.write(merged_snapshot(existing, fetched, key, pos).select(*fetched.columns), "scan")
