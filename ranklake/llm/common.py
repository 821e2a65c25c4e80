"""What the corpus operators share: table loading, the shared folder, Arrow chunks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than these: space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows with a null doc_id take this place in the order of documents (before all others).
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset a local master gets a folder of its own; any other master is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file:///tmp/ranklake-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path (not made yet) below the shared folder."""
    return f"{shared_dir(spark)}/ranklake/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table, or of columns of one, that nothing reads any longer."""
    kept = vars(df).get("staged_at")
    for folder in [kept] if kept else {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def open_shared(uri: str, mode: str):
    """A file of the shared folder, opened from any process of the cluster."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return open(parts.path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if "w" in mode else system.open_input_file(path)


def create_shared(uri: str):
    """A new file of the shared folder, opened for writing; its folder is made."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        os.makedirs(os.path.dirname(at.path), exist_ok=True)
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
    return open_shared(uri, "wb")


def move_shared(uri: str, to: str) -> None:
    """Give a file its place; one that is there already is replaced."""
    if urlparse(uri).scheme in ("", "file"):
        os.replace(urlparse(uri).path, urlparse(to).path)
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.move(path, fs.FileSystem.from_uri(to)[1])


def remove_shared(uri: str) -> None:
    if urlparse(uri).scheme in ("", "file"):
        os.remove(urlparse(uri).path)
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.delete_file(path)


def write_shared(uri: str, parts: list) -> None:
    """Write a file whole or not at all; a second attempt of the same task replaces it."""
    own = f"{uri}.{uuid.uuid4().hex}"
    with create_shared(own) as f:
        for part in parts:
            f.write(part)
    move_shared(own, uri)


def mapped(uri: str, dtype) -> np.ndarray:
    """A shared file as an array: memory-mapped where the folder is mounted, else read."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        if os.path.getsize(at.path) == 0:
            return np.zeros(0, dtype)
        return np.memmap(at.path, dtype=dtype, mode="r")
    with open_shared(uri, "rb") as f:
        return np.frombuffer(f.read(), dtype)


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """A name for each wanted one that no column of docs has, in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string (null: empty), whatever else the table holds."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, without copying (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    n = len(column)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about max_bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def ids_of(column: pa.Array) -> np.ndarray:
    """doc_ids as int64, nulls as NULL_ID."""
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy(zero_copy_only=False)


_HELD: dict = {}


def held(key, make):
    """A worker's large object (a tokenizer with its words, a scorer): one at a time, so that stages of
    other kinds, which reuse the worker, don't add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def to_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
