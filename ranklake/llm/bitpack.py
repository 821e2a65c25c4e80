"""Token ids in bit-packed files: every id takes the fewest bits that hold the vocabulary.

A shard is a file of blocks. A block holds BLOCK ids (the last one fewer), starts at a byte
boundary and is packed low bit first, so that a run of ids is unpacked by numpy in one go and any
id is found from its number. Behind the blocks lies an index: the byte offset of every block, and
each document's id and first id; the file ends with the index's place. Shards follow each other in
the order of doc_id, and so does their table of first ids.

layout: blocks | index | index offset (8 bytes) | magic
index: bits, ids, documents, blocks, block size (8 bytes each) | block offsets | doc_ids | first ids and the end
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, create_shared, held, id_text, move_shared, new_dir, open_shared, staged, to_partitions

BLOCK = 1 << 14
MAGIC = b"RLIDS01\n"
END_ID = 1
#: Words a worker remembers (about 190 bytes each).
CACHE = 1_500_000
#: A mark that ends a word is a pre-token of its own wherever a letter stands before it.
LAST_MARK = re.compile(rb"([a-z])([,.])(?=[ \t\n\x0b\x0c\r]|\Z)")
CHUNK_BYTES = 2 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(ids: np.ndarray, bits: int) -> bytes:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, -(-n * bits // 8))
    out = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = raw.reshape(n, bits // 8)
    else:
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = np.unpackbits(raw, bitorder="little")[: n * bits].reshape(n, bits)
        out = np.packbits(wide, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


class Writer:
    """Writes a shard block by block under a name of its own; close() gives it its place."""

    def __init__(self, uri: str, bits: int):
        self.uri, self.bits = uri, bits
        self.own = f"{uri}.{uuid.uuid4().hex}"
        self.file = create_shared(self.own)
        self.held: list[np.ndarray] = []
        self.waiting = self.n = self.at = 0
        self.offsets: list[int] = []
        self.docs: list[int] = []
        self.starts: list[int] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.starts.append(self.n)
        self.n += len(ids)
        self.waiting += len(ids)
        self.held.append(ids)
        if self.waiting >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        keep = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, keep, BLOCK):
            block = pack(ids[i : min(i + BLOCK, keep)], self.bits)
            self.offsets.append(self.at)
            self.file.write(block)
            self.at += len(block)
        self.held, self.waiting = [ids[keep:]], len(ids) - keep

    def close(self) -> None:
        self._flush(True)
        head = np.array([self.bits, self.n, len(self.docs), len(self.offsets), BLOCK], "<i8")
        for part in (head, np.array(self.offsets, "<i8"), np.array(self.docs, "<i8"), np.array([*self.starts, self.n], "<i8"), np.array([self.at], "<i8")):
            self.file.write(part.tobytes())
        self.file.write(MAGIC)
        self.file.close()
        move_shared(self.own, self.uri)


class Reader:
    def __init__(self, uri: str):
        self.file = open_shared(uri, "rb")
        size = self.file.seek(0, io.SEEK_END) or self.file.tell()
        self.file.seek(size - 16)
        tail = self.file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a whole shard")
        at = int(np.frombuffer(tail, "<i8", 1)[0])
        self.file.seek(at)
        index = np.frombuffer(self.file.read(size - 16 - at), "<i8")
        self.bits, self.n, docs, blocks, self.block = map(int, index[:5])
        self.offsets = index[5 : 5 + blocks]
        self.docs = index[5 + blocks : 5 + blocks + docs]
        self.starts = index[5 + blocks + docs :]

    def ids(self, start: int, count: int) -> np.ndarray:
        """`count` ids from number `start` of the shard on, reading only their blocks."""
        if count <= 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + count - 1) // self.block
        self.file.seek(int(self.offsets[first]))
        n = min((last + 1) * self.block, self.n) - first * self.block
        each = self.block * self.bits  # blocks are whole bytes, as the block size is a multiple of 8
        data = self.file.read((last - first) * each // 8 + -(-(n - (last - first) * self.block) * self.bits // 8))
        return unpack(data, self.bits, n)[start - first * self.block :][:count]


class Encoder(dict):
    """Word (bytes without ASCII white space) to its ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins what it parts, so a text's ids are its words'.
    It lower-cases; doing that for A-Z beforehand, and parting a comma or stop from the letter
    before it, leaves the ids as they are and far fewer distinct words to encode. Its added tokens
    (`<|endoftext|>` and the like, found in a text as the library finds them) are told by case, so
    a word that holds one in any case stays as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added)) or rb"(?!)", re.IGNORECASE)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(words)
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self[w] = np.array(e.ids, "<u4").tobytes()

    def split(self, raw: bytes) -> list[bytes]:
        if self.added.search(raw):
            return [p for w in raw.split() for p in ([w] if self.added.search(w) else LAST_MARK.sub(rb"\1 \2", w.lower()).split())]
        return LAST_MARK.sub(rb"\1 \2", raw.lower()).split()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t.encode()) for t in texts]
        self.learn({w for s in split for w in s})
        return [b"".join([self[w] for w in s]) for s in split]


def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("bitpack", path), lambda: Encoder(path))


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of docs in ascending doc_id order; returns shard, uri, first, n_ids, n_docs, a row a shard.

    Rows without a doc_id come first; rows that repeat a doc_id are all written, ordered by a hash
    of their text. A null or empty text is the end id alone. The driver sees one row a shard.
    """
    path = path or default_path()
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(to_partitions(spark), F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        own, writer = encoder(path), None
        uri = f"{folder}/ids-{shard:06d}.bin"
        for batch in chunks(batches, CHUNK_BYTES):
            writer = writer or Writer(uri, own.bits)
            ids = batch.column("doc_id").fill_null(NULL_ID).to_pylist()
            for doc, raw in zip(ids, own.encode(batch.column("text").to_pylist()), strict=True):
                writer.add(doc, np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([uri]), pa.array([writer.n], pa.int64()), pa.array([len(writer.docs)], pa.int64())], ["shard", "uri", "n_ids", "n_docs"])

    shards = staged(rows.select("doc_id", "text").mapInArrow(run, "shard long, uri string, n_ids long, n_docs long"), "ids-manifest")
    found = sorted(shards.collect(), key=lambda r: r["shard"])
    first, out = 0, []
    for r in found:
        out.append((r["shard"], r["uri"], first, r["n_ids"], r["n_docs"]))
        first += r["n_ids"]
    return spark.createDataFrame(out, "shard long, uri string, first long, n_ids long, n_docs long")


def read(shards: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids, if asked) of every document in the shards.

    Every row that was written comes back, repeated ones too, each with a start of its own; a null
    doc_id is null again, and a null or empty text is its end id. No shard gives no rows. Of shards
    only uri and first are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist(), strict=True):
                r = Reader(uri)
                i = 0
                while i < len(r.docs):
                    j = max(i + 1, int(np.searchsorted(r.starts, r.starts[i] + (1 << 20), "right")) - 1)
                    j = min(j, len(r.docs), i + 8192)
                    at = r.starts[i : j + 1]
                    raw = r.ids(int(at[0]), int(at[-1] - at[0])).tobytes()
                    parts = [raw[a:b] for a, b in zip(((at[:-1] - at[0]) * 4).tolist(), ((at[1:] - at[0]) * 4).tolist(), strict=True)]
                    doc = r.docs[i:j]
                    columns = [pa.array(doc, pa.int64(), mask=doc == NULL_ID), pa.array(at[:-1] + base, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())] if ids else columns, [*names, "ids"] if ids else names)
                    i = j

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    return shards.select("uri", "first").repartition(max(1, to_partitions(shards.sparkSession)), "uri").mapInArrow(run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_dir(spark, "ids")))
