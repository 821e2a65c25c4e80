"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte positions. Every adjacent pair that has a rank lies in that
rank's bucket; a bitmap of three levels, 64 ways each, says which buckets hold anything, and
find-first-set on the three words gives the lowest rank. A merge relinks the list and queues at
most two new pairs; entries whose pair has changed since are stale and skipped when they surface.
So a pre-token of n bytes costs O(n log n), however long it is.

Pre-tokens repeat, so a worker keeps those it has encoded, up to `CACHE` of them.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, held, id_text

#: Pre-tokens a worker remembers (about 200 bytes each).
CACHE = 1_000_000
#: Longer pre-tokens are encoded but not remembered.
CACHED_LENGTH = 64
CHUNK_BYTES = 4 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: lowest rank first, leftmost first among equals."""
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 1))  # a node is the bytes from its position to its end
    left = list(range(-1, n - 1))
    ids = [ranks[piece[i : i + 1]] for i in range(n)]
    pair = [-1] * n  # the rank of the pair that starts at a node; -1: none, or the node is gone
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    middle: dict[int, int] = {}
    top = 0
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            pair[i] = r
            if r in buckets:
                buckets[r].append(i)  # ascending, so the list is a heap
            else:
                buckets[r] = [i]
                low[r >> 6] = low.get(r >> 6, 0) | 1 << (r & 63)
                middle[r >> 12] = middle.get(r >> 12, 0) | 1 << (r >> 6 & 63)
                top |= 1 << (r >> 12)
    while top:
        a = (top & -top).bit_length() - 1
        m = middle[a]
        b = a << 6 | (m & -m).bit_length() - 1
        w = low[b]
        r = b << 6 | (w & -w).bit_length() - 1
        bucket = buckets[r]
        i = heappop(bucket)
        if not bucket:
            del buckets[r]
            w &= w - 1
            low[b] = w
            if not w:
                m &= m - 1
                middle[a] = m
                if not m:
                    top &= top - 1
        if pair[i] != r:
            continue
        j = end[i]
        after = end[j]
        end[i] = after
        ids[i] = r
        pair[j] = -1
        ids[j] = -1
        changed = []
        if after < n:
            left[after] = i
            changed.append((i, i, end[after]))
        else:
            pair[i] = -1
        before = left[i]
        if before >= 0:
            changed.append((before, before, after))
        for node, start, stop in changed:
            r = get(piece[start:stop])
            if r is None:
                pair[node] = -1
                continue
            pair[node] = r
            if r in buckets:
                heappush(buckets[r], node)
            else:
                buckets[r] = [node]
                low[r >> 6] = low.get(r >> 6, 0) | 1 << (r & 63)
                middle[r >> 12] = middle.get(r >> 12, 0) | 1 << (r >> 6 & 63)
                top |= 1 << (r >> 12)
    return [x for x in ids if x >= 0]


class Encoder(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__()
        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.table = [b""] * size
        for token, rank in self.ranks.items():
            self.table[rank] = token

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        out = np.array([whole] if whole is not None else merge(raw, self.ranks), "<u4").tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join([self[piece] for piece in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encoder(path: str, pattern: str) -> Encoder:
    return held(("byte_bpe", path, pattern), lambda: Encoder(path, pattern))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary, unsigned 32-bit little-endian) and n_tokens of every row.

    Texts are encoded whole and without special tokens. A null or empty text has no ids; a null
    doc_id stays null; repeated rows repeat; other columns of docs are not read.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in chunks(batches, CHUNK_BYTES):
            ids = [own.encode(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the bytes (binary) that its ids stand for."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in chunks(batches, CHUNK_BYTES, "ids"):
            raw = [own.decode(ids or b"") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, and decoded from the ids, in one pass."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in chunks(batches, CHUNK_BYTES):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = own.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
