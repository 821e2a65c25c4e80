"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark in three shuffles of packed arrays. The vocabulary comes first: sorted
64-bit hashes of all words, cut into buckets by range, so that a word's id is its place. Then the
bigrams, counted as pairs of ids and dealt to buckets by a hash of the pair, so that no context is
too common for one task. Each bucket's sorted array gives counts of counts, and for every context
and every word the partial sums that smoothing needs; those meet in the bucket of their word.

The arrays are files in the shared folder. Workers map them into memory and search them for the
sorted distinct words and pairs of a chunk of texts, so scoring shuffles nothing.

A text is its words, lower-cased in A-Z, and an end; the first token's context is the beginning.
Probabilities sum to one over the vocabulary and one unknown word.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_text, mapped, new_dir, open_shared, staged, text_bytes, to_partitions, write_shared
from .substring import mixed, word_bounds, word_hashes

END = np.uint64(0xE0D0E0D0E0D0E0D1)
BEGIN = 0xFFFFFFFF  # as a context's id
#: Distinct words that ids of 32 bits can tell apart, beside BEGIN; `train` refuses more.
MOST_TYPES = 0xFFFFFFFF
CHUNK_BYTES = 4 << 20
HOLD = 3_000_000
#: What a word has as a context (tokens after it; distinct words seen once, twice, more) and as a word (distinct words before it).
RECORD = np.dtype([("after", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"), ("before", "<u4")])
#: Discounts where the counts of counts give none.
FALLBACK = (0.5, 1.0, 1.5)


def planes(x: np.ndarray) -> bytes:
    """Array as its bytes of like rank together, compressed."""
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return zstandard.ZstdCompressor(level=1).compress(len(x).to_bytes(8, "little") + raw)


def unplaned(data: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw, np.uint8, offset=8).reshape(size, n).T.reshape(-1).copy().view(dtype) if n else np.zeros(0, dtype)


def packed_sorted(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, "<u8"), dtype=np.uint64)


def by_range(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def merged(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(count, new)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a chunk, and where each text's begin (and the end)."""
    offsets, data = text_bytes(batch.column("text"))
    n = len(offsets) - 1
    held = np.full(len(data) + n, 32, np.uint8)
    held[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    upper = (held >= 65) & (held <= 90)
    held[upper] += 32
    start, end = word_bounds(held)
    first = np.searchsorted(start, offsets + np.arange(n + 1))
    out = np.full(len(start) + n, END, np.uint64)
    text = np.repeat(np.arange(n), np.diff(first))
    if len(start):
        out[np.arange(len(start)) + text] = word_hashes(held, start, end)
    return out, first + np.arange(n + 1)


def _blobs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 1024):
        bucket, blob, count = zip(*rows[i : i + 1024], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(blob, pa.binary()), pa.array(count, pa.binary())], ["bucket", "keys", "counts"])


BLOBS = "bucket long, keys binary, counts binary"


def _dealt(key: np.ndarray, count: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    if not len(key):
        return []
    order = np.argsort(bucket, kind="stable")
    key, count, bucket = key[order], count[order], bucket[order]
    new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    end = np.append(new[1:], len(key))
    return [(int(bucket[a]), packed_sorted(key[a:b]), planes(count[a:b].astype("<u8"))) for a, b in zip(new.tolist(), end.tolist(), strict=True)]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by bucket, a bucket at a time."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != current:
                if rows:
                    yield current, rows
                current, rows = row["bucket"], []
            rows.append(row)
    if rows:
        yield current, rows


class Counter_:
    """Adds up keys and counts, merging when it holds many."""

    def __init__(self):
        self.keys, self.counts, self.n = [], [], 0

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(count)
        self.n += len(key)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = merged(np.concatenate(self.keys), np.concatenate(self.counts)) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.__init__()
        return out


class Vocabulary:
    """The word arrays of a model folder, mapped."""

    def __init__(self, folder: str, sizes: list[int]):
        self.buckets = len(sizes)
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.folder, self.sizes = folder, sizes
        self.arrays: dict[tuple[str, int], np.ndarray] = {}

    def array(self, name: str, bucket: int, dtype) -> np.ndarray:
        key = (name, bucket)
        if key not in self.arrays:
            self.arrays[key] = mapped(f"{self.folder}/{name}-{bucket:06d}.bin", dtype)
        return self.arrays[key]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct hashes: whether each is known, and its id."""
        bucket = by_range(h, self.buckets)
        known, ids = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        for b in np.unique(bucket).tolist():
            a, e = np.searchsorted(bucket, [b, b + 1])
            own = self.array("words", b, "<u8") if self.sizes[b] else np.zeros(0, np.uint64)
            if len(own):
                at = np.minimum(np.searchsorted(own, h[a:e]), len(own) - 1)
                known[a:e] = own[at] == h[a:e]
                ids[a:e] = at + self.base[b]
        return known, ids

    def gather(self, name: str, dtype, ids: np.ndarray) -> np.ndarray:
        """Values of sorted ids."""
        out = np.zeros(len(ids), dtype)
        bucket = np.searchsorted(self.base, ids, "right") - 1
        for b in np.unique(bucket).tolist():
            a, e = np.searchsorted(bucket, [b, b + 1])
            out[a:e] = self.array(name, b, dtype)[ids[a:e] - self.base[b]]
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(folder: str, sizes: tuple[int, ...]) -> Vocabulary:
    return Vocabulary(folder, list(sizes))


def _keys(h: np.ndarray, first: np.ndarray, own: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """uniq, inverse, known and ids of the chunk's distinct words, and each token's key (context id, word id)."""
    uniq, inverse = np.unique(h, return_inverse=True)
    known, ids = own.find(uniq)
    word = ids[inverse].astype(np.uint64)
    context = np.empty(len(h), np.uint64)
    context[1:] = word[:-1]
    context[first[:-1]] = BEGIN
    return uniq, inverse, known, ids, context << np.uint64(32) | word


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of things counted once, twice, three and four times."""
    if min(n) <= 0:
        return FALLBACK
    y = n[0] / (n[0] + 2 * n[1])
    d = tuple((k + 1) - (k + 2) * y * n[k + 1] / n[k] for k in range(3))
    return d if all(0 < x <= k + 1 for k, x in enumerate(d)) else FALLBACK


def train(docs: DataFrame, folder: str | None = None) -> dict:
    """Count docs (doc_id, text) into a model folder; returns what a scorer needs to open it.

    A null or empty text is its end alone; repeated rows count as often as they come; an empty
    table gives a model that knows no word; other columns of docs are not read. Counts have 64
    bits. Over MOST_TYPES distinct words are refused, as ids of 32 bits could not tell them apart.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "kneser-ney")
    buckets = to_partitions(spark)
    texts = id_text(docs)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter_()
        for batch in chunks(batches, CHUNK_BYTES):
            h, _ = tokens(batch)
            held.add(*np.unique(h, return_counts=True))
            if held.n > HOLD:
                key, count = held.take()
                if len(key) > HOLD // 2:
                    yield from _blobs(_dealt(key, count, by_range(key, buckets)))
                else:
                    held.add(key, count)
        key, count = held.take()
        yield from _blobs(_dealt(key, count, by_range(key, buckets)))

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            key, count = merged(np.concatenate([unpacked_sorted(r["keys"]) for r in rows]), np.concatenate([unplaned(r["counts"], "<u8") for r in rows]).astype(np.int64))
            write_shared(f"{folder}/words-{bucket:06d}.bin", [key.astype("<u8").tobytes()])
            write_shared(f"{folder}/counts-{bucket:06d}.bin", [count.astype("<u8").tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([len(key)]), pa.array([int(count.sum())])], ["bucket", "types", "total"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    sizes, total = [0] * buckets, 0
    for r in staged(dealt(texts.mapInArrow(words, BLOBS)).mapInArrow(merge_words, "bucket long, types long, total long"), "kn-words").collect():
        sizes[r["bucket"]] = r["types"]
        total += r["total"]
    if sum(sizes) > MOST_TYPES:
        raise ValueError(f"{sum(sizes)} distinct words are more than the {MOST_TYPES} that ids of 32 bits tell apart")
    model = {"folder": folder, "sizes": sizes, "tokens": total, "types": sum(sizes), "buckets": buckets}
    size_key = tuple(sizes)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = vocabulary(folder, size_key), Counter_()

        def out() -> Iterator[pa.RecordBatch]:
            key, count = held.take()
            yield from _blobs(_dealt(key, count, (mixed(key) % np.uint64(buckets)).astype(np.int64)))

        for batch in chunks(batches, CHUNK_BYTES):
            *_, key = _keys(*tokens(batch), own)
            held.add(*np.unique(key, return_counts=True))
            if held.n > HOLD:
                yield from out()
        yield from out()

    def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.concatenate([[0], np.cumsum(size_key)])
        for bucket, rows in _by_bucket(batches):
            key, count = merged(np.concatenate([unpacked_sorted(r["keys"]) for r in rows]), np.concatenate([unplaned(r["counts"], "<u8") for r in rows]).astype(np.int64))
            write_shared(f"{folder}/pairs-{bucket:06d}.bin", [key.astype("<u8").tobytes()])
            write_shared(f"{folder}/pair_counts-{bucket:06d}.bin", [count.astype("<u8").tobytes()])
            once = [int((count == k).sum()) for k in range(1, 5)]
            context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            # a record for each context and word of this bucket, to the range that holds it
            ids, inverse = np.unique(np.concatenate([context, word]), return_inverse=True)
            own = np.zeros(len(ids), RECORD)
            c, w = inverse[: len(context)], inverse[len(context) :]
            own["after"] = np.bincount(c, count, len(ids)).astype(np.uint64)
            for name, which in (("n1", count == 1), ("n2", count == 2), ("n3", count > 2)):
                own[name] = np.bincount(c[which], minlength=len(ids))
            own["before"] = np.bincount(w, minlength=len(ids))
            where = np.where(ids == BEGIN, buckets, np.searchsorted(base, ids, "right") - 1)
            out = []
            for r in np.unique(where).tolist():
                a, e = np.searchsorted(where, [r, r + 1])
                parts = [planes(np.ascontiguousarray(own[n][a:e])) for n in RECORD.names]
                out.append((r, packed_sorted(ids[a:e].astype("<u8")), json.dumps([len(p) for p in parts]).encode() + b"\n" + b"".join(parts), once if not out else [0] * 4))
            for i in range(0, len(out), 256):
                columns = list(zip(*out[i : i + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.int64()))], ["bucket", "keys", "counts", "once"])

    def merge_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.concatenate([[0], np.cumsum(size_key)])
        for bucket, rows in _by_bucket(batches):
            own = np.zeros(1 if bucket == buckets else size_key[bucket], RECORD)
            for r in rows:
                at = np.zeros(1, np.int64) if bucket == buckets else unpacked_sorted(r["keys"]).astype(np.int64) - base[bucket]
                sizes, _, raw = r["counts"].partition(b"\n")
                i = 0
                for name, size in zip(RECORD.names, json.loads(sizes), strict=True):
                    own[name][at] += unplaned(raw[i : i + size], RECORD[name])
                    i += size
            write_shared(f"{folder}/records-{bucket:06d}.bin", [own.tobytes()])
            before = own["before"]
            yield pa.RecordBatch.from_arrays([pa.array([[int((before == k).sum()) for k in range(1, 5)]], pa.list_(pa.int64())), pa.array([int((before > 2).sum())]), pa.array([int(before.sum())])], ["once", "many", "kinds"])

    rows = staged(dealt(texts.mapInArrow(pairs, BLOBS)).mapInArrow(merge_pairs, BLOBS + ", once array<long>"), "kn-pairs")
    sums = lambda df: [df.agg(*[F.sum(F.col("once")[k]).alias(f"s{k}") for k in range(4)]).first()[k] or 0 for k in range(4)]
    model["pair_discounts"] = discounts(sums(rows))
    records = staged(dealt(rows.select("bucket", "keys", "counts")).mapInArrow(merge_records, "once array<long>, many long, kinds long"), "kn-records")
    seen = sums(records)
    extra = records.agg(F.sum("many").alias("many"), F.sum("kinds").alias("kinds")).first()
    d = discounts(seen)
    kinds = extra["kinds"] or 0
    model |= {"word_discounts": d, "kinds": kinds, "left": (d[0] * seen[0] + d[1] * seen[1] + d[2] * (extra["many"] or 0)) / kinds if kinds else 1.0}
    return model


class Scorer:
    def __init__(self, model: dict):
        self.m = model
        self.words = vocabulary(model["folder"], tuple(model["sizes"]))
        begin = mapped(f"{model['folder']}/records-{model['buckets']:06d}.bin", RECORD) if model["tokens"] else np.zeros(1, RECORD)
        self.begin = np.array(begin)
        self.d1, self.d2, self.d3 = model["pair_discounts"]
        self.arrays: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def pair_counts(self, key: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys (0: not seen)."""
        m = self.m
        bucket = (mixed(key) % np.uint64(m["buckets"])).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, bucket = key[order], bucket[order]
        got = np.zeros(len(key), np.int64)
        for b in np.unique(bucket).tolist():
            a, e = np.searchsorted(bucket, [b, b + 1])
            if b not in self.arrays:
                try:
                    self.arrays[b] = mapped(f"{m['folder']}/pairs-{b:06d}.bin", "<u8"), mapped(f"{m['folder']}/pair_counts-{b:06d}.bin", "<u8")
                except FileNotFoundError:  # no pair fell into this bucket
                    self.arrays[b] = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            own, counts = self.arrays[b]
            if len(own):
                at = np.minimum(np.searchsorted(own, key[a:e]), len(own) - 1)
                got[a:e] = np.where(own[at] == key[a:e], counts[at], 0)
        out = np.empty(len(key), np.int64)
        out[order] = got
        return out

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """tokens, known tokens, base score and model score of each text."""
        m = self.m
        h, first = tokens(batch)
        uniq, inverse, known, ids, key = _keys(h, first, self.words)
        own = np.zeros(len(uniq), RECORD)
        count = np.zeros(len(uniq), np.int64)
        own[known] = self.words.gather("records", RECORD, ids[known])
        count[known] = self.words.gather("counts", "<u8", ids[known])
        base = np.log10((count + 1) / (m["tokens"] + m["types"] + 1))
        # words alone: distinct contexts before them, discounted, and a uniform rest
        d = m["word_discounts"]
        before = own["before"].astype(np.int64)
        alone = (before - np.where(before == 0, 0, np.where(before == 1, d[0], np.where(before == 2, d[1], d[2])))) / max(m["kinds"], 1)
        alone = alone + m["left"] / (m["types"] + 1)
        after = own["after"].astype(np.float64)
        share = np.divide(self.d1 * own["n1"] + self.d2 * own["n2"] + self.d3 * own["n3"], after, out=np.ones(len(own)), where=after > 0)
        b = self.begin[0]
        b_share = (self.d1 * b["n1"] + self.d2 * b["n2"] + self.d3 * b["n3"]) / float(b["after"]) if b["after"] else 1.0
        starts = np.zeros(len(h), bool)
        starts[first[:-1]] = True
        before_at = np.empty(len(h), np.int64)
        before_at[1:] = inverse[:-1]
        before_at[0] = 0
        total = np.where(starts, float(b["after"]), after[before_at])
        rest = np.where(starts, b_share, share[before_at])
        live = known[inverse] & (starts | known[before_at])
        pair, at = np.unique(key[live], return_inverse=True)
        c = np.zeros(len(h))
        c[live] = self.pair_counts(pair)[at]
        c -= np.where(c == 0, 0, np.where(c == 1, self.d1, np.where(c == 2, self.d2, self.d3)))
        p = np.divide(c, total, out=np.zeros(len(h)), where=total > 0) + rest * alone[inverse]
        add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  no text is without tokens
        return np.diff(first), add(known[inverse].astype(np.int64)), add(base[inverse]), add(np.log10(p))


@functools.lru_cache(maxsize=1)
def scorer(model: str) -> Scorer:
    return Scorer(json.loads(model))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity of every row.

    A null or empty text is its end alone. Repeated rows get equal scores; an empty table gives no
    rows; other columns of docs are not read. A model of no texts gives every token 1 / 1.
    """
    where = f"{model['folder']}/model.json"
    write_shared(where, [json.dumps(model).encode()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_shared(where, "rb") as f:
            own = scorer(bytes(f.read()).decode())
        for batch in chunks(batches, CHUNK_BYTES):
            n, known, base, score = own.score(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = lambda i: F.coalesce(F.pmod(F.crc32(i.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
