"""Substring deduplication by super-k-mers of words.

A window is SPAN consecutive words of a text. Its minimiser is the smallest hash among its runs of
GRAM words; consecutive windows that share a minimiser travel as one packed string, the words from
the first window's start to the last one's end, to the bucket that the minimiser names. Windows of
equal words have equal minimisers and so meet in one bucket, where they are sorted and all but the
earliest are marked. The marks return as ranges by document.

Before they travel, equal packed strings of a task are reduced to the earliest: the others' windows
are all repeats, and go straight to the ranges. A minimiser that is still too common, which a first
pass counts, is split: its windows are packed one by one and dealt by their own hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, drop_staged, id_text, staged, text_bytes, to_partitions

SPAN = 20
GRAM = 4
CHUNK_BYTES = 1 << 19  # small, so that a chunk's arrays stay in the processor's cache
#: Packed bytes a task holds before it hands them on.
HOLD_BYTES = 48 << 20
#: A minimiser is split if more than this many of its packed strings lie in all tasks, once each task has dropped equal ones.
HOT = 5_000
#: No more minimisers than this (8 bytes each) are split, the most common ones. Others are then rarer than one packed string in so many.
MOST_HOT = 1_000_000
#: Minimisers (16 bytes each) that a task counts before it hands the counts on.
COUNTED = 2_000_000
#: Up to this many doc_ids that rows of different texts share are broadcast; beyond, every row carries its text's hash.
BROADCAST_IDS = 200_000
BUCKETS_PER_PARTITION = 8

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_r = np.random.default_rng(20240229)
BYTE = _r.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
GRAMS = _r.integers(1, 2**63, 64, np.uint64) | np.uint64(1)
del _r
_powers: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64, for i < n at least; grown as needed."""
    if n > len(_powers[0]):
        size = 1 << max(16, (n - 1).bit_length())
        for i, b in enumerate((BASE, INVERSE)):
            _powers[i] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in bytes that are separated by white space."""
    gap = np.concatenate([[True], SPACE[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def running_sum(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply(BYTE[data], powers(len(data) + 1)[0][: len(data)], out=total[1:])
    np.cumsum(total, out=total)
    return total


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word, from one running sum over all bytes."""
    total = running_sum(data) if total is None else total
    down = powers(len(data) + 1)[1]
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Super:
    """The super-k-mers of a chunk of texts: first word and last word (exclusive), windows, minimiser, text."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, span: int, gram: int):
        # a gap between texts, so that no word runs over
        n = len(offsets) - 1
        held = np.full(len(data) + n, 32, np.uint8)
        held[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
        offsets = offsets + np.arange(n + 1)
        self.data = held
        self.start, self.end = word_bounds(held)
        self.first_word = np.searchsorted(self.start, offsets)  # of each text
        words = np.diff(self.first_word)
        self.words = words
        self.total = running_sum(held)
        self.hashes = h = word_hashes(held, self.start, self.end, self.total)
        grams = len(h) - gram + 1
        windows = len(h) - span + 1
        if windows <= 0:
            self.first = self.last = self.text = np.zeros(0, np.int64)
            self.minimiser = np.zeros(0, np.uint64)
            return
        g = np.zeros(grams, np.uint64)
        for i in range(gram):
            g += h[i : i + grams] * GRAMS[i]
        m = mixed(g)
        # the minimum over span - gram + 1 grams, by doubling
        need, wide = span - gram + 1, 1
        while wide * 2 <= need:
            m = np.minimum(m[: len(m) - wide], m[wide:])
            wide *= 2
        m = np.minimum(m[:windows], m[need - wide : need - wide + windows])
        text = np.repeat(np.arange(n), words)
        live = np.flatnonzero(text[:windows] == text[span - 1 : span - 1 + windows])
        if not len(live):
            self.first = self.last = self.text = np.zeros(0, np.int64)
            self.minimiser = np.zeros(0, np.uint64)
            return
        mm, tt = m[live], text[live]
        new = np.flatnonzero(np.concatenate([[True], (mm[1:] != mm[:-1]) | (tt[1:] != tt[:-1])]))
        count = np.diff(np.append(new, len(live)))
        self.first = live[new]
        self.last = self.first + count + span - 1
        self.minimiser, self.text = mm[new], tt[new]


def pack_counts(values: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted minimisers and their counts; the steps between them compress better than they do."""
    raw = np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, 8, -1)
    steps, n = (np.ascontiguousarray(x.T).reshape(-1) for x in raw)
    return np.cumsum(steps.view("<u8"), dtype=np.uint64), n.view("<i8")


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each minimiser once, sorted, with the sum of its counts."""
    m, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(m, kind="stable")
    m, n = m[order], n[order]
    new = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    return m[new], np.add.reduceat(n, new)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text, tie: tie is a hash of the text where rows of different texts share the doc_id, else 0."""
    texts = id_text(docs)
    own = F.xxhash64("text")
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    shared = texts.groupBy(key.alias("shared")).agg(F.min(own).alias("a"), F.max(own).alias("b")).filter("a <> b").select("shared")
    shared = staged(shared, "substring-ids")
    n = shared.count()
    if not n:
        drop_staged(shared)
        return texts.withColumn("tie", F.lit(0).cast("long"))
    if n > BROADCAST_IDS:
        return texts.withColumn("tie", own)
    out = texts.join(F.broadcast(shared), key == F.col("shared"), "left")
    return out.select("doc_id", "text", F.when(F.col("shared").isNotNull(), own).otherwise(0).alias("tie"))


def hot_minimisers(docs: DataFrame, span: int, gram: int) -> np.ndarray:
    """The minimisers to split, sorted: those of more than HOT packed strings, and MOST_HOT of them at most.

    Every count of every task goes into the sums, however small: a phrase may be spread thinly.
    """
    partitions = to_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        entries = weight = 0
        held = np.zeros(0, np.uint64)  # the strings that `packed` would hold, by the hash of their words
        minimisers: list[np.ndarray] = []

        def settle() -> None:
            nonlocal held, minimisers, weight, entries
            if minimisers:
                counted.append(np.unique(np.concatenate(minimisers), return_counts=True))
                entries += len(counted[-1][0])
            held, minimisers, weight = held[:0], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal entries
            if not counted:
                return
            m, n = summed(counted)
            counted.clear()
            entries = 0
            part = (mixed(m) % np.uint64(partitions)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, m, n = part[order], m[order], n[order]
            new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            blobs = [pack_counts(m[x:y], n[x:y]) for x, y in zip(new.tolist(), [*new[1:].tolist(), len(m)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[new]), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in chunks(batches, CHUNK_BYTES):
            s = Super(*text_bytes(batch.column("text")), span, gram)
            if not len(s.first):
                continue
            # equal packed strings count once for as long as `packed` holds them
            a, b = s.start[s.first], s.end[s.last - 1]
            own = mixed((s.total[b] - s.total[a]) * powers(len(s.data) + 1)[1][a] + s.minimiser)
            own, at = np.unique(own, return_index=True)
            fresh = ~np.isin(own, held, assume_unique=True)
            own, at = own[fresh], at[fresh]
            held = np.concatenate([held, own])
            minimisers.append(s.minimiser[at])
            weight += int((b[at] - a[at] + 120).sum())
            if weight > HOLD_BYTES:
                settle()
                if entries > COUNTED:
                    yield from out()
        settle()
        yield from out()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        entries, bound = 0, COUNTED
        for batch in batches:
            for blob in batch.column("blob"):
                held.append(unpack_counts(blob.as_py()))
                entries += len(held[-1][0])
                if entries > bound:
                    held = [summed(held)]
                    entries = len(held[0][0])
                    bound = max(COUNTED, 2 * entries)
        if held:
            m, n = summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(m[n > HOT].view(np.int64)), pa.array(n[n > HOT])], ["m", "n"])

    counted = docs.select("text").mapInArrow(run, "part long, blob binary").repartition(partitions, "part")
    most = counted.mapInArrow(total, "m long, n long").orderBy(F.col("n").desc(), "m").limit(MOST_HOT)
    return np.sort(np.array([r["m"] for r in most.collect()], np.int64).view(np.uint64))


def pack(ids: list[int], ties: list[int], start: list[int], strings: list[bytes]) -> bytes:
    head = b"".join(np.array(x, "<i8").tobytes() for x in ([len(ids)], ids, ties)) + b"".join(np.array(x, "<i4").tobytes() for x in (start, list(map(len, strings))))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(strings))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    wide = [np.frombuffer(raw, "<i8", n, 8 + 8 * n * i) for i in range(2)]
    return *wide, *[np.frombuffer(raw, "<i4", n, 8 + 16 * n + 4 * n * i) for i in range(2)], raw[8 + 24 * n :]


def packed(docs: DataFrame, buckets: int, hot: np.ndarray, span: int, gram: int) -> DataFrame:
    """bucket, blob (packed strings of a bucket), or doc_id, tie, lo, hi (a range of repeated windows, bucket -1)."""
    hot_list = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_list.value
        held: dict[bytes, tuple[int, int, int, int]] = {}  # string to doc_id, tie, start, bucket
        repeats: list[tuple[int, int, int, int]] = []
        weight = 0

        def out() -> Iterator[pa.RecordBatch]:
            groups: dict[int, tuple[list, list, list, list]] = {}
            for string, (doc, tie, start, bucket) in held.items():
                g = groups.get(bucket)
                if g is None:
                    g = groups[bucket] = ([], [], [], [])
                g[0].append(doc)
                g[1].append(tie)
                g[2].append(start)
                g[3].append(string)
            rows = [(b, pack(*g), None, None, None, None) for b, g in groups.items()] + [(-1, None, *r) for r in repeats]
            for i in range(0, len(rows), 4096):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096], strict=True), (pa.int64(), pa.binary(), *[pa.int64()] * 4), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "blob", "doc_id", "tie", "lo", "hi"])

        for batch in chunks(batches, CHUNK_BYTES):
            s = Super(*text_bytes(batch.column("text")), span, gram)
            if not len(s.first):
                continue
            ids, ties = batch.column("doc_id").fill_null(NULL_ID).to_numpy(), batch.column("tie").to_numpy()
            first, last, text, m = s.first, s.last, s.text, s.minimiser
            if len(hot):
                at = np.searchsorted(hot, m)
                at[at == len(hot)] = 0
                split = hot[at] == m
                if split.any():
                    # one string for each window; where it goes depends on all its words
                    count = last[split] - first[split] - span + 1
                    f = np.repeat(first[split], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    w = sum(s.hashes[f + i] * GRAMS[i] for i in range(span))
                    t = np.repeat(text[split], count)
                    first, last = np.concatenate([first[~split], f]), np.concatenate([last[~split], f + span])
                    text, m = np.concatenate([text[~split], t]), np.concatenate([m[~split], mixed(w)])
            bucket = (mixed(m) % np.uint64(buckets)).astype(np.int64)
            raw = s.data.tobytes()
            a, b = s.start[first], s.end[last - 1]
            place = first - s.first_word[text]
            for x, y, doc, tie, start, n, k in zip(a.tolist(), b.tolist(), ids[text].tolist(), ties[text].tolist(), place.tolist(), (last - first - span + 1).tolist(), bucket.tolist(), strict=True):
                string = raw[x:y]
                own, old = (doc, tie, start, k), held.get(string)
                if old is None:
                    held[string] = own
                    weight += y - x + 120
                elif own < old:
                    held[string] = own
                    repeats.append((*old[:3], old[2] + n))
                elif own != old:
                    repeats.append((*own[:3], start + n))
            if weight > HOLD_BYTES:
                yield from out()
                held, repeats, weight = {}, [], 0
        yield from out()

    return docs.mapInArrow(run, "bucket long, blob binary, doc_id long, tie long, lo long, hi long")


def exact_ids(raw: bytes) -> np.ndarray:
    """A number for each word of raw, equal for equal words only."""
    words = raw.split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words)).astype(np.uint64)


def later_windows(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, strings: list[bytes], span: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, tie and start of each window whose words also start earlier.

    Windows are sorted by a 64-bit hash. Where hashes agree the words are compared: a stretch of
    windows that follow each other on both sides is one comparison of bytes. Should one fail, all
    is done again with numbers for words in place of hashes, and full comparison of windows.
    """
    raw = b" ".join(strings)
    data = np.frombuffer(raw, np.uint8)
    word_start, word_end = word_bounds(data)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    string_at = np.cumsum(size + 1) - size - 1
    at = np.searchsorted(word_start, string_at)  # first word of each string
    words = np.diff(np.append(at, len(word_start)))
    ids = exact_ids(raw) if exact else word_hashes(data, word_start, word_end)
    count = words - span + 1
    string = np.repeat(np.arange(len(strings)), count)
    first = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count) + at[string]
    up, down = powers(len(ids) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(ids + np.uint64(1)) * up[: len(ids)])])
    h = (total[first + span] - total[first]) * down[first]
    if exact:
        _, inverse = np.unique(np.stack([ids[first + i] for i in range(span)], 1), axis=0, return_inverse=True)
        h = inverse.ravel().astype(np.uint64)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return doc[:0], tie[:0], start[:0]
    order = order[np.append(same, False) | np.append(False, same)]  # windows that are not alone
    d, t, s = doc[string[order]], tie[string[order]], start[string[order]] + first[order] - at[string[order]]
    rank = np.lexsort((s, t, d, h[order]))
    order, d, t, s = order[rank], d[rank], t[rank], s[rank]
    new = np.append(True, h[order][1:] != h[order][:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    # the same occurrence can come twice (repeated rows): it is not earlier than itself
    later = (d != d[lead]) | (t != t[lead]) | (s != s[lead])
    order, lead, d, t, s = order[later], order[lead[later]], d[later], t[later], s[later]
    if not exact and len(order):
        by_place = np.argsort(order)
        a, b = first[order[by_place]], first[lead[by_place]]
        new = np.flatnonzero(np.append(True, (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)))
        last = np.append(new[1:], len(a)) - 1
        places = [word_start[a[new]], word_end[a[last] + span - 1], word_start[b[new]], word_end[b[last] + span - 1]]
        for i, j, k, m in zip(*[p.tolist() for p in places], strict=True):
            if raw[i:j] != raw[k:m] and raw[i:j].split() != raw[k:m].split():
                return later_windows(doc, tie, start, strings, span, exact=True)
    return d, t, s


def ranges(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of a document as (doc, tie, lo, hi), hi exclusive."""
    if not len(doc):
        return doc, tie, start, start
    order = np.lexsort((start, tie, doc))
    d, t, s = doc[order], tie[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + 1)]))
    return d[new], t[new], s[new], s[np.append(new[1:], len(d)) - 1] + 1


MARKS = ["doc_id", "tie", "lo", "hi"]


def repeated(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, tie, lo, hi: ranges of window starts whose words also start earlier (null doc_id: NULL_ID); texts is `named`.

    Null and empty texts, and those of fewer words than a window, have none; rows equal in doc_id
    and text are one document, and so have equal ranges; an empty table gives no rows.
    """
    spark = texts.sparkSession
    partitions = to_partitions(spark)
    rows = packed(texts, partitions * BUCKETS_PER_PARTITION, hot_minimisers(texts, span, gram), span, gram)
    rows = rows.repartition(partitions, F.when(F.col("bucket") < 0, F.xxhash64("doc_id", "tie", "lo")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []

        def solved() -> pa.RecordBatch:
            parts = [unpack(b) for b in blobs]
            doc, tie, start, size = (np.concatenate([p[i] for p in parts]) for i in range(4))
            raw = b"".join(p[4] for p in parts)
            end = np.cumsum(size, dtype=np.int64)
            strings = [raw[x:y] for x, y in zip((end - size).tolist(), end.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(list(map(pa.array, ranges(*later_windows(doc, tie, start.astype(np.int64), strings, span)))), MARKS)

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            direct = np.flatnonzero(bucket < 0)
            if len(direct):
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(direct)) for c in MARKS], MARKS)
            for i in np.flatnonzero(bucket >= 0).tolist():
                if bucket[i] != current:
                    if blobs:
                        yield solved()
                    current, blobs = bucket[i], []
                blobs.append(batch.column("blob")[i].as_py())
        if blobs:
            yield solved()

    return rows.mapInArrow(run, "doc_id long, tie long, lo long, hi long")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def deduplicated(docs: DataFrame, span: int = SPAN, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text, if asked) of every row of docs.

    A word goes if a window over it has a word sequence that also starts earlier: in a smaller
    doc_id, or earlier in the same text. Windows are judged on the input. A null or empty text has
    no words. Rows without a doc_id come before all others. Rows that share a doc_id, or have none,
    are one document if their texts are equal, and no repeats of each other; if not, they are
    documents that follow each other by a 64-bit hash of the text. An empty table gives no rows;
    other columns of docs are not read.
    """
    own = named(docs)
    marks = repeated(own, span, gram).groupBy(F.col("doc_id").alias("of"), F.col("tie").alias("of_tie")).agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    rows = own.join(marks, (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("of")) & (F.col("tie") == F.col("of_tie")), "left").select("doc_id", "text", "marks")
    schema = RESULT + (", text string" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES):
            out = []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                words = text.encode().split()
                n = len(words)
                if marks and n:
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, np.minimum([m["lo"] for m in marks], n), 1)
                    np.add.at(cover, np.minimum([m["hi"] + span - 1 for m in marks], n), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0).tolist()]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            n, gone, sha, kept = zip(*out, strict=True)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())] if texts else columns, [*names, "text"] if texts else names)

    return rows.mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
