"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints within LIMIT differing bits must, in at least one of m parts, differ in no more
than that part's threshold, whenever the thresholds sum to LIMIT - m + 1 (a threshold of -1 leaves
a part out). Bits that go together are put into one part, so that parts are as independent as they
can be; a dynamic programme then gives each part the threshold for which the rows and the
candidate pairs expected are least, and the number of parts is chosen the same way.

A part with threshold t is probed by every choice of t of its bits left out. Fingerprints that
share a key are verified in full. Equal fingerprints are one row from the start; what a bucket or
a batch finds is handed on as a spanning forest, so a group of n is n - 1 edges and not n^2. A key
of more than LARGE fingerprints is cut into chunks, and its pairs of chunks are dealt to tasks of
their own.

A limit of bits is exact, but only a narrow one is cheap: texts of a shingle similarity of 0.8
differ in some 10 of 64 bits. For a similarity the fingerprint has WIDE words of 64 bits, which
tell it within a few hundredths; the dynamic programme then takes the parts and thresholds that
find a pair of just that similarity with a probability of RECALL at the least expected cost. Rows
travel with one word, by which most buckets are found to hold no pair; only what passes is joined
to its whole fingerprint and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_staged, free_names, id_text, staged, to_partitions
from .graph import components

SEED = 42
WORDS = 4
LIMIT = 4
LARGE = 2048
RUN = 48  # shorter runs of a key are compared by offsets, all runs at once
CHUNK_BYTES = 1 << 20
#: The widest exact limit: 8 parts with thresholds of 3 reach no further.
MOST_BITS = 31
#: Words of a fingerprint for a similarity, and the chance that a pair of just that similarity is probed.
WIDE = 16
RECALL = 0.95
#: Bits of one word by which pairs are told apart before their fingerprints are joined; texts of a similarity of 0.8 differ in 10 on average, others in 32.
FIRST = 20
#: Nodes of fingerprints that only rows without a doc_id have are numbered from here on.
NO_ID = 1 << 62
#: Relative costs of a row that is shuffled and of a candidate pair that is verified.
ROW_COST, PAIR_COST = 40.0, 1.0


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The shingles' hashes, a stretch at a time."""
    import xxhash

    text = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    if len(words) > size:
        start, end = start[: 1 - size or None], end[size - 1 :]
    else:
        start, end = start[:1], end[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(start), 1 << 16):
        yield np.array([digest(text[a:b], SEED) for a, b in zip(start[i : i + (1 << 16)].tolist(), end[i : i + (1 << 16)].tolist(), strict=True)], "<u8")


def fingerprint(words: list[bytes], size: int = WORDS) -> int:
    """The fingerprint of lower-cased words; a bit is set if over half of the shingles' hashes have it."""
    if not words:
        return 0
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(words, size):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


_r = np.random.default_rng(64)
ODD, PLUS = _r.integers(0, 2**63, (2, 256), np.uint64)
ODD = ODD * np.uint64(2) + np.uint64(1)
del _r


def wide_fingerprint(words: list[bytes], size: int, wide: int = WIDE) -> bytes:
    """`wide` words of 64 bits, each from another mixing of the distinct shingles' hashes; zeros without words."""
    if not words:
        return bytes(8 * wide)
    h = np.unique(np.concatenate(list(shingle_hashes(words, size))))
    counts = np.zeros(64 * wide, np.int64)
    for i in range(0, len(h), 1020):
        x = mixed(h[i : i + 1020, None] * ODD[:wide] + PLUS[:wide]).astype("<u8")
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # so many fit a byte's sum
            counts += np.add.reduce(bits[j : j + 255], 0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(h), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, size: int = WORDS, wide: int = 0) -> DataFrame:
    """doc_id, fp, text_hash of every row; null or empty texts have fp 0.

    fp is the 64 bits as a long, or, if wide, that many words of 64 bits as binary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES):
            split = (t.encode().lower().split() for t in batch.column("text").to_pylist())
            if wide:
                fp = pa.array([wide_fingerprint(w, size, wide) for w in split], pa.binary())
            else:
                fp = pa.array(np.array([fingerprint(w, size) for w in split], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp, batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    rows = id_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc_id long, fp {'binary' if wide else 'long'}, text_hash long")


def words_of(column: pa.Array, wide: int = 0) -> np.ndarray:
    """Fingerprints as unsigned integers: one each, or `wide` each as a row."""
    if not wide:
        return column.to_numpy().astype("<i8").view(np.uint64)
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, wide).astype(np.uint64)


def bit_counts(distinct: DataFrame, wide: int = 0) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both of two bits of a word (words x 64 x 64), over all of them."""
    words = wide or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words, 64, 64))
        n = 0
        for batch in batches:
            fp = words_of(batch.column(0), wide).reshape(-1, words)
            for i in range(0, len(fp), 1 << 14):
                for w in range(words):
                    own = np.ascontiguousarray(fp[i : i + (1 << 14), w]).astype("<u8").view(np.uint8).reshape(-1, 8)
                    bits = np.unpackbits(own, axis=1, bitorder="little").astype(np.float32)
                    total[w] += bits.T @ bits
            n += len(fp)
        if n:
            at = np.append(np.flatnonzero(total.ravel()), total.size)
            value = np.append(total.ravel(), n)[at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(value.astype(np.int64))], ["at", "n"])

    rows = distinct.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(words * 4096 + 1)
    for r in rows:
        out[r["at"]] = r["n"]
    return int(out[-1]), out[:-1].reshape(words, 64, 64)


def grouped(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of like size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    link = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(link, 0)
    left, out = set(range(64)), []
    for i in range(parts):
        size = -(-len(left) // (parts - i))
        first = max(sorted(left), key=lambda b: link[b, sorted(left)].max())
        group = [first]
        left.discard(first)
        while len(group) < size:
            nxt = max(sorted(left), key=lambda b: link[b, group].sum())
            group.append(nxt)
            left.discard(nxt)
        out.append(sorted(group))
    return out


def expected_cost(n: int, both: np.ndarray, bits: list[int], t: int) -> float:
    """Rows shuffled and pairs verified if this part is probed with threshold t."""
    if t < 0:
        return 0.0
    p = np.diag(both) / max(n, 1)
    agree = (p**2 + (1 - p) ** 2)[bits]
    # the sum over all choices of t bits left out, by the elementary symmetric polynomial of 1 / agree
    e = np.zeros(t + 1)
    e[0] = 1
    for a in agree:
        e[1:] += e[:-1] / a
    return ROW_COST * n * comb(len(bits), t) + PAIR_COST * n * n / 2 * float(np.prod(agree)) * e[t]


def plan(n: int, both: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """The parts to probe and their thresholds: every two fingerprints within limit bits share a probe.

    Limits over MOST_BITS are refused: their probes would match most pairs there are.
    """
    if not 0 <= limit <= MOST_BITS:
        raise ValueError(f"a limit of {limit} bits isn't between 0 and {MOST_BITS}; take a similarity instead")
    best, out = np.inf, []
    for parts in range(1 if limit < 2 else 2, min(limit + 4, 8) + 1):
        groups = grouped(n, both, parts)
        need = limit - parts + 1  # what the thresholds sum to
        # shifted by one, thresholds are 0 (left out) and up, and sum to limit + 1
        table = {0: (0.0, [])}
        for bits in groups:
            step: dict[int, tuple[float, list[int]]] = {}
            for done, (cost, chosen) in table.items():
                for t in range(-1, min(limit, 3) + 1):
                    total = done + t + 1
                    if total <= limit + 1:
                        c = cost + expected_cost(n, both, bits, t)
                        if total not in step or c < step[total][0]:
                            step[total] = (c, [*chosen, t])
            table = step
        if limit + 1 in table and table[limit + 1][0] < best:
            best, thresholds = table[limit + 1]
            assert sum(thresholds) == need
            out = [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]
    return out


def differing(similarity: float) -> float:
    """The share of bits in which the fingerprints of two texts of this Jaccard similarity and like size differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def plan_similar(n: int, both: np.ndarray, similarity: float, recall: float = RECALL) -> list[tuple[int, list[int], int]]:
    """Word, part and threshold of the parts to probe, so that a pair of this similarity shares a probe with a chance of recall.

    The programme goes over the parts with what each adds to the log of the chance of a miss.
    """
    q, need, steps = differing(similarity), -log(1 - recall), 200
    best, out = np.inf, []
    for parts in (2, 3, 4, 5):
        table: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for w, own in enumerate(both):
            for bits in grouped(n, own, parts):
                options = [(0, 0.0, None)]
                for t in (0, 1):
                    found = sum(comb(len(bits), j) * q**j * (1 - q) ** (len(bits) - j) for j in range(t + 1))
                    options.append((int(-log(1 - found) / need * steps), expected_cost(n, own, bits, t), (w, bits, t)))
                step: dict[int, tuple[float, tuple]] = {}
                for done, (cost, chosen) in table.items():
                    for gain, more, probe in options:
                        total, c = min(steps, done + gain), cost + more
                        if total not in step or c < step[total][0]:
                            step[total] = (c, (chosen, probe) if probe else chosen)
                table = step
        if steps in table and table[steps][0] < best:
            best, chain = table[steps]
            out = []
            while chain:
                chain, probe = chain
                out.append(probe)
    if not out:
        raise ValueError(f"fingerprints of {len(both)} words can't find a similarity of {similarity} with a chance of {recall}")
    return out[::-1]


def masks(scheme: list[tuple[list[int], int]]) -> np.ndarray:
    """One mask for each probe: the bits that two fingerprints must share."""
    return np.array([sum(1 << b for b in bits if b not in out) for bits, t in scheme for out in combinations(bits, t)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def probes(nodes: DataFrame, mask: np.ndarray, word: np.ndarray | None = None, wide: int = 0) -> DataFrame:
    """key, fp, node: each fingerprint under the key of every probe. Of a wide one, word is each probe's and fp the word after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mixed(np.arange(1, len(mask) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            step = max(1, (1 << 20) // len(mask))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                fp = words_of(part.column("fp"), wide)
                probed, sent = (fp[:, word], fp[:, (word + 1) % wide].ravel()) if wide else (fp[:, None], np.repeat(fp, len(mask)))
                key = mixed((probed & mask) ^ salt).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sent.view(np.int64)), pa.array(np.repeat(part.column("node").to_numpy(), len(mask)))], ["key", "fp", "node"])

    return nodes.select("fp", "node").mapInArrow(run, "key long, fp long, node long")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n indices is linked to by the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ; those of several words are rows."""
    if a.ndim == 1:
        return np.bitwise_count(a ^ b)
    return sum(np.bitwise_count(a[:, w] ^ b[:, w]).astype(np.int32) for w in range(a.shape[1]))


def close_pairs(key: np.ndarray, fp: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Indices of rows of an equal key within limit bits, and whether they are of one long run; rows are sorted by key."""
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(new, len(key)))
    left = (size.repeat(size) - (np.arange(len(key)) - new.repeat(size))).astype(np.int64)  # rows of the run from here on
    live = np.flatnonzero((left > 1) & (size.repeat(size) <= RUN))
    d = 1
    while len(live):
        close = live[apart(fp[live], fp[live + d]) <= limit]
        yield close, close + d, False
        d += 1
        live = live[left[live] > d]
    for start, n in zip(new[size > RUN].tolist(), size[size > RUN].tolist(), strict=True):
        own = fp[start : start + n]
        for i in range(0, n, 512):
            if own.ndim == 1:
                far = np.bitwise_count(own[i : i + 512, None] ^ own[None, i:])
            else:
                far = sum(np.bitwise_count(own[i : i + 512, None, w] ^ own[None, i:, w]).astype(np.int16) for w in range(own.shape[1]))
            x, y = np.nonzero(far <= limit)
            keep = y > x
            yield x[keep] + i + start, y[keep] + i + start, True


def linked(key: np.ndarray, fp: np.ndarray, node: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, node) edges that connect whatever lies within limit bits under an equal key; rows are sorted by key."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    root = np.arange(len(key))
    for x, y, long in close_pairs(key, fp, limit):
        if long and len(x):  # a forest at once, as these may be many
            names, at = np.unique(np.concatenate([root[x], root[y]]), return_inverse=True)
            low = forest(at[: len(x)], at[len(x) :], len(names))
            moved = np.flatnonzero(low != np.arange(len(names)))
            a.append(names[moved])
            b.append(names[low[moved]])
            root[names] = names[low]
            while (root[root] != root).any():
                root = root[root]
        elif not long:
            a.append(x)
            b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    # one forest for the batch: the same pairs turn up under several keys
    names, at = np.unique(np.concatenate([node[a], node[b]]), return_inverse=True)
    root = forest(at[: len(a)], at[len(a) :], len(names))
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _met(rows: DataFrame) -> DataFrame:
    """Rows (key, fp, node) with those of an equal key together, sorted; a key of over LARGE is one for each pair of its chunks."""
    # keys over LARGE are at most rows / LARGE
    hot = staged(rows.groupBy("key").count().filter(F.col("count") > LARGE).select(F.col("key").alias("hot"), F.ceil(F.col("count") / LARGE).cast("int").alias("cuts")), "simhash-hot")
    many = hot.count()
    rows = rows.withColumn("block", F.lit(0).cast("long"))
    if many:
        rows = rows.join(F.broadcast(hot) if many <= 10_000 else hot, F.col("key") == F.col("hot"), "left")
        own = F.pmod(F.xxhash64("fp", "node"), F.col("cuts")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: (F.least(own, j) * F.col("cuts") + F.greatest(own, j)).cast("long"))
        rows = rows.select("key", "fp", "node", F.explode(F.coalesce(F.when(F.col("cuts") > 1, others), F.array(F.lit(0).cast("long")))).alias("block"))
    rows = rows.select(F.xxhash64("key", "block").alias("key"), "fp", "node")
    return rows.repartition(to_partitions(rows.sparkSession), "key").sortWithinPartitions("key")


def _runs(batches: Iterator[pa.RecordBatch], wide: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """key, fp, node of whole keys, about `least` rows at a time."""
    held = [np.zeros(0, np.int64), np.zeros((0, wide) if wide else 0, np.uint64), np.zeros(0, np.int64)]
    for batch in batches:
        held = [np.concatenate([h, x]) for h, x in zip(held, (batch.column("key").to_numpy(), words_of(batch.column("fp"), wide), batch.column("node").to_numpy()), strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on
        if cut > least:
            yield tuple(h[:cut] for h in held)
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield tuple(held)


def _edges(rows: DataFrame, limit: int, wide: int = 0) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, node in _runs(batches, wide, 1 << 14 if wide else 1 << 16):
            u, v = linked(key, fp, node, limit)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return rows.select("key", "fp", "node").mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """u, v: edges that connect every two fingerprints (fp, node; fp distinct) within limit bits.

    Fewer than two fingerprints have none. Nothing else about nodes is read.
    """
    n, both = bit_counts(nodes)
    if n < 2:
        return nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    return _edges(_met(probes(nodes, masks(plan(n, both[0], limit)))), limit)


def similar_limit(similarity: float, wide: int) -> int:
    """Bits within which most pairs of this similarity lie, and nearly all closer ones: the mean and a deviation."""
    q, bits = differing(similarity), 64 * wide
    return ceil(q * bits + sqrt(q * (1 - q) * bits))


def similar_links(nodes: DataFrame, similarity: float, recall: float = RECALL, wide: int = WIDE) -> DataFrame:
    """u, v: edges that connect wide fingerprints (fp, node; fp distinct) of texts of this similarity.

    A pair of just this similarity is probed with a chance of recall, closer ones with more; what is
    probed is linked if its fingerprints differ in no more than `similar_limit` bits.
    """
    n, both = bit_counts(nodes, wide)
    if n < 2:
        return nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    scheme = plan_similar(n, both, similarity, recall)
    mask = np.concatenate([masks([(bits, t)]) for _, bits, t in scheme])
    word = np.concatenate([np.full(comb(len(bits), t), w) for w, bits, t in scheme])

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, node in _runs(batches, 0, 1 << 16):
            stays = np.zeros(len(key), bool)
            for x, y, _ in close_pairs(key, fp, FIRST):
                stays[x] = stays[y] = True
            yield pa.RecordBatch.from_arrays([pa.array(key[stays]), pa.array(node[stays])], ["key", "at"])

    some = staged(_met(probes(nodes, mask, word, wide)).mapInArrow(partnered, "key long, at long"), "simhash-met")
    whole = some.join(nodes, F.col("at") == F.col("node")).select("key", "fp", "node")
    return _edges(whole.repartition(to_partitions(nodes.sparkSession), "key").sortWithinPartitions("key"), similar_limit(similarity, wide), wide)


def _found(docs: DataFrame, size: int, limit: int, similarity: float | None) -> DataFrame:
    wide = 0 if similarity is None else WIDE
    own = staged(fingerprints(docs, size, wide), "simhash-fp")
    lone = F.lit(NO_ID) + F.xxhash64("fp").bitwiseAND(F.lit((1 << 61) - 1))
    nodes = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", lone).alias("node")), "simhash-nodes")
    roots = components(similar_links(nodes, similarity, wide=wide) if wide else links(nodes, limit)).withColumnRenamed("node", "own")
    named = nodes.join(roots, F.col("node") == F.col("own"), "left").select(F.col("fp").alias("of"), F.coalesce("root", "node").alias("component"))
    out = staged(own.join(named, F.col("fp") == F.col("of")).drop("of"), "simhash-found")
    for done in (own, nodes, roots):
        drop_staged(done)
    return out


def near_duplicates(docs: DataFrame, size: int = WORDS, limit: int = LIMIT, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id of every row of docs.

    component_id is the smallest doc_id that links lead to: fingerprints within limit bits, or, if
    a similarity is given, wide ones of about that similarity or more. Null and empty texts share
    fingerprint 0 and are linked like any other. Rows that share a doc_id are one document. Rows
    without a doc_id never name a component: one that holds no doc_id at all has a null
    component_id. Repeated rows are repeated; an empty table gives no rows; other columns of docs
    are not read.
    """
    return _found(docs, size, limit, similarity).select("doc_id", "fp", F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"))


def deduplicated(docs: DataFrame, size: int = WORDS, limit: int = LIMIT, similarity: float | None = None) -> DataFrame:
    """The rows of docs without the near-duplicates: of each group the smallest doc_id stays.

    Of rows that share it, or of a group without a doc_id, the text of least 64-bit hash stays; of
    repeated rows one. Null texts count as empty; an empty table stays empty; all columns stay.
    """
    found = _found(docs, size, limit, similarity)
    own_hash, least_id, least_hash = free_names(docs, "text_hash", "least_id", "least_hash")
    every = found.groupBy("component").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("named"), F.min("text_hash").alias("lone")
    )
    stays = every.select(F.col("named.doc_id").alias(least_id), F.coalesce("named.text_hash", "lone").alias(least_hash))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(least_id)) & (F.col(own_hash) == F.col(least_hash))
    # texts are shuffled once, at every size: a broadcast of ids would grow with the corpus
    kept = docs.withColumn(own_hash, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).join(stays.hint("merge"), same, "left_semi")
    if found.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", own_hash])
    return kept.drop(own_hash)


def op5(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
