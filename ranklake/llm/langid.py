"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum, over all ways to cut it into pieces, of the product of their probabilities: a
forward pass over its characters. The pieces' probabilities are fitted by expectation
maximisation, whose expected counts come from the same pass and its backward twin, on a bounded
sample of labelled rows. A text's score is the sum over its words, lower-cased; a word's scores
are remembered by the worker, as words repeat.

Every labelled language is learned, LANG_BLOCK of them at a time: the probabilities of a block are
a file in the shared folder that workers map, so the driver holds one block however many there are.
Characters outside the vocabulary take a piece of their own. Words of any length are fitted and
scored whole: beyond LONG characters the passes carry their last values from stretch to stretch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_staged, held, mapped, new_dir, staged, to_partitions, write_shared

#: Characters of a word up to which many words of like length are worked on at once.
LONG = 4096
SPAN = 16  # characters of the longest piece
#: The fit reads about this many labelled rows of each language, chosen by a hash of doc_id and text.
FIT_ROWS = 600
#: Languages fitted and scored at once.
LANG_BLOCK = 64
#: Up to this many languages' shares of rows are broadcast to draw the sample.
BROADCAST_LANGS = 10_000
ROUNDS = 3
#: Scores (words times languages, 8 bytes each) that a worker remembers, beside about 200 bytes a word.
CACHE = 1_600_000
CHUNK_BYTES = 2 << 20
WORDY = re.compile(r"[^\W\d_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L is in it: numerals such as fractions are none."""
    return any(c.isalpha() for m in WORDY.finditer(text) for c in m.group())


class Vocabulary:
    """The pieces as sorted hashes: piece i is row i of every language's table, row `size` is for unknown characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        names = sorted({x for x in (n[0] + n[1:].lower() if n else n for n in names) if 0 < len(x) <= SPAN and "▁" not in x[1:]})
        self.size = len(names)
        self.known = {x for x in names if len(x) == 1}
        hashes = np.array([self._hash(x) for x in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(MULTIPLIER) % 2**64
        return h

    def edges(self, words: list[str]) -> np.ndarray:
        """ids (words, ends, SPAN): the piece that ends after a character and is 1..SPAN long, or -1."""
        return self.pieces(["▁" + w for w in words])

    def pieces(self, marked: list[str]) -> np.ndarray:
        """As `edges`, of stretches that bear the mark of a word's begin where they have one."""
        wide = max(map(len, marked))
        codes = np.array(marked, dtype=f"<U{wide}").view(np.uint32).reshape(len(marked), wide)
        out = np.full((len(marked), wide, SPAN), -1, np.int32)
        h = np.zeros((len(marked), wide), np.uint64)
        # h holds the hash of the stretch of `span` characters from each place on
        for span in range(1, min(SPAN, wide) + 1):
            live = wide - span + 1
            h = (h[:, :live] + codes[:, span - 1 :].astype(np.uint64) + np.uint64(1)) * MULTIPLIER
            at = np.searchsorted(self.hashes, h)
            at[at == self.size] = 0
            hit = (self.hashes[at] == h) & (codes[:, span - 1 :] != 0)
            found = np.where(hit, self.ids[at], -1)
            if span == 1:
                found = np.where((found < 0) & (codes != 0), self.size, found)
            out[:, span - 1 :, span - 1] = found
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def padded(table: np.ndarray) -> np.ndarray:
    """A table with a last row of zeros: row -1 stands for no such piece."""
    return np.vstack([table, np.zeros((1, table.shape[1]))])


def forward(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log of each word's probability (words, languages); table is padded."""
    n, wide, _ = edges.shape
    alpha = np.zeros((n, wide + 1, table.shape[1]))
    alpha[:, 0] = 1
    scale = np.zeros((n, table.shape[1]))
    out = np.zeros((n, table.shape[1]))
    length = (edges[:, :, 0] >= 0).sum(1)
    for j in range(1, wide + 1):
        for span in range(1, min(SPAN, j) + 1):
            e = edges[:, j - 1, span - 1]
            if (e >= 0).any():
                alpha[:, j] += alpha[:, j - span] * table[e]
        done = length == j
        if done.any():
            out[done] = np.log(np.maximum(alpha[done, j], 1e-300)) + scale[done]
        if j % SPAN == 0:  # keep the values that are still needed within range
            top = alpha[:, max(0, j - SPAN) : j + 1].max(1)
            top[top == 0] = 1
            alpha[:, max(0, j - SPAN) : j + 1] /= top[:, None]
            scale += np.log(top)
    return out


def forward_long(own: Vocabulary, word: str, table: np.ndarray) -> np.ndarray:
    """As `forward`, of one word of any length: the last SPAN values go on from stretch to stretch."""
    marked = "▁" + word
    last = np.zeros((SPAN, table.shape[1]))
    last[-1] = 1
    scale = np.zeros(table.shape[1])
    for at in range(0, len(marked), LONG):
        before = min(at, SPAN - 1)
        edges = own.pieces([marked[at - before : at + LONG]])[0, before:]
        alpha = np.vstack([last, np.zeros((len(edges), table.shape[1]))])
        for i in range(0, len(edges), 256):
            weight = table[edges[i : i + 256, ::-1]]
            for j in range(i, min(i + 256, len(edges))):
                alpha[SPAN + j] = np.einsum("sl,sl->l", alpha[j : j + SPAN], weight[j - i])
                if j % SPAN == SPAN - 1:
                    top = alpha[j + 1 : j + 1 + SPAN].max(0)
                    top[top == 0] = 1
                    alpha[j + 1 : j + 1 + SPAN] /= top
                    scale += np.log(top)
        last = alpha[-SPAN:]
    return np.log(np.maximum(last[-1], 1e-300)) + scale


def expected(edges: np.ndarray, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words, by forward and backward passes that are scaled as they go."""
    n, wide, _ = edges.shape
    own = np.append(table, 0.0)
    length = (edges[:, :, 0] >= 0).sum(1)
    rows = np.arange(n)
    alpha, beta = np.zeros((n, wide + 1)), np.zeros((n, wide + 1))
    alpha_log, beta_log = np.zeros((n, wide + 1)), np.zeros((n, wide + 1))
    alpha[:, 0] = 1
    beta[rows, length] = 1
    scale = np.zeros(n)
    for j in range(1, wide + 1):
        for span in range(1, min(SPAN, j) + 1):
            alpha[:, j] += alpha[:, j - span] * own[edges[:, j - 1, span - 1]]
        alpha_log[:, j] = scale
        if j % SPAN == 0:
            top = alpha[:, j - SPAN : j + 1].max(1)
            top[top == 0] = 1
            alpha[:, j - SPAN : j + 1] /= top[:, None]
            scale = scale + np.log(top)
            alpha_log[:, j - SPAN : j + 1] = scale[:, None]
    scale = np.zeros(n)
    for j in range(wide, 0, -1):
        beta_log[:, j] = scale
        for span in range(1, min(SPAN, j) + 1):
            beta[:, j - span] += beta[:, j] * own[edges[:, j - 1, span - 1]]
        if j % SPAN == 0:
            top = beta[:, j - SPAN : j].max(1)
            top[top == 0] = 1
            beta[:, j - SPAN : j] /= top[:, None]
            scale = scale + np.log(top)
    total = alpha[rows, length]
    each = np.divide(weight, total, out=np.zeros(n), where=total > 0)
    at = alpha_log[rows, length]
    out = np.zeros(len(own))
    for span in range(1, min(SPAN, wide) + 1):
        e = edges[:, span - 1 :, span - 1]
        there = e >= 0
        factor = np.exp(np.minimum(alpha_log[:, : wide - span + 1] + beta_log[:, span:] - at[:, None], 700))
        value = each[:, None] * alpha[:, : wide - span + 1] * beta[:, span:] * factor * own[e]
        out += np.bincount(e[there], value[there], len(own))
    return out[:-1]


def _forward_stretch(last: np.ndarray, scale: float, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward values and their log scales behind each character of a stretch, the SPAN values before it in front."""
    alpha, logs = np.concatenate([last, np.zeros(len(weight))]), np.full(SPAN + len(weight), scale)
    for i, w in enumerate(weight, SPAN):
        alpha[i] = alpha[i - SPAN : i] @ w[::-1]
        logs[i] = scale
        if i % SPAN == 0:
            top = alpha[i - SPAN + 1 : i + 1].max()
            if top > 0:
                alpha[i - SPAN + 1 : i + 1] /= top
                scale += np.log(top)
                logs[i - SPAN + 1 : i + 1] = scale
    return alpha, logs


def expected_long(own: Vocabulary, marked: str, table: np.ndarray, weight: float) -> np.ndarray:
    """As `expected`, of one word of any length: forward values at the beginnings of stretches are kept, and the
    backward pass goes through the stretches from the last one, carrying its first SPAN values on."""
    prob = np.append(table, 0.0)
    starts = range(0, len(marked), LONG)

    def edges(at: int) -> np.ndarray:
        before = min(at, SPAN - 1)
        return own.pieces([marked[at - before : at + LONG]])[0, before:]

    last, scale, before = np.zeros(SPAN), 0.0, []
    last[-1] = 1
    for at in starts:
        before.append((last, scale))
        alpha, logs = _forward_stretch(last, scale, prob[edges(at)])
        last, scale = alpha[-SPAN:] * np.exp(logs[-SPAN:] - logs[-1]), logs[-1]
    out = np.zeros(len(prob))
    if last[-1] <= 0:
        return out[:-1]
    total = np.log(last[-1]) + scale
    carried, scale = np.zeros(SPAN), 0.0
    carried[-1] = 1
    for at, (first, first_scale) in zip(reversed(starts), reversed(before), strict=True):
        e = edges(at)
        w = prob[e]
        alpha, logs = _forward_stretch(first, first_scale, w)
        beta, said = np.concatenate([np.zeros(len(e)), carried]), np.zeros(len(e))
        ends = np.zeros(len(e))
        for k in range(len(e) - 1, -1, -1):  # what ends behind character k ends at place k + SPAN
            i = k + SPAN
            ends[k], said[k] = beta[i], scale
            beta[i - SPAN : i] += beta[i] * w[k, ::-1]
            if k % SPAN == 0:
                top = beta[i - SPAN : i].max()
                if top > 0:
                    beta[i - SPAN : i] /= top
                    scale += np.log(top)
        carried = beta[:SPAN]
        places = np.arange(len(e))[:, None] + SPAN - np.arange(1, SPAN + 1)
        value = weight * alpha[places] * w * ends[:, None] * np.exp(np.minimum(logs[places] + said[:, None] - total, 700))
        there = e >= 0
        out += np.bincount(e[there], value[there], len(prob))
    return out[:-1]


def by_length(words: list[str], most: int = 4096) -> Iterator[list[int]]:
    """Indices of words of like length, few enough to work on at once."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    while start < len(order):
        end, bound = start, max(4, len(words[order[start]]) * 5 // 4)
        while end < len(order) and end - start < max(16, most * 8 // bound) and len(words[order[end]]) <= bound:
            end += 1
        yield order[start:end]
        start = end


class Scorer:
    """Remembers the scores of words; tables is one padded table for each block of languages."""

    def __init__(self, path: str, tables: list[np.ndarray]):
        self.vocabulary, self.tables = vocabulary(path), tables
        self.langs = sum(t.shape[1] for t in tables)
        self.most = max(1024, CACHE // self.langs)
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.langs))

    def forward(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.langs))
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        for group in by_length([words[i] for i in short]):
            group = [short[i] for i in group]
            edges = self.vocabulary.edges([words[i] for i in group])
            out[group] = np.hstack([forward(edges, t) for t in self.tables])
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = np.hstack([forward_long(self.vocabulary, w, t) for t in self.tables])
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.most:
            self.at.clear()
            new = list(words)
        if not new:
            return
        base = len(self.at)
        if base + len(new) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), base + len(new)), self.langs))
            grown[:base] = self.rows[:base]
            self.rows = grown
        self.rows[base : base + len(new)] = self.forward(new)
        self.at.update(zip(new, range(base, base + len(new)), strict=True))

    def score(self, texts: list[str]) -> np.ndarray:
        """log probability of each text in each language."""
        split = [t.lower().split() for t in texts]
        get = self.at.__getitem__
        out = np.zeros((len(texts), self.langs))
        start = 0
        while start < len(split):  # as many texts as have few enough words to remember at once
            end, words = start, set()
            while end < len(split) and (end == start or len(words) < self.most):
                words.update(w.replace("\0", "�") for w in split[end])
                end += 1
            self.learn(words)
            for i in range(start, end):
                for k in range(0, len(split[i]), 1 << 16):
                    s = split[i][k : k + (1 << 16)]
                    try:
                        rows = list(map(get, s))
                    except KeyError:
                        rows = [get(w.replace("\0", "�")) for w in s]
                    out[i] += self.rows[rows].sum(0)
            start = end
        return out


def scorer(path: str, uris: list[str]) -> Scorer:
    """The worker's scorer for this model; later tasks find its words."""

    def make() -> Scorer:
        rows = vocabulary(path).size + 2
        return Scorer(path, [np.array(mapped(u, "<f8")).reshape(rows, -1) for u in uris])

    return held(("langid", path, tuple(uris)), make)


def fit(labelled: DataFrame, path: str | None = None) -> tuple[list[str], list[str]]:
    """Languages, and a file of piece probabilities for each LANG_BLOCK of them, in the shared folder.

    labelled: doc_id, text, lang. Reads about FIT_ROWS rows of each language, every one of them;
    equal texts of a language count once in the sample. Words of any length are counted whole.
    What reaches the driver at once is a count for each piece and language of one block. Rows without text or lang teach nothing; with none left there are no languages.
    """
    path = path or default_path()
    spark = labelled.sparkSession
    rows = labelled.filter("text is not null and lang is not null")
    counts = staged(rows.groupBy("lang").count().select(F.col("lang").alias("own_lang"), (FIT_ROWS / F.col("count")).alias("share")), "langid-langs")
    langs = sorted(r["own_lang"] for r in counts.select("own_lang").collect())
    size = vocabulary(path).size
    if not langs:
        return [], []
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    share = F.broadcast(counts) if len(langs) <= BROADCAST_LANGS else counts
    sample = rows.join(share, F.col("lang") == F.col("own_lang")).filter(draw < F.col("share")).select("lang", "text").dropDuplicates()
    sample = staged(sample.repartition(to_partitions(spark), F.xxhash64("text")), "langid-sample")
    folder, uris = new_dir(spark, "langid"), []
    for i in range(0, len(langs), LANG_BLOCK):
        block = langs[i : i + LANG_BLOCK]
        table = _fitted(sample.filter(F.col("lang").isin(block)), block, path, size)
        uris.append(f"{folder}/pieces-{i:06d}.bin")
        write_shared(uris[-1], [padded(table).astype("<f8").tobytes()])
    drop_staged(sample)
    drop_staged(counts)
    return langs, uris


def _fitted(sample: DataFrame, langs: list[str], path: str, size: int) -> np.ndarray:
    """The probabilities of the pieces, and of one for unknown characters, in each of a few languages."""
    at = {x: i for i, x in enumerate(langs)}
    table = np.full((size + 1, len(langs)), 1 / (size + 1))
    for _ in range(ROUNDS):
        sent = sample.sparkSession.sparkContext.broadcast(table)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, table = vocabulary(path), sent.value
            for batch in chunks(batches, CHUNK_BYTES):
                words: dict[str, Counter] = {}
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    seen = words.setdefault(lang, Counter())
                    seen.update("▁" + w.replace("\0", "�") for w in text.lower().split())
                for lang, seen in words.items():
                    names = [w for w in seen if len(w) <= LONG]
                    total = np.zeros(size + 1)
                    for w in (w for w in seen if len(w) > LONG):
                        total += expected_long(own, w, table[:, at[lang]], float(seen[w]))
                    for group in by_length(names):
                        total += expected(own.pieces([names[i] for i in group]), table[:, at[lang]], np.array([seen[names[i]] for i in group], float))
                    piece = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(piece), pa.string()), pa.array(piece, pa.int64()), pa.array(total[piece], pa.float64())], ["lang", "piece", "n"])

        got = sample.mapInArrow(count, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        table = np.full((size + 1, len(langs)), 1e-2)
        for r in got:
            table[r["piece"], at[r["lang"]]] += r["n"]
        table /= table.sum(0)
    return table


def _judged(batch: pa.RecordBatch, langs: list[str], own: Scorer | None) -> tuple[list[str], np.ndarray]:
    """The language of each text of a batch, and its share of the text's probability."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    if own is None:
        return ["und"] * len(texts), np.zeros(len(texts))
    logs = own.score(texts)
    best = logs.argmax(1)
    share = 1 / np.exp(logs - logs.max(1)[:, None]).sum(1)
    letter = [has_letter(t) for t in texts]
    return [langs[b] if ok else "und" for b, ok in zip(best, letter, strict=True)], np.where(letter, share, 0.0)


def predict(docs: DataFrame, langs: list[str], uris: list[str], path: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every row.

    score is the predicted language's share of the text's probability. A null text, or one without
    a letter (Unicode category L), gets `und` and score 0, as does every text where no language was
    learned. Of languages that tie, the first by code point is named. Repeated rows get equal
    results; an empty table gives no rows; other columns of docs are not read.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(path, uris) if langs else None
        for batch in chunks(batches, CHUNK_BYTES):
            pred, share = _judged(batch, langs, own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(share, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, langs: list[str], uris: list[str], min_share: float, path: str | None = None) -> DataFrame:
    """The rows of docs that `predict` gives a language with a share of min_share or more, their columns as they are.

    No column is added on the way, so none can clash. Null texts, texts without a letter, and all
    texts where no language was learned, go; repeated rows stay or go together; an empty table
    stays empty.
    """
    path = path or default_path()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(path, uris) if langs else None
        for batch in chunks(batches, CHUNK_BYTES):
            pred, share = _judged(batch, langs, own)
            stays = pa.array([p != "und" and s >= min_share for p, s in zip(pred, share.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(batch.columns, names).filter(stays)

    return docs.mapInArrow(run, docs.schema)


def training(docs: DataFrame) -> DataFrame:
    """The rows to learn from: crc32 of doc_id as text, modulo 3, isn't 1."""
    return docs.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, uris = fit(training(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return predict(docs, langs, uris).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
