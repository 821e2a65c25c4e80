"""Personal data: base patterns, and bootstrapped contextual extraction.

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. They are
the seeds. A lexical pattern is what stands left of an instance: its last word, or its last two.
Every identifier-like token of the corpus, seed or not, gives edges between the patterns around it
and itself. Scoring alternates over that graph: a pattern's confidence is the mean score of the
distinct instances it matches (each seed counts 1), an instance's score is the chance that not all
of its patterns are wrong. After ROUNDS rounds, patterns of high confidence that matched enough
distinct seeds, nearly all of one kind, give that kind to the unseen tokens they match that can be
of it. Those of a high score become seeds,
and all is scored again, up to GENERATIONS times.

Edges are counts, so a context that a third of all texts share is one row a task before any
shuffle; texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import chunks, drop_staged, free_names, staged

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Times that tokens found become seeds, unless none is found before.
GENERATIONS = 3
MIN_CONFIDENCE = 0.8
#: Distinct seeds that a pattern must match.
MIN_SEEDS = 5
#: The shortest text that is of any kind (`a@b.c`), and the most digits that any kind allows (a card): what an unseen token must reach, or a run of groups stay within.
MIN_LENGTH = 5
RUN_DIGITS = 19
#: Characters before an instance that are read first for its context; more follow until two words are found.
CONTEXT = 120
#: Up to this many patterns (under 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_PATTERNS = 100_000
#: Tasks that one pattern's rows are dealt to where they are joined: a common context has a great share of all.
SALTS = 16
CHUNK_BYTES = 4 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
MARKED = re.compile(r"[0-9]+|@|\(at\)|\[at\]", re.IGNORECASE)
#: Groups of digits and marks of numbers, one blank between them; no letter at either end.
RUN = re.compile(r"(?<![\w@.,()/+-])\(?[0-9][0-9()./-]*(?:[\x20\t\xa0]\(?[0-9][0-9()./-]*)+(?![\w@])")
SPACES = " \t\n\x0b\x0c\r"
EDGE = "\"'`.,;:!?()[]{}<>*#$%&|=/\\"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((start, last))
            at = text.find("@", last)
        else:
            # the local part can't reach over this sign, so what is before it is settled
            last = at + 1
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in DOTTED.finditer(text):
        token = m.group()
        if token.count(".") < 3:
            continue
        parts, at = token.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end()))
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; code points, end exclusive."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [(1, *s) for s in ips(text)] + [(2, *s) for s in cards(text)]
        if "+" in text:
            out += [(3, *s) for s in phones(text)]
    return out


def _left(text: str, start: int) -> tuple[str, str]:
    """The word before a place and the two before it, lower-cased, without marks at their edges; empty where there are none.

    Pieces of marks alone are no words, and the walk to the left goes on until two words are found:
    no instance is passed by more than the next two, as instances are words themselves.
    """
    reach = CONTEXT
    while True:
        at = max(0, start - reach)
        near = text[at:start].lower().split()
        if at and near and text[at - 1] not in SPACES and text[at] not in SPACES:
            near = near[1:]  # a word that the window cuts is no word yet
        words = [w for w in (x.strip(EDGE) for x in near) if w][-2:]
        if len(words) == 2 or not at:
            return (words[-1] if words else "", " ".join(words) if len(words) == 2 else "")
        reach *= 4


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str, str]]:
    """(kind or -1, start, end, token, one word before, two words before) of seeds and of unseen identifier-like tokens.

    Unseen, of MIN_LENGTH characters or more, and touched by no base span: a word, without the
    marks at its edges, with a digit, @ or (at) in it; and a run of groups of digits, as numbers
    are often written, of up to RUN_DIGITS digits. The words of a run also count alone.
    """
    out = [(k, a, b, text[a:b].lower(), *_left(text, a)) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    n, done, i, seen = len(text), 0, 0, 0
    unseen = []
    for m in MARKED.finditer(text):
        if m.start() < done:
            continue
        a, b = m.span()
        while a > done and text[a - 1] not in SPACES:
            a -= 1
        while b < n and text[b] not in SPACES:
            b += 1
        done = b
        while a < b and text[a] in EDGE:
            a += 1
        while a < b and text[b - 1] in EDGE:
            b -= 1
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if b - a >= MIN_LENGTH and not any(x < b for x, _ in taken[i : i + 1]):
            unseen.append((a, b))
    for m in RUN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in EDGE:
            b -= 1
        while seen < len(taken) and taken[seen][1] <= a:
            seen += 1
        digits = sum(c.isdigit() for c in text[a:b])
        if b - a >= MIN_LENGTH <= digits <= RUN_DIGITS and not any(x < b for x, _ in taken[seen : seen + 1]):
            unseen.append((a, b))
    return out + [(-1, a, b, text[a:b].lower(), *_left(text, a)) for a, b in sorted(set(unseen))]


#: What an unseen token must hold to be of a kind: letters for an address, digits and no letters for numbers.
CAN_BE = (r"[^\W\d_]", r"[0-9]", r"^[^A-Za-z]*[0-9][^A-Za-z]*$", r"^[^A-Za-z]*[0-9][^A-Za-z]*$")


def can_be(token: str, kind: int) -> bool:
    return re.search(CAN_BE[kind], token) is not None


def _can_be(token: str, kind: str):
    t = F.col(token)
    return F.when(F.col(kind) == 0, t.rlike(r"\p{L}")).when(F.col(kind) == 1, t.rlike(CAN_BE[1])).otherwise(t.rlike(CAN_BE[2]))


FOUND = "doc_id long, uid string, base array<struct<kind:int,start:long,end:long>>, found array<struct<kind:int,start:long,end:long,token:string,one:string,two:string>>"


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, uid, base spans and instances of every row of docs; uid tells texts apart."""
    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    found_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("token", pa.string()), ("one", pa.string()), ("two", pa.string())]))
    b_names, f_names = ("kind", "start", "end"), ("kind", "start", "end", "token", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES):
            uid, base, found = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                own = base_spans(text)
                inst = instances(text, own)
                uid.append(_uid(text) if inst else "")
                base.append([dict(zip(b_names, s, strict=True)) for s in own])
                found.append([dict(zip(f_names, s, strict=True)) for s in inst])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(uid, pa.string()), pa.array(base, base_type), pa.array(found, found_type)], ["doc_id", "uid", "base", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def _by_pattern(rows: DataFrame, of_pattern: DataFrame, *own: str) -> DataFrame:
    """rows joined to what each pattern has (a staged table, a row a pattern).

    Few patterns are broadcast. More are joined by a shuffle, a common pattern's rows dealt by a
    hash of their own columns.
    """
    if of_pattern.count() <= BROADCAST_PATTERNS:
        return rows.join(F.broadcast(of_pattern), "pattern")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int"))
    every = of_pattern.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(every.hint("merge"), ["pattern", "salt"]).drop("salt")


def patterns(rows: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """pattern, kind, confidence of the patterns that pass; rows is what `extracted` gives, staged.

    Rows without instances, as of null or empty texts, teach nothing; repeated ones teach once; an
    empty table gives no pattern. Of kinds that tie, the first of KINDS is taken.
    """
    each = rows.filter(F.size("found") > 0).select(F.explode("found").alias("f"))
    each = each.select(F.col("f.kind").alias("kind"), F.col("f.token").alias("token"), F.explode(F.array(F.concat(F.lit("1 "), "f.one"), F.concat(F.lit("2 "), "f.two"))).alias("pattern"))
    edges = staged(each.filter(F.length("pattern") > 2).groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "pii-edges")
    done = [edges]
    for _ in range(GENERATIONS):
        good, learned = _scored(edges, rounds, min_confidence, min_seeds)
        done += [good, learned]
        if learned.isEmpty():
            break
        # what the patterns have found seeds further ones
        edges = staged(edges.join(learned, "token", "left").select("pattern", "token", F.greatest("kind", F.coalesce("learned", F.lit(-1))).alias("kind")), "pii-edges")
        done.append(edges)
    for table in done:
        if table is not good:
            drop_staged(table)
    return good


def _scored(edges: DataFrame, rounds: int, min_confidence: float, min_seeds: int) -> tuple[DataFrame, DataFrame]:
    """The patterns that pass, and token, learned (a kind) of the tokens that they add to the seeds."""
    # only patterns that matched a seed can score now, and only tokens they touch
    live = edges.groupBy("pattern").agg(F.count_if(F.col("kind") >= 0).alias("seeds")).filter("seeds > 0").select("pattern")
    live = staged(live, "pii-live")
    edges = staged(_by_pattern(edges, live, "token"), "pii-live-edges")
    done = [live, edges]
    score = edges.filter("kind >= 0").select("token", F.lit(1.0).alias("score")).distinct()
    confidence = None
    for _ in range(rounds):
        confidence = edges.join(score, "token", "left").groupBy("pattern").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("confidence"))
        confidence = staged(confidence, "pii-confidence")
        doubt = _by_pattern(edges, confidence, "token").groupBy("token").agg(
            F.max("kind").alias("kind"), F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))).alias("doubt")
        )
        score = staged(doubt.select("token", F.when(F.col("kind") >= 0, 1.0).otherwise(1 - F.exp("doubt")).alias("score")), "pii-scores")
        done += [confidence, score]
    seeds = edges.filter("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    kinds = seeds.groupBy("pattern").agg(F.sum("n").alias("all"), F.max("n").alias("seeds"), F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind"))
    pure = F.col("seeds") >= min_confidence * F.col("all")  # a context of several kinds names none
    good = confidence.join(kinds, "pattern").filter((F.col("confidence") >= min_confidence) & (F.col("seeds") >= min_seeds) & pure).select("pattern", "kind", "confidence")
    good = staged(good, "pii-good")
    hit = _by_pattern(edges.filter("kind < 0").select("pattern", "token"), good.withColumnRenamed("kind", "learned"), "token").filter(_can_be("token", "learned"))
    hit = hit.groupBy("token").agg(F.max_by("learned", F.struct("confidence", -F.col("learned"))).alias("learned"))
    sure = score.filter(F.col("score") >= min_confidence).select("token")
    learned = staged(hit.join(sure, "token", "left_semi"), "pii-learned")
    for table in done:
        drop_staged(table)
    return good, learned


MORE = "array<struct<kind:int,start:long,end:long>>"


def _hits(rows: DataFrame, good: DataFrame) -> DataFrame:
    """hit (a uid) and more: the spans that the patterns give to a text's unseen tokens."""
    unseen = rows.filter(F.exists("found", lambda f: f["kind"] < 0)).groupBy("uid").agg(F.first("found").alias("found"))
    unseen = unseen.select("uid", F.explode(F.filter("found", lambda f: f["kind"] < 0)).alias("f"))
    unseen = unseen.select("uid", "f.start", "f.end", "f.token", F.explode(F.array(F.concat(F.lit("1 "), "f.one"), F.concat(F.lit("2 "), "f.two"))).alias("pattern"))
    hits = _by_pattern(unseen, good, "uid", "start").filter(_can_be("token", "kind"))
    hits = hits.groupBy("uid", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    return hits.groupBy("uid").agg(F.collect_list(F.struct(F.col("kind"), F.col("start"), F.col("end"))).alias("more")).withColumnRenamed("uid", "hit")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, uid, base and spans (arrays of kind, start, end by kind then start) of every row.

    A null or empty text has none; equal texts have equal spans; an empty table gives no rows;
    other columns of docs are not read.
    """
    rows = staged(extracted(docs), "pii-rows")
    hits = _hits(rows, patterns(rows))
    # texts without any instance, most of a corpus, need no join
    plain = rows.filter(F.size("found") == 0).select("doc_id", "uid", "base", F.col("base").alias("spans"))
    out = rows.filter(F.size("found") > 0).join(hits, F.col("uid") == F.col("hit"), "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(MORE))))
    return plain.unionByName(out.select("doc_id", "uid", "base", every.alias("spans")))


def _said(column: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans as text, of every row that `spans` gives.

    A null doc_id stays null; a row without spans has counts of 0, the digest of nothing and an empty
    text; repeated rows repeat; an empty table gives no rows; other columns are not read.
    """
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_said("base"), 256).alias("base_sha256"), _said("spans").alias("spans"))


def _uid(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=12).hexdigest()


def _marked(text: str, found: list[tuple[int, int, int]]) -> str:
    """text with each (kind, start, end) replaced by its kind."""
    parts, last = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in found):
        if a >= last:  # spans of two kinds may overlap: the first keeps its mark
            parts += [text[last:a], f"<{KINDS[kind].upper()}>"]
        last = max(last, b)
    return "".join([*parts, text[last:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of `spans` replaced by its kind in angle brackets; other columns as they are.

    The patterns are learned in a first pass and carried to a second, so no text is shuffled.
    Where more than BROADCAST_PATTERNS pass, the spans are joined to the texts by their hash. A
    null or empty text stays as it is; repeated rows get equal texts; an empty table stays empty.
    """
    rows = staged(extracted(docs), "pii-rows")
    good = staged(patterns(rows), "pii-patterns")
    names, at = docs.columns, docs.columns.index("text")
    if good.count() > BROADCAST_PATTERNS:
        return _redacted_by_join(docs, _hits(rows, good))
    known = docs.sparkSession.sparkContext.broadcast({r["pattern"]: (r["confidence"], -r["kind"]) for r in good.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in chunks(batches, CHUNK_BYTES):
            out = []
            for text in batch.column("text").to_pylist():
                own = base_spans(text) if text else []
                found = list(own)
                for kind, a, b, token, one, two in instances(text, own) if table and text else ():
                    if kind < 0 and (hits := [table[p] for p in (f"1 {one}", f"2 {two}") if p in table and can_be(token, -table[p][1])]):
                        found.append((-max(hits)[1], a, b))
                out.append(_marked(text, found) if found else text)
            columns = batch.columns
            columns[at] = pa.array(out, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def _redacted_by_join(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """As `redacted`, with the spans of hits (hit, more), which may be any number."""
    names, at = docs.columns, docs.columns.index("text")
    own_uid, own_hit, own_more = free_names(docs, "pii_uid", "pii_hit", "pii_more")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES):
            uid = [_uid(t) if t else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(uid, pa.string())], [*names, own_uid])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES):
            out = []
            for text, more in zip(batch.column("text").to_pylist(), batch.column(own_more).to_pylist(), strict=True):
                found = (base_spans(text) if text else []) + [(m["kind"], m["start"], m["end"]) for m in more or ()]
                out.append(_marked(text, found) if found else text)
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(out, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    own = docs.mapInArrow(keyed, StructType([*docs.schema.fields, StructField(own_uid, StringType())]))
    joined = own.join(hits.select(F.col("hit").alias(own_hit), F.col("more").alias(own_more)), F.col(own_uid) == F.col(own_hit), "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], own_more).mapInArrow(run, docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return digest(spans(spark.read.parquet(f"{sf_dir}/documents.parquet")))
