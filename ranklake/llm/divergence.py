"""Quality rules with distribution divergence, in DataFrame functions only.

Two histograms of a document are held against those of its language: how its characters spread
over six classes, and how its words spread over the language's common words. Both use the
Jensen-Shannon distance (base 2, so 0 to 1). Short documents have noisy histograms: below
`min_words` words the method gives no verdict.

The references are counted over all documents. A common word occurs more than once and holds at
least `share` of all words of its language, so a language has at most 1 / share of them. Every
language of MIN_REFERENCE words or more has a reference, whatever share of the corpus it holds; one
without common words (written without spaces, say) has that of its characters alone. References
are broadcast up to BROADCAST_LANGS languages, and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, staged

SHARE = 0.005
#: A language of fewer words has no reference: its own documents would be most of it.
MIN_REFERENCE = 10_000
#: Up to this many languages' references (some 4 KB each) are broadcast.
BROADCAST_LANGS = 1_000
#: Documents with fewer words get no verdict from the divergence.
MIN_WORDS = 50
#: Largest distances of a kept document.
MAX_CHARS = 0.27
MAX_COMMON = 0.42
#: Up to this many common words of all languages make a first, hashed test.
PREFILTER = 5_000
CLASSES = ("lower", "upper", "digit", "space", "mark", "other")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def _windows(hashed: Column) -> Column:
    """A 64-bit hash of each 3-word window, in order, from the words' hashes."""
    whole = F.transform(hashed, lambda x, i: F.xxhash64(x, F.get(hashed, i + 1), F.get(hashed, i + 2)))
    return F.when(F.size(hashed) >= 3, F.slice(whole, F.lit(1), F.size(hashed) - 2)).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, words and the base counts of every document (null text: empty).

    Every row stays: a null lang or doc_id stays null, repeated rows repeat, a text without words
    has counts of 0; an empty table gives no rows; other columns are not read.
    """
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # each step strips one class from what is left, so only the first pass sees the whole text
    out = out.withColumn("left1", F.regexp_replace("text", r"\p{Ll}+", ""))
    out = out.withColumn("left2", F.regexp_replace("left1", GAP, ""))
    out = out.withColumn("left3", F.regexp_replace("left2", r"\p{Lu}+", ""))
    out = out.withColumn("left4", F.regexp_replace("left3", r"\p{Nd}+", ""))
    out = out.withColumn("left5", F.regexp_replace("left4", r"\p{P}+", ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        "doc_id",
        "lang",
        _words(F.col("text")).alias("words"),
        lines.alias("lines"),
        *[F.length(x).alias(f"n{i}") for i, x in enumerate(("text", "left1", "left2", "left3", "left4", "left5"))],
        (F.length("left4") - F.length(F.regexp_replace("left4", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    out = out.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    out = out.withColumn("windows", _windows(F.col("hashed"))).drop("hashed")
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    empty = F.array().cast("array<struct<w:bigint,i:int>>")
    placed = F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(empty)).drop("windows")
    s = F.col("sorted")
    same = lambda x, j: ((j > 0) & (F.get(s, j - 1)["w"] == x["w"])) | F.coalesce(F.get(s, j + 1)["w"] == x["w"], F.lit(False))
    out = out.withColumn("at", F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))).drop("sorted")
    at = F.col("at")
    spread = F.aggregate(
        F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x
    )
    out = out.withColumn("n_repeat_words", spread.cast("long")).drop("at")
    n = [F.col(f"n{i}") for i in range(6)]
    counts = [n[0] - n[1], n[2] - n[3], n[3] - n[4], n[1] - n[2], n[4] - n[5], n[5]]
    return out.select(
        "doc_id",
        "lang",
        "words",
        F.size("words").cast("long").alias("n_words"),
        (n[0] - (n[1] - n[2])).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.array(*[c.cast("double") for c in counts]).alias("chars"),
    )


def references(docs: DataFrame, share: float = SHARE, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """lang, common (word to share; null without common words) and chars (6 sums) of each language, over all documents.

    Rows without a lang or text are in no reference; repeated rows count as often as they come; an
    empty table gives no reference.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.select("lang", F.length("text").alias("chars"), _words(F.col("text")).alias("words"))
    # a text's white space rides along as one more word, a blank and its length: texts are read once, and
    # classes of characters are counted in distinct words
    gap = F.concat(F.lit(" "), (F.col("chars") - F.length(F.array_join("words", ""))).cast("string"))
    counted = rows.select("lang", F.explode(F.array_append("words", gap)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    is_gap = F.col("word").startswith(" ")
    sized = counted.withColumn("n0", F.length("word")).withColumn("a", F.regexp_replace("word", r"\p{Ll}+", ""))
    for i, pattern in enumerate((r"\p{Lu}+", r"\p{Nd}+", r"\p{P}+"), 1):
        sized = sized.withColumn(f"n{i}", F.length("a")).withColumn("a", F.regexp_replace("a", pattern, ""))
    n = [F.col(f"n{i}") for i in range(4)]
    last = F.length("a")
    spaces = F.when(is_gap, F.trim("word").cast("long")).otherwise(0)
    counts = [n[0] - n[1], n[1] - n[2], n[2] - n[3], spaces, n[3] - last, last]
    per_class = [F.sum((c if i == 3 else F.when(is_gap, 0).otherwise(c)) * F.col("n")).cast("double").alias(f"c{i}") for i, c in enumerate(counts)]
    # words that occur once are in no list: they are one row of a language
    named = F.when(~is_gap & (F.col("n") > 1), F.col("word")).alias("word")
    counted = staged(sized.groupBy("lang", named).agg(F.sum(F.when(~is_gap, F.col("n")).otherwise(0)).alias("n"), *per_class), "divergence-words")
    sums = counted.groupBy("lang").agg(F.sum("n").alias("total"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(6)])
    sums = staged(sums.filter(F.col("total") >= min_reference).select("lang", "total", F.array(*[F.col(f"c{i}") for i in range(6)]).alias("chars")), "divergence-langs")
    counted = counted.filter(F.col("word").isNotNull()).select("lang", "word", "n")
    total = sums.select("lang", "total")
    common = (
        counted.join(F.broadcast(total) if total.count() <= BROADCAST_LANGS else total, "lang")
        .filter(F.col("n") >= share * F.col("total"))
        .groupBy("lang")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", (F.col("n") / F.col("total")).alias("share"))))).alias("common"))
    )
    return sums.join(common, "lang", "left").select("lang", "common", "chars")


def _term(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence."""
    half = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / half)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def _distance(p: Column, q: Column) -> Column:
    total = F.aggregate(F.zip_with(p, q, _term), F.lit(0.0), lambda a, x: a + x)
    return _root(total)


def _root(total: Column) -> Column:
    """The distance of a divergence that may lie below 0 by rounding; null where it is null, which greatest() would skip."""
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def scored(docs: DataFrame, share: float = SHARE, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """measured() with char_distance and common_distance (null where no reference applies); rows as there."""
    own = staged(references(docs, share, min_reference), "divergence-references")
    few = own.count() <= BROADCAST_LANGS
    # at most 1 / share words of each language: where they are few, words are tested against all of them first
    every = [r["word"] for r in own.select(F.explode(F.map_keys("common")).alias("word")).distinct().limit(PREFILTER + 1).collect()] if few else []
    known = own.select(F.col("lang").alias("known"), F.col("common"), F.col("chars").alias("own_chars"))
    out = measured(docs).join(F.broadcast(known) if few else known, F.col("lang") == F.col("known"), "left")
    names = F.map_keys("common")
    candidates = F.filter("words", lambda w: w.isin(every)) if few and len(every) <= PREFILTER else F.col("words")
    found = F.sort_array(F.filter("candidates", lambda w: F.array_contains(F.col("names"), w)))
    out = out.withColumn("names", names).withColumn("candidates", candidates)
    out = out.withColumn("found", F.when(F.col("known").isNotNull(), found)).drop("words", "candidates")
    out = out.withColumn("each", F.array_distinct("found"))
    out = out.withColumn("first", F.transform("each", lambda w: F.array_position("found", w)))
    first = F.col("first")
    n = F.col("n_words").cast("double")
    p = F.transform(F.col("each"), lambda w, i: (F.coalesce(F.get(first, i + 1), F.size("found").cast("long") + 1) - F.get(first, i)) / n)
    out = out.withColumn("p", p).withColumn("q", F.transform("each", lambda w: F.element_at("common", w)))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    out = out.withColumn("all_q", add(F.map_values("common"))).withColumn("sum_p", add(F.col("p"))).withColumn("sum_q", add(F.col("q")))
    total = (
        add(F.zip_with("p", "q", _term))
        + (F.col("all_q") - F.col("sum_q")) / 2
        + _term(F.greatest(1 - F.col("sum_p"), F.lit(0.0)), F.greatest(1 - F.col("all_q"), F.lit(0.0)))
    )
    out = out.withColumn("common_distance", F.when(F.col("n_words") > 0, _root(total)))
    return out.withColumn("char_distance", _distance(_shares(F.col("chars")), _shares(F.col("own_chars")))).drop(
        "names", "found", "each", "first", "p", "q", "all_q", "sum_p", "sum_q", "common", "known", "own_chars"
    )


def judged(
    docs: DataFrame, max_chars: float = MAX_CHARS, max_common: float = MAX_COMMON, min_words: int = MIN_WORDS, share: float = SHARE, min_reference: int = MIN_REFERENCE
) -> DataFrame:
    """Base counts, base_failed and kept of every row of docs.

    An empty or null text has no words and fails the base rule. A null lang, or one of fewer than
    min_reference words in all, passes the method's rule. Repeated rows get equal verdicts; an empty table
    gives no rows; other columns of docs are not read.
    """
    out = scored(docs, share, min_reference)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = (F.col("n_words") >= min_words) & (
        F.coalesce(F.col("char_distance") > max_chars, F.lit(False)) | F.coalesce(F.col("common_distance") > max_common, F.lit(False))
    )
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def op4(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_sql(min_reference: int = MIN_REFERENCE) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, text IS NULL AS empty FROM documents)
, s AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)
, w AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM s)
, g AS (SELECT rid, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY rid ORDER BY i))
, rep AS (SELECT rid, i FROM g WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1)
, cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) t(k) GROUP BY rid)
, li AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid)
, x AS (SELECT rid, doc_id, lang, empty, text, regexp_replace(text, '\p{{Ll}}+', '', 'g') AS t1 FROM d)
, y AS (SELECT *, regexp_replace(t1, '[\x20\x09-\x0D]+', '', 'g') AS t2 FROM x)
, z AS (SELECT *, regexp_replace(t2, '\p{{Lu}}+', '', 'g') AS t3 FROM y)
, z4 AS (SELECT *, regexp_replace(t3, '\p{{Nd}}+', '', 'g') AS t4 FROM z)
, z5 AS (SELECT *, regexp_replace(t4, '\p{{P}}+', '', 'g') AS t5 FROM z4)
, m AS (SELECT rid, doc_id, lang, empty, length(text) - length(t1) AS c0, length(t2) - length(t3) AS c1, length(t3) - length(t4) AS c2, length(t1) - length(t2) AS c3, length(t4) - length(t5) AS c4, length(t5) AS c5,
    length(text) - (length(t1) - length(t2)) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols FROM z5)
, f AS (SELECT lang, a, count(*) AS n FROM w JOIN d USING (rid) WHERE lang IS NOT NULL GROUP BY ALL)
, t AS (SELECT lang, sum(n) AS total FROM f GROUP BY lang HAVING sum(n) >= {min_reference})
, k AS (SELECT lang, a, n / total AS q FROM f JOIN t USING (lang) WHERE n > 1 AND n >= {SHARE} * total)
, kk AS (SELECT lang, sum(q) AS all_q FROM k GROUP BY lang)
, r AS (SELECT lang, sum(c0) AS r0, sum(c1) AS r1, sum(c2) AS r2, sum(c3) AS r3, sum(c4) AS r4, sum(c5) AS r5, sum(c0 + c1 + c2 + c3 + c4 + c5) AS rt FROM m JOIN t USING (lang) WHERE NOT empty GROUP BY lang)
, nw AS (SELECT rid, len(words) AS n FROM s)
, h AS (SELECT rid, lang, a, count(*) AS n FROM w JOIN d USING (rid) GROUP BY ALL)
, j AS (SELECT h.rid, h.n / nw.n AS p, k.q FROM h JOIN k ON h.lang = k.lang AND h.a = k.a JOIN nw ON nw.rid = h.rid)
, jj AS (SELECT rid, sum(p) AS sp, sum(q) AS sq, sum((p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) / 2) AS v FROM j GROUP BY rid)
, cd AS (SELECT m.rid, sqrt(greatest(v + (all_q - sq) / 2 + CASE WHEN po > 0 THEN po * log2(2 * po / (po + qo)) / 2 ELSE 0 END + CASE WHEN qo > 0 THEN qo * log2(2 * qo / (po + qo)) / 2 ELSE 0 END, 0)) AS dist FROM (
    SELECT m.rid, kk.all_q, coalesce(v, 0) AS v, coalesce(sq, 0) AS sq, greatest(1 - coalesce(sp, 0), 0) AS po, greatest(1 - all_q, 0) AS qo FROM m JOIN kk USING (lang) LEFT JOIN jj USING (rid)) m)
, ch AS (SELECT rid, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS dist FROM (
    SELECT rid, unnest([c0, c1, c2, c3, c4, c5]) / (c0 + c1 + c2 + c3 + c4 + c5) AS p, unnest([r0, r1, r2, r3, r4, r5]) / rt AS q FROM m JOIN r USING (lang) WHERE c0 + c1 + c2 + c3 + c4 + c5 > 0) GROUP BY rid)
, o AS (SELECT m.doc_id, nw.n::BIGINT AS n_words, m.word_chars::BIGINT AS word_chars, m.n_symbols::BIGINT AS n_symbols, coalesce(li.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    nw.n < 50 OR 100 * coalesce(cov.n, 0) > 50 * nw.n AS base_failed, coalesce(ch.dist > {MAX_CHARS}, false) OR coalesce(cd.dist > {MAX_COMMON}, false) AS far
  FROM m JOIN nw USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN li USING (rid) LEFT JOIN cd USING (rid) LEFT JOIN ch USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND far) AS kept FROM o
"""


OP4_SQL = op4_sql()
