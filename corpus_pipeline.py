"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents. SQL can't express language models or SimHash, so there is no
ORACLE_SQL; tests/llm/test_pipeline.py holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.llm import byte_bpe, langid, mixing, pii, simhash
from ranklake.llm.common import drop_staged, staged

#: A document's language must hold this share of its probability.
MIN_LANGUAGE_SHARE = 0.5
#: Words of a shingle in the near-duplicate stage, and the similarity from which texts are linked.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those no language claims for the most part.

    Null and empty texts go; rows without a lang teach nothing but are judged; repeated rows stay
    or go together; an empty table stays empty; further columns pass through.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, table = langid.fit(labelled)
    return langid.accepted(docs, langs, table, MIN_LANGUAGE_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each group of near-duplicates.

    Null, empty and wordless texts are one group; rows that share a doc_id leave one; rows without a
    doc_id go after those with one; an empty table stays empty; further columns pass through.
    """
    return simhash.deduplicated(docs, SHINGLE_WORDS, similarity=SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; n_chars follows the text.

    Every row stays; a null text stays null; repeated rows get equal texts; an empty table stays
    empty; further columns pass through.
    """
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times.

    Texts without words go; a null source is a source of its own; rows that repeat a doc_id are
    taken alike; an empty table stays empty; further columns pass through.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    A null text is an empty one, without ids; repeated rows repeat; an empty table gives no rows;
    further columns are not read.
    """
    return byte_bpe.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("byte_bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table is dropped once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
