"""What every operator must bear: nulls, empty and long texts, repeated rows, an empty table, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from ranklake.llm import registry

LONG = "word and another " * 20_000 + "x" * 50_000
ROWS = [
    (1, "Ein Text, der kurz ist.", "de", "a"),
    (1, "Ein Text, der kurz ist.", "de", "a"),
    (2, None, "en", None),
    (3, "", None, "b"),
    (None, "a text without an id", "en", "b"),
    (None, None, None, None),
    (4, LONG, "en", "a"),
    (5, "tail\x00 and ü 日本   \x1c end", "en", "c"),
]
CLASH = ("size", "hash", "copies", "fp", "node", "key", "words", "score", "lang_pred", "kept", "marks", "tie", "uid", "base", "media", "n_bytes", "held_out", "shard", "target", "level", "text_hash", "least_id", "least_hash", "component", "shared", "of", "of_tie", "bucket", "hit", "found", "mix_size", "mix_copies", "_stays", "_lang_pred", "_pii_uid")


#: Operators of other tables than documents have awkward tables of their own.
OTHER = {"op11_whitening", "op13_warc"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - OTHER))
def test_any_rows(spark, make, tmp_path, name):
    docs = make(ROWS)
    docs.write.parquet(f"{tmp_path}/plain/documents.parquet")
    wide = docs
    for i, c in enumerate(CLASH):
        wide = wide.withColumn(c, F.lit(None).cast("string") if i % 2 else F.lit(i))
    wide.write.parquet(f"{tmp_path}/wide/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = [sorted(map(str, registry.QUERIES[name](spark, f"{tmp_path}/{k}").collect())) for k in ("plain", "wide", "none")]
    assert len(got[0]) == len(ROWS)
    assert got[0] == got[1]
    assert got[2] == []
