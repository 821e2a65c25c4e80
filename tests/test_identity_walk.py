"""Names are walked through within a task, whatever batches their rows come in, and without a frame for each name."""

from pyspark.sql import functions as F

from ranklake.operators.identity import resolved


def test_names_go_on_over_batches_without_a_frame_each(spark, monkeypatch):
    kind = type(spark.range(1).groupBy("id"))
    monkeypatch.setattr(kind, "applyInPandas", lambda *_, **__: (_ for _ in ()).throw(AssertionError("a frame for each name")))
    rows = spark.range(600).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 50 != 49, F.concat(F.lit("n"), (F.col("id") % 20).cast("string"))).alias("name_key"), F.when(F.col("id") % 3 != 0, 1950 + F.col("id") % 7).cast("int").alias("birth_year"),
        F.when(F.col("id") % 11 == 0, F.col("id") % 40 + 1).alias("user_id"), F.lit(None).cast("long").alias("registry_id"), F.lit(None).cast("string").alias("basis"),
    )
    cols = ["seq", "person_id", "identity_state", "identity_confidence"]
    whole = sorted(map(tuple, resolved(rows).select(*cols).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, resolved(rows).select(*cols).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # the first named row of a name without any id is a candidate of its own; a direct id is certain
    by = {r[0]: r for r in whole}
    assert len(by) == 600 and by[1][2] == "candidate" and by[1][1] < 0 and by[11][1:] == (12, "resolved", 1.0)
