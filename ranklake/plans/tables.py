"""Benchmark tables read as competition tables, so that every operator runs on whole public tables.

A lineitem is a result, its order the list; customers are people, suppliers clubs' members, orders
reviewed documents. The same mapping stands as SQL in `R`, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("Damen 21 Elite", "Herren 21 Elite", "Herren ab 35", "Familie", "H-14", "D21 Kurz")
KINDS = ("individual", "individual", "relay", "pair", "family", "team")
ELIGIBILITY = ("eligible", "provisional", "unknown", "ineligible")
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], key: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({key} % {len(values)} as int) + 1)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = f"row_number() over (partition by l_orderkey order by {', '.join(ORDER)})"
    return (
        read(spark, sf_dir, "lineitem")
        .withColumn("seq", F.expr(seq).cast("long"))
        .selectExpr(
            "l_orderkey * 1000 + seq as result_id",
            "seq",
            "l_orderkey as list_id",
            "l_orderkey div 8 as stage_id",
            "l_orderkey div 32 as event_id",
            "l_orderkey div 2 as document_id",
            f"{_pick(CATEGORIES, 'l_partkey')} as category",
            "l_suppkey as person_id",
            "concat('Club ', cast(l_partkey % 20 as string)) as club",
            "case when l_returnflag = 'A' then 'ok' when l_returnflag = 'N' then if(l_linenumber % 2 = 0, 'ok', 'dnf') else if(l_partkey % 3 <> 0, 'ok', 'mp') end as status",
            "case when l_linenumber % 3 <> 0 then l_linenumber end as rank",
            "cast(l_quantity as int) as time_s",
            "l_tax > 0.07 as out_of_competition",
            f"{_pick(KINDS, 'l_suppkey')} as result_kind",
            "case when l_partkey % 4 = 0 then cast(l_partkey % 9 as string) end as team_number",
            "case when l_partkey % 3 = 0 then concat('Team ', cast(l_partkey % 11 as string)) end as team_name",
            "case when l_linestatus = 'F' and l_partkey % 5 = 0 then 'ÖM' end as championship",
            f"{_pick(ELIGIBILITY, 'l_suppkey')} as eligibility",
            "if(l_orderkey % 5 = 0, 'api', 'html') as source",
            "cast(l_shipdate as date) as day",
        )
    )


def _sql_pick(values: tuple[str, ...], key: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({key} % {len(values)} AS INT) + 1)"


#: The same rows for DuckDB, as the head of a query.
R = f"""
WITH r AS (
  SELECT l_orderkey * 1000 + seq AS result_id, seq, l_orderkey AS list_id, l_orderkey // 8 AS stage_id, l_orderkey // 32 AS event_id, l_orderkey // 2 AS document_id,
    {_sql_pick(CATEGORIES, 'l_partkey')} AS category, l_suppkey AS person_id, 'Club ' || (l_partkey % 20)::VARCHAR AS club,
    CASE WHEN l_returnflag = 'A' THEN 'ok' WHEN l_returnflag = 'N' THEN (CASE WHEN l_linenumber % 2 = 0 THEN 'ok' ELSE 'dnf' END) ELSE (CASE WHEN l_partkey % 3 <> 0 THEN 'ok' ELSE 'mp' END) END AS status,
    CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END AS rank, l_quantity::INT AS time_s, l_tax > 0.07 AS out_of_competition,
    {_sql_pick(KINDS, 'l_suppkey')} AS result_kind, CASE WHEN l_partkey % 4 = 0 THEN (l_partkey % 9)::VARCHAR END AS team_number,
    CASE WHEN l_partkey % 3 = 0 THEN 'Team ' || (l_partkey % 11)::VARCHAR END AS team_name,
    CASE WHEN l_linestatus = 'F' AND l_partkey % 5 = 0 THEN 'ÖM' END AS championship, {_sql_pick(ELIGIBILITY, 'l_suppkey')} AS eligibility,
    CASE WHEN l_orderkey % 5 = 0 THEN 'api' ELSE 'html' END AS source, l_shipdate::DATE AS day
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS seq FROM lineitem)
)"""
