"""The library's input shapes on the TPC-H-like test tables.

``assessment``  test records of several years, nulls injected
``formatted``   records with a prior score and flags
``listed``      keys of the disadvantaged, repeated
``student``     demographics already classified, nulls injected

Each column is one expression that both Spark and DuckDB read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COMPOSITE = (
    "case when l_linenumber = 7 then null else "
    "(10 + cast(floor((l_quantity - 1) * (o_custkey % 5 + 1) / 5e0) as bigint)) / 10e0 end"
)
LITERACY = "case when l_linenumber = 6 then null else (10 + cast(floor(l_extendedprice) as bigint) % 50) / 10e0 end"
TIE_BREAK = ["k1", "k2", "k3", "k4"]
TIES = {"k1": "l_orderkey", "k2": "l_linenumber", "k3": "l_partkey", "k4": "l_extendedprice"}

ASSESSMENT = {
    "id": "o_custkey",
    "year": "cast(year(o_orderdate) as int)",
    "grade": "case when o_custkey % 2 = 0 then o_custkey % 6 + (year(o_orderdate) - 1995) else o_custkey % 13 end",
    "pl_comp": COMPOSITE,
    "pl_lit": LITERACY,
    "district": "concat('TN', cast(s_nationkey as varchar(9)))",
    "system": "s_nationkey",
    "school": "l_suppkey",
    **TIES,
}
FORMATTED = {
    "id": "o_custkey",
    "system": "s_nationkey",
    "school": "l_suppkey",
    "literacy": LITERACY,
    "composite": COMPOSITE,
    "prior_level": LITERACY,
    "prior_composite": "case when l_partkey % 9 = 0 then null else (10 + l_partkey % 50) / 10e0 end",
    "white": "case when o_custkey % 2 = 0 then 'Y' end",
    "asian": "case when o_custkey % 5 = 0 then 'N' end",
    "pacific_islander": "case when o_custkey % 17 = 0 then 'Y' end",
    "american_indian": "case when o_custkey % 13 = 0 then 'Y' end",
    "black": "case when l_partkey % 3 = 0 then 'Y' end",
    "hispanic": "case when o_custkey % 7 = 0 then 'H' end",
    "primary_disability": "case when o_custkey % 8 = 0 then '05' end",
    **TIES,
}
STUDENT = {
    "id": "c_custkey",
    "race_ethnicity": "case when c_custkey % 11 = 0 then null else c_mktsegment end",
    "ed": "c_acctbal < 2000",
    "el": "c_nationkey < 15",
    "swd": "case when c_custkey % 7 = 0 then null else c_custkey % 3 = 0 end",
}
# The values standing in for the three races of the combined subgroup.
COMBINED = ["AUTOMOBILE", "BUILDING", "FURNITURE"]


def _columns(view: dict[str, str]) -> str:
    return ", ".join(f"{e} as {c}" for c, e in view.items())


_RECORDS = "lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey"
ASSESSMENT_SQL = f"assessment as (select {_columns(ASSESSMENT)} from {_RECORDS})"
FORMATTED_SQL = f"formatted as (select {_columns(FORMATTED)} from {_RECORDS})"
STUDENT_SQL = f"student as (select {_columns(STUDENT)} from customer)"
LISTED_SQL = "listed as (select o_custkey as student_key from orders where o_orderstatus = 'F')"
YEAR_MAX_SQL = (
    "year_max as (select id, year, cast(min(grade) as double) as grade, "
    "coalesce(max(pl_comp), cast('-infinity' as double)) as pl_comp from assessment group by id, year)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, view: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(c) for c, e in view.items()])


def _records(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
    )


def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_records(spark, sf_dir), ASSESSMENT)


def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_records(spark, sf_dir), FORMATTED)


def student(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "customer"), STUDENT)


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("STUDENT_KEY"))
    )


# SQL text of the rules, for the oracles: values written out, not taken from the library.

def band_sql(x: str) -> str:
    return (
        f"case when {x} >= 1e0 and {x} < 1.5e0 then '1.0-1.4' when {x} >= 1.5e0 and {x} < 2e0 then '1.5-1.9' "
        f"when {x} >= 2e0 and {x} < 2.5e0 then '2.0-2.4' when {x} >= 2.5e0 and {x} < 3e0 then '2.5-2.9' "
        f"when {x} >= 3e0 and {x} < 3.5e0 then '3.0-3.4' when {x} >= 3.5e0 and {x} < 4e0 then '3.5-3.9' "
        f"when {x} >= 4e0 and {x} < 4.5e0 then '4.0-4.4' when {x} >= 4.5e0 and {x} < 5e0 then '4.5-4.9' end"
    )


def standard_sql(prior: str, valid: str) -> str:
    return (
        f"case when not ({valid}) then null when {prior} <= 1.4e0 then 1.3e0 "
        f"when {prior} between 1.5e0 and 1.9e0 then 0.7e0 when {prior} between 2.0e0 and 2.4e0 then 0.8e0 "
        f"when {prior} between 2.5e0 and 2.9e0 then 0.7e0 when {prior} between 3.0e0 and 3.4e0 then 0.4e0 "
        f"when {prior} between 3.5e0 and 3.9e0 then 0.5e0 when {prior} >= 4e0 then 0.4e0 end"
    )


def points_sql(pct: str, n: str) -> str:
    return (
        f"cast(case when {n} < 10 then null when {pct} < 25 then 0 when {pct} < 40 then 1 "
        f"when {pct} < 50 then 2 when {pct} < 60 then 3 when {pct} >= 60 then 4 end as integer)"
    )


def rate_sql(num: str, den: str) -> str:
    return f"round_even(100e0 * ({num}) / nullif({den}, 0), 1)"


def count_sql(flag: str, weight: str = "1") -> str:
    return f"cast(coalesce(sum(case when {flag} then {weight} else 0 end), 0) as bigint)"
