from __future__ import annotations

import random

import pytest
from helpers import plan, rows, sort_rows
from pyspark.sql import functions as F

from tallymark.functions.missing import rate, total
from tallymark.operators.subgroups import sorted_values, subgroup_rates, sum_columns, total_rates
from tallymark.plans import reports
from tallymark.plans.reports import LEVELS

SCHEMA = "system int, school int, race string, ed boolean, num boolean, den boolean, w int"
RATES = {"pct": ("n", "valid")}
SUBGROUPS, MEASURES = [], {}


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    """Columns need a session, so the lists are filled once there is one."""
    SUBGROUPS[:] = [
        ("All", F.lit(True)), ("Races", F.col("race").isin("b", "h")), ("ED", F.col("ed")), ("Same", F.lit(True)),
    ]
    MEASURES.update({"n": F.col("num"), "valid": F.col("den")})


def students(spark, n=400, seed=1):
    rng = random.Random(seed)
    data = [
        (rng.choice([0, 0, 0, 0, 1, 2, None]), rng.choice([1, 2, 3, None]), rng.choice(["b", "h", "w", None]),
         rng.choice([True, False, None]), rng.choice([True, False, None]), rng.choice([True, False]), rng.randrange(1, 4))
        for _ in range(n)
    ]
    return spark.createDataFrame(data, SCHEMA)


def by_filters(df, weight=None):
    """One filtered aggregate per level and subgroup, put together."""
    w = None if weight is None else F.col(weight)
    out = []
    for level, keys in LEVELS.items():
        for label, condition in [*SUBGROUPS, *[(v, F.col("race") == v) for v in "bhw"]]:
            part = df.where(condition).groupBy(*keys) if keys else df.where(condition)
            part = part.agg(*[total(m, w).alias(k) for k, m in MEASURES.items()])
            for r in part.withColumn("pct", rate(F.col("n"), F.col("valid"))).collect():
                d = r.asDict()
                out.append((level, d.get("system"), d.get("school"), label, d["n"], d["valid"], d["pct"]))
    return sort_rows(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("weight", [None, "w"])
def test_equal_to_filtered_aggregates(spark, seed, weight):
    df = students(spark, seed=seed)
    got = subgroup_rates(df, SUBGROUPS, MEASURES, RATES, LEVELS, by_value=["race"], weight=weight)
    assert got.columns == ["level", "system", "school", "subgroup", "n", "valid", "pct"]
    assert rows(got) == by_filters(df, weight)


def test_each_level_alone_is_the_same(spark):
    df = students(spark)
    together = subgroup_rates(df, SUBGROUPS, MEASURES, RATES, LEVELS)
    for level, keys in LEVELS.items():
        alone = subgroup_rates(df, SUBGROUPS, MEASURES, RATES, {level: keys})
        assert rows(alone) == rows(together.where(F.col("level") == level), *alone.columns)


def test_empty_subgroups_show_in_the_whole_only(spark):
    df = spark.createDataFrame([(1, 1, "w", False, True, True, 1), (None, None, "w", None, False, True, 1)], SCHEMA)
    got = rows(subgroup_rates(df, SUBGROUPS[:3], MEASURES, RATES, LEVELS))
    assert got == sort_rows([
        ("state", None, None, "All", 1, 2, 50.0), ("state", None, None, "Races", 0, 0, None),
        ("state", None, None, "ED", 0, 0, None),
        ("district", 1, None, "All", 1, 1, 100.0), ("district", None, None, "All", 0, 1, 0.0),
        ("school", 1, 1, "All", 1, 1, 100.0), ("school", None, None, "All", 0, 1, 0.0),
    ])


def test_no_students_at_all(spark):
    df = students(spark).where("false")
    got = rows(subgroup_rates(df, SUBGROUPS, MEASURES, RATES, LEVELS))
    assert got == sort_rows([("state", None, None, label, 0, 0, None) for label, _ in SUBGROUPS])
    assert rows(total_rates(df, MEASURES, RATES)) == [(0, 0, None)]
    assert rows(subgroup_rates(df, SUBGROUPS, MEASURES, RATES, {"school": ["system", "school"]})) == []


def test_levels_must_nest(spark):
    with pytest.raises(ValueError):
        subgroup_rates(students(spark), SUBGROUPS, MEASURES, RATES, {"a": ["school"], "b": ["system", "school"]})


def test_students_are_read_once(spark, tmp_path):
    students(spark).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    text = plan(subgroup_rates(df, SUBGROUPS, MEASURES, RATES, LEVELS))
    assert text.count("FileScan") == 1
    assert text.count("Exchange") == 2
    # Only sums are repeated per subgroup and level.
    lines = text.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    aggregate = max(i for i, line in enumerate(lines[:scan]) if "partial_sum" in line)
    repeats = [i for i, line in enumerate(lines[:scan]) if "Expand" in line or "Generate" in line]
    assert len(repeats) == 2 and max(repeats) < aggregate


def test_state_points(spark):
    df = spark.createDataFrame([(i < 5, True) for i in range(10)], "numerator boolean, denominator boolean")
    assert tuple(reports.state_points(df, weight=None).first()) == (5, 10, 50.0, 3)
    few = df.limit(9)
    assert reports.state_points(few, weight=None).first()["points"] is None


def test_sum_columns_and_values(spark):
    df = spark.createDataFrame([(1, True, 2), (1, None, 3), (2, False, None)], "k int, n_a boolean, n_b int")
    assert rows(sum_columns(df, ["k"], ["n_a", "n_b"])) == [(1, 1, 5), (2, 0, 0)]
    values = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "race string")
    assert [r[0] for r in sorted_values(values, "race").collect()] == ["a", "b"]


def test_more_subgroups_than_bits(spark):
    df = spark.range(200).selectExpr("cast(id as int) as id", "id % 2 = 0 as even")
    groups = [(f"g{i}", F.col("id") % 130 == i) for i in range(130)]
    got = subgroup_rates(df, groups, {"n": F.lit(1), "n_even": F.col("even")}, {"pct": ("n_even", "n")}, {"all": []})
    found = {r["subgroup"]: (r["n"], r["n_even"]) for r in got.collect()}
    assert found == {f"g{i}": (2, 2 - 2 * (i % 2)) if i < 70 else (1, 1 - i % 2) for i in range(130)}
