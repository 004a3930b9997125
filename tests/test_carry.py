from __future__ import annotations

import random

import pytest
from helpers import plan, rows, sort_rows
from pyspark.sql import functions as F

from tallymark.operators.carry import carry_forward, int_steps


def brute(data, leading=None):
    """data: (order..., value); nulls last in every order column."""
    ordered = sorted(data, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r[:-1]))
    out, last = [], leading
    for r in ordered:
        last = last if r[-1] is None else r[-1]
        out.append((*r[:-1], last))
    return sort_rows(out)


def table(seed, groups, n, known=0.1, start=0):
    rng = random.Random(seed)
    keys = {(rng.choice(groups), rng.choice([1, 2, 3, None]), i) for i in range(n)}
    return [(*k, f"v{k[2]}" if k[2] >= start and rng.random() < known else None) for k in keys]


@pytest.mark.parametrize("seed", range(4))
def test_path_equals_global_window(spark, seed):
    data = table(seed, [0, 0, 0, 1, 2, 5, None], 300, start=40)
    df = spark.createDataFrame(data, "a int, b int, c int, v string")
    order = ["a", "b", "c"]
    expected = brute(data, "0")
    for path in ([F.col("a")], [F.col("a"), F.col("b")], [F.col("a"), F.col("b"), F.col("c")]):
        assert rows(carry_forward(df, "v", order, path, "0")) == expected
    assert rows(carry_forward(df, "v", order, leading="0", buckets=7)) == expected


def test_nothing_known(spark):
    data = [(i % 3, i, i, None) for i in range(20)]
    df = spark.createDataFrame(data, "a int, b int, c int, v string")
    assert rows(carry_forward(df, "v", ["a", "b", "c"], [F.col("a")])) == sort_rows(data)
    assert set(rows(carry_forward(df, "v", ["a", "b", "c"], [F.col("a")], "0"), "v")) == {("0",)}


def test_one_bucket_holds_all(spark):
    data = [(1, 1, i, f"v{i}" if i % 97 == 5 else None) for i in range(1000)]
    df = spark.createDataFrame(data, "a int, b int, c int, v string")
    got = carry_forward(df, "v", ["a", "b", "c"], buckets=16)
    assert rows(got) == brute(data)


def test_int_steps_rise_with_the_number(spark):
    numbers = [0, 1, 1023, 1024, 2**20, 2**20 + 1, 2**39, 2**41, 2**62 + 5]
    df = spark.createDataFrame([(n, f"x{n}" if n in (1, 2**20) else None) for n in numbers], "k bigint, v string")
    steps = df.select("k", *[s.alias(f"s{i}") for i, s in enumerate(int_steps(F.col("k")))]).orderBy("k").collect()
    assert [tuple(r)[1:] for r in steps] == sorted(tuple(r)[1:] for r in steps)
    got = {r["k"]: r["f"] for r in carry_forward(df, "v", ["k"], int_steps(F.col("k")), "0", out="f").collect()}
    assert got == {0: "0", 1: "x1", 1023: "x1", 1024: "x1", 2**20: f"x{2**20}", 2**20 + 1: f"x{2**20}", 2**39: f"x{2**20}",
                   2**41: f"x{2**20}", 2**62 + 5: f"x{2**20}"}


def test_steps_of_large_numbers_are_few(spark):
    df = spark.range(2000).selectExpr("id * (1L << 41) as k")
    steps = int_steps(F.col("k"))
    assert df.select(steps[0].alias("s")).distinct().count() <= 2**10


def test_rows_never_meet_in_one_partition(spark, tmp_path):
    data = table(1, [0, 1, 2], 200)
    spark.createDataFrame(data, "a int, b int, c int, v string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    text = plan(carry_forward(df, "v", ["a", "b", "c"], [F.col("a"), F.col("b")]))
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            # Its input is an aggregate per bucket of the first step.
            below = "".join(lines[i:i + 6])
            assert "Aggregate" in below and "FileScan" not in below
