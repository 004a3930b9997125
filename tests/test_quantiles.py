from __future__ import annotations

import math
import random

import pytest
from helpers import r_quantile, rows, sort_rows
from hypothesis import given, settings, strategies as st

from tallymark.operators import quantiles
from tallymark.operators.quantiles import exact_quantiles, percentile_quantiles

PROBS = {"median": 0.5, "p60": 0.6, "p70": 0.7}


def expected(data):
    out = []
    for g in {r[0] for r in data}:
        values = [v for k, v in data if k == g]
        out.append((g, *[r_quantile(values, p) for p in PROBS.values()], len(values)))
    return sort_rows(out)


def frame(spark, data):
    return spark.createDataFrame(data, "g string, x double")


@settings(max_examples=12, deadline=None)
@given(st.lists(
    st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-20, 20).map(lambda i: i / 10))),
    min_size=1, max_size=60,
))
def test_small_groups(spark, data):
    assert rows(exact_quantiles(frame(spark, data), ["g"], "x", PROBS)) == expected(data)


def test_missing_and_infinite_values(spark):
    data = [("a", None), ("a", math.nan), ("b", -math.inf), ("b", 1.0), ("b", None), ("c", math.inf), ("c", math.inf)]
    assert rows(exact_quantiles(frame(spark, data), ["g"], "x", PROBS)) == expected(data)


@pytest.mark.parametrize("task_values", [3, 50, 400])
def test_slices_give_the_same(spark, task_values):
    rng = random.Random(11)
    data = [("hot", rng.choice([0.5, rng.random()])) for _ in range(3000)]
    data += [("few", rng.randrange(5) / 2) for _ in range(100)] + [(None, rng.gauss(0, 1)) for _ in range(900)]
    data += [("empty", None)] * 7
    assert rows(exact_quantiles(frame(spark, data), ["g"], "x", PROBS, task_values)) == expected(data)


def test_narrowing_drops_most_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SLICES", 8)
    data = [("a", i / 7) for i in range(4000)]
    assert rows(exact_quantiles(frame(spark, data), ["g"], "x", PROBS, 20)) == expected(data)


def test_two_group_columns(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, None, 5.0)], "g int, h string, x double")
    got = exact_quantiles(df, ["g", "h"], "x", {"m": 0.5})
    assert rows(got) == sort_rows([(1, "a", 1.5, 2), (1, None, 5.0, 1)])


def test_any_number_of_groups(spark):
    df = spark.range(3003).selectExpr("cast(id % 1001 as string) as g", "cast(id as double) as x")
    got = rows(exact_quantiles(df, ["g"], "x", {"m": 0.5}, task_values=2))
    assert len(got) == 1001
    assert all(m == float(g) + 1001 and n == 3 for g, m, n in got)


def test_percentile_form_agrees(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.choice([None, rng.randrange(50) / 10])) for _ in range(500)]
    exact = rows(exact_quantiles(frame(spark, data), ["g"], "x", PROBS))
    for a, b in zip(exact, rows(percentile_quantiles(frame(spark, data), ["g"], "x", PROBS))):
        assert a[0] == b[0] and a[-1] == b[-1]
        assert a[1:-1] == pytest.approx(b[1:-1], abs=1e-12)
