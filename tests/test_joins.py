from __future__ import annotations

import random

import pytest
from helpers import plan, rows, sort_rows

from tallymark.operators import joins
from tallymark.operators.joins import apply_overrides, fan_out, flag_lookup, keyed_join, one_per_key

LEFT = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")]
RIGHT = [(1, "x"), (1, "y"), (2, "z"), (None, "n"), (5, "w")]


@pytest.fixture
def sides(spark):
    return spark.createDataFrame(LEFT, "k int, a string"), spark.createDataFrame(RIGHT, "k int, b string")


def brute(left, right, how, null_keys="match"):
    def same(x, y):
        return x == y and (null_keys == "match" or x is not None)

    out = [(lk, *lv, *rv) for lk, *lv in left for rk, *rv in right if same(lk, rk)]
    if how in ("left", "full"):
        out += [(lk, *lv, *[None] * (len(right[0]) - 1)) for lk, *lv in left if not any(same(lk, r[0]) for r in right)]
    if how == "full":
        out += [(rk, *[None] * (len(left[0]) - 1), *rv) for rk, *rv in right if not any(same(l[0], rk) for l in left)]
    return sort_rows(out)


@pytest.mark.parametrize("how", ["left", "inner", "full"])
@pytest.mark.parametrize("null_keys", ["match", "never"])
def test_missing_keys(sides, how, null_keys):
    assert rows(keyed_join(*sides, ["k"], how, null_keys)) == brute(LEFT, RIGHT, how, null_keys)


@pytest.mark.parametrize("how", ["left", "inner", "full"])
@pytest.mark.parametrize("null_keys", ["match", "never"])
@pytest.mark.parametrize("hot", ["left", "right"])
@pytest.mark.parametrize("hot_key", [7, None])
def test_hot_keys_change_nothing(spark, how, null_keys, hot, hot_key):
    rng = random.Random(3)
    big = [(hot_key, i % 5) for i in range(200)] + [(rng.randrange(20), i) for i in range(100)] + [(None, -1), (99, -2)]
    small = [(k, f"s{k}") for k in [*range(15), 7, 50, None, None]]
    left, right = (big, small) if hot == "left" else (small, big)
    left_df = spark.createDataFrame(left, f"k int, a {'int' if hot == 'left' else 'string'}")
    right_df = spark.createDataFrame(right, f"k int, b {'string' if hot == 'left' else 'int'}")
    assert joins.hot_keys(left_df if hot == "left" else right_df, ["k"], 20).first()["_salts"] >= 10
    got = keyed_join(left_df, right_df, ["k"], how, null_keys, hot=hot, rows_per_task=20)
    assert rows(got) == brute(left, right, how, null_keys)


def test_hot_rows_are_spread_even_if_equal(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        copies = spark.range(0, 4000, 1, 8).selectExpr("1 as k", "'same' as a")
        one = spark.createDataFrame([(1, "x")], "k int, b string")
        joined = keyed_join(copies, one.hint("merge"), ["k"], "full", hot="left", rows_per_task=100)
        sizes = [len(p) for p in joined.rdd.glom().collect()]
        assert sum(sizes) == 4000
        assert max(sizes) < 4000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("how,hot", [("left", "right"), ("full", "left"), ("full", "right"), ("left", "left"), ("inner", "right")])
def test_salts_of_keys_that_a_side_lacks(spark, how, hot):
    left, right = [(1, 10), (5, 50), (None, 0)], [(1, "p"), (9, "q"), (None, "n")]
    salts = spark.createDataFrame([(1, 3), (5, 4), (9, 4), (77, 2), (None, 2)], "k int, _salts bigint")
    got = keyed_join(
        spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b string"), ["k"], how,
        hot=hot, salts=salts,
    )
    assert rows(got) == brute(left, right, how, "match")


def test_every_hot_key_is_found(spark):
    df = spark.range(60_006).selectExpr("cast(id % 20002 as int) as k")
    found = joins.hot_keys(df, ["k"], 2)
    assert found.count() == 20002
    assert set(rows(found.select("_salts"))) == {(2,)}
    one = spark.range(1000).selectExpr("1 as k")
    assert rows(joins.hot_keys(one, ["k"], 10)) == [(1, 100)]


def test_nothing_is_counted_where_spark_splits(spark, monkeypatch):
    monkeypatch.setattr(joins, "hot_keys", None)
    a, b = spark.createDataFrame([(1, 2)], "k int, a int"), spark.createDataFrame([(1, 3)], "k int, b int")
    assert rows(keyed_join(a, b, ["k"], "inner", hot="left")) == [(1, 2, 3)]
    assert rows(keyed_join(a, b, ["k"], "left", hot="left")) == [(1, 2, 3)]


def test_two_keys_and_other_names(spark):
    a = spark.createDataFrame([(1, 2, "p"), (1, None, "q")], "system int, school int, a string")
    b = spark.createDataFrame([(1, 2, "r"), (1, None, "s")], "system int, schoolnumber int, b string")
    got = keyed_join(a, b, ["system", ("school", "schoolnumber")], "full")
    assert got.columns == ["system", "school", "a", "b"]
    assert rows(got) == sort_rows([(1, 2, "p", "r"), (1, None, "q", "s")])


def test_suffixes_and_self_join(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    got = keyed_join(df, df, ["k"], "inner", suffixes=(".x", ".y"))
    assert got.columns == ["k", "v.x", "v.y"]
    with pytest.raises(ValueError):
        keyed_join(df, df, ["k"], suffixes=("", ""))


def test_expect_one(spark, sides):
    left, right = sides
    with pytest.raises(Exception, match="more than one row for key"):
        keyed_join(left, right, ["k"], expect="one").collect()
    unique = right.where("b <> 'y'")
    assert rows(keyed_join(left, unique, ["k"], expect="one")) == brute(LEFT, [r for r in RIGHT if r[1] != "y"], "left")
    assert rows(one_per_key(unique, ["k"])) == rows(unique)


def test_bad_arguments(sides):
    for wrong in ({"how": "cross"}, {"null_keys": "maybe"}, {"expect": "two"}):
        with pytest.raises(ValueError):
            keyed_join(*sides, ["k"], **wrong)


def test_fan_out_counts_without_joining(sides):
    got = rows(fan_out(*sides, ["k"]))
    assert got == sort_rows([(1, 2, 2, 4), (2, 1, 1, 1), (4, 1, 0, 1), (None, 1, 1, 1)])
    assert sum(r[3] for r in got) == len(brute(LEFT, RIGHT, "left"))


def test_crosswalk_by_system_fans_out(spark):
    """Joining school rows by system alone repeats them per school of the system."""
    schools = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 3, 30)], "system int, school int, n int")
    crosswalk = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "system int, school int, school_name string")
    got = keyed_join(schools, crosswalk, ["system"], suffixes=(".x", ".y"))
    assert got.columns == ["system", "school.x", "n", "school.y", "school_name"]
    assert got.count() == 5
    assert keyed_join(schools, crosswalk, ["system", "school"]).count() == 3


@pytest.mark.parametrize("hot", [None, "left"])
def test_flag_lookup(spark, hot):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, a string")
    keys = spark.createDataFrame([(1,), (1,), (3,)], "KEY int")
    assert rows(flag_lookup(df, keys, "id", "KEY", "ed", hot)) == sort_rows(
        [(1, "a", 1), (1, "b", 1), (2, "c", 0), (None, "d", 0)]
    )
    with_null = keys.unionByName(spark.createDataFrame([(None,)], "KEY int"))
    assert rows(flag_lookup(df, with_null, "id", "KEY", "ed", hot))[-1] == (None, "d", 1)
    assert rows(flag_lookup(df, keys.where("false"), "id", "KEY", "ed", hot), "ed") == [(0,)] * 4


def test_overrides(spark):
    df = spark.createDataFrame(
        [(1, 1, "One"), (1, 2, "Two"), (2, 1, None), (2, 2, None)], "system int, school bigint, name string"
    )
    table = [(1, 1, ""), (2, 1, "New")]
    got = apply_overrides(df, table, ["system", "school"], "name")
    assert rows(got) == sort_rows([(1, 1, ""), (1, 2, "Two"), (2, 1, "New"), (2, 2, None)])
    assert "Join" not in plan(got)
    assert rows(apply_overrides(df, [], ["system", "school"], "name")) == rows(df)
    with pytest.raises(ValueError):
        apply_overrides(df, [(1, 1, "a"), (1, 1, "b")], ["system", "school"], "name")


def test_published_overrides_are_unique():
    from tallymark.plans.reports import SCHOOL_NAMES

    assert len(SCHOOL_NAMES) == 15
    assert len({row[:2] for row in SCHOOL_NAMES}) == 15


@pytest.mark.parametrize("null_keys, expected", [
    ("match", {"n_left": 5, "n_joined": 8, "n_matched": 6, "n_more": 3}),
    ("never", {"n_left": 5, "n_joined": 7, "n_matched": 4, "n_more": 2}),
])
def test_counts_of_a_left_join(spark, null_keys, expected):
    from tallymark.operators.joins import JoinCounts

    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")], "k int, x string")
    right = spark.createDataFrame([(1, 1.0), (1, 2.0), (None, 3.0), (None, 4.0), (7, 5.0)], "k int, y double")
    counts = JoinCounts()
    df = keyed_join(left, right, ["k"], null_keys=null_keys, counts=counts)
    assert df.columns == ["k", "x", "y"]
    assert len(df.collect()) == expected["n_joined"]
    assert counts.get() == expected
    with pytest.raises(ValueError):
        keyed_join(left, right, ["k"], "inner", counts=counts)
