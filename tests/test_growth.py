from __future__ import annotations

import math
import random

import pytest
from helpers import plan, r_quantile, rows, sort_rows
from pyspark.sql import functions as F

from tallymark.functions.bands import SCORE_LABELS
from tallymark.operators import joins
from tallymark.operators.joins import keyed_join
from tallymark.operators.records import student_year_max
from tallymark.operators.reshape import spread
from tallymark.operators.settle import settled_here
from tallymark.plans.growth import (
    attach_standard, growth_pairs, growth_standards, indicator_growth, scores_by_year, student_growth, student_table,
    with_standard,
)

SCHEMA = "id bigint, year int, grade int, score double"


def records(spark, n=600, seed=4):
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        id = rng.choice([None, *range(120)])
        year = rng.choice([1998, 1999, 2000, 2001])
        grade = None if rng.random() < 0.03 else (id or 0) % 9 + (year - 1998) * (rng.random() < 0.4)
        data.append((id, year, grade, None if rng.random() < 0.2 else rng.randrange(10, 60) / 10))
    return spark.createDataFrame(data, SCHEMA)


def standards_of(spark, values):
    return spark.createDataFrame([(b, v) for b, v in values.items()], "score_band string, score_60 double")


@pytest.mark.parametrize("all_missing", ["inf", "null"])
@pytest.mark.parametrize("same_grade", [True, False])
def test_pairs_equal_the_long_to_wide_form(spark, all_missing, same_grade):
    """One conditional aggregate per student against maximum, then spread."""
    df = records(spark)
    wide = scores_by_year(df, [2001, 2000], grade="grade", all_missing=all_missing)
    ours = growth_pairs(wide, 2001, 2000, same_grade).where("score_band is not null")
    long = student_year_max(df, ["id", "year"], ["score"], ["grade"], all_missing).where("year in (2000, 2001)")
    keys = ["id", "grade"] if same_grade else ["id"]
    spreaded = spread(long, keys, "year", "score", [2000, 2001], "y")
    from tallymark.functions.bands import score_band
    from tallymark.functions.missing import nan_to_null

    theirs = spreaded.select(
        score_band(F.col("y2000")).alias("score_band"), nan_to_null(F.col("y2001") - F.col("y2000")).alias("growth")
    ).where("score_band is not null")
    assert rows(ours) == rows(theirs)
    assert ours.count() > 50


def test_standards_are_interpolated(spark):
    df = records(spark, 1500)
    wide = scores_by_year(df, [2001, 2000], grade="grade")
    pairs = [tuple(r) for r in growth_pairs(wide, 2001, 2000).collect()]
    got = {r["score_band"]: r for r in growth_standards(wide, 2001, 2000).collect()}
    assert set(got) == {b for b, _ in pairs if b is not None} <= set(SCORE_LABELS)
    for band, r in got.items():
        values = [g for b, g in pairs if b == band]
        assert r["n"] == len(values)
        assert r["median_score"] == r_quantile(values, 0.5)
        assert r["score_60"] == r_quantile(values, 0.6)
        assert r["score_70"] == r_quantile(values, 0.7)


def test_promoted_students_have_no_growth_but_count(spark):
    df = spark.createDataFrame(
        [(1, 2000, 3, 2.0), (1, 2001, 4, 3.0), (2, 2000, 3, 2.1), (2, 2001, 3, 2.6)], SCHEMA
    )
    wide = scores_by_year(df, [2001, 2000], grade="grade")
    by_grade, by_id = (growth_standards(wide, 2001, 2000, same).first() for same in (True, False))
    assert (by_grade["n"], round(by_grade["median_score"], 6)) == (2, 0.5)
    assert (by_id["n"], round(by_id["median_score"], 6)) == (2, 0.75)


def test_wide_scores_equal_self_joins(spark):
    df = records(spark)
    standards = standards_of(spark, {b: 0.3 + i / 10 for i, b in enumerate(SCORE_LABELS)})
    got = student_growth(scores_by_year(df, [2001, 2000, 1999]), standards, 2001)
    long = with_standard(student_year_max(df, ["id", "year"], ["score"]), standards, "score", "growth_standard")
    joined = None
    for when, year in (("current", 2001), ("prior", 2000), ("two_back", 1999)):
        part = long.where(F.col("year") == year).select(
            "id", F.col("score").alias(f"score_{when}"), F.col("growth_standard").alias(f"standard_{when}")
        )
        joined = part if joined is None else keyed_join(joined, part, ["id"])
    columns = sorted(joined.columns)
    assert rows(got, *columns) == rows(joined, *columns)
    years = [2001, 2000, 1999]
    attached = attach_standard(scores_by_year(df, years), standards, years)
    assert rows(attached) == rows(long.where(F.col("year").isin(years)), "year", "id", "score", "growth_standard")


def test_standards_by_band_are_unique_and_may_be_none(spark):
    df = spark.createDataFrame([(1, 2.2), (2, 9.9), (3, None)], "id int, score double")
    none = spark.createDataFrame([], "score_band string, score_60 double")
    assert rows(with_standard(df, none, "score", "s"), "id", "s") == [(1, None), (2, None), (3, None)]
    known = spark.createDataFrame([("2.0-2.4", 0.5), (None, 0.7), ("2.5-2.9", None)], none.schema)
    assert rows(with_standard(df, known, "score", "s"), "id", "s") == [(1, 0.5), (2, None), (3, None)]
    with pytest.raises(Exception, match="(?i)duplicate"):
        with_standard(df, known.union(known), "score", "s").collect()


def test_standards_by_grade_band(spark):
    df = spark.createDataFrame([(1, 2.2, 3), (2, 2.2, 7), (3, 2.2, None), (4, None, 3)], "id int, score double, grade int")
    known = spark.createDataFrame(
        [("elementary", "2.0-2.4", 0.5), (None, "2.0-2.4", 0.9)], "grade_band string, score_band string, score_60 double"
    )
    got = with_standard(df, known, "score", "s", grade="grade")
    assert rows(got, "id", "s") == [(1, 0.5), (2, None), (3, 0.9), (4, None)]


def test_student_rules(spark):
    inf = math.inf
    wide = spark.createDataFrame([
        # id, n, score, n, score, n, score for 2001, 2000, 1999
        (1, 1, 3.0, 1, 2.0, 1, 1.0),    # met one year
        (2, 1, 2.1, 1, 2.0, 1, 1.0),    # missed one, met two
        (3, 1, 2.1, 1, 2.0, 0, None),   # missed one, two unknown
        (4, 1, 3.0, 0, None, 1, 1.0),   # prior missing
        (5, 1, -inf, 1, 2.0, 1, 1.0),   # no score this year: not met, counts
        (6, 1, 5.5, 1, 5.1, 1, 1.0),    # prior beyond the bands
        (7, 0, None, 1, 2.0, 1, 1.0),   # not tested this year
        (8, 1, -inf, 1, -inf, 1, 1.0),  # growth undefined
    ], "id int, n_2001 int, score_2001 double, n_2000 int, score_2000 double, n_1999 int, score_1999 double")
    standards = standards_of(spark, {"1.0-1.4": 0.5, "2.0-2.4": 0.5})
    got = {r["id"]: r for r in student_growth(wide, standards, 2001).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 8]
    flags = {i: (r["met_growth_1yr"], r["met_growth_2yr"], r["numerator"], r["denominator"]) for i, r in got.items()}
    assert flags == {
        1: (True, True, True, True),
        2: (False, True, True, True),
        3: (False, None, None, True),
        4: (None, None, None, False),
        5: (False, False, False, True),
        6: (None, None, None, False),
        8: (None, None, None, False),
    }
    assert got[1]["growth_standard_2yr"] == 1.0
    assert got[8]["growth_1yr"] is None
    assert got[1]["met_growth_2yr_prev_standard"] is True
    assert got[2]["met_growth_2yr_prev_standard"] is False


def test_exact_gain(spark):
    wide = spark.createDataFrame([(1, 1, 3.4, 1, 2.7, 0, None)],
                                 "id int, n_2001 int, score_2001 double, n_2000 int, score_2000 double, n_1999 int, score_1999 double")
    standards = standards_of(spark, {"2.5-2.9": 0.7})
    assert student_growth(wide, standards, 2001).first()["met_growth_1yr"] is False
    assert student_growth(wide, standards, 2001, compare_decimals=6).first()["met_growth_1yr"] is True


def test_all_missing_score_counts_only_with_inf(spark):
    df = spark.createDataFrame(
        [(1, 2000, 3, 2.0), (1, 2001, 3, None)] + [(i, y, 3, s) for i in (2, 3) for y, s in ((2000, 2.0), (2001, 3.0))], SCHEMA
    )
    inf = {r["id"]: r for r in indicator_growth(df, 2001).collect()}
    clean = {r["id"]: r for r in indicator_growth(df, 2001, all_missing="null").collect()}
    assert (inf[1]["met_growth_1yr"], inf[1]["denominator"]) == (False, True)
    assert (clean[1]["met_growth_1yr"], clean[1]["denominator"]) == (None, False)
    assert inf[2]["denominator"] and clean[2]["denominator"]


@pytest.mark.parametrize("hot", [False, True])
def test_student_table_counts_copies(spark, hot, monkeypatch):
    counted = joins.hot_keys
    monkeypatch.setattr(joins, "hot_keys", lambda df, keys, rows_per_task: counted(df, keys, 1))
    growth = spark.createDataFrame([(1, True), (2, False), (None, True), (4, True)], "id int, numerator boolean")
    enrolment = spark.createDataFrame(
        [(1, 10, 1), (1, 10, 1), (1, 20, 2), (2, 10, 1), (None, 30, 3), (None, 30, 3), (9, 1, 1)], "id int, system int, school int"
    )
    people = spark.createDataFrame(
        [(1, "w"), (2, "b"), (2, "b"), (2, "h"), (None, None), (None, None)], "id int, race string"
    )
    got = student_table(growth, enrolment, people, hot=hot)
    repeated = keyed_join(keyed_join(growth, enrolment, ["id"]), people, ["id"])
    counted = repeated.groupBy(*repeated.columns).agg(F.count("*").alias("copies"))
    assert rows(got, *counted.columns) == rows(counted)
    assert got.agg(F.sum("copies")).first()[0] == repeated.count()


def test_demographics_may_join_on_more(spark):
    growth = spark.createDataFrame([(1, 2017)], "id int, year int")
    enrolment = spark.createDataFrame([(1, 10)], "id int, system int")
    people = spark.createDataFrame([(1, 2017, "w"), (1, 2016, "b")], "id int, year int, race string")
    got = student_table(growth, enrolment, people, demographic_keys=["id", "year"])
    assert rows(got, "race", "copies") == [("w", 1)]


def test_students_are_joined_where_they_are(spark):
    """One shuffle for the demographics, one for the enrolment, none for the growth."""
    enrolment = spark.range(300).selectExpr("id % 90 as id", "id % 7 as system")
    people = spark.range(90).selectExpr("id", "if(id % 2 = 0, 'w', 'b') as race")
    before = len(spark.catalog.listTables())
    with settled_here(spark):
        table = student_table(indicator_growth(records(spark).where("id is not null"), 2001), enrolment, people)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            text = plan(table)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert text.count("Exchange hashpartitioning(") == text.count("Exchange hashpartitioning(id") == 2
        assert "SinglePartition" not in text.split("Subquery")[0]
        assert "Bucketed: true" in text
        assert table.count() > 0
    assert len(spark.catalog.listTables()) == before


@pytest.mark.parametrize("null_keys", ["match", "never"])
def test_students_without_id_are_kept_apart(spark, null_keys):
    growth = spark.createDataFrame([(1, True), (None, True)], "id int, numerator boolean")
    enrolment = spark.createDataFrame([(1, 10)] + [(None, i % 3) for i in range(90)], "id int, system int")
    people = spark.createDataFrame([(1, "w")] + [(None, "ab"[i % 2]) for i in range(40)], "id int, race string")
    got = student_table(growth, enrolment, people, null_keys=null_keys)
    lone = [(None, True, r, s, 20 * 30) for r in "ab" for s in range(3)] if null_keys == "match" else [(None, True, None, None, 1)]
    assert rows(got, "id", "numerator", "race", "system", "copies") == sort_rows([(1, True, "w", 10, 1), *lone])
