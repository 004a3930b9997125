"""Reports, release and check jobs on hand-made rows."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from helpers import optimized, plan, rows, sort_rows
from pyspark.sql import functions as F
from tallymark.operators.reconcile import differing_ranges, reconcile
from tallymark.operators.settle import settle
from tallymark.plans.check import check_report
from tallymark.plans.release import release_duplicates, release_students, release_table
from tallymark.plans.reports import assemble, growth_rates, level_report, stack_levels

STUDENTS = "id int, system int, school int, race_ethnicity string, ed boolean, el boolean, swd boolean, numerator boolean, denominator boolean, copies bigint"


@pytest.fixture
def people(spark):
    return spark.createDataFrame([
        (1, 1, 1, "White", True, True, False, True, True, 1),
        (2, 1, 1, "Hispanic or Latino", False, None, None, False, True, 2),
        (3, 1, 2, None, None, True, True, None, False, 1),
        (4, 2, 1, "Black or African American", True, False, True, True, True, 1),
        (5, None, None, None, None, None, None, True, True, 1),
    ], STUDENTS)


def test_three_levels(people):
    got = {(r["level"], r["system"], r["school"], r["subgroup"]): tuple(r)[4:] for r in growth_rates(people).collect()}
    assert got["state", None, None, "All Students"] == (3, 5, 60.0)
    assert got["state", None, None, "Black/Hispanic/Native American"] == (1, 3, 33.3)
    assert got["district", 1, None, "All Students"] == (1, 3, 33.3)
    assert got["district", None, None, "All Students"] == (1, 1, 100.0)
    assert got["school", 1, 2, "Students with Disabilities"] == (0, 0, None)
    assert ("district", None, None, "English Learners") not in got


def test_level_report_names_and_order(spark, people):
    names = spark.createDataFrame([(1, "One"), (0, "State")], "system int, system_name string")
    report = level_report(people, "district", names)
    assert report.columns == ["system", "system_name", "subgroup", "n_met_growth", "valid_tests", "pct_met_growth"]
    order = [(r["system"], r["subgroup"]) for r in report.collect()]
    assert order == sorted(order, key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    assert {r["system_name"] for r in report.where("system = 2").collect()} == {None}
    state = level_report(people, "state", names)
    assert {(r["system"], r["system_name"]) for r in state.collect()} == {(0, "State")}
    schools = spark.createDataFrame([(1, 1, "S")], "system int, school int, school_name string")
    assert level_report(people, "school", schools).columns[:3] == ["system", "school", "school_name"]


def test_output_has_names_everywhere(spark, people):
    names = spark.createDataFrame(
        [(1, 1, "One", "S11"), (1, 2, "One", "S12")], "system int, school int, system_name string, school_name string"
    )
    out = assemble(growth_rates(people), names, [(1, 2, "")])
    got = {(r["level"], r["system"], r["school"], r["subgroup"]): r for r in out.collect()}
    assert got["state", 0, 0, "All Students"]["system_name"] == "0"
    assert got["school", 0, 0, "All Students"]["system_name"] == "0"
    assert got["school", 1, 1, "All Students"]["school_name"] == "S11"
    assert got["school", 1, 2, "All Students"]["school_name"] == ""
    assert got["school", 2, 1, "All Students"]["system_name"] == "One"
    assert out.count() == growth_rates(people).count()


def test_stack_levels(spark):
    state = spark.createDataFrame([("All", 5)], "subgroup string, n int")
    district = spark.createDataFrame([(1, "All", 3), (None, "All", 2)], "system int, subgroup string, n int")
    school = spark.createDataFrame([(1, 4, "All", 3)], "system int, school int, subgroup string, n int")
    got = stack_levels(state, district, school).select("level", "system", "school", "n")
    assert rows(got) == sort_rows([("state", 0, 0, 5), ("district", 1, 0, 3), ("district", 0, 0, 2), ("school", 1, 4, 3)])


FORMATTED = (
    "id int, system int, school int, literacy double, composite double, prior_level double, prior_composite double, "
    "white string, asian string, pacific_islander string, american_indian string, black string, hispanic string, "
    "primary_disability string, k int"
)


@pytest.fixture
def formatted(spark):
    return spark.createDataFrame([
        (1, 1, 1, 4.0, 4.2, 1.0, 4.1, "Y", None, None, None, None, None, None, 1),
        (1, 1, 1, 3.0, 3.0, 1.0, 1.0, "Y", None, None, None, None, None, None, 2),
        (2, 1, 1, 2.0, 2.0, 1.0, 1.45, "N", None, None, None, "Y", None, "05", 3),
        (3, 1, 1, 2.0, 2.5, 1.0, 1.0, None, None, None, None, None, "H", None, 4),
        (4, 1, 2, None, 2.5, 1.0, None, None, None, None, None, None, None, None, 5),
        (None, 1, 2, 1.0, 1.0, 1.0, 1.0, None, None, None, None, None, None, None, 6),
    ], FORMATTED)


@pytest.fixture
def listed(spark):
    return spark.createDataFrame([(2,), (2,), (3,), (77,)], "STUDENT_KEY int")


def test_release_students(formatted, listed):
    got = {r["id"]: r.asDict() for r in release_students(formatted, listed, ["k"]).collect()}
    assert len(got) == 5
    assert [got[i]["reported_race"] for i in (1, 2, 3, 4, None)] == [
        "White", "Black or African American", "Hispanic", "None Reported", "None Reported"]
    assert [got[i]["ed"] for i in (1, 2, 3, 4, None)] == [0, 1, 1, 0, 0]
    assert [got[i]["n_met_growth"] for i in (1, 2, 3, 4, None)] == [True, None, True, False, False]
    assert [got[i]["n_met_exit"] for i in (1, 2, 3, 4, None)] == [True, False, False, False, False]
    assert [got[i]["valid_tests_growth"] for i in (1, 4)] == [True, False]
    assert [got[i]["swd"] for i in (1, 2)] == [0, 1]
    assert "k" not in got[1]


def test_release_table(formatted, listed):
    table = release_table(release_students(formatted, listed, ["k"]))
    assert table.columns == [
        "system", "school", "subgroup", "valid_tests_growth", "valid_tests_exit", "n_met_exit", "n_met_growth",
        "pct_met_growth", "pct_met_exit"]
    got = {(r["school"], r["subgroup"]): tuple(r)[3:] for r in table.collect()}
    assert got[1, "All Students"] == (3, 3, 1, 2, 66.7, 33.3)
    assert got[1, "English Learners"] == got[1, "All Students"]
    assert got[1, "Black/Hispanic/Native American"] == (2, 2, 0, 1, 50.0, 0.0)
    assert got[1, "Students with Disabilities"] == (1, 1, 0, 0, 0.0, 0.0)
    assert got[2, "None Reported"] == (1, 1, 0, 0, 0.0, 0.0)
    assert (1, "Economically Disadvantaged") not in got
    more = release_table(release_students(formatted, listed, ["k"]), disadvantaged=True)
    ed = more.where("subgroup = 'Economically Disadvantaged'")
    assert rows(ed, "school", "valid_tests_growth") == [(1, 2)]


def test_release_reads_the_records_once(spark, formatted, listed, tmp_path):
    formatted.write.parquet(str(tmp_path / "f"))
    df = spark.read.parquet(str(tmp_path / "f"))
    text = plan(release_table(release_students(df, listed, ["k"])))
    assert text.count("FileScan") == 1
    assert text.count("Exchange hashpartitioning(id") == 1


def test_release_duplicates(formatted, listed):
    got = release_duplicates(formatted, listed, ["k"])
    assert got.count() == 6
    assert {"composite_x", "composite_y", "ed_x", "ed_y"} <= set(got.columns)
    pairs = rows(got.where("id = 1"), "k_x", "k_y", "composite_y")
    assert pairs == [(1, 1, 4.2), (2, 1, 4.2)]


@pytest.fixture
def ours(spark):
    return spark.createDataFrame([
        (1, 1, "All Students", 10, 9), (1, 1, "English Learners", 10, 9), (1, 1, "Students with Disabilities", 3, 3),
        (1, 1, "White", 4, 4), (1, 2, "All Students", 5, 5), (1, None, "All Students", 7, 7), (2, 1, "All Students", None, 1),
    ], "system int, school int, subgroup string, valid_tests_growth int, valid_tests_exit int")


@pytest.fixture
def theirs(spark):
    return spark.createDataFrame([
        ("1", "1", "All Students", 11, 1), ("1", "1.0", "x", 1, 1), ("1", "1", "English Language Learners", 10, 1),
        ("1", "1", "Students with Disabilities", 9, 1), ("1", "1", "Non-White", 6, 1), ("1", None, "All Students", 8, 1),
        ("2", "1", "All Students", 3, 1), ("3", "1", "All Students", 3, 1), ("1", "1", None, 3, 1),
    ], "system string, schoolnumber string, subgroup string, n_validtests_growth int, valid_tests int")


def test_mismatches(ours, theirs):
    got = check_report(ours, theirs)
    assert got.columns == ["system", "school", "subgroup", "n_validtests_growth", "valid_tests_growth", "valid_tests", "valid_tests_exit"]
    assert rows(got) == sort_rows([(1, 1, "All Students", 11, 10, 1, 9), (1, None, "All Students", 8, 7, 1, 7)])
    with_swd = check_report(ours, theirs, exclude=None)
    assert with_swd.count() == 3


def test_mismatches_equal_the_filtered_full_join(ours, theirs):
    every = check_report(ours, theirs, only="all", exclude=None)
    filtered = every.where("n_validtests_growth <> valid_tests_growth").where("subgroup <> 'Students with Disabilities'")
    assert rows(filtered.drop("status")) == rows(check_report(ours, theirs))


def test_one_sided_rows(ours, theirs):
    got = {(r["system"], r["school"], r["subgroup"]): r["status"] for r in check_report(ours, theirs, "all", None).collect()}
    assert got == {
        (1, 1, "All Students"): "mismatch", (1, 1, "English Language Learners"): "match",
        (1, 1, "Students with Disabilities"): "mismatch", (1, 2, "All Students"): "only_ours",
        (1, None, "All Students"): "mismatch", (2, 1, "All Students"): "mismatch", (3, 1, "All Students"): "only_theirs",
        (1, 1, "x"): "only_theirs",
    }


def test_mismatch_is_an_inner_join(ours, theirs):
    assert "FullOuter" not in optimized(check_report(ours, theirs))
    with pytest.raises(ValueError):
        reconcile(ours, theirs, ["system"], ("a", "b"), [], only="some")


def test_ranges_of_equal_keys_are_left_out(spark):
    data = [(i, i % 3, i / 2) for i in range(300)] + [(None, 1, 5.0), (900, None, None)]
    theirs = [(i, j, v + (1 if i in (17, 250) else 0) if v is not None else v) for i, j, v in data]
    theirs = [r for r in theirs if r[0] != 40] + [(901, 1, 1.0), (900, None, None)]
    ours = spark.createDataFrame(data, "a int, b int, m double")
    other = spark.createDataFrame(theirs, "a2 long, b int, n double")
    on = [("a", "a2"), "b"]
    plain = reconcile(ours, other, on, ("m", "n"), [])
    fast = reconcile(ours, other, on, ("m", "n"), [], ranges=64)
    assert rows(fast) == rows(plain) and fast.count() == 2
    x, y = differing_ranges(ours, other, on, ("m", "n"), 64)
    assert 0 < x.count() < 60 and 0 < y.count() < 60
    same = differing_ranges(ours, ours, ["a", "b"], ("m", "m"), 64)
    assert [s.count() for s in same] == [0, 0] and "Join" not in optimized(same[0])


def test_keys_with_several_measures_are_compared(spark):
    """The same rows on both sides differ where a key has two measures: each meets the other."""
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0), (2, 5.0), (3, None), (3, 4.0)], "k int, m double")
    other = df.withColumnRenamed("m", "n")
    assert rows(reconcile(df, other, ["k"], ("m", "n"), [], ranges=8)) == rows(reconcile(df, other, ["k"], ("m", "n"), []))
    with pytest.raises(Exception, match="more than one row"):
        reconcile(df, other, ["k"], ("m", "n"), [], expect="one", ranges=8).collect()


def test_settling_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffled():
        return {f for folder in folders for f in Path(folder.toString()).rglob("shuffle_*.data")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(name, None)
    made = settle(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert made.count() == 100 and spark.conf.get(name, None) == setting
