from __future__ import annotations

from helpers import rows, sort_rows
from pyspark.sql import functions as F

from tallymark.plans.inputs import demographics, enrolment, history_with_current, yearly_records
from tallymark.sources import schemas

RESULTS = "id bigint, grade string, district string, school string, literacy double, score double, k int"


def results(spark):
    return spark.createDataFrame([
        (1, "03", "TN00010", "0005", 2.0, 3.0, 1), (1, "03", "TN00010", "0006", 2.5, 3.0, 2),
        (2, "K", "TN00TN1", "x", None, None, 3),
    ], RESULTS)


def history(spark):
    return spark.createDataFrame(
        [(2.0, 1, 10.0, 5.0, 2015, 1.0, 1.5), (3.0, 1, 10.0, 5.0, 2016, 1.0, 9.9), (None, 3, None, None, 2015, None, 2.0)],
        "grade double, id bigint, system double, school double, year int, literacy double, score double",
    )


def test_each_year_has_one_source(spark):
    prior = spark.createDataFrame([(1, 2, "1.5", "2.5"), (2, None, "n", "")], "id bigint, grade int, literacy string, score string")
    got = yearly_records(results(spark), prior, history(spark), 2017)
    assert got.columns == ["id", "year", "grade", "score"]
    assert rows(got) == sort_rows([
        (1, 2017, 3, 3.0), (1, 2017, 3, 3.0), (2, 2017, None, None),
        (1, 2016, 2, 2.5), (2, 2016, None, None),
        (1, 2015, 2, 1.5), (3, 2015, None, 2.0),
    ])


def test_history_takes_the_best_current_record(spark):
    got = history_with_current(history(spark), results(spark), 2017, ["k"]).where("year = 2017")
    assert rows(got, "id", "grade", "system", "school", "literacy", "score") == sort_rows(
        [(1, 3.0, 10.0, 6.0, 2.5, 3.0), (2, None, None, None, None, None)]
    )


def test_enrolment_keeps_every_record(spark):
    assert rows(enrolment(results(spark))) == sort_rows([(1, 10, 5), (1, 10, 6), (2, None, None)])


def test_demographics(spark):
    def raw(id, **flags):
        values = {c: "N" for c in schemas.DEMOGRAPHICS.renames.values()}
        return {**values, "ethnicity": "X", "school_year": 2016, "id": id, **flags}

    data = [
        raw("1", white="Y"),
        raw("2", white="Y", black="Y", homeless="Y", prim_tbi="Y"),
        raw("3", black="Y", ethnicity="H", waivedel="Y"),
        raw("4", white="Y", asian=None, migrant=None, prim_blind=None),
        raw("5", white="Y", asian=None, ethnicity="H", runaway=None, homeless="Y"),
        raw("x"),
    ]
    columns = list(schemas.DEMOGRAPHICS.renames.values())
    schema = ", ".join(f"{c} {'int' if c == 'school_year' else 'string'}" for c in columns)
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in data], schema)
    got = {r["id"]: tuple(r)[2:] for r in demographics(df).collect()}
    assert got == {
        1: ("White", False, False, False),
        2: ("Black or African American", True, False, True),
        3: ("Hispanic or Latino", False, True, False),
        4: (None, None, False, None),
        5: ("Hispanic or Latino", True, False, False),
        None: (None, False, False, False),
    }
    assert {r[0] for r in demographics(df).select(F.col("year")).collect()} == {2017}
