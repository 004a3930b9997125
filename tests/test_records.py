from __future__ import annotations

import math
import random

import pytest
from helpers import optimized, plan, rows, sort_rows
from pyspark.sql import functions as F

from tallymark.operators.records import best_record, duplicate_audit, student_year_max, tied_best
from tallymark.operators.reshape import spread, stack_by_name

SCHEMA = "id bigint, comp double, lit double, k int"


def test_best_record_takes_the_whole_row(spark):
    df = spark.createDataFrame([
        (1, 3.0, 2.0, 1), (1, 3.0, 4.0, 2), (1, None, 5.0, 3),
        (2, None, None, 1), (2, None, 1.0, 2),
        (3, 2.0, None, 1), (3, 2.0, 1.0, 2),
        (4, 2.0, 2.0, 9), (4, 2.0, 2.0, 3),
        (5, math.nan, 1.0, 1), (5, 1.0, None, 2),
        (None, 1.0, 1.0, 1), (None, 2.0, 1.0, 2),
    ], SCHEMA)
    got = rows(best_record(df, ["id"], ["comp", "lit"], ["k"]))
    assert got == sort_rows([
        (1, 3.0, 4.0, 2), (2, None, 1.0, 2), (3, 2.0, 1.0, 2), (4, 2.0, 2.0, 3), (5, 1.0, None, 2), (None, 2.0, 1.0, 2),
    ])


def test_ties_raise_when_the_order_is_not_total(spark):
    df = spark.createDataFrame([(1, 3.0, 2.0, 1), (1, 3.0, 2.0, 1), (2, 1.0, 1.0, 1)], SCHEMA)
    assert rows(tied_best(df, ["id"], ["comp", "lit"])) == [(1, 2)]
    with pytest.raises(ValueError):
        best_record(df, ["id"], ["comp", "lit"], ["k"], total=False)
    untied = df.where("id = 2")
    assert best_record(untied, ["id"], ["comp", "lit"], ["k"], total=False).count() == 1


def test_best_record_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 10 as id", "id / 2 as comp", "1.0 as lit", "id as k")
    text = plan(best_record(df, ["id"], ["comp"], ["k"]))
    assert text.count("WindowGroupLimit") == 2
    assert text.count("Exchange hashpartitioning") == 1


def test_yearly_extremes(spark):
    df = spark.createDataFrame(
        [(1, 3, 1.0), (1, 2, 4.0), (2, None, None), (3, 5, None)], "id bigint, grade int, score double"
    )
    got = rows(student_year_max(df, ["id"], ["score"], ["grade"]))
    assert got == [(1, 2.0, 4.0), (2, math.inf, -math.inf), (3, 5.0, -math.inf)]
    clean = rows(student_year_max(df, ["id"], ["score"], ["grade"], "null"))
    assert clean == sort_rows([(1, 2, 4.0), (2, None, None), (3, 5, None)])
    with pytest.raises(ValueError):
        student_year_max(df, ["id"], ["score"], all_missing="zero")


def test_duplicate_audit_against_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, 1.0, 2.0]), rng.choice([None, 1.0]), k) for k in range(60)]
    low = -math.inf
    best = {}
    for row in data:
        place = (low if row[1] is None else row[1], low if row[2] is None else row[2], -row[3])
        if row[0] not in best or place > best[row[0]][0]:
            best[row[0]] = (place, row)
    expected = [r + best[r[0]][1][1:] for r in data]
    got = duplicate_audit(spark.createDataFrame(data, SCHEMA), "id", ["comp", "lit"], ["k"])
    assert got.columns == ["id", "comp_x", "lit_x", "k_x", "comp_y", "lit_y", "k_y"]
    assert rows(got) == sort_rows(expected)


def test_stack_by_name(spark):
    a = spark.createDataFrame([(1, 2)], "id bigint, grade int")
    b = spark.createDataFrame([(3.5, 2)], "grade double, id bigint")
    c = spark.createDataFrame([(9,)], "id bigint")
    got = stack_by_name(a, b, c)
    assert dict(got.dtypes) == {"id": "bigint", "grade": "double"}
    assert rows(got) == sort_rows([(1, 2.0), (2, 3.5), (9, None)])
    with pytest.raises(TypeError):
        stack_by_name(a, spark.createDataFrame([("K",)], "grade string"))


def test_spread_keys_decide_the_rows(spark):
    df = spark.createDataFrame(
        [(1, 3, 2000, 2.0), (1, 4, 2001, 3.0), (2, 5, 2000, 1.0), (2, 5, 2001, 1.5)],
        "id bigint, grade int, year int, pl double",
    )
    by_grade = rows(spread(df, ["id", "grade"], "year", "pl", [2000, 2001]))
    assert by_grade == sort_rows([(1, 3, 2.0, None), (1, 4, None, 3.0), (2, 5, 1.0, 1.5)])
    by_id = spread(df, ["id"], "year", "pl", [2000, 2001])
    assert rows(by_id) == [(1, 2.0, 3.0), (2, 1.0, 1.5)]
    assert plan(by_id).count("Exchange") == 1
    pivoted = df.groupBy("id", "grade").pivot("year", [2000, 2001]).agg({"pl": "first"})
    assert rows(pivoted) == by_grade


def test_null_and_nan_tie(spark):
    from tallymark.operators.records import tied_best

    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 3.0), (2, None)], "k int, x double")
    assert [tuple(r) for r in tied_best(df, ["k"], ["x"]).collect()] == [(1, 2)]


@pytest.mark.parametrize("kind", ["double", "float", "int", "bigint", "decimal(9,2)", "boolean", "date", "timestamp", "string"])
def test_audit_by_any_type(spark, kind):
    texts = {
        "boolean": ["true", "false"], "date": ["2020-01-02", "1969-12-31"], "timestamp": ["2020-01-02 03:04:05", "1900-01-01"],
        "string": ["b", "a"],
    }.get(kind, ["3", "-2", "0", "-7"])
    df = spark.range(80).selectExpr("id % 9 as id", "id as k").withColumn(
        "v", F.get(F.array(*map(F.lit, texts), F.lit(None)), F.pmod(F.col("k") * 7, F.lit(len(texts) + 1)).cast("int")).cast(kind)
    ).union(spark.range(1).selectExpr("77L", "500L", f"cast(null as {kind})"))
    chosen = best_record(df, ["id"], ["v"], ["k"]).select("id", F.col("v").alias("v_y"), F.col("k").alias("k_y"))
    got = duplicate_audit(df, "id", ["v"], ["k"])
    assert rows(got, "id", "k_x", "v_x", "k_y", "v_y") == rows(df.join(chosen, "id"), "id", "k", "v", "k_y", "v_y")


def test_single_records_pass_no_join(spark):
    df = spark.createDataFrame([(i, float(i), 0.0, i) for i in range(50)], SCHEMA)
    got = duplicate_audit(df, "id", ["comp"], ["k"], per_key=lambda best: best.withColumn("flag", F.col("id") > 3))
    assert got.columns[-1] == "flag"
    assert rows(got, "k_x", "k_y", "flag") == [(i, i, i > 3) for i in range(50)]
    several = optimized(got).split("Join")[1]
    assert "_records" in several
