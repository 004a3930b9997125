"""Best record, yearly values, bands, flags, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions.bands import fixed_standard, grade_band, grade_band_rank, points, score_band
from tallymark.functions.flags import (
    RACE_FLAGS, any_flag, classify, met_exit, met_growth, valid_exit, valid_growth,
)
from tallymark.functions.missing import cast_losses, clean_code, rate, replace_first, total
from tallymark.operators.records import best_record, student_year_max, tied_best
from tallymark.operators.reshape import spread, stack_by_name
from tallymark.operators.subgroups import sorted_values, sum_columns

from .views import (
    ASSESSMENT_SQL, FORMATTED_SQL, TIE_BREAK, YEAR_MAX_SQL, assessment, band_sql, count_sql, formatted, points_sql,
    rate_sql, standard_sql, table,
)


def best_record_query(spark, sf_dir):
    return best_record(assessment(spark, sf_dir), ["id", "year"], ["pl_comp", "pl_lit"], TIE_BREAK)


def tied_best_query(spark, sf_dir):
    return tied_best(assessment(spark, sf_dir), ["id", "year"], ["pl_comp"])


def _year_max(spark, sf_dir, all_missing="inf"):
    return student_year_max(assessment(spark, sf_dir), ["id", "year"], ["pl_comp"], ["grade"], all_missing)


def student_year_max_clean(spark, sf_dir):
    return _year_max(spark, sf_dir, "null")


def score_band_counts(spark, sf_dir):
    banded = _year_max(spark, sf_dir).select("year", score_band(F.col("pl_comp")).alias("score_band"))
    return banded.groupBy("year", "score_band").agg(F.count("*").alias("n"))


def grade_band_counts(spark, sf_dir):
    banded = assessment(spark, sf_dir).select("year", grade_band(F.col("grade")).alias("grade_band"))
    counts = banded.groupBy("year", "grade_band").agg(F.count("*").alias("n"))
    return counts.withColumn("band_rank", grade_band_rank(F.col("grade_band")))


def fixed_standard_query(spark, sf_dir):
    prior = F.col("prior_composite")
    return formatted(spark, sf_dir).select(
        "id", *TIE_BREAK, "prior_composite", "composite",
        fixed_standard(prior, valid_growth(F.col("composite"), prior)).alias("growth_standard"),
    )


def valid_exit_met(spark, sf_dir):
    score, prior, lit = F.col("composite"), F.col("prior_composite"), F.col("literacy")
    valid = valid_growth(score, prior)
    return formatted(spark, sf_dir).select(
        "id", *TIE_BREAK,
        valid.alias("valid_tests_growth"),
        valid_exit(lit, score).alias("valid_tests_exit"),
        met_exit(lit, score).alias("n_met_exit"),
        met_growth(score, prior, lit, fixed_standard(prior, valid)).alias("n_met_growth"),
        met_growth(score, prior, lit, fixed_standard(prior, valid), decimals=6).alias("n_met_growth_rounded"),
    )


def points_min_n(spark, sf_dir):
    valid = F.col("pl_comp").isNotNull() & F.col("pl_lit").isNotNull()
    counts = assessment(spark, sf_dir).groupBy("school", "year", "grade").agg(
        total(valid).alias("valid_tests"), total(F.col("pl_comp") >= 2).alias("n_met")
    )
    rated = counts.withColumn("pct_met", rate(F.col("n_met"), F.col("valid_tests")))
    return rated.withColumn("points", points(F.col("pct_met"), F.col("valid_tests")))


def clean_district(spark, sf_dir):
    counts = assessment(spark, sf_dir).groupBy("district").agg(F.count("*").alias("n"))
    return counts.select(
        "district",
        replace_first(F.col("district"), "TN").alias("code"),
        clean_code(F.col("district"), "TN").alias("system"),
        clean_code(F.concat(F.col("district"), F.lit("TN")), "TN").alias("twice"),
        "n",
    )


def spread_year(spark, sf_dir):
    wide = spread(_year_max(spark, sf_dir), ["id", "grade"], "year", "pl_comp", [2000, 2001], "pl_")
    return wide.withColumn("growth", F.round(F.col("pl_2001") - F.col("pl_2000"), 6))


def stack_years(spark, sf_dir):
    """Years from two differently shaped sources, one value per student-year."""
    records = assessment(spark, sf_dir)
    now = records.where("year = 2001").select("year", "id", "grade", "pl_lit", "pl_comp")
    earlier = records.where("year < 2001").select("id", "year", F.col("grade").cast("double").alias("grade"), "pl_comp")
    stacked = stack_by_name(now, earlier)
    return stacked.groupBy("year").agg(
        F.count("*").alias("n"), F.count("pl_lit").alias("n_literacy"), F.max("grade").alias("max_grade"),
        F.round(F.max("pl_comp"), 6).alias("max_score"),
    )


_RACE_TABLE = {
    "white": "case when o_custkey % 4 = 0 then 'Y' when o_orderkey % 31 = 0 then null else 'N' end",
    "asian": "case when o_custkey % 5 = 0 then 'Y' when o_orderkey % 37 = 0 then null else 'N' end",
    "nativehawaiian": "case when o_custkey % 11 = 0 then 'Y' else 'N' end",
    "americanindian": "case when o_custkey % 13 = 0 then 'Y' else 'N' end",
    "black": "case when o_orderstatus = 'F' then 'Y' when o_orderkey % 41 = 0 then null else 'N' end",
    "ethnicity": "case when o_orderkey % 6 = 0 then 'H' when o_orderkey % 43 = 0 then null else 'X' end",
}


def race_precedence(spark, sf_dir):
    flags = table(spark, sf_dir, "orders").select(
        "o_orderkey", *[F.expr(e).alias(c) for c, e in _RACE_TABLE.items()]
    )
    rules = [
        (F.col("ethnicity") == "H" if flag == "hispanic" else F.col(flag) == "Y", label)
        for flag, label in RACE_FLAGS
    ]
    return flags.select("o_orderkey", classify(rules).alias("race_ethnicity"))


# Tests and labels of the races, the last true one winning.
_RACE_LABELS = [
    ("white = 'Y'", "White"), ("asian = 'Y'", "Asian"), ("nativehawaiian = 'Y'", "Hawaiian or Pacific Islander"),
    ("americanindian = 'Y'", "Native American or Alaska Native"), ("black = 'Y'", "Black or African American"),
    ("ethnicity = 'H'", "Hispanic or Latino"),
]


def _race_sql():
    sql = "null"
    for test, label in _RACE_LABELS:
        sql = f"case when ({test}) is null then null when {test} then '{label}' else {sql} end"
    return sql


_DISABILITY = [
    f"case when l_partkey % 83 = {i} then 'Y' when l_suppkey % 41 = {i} then null else 'N' end" for i in range(16)
]


def any_flag_query(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").select(
        any_flag([F.col("l_returnflag"), F.col("l_linestatus")], "R").alias("ed"),
        any_flag([F.expr("nullif(l_returnflag, 'A')"), F.col("l_linestatus")], "O").alias("el"),
        any_flag([F.expr(e) for e in _DISABILITY]).alias("swd"),
    )
    return flags.groupBy("ed", "el", "swd").agg(F.count("*").alias("n"))


def school_sums(spark, sf_dir):
    score, prior, lit = F.col("composite"), F.col("prior_composite"), F.col("literacy")
    flags = formatted(spark, sf_dir).select(
        "system", "school",
        valid_growth(score, prior).alias("valid_tests_growth"),
        valid_exit(lit, score).alias("valid_tests_exit"),
        met_exit(lit, score).alias("n_met_exit"),
    )
    return sum_columns(flags, ["system", "school"], ["valid_tests_growth", "valid_tests_exit", "n_met_exit"])


def race_values(spark, sf_dir):
    return sorted_values(table(spark, sf_dir, "customer"), "c_mktsegment")


def cast_report(spark, sf_dir):
    texts = table(spark, sf_dir, "orders").select(
        F.expr("case when o_orderkey % 3 = 0 then null when o_orderkey % 5 = 0 then o_orderpriority "
               "else cast(o_custkey as varchar(20)) end").alias("number"),
        F.col("o_orderpriority").alias("text"),
    )
    return cast_losses(texts, ["number", "text"])


QUERIES = {
    "best_record": best_record_query,
    "tied_best": tied_best_query,
    "student_year_max": _year_max,
    "student_year_max_clean": student_year_max_clean,
    "score_band_counts": score_band_counts,
    "grade_band_counts": grade_band_counts,
    "fixed_standard": fixed_standard_query,
    "valid_exit_met": valid_exit_met,
    "points_min_n": points_min_n,
    "clean_district": clean_district,
    "spread_year": spread_year,
    "stack_years": stack_years,
    "race_precedence": race_precedence,
    "any_flag": any_flag_query,
    "school_sums": school_sums,
    "race_values": race_values,
    "cast_report": cast_report,
}

_VALID = "(composite is not null and prior_composite is not null)"
_EXIT = "(literacy is not null and composite is not null and literacy >= 4e0 and composite >= 4.2e0)"
_STANDARD = standard_sql("prior_composite", _VALID)
_TIES = ", ".join(TIE_BREAK)

ORACLES = {
    "best_record": f"""with {ASSESSMENT_SQL}
        select id, year, grade, pl_comp, pl_lit, district, system, school, {_TIES} from (
            select *, row_number() over (partition by id, year
                order by pl_comp desc nulls last, pl_lit desc nulls last, {_TIES}) as rn
            from assessment) where rn = 1""",
    "tied_best": f"""with {ASSESSMENT_SQL}, ranked as (
            select id, year, rank() over (partition by id, year order by pl_comp desc nulls last) as rn
            from assessment)
        select id, year, count(*) as n_tied from ranked where rn = 1 group by id, year having count(*) > 1""",
    "student_year_max": f"with {ASSESSMENT_SQL}, {YEAR_MAX_SQL} select id, year, grade, pl_comp from year_max",
    "student_year_max_clean": f"""with {ASSESSMENT_SQL}
        select id, year, min(grade) as grade, max(pl_comp) as pl_comp from assessment group by id, year""",
    "score_band_counts": f"""with {ASSESSMENT_SQL}, {YEAR_MAX_SQL}
        select year, {band_sql('pl_comp')} as score_band, count(*) as n from year_max group by 1, 2""",
    "grade_band_counts": f"""with {ASSESSMENT_SQL}, banded as (
            select year, case when grade < 5 then 'elementary' when grade < 9 then 'middle'
                when grade > 8 then 'high' end as grade_band from assessment)
        select year, grade_band, count(*) as n,
            cast(case grade_band when 'elementary' then 1 when 'middle' then 2 when 'high' then 3 end as integer)
                as band_rank
        from banded group by year, grade_band""",
    "fixed_standard": f"""with {FORMATTED_SQL}
        select id, {_TIES}, prior_composite, composite, {_STANDARD} as growth_standard from formatted""",
    "valid_exit_met": f"""with {FORMATTED_SQL}
        select id, {_TIES}, {_VALID} as valid_tests_growth,
            (literacy is not null and composite is not null) as valid_tests_exit,
            {_EXIT} as n_met_exit,
            {_VALID} and ({_EXIT} or composite - prior_composite >= {_STANDARD}) as n_met_growth,
            {_VALID} and ({_EXIT} or round(composite - prior_composite, 6) >= {_STANDARD}) as n_met_growth_rounded
        from formatted""",
    "points_min_n": f"""with {ASSESSMENT_SQL}, counts as (
            select school, year, grade, {count_sql('pl_comp is not null and pl_lit is not null')} as valid_tests,
                {count_sql('pl_comp >= 2')} as n_met
            from assessment group by school, year, grade), rated as (
            select *, {rate_sql('n_met', 'valid_tests')} as pct_met from counts)
        select *, {points_sql('pct_met', 'valid_tests')} as points from rated""",
    "clean_district": f"""with {ASSESSMENT_SQL}
        select district, regexp_replace(district, 'TN', '') as code,
            cast(trunc(try_cast(regexp_replace(district, 'TN', '') as double)) as integer) as system,
            cast(trunc(try_cast(regexp_replace(concat(district, 'TN'), 'TN', '') as double)) as integer) as twice,
            count(*) as n
        from assessment group by district""",
    "spread_year": f"""with {ASSESSMENT_SQL}, {YEAR_MAX_SQL}, wide as (
            select id, grade, max(case when year = 2000 then pl_comp end) as pl_2000,
                max(case when year = 2001 then pl_comp end) as pl_2001
            from year_max group by id, grade)
        select *, round(pl_2001 - pl_2000, 6) as growth from wide""",
    "stack_years": f"""with {ASSESSMENT_SQL}
        select year, count(*) as n, count(case when year = 2001 then pl_lit end) as n_literacy,
            cast(max(grade) as double) as max_grade, round(max(pl_comp), 6) as max_score
        from assessment group by year""",
    "race_precedence": f"""with flags as (
            select o_orderkey, {', '.join(f'{e} as {c}' for c, e in _RACE_TABLE.items())} from orders)
        select o_orderkey, {_race_sql()} as race_ethnicity from flags""",
    "any_flag": f"""select (l_returnflag = 'R' or l_linestatus = 'R') as ed,
            (nullif(l_returnflag, 'A') = 'O' or l_linestatus = 'O') as el,
            ({' or '.join(f"({e}) = 'Y'" for e in _DISABILITY)}) as swd, count(*) as n
        from lineitem group by 1, 2, 3""",
    "school_sums": f"""with {FORMATTED_SQL}
        select system, school, {count_sql(_VALID)} as valid_tests_growth,
            {count_sql('literacy is not null and composite is not null')} as valid_tests_exit,
            {count_sql(_EXIT)} as n_met_exit
        from formatted group by system, school""",
    "race_values": "select distinct c_mktsegment from customer where c_mktsegment is not null",
    "cast_report": """with texts as (
            select case when o_orderkey % 3 = 0 then null when o_orderkey % 5 = 0 then o_orderpriority
                else cast(o_custkey as varchar) end as number, o_orderpriority as text
            from orders)
        select 'number' as "column", count(number) as n_values,
            count(number) - count(try_cast(number as double)) as n_lost from texts
        union all
        select 'text', count(text), count(text) - count(try_cast(text as double)) from texts""",
}
