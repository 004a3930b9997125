"""Growth standards and the student-level growth table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions.missing import name
from tallymark.operators.carry import carry_forward, int_steps
from tallymark.operators.quantiles import exact_quantiles
from tallymark.operators.ranges import row_places
from tallymark.operators.settle import settle
from tallymark.plans.growth import (
    attach_standard, growth_standards, indicator_growth, scores_by_year, student_table,
)

from .views import (
    ASSESSMENT_SQL, STUDENT_SQL, YEAR_MAX_SQL, assessment, band_sql, student, table,
)

COLUMNS = {"score": "pl_comp"}


def rounded(df, columns):
    return df.withColumns({c: F.round(name(c), 6) for c in columns})


_QUANTILES = ["median_score", "score_60", "score_70"]


def _scores(spark, sf_dir, all_missing="inf"):
    return scores_by_year(
        assessment(spark, sf_dir), [2001, 2000], grade="grade", all_missing=all_missing, **COLUMNS
    )


def _standards(spark, sf_dir, same_grade=True, method="slices", all_missing="inf"):
    return growth_standards(_scores(spark, sf_dir, all_missing), 2001, 2000, same_grade, method=method)


def growth_standards_query(spark, sf_dir):
    return rounded(_standards(spark, sf_dir), _QUANTILES)


def growth_standards_percentile(spark, sf_dir):
    return rounded(_standards(spark, sf_dir, method="percentile"), _QUANTILES)


def growth_standards_by_id(spark, sf_dir):
    return rounded(_standards(spark, sf_dir, same_grade=False), _QUANTILES)


def growth_standards_by_grade_band(spark, sf_dir):
    """Standards for wider score bands, by the band of the prior grade too."""
    bands = ([1.0, 2.0, 3.0, 4.0, 6.0], ["1", "2", "3", "4-5"])
    found = growth_standards(_scores(spark, sf_dir, "null"), 2001, 2000, bands=bands, grade_bands=True)
    return rounded(found, _QUANTILES)


def growth_standards_clean(spark, sf_dir):
    return rounded(_standards(spark, sf_dir, all_missing="null"), _QUANTILES)


def price_quantiles(spark, sf_dir):
    """Quantiles of a column with nearly as many values as rows."""
    lines = table(spark, sf_dir, "lineitem")
    probs = {"q10": 0.1, "q50": 0.5, "q99": 0.99}
    return rounded(exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", probs, task_values=1000), probs)


def attach_standard_query(spark, sf_dir):
    years = [2001, 2000, 1999]
    scores = settle(scores_by_year(assessment(spark, sf_dir), years, grade="grade", **COLUMNS))
    attached = attach_standard(scores, growth_standards(scores, 2001, 2000), years)
    return rounded(attached, ["growth_standard"]).withColumnRenamed("score", "pl_comp")


def _growth(spark, sf_dir, all_missing="inf", compare_decimals=None):
    return indicator_growth(
        assessment(spark, sf_dir), 2001, all_missing=all_missing, compare_decimals=compare_decimals, **COLUMNS
    )


_DOUBLES = [
    "score_current", "score_prior", "score_two_back", "standard_current", "standard_prior", "standard_two_back",
    "growth_1yr", "growth_2yr", "growth_standard_1yr", "growth_standard_2yr",
]


def student_growth_query(spark, sf_dir):
    return rounded(_growth(spark, sf_dir), _DOUBLES)


def student_growth_clean(spark, sf_dir):
    """Missing instead of -inf, and comparisons on six decimals."""
    return rounded(_growth(spark, sf_dir, "null", 6), _DOUBLES)


def students(spark, sf_dir):
    """The indicator's student table, from growth, current records and demographics."""
    enrolment = assessment(spark, sf_dir).where("year = 2001").select("id", "system", "school")
    return student_table(_growth(spark, sf_dir), enrolment, student(spark, sf_dir))


def student_table_query(spark, sf_dir):
    return rounded(students(spark, sf_dir), _DOUBLES)


def carry_forward_query(spark, sf_dir):
    """Supplier names, known for those with much on account, carried on in key order."""
    names = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", F.expr("case when s_acctbal > 5000 then s_name end").alias("known_name")
    )
    return carry_forward(names, "known_name", ["s_suppkey"], int_steps(F.col("s_suppkey")), "0", out="name")


def carry_forward_records(spark, sf_dir):
    """Each record's last known score in school, student and record order."""
    records = assessment(spark, sf_dir).select("school", "id", "k1", "k2", "k3", "k4", "pl_comp")
    return carry_forward(records, "pl_comp", ["school", "id", "k1", "k2", "k3", "k4"], out="carried")


def record_places(spark, sf_dir):
    """Each record's place in school, student and record order."""
    records = assessment(spark, sf_dir).select("school", "id", "k1", "k2", "k3", "k4")
    return row_places(records, records.columns)


QUERIES = {
    "growth_standards": growth_standards_query,
    "growth_standards_percentile": growth_standards_percentile,
    "growth_standards_by_id": growth_standards_by_id,
    "growth_standards_by_grade_band": growth_standards_by_grade_band,
    "growth_standards_clean": growth_standards_clean,
    "price_quantiles": price_quantiles,
    "attach_standard": attach_standard_query,
    "student_growth": student_growth_query,
    "student_growth_clean": student_growth_clean,
    "student_table": student_table_query,
    "carry_forward": carry_forward_query,
    "carry_forward_records": carry_forward_records,
    "record_places": record_places,
}

YEAR_MAX_CLEAN_SQL = (
    "year_max as (select id, year, min(grade) as grade, max(pl_comp) as pl_comp from assessment group by id, year)"
)


def standards_sql(same_grade=True) -> str:
    keys = "id, grade" if same_grade else "id"
    return f"""wide as (
            select {keys}, max(case when year = 2000 then pl_comp end) as prior,
                max(case when year = 2001 then pl_comp end) as now
            from year_max group by {keys}),
        pairs as (select {band_sql('prior')} as score_band,
            case when isnan(now - prior) then null else now - prior end as growth from wide),
        standards as (
            select score_band, quantile_cont(growth, 0.5) as median_score, quantile_cont(growth, 0.6) as score_60,
                quantile_cont(growth, 0.7) as score_70, count(*) as n
            from pairs where score_band is not null group by score_band)"""


_ROUNDED = """select score_band, round(median_score, 6) as median_score, round(score_60, 6) as score_60,
    round(score_70, 6) as score_70, n from standards"""


def growth_sql(year_max=YEAR_MAX_SQL, decimals=None) -> str:
    def at_least(a, b):
        return f"{a} >= {b}" if decimals is None else f"round({a}, {decimals}) >= round({b}, {decimals})"

    def difference(a, b):
        return f"case when isnan({a} - {b}) then null else {a} - {b} end"

    return f"""{ASSESSMENT_SQL}, {year_max}, {standards_sql()},
        long as (select id, year, pl_comp, s.score_60 as standard from year_max y
            left join standards s on {band_sql('y.pl_comp')} = s.score_band),
        scores as (
            select a.id, a.pl_comp as score_current, b.pl_comp as score_prior, c.pl_comp as score_two_back,
                a.standard as standard_current, b.standard as standard_prior, c.standard as standard_two_back
            from (select * from long where year = 2001) a
            left join (select * from long where year = 2000) b on a.id is not distinct from b.id
            left join (select * from long where year = 1999) c on a.id is not distinct from c.id),
        grown as (
            select *, {difference('score_current', 'score_prior')} as growth_1yr,
                {difference('score_current', 'score_two_back')} as growth_2yr,
                standard_prior as growth_standard_1yr, standard_two_back + standard_prior as growth_standard_2yr
            from scores),
        met as (
            select *, {at_least('growth_1yr', 'growth_standard_1yr')} as met_growth_1yr,
                {at_least('growth_2yr', 'growth_standard_2yr')} as met_growth_2yr,
                {at_least('growth_2yr', '1.4e0')} as met_growth_2yr_prev_standard
            from grown),
        growth as (
            select *, (met_growth_1yr or met_growth_2yr) as numerator, met_growth_1yr is not null as denominator
            from met)"""


def students_sql() -> str:
    """Rows repeated as the joins give them."""
    return f"""{growth_sql()}, {STUDENT_SQL},
        students as (
            select g.*, e.system, e.school, d.race_ethnicity, d.ed, d.el, d.swd
            from growth g
            left join (select id, system, school from assessment where year = 2001) e on g.id is not distinct from e.id
            left join student d on g.id is not distinct from d.id)"""


_FLAGS = "met_growth_1yr, met_growth_2yr, met_growth_2yr_prev_standard, numerator, denominator"
_ROUND_ALL = ", ".join(f"round({c}, 6) as {c}" for c in _DOUBLES)

ORACLES = {
    "growth_standards": f"with {ASSESSMENT_SQL}, {YEAR_MAX_SQL}, {standards_sql()} {_ROUNDED}",
    "growth_standards_percentile": f"with {ASSESSMENT_SQL}, {YEAR_MAX_SQL}, {standards_sql()} {_ROUNDED}",
    "growth_standards_by_id": f"with {ASSESSMENT_SQL}, {YEAR_MAX_SQL}, {standards_sql(False)} {_ROUNDED}",
    "growth_standards_clean": f"with {ASSESSMENT_SQL}, {YEAR_MAX_CLEAN_SQL}, {standards_sql()} {_ROUNDED}",
    "growth_standards_by_grade_band": f"""with {ASSESSMENT_SQL}, {YEAR_MAX_CLEAN_SQL},
        pairs as (
            select case when b.grade < 5 then 'elementary' when b.grade < 9 then 'middle' when b.grade > 8 then 'high' end
                    as grade_band,
                case when b.pl_comp >= 1 and b.pl_comp < 2 then '1' when b.pl_comp >= 2 and b.pl_comp < 3 then '2'
                    when b.pl_comp >= 3 and b.pl_comp < 4 then '3' when b.pl_comp >= 4 and b.pl_comp < 6 then '4-5' end
                    as score_band,
                case when a.grade is not distinct from b.grade then a.pl_comp - b.pl_comp end as growth
            from (select * from year_max where year = 2000) b left join (select * from year_max where year = 2001) a
                on a.id is not distinct from b.id)
        select grade_band, score_band, round(quantile_cont(growth, 0.5), 6) as median_score,
            round(quantile_cont(growth, 0.6), 6) as score_60, round(quantile_cont(growth, 0.7), 6) as score_70,
            count(*) as n
        from pairs where score_band is not null group by grade_band, score_band""",
    "price_quantiles": """select l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) as q10,
            round(quantile_cont(l_extendedprice, 0.5), 6) as q50,
            round(quantile_cont(l_extendedprice, 0.99), 6) as q99, count(*) as n
        from lineitem group by l_returnflag""",
    "attach_standard": f"""with {ASSESSMENT_SQL}, {YEAR_MAX_SQL}, {standards_sql()}
        select y.year, y.id, y.pl_comp, round(s.score_60, 6) as growth_standard from year_max y
        left join standards s on {band_sql('y.pl_comp')} = s.score_band where y.year between 1999 and 2001""",
    "student_growth": f"with {growth_sql()} select id, {_ROUND_ALL}, {_FLAGS} from growth",
    "student_growth_clean": f"with {growth_sql(YEAR_MAX_CLEAN_SQL, 6)} select id, {_ROUND_ALL}, {_FLAGS} from growth",
    "student_table": f"""with {students_sql()}
        select id, {_ROUND_ALL}, {_FLAGS}, system, school, race_ethnicity, ed, el, swd, count(*) as copies
        from students group by all""",
    "carry_forward": """with names as (
            select s_suppkey, s_nationkey, case when s_acctbal > 5000 then s_name end as known_name from supplier)
        select *, coalesce(last_value(known_name ignore nulls) over (order by s_suppkey
            rows between unbounded preceding and current row), '0') as name from names""",
    "carry_forward_records": f"""with {ASSESSMENT_SQL}
        select school, id, k1, k2, k3, k4, pl_comp, last_value(pl_comp ignore nulls) over (
            order by school, id, k1, k2, k3, k4 rows between unbounded preceding and current row) as carried
        from assessment""",
}
ORACLES["record_places"] = f"""with {ASSESSMENT_SQL}
    select school, id, k1, k2, k3, k4, row_number() over (order by school, id, k1, k2, k3, k4) as place from assessment"""
