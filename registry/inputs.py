"""The input files' shapes, and the jobs started from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.plans.growth import indicator_growth, student_table
from tallymark.plans.inputs import demographics, enrolment, history_with_current, yearly_records
from tallymark.sources.schemas import DISABILITY_COLUMNS, DISADVANTAGE_COLUMNS, LEARNER_COLUMNS, RACE_COLUMNS

from .records import _race_sql
from .standards import _DOUBLES, ORACLES as STANDARDS, rounded
from .views import ASSESSMENT_SQL, TIE_BREAK, assessment, student, table


def _results(spark, sf_dir):
    """The current year as the file has it: codes, grades and schools as text."""
    return assessment(spark, sf_dir).where("year = 2001").select(
        "id", F.col("grade").cast("string").alias("grade"), "district", F.col("school").cast("string").alias("school"),
        F.col("pl_lit").alias("literacy"), F.col("pl_comp").alias("score"), *TIE_BREAK,
    )


def _prior(spark, sf_dir):
    """The prior year with scores as text."""
    return assessment(spark, sf_dir).where("year = 2000").select(
        "id", F.col("grade").cast("int").alias("grade"), F.col("pl_lit").cast("string").alias("literacy"),
        F.col("pl_comp").cast("string").alias("score"),
    )


def _history(spark, sf_dir):
    return assessment(spark, sf_dir).where("year < 2001").select(
        F.col("grade").cast("double").alias("grade"), "id", F.col("system").cast("double").alias("system"),
        F.col("school").cast("double").alias("school"), "year", F.col("pl_lit").alias("literacy"),
        F.col("pl_comp").alias("score"),
    )


def yearly_records_query(spark, sf_dir):
    records = yearly_records(_results(spark, sf_dir), _prior(spark, sf_dir), _history(spark, sf_dir), 2001)
    return records.groupBy("id", "year", "grade").agg(F.count("*").alias("n"), F.max("score").alias("score"))


def history_query(spark, sf_dir):
    stacked = history_with_current(_history(spark, sf_dir), _results(spark, sf_dir), 2001, TIE_BREAK)
    return stacked.groupBy("year", "system", "school").agg(
        F.count("*").alias("n"), F.max("grade").alias("grade"), F.max("score").alias("score"),
        F.max("literacy").alias("literacy"),
    )


def _growth_from_inputs(spark, sf_dir):
    records = yearly_records(_results(spark, sf_dir), _prior(spark, sf_dir), _history(spark, sf_dir), 2001)
    return indicator_growth(records, 2001)


def growth_from_inputs(spark, sf_dir):
    return rounded(_growth_from_inputs(spark, sf_dir), _DOUBLES)


def students_from_inputs(spark, sf_dir):
    growth = _growth_from_inputs(spark, sf_dir)
    return rounded(student_table(growth, enrolment(_results(spark, sf_dir)), student(spark, sf_dir)), _DOUBLES)


# Each flag column from two remainders of the key, some missing.
_COLUMNS = [*RACE_COLUMNS, *DISADVANTAGE_COLUMNS, *LEARNER_COLUMNS, *DISABILITY_COLUMNS]
_RAW = {
    "school_year": "2000",
    "id": "cast(c_custkey as varchar(20))",
    **{
        c: f"case when c_custkey % {i + 3} = 1 then 'Y' when c_custkey % {37 + i} = 2 then null else 'N' end"
        for i, c in enumerate(_COLUMNS)
    },
    "ethnicity": "case when c_custkey % 9 = 4 then 'H' when c_custkey % 23 = 5 then null else 'X' end",
}


def demographics_query(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(*[F.expr(e).alias(c) for c, e in _RAW.items()])
    return demographics(raw)


QUERIES = {
    "yearly_records": yearly_records_query,
    "history_with_current": history_query,
    "growth_from_inputs": growth_from_inputs,
    "students_from_inputs": students_from_inputs,
    "demographics": demographics_query,
}


def _any(columns) -> str:
    return "(" + " or ".join(f"{c} = 'Y'" for c in columns) + ")"


ORACLES = {
    "yearly_records": f"""with {ASSESSMENT_SQL}
        select id, year, cast(grade as integer) as grade, count(*) as n, max(pl_comp) as score
        from assessment where year between 1999 and 2001 group by id, year, grade""",
    "history_with_current": f"""with {ASSESSMENT_SQL}, best as (select * from (
            select *, row_number() over (partition by id order by pl_comp desc nulls last, pl_lit desc nulls last,
                {', '.join(TIE_BREAK)}) as rn from assessment where year = 2001) where rn = 1),
        stacked as (
            select year, system, school, grade, pl_comp, pl_lit from assessment where year < 2001
            union all select year, system, school, grade, pl_comp, pl_lit from best)
        select year, cast(system as double) as system, cast(school as double) as school, count(*) as n,
            cast(max(grade) as double) as grade, max(pl_comp) as score, max(pl_lit) as literacy
        from stacked group by year, system, school""",
    "growth_from_inputs": STANDARDS["student_growth"],
    "students_from_inputs": STANDARDS["student_table"].replace(
        "system, school, race_ethnicity", "system, cast(school as integer) as school, race_ethnicity"
    ),
    "demographics": f"""with raw as (select {', '.join(f'{e} as {c}' for c, e in _RAW.items())} from customer)
        select cast(school_year + 1 as integer) as year, cast(id as bigint) as id, {_race_sql()} as race_ethnicity,
            {_any(DISADVANTAGE_COLUMNS)} as ed, {_any(LEARNER_COLUMNS)} as el, {_any(DISABILITY_COLUMNS)} as swd
        from raw""",
}
