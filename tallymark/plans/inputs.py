"""From the input files' columns to the columns the jobs work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.flags import RACE_FLAGS, any_flag, classify
from ..functions.missing import clean_code, to_int, to_long, to_number
from ..operators.records import best_record
from ..operators.reshape import stack_by_name
from ..sources.schemas import DISABILITY_COLUMNS, DISADVANTAGE_COLUMNS, LEARNER_COLUMNS

# Fixed value: what a district code begins with.
DISTRICT_PREFIX = "TN"


def yearly_records(results: DataFrame, prior: DataFrame, history: DataFrame, current: int) -> DataFrame:
    """Test records of three years (id, year, grade, score), one source per year.

    ``results``, ``prior`` and ``history`` are read with the schemas RESULTS,
    PRIOR_RESULTS and HISTORY; of the history, only two years back is used.
    """
    now = results.select("id", F.lit(current).alias("year"), to_int(F.col("grade")).alias("grade"), "score")
    before = prior.select("id", F.lit(current - 1).alias("year"), "grade", to_number(F.col("score")).alias("score"))
    earlier = history.where(F.col("year") == current - 2).select(
        "id", "year", F.col("grade").try_cast("int").alias("grade"), "score"
    )
    return stack_by_name(now, before, earlier)


def history_with_current(
    history: DataFrame, results: DataFrame, current: int, tie_break: list[str]
) -> DataFrame:
    """The history and the best record of each student of the current year."""
    best = best_record(results, ["id"], ["score", "literacy"], tie_break)
    added = best.select(
        to_number(F.col("grade")).alias("grade"),
        "id",
        clean_code(F.col("district"), DISTRICT_PREFIX).cast("double").alias("system"),
        to_number(F.col("school")).alias("school"),
        F.lit(current).alias("year"),
        "literacy",
        "score",
    )
    return stack_by_name(history, added)


def enrolment(results: DataFrame) -> DataFrame:
    """Every current record's student, system and school."""
    return results.select(
        "id",
        clean_code(F.col("district"), DISTRICT_PREFIX).alias("system"),
        to_int(F.col("school")).alias("school"),
    )


def demographics(raw: DataFrame) -> DataFrame:
    """Race and the disadvantaged, learner and disability flags of each student.

    ``raw`` is read with the schema DEMOGRAPHICS; the results of a year belong to
    the school year before it.
    """
    rules = [
        (F.col("ethnicity") == "H" if flag == "hispanic" else F.col(flag) == "Y", label)
        for flag, label in RACE_FLAGS
    ]
    return raw.select(
        (F.col("school_year") + 1).alias("year"),
        to_long(F.col("id")).alias("id"),
        classify(rules).alias("race_ethnicity"),
        any_flag([F.col(c) for c in DISADVANTAGE_COLUMNS]).alias("ed"),
        any_flag([F.col(c) for c in LEARNER_COLUMNS]).alias("el"),
        any_flag([F.col(c) for c in DISABILITY_COLUMNS]).alias("swd"),
    )
