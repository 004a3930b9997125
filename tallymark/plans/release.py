"""The release table: fixed standards and an exit rule, per school."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.bands import fixed_standard
from ..functions.flags import (
    NO_RACE, RELEASE_COMBINED_RACES, RELEASE_RACE_FLAGS, classify, met_exit, met_growth, valid_exit, valid_growth,
)
from ..functions.missing import columns_starting, map_columns, name, present
from ..operators.joins import flag_lookup
from ..operators.records import best_record, duplicate_audit
from ..operators.subgroups import ALL, COMBINED, DISABILITY, DISADVANTAGED, LEARNERS, subgroup_rates

FLAGS = [flag for flag, _ in RELEASE_RACE_FLAGS] + ["primary_disability"]
RATES = {
    "pct_met_growth": ("n_met_growth", "valid_tests_growth"),
    "pct_met_exit": ("n_met_exit", "valid_tests_exit"),
}


def release_records(formatted: DataFrame, carry: list[str] = ()) -> DataFrame:
    """The formatted file's records with race and disability decided.

    Flags count as set where they hold any value, an ``"N"`` included.
    """
    flagged = map_columns(formatted, FLAGS, present)
    race = classify([(F.col(flag) == 1, label) for flag, label in RELEASE_RACE_FLAGS], NO_RACE)
    return flagged.select(
        "system", "school", "id", "literacy", "composite", "prior_level", "prior_composite",
        race.alias("reported_race"),
        F.col("primary_disability").alias("swd"),
        *map(name, carry),
    )


def release_students(
    formatted: DataFrame,
    listed: DataFrame,
    tie_break: list[str],
    listed_key: str = "STUDENT_KEY",
    compare_decimals: int | None = None,
) -> DataFrame:
    """One record per student with validity, exit, standard and growth flags.

    ``listed`` names the disadvantaged students. The best record is chosen
    before the lookup, which depends on the student only: one row per student
    goes into that join.
    """
    records = release_records(formatted, tie_break)
    best = best_record(records, ["id"], ["composite", "literacy"], tie_break).drop(*tie_break)
    looked_up = flag_lookup(best, listed, "id", listed_key, "ed", hot=None)
    score, prior, lit = F.col("composite"), F.col("prior_composite"), F.col("literacy")
    valid = valid_growth(score, prior)
    return looked_up.withColumns({
        "valid_tests_growth": valid,
        "valid_tests_exit": valid_exit(lit, score),
        "n_met_exit": met_exit(lit, score),
        "growth_standard": fixed_standard(prior, valid),
    }).withColumn("n_met_growth", met_growth(score, prior, lit, F.col("growth_standard"), compare_decimals))


def release_table(students: DataFrame, disadvantaged: bool = False) -> DataFrame:
    """Counts and both rates per school and subgroup, each race included.

    All students are English learners here, so that subgroup repeats the first.
    The disadvantaged are shown on request.
    """
    subgroups = [
        (ALL, F.lit(True)),
        (COMBINED, F.col("reported_race").isin(RELEASE_COMBINED_RACES)),
        (LEARNERS, F.lit(True)),
        (DISABILITY, F.col("swd") == 1),
    ]
    if disadvantaged:
        subgroups.append((DISADVANTAGED, F.col("ed") == 1))
    measures = columns_starting(students, "valid_tests", "n_")
    return subgroup_rates(
        students,
        subgroups,
        {m: F.col(m) for m in measures},
        RATES,
        {"school": ["system", "school"]},
        by_value=["reported_race"],
    ).drop("level")


def release_duplicates(
    formatted: DataFrame, listed: DataFrame, tie_break: list[str], listed_key: str = "STUDENT_KEY"
) -> DataFrame:
    """Every formatted record beside the one chosen for its student.

    The lookup depends on the student only: it is done once per student and serves both.
    """
    audit = duplicate_audit(
        release_records(formatted, tie_break), "id", ["composite", "literacy"], tie_break,
        per_key=lambda chosen: flag_lookup(chosen, listed, "id", listed_key, "ed", hot=None),
    )
    return audit.withColumns({"ed_x": F.col("ed"), "ed_y": F.col("ed")}).drop("ed")
