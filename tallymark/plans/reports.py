"""State, district and school reports, points, and the assembled output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.bands import points
from ..functions.flags import COMBINED_RACES
from ..functions.missing import columns_starting, missing_to_zero, name, nan_to_null_frame, put_first
from ..operators.carry import carry_forward
from ..operators.joins import apply_overrides, keyed_join
from ..operators.reshape import stack_by_name
from ..operators.settle import settle
from ..operators.subgroups import (
    ALL, COMBINED, DISABILITY, DISADVANTAGED, LEARNERS, subgroup_rates, total_rates,
)

LEVELS = {"state": [], "district": ["system"], "school": ["system", "school"]}
MEASURES = {"n_met_growth": "numerator", "valid_tests": "denominator"}
RATES = {"pct_met_growth": ("n_met_growth", "valid_tests")}

# School names that win over the crosswalk, by system and school.
# The empty name is meant.
SCHOOL_NAMES = [
    (190, 296, "East Nashville Middle"),
    (190, 8053, ""),
    (190, 8105, "KA @ The Crossings"),
    (220, 37, "Dickson Intermediate School"),
    (570, 22, "Jackson Central-Merry Early College High"),
    (570, 24, "Rose Hill School"),
    (710, 17, "Baxter Primary"),
    (792, 8160, "Nexus STEM Academy Middle School"),
    (792, 8165, "Memphis STEM Academy"),
    (792, 8175, "Aspire East Academy"),
    (940, 71, "Mill Creek Elementary School"),
    (940, 72, "Mill Creek Middle School"),
    (985, 8130, "Memphis Scholars Raleigh-Egypt"),
    (985, 8135, "Kirby Middle School"),
    (985, 8140, "Hillcrest High School"),
]


def report_subgroups(combined_races: list[str] = COMBINED_RACES):
    return [
        (ALL, F.lit(True)),
        (COMBINED, F.col("race_ethnicity").isin(combined_races)),
        (DISADVANTAGED, F.col("ed")),
        (LEARNERS, F.col("el")),
        (DISABILITY, F.col("swd")),
    ]


def growth_rates(
    students: DataFrame, levels: dict[str, list[str]] = LEVELS, weight: str | None = "copies", subgroups=None
) -> DataFrame:
    """Growth met per subgroup at every level, from the student table."""
    return subgroup_rates(
        students,
        report_subgroups() if subgroups is None else subgroups,
        {out: F.col(flag) for out, flag in MEASURES.items()},
        RATES,
        levels,
        weight=weight,
    )


def state_points(students: DataFrame, weight: str | None = "copies") -> DataFrame:
    """The state's rate over all students and the points it earns."""
    whole = total_rates(students, {out: F.col(flag) for out, flag in MEASURES.items()}, RATES, weight)
    return whole.withColumn("points", points(F.col("pct_met_growth"), F.col("valid_tests")))


def level_report(students: DataFrame, level: str, names: DataFrame, weight: str | None = "copies") -> DataFrame:
    """One level's report with names, key columns first, in key order.

    ``names`` has one row per system (state, district) or per system and
    school (school); the state is system 0.
    """
    keys = LEVELS[level]
    rates = growth_rates(students, {level: keys}, weight).drop("level")
    if level == "state":
        rates = rates.withColumn("system", F.lit(0))
    named = keyed_join(rates, names, keys or ["system"], "left", expect="one")
    named = put_first(named, columns_starting(named, "system", "school"))
    return nan_to_null_frame(named).orderBy(
        *[F.col(k).asc_nulls_last() for k in keys or ["system"]], F.col("subgroup").asc_nulls_last()
    )


def stack_levels(state: DataFrame, district: DataFrame, school: DataFrame) -> DataFrame:
    """Three separately made level tables as one, with missing keys 0."""
    levels = {"state": state, "district": district, "school": school}
    stacked = stack_by_name(*[df.withColumn("level", F.lit(level)) for level, df in levels.items()])
    return stacked.withColumns({k: missing_to_zero(name(k)) for k in ("system", "school")})


def assemble(
    rates: DataFrame,
    names: DataFrame,
    overrides: list[tuple] = SCHOOL_NAMES,
    leading: str | None = "0",
) -> DataFrame:
    """All levels in one table with names.

    ``rates`` are ``growth_rates`` at three levels, ``names`` has ``system``,
    ``school``, ``system_name``, ``school_name``, a system and school at most
    once (else the job fails). Missing keys become 0, a
    missing ``system_name`` takes the one before it in level, system, school,
    subgroup order (``leading`` before the first), and ``overrides`` replace
    school names. Building the result runs a job: the rates with their names, one
    row per level, key and subgroup, are written, so that filling in the names
    reads them twice without making them twice.
    """
    keyed = rates.withColumns({k: missing_to_zero(name(k)) for k in ("system", "school")})
    named = settle(keyed_join(keyed, names, ["system", "school"], "left", expect="one"))
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    # Missing keys became 0 and may share a place with a real 0: same key, same name.
    order = ["_level", "system", "school", "subgroup"]
    buckets = [F.col("_level"), F.col("system")]  # a report's rows of one system are few
    carried = carry_forward(named.withColumn("_level", place), "system_name", order, buckets, leading)
    return apply_overrides(carried.drop("_level"), overrides, ["system", "school"], "school_name")
