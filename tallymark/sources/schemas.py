"""Declared schemas of the input files, and their short column names.

Headers are given as they stand in the files. Columns whose text is cleaned by
the library (codes, grades) are read as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


@dataclass(frozen=True)
class Input:
    """Columns as (header, type, short name)."""

    columns: list[tuple]

    @property
    def schema(self) -> StructType:
        return StructType([StructField(header, kind(), True) for header, kind, _ in self.columns])

    @property
    def renames(self) -> dict[str, str]:
        return {header: short for header, _, short in self.columns}


# Fixed values from here to the end: the headers of the files.
# Assessment results, current year.
RESULTS = Input([
    ("State Student ID", LongType, "id"),
    ("Grade", StringType, "grade"),
    ("District Number", StringType, "district"),
    ("School Number", StringType, "school"),
    ("Literacy Proficiency Level", DoubleType, "literacy"),
    ("Composite (Overall) Proficiency Level", DoubleType, "score"),
])

# Assessment results, prior year.
PRIOR_RESULTS = Input([
    ("statestudentid", LongType, "id"),
    ("grade", IntegerType, "grade"),
    ("literacy_pl_new_standard", StringType, "literacy"),
    ("composite_pl_new_standard", StringType, "score"),
])

# Results of earlier years.
HISTORY = Input([
    ("grade", DoubleType, "grade"),
    ("id", LongType, "id"),
    ("system", DoubleType, "system"),
    ("school", DoubleType, "school"),
    ("year", IntegerType, "year"),
    ("pl_lit", DoubleType, "literacy"),
    ("pl_comp", DoubleType, "score"),
])

RACE_COLUMNS = ["white", "asian", "nativehawaiian", "americanindian", "black"]
DISADVANTAGE_COLUMNS = ["homeless", "migrant", "runaway", "directcertecondis"]
LEARNER_COLUMNS = ["englishlearner", "waivedel"]
DISABILITY_COLUMNS = [
    "prim_sld", "prim_intellectdis", "prim_speechimp", "prim_langimp", "prim_emotionaldis", "prim_autism",
    "prim_otherhealthimp", "prim_orthimp", "prim_deaf", "prim_hearingimp", "prim_blind", "prim_visualimp",
    "prim_deafblind", "prim_multipledis", "prim_devdelay", "prim_tbi",
]

# Student demographics.
DEMOGRAPHICS = Input([
    ("school_year", IntegerType, "school_year"),
    ("studentid", StringType, "id"),
    *[
        (c, StringType, c)
        for c in [*RACE_COLUMNS, "ethnicity", *DISADVANTAGE_COLUMNS, *LEARNER_COLUMNS, *DISABILITY_COLUMNS]
    ],
])

# Crosswalks from codes to names.
SYSTEM_NAMES = Input([("system", IntegerType, "system"), ("system_name", StringType, "system_name")])
SYSTEM_SCHOOLS = Input([
    ("system", IntegerType, "system"),
    ("system_name", StringType, "system_name"),
    ("school", IntegerType, "school"),
    ("school_name", StringType, "school_name"),
])
SCHOOL_NAMES = SYSTEM_SCHOOLS

# The formatted student-level file of the release.
FORMATTED = Input([
    ("State Student ID", LongType, "id"),
    ("System Number", IntegerType, "system"),
    ("School Number", IntegerType, "school"),
    ("Literacy Proficiency Level", DoubleType, "literacy"),
    ("Composite (Overall) Proficiency Level", DoubleType, "composite"),
    ("Prior Composite Performance Level New Standard", DoubleType, "prior_level"),
    ("Prior Composite Scale Score New Standard", DoubleType, "prior_composite"),
    ("Race - White", StringType, "white"),
    ("Race - Asian", StringType, "asian"),
    ("Race - Pacific Islander/Hawaiian", StringType, "pacific_islander"),
    ("Race - American Indian/Alaska Native", StringType, "american_indian"),
    ("Race - Black/African American", StringType, "black"),
    ("Ethnicity - Hispanic/Latino", StringType, "hispanic"),
    ("Primary Disability", StringType, "primary_disability"),
])

# List of disadvantaged students; a key may repeat.
LISTED = Input([("STUDENT_KEY", LongType, "STUDENT_KEY")])

# School-level results: the other analyst's and ours.
THEIR_RESULTS = Input([
    ("system", StringType, "system"),
    ("schoolnumber", StringType, "schoolnumber"),
    ("subgroup", StringType, "subgroup"),
    ("n_validtests_growth", IntegerType, "n_validtests_growth"),
    ("valid_tests", IntegerType, "valid_tests"),
])
OUR_RESULTS = Input([
    ("system", IntegerType, "system"),
    ("school", IntegerType, "school"),
    ("subgroup", StringType, "subgroup"),
    ("valid_tests_growth", LongType, "valid_tests_growth"),
    ("valid_tests_exit", LongType, "valid_tests_exit"),
    ("n_met_exit", LongType, "n_met_exit"),
    ("n_met_growth", LongType, "n_met_growth"),
    ("pct_met_growth", DoubleType, "pct_met_growth"),
    ("pct_met_exit", DoubleType, "pct_met_exit"),
])
