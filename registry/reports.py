"""Subgroup rates, level reports, assembled output, release table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions.bands import fixed_standard
from tallymark.functions.flags import met_exit, met_growth, valid_exit, valid_growth
from tallymark.operators.joins import keyed_join
from tallymark.operators.ranges import row_places
from tallymark.operators.records import best_record
from tallymark.operators.settle import settle
from tallymark.operators.subgroups import (
    ALL, COMBINED as COMBINED_LABEL, DISABILITY, DISADVANTAGED, LEARNERS, subgroup_rates,
)
from tallymark.plans.release import release_students, release_table
from tallymark.plans.reports import (
    LEVELS, assemble, growth_rates, level_report, report_subgroups, stack_levels, state_points,
)

from .standards import growth_sql, students, students_sql, _growth
from .views import (
    COMBINED, FORMATTED_SQL, LISTED_SQL, STUDENT_SQL, TIE_BREAK, count_sql, formatted, listed, points_sql, rate_sql,
    standard_sql, student, table,
)


def subgroup_rates_query(spark, sf_dir):
    """Growth met per subgroup at state, district and school level."""
    records = formatted(spark, sf_dir)
    best = best_record(records, ["id"], ["composite", "literacy"], TIE_BREAK)
    score, prior, lit = F.col("composite"), F.col("prior_composite"), F.col("literacy")
    valid = valid_growth(score, prior)
    flagged = best.select(
        "id", "system", "school", valid.alias("denominator"), valid_exit(lit, score).alias("exit_tests"),
        met_exit(lit, score).alias("exited"),
        met_growth(score, prior, lit, fixed_standard(prior, valid)).alias("numerator"),
    )
    # Both sides are together by id already; demographics have no missing id.
    people = keyed_join(flagged, student(spark, sf_dir), ["id"], "left", null_keys="never", expect="one")
    return subgroup_rates(
        people,
        report_subgroups(COMBINED),
        {
            "n_met_growth": F.col("numerator"), "valid_tests": F.col("denominator"),
            "n_met_exit": F.col("exited"), "valid_tests_exit": F.col("exit_tests"),
        },
        {"pct_met_growth": ("n_met_growth", "valid_tests"), "pct_met_exit": ("n_met_exit", "valid_tests_exit")},
        LEVELS,
        by_value=["race_ethnicity"],
    )


def state_rate(spark, sf_dir):
    return state_points(_growth(spark, sf_dir), weight=None)


def _rates(spark, sf_dir):
    return growth_rates(students(spark, sf_dir), subgroups=report_subgroups(COMBINED))


def indicator_rates(spark, sf_dir):
    return _rates(spark, sf_dir)


def levels_assembled(spark, sf_dir):
    """Three level tables made apart, then stacked with missing keys 0."""
    people = settle(students(spark, sf_dir))
    made = {
        level: growth_rates(people, {level: keys}, subgroups=report_subgroups(COMBINED)).drop("level")
        for level, keys in LEVELS.items()
    }
    return stack_levels(made["state"], made["district"], made["school"])


def _system_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("system"), F.col("n_name").alias("system_name")
    )


def _school_names(spark, sf_dir):
    """Schools with their own and their system's name; those in debt have none."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return suppliers.join(nations, F.expr("s_nationkey = n_nationkey")).select(
        F.col("s_nationkey").alias("system"), F.col("s_suppkey").alias("school"),
        F.expr("case when s_acctbal > 0 then n_name end").alias("system_name"),
        F.expr("case when s_acctbal > 0 then s_name end").alias("school_name"),
    )


OVERRIDES = [(1, 1, "First School"), (3, 3, ""), (4, 4, "Fourth School"), (24, 24, "Last School")]


def indicator_output(spark, sf_dir):
    return assemble(_rates(spark, sf_dir), _school_names(spark, sf_dir), OVERRIDES)


def _report(spark, sf_dir, level):
    # The races of the combined subgroup have their published labels.
    people = students(spark, sf_dir).replace(
        dict(zip(COMBINED, ["Black or African American", "Hispanic or Latino", "Native American or Alaska Native"])),
        subset=["race_ethnicity"],
    )
    names = _school_names(spark, sf_dir).drop("system_name") if level == "school" else _system_names(spark, sf_dir)
    return level_report(people, level, names)


def state_report(spark, sf_dir):
    return _report(spark, sf_dir, "state")


def district_report(spark, sf_dir):
    return _report(spark, sf_dir, "district")


def school_report(spark, sf_dir):
    return _report(spark, sf_dir, "school")


def _release(spark, sf_dir):
    return release_students(formatted(spark, sf_dir), listed(spark, sf_dir), TIE_BREAK)


def release_students_query(spark, sf_dir):
    return _release(spark, sf_dir)


def release_table_query(spark, sf_dir):
    return release_table(_release(spark, sf_dir))


def release_table_disadvantaged(spark, sf_dir):
    return release_table(_release(spark, sf_dir), disadvantaged=True)


def report_order(spark, sf_dir):
    """Rows of the district report with their place in it."""
    placed = row_places(settle(district_report(spark, sf_dir)), ["system", "subgroup"])
    return placed.withColumn("place", F.col("place").cast("int"))


QUERIES = {
    "report_order": report_order,
    "subgroup_rates": subgroup_rates_query,
    "state_rate": state_rate,
    "indicator_rates": indicator_rates,
    "levels_assembled": levels_assembled,
    "indicator_output": indicator_output,
    "state_report": state_report,
    "district_report": district_report,
    "school_report": school_report,
    "release_students": release_students_query,
    "release_table": release_table_query,
    "release_table_disadvantaged": release_table_disadvantaged,
}

_IN_COMBINED = "race_ethnicity in (" + ", ".join(f"'{r}'" for r in COMBINED) + ")"
_SUBGROUPS = [(ALL, "true"), (COMBINED_LABEL, _IN_COMBINED), (DISADVANTAGED, "ed"), (LEARNERS, "el"), (DISABILITY, "swd")]
_KEYS = {
    "state": ("cast(null as integer)", "cast(null as bigint)", ""),
    "district": ("system", "cast(null as bigint)", "group by system"),
    "school": ("system", "school", "group by system, school"),
}


def _union(source, sums, subgroups, levels=("state", "district", "school"), by_value=None) -> str:
    """The union of filtered aggregates, one per level and subgroup."""
    parts = []
    for level in levels:
        system, school, grouped = _KEYS[level]
        for label, condition in subgroups:
            parts.append(
                f"select '{level}' as level, {system} as system, {school} as school, '{label}' as subgroup, {sums} "
                f"from {source} where {condition} {grouped}"
            )
        if by_value:
            more = grouped + f", {by_value}" if grouped else f"group by {by_value}"
            parts.append(
                f"select '{level}', {system}, {school}, {by_value}, {sums} "
                f"from {source} where {by_value} is not null {more}"
            )
    return " union all ".join(parts)


_GROWTH_SUMS = f"{count_sql('numerator')} as n_met_growth, {count_sql('denominator')} as valid_tests"
_GROWTH_RATE = f"{rate_sql('n_met_growth', 'valid_tests')} as pct_met_growth"
_VALID = "(composite is not null and prior_composite is not null)"
_VALID_EXIT = "(literacy is not null and composite is not null)"
_EXIT = f"({_VALID_EXIT} and literacy >= 4e0 and composite >= 4.2e0)"
_STANDARD = standard_sql("prior_composite", _VALID)
_MET = f"({_VALID} and ({_EXIT} or composite - prior_composite >= {_STANDARD}))"
_BEST = f"""best as (select * from (
            select *, row_number() over (partition by id
                order by composite desc nulls last, literacy desc nulls last, {', '.join(TIE_BREAK)}) as rn
            from formatted) where rn = 1)"""
_FLAGSHIP_SUMS = f"""{count_sql('numerator')} as n_met_growth, {count_sql('denominator')} as valid_tests,
    {count_sql('exited')} as n_met_exit, {count_sql('exit_tests')} as valid_tests_exit"""

# The release table's races, the last present one winning.
_RACES = [
    ("white", "White"), ("asian", "Asian"), ("pacific_islander", "Native Hawaiian or Pacific Islander"),
    ("american_indian", "American Indian or Alaska Native"), ("black", "Black or African American"),
    ("hispanic", "Hispanic"),
]
_RACE = "case " + " ".join(f"when {c} is not null then '{label}'" for c, label in reversed(_RACES)) + (
    " else 'None Reported' end"
)
_RELEASE = f"""{FORMATTED_SQL}, {LISTED_SQL}, {_BEST}, release as (
        select id, system, school, literacy, composite, prior_level, prior_composite, {_RACE} as reported_race,
            cast(primary_disability is not null as integer) as swd,
            cast(id in (select student_key from listed) as integer) as ed,
            {_VALID} as valid_tests_growth, {_VALID_EXIT} as valid_tests_exit, {_EXIT} as n_met_exit,
            {_STANDARD} as growth_standard, {_MET} as n_met_growth
        from best)"""
_RELEASE_SUMS = ", ".join(
    f"{count_sql(c)} as {c}" for c in ["valid_tests_growth", "valid_tests_exit", "n_met_exit", "n_met_growth"]
)
_RELEASE_SUBGROUPS = [
    (ALL, "true"),
    (COMBINED_LABEL, "reported_race in ('Black or African American', 'Hispanic', 'American Indian or Alaska Native')"),
    (LEARNERS, "true"), (DISABILITY, "swd = 1"),
]


def release_sql(subgroups=_RELEASE_SUBGROUPS) -> str:
    return f"""with {_RELEASE}, sums as (
            {_union('release', _RELEASE_SUMS, subgroups, ['school'], 'reported_race')})
        select system, school, subgroup, valid_tests_growth, valid_tests_exit, n_met_exit, n_met_growth,
            {rate_sql('n_met_growth', 'valid_tests_growth')} as pct_met_growth,
            {rate_sql('n_met_exit', 'valid_tests_exit')} as pct_met_exit
        from sums"""


_INDICATOR = f"{students_sql()}, sums as ({_union('students', _GROWTH_SUMS, _SUBGROUPS)})"
_SCHOOL_NAMES = """names as (select s_nationkey as system, s_suppkey as school,
        case when s_acctbal > 0 then n_name end as system_name,
        case when s_acctbal > 0 then s_name end as school_name
        from supplier join nation on s_nationkey = n_nationkey)"""


def _report_sql(level, names, columns) -> str:
    keys = "0 as system" if level == "state" else "system" if level == "district" else "system, school"
    using = "system, school" if level == "school" else "system"
    return f"""with {students_sql()}, sums as ({_union('students', _GROWTH_SUMS, _SUBGROUPS, [level])}),
        keyed as (select {keys}, subgroup, n_met_growth, valid_tests, {_GROWTH_RATE} from sums), {names}
        select keyed.*, {columns} from keyed left join names using ({using})"""


_SYSTEM_NAMES = "names as (select n_nationkey as system, n_name as system_name from nation)"

ORACLES = {
    "subgroup_rates": f"""with {FORMATTED_SQL}, {STUDENT_SQL}, {_BEST}, people as (
            select system, school, {_VALID} as denominator, {_VALID_EXIT} as exit_tests, {_EXIT} as exited,
                {_MET} as numerator, race_ethnicity, ed, el, swd
            from best left join student using (id)),
        sums as ({_union('people', _FLAGSHIP_SUMS, _SUBGROUPS, by_value='race_ethnicity')})
        select *, {_GROWTH_RATE}, {rate_sql('n_met_exit', 'valid_tests_exit')} as pct_met_exit from sums""",
    "state_rate": f"""with {growth_sql()}, sums as (select {_GROWTH_SUMS} from growth),
        rated as (select *, {_GROWTH_RATE} from sums)
        select *, {points_sql('pct_met_growth', 'valid_tests')} as points from rated""",
    "indicator_rates": f"with {_INDICATOR} select *, {_GROWTH_RATE} from sums",
    "levels_assembled": f"""with {_INDICATOR}
        select level, coalesce(system, 0) as system, coalesce(school, 0) as school, subgroup, n_met_growth,
            valid_tests, {_GROWTH_RATE} from sums""",
    "indicator_output": f"""with {_INDICATOR}, {_SCHOOL_NAMES}, keyed as (
            select level, coalesce(system, 0) as system, coalesce(school, 0) as school, subgroup, n_met_growth,
                valid_tests, {_GROWTH_RATE},
                case level when 'state' then 1 when 'district' then 2 else 3 end as place from sums)
        select level, system, school, subgroup, n_met_growth, valid_tests, pct_met_growth,
            coalesce(last_value(system_name ignore nulls) over (order by place, system, school, subgroup
                rows between unbounded preceding and current row), '0') as system_name,
            case when system = 1 and school = 1 then 'First School' when system = 3 and school = 3 then ''
                when system = 4 and school = 4 then 'Fourth School' when system = 24 and school = 24
                then 'Last School' else school_name end as school_name
        from keyed left join names using (system, school)""",
    "state_report": _report_sql("state", _SYSTEM_NAMES, "system_name"),
    "district_report": _report_sql("district", _SYSTEM_NAMES, "system_name"),
    "school_report": _report_sql("school", _SCHOOL_NAMES, "school_name"),
    "report_order": f"""with report as ({_report_sql("district", _SYSTEM_NAMES, "system_name")})
        select *, cast(row_number() over (order by system nulls last, subgroup nulls last) as integer) as place
        from report""",
    "release_students": f"with {_RELEASE} select * from release",
    "release_table": release_sql(),
    "release_table_disadvantaged": release_sql([*_RELEASE_SUBGROUPS, (DISADVANTAGED, "ed = 1")]),
}
