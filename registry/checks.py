"""Reconciliation with another report, and the duplicate audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators.settle import settle
from tallymark.operators.subgroups import ALL, COMBINED, DISABILITY, LEARNERS
from tallymark.plans.check import check_report
from tallymark.plans.release import release_duplicates

from .reports import release_sql, release_table_query, _RACE
from .views import FORMATTED_SQL, LISTED_SQL, TIE_BREAK, formatted, listed


def _theirs(ours):
    """Another analyst's report: some counts off by one, one label of their own, a complement subgroup, keys as text."""
    label = F.when(F.col("subgroup") == LEARNERS, "English Language Learners").when(
        F.col("subgroup") == "White", "Non-White"
    ).otherwise(F.col("subgroup"))
    wrong = F.when(F.col("school") % 7 == 0, 1).otherwise(0)
    return ours.select(
        F.col("system").cast("string").alias("system"),
        F.col("school").cast("string").alias("schoolnumber"),
        label.alias("subgroup"),
        (F.col("valid_tests_growth") + wrong).alias("n_validtests_growth"),
        (F.col("valid_tests_growth") + F.col("valid_tests_exit")).alias("valid_tests"),
    )


def reconcile_mismatch(spark, sf_dir):
    ours = settle(release_table_query(spark, sf_dir))
    return check_report(ours, _theirs(ours))


def reconcile_ranges(spark, sf_dir):
    """The same comparison, joined only where ranges of keys differ."""
    ours = settle(release_table_query(spark, sf_dir))
    return check_report(ours, settle(_theirs(ours)), ranges=1024)


def reconcile_all(spark, sf_dir):
    ours = settle(release_table_query(spark, sf_dir))
    return check_report(ours, _theirs(ours), only="all", exclude=None)


def duplicate_audit(spark, sf_dir):
    return release_duplicates(formatted(spark, sf_dir), listed(spark, sf_dir), TIE_BREAK)


QUERIES = {
    "reconcile_mismatch": reconcile_mismatch,
    "reconcile_ranges": reconcile_ranges,
    "reconcile_all": reconcile_all,
    "duplicate_audit": duplicate_audit,
}


_BOTH = f"""with report as ({release_sql()}), theirs as (
            select system, school as schoolnumber, case when subgroup = '{LEARNERS}' then 'English Language Learners'
                    when subgroup = 'White' then 'Non-White' else subgroup end as subgroup,
                valid_tests_growth + case when school % 7 = 0 then 1 else 0 end as n_validtests_growth,
                valid_tests_growth + valid_tests_exit as valid_tests
            from report),
        b as (select * from theirs where subgroup not like '%Non-%'),
        a as (select system, school, case when subgroup = '{LEARNERS}' then 'English Language Learners'
                else subgroup end as subgroup, valid_tests_growth, valid_tests_exit from report
            where subgroup in ('{ALL}', '{COMBINED}', '{LEARNERS}', '{DISABILITY}'))"""


_AUDIT = ["system", "school", "literacy", "composite", "prior_level", "prior_composite", "reported_race", "swd", "ed"]
_AUDITED = [*_AUDIT, *TIE_BREAK]

ORACLES = {
    "reconcile_mismatch": f"""{_BOTH}
        select a.system, a.school, a.subgroup, n_validtests_growth, valid_tests_growth, valid_tests, valid_tests_exit
        from a join b on a.system = b.system and a.school = b.schoolnumber and a.subgroup = b.subgroup
        where n_validtests_growth <> valid_tests_growth and a.subgroup <> '{DISABILITY}'""",
    "reconcile_all": f"""{_BOTH}
        select coalesce(a.system, b.system) as system, coalesce(a.school, b.schoolnumber) as school,
            coalesce(a.subgroup, b.subgroup) as subgroup, n_validtests_growth, valid_tests_growth, valid_tests,
            valid_tests_exit, case when b.system is null then 'only_ours' when a.system is null then 'only_theirs'
                when n_validtests_growth = valid_tests_growth then 'match' else 'mismatch' end as status
        from a full join b on a.system = b.system and a.school = b.schoolnumber and a.subgroup = b.subgroup""",
    "duplicate_audit": f"""with {FORMATTED_SQL}, {LISTED_SQL}, records as (
            select id, system, school, literacy, composite, prior_level, prior_composite, {_RACE} as reported_race,
                cast(primary_disability is not null as integer) as swd,
                cast(id in (select student_key from listed) as integer) as ed, {', '.join(TIE_BREAK)}
            from formatted),
        chosen as (select * from (select *, row_number() over (partition by id
            order by composite desc nulls last, literacy desc nulls last, {', '.join(TIE_BREAK)}) as rn from records)
            where rn = 1)
        select x.id, {', '.join(f'x.{c} as {c}_x' for c in _AUDITED)}, {', '.join(f'y.{c} as {c}_y' for c in _AUDITED)}
        from records x join chosen y on x.id = y.id""",
}
ORACLES["reconcile_ranges"] = ORACLES["reconcile_mismatch"]
