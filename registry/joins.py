"""Joins: lookups, fan-out, missing keys, overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions.missing import columns_starting, put_first
from tallymark.operators.joins import JoinCounts, apply_overrides, fan_out, flag_lookup, keyed_join
from tallymark.operators.records import student_year_max
from tallymark.operators.settle import settle
from tallymark.plans.reports import SCHOOL_NAMES

from .views import (
    ASSESSMENT_SQL, FORMATTED_SQL, LISTED_SQL, STUDENT_SQL, TIE_BREAK, assessment, formatted, listed, student, table,
)


def flag_lookup_query(spark, sf_dir):
    records = formatted(spark, sf_dir).select("id", *TIE_BREAK)
    return flag_lookup(records, listed(spark, sf_dir), "id", "STUDENT_KEY", "ed")


def _per_school(spark, sf_dir):
    return assessment(spark, sf_dir).groupBy("system", "school").agg(F.count("*").alias("n"))


def _systems(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("system"), F.col("n_name").alias("system_name")
    )


def _schools(spark, sf_dir, name="s_name"):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("system"), F.col("s_suppkey").alias("school"), F.expr(name).alias("school_name")
    )


# Some schools have no name.
_NAME = "case when s_acctbal > 0 then s_name end"


def name_lookup(spark, sf_dir):
    """Names by system and by system and school, key columns first."""
    named = keyed_join(_per_school(spark, sf_dir), _systems(spark, sf_dir), ["system"])
    named = keyed_join(named, _schools(spark, sf_dir, _NAME), ["system", "school"])
    return put_first(named, columns_starting(named, "system", "school"))


def one_to_many(spark, sf_dir):
    """A student's highest value beside each of the student's records."""
    records = assessment(spark, sf_dir)
    best = student_year_max(records, ["id"], ["pl_comp"], all_missing="null")
    enrolled = records.select("id", "system", "school", "k1", "k2")
    return keyed_join(best, enrolled, ["id"], hot="right")


def join_counts(spark, sf_dir):
    """What joining the listed keys' records does to the number of customers, counted by the join itself."""
    counts = JoinCounts()
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    settle(keyed_join(people, listed(spark, sf_dir), [("id", "STUDENT_KEY")], counts=counts))
    found = counts.get()
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{c} long" for c in found))


def system_schools(spark, sf_dir):
    """Each district's count beside every school of the crosswalk."""
    districts = assessment(spark, sf_dir).groupBy("system").agg(F.count("*").alias("n"))
    return keyed_join(districts, _schools(spark, sf_dir), ["system"], hot="right")


def fan_out_query(spark, sf_dir):
    """What joining school rows to the crosswalk by system alone would give."""
    return fan_out(_per_school(spark, sf_dir), _schools(spark, sf_dir), ["system"])


def null_safe_join(spark, sf_dir):
    people = student(spark, sf_dir).select("id", "race_ethnicity")
    sizes = people.groupBy("race_ethnicity").agg(F.count("*").alias("n_race"))
    matched = keyed_join(people, sizes, ["race_ethnicity"], hot="left")
    never = sizes.withColumnRenamed("n_race", "n_known_race")
    return keyed_join(matched, never, ["race_ethnicity"], null_keys="never", hot="left")


OVERRIDES = [(1, 1, "First School"), (3, 3, ""), (4, 4, "Fourth School"), (24, 24, "Last School")]


def overrides(spark, sf_dir):
    named = keyed_join(_per_school(spark, sf_dir), _schools(spark, sf_dir, _NAME), ["system", "school"])
    return apply_overrides(named, OVERRIDES, ["system", "school"], "school_name")


# The published school names, by place in this list, system and school.
_PUBLISHED = """(1, 190, 296, 'East Nashville Middle'), (2, 190, 8053, ''), (3, 190, 8105, 'KA @ The Crossings'),
    (4, 220, 37, 'Dickson Intermediate School'), (5, 570, 22, 'Jackson Central-Merry Early College High'),
    (6, 570, 24, 'Rose Hill School'), (7, 710, 17, 'Baxter Primary'),
    (8, 792, 8160, 'Nexus STEM Academy Middle School'), (9, 792, 8165, 'Memphis STEM Academy'),
    (10, 792, 8175, 'Aspire East Academy'), (11, 940, 71, 'Mill Creek Elementary School'),
    (12, 940, 72, 'Mill Creek Middle School'), (13, 985, 8130, 'Memphis Scholars Raleigh-Egypt'),
    (14, 985, 8135, 'Kirby Middle School'), (15, 985, 8140, 'Hillcrest High School')"""


def default_overrides(spark, sf_dir):
    """Suppliers under the keys of the published table, and some outside it."""
    places = F.array(*[F.struct(F.lit(a).alias("system"), F.lit(b).alias("school")) for a, b, _ in SCHOOL_NAMES])
    key = F.get(places, (F.col("s_suppkey") % 16).cast("int"))
    named = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.coalesce(key["system"], F.lit(1000)).alias("system"),
        F.coalesce(key["school"].cast("bigint"), F.col("s_suppkey")).alias("school"), F.col("s_name").alias("school_name"),
    )
    return apply_overrides(named, SCHOOL_NAMES, ["system", "school"], "school_name")


QUERIES = {
    "join_counts": join_counts,
    "default_overrides": default_overrides,
    "flag_lookup": flag_lookup_query,
    "name_lookup": name_lookup,
    "one_to_many": one_to_many,
    "system_schools": system_schools,
    "fan_out": fan_out_query,
    "null_safe_join": null_safe_join,
    "overrides": overrides,
}

_TIES = ", ".join(TIE_BREAK)
_PER_SCHOOL = "per_school as (select system, school, count(*) as n from assessment group by system, school)"

ORACLES = {
    "flag_lookup": f"""with {FORMATTED_SQL}, {LISTED_SQL}, distinct_keys as (select distinct student_key from listed)
        select id, {_TIES}, cast(student_key is not null as integer) as ed
        from formatted left join distinct_keys on id = student_key""",
    "name_lookup": f"""with {ASSESSMENT_SQL}, {_PER_SCHOOL}
        select system, n_name as system_name, school, {_NAME} as school_name, n from per_school
        left join nation on system = n_nationkey
        left join supplier on system = s_nationkey and school = s_suppkey""",
    "one_to_many": f"""with {ASSESSMENT_SQL}, best as (select id, max(pl_comp) as pl_comp from assessment group by id)
        select b.id, b.pl_comp, n.system, n.school, n.k1, n.k2 from best b left join assessment n on b.id = n.id""",
    "system_schools": f"""with {ASSESSMENT_SQL}, districts as (select system, count(*) as n from assessment group by system)
        select system, n, s_suppkey as school, s_name as school_name
        from districts left join supplier on system = s_nationkey""",
    "fan_out": f"""with {ASSESSMENT_SQL}, {_PER_SCHOOL}, n_left as (
            select system, count(*) as n_left from per_school group by system), n_right as (
            select s_nationkey as system, count(*) as n_right from supplier group by 1)
        select system, n_left, coalesce(n_right, 0) as n_right, n_left * greatest(coalesce(n_right, 0), 1) as n_joined
        from n_left left join n_right using (system)""",
    "null_safe_join": f"""with {STUDENT_SQL}, sizes as (select race_ethnicity, count(*) as n_race from student group by 1)
        select p.id, p.race_ethnicity, a.n_race, b.n_race as n_known_race from student p
        left join sizes a on p.race_ethnicity is not distinct from a.race_ethnicity
        left join sizes b on p.race_ethnicity = b.race_ethnicity""",
    "overrides": f"""with {ASSESSMENT_SQL}, {_PER_SCHOOL}
        select system, school, n, case when system = 1 and school = 1 then 'First School'
            when system = 3 and school = 3 then '' when system = 4 and school = 4 then 'Fourth School'
            when system = 24 and school = 24 then 'Last School' else {_NAME} end as school_name
        from per_school
        left join supplier on system = s_nationkey and school = s_suppkey""",
    "default_overrides": f"""with keys as (select s_suppkey, s_name, s_suppkey % 16 + 1 as k from supplier),
        published as (select * from (values {_PUBLISHED}) as p(k, system, school, published)),
        rows as (select s_suppkey, coalesce(system, 1000) as system, coalesce(school, s_suppkey) as school, s_name
            from keys left join published using (k))
        select s_suppkey, r.system, r.school, case when p.k is null then s_name else published end as school_name
        from rows r left join published p on r.system = p.system and r.school = p.school""",
}
ORACLES["join_counts"] = f"""with {LISTED_SQL}, joined as (
        select c_custkey, student_key from customer left join listed on c_custkey = student_key)
    select (select count(*) from customer) as n_left, count(*) as n_joined, count(student_key) as n_matched,
        count(*) - (select count(*) from customer) as n_more
    from joined"""
