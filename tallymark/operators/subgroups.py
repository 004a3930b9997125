"""Counts and rates for overlapping subgroups at several levels in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import name, rate, total

# The labels of the reports.
ALL = "All Students"
COMBINED = "Black/Hispanic/Native American"
DISADVANTAGED = "Economically Disadvantaged"
LEARNERS = "English Learners"
DISABILITY = "Students with Disabilities"


def subgroup_rates(
    df: DataFrame,
    subgroups: list[tuple[str, Column]],
    measures: dict[str, Column],
    rates: dict[str, tuple[str, str]],
    levels: dict[str, list[str]],
    by_value: list[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Sums of ``measures`` and per cent ``rates`` per level and subgroup.

    ``subgroups`` are (label, condition) pairs, and each value of a ``by_value``
    column is a further subgroup; a row may be in any number of them, also in
    one condition under two labels. ``rates`` map a name to (numerator,
    denominator) measures. ``levels`` map a level's name to its key columns,
    each level's keys beginning the next one's. ``weight`` counts a row so many
    times.

    The level without keys shows every listed subgroup, with zeros for those
    without members. Missing keys are groups of their own.

    Students are summed once, per finest key and combination of subgroups;
    only those sums are repeated per subgroup and level.
    """
    ordered = sorted(levels.items(), key=lambda level: len(level[1]))
    keys = ordered[-1][1]
    if any(cols != keys[: len(cols)] for _, cols in ordered):
        raise ValueError("each level's keys must begin the next level's")

    masks = {
        f"_mask{at}": reduce(
            lambda a, b: a.bitwiseOR(b),
            [F.when(condition, _bit(i)).otherwise(_bit()) for i, (_, condition) in enumerate(part)],
            _bit(),
        )
        for at, part in enumerate(_parts(subgroups))
    }
    weighted = None if weight is None else name(weight)
    rows = F.count("*") if weight is None else F.sum(name(weight))
    by = {f"_v{i}": c for i, c in enumerate(by_value)}
    sums = df.groupBy(
        *map(name, keys), *[m.alias(a) for a, m in masks.items()], *[name(c).alias(a) for a, c in by.items()]
    ).agg(
        *[total(m, weighted).alias(out) for out, m in measures.items()],
        rows.alias("_rows"),
    )

    labels = [
        F.when(F.col(mask).bitwiseAND(_bit(i)) != 0, F.lit(label))
        for mask, part in zip(masks, _parts(subgroups))
        for i, (label, _) in enumerate(part)
    ] + [F.col(a).cast("string") for a in by]
    members = sums.select(
        *map(name, keys),
        F.explode(F.array_compact(F.array(*labels))).alias("subgroup"),
        *map(name, measures),
        "_rows",
    )

    whole = any(not cols for cols in levels.values())
    if whole and subgroups:
        members = members.unionByName(_empty_subgroups(members, [label for label, _ in subgroups]))
    found = _roll_up(members, ordered, keys, list(measures))
    if whole:
        found = found.where((F.col("_rows") > 0) | (F.col("level") == _whole_level(levels)))
    return found.select(
        "level",
        *map(name, keys),
        "subgroup",
        *map(name, measures),
        *[rate(name(num), name(den)).alias(out) for out, (num, den) in rates.items()],
    )


def _parts(subgroups: list, size: int = 62) -> list[list]:
    """Subgroups by mask column: a column of bits holds 62."""
    return [subgroups[at : at + size] for at in range(0, len(subgroups), size)]


def _bit(place: int | None = None) -> Column:
    return F.lit(0 if place is None else 1 << place).cast("bigint")


def _whole_level(levels):
    return next(level for level, cols in levels.items() if not cols)


def _empty_subgroups(members: DataFrame, labels: list[str]) -> DataFrame:
    """A zero row per listed subgroup, with the schema of ``members``."""
    zero = {f.name: F.lit(None if f.name in _keys(members) else 0).cast(f.dataType) for f in members.schema}
    zero["subgroup"] = F.explode(F.array(*map(F.lit, labels)))
    return members.sparkSession.range(1).select(*[zero[c].alias(c) for c in members.columns])


def _keys(members: DataFrame) -> list[str]:
    return members.columns[: members.columns.index("subgroup")]


def _roll_up(members, ordered, keys, measures):
    sums = [F.sum(name(m)).alias(m) for m in [*measures, "_rows"]]
    if len(ordered) == 1:
        level, cols = ordered[0]
        return members.groupBy(*map(name, cols), "subgroup").agg(*sums).withColumn("level", F.lit(level))
    sets = [[name(c) for c in cols] + [F.col("subgroup")] for _, cols in ordered]
    rolled = members.groupingSets(sets, *map(name, keys), "subgroup").agg(
        *sums, F.grouping_id().alias("_rolled")
    )
    # grouping_id has a bit per column, set where it was rolled away (subgroup
    # never is); a null key is data and says nothing about the level.
    level = F.lit(None).cast("string")
    for label, cols in ordered:
        bits = ((1 << (len(keys) - len(cols))) - 1) << 1
        level = F.when(F.col("_rolled") == bits, F.lit(label)).otherwise(level)
    return rolled.withColumn("level", level)


def total_rates(
    df: DataFrame,
    measures: dict[str, Column],
    rates: dict[str, tuple[str, str]],
    weight: str | None = None,
) -> DataFrame:
    """Sums and rates over all rows: always one row."""
    weighted = None if weight is None else name(weight)
    sums = df.agg(*[total(m, weighted).alias(out) for out, m in measures.items()])
    return sums.select("*", *[rate(name(num), name(den)).alias(out) for out, (num, den) in rates.items()])


def sum_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sum chosen flag or count columns per key, each keeping its name."""
    return df.groupBy(*map(name, keys)).agg(*[total(name(c)).alias(c) for c in columns])


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, missing left out, in order."""
    return df.select(name(column)).where(name(column).isNotNull()).distinct().orderBy(name(column))
