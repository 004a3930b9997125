"""Exact quantiles by linear interpolation, for groups of any size.

``percentile`` keeps every distinct value of a group in one task's memory. Here
equal values are counted first, which combines before the shuffle and gives each
group a summary of values and counts. Where no group has more values than one
task should rank, and there are few groups, the summaries give the quantiles in
one query, and nothing is written. Else a group with more values is cut into
slices, and only those holding a wanted rank are kept.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.missing import name, nan_to_null
from .settle import settle

TASK_VALUES = 1_000_000  # distinct values that one task may rank
FEW_GROUPS = 10_000  # groups whose quantiles may come to the driver
SLICES = 64  # a power of two


def exact_quantiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    probs: dict[str, float],
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """One row per group: a column per quantile and ``n``, its rows.

    Quantile p of m values lies at place 1 + p * (m - 1), between the two nearest
    values. Null and NaN values count in ``n`` only. A group may hold any share
    of the rows, and there may be any number of groups. Building the result runs
    jobs: the summaries are ranked, and where they show a group of more than
    ``task_values`` values or more than ``FEW_GROUPS`` groups, the counts are
    written and cut into slices.
    """
    keys = list(map(name, groups))
    x = nan_to_null(name(value).cast("double"))
    counts = df.groupBy(*keys, x.alias("_x")).agg(F.count("*").alias("_n"))
    found = _from_summaries(counts, groups, probs, task_values)
    return _by_slices(settle(counts), groups, probs, task_values) if found is None else found


def _from_summaries(counts: DataFrame, groups: list[str], probs: dict[str, float], task_values: int) -> DataFrame | None:
    """The quantiles, or nothing if a group has too many values or there are too many groups.

    A task takes at most ``task_values`` + 1 values of a group: the first ones tell that there are more.
    """
    keys = list(map(name, groups))
    in_order = Window.partitionBy(*keys).orderBy(F.col("_x").asc_nulls_last())
    first = counts.withColumn("_at", F.row_number().over(in_order)).where(F.col("_at") <= task_values + 1)
    whole = Window.partitionBy(*keys)
    values = F.when(F.col("_x").isNotNull(), F.col("_n"))
    ranked = first.withColumns({
        "_end": F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
        "_m": F.sum(values).over(whole),
    })
    found = ranked.groupBy(*keys).agg(
        F.max("_m").alias("_m"), F.sum("_n").alias("n"), F.count("_x").alias("_values"), *_at_ranks(probs)
    )
    quantiles = found.select(*keys, *_between(probs), "n", (F.col("_values") > task_values).alias("_more"))
    rows = quantiles.limit(FEW_GROUPS + 1).collect()
    if len(rows) > FEW_GROUPS or any(r["_more"] for r in rows):
        return None
    return counts.sparkSession.createDataFrame(rows, quantiles.schema).drop("_more")


def _by_slices(counts: DataFrame, groups: list[str], probs: dict[str, float], task_values: int) -> DataFrame:
    keys = list(map(name, groups))
    values = F.when(F.col("_x").isNotNull(), F.col("_n"))
    totals = counts.groupBy(*keys).agg(
        F.sum(values).alias("_m"), F.sum("_n").alias("n"), F.count("_x").alias("_values")
    )
    largest = totals.agg(F.coalesce(F.max("_values"), F.lit(0))).first()[0]

    known = _with_groups(counts.where("_x is not null"), totals.drop("n", "_values"), groups)
    known = known.withColumns({"_slice": F.lit(0).cast("bigint"), "_before": F.lit(0).cast("bigint")})
    while largest > task_values:
        known = settle(_wanted_slices(known, groups, list(probs.values())))
        before, largest = largest, _largest(known, groups)
        if largest == before:
            raise RuntimeError(f"a slice of {largest} values could not be cut to {task_values}")

    running = Window.partitionBy(*keys, "_slice").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ends = known.withColumn("_end", F.col("_before") + F.sum("_n").over(running))
    found = ends.groupBy(*keys).agg(F.max("_m").alias("_m"), *_at_ranks(probs))
    quantiles = found.select(*keys, *_between(probs))
    return _with_groups(totals.drop("_m", "_values"), quantiles, groups, "left").select(*keys, *map(name, probs), "n")


def _at_ranks(probs: dict[str, float]) -> list:
    """For each rank that a quantile lies between: the value there, from each value's last rank ``_end``."""
    ranks = [rank for p in probs.values() for rank in _ranks(p)]
    return [F.min(F.when(F.col("_end") > rank, F.col("_x"))).alias(f"_at{i}") for i, rank in enumerate(ranks)]


def _between(probs: dict[str, float]) -> list:
    """The quantiles, from the values at their two ranks."""
    out = []
    for i, (label, p) in enumerate(probs.items()):
        low, high = F.col(f"_at{2 * i}"), F.col(f"_at{2 * i + 1}")
        part = _place(p) - F.floor(_place(p))
        out.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(label))
    return out


def _place(p: float):
    return 1 + p * (F.col("_m") - 1)


def _ranks(p: float):
    """The two ranks, from 0, that a quantile lies between."""
    return F.floor(_place(p)) - 1, F.ceil(_place(p)) - 1


def _largest(known: DataFrame, groups: list[str]) -> int:
    return known.groupBy(*map(name, groups), "_slice").count().agg(F.max("count")).first()[0] or 0


def _wanted_slices(known: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """Cut every slice of a group further; keep the parts that hold a wanted rank."""
    slice_keys = [*groups, "_slice"]
    # The borders come from a sketch; they only have to be roughly even.
    cuts = [i / SLICES for i in range(1, SLICES)]
    sketch = known.groupBy(*map(name, slice_keys)).agg(F.percentile_approx("_x", cuts, 4 * SLICES).alias("_borders"))
    cut = _with_groups(known, sketch, slice_keys).withColumn("_part", _n_below("_borders", "_x")).drop("_borders")

    running = Window.partitionBy(*map(name, slice_keys)).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    sizes = (
        cut.groupBy(*map(name, slice_keys), "_part")
        .agg(F.sum("_n").alias("_size"), F.max("_before").alias("_before"), F.max("_m").alias("_m"))
        .withColumn("_start", F.col("_before") + F.sum("_size").over(running) - F.col("_size"))
    )
    start, end = F.col("_start"), F.col("_start") + F.col("_size")
    holds = [(rank >= start) & (rank < end) for p in probs for rank in _ranks(p)]
    wanted = sizes.where(reduce(or_, holds)).drop("_size", "_before", "_m")
    kept = _with_groups(cut, wanted, [*slice_keys, "_part"])
    return kept.withColumns({"_slice": F.col("_slice") * SLICES + F.col("_part"), "_before": F.col("_start")}).drop(
        "_part", "_start"
    )


def _n_below(borders: str, x: str):
    """How many of the SLICES - 1 sorted borders are below x, by halving."""
    steps = [SLICES >> i for i in range(1, SLICES.bit_length())]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(F.col(borders), at + step - 1) < F.col(x), at + step).otherwise(at),
    ).cast("bigint")


def _with_groups(df: DataFrame, per_group: DataFrame, groups: list[str], how: str = "inner") -> DataFrame:
    """Attach a table with a few rows per group; missing groups match.

    Spark broadcasts the table where it is small enough.
    """
    renamed = per_group.select(
        *[name(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        *[name(c) for c in per_group.columns if c not in groups],
    )
    same = reduce(lambda a, b: a & b, [name(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)])
    return df.join(renamed, same, how).drop(*[f"_g{i}" for i in range(len(groups))])


def percentile_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The same result by Spark's ``percentile``.

    One aggregation, for values on a grid: each group's distinct values must
    fit in a task (scores with one decimal from 1.0 to 6.0 have at most 2,600
    distinct differences).
    """
    x = nan_to_null(name(value).cast("double"))
    wanted = F.percentile(x, F.array(*[F.lit(float(p)) for p in probs.values()]))
    out = df.groupBy(*map(name, groups)).agg(wanted.alias("_q"), F.count("*").alias("n"))
    return out.select(
        *map(name, groups), *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(probs)], "n"
    )
