"""Carry the last known value forward over a table in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.missing import name
from .ranges import before_ranges, with_ranges


def int_steps(column: Column, step_bits: int = 10, bits: int = 63) -> list[Column]:
    """A non-negative whole number as coarse-to-fine steps of equal width.

    Each step has at most ``2 ** step_bits`` values inside the one before (the
    first one too, if the numbers stay under ``2 ** bits``).
    """
    steps = -(-bits // step_bits)
    shifts = [step_bits * i for i in range(steps - 1, -1, -1)]
    return [F.shiftright(column, s) if s else column for s in shifts]


def carry_forward(
    df: DataFrame,
    column: str,
    order: list[str],
    path: list[Column] | None = None,
    leading=None,
    out: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Fill missing values of ``column`` with the last known one before them.

    ``order`` is a total order of the rows, ascending, nulls last. Rows before
    the first known value get ``leading``. The result goes to ``out`` (default:
    ``column``).

    The order is cut into ranges, each filled alone; the value a range starts
    with is found among the ranges. Ranges are of even size whatever the order's
    columns hold; the rows are shuffled once, and written in that place. A
    range should fit a task's sort: give (rows / some million) ``buckets``; the
    default is the number of shuffle partitions, which is set by that rule anyway.
    This form runs the jobs of ``with_ranges``.

    ``path`` needs no sample: it cuts by expressions that rise with the order,
    coarse to fine, such as its first columns; no task then sees more than the
    rows of one finest bucket or the children of another (``df`` is read twice).
    """
    if path is None:
        result = _by_ranges(df, column, order, buckets)
    else:
        result = _by_path(df, column, order, path)
    filled = F.col("_filled")
    if leading is not None:
        filled = F.coalesce(filled, F.lit(leading).cast(df.schema[column].dataType))
    target = out or column
    kept = [filled.alias(c) if c == target else name(c) for c in df.columns]
    if target not in df.columns:
        kept.append(filled.alias(target))
    return result.select(*kept)


def _by_ranges(df: DataFrame, column: str, order: list[str], ranges: int | None) -> DataFrame:
    rows = with_ranges(df, order, ranges)
    last = _last_known(rows, ["_range", "_task"], name(column), [name(c) for c in order])
    before = before_ranges(last, F.last("_value", ignorenulls=True))
    so_far = (
        Window.partitionBy("_task").orderBy(*[name(c).asc_nulls_last() for c in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = rows.withColumn("_inside", F.last(name(column), ignorenulls=True).over(so_far))
    # a row per range
    return inside.join(F.broadcast(before), "_task").withColumn("_filled", F.coalesce("_inside", "_before"))


def _by_path(df: DataFrame, column: str, order: list[str], path: list[Column]) -> DataFrame:
    known = name(column)
    steps = [f"_step{i}" for i in range(len(path))]
    rows = df.withColumns({s: p for s, p in zip(steps, path)})

    # Last known value per bucket, from the finest buckets up.
    last = {len(steps): _last_known(rows, steps, known, [name(c) for c in order])}
    for depth in range(len(steps) - 1, 0, -1):
        last[depth] = _last_known(last[depth + 1], steps[:depth], F.col("_value"), [F.col(steps[depth])])

    # Value each bucket starts with, from the coarsest buckets down.
    start = None
    for depth in range(1, len(steps) + 1):
        parent, step = steps[: depth - 1], steps[depth - 1]
        buckets = last[depth].withColumn("_row", F.lit(True))
        if start is not None:
            buckets = buckets.unionByName(start.withColumn("_row", F.lit(False)), allowMissingColumns=True)
        before = (
            Window.partitionBy(*map(F.col, parent))
            .orderBy(F.col("_row").asc(), F.col(step).asc_nulls_last())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        start = (
            buckets.withColumn("_start", F.last("_value", ignorenulls=True).over(before))
            .where("_row")
            .select(*steps[:depth], F.col("_start").alias("_value"))
        )

    # The start value enters each bucket as a row ahead of its rows.
    so_far = (
        Window.partitionBy(*map(F.col, steps))
        .orderBy(F.col("_row").asc(), *[name(c).asc_nulls_last() for c in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = F.last("_value", ignorenulls=True).over(so_far)
    ahead = start.withColumn("_row", F.lit(False))
    filling = rows.withColumns({"_value": known, "_row": F.lit(True)}).unionByName(ahead, allowMissingColumns=True)
    return filling.withColumn("_filled", filled).where("_row")


def _last_known(df: DataFrame, keys: list[str], value: Column, order: list[Column]) -> DataFrame:
    # A struct compares null first, so each part is led by its null flag.
    place = F.struct(*[part for c in order for part in (c.isNull(), c)])
    return df.groupBy(*map(F.col, keys)).agg(
        F.max_by(value, F.when(value.isNotNull(), place)).alias("_value")
    )
