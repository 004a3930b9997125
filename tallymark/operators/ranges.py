"""Ranges of rows in a total order, each range the work of one task.

Rows are shuffled by range once and stored in one bucket per range. A first pass
sums up each range, and a second one works inside the ranges, with the sums of
all ranges before already known: both read the buckets, and no row moves again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.missing import name
from .settle import settle


def with_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``, which rises with ``order``, and ``_task``, one value for each range.

    There are ``ranges`` of about even size (default: the number of shuffle
    partitions), fewer for few rows; missing values come last. Rows that are equal in ``order``
    share a range. Runs jobs: Spark samples the order's columns for the borders, and the rows are
    written in buckets by ``_task``, so that a window over it needs no shuffle.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[name(c).asc_nulls_last() for c in order])
    task = F.get(F.lit(_task_keys(spark, n)), F.col("_range"))
    return settle(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_task", task), by=["_task"], buckets=n)


def _task_keys(spark: SparkSession, tasks: int) -> list[int]:
    """Numbers that Spark's hash deals to task 0, 1, ... of ``tasks``."""
    numbers = spark.range(40 * tasks).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("task"))
    found = {r["task"]: r["id"] for r in numbers.groupBy("task").agg(F.min("id").alias("id")).collect()}
    # a task for which there is none shares with another: the ranges stay apart, if not the tasks
    return [found.get(task, -1 - task) for task in range(tasks)]


def before_ranges(sums: DataFrame, value: Column) -> DataFrame:
    """``_task`` and ``_before``: ``value`` (an aggregate such as a last value or a sum) over all ranges before.

    ``sums`` has one row per range, so a single task orders them.
    """
    earlier = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_task", value.over(earlier).alias("_before"))


def row_places(df: DataFrame, order: list[str], out: str = "place", ranges: int | None = None) -> DataFrame:
    """Each row's place, from 1, in ``order``, ascending with missing values last.

    Ranges are counted, and rows numbered inside their range: one shuffle, and no task sorts all rows. Rows
    that are equal in ``order`` have places in any order. Runs the jobs of ``with_ranges``.
    """
    rows = with_ranges(df, order, ranges)
    counts = rows.groupBy("_range", "_task").agg(F.count("*").alias("_rows"))
    before = before_ranges(counts, F.sum("_rows"))
    inside = Window.partitionBy("_task").orderBy(*[name(c).asc_nulls_last() for c in order])
    numbered = rows.withColumn("_inside", F.row_number().over(inside))
    joined = numbered.join(F.broadcast(before), "_task")  # a row per range
    place = F.coalesce("_before", F.lit(0).cast("long")) + F.col("_inside")
    return joined.withColumn(out, place).select(*map(name, df.columns), name(out))
