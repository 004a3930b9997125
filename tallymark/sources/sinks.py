"""Sinks: delimited reports and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.missing import name
from ..operators.ranges import row_places


def write_csv(
    df: DataFrame,
    path: str,
    na: str = "",
    undefined: dict[str, Column] | None = None,
    one_file: bool = False,
    order_by: list[str] = (),
    sep: str = ",",
    place: str | None = None,
) -> None:
    """Write with a header, missing values as ``na``.

    ``undefined`` maps a rate column to the condition under which it is printed
    as ``NaN`` (a rate over no tests) rather than ``na``. Text keeps its blanks;
    quotes in it are doubled. ``one_file`` is for reports that one task can
    write; without it the output is a folder of part files, in ``order_by`` order.
    ``place`` names a column to add last: each row's place, from 1, in that order.
    """
    if place is not None:
        df = row_places(df, list(order_by), place)
    for column, condition in (undefined or {}).items():
        if not isinstance(df.schema[column].dataType, (DoubleType, FloatType)):
            raise TypeError(f"{column} is not a floating-point column")
        df = df.withColumn(column, F.when(condition, F.lit(float("nan"))).otherwise(name(column)))
    order = [name(c).asc_nulls_last() for c in order_by]
    if one_file:
        df = df.repartition(1).sortWithinPartitions(*order) if order else df.repartition(1)
    elif order:
        df = df.orderBy(*order)
    df.write.mode("overwrite").csv(
        path, header=True, nullValue=na, emptyValue='""', sep=sep, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def run_stamp() -> Column:
    """Today as yyyymmdd, for output paths."""
    return F.date_format(F.current_date(), "yyyyMMdd")
