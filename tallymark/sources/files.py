"""Readers: delimited text and Parquet."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from ..functions.missing import name, nan_to_null_frame, to_long, to_number
from .schemas import Input

# Texts read as missing.
MISSING_TEXT = ["", "NA"]


def read_delimited(
    spark: SparkSession, path, layout: Input, sep: str = ",", base: str | None = None, multi_line: bool = True,
    losses: Observation | None = None,
) -> DataFrame:
    """Text with a header line; columns found by header, renamed to short names.

    A file may have more columns, in any order, but files read together must
    agree on theirs. ``base`` is put before relative paths. Quotes in a quoted
    value are doubled; quoted text keeps its blanks. A line that does not fit
    the header fails the job. Numbers that do not parse become null; ``losses``
    counts them in the job that reads the data (``number_losses`` in one of its own).
    Once that job is done, ``losses.get`` has ``rows``, and per number column, under its
    short name, how many of its values became null. The job has to read all rows, and reads the number
    columns for it, wanted or not.

    A quoted value may hold line breaks, so a file is read by one task; without
    any, ``multi_line=False`` lets Spark split it.
    """
    texts = _read_text(spark, path, layout, sep, base, multi_line)
    if losses is not None:
        lost = [F.count_if(there & ~kept).alias(layout.renames[c]) for c, there, kept in _number_checks(layout)]
        texts = texts.observe(losses, F.count(F.lit(1)).alias("rows"), *lost)
    return _renamed(texts, layout)


def number_losses(
    spark: SparkSession, path, layout: Input, sep: str = ",", base: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Per number column of a file: its values, and those that become null because they do not parse."""
    texts = _read_text(spark, path, layout, sep, base, multi_line)
    pairs = [
        F.struct(F.lit(c).alias("column"), there.alias("there"), kept.alias("kept"))
        for c, there, kept in _number_checks(layout)
    ]
    return (
        texts.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.column")
        .agg(F.count_if("p.there").alias("n_values"), F.count_if(F.col("p.there") & ~F.col("p.kept")).alias("n_lost"))
    )


def _number_checks(layout: Input) -> list[tuple[str, Column, Column]]:
    """Per number column: its header, whether a value is there, and whether it parses."""
    return [
        (f.name, _known(f.name).isNotNull(), _number(_known(f.name), f.dataType).isNotNull())
        for f in layout.schema if not isinstance(f.dataType, StringType)
    ]


def _read_text(spark, path, layout, sep, base, multi_line) -> DataFrame:
    """All columns of the header as text."""
    paths = [_under(base, p) for p in ([path] if isinstance(path, (str, os.PathLike)) else path)]
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line}
    header = spark.read.options(**options).csv(paths, inferSchema=False).columns
    absent = [h for h in layout.renames if h not in header]
    if absent:
        raise ValueError(f"{paths} lack the columns {absent}")
    schema = ", ".join(f"`{h.replace('`', '``')}` string" for h in header)
    return spark.read.schema(schema).options(**options).csv(paths, enforceSchema=False, mode="FAILFAST")


def _known(column: str) -> Column:
    """A text column without the texts that stand for missing."""
    return F.when(~F.trim(name(column)).isin(MISSING_TEXT), name(column))


def _number(text: Column, kind) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        return to_number(text).cast(kind)
    return to_long(text).try_cast(kind)


def read_csv(
    spark: SparkSession, path, layout: Input, base: str | None = None, multi_line: bool = True,
    losses: Observation | None = None,
) -> DataFrame:
    return read_delimited(spark, path, layout, ",", base, multi_line, losses)


def read_tsv(
    spark: SparkSession, path, layout: Input, base: str | None = None, multi_line: bool = True,
    losses: Observation | None = None,
) -> DataFrame:
    return read_delimited(spark, path, layout, "\t", base, multi_line, losses)


def read_parquet(spark: SparkSession, path, layout: Input | None = None, base: str | None = None) -> DataFrame:
    """Typed records; with ``layout``, its columns under their short names."""
    df = spark.read.parquet(_under(base, path))
    return df if layout is None else _renamed(df, layout)


def _under(base: str | None, path) -> str:
    path = os.fspath(path)
    relative = base is not None and "://" not in path and not path.startswith("/")
    return f"{base.rstrip('/')}/{path}" if relative else path


def _renamed(df: DataFrame, layout: Input) -> DataFrame:
    columns = []
    for field in layout.schema:
        if isinstance(df.schema[field.name].dataType, StringType):
            text = _known(field.name)
            column = text if isinstance(field.dataType, StringType) else _number(text, field.dataType)
        else:
            column = name(field.name).cast(field.dataType)
        columns.append(column.alias(layout.renames[field.name]))
    return nan_to_null_frame(df.select(*columns))
