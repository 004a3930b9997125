"""Missing-value rules that differ from SQL defaults.

The domain's arithmetic treats a missing condition as missing (SQL's CASE takes
ELSE), sums nothing to zero (SQL gives null), divides 0 by 0 to missing (ANSI
mode raises) and rounds halves to even (``round`` goes up).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

# Texts that count as a number; anything else becomes null.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def name(column: str) -> Column:
    """A column by its literal name, dots, spaces and slashes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def strict_if(condition: Column, yes, no) -> Column:
    """``yes`` / ``no`` by condition; a null condition gives null, never ``no``."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def strict_chain(rules, default=None) -> Column:
    """Apply ``(condition, value)`` rules in order, the last true one winning.

    Every rule is a ``strict_if``: one null condition wipes what the earlier
    rules decided.
    """
    return reduce(lambda so_far, rule: strict_if(rule[0], F.lit(rule[1]), so_far), rules, F.lit(default))


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def nan_to_null_frame(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating-point column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: nan_to_null(name(c)) for c in floating}) if floating else df


def missing_to_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def present(column: Column) -> Column:
    """1 where any value is there, an ``"N"`` included; 0 where missing."""
    return column.isNotNull().cast("int")


def total(column: Column, weight: Column | None = None) -> Column:
    """Sum of a flag or whole number ignoring nulls; 0 over nothing.

    ``weight`` counts a row that many times. A value with a fraction fails the
    job: it would be cut.
    """
    number = column.cast("double")
    fraction = F.raise_error(F.concat(F.lit("not a whole number: "), column.cast("string"))).cast("bigint")
    value = F.when(number.isNull() | (number == F.floor(number)), column.cast("bigint")).otherwise(fraction)
    return F.coalesce(F.sum(value if weight is None else value * weight), F.lit(0).cast("bigint"))


def rate(numerator: Column, denominator: Column, digits: int = 1) -> Column:
    """Per cent, halves to even; null over a zero denominator."""
    return F.bround(F.try_divide(F.lit(100.0) * numerator, denominator), digits)


def to_number(text: Column) -> Column:
    """Text to double; text that is not a number gives null."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def to_int(text: Column) -> Column:
    """Text to integer, cutting decimals toward zero; other text gives null."""
    return to_number(text).try_cast("int")


def to_long(text: Column) -> Column:
    """Text to a 64-bit whole number, every digit kept; decimals are cut toward zero."""
    return F.when(text.rlike(NUMBER_TEXT), F.coalesce(F.trim(text).try_cast("bigint"), to_number(text).try_cast("bigint")))


def replace_first(column: Column, pattern: str, replacement: str = "") -> Column:
    """Replace the first match of ``pattern`` (without capture groups) only."""
    return F.regexp_replace(column, f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def clean_code(column: Column, prefix: str) -> Column:
    """A code such as ``prefix00470`` as an integer."""
    return to_int(replace_first(column, prefix))


def cast_losses(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: the values there before and lost by ``to_number``."""
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            name(c).isNotNull().alias("there"),
            to_number(name(c)).isNotNull().alias("kept"),
        )
        for c in columns
    ])
    return (
        df.select(F.explode(pairs).alias("p"))
        .groupBy("p.column")
        .agg(
            F.count_if("p.there").alias("n_values"),
            F.count_if(F.col("p.there") & ~F.col("p.kept")).alias("n_lost"),
        )
    )


def columns_starting(df: DataFrame, *prefixes: str) -> list[str]:
    """Column names by prefix, ignoring case, in the order of the prefixes."""
    return [c for p in prefixes for c in df.columns if c.lower().startswith(p.lower())]


def columns_containing(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part.lower() in c.lower()]


def put_first(df: DataFrame, first: list[str]) -> DataFrame:
    """Move columns to the front, losing none."""
    head = list(dict.fromkeys(first))
    return df.select(*map(name, head), *[name(c) for c in df.columns if c not in head])


def map_columns(df: DataFrame, columns: list[str], fn) -> DataFrame:
    """One function over chosen columns, replacing each."""
    return df.withColumns({c: fn(name(c)) for c in columns})
