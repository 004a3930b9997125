"""Stacking differently sourced years, and long to wide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NullType, NumericType

from ..functions.missing import name


def stack_by_name(*frames: DataFrame) -> DataFrame:
    """Union by column name, filling absent columns with null.

    Whole numbers widen to doubles where needed; a text column against a
    number column is an error here rather than in the middle of the job.
    """
    seen: dict[str, object] = {}
    for df in frames:
        for field in df.schema.fields:
            kind = _kind(field.dataType)
            if kind is None:
                continue
            if seen.setdefault(field.name, kind) != kind:
                raise TypeError(f"column {field.name!r} is {seen[field.name]} in one table and {kind} in another")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _kind(data_type) -> str | None:
    if isinstance(data_type, NullType):
        return None
    return "number" if isinstance(data_type, NumericType) else data_type.typeName()


def spread(df: DataFrame, keys: list[str], by: str, value: str, values: list, prefix: str = "") -> DataFrame:
    """One row per key with a column per listed value of ``by``.

    One aggregation by ``keys`` alone. A key with two rows for one value of
    ``by`` keeps the larger.
    """
    return df.groupBy(*map(name, keys)).agg(
        *[F.max(F.when(name(by) == F.lit(v), name(value))).alias(f"{prefix}{v}") for v in values]
    )
