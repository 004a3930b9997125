"""One record per student, one value per student-year, and their audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (
    BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, TimestampType,
)

from ..functions.missing import name, nan_to_null
from .joins import keyed_join


def _sortable(df: DataFrame, column: str) -> Column:
    """NaN sorts as missing, so last, like null."""
    floating = isinstance(df.schema[column].dataType, (DoubleType, FloatType))
    return nan_to_null(name(column)) if floating else name(column)


def best_record(
    df: DataFrame, keys: list[str], order: list[str], tie_break: list[str], total: bool = True
) -> DataFrame:
    """The record with the highest ``order`` values per key, whole.

    Missing values rank last; ``tie_break`` decides among equals, ascending.
    ``total=False`` says the two may not give a total order: ties for the best
    place are then looked for first, and raise.

    Spark keeps one row per key and task before the shuffle, so a key with a
    large share of the rows costs no more than any other.
    """
    if not total and not tied_best(df, keys, order + tie_break).isEmpty():
        raise ValueError(f"records tie for the best place by {order + tie_break}")
    w = Window.partitionBy(*map(name, keys)).orderBy(
        *[_sortable(df, c).desc_nulls_last() for c in order],
        *[_sortable(df, c).asc_nulls_last() for c in tie_break],
    )
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def tied_best(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keys whose best place is shared, with the number of records sharing it."""
    ranked = df.withColumns({c: _sortable(df, c) for c in order})
    copies = ranked.groupBy(*map(name, keys), *map(name, order)).agg(F.count("*").alias("n_tied"))
    w = Window.partitionBy(*map(name, keys)).orderBy(
        *[_sortable(copies, c).desc_nulls_last() for c in order]
    )
    best = copies.withColumn("_place", F.row_number().over(w)).where("_place = 1")
    return best.where("n_tied > 1").select(*map(name, keys), "n_tied")


def duplicate_audit(
    df: DataFrame,
    key: str,
    order: list[str],
    tie_break: list[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
    salts: DataFrame | None = None,
    per_key: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Every record beside the record chosen for its key.

    The chosen record is carried along by one aggregation per key, combined
    before the shuffle, with the number of records. A key's only record is
    itself the chosen one and passes no join; only records of keys with several
    are joined with theirs. ``per_key`` may add columns to a table of one row per key; they
    come last, once. Where ``order`` has columns that are not numbers,
    truth values, dates or times, the chosen records are found by ``best_record``.
    """
    if any(_falling(df, c) is None for c in order):
        chosen = best_record(df, [key], order, tie_break)
        chosen = per_key(chosen) if per_key else chosen
        return keyed_join(df, chosen, [key], "inner", suffixes=suffixes, hot="left", salts=salts)
    rest = [c for c in df.columns if c != key]
    place = F.struct(*[
        part.alias(f"p{i}")
        for i, part in enumerate(
            part for value in [*[_falling(df, c) for c in order], *[_sortable(df, c) for c in tie_break]]
            # missing ones last
            for part in (value.isNull(), value)
        )
    ])
    record = F.struct(*[name(c).alias(f"r{i}") for i, c in enumerate(rest)])
    best = df.groupBy(name(key)).agg(F.min_by(record, place).alias("_best"), F.count("*").alias("_records"))

    found = per_key(best) if per_key else best
    added = [name(c) for c in found.columns if c not in best.columns]

    def beside(own: str) -> list[Column]:
        sides = zip(suffixes, (own, "_best"))
        return [F.col(f"{side}.r{i}").alias(c + suffix) for suffix, side in sides for i, c in enumerate(rest)]

    single = found.where("_records = 1").select(name(key), *beside("_best"), *added)
    # a key with a large share of the records is on the left, where Spark splits it
    several = keyed_join(df.select(name(key), record.alias("_own")), found.where("_records > 1"), [key], "inner", salts=salts)
    return single.unionByName(several.select(name(key), *beside("_own"), *added))


def _falling(df: DataFrame, column: str) -> Column | None:
    """A value that falls as the column rises, or nothing where there is none of its type."""
    kind = df.schema[column].dataType
    if isinstance(kind, (DoubleType, FloatType, DecimalType)):
        # + 0.0 makes -0.0 and 0.0 one value
        return -(_sortable(df, column) + F.lit(0).cast(kind))
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return F.bitwise_not(name(column).cast("long"))
    if isinstance(kind, BooleanType):
        return ~name(column)
    if isinstance(kind, DateType):
        return -F.unix_date(name(column))
    if isinstance(kind, TimestampType):
        return -F.unix_micros(name(column))
    return None


def student_year_max(
    df: DataFrame,
    keys: list[str],
    highest: list[str] = (),
    lowest: list[str] = (),
    all_missing: str = "inf",
) -> DataFrame:
    """Maximum / minimum per key, ignoring missing values.

    A group without any value gives -inf / inf with ``all_missing="inf"`` (the
    domain's rule, which keeps such a student in the denominator) and null with
    ``"null"``.
    """
    return df.groupBy(*map(name, keys)).agg(
        *[extreme(F.min(name(c)), "min", all_missing).alias(c) for c in lowest],
        *[extreme(F.max(name(c)), "max", all_missing).alias(c) for c in highest],
    )


def extreme(value: Column, kind: str, all_missing: str) -> Column:
    """An extreme with its value for a group that has rows but no values."""
    if all_missing == "null":
        return value
    if all_missing != "inf":
        raise ValueError("all_missing is 'inf' or 'null'")
    return F.coalesce(value.cast("double"), F.lit(float("inf" if kind == "min" else "-inf")))
