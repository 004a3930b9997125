"""Compare a report with an independently made one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType, StringType

from ..functions.missing import map_columns, name, to_int
from .joins import keyed_join


def reconcile(
    ours: DataFrame,
    theirs: DataFrame,
    on: list[str | tuple[str, str]],
    measure: tuple[str, str],
    keep: list[str],
    only: str = "mismatch",
    exclude: Column | None = None,
    expect: str = "many",
    ranges: int | None = None,
) -> DataFrame:
    """Rows whose ``measure`` (our name, their name) differs, by key.

    Keys missing on both sides match. ``keep`` are further columns to show.
    ``exclude`` is a condition on the result; rows where it is missing go too.
    ``only="mismatch"`` compares keys present on both sides; ``only="all"``
    keeps every key and says in ``status`` whether it is a ``match``, a
    ``mismatch``, ``only_ours`` or ``only_theirs``. ``expect="one"`` fails the job
    if a key occurs twice on their side.

    For large reports that are nearly equal, ``ranges`` first compares both by so many
    hash ranges of the keys (a job, which reads keys and measures), and only rows of
    ranges that differ are joined; of equal reports none are. It holds for
    ``only="mismatch"``; the other shows every key and so joins all.
    """
    if only not in ("mismatch", "all"):
        raise ValueError("only is 'mismatch' or 'all'")
    if ranges is not None and only == "mismatch":
        ours, theirs = differing_ranges(ours, theirs, on, measure, ranges, expect)
    keys = [k if isinstance(k, str) else k[0] for k in on]
    a, b = map(name, measure)
    if only == "mismatch":
        result = keyed_join(ours, theirs, on, "inner", expect=expect).where(a != b)
        shown = [*keys, measure[1], measure[0], *keep]
    else:
        result = keyed_join(
            ours.withColumn("_ours", F.lit(True)),
            theirs.withColumn("_theirs", F.lit(True)),
            on,
            "full",
            expect=expect,
        ).withColumn(
            "status",
            F.when(F.col("_theirs").isNull(), F.lit("only_ours"))
            .when(F.col("_ours").isNull(), F.lit("only_theirs"))
            .when(a.eqNullSafe(b), F.lit("match"))
            .otherwise(F.lit("mismatch")),
        )
        shown = [*keys, measure[1], measure[0], *keep, "status"]
    if exclude is not None:
        result = result.where(~exclude)
    return result.select(*map(name, dict.fromkeys(shown)))


def differing_ranges(
    ours: DataFrame, theirs: DataFrame, on: list[str | tuple[str, str]], measure: tuple[str, str], ranges: int = 4096,
    expect: str = "many",
) -> tuple[DataFrame, DataFrame]:
    """Both reports without the rows of key ranges in which they cannot differ.

    A range is left out if both sides have the same keys in it, with the same
    measures, and each key's rows agree on theirs. Keys and measures are summed per key, combined
    before the shuffle, then per range into digests of two 64-bit sums; only
    the ``ranges`` digests reach the driver. ``expect="one"`` counts rows too, so that a key that
    occurs twice on their side keeps its range and fails the join behind.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    sides = []
    for side, (df, which) in enumerate(((ours, measure[0]), (theirs, measure[1]))):
        kinds = [(ours.schema[l].dataType, theirs.schema[r].dataType) for l, r in pairs]
        keys = [_alike(name(pair[side]), *kind) for pair, kind in zip(pairs, kinds)]
        value = _alike(name(which), ours.schema[measure[0]].dataType, theirs.schema[measure[1]].dataType)
        columns = [k.alias(f"k{i}") for i, k in enumerate(keys)]
        sides.append((df, keys, df.select(*columns, value.alias("v"))))
    # a key's name is the same on both sides, missing parts told from empty ones
    def of_range(keys):
        parts = [part for k in keys for part in (k.isNull(), k)]
        return F.pmod(F.xxhash64(*parts), F.lit(ranges)).cast("int")

    digests = []
    for _, _, compared in sides:
        keys = [F.col(c) for c in compared.columns[:-1]]
        per_key = compared.groupBy(*keys).agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("missing"),
            F.count("*").alias("rows"),
        )
        uneven = ~F.col("low").eqNullSafe(F.col("high")) | ((F.col("missing") > 0) & F.col("low").isNotNull())
        digests.append(
            per_key.groupBy(of_range(keys).alias("range")).agg(
                _digest(keys, 1).alias("d1"), _digest(keys, 2).alias("d2"), F.count("*").alias("keys"),
                F.count_if(uneven).alias("uneven"), F.sum("rows").alias("rows"),
            )
        )
    a, b = ({r["range"]: r for r in d.collect()} for d in digests)
    same = [
        r for r in a.keys() & b.keys()
        if (a[r]["d1"], a[r]["d2"], a[r]["keys"]) == (b[r]["d1"], b[r]["d2"], b[r]["keys"])
        and not a[r]["uneven"] and not b[r]["uneven"] and (expect != "one" or b[r]["rows"] == b[r]["keys"])
    ]
    differ = sorted((a.keys() | b.keys()) - set(same))
    out = []
    for df, keys, _ in sides:
        out.append(df.where(of_range(keys).isin(differ)) if differ else df.limit(0))
    return out[0], out[1]


def _digest(keys: list[Column], seed: int) -> Column:
    parts = [part for k in [*keys, F.col("low")] for part in (k.isNull(), k)]
    # sums of parts of the hash, so that they do not overflow; each key counts, in any order
    hashed = F.xxhash64(F.lit(seed), *parts)
    return F.sum(hashed.cast("decimal(20,0)"))


def _alike(column: Column, mine: DataType, other: DataType) -> Column:
    """Both sides' values in one type, so that equal values have equal hashes."""
    if mine == other:
        # 0.0 and -0.0 are equal
        return column + F.lit(0.0).cast(mine) if isinstance(mine, (DoubleType, FloatType)) else column
    if isinstance(mine, IntegralType) and isinstance(other, IntegralType):
        return column.cast("bigint")
    return column.cast("string")


def comparable_ours(df: DataFrame, subgroups: list[str], relabel: dict[str, str]) -> DataFrame:
    """Our report with the shared subgroups only, under the other side's labels."""
    return df.where(F.col("subgroup").isin(subgroups)).replace(relabel, subset=["subgroup"])


def comparable_theirs(df: DataFrame, without: str, int_keys: list[str]) -> DataFrame:
    """Their report without the complement subgroups, keys as whole numbers."""
    kept = df.where(~F.col("subgroup").contains(without))
    texts = [k for k in int_keys if isinstance(df.schema[k].dataType, StringType)]
    kept = map_columns(kept, texts, to_int) if texts else kept
    numbers = [k for k in int_keys if k not in texts]
    return map_columns(kept, numbers, lambda c: c.try_cast("int")) if numbers else kept
