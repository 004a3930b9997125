"""Keyed joins: null keys that match, suffixes, fan-out checks, hot keys.

No join forces a broadcast of data whose size is unknown: crosswalks are left
to Spark, which broadcasts them only under ``autoBroadcastJoinThreshold``. What
is broadcast by hint has a bound stated next to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..functions.missing import name, present
from .settle import settle

ROWS_PER_TASK = 1_000_000  # a key with more rows than this is split


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str | tuple[str, str]],
    how: str = "left",
    null_keys: str = "match",
    expect: str = "many",
    suffixes: tuple[str, str] = ("_x", "_y"),
    hot: str | None = None,
    salts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    counts: JoinCounts | None = None,
) -> DataFrame:
    """Equi-join keeping one key column per pair.

    ``on`` holds names, or (left name, right name) pairs; the left name stays.
    ``null_keys="match"`` joins missing with missing. ``expect="one"`` fails the
    job if a key occurs twice on the right. Other columns present on both sides
    get ``suffixes``. ``hot`` names the side on which one key may hold a large
    share of the rows. Where Spark itself splits that side (adaptive execution,
    on by default, does for the left side of left joins and both of inner ones),
    nothing is counted. Else that side's keys are counted first (or ``salts``
    given, from ``hot_keys``), and the rows of those found are spread over
    several tasks. ``counts`` tells of a left join, once a job has made all its rows,
    how many came in, found a partner and are more than came in.
    """
    if counts is not None and how != "left":
        raise ValueError("counts are of left joins")
    if how not in ("left", "inner", "full"):
        raise ValueError("how is 'left', 'inner' or 'full'")
    if null_keys not in ("match", "never"):
        raise ValueError("null_keys is 'match' or 'never'")
    if expect not in ("one", "many"):
        raise ValueError("expect is 'one' or 'many'")
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    left_keys = [l for l, _ in pairs]
    right_keys = [r for _, r in pairs]
    if expect == "one":
        right = one_per_key(right, right_keys)

    left_rest = [c for c in left.columns if c not in left_keys]
    right_rest = [c for c in right.columns if c not in right_keys]
    # Own names on both sides, so that a frame can be joined with itself.
    l = left.select(
        *[name(k).alias(f"_lk{i}") for i, k in enumerate(left_keys)],
        *[name(c).alias(f"_l_{c}") for c in left_rest],
    )
    r = right.select(
        *[name(k).alias(f"_rk{i}") for i, k in enumerate(right_keys)],
        *[name(c).alias(f"_r_{c}") for c in right_rest],
    )
    if counts is not None:
        l = l.observe(counts.before, F.count(F.lit(1)).alias("n_left"))
        r = r.withColumn("_there", F.lit(True))
    lk = [f"_lk{i}" for i in range(len(pairs))]
    rk = [f"_rk{i}" for i in range(len(pairs))]
    matched = _same_key(lk, rk, null_keys)

    if salts is None and (how == "inner" or (how, hot) == ("left", "left")):
        hot = None
    if hot is not None and salts is None:
        salts = hot_keys(left, left_keys, rows_per_task) if hot == "left" else hot_keys(right, right_keys, rows_per_task)
    if hot is None or salts.isEmpty():
        joined = l.join(r, matched, how)
    else:
        joined = _salted_join(l, r, lk, rk, matched, how, null_keys, hot, salts)
    if counts is not None:
        matches = F.count_if(F.col("_there").isNotNull())
        joined = joined.observe(counts.after, F.count(F.lit(1)).alias("n_joined"), matches.alias("n_matched"))

    keys = [
        (F.coalesce(F.col(a), F.col(b)) if how == "full" else F.col(a)).alias(k)
        for a, b, k in zip(lk, rk, left_keys)
    ]
    names = _suffixed(left_keys, left_rest, right_rest, suffixes)
    return joined.select(
        *keys,
        *[name(f"_l_{c}").alias(names[0][c]) for c in left_rest],
        *[name(f"_r_{c}").alias(names[1][c]) for c in right_rest],
    )


class JoinCounts:
    """What a left join did to the number of rows, counted in the job that runs it."""

    def __init__(self):
        self.before, self.after = Observation(), Observation()

    def get(self) -> dict[str, int]:
        """n_left rows came in; n_joined came out, n_matched of them with a partner; n_more are beyond those that
        came in, because their key occurs more than once on the right. Waits for the job."""
        found = {**self.before.get, **self.after.get}
        return {**found, "n_more": found["n_joined"] - found["n_left"]}


def _same_key(a: list[str], b: list[str], null_keys: str) -> Column:
    condition = F.lit(True)
    for x, y in zip(a, b):
        same = F.col(x).eqNullSafe(F.col(y)) if null_keys == "match" else F.col(x) == F.col(y)
        condition = condition & same
    return condition


def _suffixed(keys, left_rest, right_rest, suffixes):
    both = set(left_rest) & set(right_rest)
    left_names = {c: c + suffixes[0] if c in both else c for c in left_rest}
    right_names = {c: c + suffixes[1] if c in both or c in keys else c for c in right_rest}
    out = [*keys, *left_names.values(), *right_names.values()]
    if len(set(out)) != len(out):
        raise ValueError(f"the join would give repeated column names: {sorted(out)}")
    return left_names, right_names


def _salted_join(l, r, lk, rk, matched, how, null_keys, hot, salts):
    """Spread each hot key's rows over salts; repeat its few partners per salt."""
    big, small, big_keys, small_keys = (l, r, lk, rk) if hot == "left" else (r, l, rk, lk)

    def with_salts(df, keys, tag, null_keys):
        # Few rows: those of a key, at most one for each ROWS_PER_TASK rows. Spark sees their size.
        of = salts.select(
            *[name(k).alias(f"{tag}{i}") for i, k in enumerate(salts.columns[:-1])],
            F.col("_salts").alias(f"{tag}n"),
        )
        same = _same_key(keys, [f"{tag}{i}" for i in range(len(keys))], null_keys)
        return df.join(of, same, "left").drop(*[f"{tag}{i}" for i in range(len(keys))])

    # Whole-row hash and task number: also splits a mass of identical rows, and
    # gives the same salt again when a lost task is rerun.
    spread = F.pmod(F.xxhash64(*map(name, big.columns), F.spark_partition_id()), F.col("_bn"))
    big = with_salts(big, big_keys, "_b", "match").withColumn(
        "_bsalt", F.when(F.col("_bn").isNull(), F.lit(0).cast("bigint")).otherwise(spread)
    ).withColumns({"_big": F.lit(True), "_salted": F.col("_bn").isNotNull()}).drop("_bn")
    small = with_salts(small, small_keys, "_s", null_keys)
    keeps_small = how == "full" or (how == "left" and hot == "right")
    if keeps_small:
        # A key that the other side lacks is not repeated, so it stays as the one row it is.
        there = big.where(F.col("_salted")).select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(big_keys)]).distinct()
        on_big = _same_key(small_keys, [f"_t{i}" for i in range(len(small_keys))], null_keys)
        small = small.join(there.withColumn("_on_big", F.lit(True)), on_big, "left")
        small = small.withColumn("_sn", F.when(F.col("_on_big"), F.col("_sn"))).drop(
            "_on_big", *[f"_t{i}" for i in range(len(small_keys))]
        )
    big = big.drop("_salted")
    small = small.withColumn(
        "_ssalt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_sn", F.lit(1)) - 1))
    )
    sides = (big, small) if hot == "left" else (small, big)
    joined = sides[0].join(sides[1], matched & (F.col("_bsalt") == F.col("_ssalt")), how)
    if keeps_small:
        # A partner repeated per salt has a match in some salt, so where it has
        # none it is a repeat and not a row of its own.
        joined = joined.where(F.col("_big").isNotNull() | F.col("_sn").isNull())
    return joined


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All keys with more rows than one task should take, with the tasks they need.

    Runs a job that reads the key columns of ``df`` only. There are at most
    (rows / ``rows_per_task``) such keys; the list serves several joins.
    """
    counted = df.groupBy(*map(name, keys)).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_task)
    salts = F.ceil(F.col("_n") / rows_per_task).cast("bigint")
    return settle(counted.select(*map(name, keys), salts.alias("_salts")))


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; the job fails if a key occurs more than once.

    Leaves the rows together and sorted by key, as the join needs them anyway.
    """
    same_key = Window.partitionBy(*map(name, keys)).orderBy(*map(name, keys))
    problem = F.concat(F.lit("more than one row for key "), F.to_json(F.struct(*map(name, keys))))
    check = F.when(F.col("_place") > 1, F.raise_error(problem).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_place", F.row_number().over(same_key)).where(check).drop("_place")


def fan_out(
    left: DataFrame, right: DataFrame, on: list[str | tuple[str, str]], null_keys: str = "match"
) -> DataFrame:
    """Per key of the left side: rows left, rows right, rows a left join gives.

    Both sides are counted before they meet, so no pair of rows is made.
    """
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    n_left = left.groupBy(*[name(l) for l, _ in pairs]).agg(F.count("*").alias("n_left"))
    n_right = right.groupBy(*[name(r) for _, r in pairs]).agg(F.count("*").alias("n_right"))
    joined = keyed_join(n_left, n_right, on, "left", null_keys)
    n_right = F.coalesce("n_right", F.lit(0).cast("bigint"))
    return joined.withColumn("n_right", n_right).withColumn(
        "n_joined", F.col("n_left") * F.greatest(F.col("n_right"), F.lit(1))
    )


def flag_lookup(
    df: DataFrame,
    listed: DataFrame,
    key: str,
    listed_key: str,
    flag: str,
    hot: str | None = "left",
    salts: DataFrame | None = None,
) -> DataFrame:
    """1 where the row's key is on a list (which may repeat keys), else 0.

    A missing key is on the list if the list has a missing key. That is asked
    apart, so that the join is on the plain key and needs no shuffle of its own
    where the rows are already together by it.
    """
    on_list = listed.select(name(listed_key).alias(listed_key)).distinct()
    missing = on_list.agg(F.coalesce(F.max(name(listed_key).isNull()), F.lit(False))).scalar()
    distinct = on_list.where(name(listed_key).isNotNull()).withColumn(flag, F.lit(1))
    joined = keyed_join(df, distinct, [(key, listed_key)], "left", "never", hot=hot, salts=salts)
    found = F.when(name(key).isNull(), missing.cast("int")).otherwise(present(name(flag)))
    return joined.withColumn(flag, found)


def apply_overrides(df: DataFrame, table: list[tuple], keys: list[str], column: str) -> DataFrame:
    """Constants win over the looked-up ``column``; an empty text wins too.

    ``table`` holds key values followed by the constant. It is code, not data,
    so it goes into the plan as one map from key to constant.
    """
    types = [df.schema[k].dataType for k in keys]
    if not table:
        return df
    if len({tuple(row[:-1]) for row in table}) != len(table):
        raise ValueError("an override key occurs twice")

    def key_of(values):
        return F.struct(*[v.cast(t).alias(k) for v, t, k in zip(values, types, keys)])

    constants = F.map_from_arrays(
        F.array(*[key_of([F.lit(v) for v in row[:-1]]) for row in table]),
        F.array(*[F.lit(row[-1]) for row in table]),
    )
    override = F.try_element_at(constants, key_of([name(k) for k in keys]))
    return df.withColumn(column, F.coalesce(override, name(column)))
