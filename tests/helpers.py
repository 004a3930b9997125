from __future__ import annotations

import math


def rows(df, *columns):
    """Result rows as sorted tuples (missing last), of the named columns."""
    picked = df.select(*columns) if columns else df
    return sort_rows(tuple(r) for r in picked.collect())


def sort_rows(data):
    def key(row):
        return tuple((v is None, str(type(v)), v) for v in row)

    return sorted(data, key=key)


def r_quantile(values, p):
    """Type-7 quantile, written from its definition."""
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    if not values:
        return None
    place = 1 + p * (len(values) - 1)
    low, high = values[math.floor(place) - 1], values[math.ceil(place) - 1]
    part = place - math.floor(place)
    return low if low == high else (1 - part) * low + part * high


def plan(df) -> str:
    """The physical plan as first made, also if the frame has run already."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()
