"""Score bands, fixed growth standards, and points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Half-open score bands [1.0, 1.5), [1.5, 2.0) ... [4.5, 5.0).
SCORE_EDGES = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0]
SCORE_LABELS = ["1.0-1.4", "1.5-1.9", "2.0-2.4", "2.5-2.9", "3.0-3.4", "3.5-3.9", "4.0-4.4", "4.5-4.9"]

# Closed prior-score ranges and the growth each one asks for.
# A prior score between two ranges (1.45) has no standard.
FIXED_STANDARDS = [
    (None, 1.4, 1.3),
    (1.5, 1.9, 0.7),
    (2.0, 2.4, 0.8),
    (2.5, 2.9, 0.7),
    (3.0, 3.4, 0.4),
    (3.5, 3.9, 0.5),
    (4.0, None, 0.4),
]

# Lower ends of points 1, 2, 3, 4, and the smallest reported group.
POINT_CUTS = [25, 40, 50, 60]
MIN_N = 10

GRADE_BANDS = ["elementary", "middle", "high"]


def _first_match(rules) -> Column:
    """CASE over ranges that exclude one another.

    All their tests are missing together, so a missing score falls through to
    null and the rules for missing conditions need no tests of their own.
    """
    return reduce(lambda case, rule: case.when(*rule), rules[1:], F.when(*rules[0]))


def score_band(score: Column, edges=SCORE_EDGES, labels=SCORE_LABELS) -> Column:
    """Label of the half-open band holding ``score``; null outside all bands."""
    if len(edges) != len(labels) + 1:
        raise ValueError("score_band needs one more edge than labels")
    return _first_match(
        [((score >= lo) & (score < hi), label) for lo, hi, label in zip(edges, edges[1:], labels)]
    )


def grade_band(grade: Column) -> Column:
    return _first_match([
        (grade < 5, GRADE_BANDS[0]),
        ((grade > 4) & (grade < 9), GRADE_BANDS[1]),
        (grade > 8, GRADE_BANDS[2]),
    ])


def grade_band_rank(band: Column) -> Column:
    """Sort position of a grade band (names do not sort by level)."""
    return F.array_position(F.array(*map(F.lit, GRADE_BANDS)), band).cast("int")


def fixed_standard(prior: Column, valid: Column | None = None, table=FIXED_STANDARDS) -> Column:
    """Growth asked of a prior score by a fixed table; null where not ``valid``."""
    valid = F.lit(True) if valid is None else valid

    def inside(lo, hi):
        if lo is None:
            return prior <= hi
        return prior >= lo if hi is None else prior.between(lo, hi)

    return _first_match([(valid & inside(lo, hi), standard) for lo, hi, standard in table])


def points(rate: Column, n: Column, cuts=POINT_CUTS, min_n: int = MIN_N) -> Column:
    """0 to ``len(cuts)`` points for a rate; null for groups under ``min_n``."""
    enough = n >= min_n
    bounds = [None, *cuts, None]
    rules = []
    for earned, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        condition = enough
        if lo is not None:
            condition = condition & (rate >= lo)
        if hi is not None:
            condition = condition & (rate < hi)
        rules.append((condition, earned))
    return _first_match(rules)
