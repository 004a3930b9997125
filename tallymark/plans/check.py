"""Check our school report against another analyst's."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.reconcile import comparable_ours, comparable_theirs, reconcile
from ..operators.subgroups import ALL, COMBINED, DISABILITY, LEARNERS

# The shared subgroups, the other file's label for one of them,
# and the mark of its complement subgroups.
SHARED = [ALL, COMBINED, LEARNERS, DISABILITY]
THEIR_LABELS = {LEARNERS: "English Language Learners"}
COMPLEMENT = "Non-"


def check_report(
    ours: DataFrame, theirs: DataFrame, only: str = "mismatch", exclude: str | None = DISABILITY, ranges: int | None = None
) -> DataFrame:
    """Schools and subgroups whose number of valid growth tests differs.

    ``ranges`` compares large reports by so many ranges of keys first (``reconcile``).
    """
    return reconcile(
        comparable_ours(ours, SHARED, THEIR_LABELS),
        comparable_theirs(theirs, COMPLEMENT, ["system", "schoolnumber"]),
        ["system", ("school", "schoolnumber"), "subgroup"],
        ("valid_tests_growth", "n_validtests_growth"),
        keep=["valid_tests", "valid_tests_exit"],
        only=only,
        exclude=None if exclude is None else F.col("subgroup") == exclude,
        ranges=ranges,
    )
