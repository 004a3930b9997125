"""Quality rules whose thresholds come from the documents themselves.

Each document is measured by row expressions. Per language and source, each
measure goes into a mergeable quantile sketch: counts per logarithmic bucket,
as in DDSketch, so sketches merge by adding counts, Spark adds them before the
shuffle, and the result does not depend on the order of rows. The thresholds
are fences around the quartiles, joined back to the documents.

Defined results: a missing or empty text has no words and fails the base rule.
A missing language or source is a group of its own. Rows with equal ids are
judged one by one. An empty table gives an empty table. Columns of the input
that have the name of a measure or of a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.settle import settle
from .text import bound, column_words

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
GROUP = ("lang", "source")


@dataclass(frozen=True)
class Fence:
    """Limits of a measure in a group: ``reach`` quartile distances beyond the
    quartiles, but at least ``margin`` beyond them; values are integers."""

    value: str
    low: bool
    margin: int
    reach: int = 3


#: SQL of integer measures, read by Spark and by DuckDB; ``//`` is integer division.
FENCES = {
    "symbols": Fence("1000 * n_symbols // greatest(word_chars, 1)", low=False, margin=60),
    "repeats": Fence("1000 * n_repeat_words // greatest(n_words, 1)", low=False, margin=300),
    "dup_lines": Fence("1000 * n_dup_lines // greatest(n_words, 1)", low=False, margin=100),
    "word_length": Fence("100 * word_chars // greatest(n_words, 1)", low=True, margin=200),
}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("__words", column_words(F.col(text)))
        .withColumns({
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(content, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")).cast("long"),
        })
        .drop("__words")
    )


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a run of ``size`` words found at least twice."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size))
    )

    def places(hashes):
        numbered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bound(
            numbered,
            lambda s: F.array_sort(F.transform(
                F.filter(
                    s,
                    lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )),
        )

    def covered(positions):
        return F.aggregate(
            positions,
            F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(size), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    def of(hashes):
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(places(hashes)))

    return F.when(F.size(words) < size, 0).otherwise(bound(runs, of))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bucket(value: Column) -> Column:
    """Bucket of a whole number from 0: exact below 32, then 16 buckets for each power of two."""
    shift = F.length(F.bin(value)).cast("int") - 5
    return F.when(value < 32, value).otherwise(16 * shift + F.call_function("shiftright", value, shift))


def bucket_start(number: Column) -> Column:
    shift = (F.floor(number / 16) - 1).cast("int")
    return F.when(number < 32, number).otherwise(F.call_function("shiftleft", number - 16 * shift, shift))


def _value(fence: Fence) -> Column:
    return F.expr(fence.value.replace("//", "div"))


def sketches(documents: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): mergeable by adding ``n``."""
    values = [F.struct(F.lit(name).alias("measure"), _value(f).alias("value")) for name, f in FENCES.items()]
    return (
        documents.where("n_words > 0")
        .select(*GROUP, F.explode(F.array(*values)).alias("m"))
        .groupBy(*GROUP, F.col("m.measure").alias("measure"), bucket(F.col("m.value")).cast("long").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source: lowest and highest value that each measure may have."""
    w = Window.partitionBy(*GROUP, "measure")
    ranked = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))

    def quartile(k):
        return F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket")))

    found = ranked.groupBy(*GROUP, "measure").agg(
        bucket_start(quartile(1)).cast("long").alias("q1"), bucket_start(quartile(3)).cast("long").alias("q3")
    )
    limits = []
    for name, fence in FENCES.items():
        q1, q3 = (F.max(F.when(F.col("measure") == name, F.col(q))) for q in ("q1", "q3"))
        reach = F.greatest(fence.reach * (q3 - q1), F.lit(fence.margin))
        limits += [(q3 + reach).alias(f"{name}_most")] + [(q1 - reach).alias(f"{name}_least")] * fence.low
    return found.groupBy(*GROUP).agg(*limits)


def judged(documents: DataFrame) -> DataFrame:
    """Measured ``documents`` with base_failed and kept.

    The measured rows are written once: the sketches read them, and then the
    verdict does. The thresholds are written too, so Spark knows their size
    and broadcasts them only below its limit; otherwise the join is shuffled
    and Spark splits the partitions of large groups.
    """
    settled = settle(documents.drop("base_failed", "kept"))
    limits = settle(thresholds(sketches(settled)))
    limits = limits.withColumnsRenamed({c: f"__{c}" for c in limits.columns})
    joined = settled.join(limits, [settled[c].eqNullSafe(limits[f"__{c}"]) for c in GROUP], "left")
    outside = F.lit(False)
    for name, fence in FENCES.items():
        outside |= _value(fence) > F.col(f"__{name}_most")
        if fence.low:
            outside |= _value(fence) < F.col(f"__{name}_least")
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False)))
        .select(*settled.columns, "base_failed", "kept")
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``."""
    clash = {c: f"_in_{c}" for c in _MADE if c in docs.columns}
    renamed = docs.withColumnsRenamed(clash)
    kept = judged(measured(renamed, text)).where("kept").select(*renamed.columns)
    return kept.withColumnsRenamed({v: k for k, v in clash.items()})


_MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
