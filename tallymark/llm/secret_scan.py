"""Spans of secrets in texts: known forms, and runs of characters of high entropy.

Known forms are found by regular expressions. Other candidates are runs of one
character class. A window slides over each run; its Shannon entropy follows
from the counts of its characters, which are kept up to date as one character
enters and one leaves. A run counts as a secret if the entropy of some window
reaches the limit of its class, unless the allow-list names it.

Everything is an expression on one row: no shuffle, and a text is read whole.
Positions are code points, ends exclusive.

Defined results: a missing or empty text has no spans. Repeated rows each get
their own. Columns of the input that have the name of a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .text import bound

# The known forms.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex")

WINDOW = 20
#: Classes of candidate runs: name -> (pattern of a whole run, bits of entropy that some window must reach).
#: Runs joined by signs come before their alphanumeric parts, which count where the whole does not.
CLASSES = {
    "hexrun": (r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])", 3.0),
    "base64": (
        r"(?<![0-9A-Za-z+/_=-])(?=[0-9A-Za-z]*[+/_=-])(?=[A-Za-z+/_=-]*[0-9])"
        # both cases; or one, if letters and digits alternate in some part, as they do not in paths, slugs and dates
        r"(?:(?=[0-9a-z+/_=-]*[A-Z])(?=[0-9A-Z+/_=-]*[a-z])"
        r"|(?=[0-9A-Za-z+/_=-]*(?:[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9])))"
        r"[0-9A-Za-z+/_=-]{20,}(?![0-9A-Za-z+/_=-])",
        3.9,
    ),
    "alnum": (r"(?<![0-9A-Za-z])(?=[0-9A-Za-z]*[0-9])(?=[0-9A-Za-z]*[A-Za-z])[0-9A-Za-z]{20,}(?![0-9A-Za-z])", 3.6),
}
#: Runs that look random but are not secret: paths and words joined by a sign, counters, placeholders.
ALLOWED = (
    r"(?i)example|placeholder|changeme|your_|dummy|lorem|0123456789|abcdefgh|(.)\1{7,}"
    r"|^([0-9]*[a-z]{2,}[0-9]*[/_-])+[0-9]*[a-z]{2,}[0-9]*$"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
_SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _matches(text: Column, pattern: str, groups=(0,)) -> Column:
    """Each match: start, end and the groups' texts, in order.

    The text between matches is what splitting by the pattern gives, so the
    lengths of both, added up, are the positions.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"),
        *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups],
    )
    none = F.array().cast("array<struct<start:int,end:int" + "".join(f",g{g}:string" for g in groups) + ">>")

    def step(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["g0"])
        one = F.struct(start.alias("start"), end.alias("end"), *[x[f"g{g}"].alias(f"g{g}") for g in groups])
        return F.struct(
            end.alias("at"), F.when(x["g0"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(none)


def _spans(matches: Column, rank: int, kind: str, keep=None) -> Column:
    matches = F.filter(matches, keep) if keep else matches
    return F.transform(
        matches,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")
        ),
    ).cast(f"array<{_SPAN}>")


def base_spans(text: Column) -> list[Column]:
    """Spans of the known forms, one array for each kind."""
    assign = _spans(_matches(text, ASSIGN, (0, 2)), 0, "assign", lambda m: F.length(m["g2"]) >= 8)
    return [assign, _spans(_matches(text, ACCESS), 1, "access"), _spans(_matches(text, HEX), 2, "hex")]


def highest_entropy(run: Column, window: int = WINDOW) -> Column:
    """Most bits of Shannon entropy of the characters in any ``window`` of ``run``.

    With counts c of a window's characters, entropy = log2(w) - sum(c * log2(c)) / w.
    A step of the window changes two counts, and the sum by what these change.
    """
    # c * log2(c) for all counts that a window can have
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])

    def slide(chars, alphabet):
        places = F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int") - 1)

        def over(place):
            none = F.transform(alphabet, lambda _: F.lit(0))
            state = F.struct(none.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(1e9).alias("least"))

            def change(acc, enters):
                leaves = F.when(acc["i"] >= window, F.get(place, acc["i"] - window)).otherwise(-1)

                def with_leaving(out):
                    same = out == enters
                    gone = F.when((out < 0) | same, 0.0).otherwise(
                        F.get(term, F.get(acc["counts"], out) - 1) - F.get(term, F.get(acc["counts"], out))
                    )
                    come = F.when(same, 0.0).otherwise(
                        F.get(term, F.get(acc["counts"], enters) + 1) - F.get(term, F.get(acc["counts"], enters))
                    )
                    total = acc["sum"] + gone + come
                    counts = F.transform(
                        acc["counts"],
                        lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == out, 1).otherwise(0),
                    )
                    least = F.when(acc["i"] >= window - 1, F.least(acc["least"], total)).otherwise(acc["least"])
                    return F.struct(
                        counts.alias("counts"), total.alias("sum"), (acc["i"] + 1).alias("i"), least.alias("least")
                    )

                return bound(leaves, with_leaving)

            return F.aggregate(place, state, change, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)

        return bound(places, over)

    return bound(F.split(run, ""), lambda chars: bound(F.array_distinct(chars), lambda alphabet: slide(chars, alphabet)))


def entropy_spans(text: Column) -> list[Column]:
    """Candidate runs whose entropy reaches the limit of their class, without allowed ones."""
    def random(limit):
        return lambda m: ~m["g0"].rlike(ALLOWED) & (highest_entropy(m["g0"]) >= limit)

    return [
        _spans(_matches(text, pattern), 3 + k, kind, random(limit))
        for k, (kind, (pattern, limit)) in enumerate(CLASSES.items())
    ]


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``found``, arrays of (start, rank, kind, end) in order.

    ``found`` holds the base spans and those that entropy adds; an added one
    that overlaps a base span, or one of a class before it, is left out.
    """
    content = F.coalesce(F.col(text), F.lit(""))

    def joined_by(later):
        def apart(x, earlier):
            return ~F.exists(earlier, lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"]))

        return lambda earlier: F.concat(earlier, F.filter(later, lambda x: apart(x, earlier)))

    found = F.col("base")
    for spans in entropy_spans(content):
        found = bound(found, joined_by(spans))
    return docs.withColumn("base", F.array_sort(F.concat(*base_spans(content)))).withColumn("found", F.array_sort(found))


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask``; overlapping spans by one mask."""
    names = {c: f"__in_{c}" for c in ("base", "found") if c in docs.columns}
    found = find_secrets(docs.withColumnsRenamed(names), text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        between = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], between, F.lit(mask))).alias("out"),
            )
        )

    masked = F.aggregate(
        "found", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))
    )
    return (
        found.withColumn(text, F.when(F.size("found") > 0, masked).otherwise(F.col(text)))
        .drop("base", "found")
        .withColumnsRenamed({v: k for k, v in names.items()})
    )


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
