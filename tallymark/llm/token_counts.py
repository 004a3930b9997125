"""Token counts of fields or sections of documents, by the offsets of tokens.

A document is encoded once, whole. The vocabulary is one of byte pieces whose
tokens, put together, are the text's bytes; so the lengths of the tokens' bytes,
added up, are the places where tokens begin and end. Tokens and sections are
both ordered by place, and a merge of the two orders finds the tokens of each
section: an interval join in one pass over a row.

A token that crosses a boundary goes by an explicit rule to one section:
``"first"``: that of its first byte; ``"largest"``: the one that holds most of
its bytes, of equal ones the first. So the counts of sections that cover a
document add up to its tokens.

Defined results: a missing or empty text has no section and no token. An empty
section has 0 tokens. Bytes in no section count for none. Repeated rows each
get their counts.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

RULES = ("first", "largest")


@lru_cache(2)
def encoding(path: str, pattern: str):
    """(vocabulary, number of bytes of each token)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(ends: np.ndarray, starts_of: np.ndarray, ends_of: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section.

    ``ends``: where each token ends, in order; sections are [start, end), in
    order and apart from each other.
    """
    begins = np.concatenate([[0], ends[:-1]])
    if not len(starts_of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # first section that ends behind the token's begin, last section that begins before its end
    low = np.searchsorted(ends_of, begins, side="right")
    high = np.searchsorted(starts_of, ends, side="left") - 1
    inside = low <= high
    first, last = low[inside], high[inside]
    begins, ends = begins[inside], ends[inside]
    crossing = (begins < starts_of[first]) | (ends > ends_of[first])
    owner = first.copy()
    owner[(rule == "first") & (begins < starts_of[first])] = -1
    if rule == "largest":
        held = np.minimum(ends_of[first], ends) - np.maximum(starts_of[first], begins)
        for step in range(1, int((last - first).max(initial=0)) + 1):
            # the tokens that reach a section further on; their number falls with each step
            far = np.flatnonzero(first + step <= last)
            section = first[far] + step
            share = np.minimum(ends_of[section], ends[far]) - starts_of[section]
            better = share > held[far]
            owner[far[better]], held[far[better]] = section[better], share[better]
    n = len(starts_of)
    return np.bincount(owner[owner >= 0], minlength=n), np.bincount(owner[(owner >= 0) & crossing], minlength=n)


def lines(text: Column) -> Column:
    """Lengths in bytes of a text's lines; each has the line break that ends it."""
    return _lengths(text, r"(?<=\n)")


def sentences(text: Column) -> Column:
    """Lengths in bytes of a text's sentences; each has the white space character that ends it."""
    return _lengths(text, r"(?<=[.!?][\x20\x09-\x0D])")


def _lengths(text: Column, between: str) -> Column:
    # a text that ends where a part ends has an empty one behind it, which is no section
    return F.filter(F.transform(F.split(text, between), lambda part: F.octet_length(part)), lambda n: n > 0)


def count_sections(
    docs: DataFrame, path: str, pattern: str, text: str = "text", sections=lines, rule: str = "largest"
) -> DataFrame:
    """``docs`` without the text, a row per section: section (from 0), n_bytes, n_tokens, n_crossing.

    ``sections`` makes, of the text's column, the sections' lengths in bytes,
    one after the other from the begin of the text. To count fields, join them
    with ``F.concat`` and give a function that returns the fields' lengths.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    content = F.coalesce(F.col(text), F.lit(""))
    made = ("section", "n_bytes", "n_tokens", "n_crossing")
    rest = [f for f in docs.schema.fields if f.name not in (text, *made)]
    names = [f.name for f in rest]
    rows = docs.select(*names, content.alias("__text"), sections(content).cast("array<long>").alias("__lengths"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{m} long" for m in made)])

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            texts, lengths = batch.column("__text"), batch.column("__lengths")
            for start in range(0, len(batch), 500):
                yield _counted(
                    names, [c.slice(start, 500) for c in columns], texts.slice(start, 500).to_pylist(),
                    lengths.slice(start, 500).to_pylist(), path, pattern, rule,
                )

    return rows.mapInArrow(run, schema)


def _counted(names, columns, texts, sections, path, pattern, rule):
    vocabulary, sizes = encoding(path, pattern)
    repeat, numbers, spans, tokens, crossing = [], [], [], [], []
    for text, lengths in zip(texts, sections):
        lengths = np.array(lengths if text else [], np.int64)
        ends_of = np.cumsum(lengths)
        ends = np.cumsum(sizes[np.array(vocabulary.encode_to_numpy(text, disallowed_special=()), np.int64)])
        n, crossed = attribute(ends, ends_of - lengths, ends_of, rule)
        repeat.append(len(lengths))
        numbers.append(np.arange(len(lengths)))
        spans.append(lengths)
        tokens.append(n)
        crossing.append(crossed)
    row = pa.array(np.repeat(np.arange(len(texts)), repeat))
    made = [pa.array(np.concatenate(x).astype(np.int64)) for x in (numbers, spans, tokens, crossing)]
    return pa.record_batch(
        [*(c.take(row) for c in columns), *made], names=[*names, "section", "n_bytes", "n_tokens", "n_crossing"]
    )
