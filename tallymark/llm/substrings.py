"""Removal of passages that an earlier document has too.

A window is ``size`` consecutive words, hashed as in Rabin-Karp: one prefix sum
per text gives the hash of every window. A window that also starts in a
document with a smaller id is repeated; repeated windows of a document merge
into maximal intervals of words, which are removed.

Counting every window in Spark would shuffle more bytes than the texts have.
So each window first gets an anchor, the smallest hash among its runs of
``size // 2`` words. Equal windows have equal anchors, and neighbouring windows
mostly share one, so a text has few. Only windows whose anchor occurs in
several documents can be repeated; all of these are counted, exactly. Tasks know
the shared anchors by a bit field, sized by their number. Beyond ``FIELD_VALUES``
anchors each text gets the list of its own shared ones by a join.

Windows are compared by 96 bits; different ones are taken for equal with a chance of 2**-96 a pair.

Defined results: a missing or empty text has no words. A document without id
is compared with none and keeps its words. Rows with equal ids count as one
document for the others, and each keeps its own text; each is joined with its
own windows only, so that one id may have any number of rows. Ties cannot occur, since
only smaller ids count. An empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.settle import drop_paths, settle, written_paths
from .marks import bit_field, field_bits, may_hold
from .text import chunks, mix, sequences

SIZE = 50
FIELD_VALUES = 1 << 25  # shared anchors up to which tasks get a bit field, then of 32 MB
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def anchors(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """For each window the smallest hash of its runs of ``size // 2`` words."""
    low = sequences(words, size // 2)
    if len(words) < size:
        return low[:0]
    span, have = size - size // 2 + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def checks(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """32 more bits for each window, from other values of its words."""
    return sequences(mix(words ^ np.uint64(size)), size).astype(np.uint32).view(np.int32)


def documents_in(batches, size):
    """(id, key, own shared anchors or nothing, word hashes) of each text that has a window and an id."""
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, words, at in chunks(batch.column(2), lower=False):
            for i in range(len(at) - 1):
                if at[i + 1] - at[i] >= size and ids[first + i] is not None:
                    yield ids[first + i], keys[first + i], _given(batch, first + i), words[at[i] : at[i + 1]]


def _given(batch, row):
    if batch.num_columns < 4 or not batch.column(3)[row].is_valid:
        return None
    return batch.column(3)[row].values.to_numpy().view(np.uint64)


def _as_rows(found, names, limit=1 << 18):
    """Batches of columns: those of one value per text, repeated, and those of its values."""
    rows, held = [], 0

    def made():
        sizes = [len(r[-1]) for r in rows]
        columns = [
            np.concatenate(c) if isinstance(c[0], np.ndarray) else np.repeat(np.array(c, np.int64), sizes) for c in zip(*rows)
        ]
        return pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)

    for row in found:
        rows.append(row)
        held += len(row[-1])
        if held >= limit:
            yield made()
            rows, held = [], 0
    if held:
        yield made()


def with_marks(pairs: DataFrame, size: int):
    """``pairs`` (id, key, text), and which windows of a text have an anchor that several documents have.

    The second is a function of a text's words and its list in the column ``own``, which is there only
    where the anchors are too many for a bit field.
    """

    def anchor_rows(batches):
        found = ((i, k, np.unique(anchors(w, size))) for i, k, _, w in documents_in(batches, size))
        return _as_rows(found, ["id", "key", "anchor"])

    rows = pairs.mapInArrow(anchor_rows, "id long, key long, anchor long")
    before = set(written_paths())
    shared = settle(_in_several(rows, "anchor").select("anchor"))
    used = [p for p in written_paths() if p not in before]
    count = shared.count()
    if count <= FIELD_VALUES:
        field = pairs.sparkSession.sparkContext.broadcast(bit_field(shared, "anchor", field_bits(count)))
        drop_paths(pairs.sparkSession, used)
        return pairs, lambda words, own: may_hold(field.value, anchors(words, size))
    # a text's anchors are no more than its words
    own = rows.join(shared, "anchor", "left_semi").groupBy("id", "key").agg(F.collect_set("anchor").alias("own"))

    def marks(words, own):
        return np.isin(anchors(words, size), own) if own is not None else np.zeros(max(len(words) - size + 1, 0), bool)

    return pairs.join(own, ["id", "key"], "left").select("id", "key", "text", "own"), marks


def repeated_windows(marked: DataFrame, marks, size: int = SIZE) -> DataFrame:
    """(id, key, window) of each window that also starts in a document with a smaller id."""

    def window_rows(batches):
        def of(words, own):
            marked = marks(words, own)
            if not marked.any():  # most texts
                return words[:0], np.zeros(0, np.int32)
            window, first = np.unique(sequences(words, size)[marked], return_index=True)
            return window, checks(words, size)[marked][first]

        return _as_rows(((i, k, *of(w, own)) for i, k, own, w in documents_in(batches, size)), ["id", "key", "window", "check"])

    windows = marked.mapInArrow(window_rows, "id long, key long, window long, check int")
    first = _in_several(windows, "window", "check")
    return windows.join(first, ["window", "check"]).where("id > first").select("id", "key", "window")


def _in_several(rows: DataFrame, *value: str) -> DataFrame:
    """Values that several documents have, with the smallest id; combined before the shuffle."""
    return (
        rows.groupBy(*value).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    )


def intervals(covered_from: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that windows starting at these places cover."""
    if not len(covered_from):
        return []
    gaps = np.flatnonzero(np.diff(covered_from) > size)
    starts = covered_from[np.concatenate([[0], gaps + 1])]
    ends = covered_from[np.concatenate([gaps, [len(covered_from) - 1]])] + size
    return list(zip(starts.tolist(), ends.tolist()))


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Per row of ``docs``: its id, n_words, ``removed`` (maximal intervals of words, ends
    exclusive) and ``kept`` (the words left, joined by one space)."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    marked, marks = with_marks(texts, size)
    # A row's windows are no more than its words, so the list stays as small as its text.
    lists = repeated_windows(marked, marks, size).groupBy("id", "key").agg(F.collect_set("window").alias("windows"))

    def texts_of(batch):
        """(row, its word hashes, whether it may have repeated windows)"""
        for first, words, at in chunks(batch.column(2), lower=False):
            for i in range(len(at) - 1):
                own = words[at[i] : at[i + 1]]
                yield first + i, own, bool(marks(own, _given(batch, first + i)).any())

    def open_rows(batches):
        for batch in batches:
            flags = [is_open for _, _, is_open in texts_of(batch)]
            yield batch.select([0, 1, 2]).filter(pa.array(flags, pa.bool_()))

    def closed_rows(batches):
        for batch in batches:
            rows, made = [], []
            for row, words, is_open in texts_of(batch):
                if not is_open:
                    rows.append(row)
                    made.append(_cut(batch.column(2)[row].as_py(), words, None, size))
            yield _result(batch.column(0).take(pa.array(rows, pa.int64())), made)

    def cut(batches):
        for batch in batches:
            ids, texts, removed = (batch.column(c) for c in ("id", "text", "windows"))
            for first, words, at in chunks(texts, lower=False):
                rows = range(first, first + len(at) - 1)
                made = [_cut(texts[r].as_py(), words[at[i] : at[i + 1]], removed[r].as_py(), size) for i, r in enumerate(rows)]
                yield _result(ids.slice(first, len(made)), made)

    out = "id long, n_words long, removed array<struct<start:long,end:long>>, kept string"
    # Texts that no shared anchor marks have nothing to remove: they are not shuffled.
    closed = marked.mapInArrow(closed_rows, out)
    joined = marked.mapInArrow(open_rows, "id long, key long, text string").join(lists, ["id", "key"], "left").mapInArrow(cut, out)
    return closed.unionByName(joined).withColumn("id", F.col("id").cast(docs.schema[doc_id].dataType)).withColumnRenamed("id", doc_id)


def _result(ids: pa.Array, made: list[tuple]) -> pa.RecordBatch:
    n, gone, kept = zip(*made) if made else ((), (), ())
    return pa.record_batch(
        [ids, pa.array(n, pa.int64()), pa.array(gone, _INTERVALS), pa.array(kept, pa.string())],
        names=["id", "n_words", "removed", "kept"],
    )


_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(text, words, removed, size):
    raw = (text or "").encode()
    if not removed:
        return len(words), [], _SPACES.sub(b" ", raw).strip(b" ").decode()
    parts = raw.split()
    gone = intervals(np.flatnonzero(np.isin(sequences(words, size), np.array(removed, np.int64).view(np.uint64))), size)
    kept, at = [], 0
    for start, end in gone:
        kept += parts[at:start]
        at = end
    return len(parts), [{"start": s, "end": e} for s, e in gone], b" ".join(kept + parts[at:]).decode()


def digests(cut: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return cut.select(
        doc_id, "n_words", n.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
