"""Near duplicates by SimHash, with pairs discarded by tables of distances to pivots.

Equal fingerprints are one class. Classes meet where they agree on one of five
blocks of bits, which pairs at most ``RADIUS`` = 4 bits apart must. Where a block
value is so common that a task would get too many, the bits left are cut into
five blocks again, and so on, so that no group of classes is too large for a
task, and no pair is lost.

Inside a group, the Hamming distances of each class to 64 reference
fingerprints (pivots) are tabulated. Two classes whose distances to any pivot
differ by more than the radius are further apart than the radius, by the
triangle inequality. The pivots are the rows of a Hadamard matrix, which are 32
bits apart each: over all of them the squared differences add up to 64 times the
distance of the pair, so every pair more than radius squared bits apart is
discarded by some pivot. Survivors are verified, and a group hands on one link
per class that is not its component's first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.settle import settle
from .components import components
from .text import one_by_one

SIZE, RADIUS, SEED = 4, 4, 42
GROUP_ROWS = 8_192  # classes that agree on a block before the rest is cut again
PIECE = 1 << 20  # bytes of a text whose words are lists at a time
SHIFTED = 1 << 20  # pairs looked at between two merges of labels

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(raw: bytes):
    """Lists of words of a text, a piece at a time; ASCII letters in lower case."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].lower().split()
        at = end


def shingle_hashes(raw: bytes, size: int = SIZE, seed: int = SEED):
    """XXH64 of the text's shingles, repeats included, in arrays: runs of ``size`` words joined by a
    space; with fewer words, the whole sequence; without words, nothing."""
    hashed, carried, any_run = xxhash.xxh64_intdigest, [], False
    for words in _words(raw):
        words = carried + words
        if len(words) >= size:
            any_run = True
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
            ends = ends[size - 1 :].tolist()
            yield np.array([hashed(joined[a:b], seed) for a, b in zip(starts, ends)], np.uint64)
        carried = words[len(words) - size + 1 :] if len(words) >= size else words
    if not any_run and carried:
        yield np.array([hashed(b" ".join(carried), seed)], np.uint64)


def fingerprint(text: str | None, size: int = SIZE, seed: int = SEED) -> int:
    """A bit is 1 if over half of the shingle hashes have it; 0 without words."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes((text or "").encode(), size, seed):
        for at in range(0, len(hashes), 1 << 14):
            part = hashes[at : at + (1 << 14)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > n))


def fingerprints(docs: DataFrame, doc_id: str, text: str, size: int = SIZE) -> DataFrame:
    """(doc, print) of every row; prints are signed 64-bit numbers."""
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in one_by_one(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc", "print"])

    return pairs.mapInArrow(run, "doc long, print long")


def _cut(rows: DataFrame, bits: int, parts: int) -> DataFrame:
    """Each row under ``parts`` keys: a block of its ``rest``, of ``bits`` bits, and what it had in common so far.

    A pair that differs in fewer than ``parts`` bits agrees on one of the blocks at least.
    """
    width = bits // parts
    rest = F.col("rest")

    def block(i: int) -> Column:
        low = rest.bitwiseAND(F.lit((1 << (i * width)) - 1))
        high = F.shiftleft(F.shiftrightunsigned(rest, (i + 1) * width), i * width) if (i + 1) * width < 64 else F.lit(0).cast("long")
        value = F.shiftrightunsigned(rest, i * width).bitwiseAND(F.lit((1 << width) - 1))
        return F.struct(F.xxhash64("key", F.lit(i), value).alias("key"), low.bitwiseOR(high).alias("rest"))

    blocks = F.explode(F.array(*[block(i) for i in range(parts)])).alias("b")
    return rows.select("print", blocks).select("print", "b.key", "b.rest")


def groups(prints: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, print): every pair of prints at most ``radius`` bits apart has a key in common.

    Building the result runs a job per cut, which writes the keys of too many prints. Where so few bits are left
    that a key cannot have more than ``group_rows`` prints, nothing is cut.
    """
    parts, bits, done = radius + 1, 64, None
    rows = prints.select("print", F.lit(0).cast("long").alias("key"), F.col("print").alias("rest"))
    while True:
        rows, bits = _cut(rows, bits, parts), bits - bits // parts
        crowded = settle(rows.groupBy("key").count().where(F.col("count") > group_rows).select("key"))
        last = 1 << bits <= group_rows or bits < parts or crowded.isEmpty()
        calm = rows if last else rows.join(crowded, "key", "left_anti")
        calm = calm.select("key", "print")
        done = calm if done is None else done.unionByName(calm)
        if last:
            return done
        rows = rows.join(crowded, "key", "left_semi")


def _pivots() -> np.ndarray:
    """The rows of a Hadamard matrix of order 64, as bits: row i has the parity of i & j at place j."""
    i, j = np.indices((64, 64)).astype(np.uint64)
    parity = np.bitwise_count(i & j) & 1
    return np.bitwise_or.reduce(parity.astype(np.uint64) << j, axis=1)


PIVOTS = _pivots()


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distance of each print (columns) to each pivot (rows)."""
    return np.stack([np.bitwise_count(prints ^ p) for p in PIVOTS]).astype(np.int8)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining places a and b: the smallest place that a component has."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            return label
        label = label.copy()
        np.minimum.at(label, high, low)
        while not np.array_equal(label[label], label):
            label = label[label]


def group_components(group: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Components of prints of equal ``group`` (sorted), as (order, label): print ``order[i]`` is in the component
    of print ``order[label[i]]``.

    Prints of a group are sorted by their distance to one pivot and each is held against those behind it, one
    place further at a time, as long as that distance allows; the other pivots narrow what is left. Once
    most of a group is one component, only its other prints are held against it, from both sides.
    """
    by = np.bitwise_count(prints ^ PIVOTS[1]).astype(np.int64)
    order = np.lexsort((by, group))
    group, prints, by = group[order], prints[order], by[order]
    table, n = distance_table(prints), len(prints)
    label = np.arange(n)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([start, [n]]))
    number = np.repeat(np.arange(len(start)), size)

    def survivors(a, b):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        for row in table[2:5]:
            near = np.abs(row[a] - row[b]) <= radius
            a, b = a[near], b[near]
        if len(a):
            near = (np.abs(table[5:, a] - table[5:, b]) <= radius).all(axis=0) & (np.abs(table[0, a] - table[0, b]) <= radius)
            a, b = a[near], b[near]
        same = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        return a[same], b[same]

    def sweep(active, step, shift):
        """Hold active places against those ``shift`` and more behind (step 1) or ahead (step -1) of them."""
        nonlocal label
        links, looked = [], 0
        while len(active):
            other = active + step * shift
            inside = (other >= 0) & (other < n)
            active, other = active[inside], other[inside]
            near = (group[active] == group[other]) & (np.abs(by[other] - by[active]) <= radius)
            active, other = active[near], other[near]
            links.append(survivors(active, other))
            shift, looked = shift + 1, looked + len(active)
            if looked >= SHIFTED or shift in (4, 16, 64):
                label = _merge(label, *map(np.concatenate, zip(*links)))
                links, looked = [], 0
                if step > 0 and len(active):
                    active = active[~most(label)[active]]
        if links:
            label = _merge(label, *map(np.concatenate, zip(*links)))

    def most(label):
        """Places in a component that holds over half of its group."""
        members = np.bincount(label, minlength=n)
        return 2 * members[label] > size[number]

    sweep(np.arange(n), 1, 1)
    # those left out on the way may have prints of other components behind them, which look ahead of themselves
    large = most(label)
    has_large = np.bincount(number, large, len(start)) > 0
    sweep(np.flatnonzero(~large & has_large[number]), -1, 1)
    return order, label


def _links(batches, radius):
    """One link per print that is not the first of its component in its group; groups come whole and in order."""
    held_keys, held_prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def handed(keys, prints):
        order, label = group_components(keys, prints, radius)
        rest = np.flatnonzero(label != np.arange(len(label)))
        a, b = prints[order[rest]].view(np.int64), prints[order[label[rest]]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        keys, prints = (batch.column(i).to_numpy() for i in (0, 1))
        keys, prints = np.concatenate([held_keys, keys]), np.concatenate([held_prints, prints.view(np.uint64)])
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
        if whole:
            yield handed(keys[:whole], prints[:whole])
        held_keys, held_prints = keys[whole:], prints[whole:]
    if len(held_keys):
        yield handed(held_keys, held_prints)


def print_links(prints: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b) of distinct ``print``: links that give the same components as all pairs within the radius."""
    sorted_groups = groups(prints, radius, group_rows).repartition("key").sortWithinPartitions("key")
    return sorted_groups.mapInArrow(lambda batches: _links(batches, radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, radius: int = RADIUS
) -> DataFrame:
    """Per row of ``docs``: its id, ``fingerprint`` (16 hexadecimal digits) and component_id, the smallest id that
    links of at most ``radius`` bits reach.

    Texts without words, missing ones too, have fingerprint zero and are linked like others. Rows without id are
    linked like others but name no component: theirs is missing where nobody in it has an id. Rows that repeat
    stay. Building the result runs jobs.
    """
    rows = settle(fingerprints(docs, doc_id, text, size))
    classes = settle(rows.groupBy("print").agg(F.min("doc").alias("least")))
    labels = settle(components(print_links(classes.select("print"), radius)))
    known = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "label", F.coalesce("label", "print")
    )
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    named = settle(known.join(least, "label").select("print", "component_id"))
    # the rows come first: Spark splits those of a very common print
    joined = rows.join(named, "print", "left")
    return joined.select(
        F.col("doc").alias(doc_id), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
