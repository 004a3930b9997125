"""Near-duplicate documents by a Jaccard join on word shingles, with signature trees.

Two documents link when the Jaccard similarity of their shingle sets reaches a
threshold. The join finds every link that the components need, none is missed
by chance:

1. Documents with equal sets are one class, named by a 64-bit digest of the set.
2. Hash values of shingles are cut into segments, as many as two similar sets of a
   range of sizes may differ in shingles, and one more: so one segment at least
   holds the same shingles in both. Digests of segments are keys, and classes that
   share one meet. A passage that many documents share is no key; a few shingles
   from all over the text are.
3. Within a key, classes are rows under a signature tree: a node holds the OR of
   its rows' token bitmaps and the range of their sizes. A traversal of pairs of
   nodes drops those whose sizes or bits rule out the overlap that the
   threshold needs, and those that are in one component already. Pairs of rows are
   also held against parities of their shingles' hashes: long sets fill a bitmap,
   while parities differ in no more bits than the sets do in shingles. Keys with
   one leaf of rows, which are most, have their pairs made together.
4. Pairs that are left are checked with larger bitmaps, then with the sets.

Step 3 runs several times. First, under the ``FIRST_KEYS`` smallest of its shared keys, each
row is compared with ``NEIGHBOURS`` rows only, and of the pairs found, one for
each class is checked, then the rest without those that these have joined. That
joins most copies at a cost that grows with the rows. Then the keys that hold several
components are traversed, ``BEST_ROUNDS`` times for the pair of each row that may be
most similar, which is checked and joins more, and at last for all pairs of what is still apart. Keys with many rows are dealt to cells of
bounded size: the rows of the key's largest component are spread, the others go
along with each part. Nothing is sampled or cut off.

Defined results: a text without words has an empty set, links with nothing and
is its own component. Rows without id link like others, but do not name a
component; a component of only such rows has none. Rows with equal ids are
documents each. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.settle import drop_paths, settings, settle, written_paths
from .components import components
from .kept import alone
from .marks import bit_field, may_hold
from .text import chunks, mix, sequences

SIZE, PERCENT = 5, 80
GROWTH = 140  # percent by which a range of sizes ends above its begin
SPARE = 6  # a spare segment for so many others
FIRST_KEYS = 4  # keys of a class under which neighbours are compared
SIGNATURE = 1024  # bits of a token bitmap in a tree
PARITY = 2048  # bits of a row's parities, which tell long sets apart where the bitmap is full
WIDE = 8  # bits per shingle of the larger bitmaps
LEAF, FAN = 16, 8  # rows of a leaf, children of a node
NEIGHBOURS = 3  # rows of its cell with which a row is compared first: the cell's first and those before it
BEST_ROUNDS = 1  # traversals for the best partner of each row before the one for all
CELL_ROWS = 1024
PAIRS_AT_ONCE = 16_384  # pairs of rows whose bits are compared at once
BATCH_BYTES = 2 << 20  # bytes of texts or sets that go to Python at once, or one row's
PAIRS = 1_000_000  # pairs that a task holds to hand on each once
ROW = "__row"  # column of row keys while one row of each component is chosen
SEEN_CLASSES = 200_000  # classes of which a task remembers that it has handed them on


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; the whole sequence if it is shorter."""
    if not len(words):
        return words[:0]
    found = sequences(words, min(size, len(words)))
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def digest(shingles: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return int(np.int64(np.add.reduce(mix(shingles), dtype=np.uint64) ^ np.uint64(len(shingles))))


def _sets(batches, size):
    """(batch, row, set) of each text."""
    for batch in batches:
        for first, words, at in chunks(batch.column(batch.schema.get_field_index("text")), lower=True):
            for i in range(len(at) - 1):
                yield batch, first + i, shingle_set(words[at[i] : at[i + 1]], size)


class _Seen:
    """Which classes a task has met; forgets all when it is full, so some are handed on again."""

    def __init__(self):
        self.classes: set[int] = set()

    def first_time(self, name: int) -> bool:
        if name in self.classes:
            return False
        if len(self.classes) >= SEEN_CLASSES:
            self.classes.clear()
        self.classes.add(name)
        return True


def document_sets(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc, n, class) of all documents."""
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))

    def run(batches):
        rows = []
        for batch, i, found in _sets(batches, size):
            rows.append((batch.column(0)[i].as_py(), len(found), digest(found) if len(found) else None))
            if len(rows) == 10_000:
                yield _made(rows, _DOCUMENT)
                rows = []
        yield _made(rows, _DOCUMENT)

    return settle(pairs.mapInArrow(alone(run), "doc long, n long, class long"))


_DOCUMENT = pa.schema([(c, pa.int64()) for c in ("doc", "n", "class")])


def _made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def size_ranges(n: int, percent: int) -> list[tuple[int, int]]:
    """(range, largest size in it) of the ranges with sizes of sets not larger than ``n`` that may be similar to it."""
    least, begin, number, out = -(-percent * n // 100), 1, 0, []
    while begin <= n:
        end = max(begin + 1, begin * GROWTH // 100)
        if end > least:
            out.append((number, end - 1))
        begin, number = end, number + 1
    return out


def segment_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set: of any two sets as similar as asked, one is a key of both.

    Where the smaller of two sets has at most ``most`` shingles, they differ in at most
    ``differ``, so that of ``differ + 1 + spare`` segments ``spare + 1`` are equal. A set with at most ``spare``
    segments of less than two shingles leaves these out, or else empty ones, if at most ``spare`` are: of
    two sets the one that leaves out more has an equal segment left that both keep.
    """
    keys = []
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles), dtype=np.uint64)])
    for number, most in size_ranges(len(shingles), percent):
        differ = (most + 100 * most // percent) * (100 - percent) // (100 + percent)
        spare = max(1, differ // SPARE) if differ else 0
        count = differ + 1 + spare
        segment = ((shingles >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        edges = np.searchsorted(segment, np.arange(count + 1, dtype=np.uint64))
        held = np.diff(edges)
        least = next((k for k in (2, 1) if np.count_nonzero(held < k) <= spare), 0)
        names = (np.arange(count, dtype=np.uint64) << np.uint64(16)) + np.uint64(number)
        all_keys = mix(mixed[edges[1:]] - mixed[edges[:-1]] + mix(names + np.uint64(1)))
        keys.append(all_keys[held >= least])
    return np.concatenate(keys)


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Bytes with bit ``s mod bits`` set for each shingle."""
    out = np.zeros(bits, np.uint8)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bytes whose bit p is set if an odd number of shingles are p modulo ``PARITY``, by other bits than ``bitmap``.

    Sets that differ in d shingles differ in d bits at most.
    """
    place = ((shingles >> np.uint64(20)) & np.uint64(PARITY - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=PARITY) & 1).astype(np.uint8), bitorder="little")


def wide_bitmap(shingles: bytes) -> bytes:
    """The larger bitmap of a set."""
    found = np.frombuffer(shingles, np.uint64)
    return bitmap(found, max(SIGNATURE, 1 << int(WIDE * len(found) - 1).bit_length())).tobytes()


def _needed(n, m, percent):
    """Smallest overlap of sets of these sizes that are as similar as asked."""
    return -(-percent * (n + m) // (100 + percent))


def shared_keys(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, rows) of the keys that several classes have."""

    def run(batches):
        seen = _Seen()
        keys, names, held = [], [], 0
        for _, _, found in _sets(batches, size):
            if len(found) and seen.first_time(name := digest(found)):
                keys.append(segment_keys(found, percent))
                names.append(name)
                held += len(keys[-1])
            if held >= 200_000:
                yield _key_rows(keys, names)
                keys, names, held = [], [], 0
        if held:
            yield _key_rows(keys, names)

    rows = pairs.mapInArrow(alone(run), "key long, class long")
    least_most = rows.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("rows"))
    return settle(least_most.where("a < b").select("key", "rows"))


def _key_rows(keys, names):
    owner = np.repeat(np.array(names, np.int64), [len(k) for k in keys])
    return pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(owner)], names=["key", "class"])


def class_keys(pairs: DataFrame, shared: DataFrame, size: int, percent: int) -> DataFrame:
    """(class, n, signature, keys, shingles): classes with a key that others may have too; copies of a
    class that tasks met apart are rows of their own."""
    field = pairs.sparkSession.sparkContext.broadcast(bit_field(shared, "key", _field_bits(shared.count())))

    def run(batches):
        seen, rows, held = _Seen(), [], 0
        for _, _, found in _sets(batches, size):
            if len(found) and seen.first_time(name := digest(found)):
                keys = segment_keys(found, percent)
                keys = keys[may_hold(field.value, keys)].view(np.int64)
                if len(keys):
                    signature = bitmap(found, SIGNATURE).tobytes() + parities(found).tobytes()
                    rows.append((name, len(found), signature, np.sort(keys), found.tobytes()))
                    held += len(found)
            if held >= 200_000:
                yield _made(rows, _CLASS)
                rows, held = [], 0
        if rows:
            yield _made(rows, _CLASS)

    columns = "class long, n long, signature binary, keys array<long>, shingles binary"
    found = settle(pairs.mapInArrow(alone(run), columns))
    field.destroy()
    return found


def _field_bits(values: int) -> int:
    """Places of a bit field for so many values: 8 to 32 MB."""
    return min(max(1 << 26, 1 << (8 * values).bit_length()), 1 << 28)


def with_parts(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """``rows`` (key, class) with the number of parts of their key and their part."""
    parts = F.coalesce(F.ceil(F.col("rows") / CELL_ROWS), F.lit(1))
    return (
        rows.join(crowded, "key", "left").withColumn("parts", parts.cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("class", "key"), F.col("parts")).cast("int")).drop("rows")
    )


_CLASS = pa.schema([
    ("class", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()), ("keys", pa.list_(pa.int64())),
    ("shingles", pa.binary()),
])


class Rows:
    """Rows of one or more cells, ordered by cell, size and class."""

    def __init__(self, batch: pa.RecordBatch):
        def numbers(name):
            return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)

        self.cell, self.key = numbers("cell"), numbers("key")
        self.name, self.n, self.label = numbers("class"), numbers("n"), numbers("label")
        raw = b"".join(batch.column(batch.schema.get_field_index("signature")).to_pylist())
        both = np.frombuffer(raw, np.uint64).reshape(len(batch), -1)
        # the bitmap and behind it the parities; without these, rows are told apart by the rest
        self.bits, self.parity = both[:, : SIGNATURE // 64], both[:, SIGNATURE // 64 :]
        self.surplus = self.n - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)

    def similar(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of rows that may be as similar as asked and are not in one component, and by how
        large a part of their sizes the largest possible overlap is more than needed."""
        keep = self.label[i] != self.label[j]
        n, m = self.n[i], self.n[j]
        keep &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        i, j, n, m = i[keep], j[keep], n[keep], m[keep]
        a, b = self.bits[i], self.bits[j]
        lost = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
        also = np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
        differ = np.bitwise_count(self.parity[i] ^ self.parity[j]).sum(axis=1, dtype=np.int64)
        more = np.minimum(np.minimum(n - lost, m - also), (n + m - differ) // 2) - _needed(n, m, percent)
        keep = more >= 0
        return i[keep], j[keep], (more / (n + m))[keep]


def _places(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Where each row stands, and where its cell begins."""
    new = np.concatenate([[True], rows.cell[1:] != rows.cell[:-1]])
    return np.arange(len(rows.cell)), np.flatnonzero(new)[np.cumsum(new) - 1]


def near_pairs(rows: Rows):
    """Pairs of each row with the first row of its cell and those just before it."""
    place, begin = _places(rows)
    found = []
    for step in range(1, NEIGHBOURS):
        j = place[place - begin >= step]
        found.append((j - step, j))
    j = place[place - begin >= NEIGHBOURS]
    found.append((begin[j], j))
    return tuple(np.concatenate(x) for x in zip(*found))


def leaf_pairs(rows: Rows):
    """All pairs of rows (i < j) in each cell that is one leaf, of all such cells together, some at a time."""
    place, begin = _places(rows)
    single = np.bincount(begin, minlength=len(place))[begin] <= LEAF
    place, begin = place[single], begin[single]
    for step in range(1, LEAF):
        later = place - begin >= step
        place, begin = place[later], begin[later]
        for at in range(0, len(place), PAIRS_AT_ONCE):
            j = place[at : at + PAIRS_AT_ONCE]
            yield j - step, j


class Tree:
    """Signature tree over rows [begin, end): levels of nodes, the leaves first."""

    def __init__(self, rows: Rows, begin: int, end: int):
        at = np.arange(begin, end, LEAF)
        self.begin, self.end = begin, end
        self.levels = [(
            np.bitwise_or.reduceat(rows.bits[begin:end], at - begin, axis=0),
            *(f.reduceat(x[begin:end], at - begin) for f, x in (
                (np.minimum, rows.n), (np.maximum, rows.n), (np.maximum, rows.surplus),
                (np.minimum, rows.label), (np.maximum, rows.label),
            )),
        )]
        while len(self.levels[-1][0]) > 1:
            bits, small, large, surplus, low, high = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((
                np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at),
                np.maximum.reduceat(surplus, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
            ))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a similar pair of rows of different components."""
        bits, small, large, surplus, low, high = self.levels[level]
        keep = (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
        keep &= (100 * large[i] >= percent * small[j]) & (100 * large[j] >= percent * small[i])
        common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
        return keep & (common + np.minimum(surplus[i], surplus[j]) >= _needed(small[i], small[j], percent))

    def pairs(self, percent: int):
        """Pairs of rows (i < j) under pairs of leaves that are left, in chunks."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            keep = self.possible(level, i, j, percent)
            i, j = i[keep], j[keep]
            if level:
                i, j = self._children(i, j, FAN, len(self.levels[level - 1][0]))
        for at in range(0, len(i), 256):
            a, b = self._children(i[at : at + 256], j[at : at + 256], LEAF, self.end - self.begin)
            apart = a != b
            yield a[apart] + self.begin, b[apart] + self.begin

    @staticmethod
    def _children(i, j, fan, count):
        """Pairs of children, each once: also of a node with itself."""
        a = (i[:, None, None] * fan + np.arange(fan)[None, :, None]).repeat(fan, axis=2).ravel()
        b = (j[:, None, None] * fan + np.arange(fan)[None, None, :]).repeat(fan, axis=1).ravel()
        keep = (a < count) & (b < count) & (a <= b)
        return a[keep], b[keep]


def _cells(batches):
    """Rows of whole cells, many small cells at a time."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([rest, batch]).combine_chunks() if rest is not None else pa.Table.from_batches([batch])
        if not len(table):
            continue
        cell = np.stack([table.column(c).to_numpy() for c in ("key", "cell")])
        change = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield _whole(table.slice(0, cut))
        rest = table.slice(cut).combine_chunks().to_batches()[0]
    if rest is not None and len(rest):
        yield _whole(pa.Table.from_batches([rest]))


def _whole(table: pa.Table) -> Rows:
    """Each class of a cell once; cells numbered from 0, as equal numbers occur under several keys."""
    place = np.stack([table.column(c).to_numpy() for c in ("key", "cell", "class")])
    again = np.concatenate([[False], (place[:, 1:] == place[:, :-1]).all(axis=0)])
    rows = Rows(table.filter(pa.array(~again)).combine_chunks().to_batches()[0])
    new = (rows.cell[1:] != rows.cell[:-1]) | (rows.key[1:] != rows.key[:-1])
    rows.cell = np.concatenate([[0], np.cumsum(new)])
    return rows


def _best(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows, the one with the highest score of each row."""
    row, other = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((other, -np.concatenate([score, score]), row))
    row, other = row[order], other[order]
    first = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    return row[first], other[first]


def _allowed(some: Rows, percent: int, mode: str):
    """Pairs of rows, some at a time, that sizes and bits allow."""
    if mode == "near":
        i, j = near_pairs(some)
        for at in range(0, len(i), PAIRS_AT_ONCE):
            yield some.similar(i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE], percent)[:2]
        return
    edges = np.append(np.flatnonzero(np.concatenate([[True], some.cell[1:] != some.cell[:-1]])), len(some.cell))
    large = np.flatnonzero(np.diff(edges) > LEAF)
    # most cells are one leaf: their pairs are made together
    trees = (Tree(some, begin, end).pairs(percent) for begin, end in zip(edges[large], edges[large + 1]))
    for pairs in chain([leaf_pairs(some)], trees):
        found = (some.similar(i, j, percent) for i, j in pairs)
        if mode == "best":
            if found := list(found):
                yield _best(*(np.concatenate(x) for x in zip(*found)))
        else:
            yield from (f[:2] for f in found)


def _candidates(rows: DataFrame, percent: int, mode: str) -> DataFrame:
    """(a, b): pairs of classes that meet in a cell and that sizes and bits allow: of each row and its
    neighbours ("near"), of each row and the one that may be most similar to it ("best"), or "all".

    A task hands a pair on once for every ``PAIRS`` that it finds, under however many keys it finds it.
    """

    def run(batches):
        held, count = [], 0
        for some in _cells(batches):
            for i, j in _allowed(some, percent, mode):
                a, b = some.name[i], some.name[j]
                held.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                count += len(a)
                if count >= PAIRS:
                    held = [_distinct(held)]
                    count = held[0].shape[1]
                    if count >= PAIRS // 2:
                        yield _pair_batch(held[0])
                        held, count = [], 0
        if held:
            yield _pair_batch(_distinct(held))

    ordered = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "n", "class")
    columns = ordered.select("key", "cell", "class", "n", "label", "signature")
    return columns.mapInArrow(alone(run), "a long, b long")


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(pairs, axis=1)
    both = both[:, np.lexsort(both)]
    return both[:, np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(axis=0)])[: both.shape[1]]]


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(p) for p in pairs], names=["a", "b"])


def crowded_cells(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """``rows`` (key, class, label) dealt to cells so that any two rows of a key that have different
    labels meet in one. Keys with one label only are left out."""
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("n_label"))
    keys = settle(
        counts.groupBy("key").agg(
            F.max_by("label", F.struct("n_label", "label")).alias("main"),
            (F.sum("n_label") - F.max("n_label")).alias("others"),
        ).where("others > 0")
    )
    joined = with_parts(rows.join(keys, "key"), crowded)
    joined = joined.withColumn("groups", F.ceil(F.col("others") / CELL_ROWS).cast("int"))
    group = F.pmod(F.xxhash64("class", F.lit(1)), F.col("groups")).cast("int")
    # cells: number part * groups + group; behind them, groups * groups for pairs of groups of others
    mains = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.col("part") * F.col("groups") + g)
    with_mains = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p * F.col("groups") + F.col("group"))
    behind = F.col("parts") * F.col("groups")
    each_other = F.transform(
        F.sequence(F.lit(0), F.col("groups") - 1),
        lambda g: behind + F.least(g, F.col("group")) * F.col("groups") + F.greatest(g, F.col("group")),
    )
    cells = F.when(F.col("label") == F.col("main"), mains).otherwise(
        F.when(F.col("groups") > 1, F.concat(with_mains, each_other)).otherwise(with_mains)
    )
    return joined.withColumn("group", group).withColumn("cell", F.explode(cells))


def wide_overlap(n: int, a: bytes, m: int, b: bytes) -> int:
    """Most shingles that sets with these bitmaps can share."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    width = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, width), axis=0) for z in (x, y))
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def set_overlap(n: int, a: bytes, m: int, b: bytes) -> int:
    both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def checked(pairs: DataFrame, sets: DataFrame, percent: int, overlap, form=None) -> DataFrame:
    """The pairs (a, b) whose sets can be as similar as asked, by ``overlap`` of the sets or of what ``form`` makes of each.

    Only the sets of classes in ``pairs`` are shuffled: a bit field of fixed size tells them.
    """
    pairs = settle(pairs.select("a", "b"))
    if pairs.isEmpty():
        return pairs
    named = pairs.select(F.col("a").alias("class")).union(pairs.select("b"))
    field = sets.sparkSession.sparkContext.broadcast(bit_field(named, "class"))

    def needed(batches):
        for batch in batches:
            some = batch.filter(pa.array(may_hold(field.value, batch.column(0).to_numpy().view(np.uint64))))
            if form:
                made = pa.array([form(s.as_py()) for s in some.column(2)], pa.binary())
                some = pa.record_batch([some.column(0), some.column(1), made], names=some.schema.names)
            yield some

    some = sets.select("class", "n", "shingles").mapInArrow(alone(needed), "class long, n long, shingles binary")
    some = some.dropDuplicates(["class"])
    left = some.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("of_a"))
    right = some.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("of_b"))

    def run(batches):
        for batch in batches:
            keep = []
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                n, x, m, y = (part.column(c).to_pylist() for c in ("n_a", "of_a", "n_b", "of_b"))
                keep += [overlap(*v) >= _needed(v[0], v[2], percent) for v in zip(n, x, m, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = settle(pairs.join(left, "a").join(right, "b").mapInArrow(alone(run), "a long, b long").distinct())
    field.destroy()
    return found


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes have different labels."""
    both = _labelled(_labelled(pairs, labels, "a", "label_a"), labels, "b", "label_b")
    return settle(both.where("label_a <> label_b").select("a", "b"))


def _labelled(rows: DataFrame, labels: DataFrame, name: str, label: str) -> DataFrame:
    known = labels.select(F.col("node").alias(name), F.col("label").alias(label))
    return rows.join(known, name, "left").withColumn(label, F.coalesce(label, name))


def _stars(labels: DataFrame) -> DataFrame:
    """Links (a, b) that give these labels: of each class to its label, in place of all that led to it."""
    return labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def class_links(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes: all that their components need."""
    shared = shared_keys(pairs, size, percent)
    crowded = settle(shared.where(F.col("rows") > CELL_ROWS))
    classes = class_keys(pairs, shared, size, percent)

    def exact(some):
        return checked(some, classes, percent, set_overlap)

    def similar(some):
        return exact(checked(some, classes, percent, wide_overlap, wide_bitmap))

    def joined(links, near):
        # one partner of each class first: that joins most copies, and spares most other checks
        some = exact(near.groupBy("b").agg(F.min("a").alias("a")))
        labels = settle(components(links.union(some) if links is not None else some))
        return _stars(labels).union(similar(_apart(near, labels)))

    first = classes.select("class", "n", "signature", F.explode(F.slice("keys", 1, FIRST_KEYS)).alias("key"))
    alone = with_parts(first, crowded).withColumn("label", F.col("class")).withColumn("cell", F.col("part"))
    links = joined(None, settle(_candidates(alone, percent, "near").distinct()))
    for _ in range(BEST_ROUNDS):
        labels = settle(components(links))
        best = _candidates(open_cells(classes, labels, crowded), percent, "best")
        links = joined(_stars(labels), settle(best.distinct()))
    labels = settle(components(links))
    still = _candidates(open_cells(classes, labels, crowded), percent, "all").distinct()
    return _stars(labels).union(similar(still))


def open_cells(classes: DataFrame, labels: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows of the keys under which classes of several components meet, dealt to cells."""
    labelled = settle(_labelled(classes.select("class", "keys"), labels, "class", "label"))
    keyed = labelled.select("class", "label", F.explode("keys").alias("key"))
    open_keys = keyed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    open_keys = settle(open_keys.where("low < high").select("key"))
    left = settle(keyed.join(open_keys, "key", "left_semi").distinct())
    signed = classes.select("class", "n", "signature").join(left.select("class").distinct(), "class", "left_semi")
    return crowded_cells(left, crowded).join(signed.dropDuplicates(["class"]), "class")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT
) -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, and component_id, the smallest id it reaches by links."""
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    # a batch of 10,000 rows of long texts, or of pairs of their sets, would be most of what a task holds beside its heap
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
        documents = document_sets(docs, doc_id, text, size)
        before = written_paths()
        labels = settle(components(class_links(pairs, size, percent)))
    classes = documents.where("class is not null").groupBy("class").agg(F.min("doc").alias("least"))
    labelled = settle(_labelled(classes, labels, "class", "label"))
    roots = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    used = [p for p in written_paths() if p not in set(before)]
    named = settle(labelled.join(roots, "label").select("class", "component_id"))
    drop_paths(docs.sparkSession, used)

    joined = documents.join(named, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    return joined.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), own.alias("component_id"))


def row_number(key: Column) -> Column:
    """A row's key from Spark's row id, and the id from the key: the low bits change with the
    partition, so that rows of many partitions spread over a bit field."""
    partition = F.shiftright(key, 33)
    return key.bitwiseXOR(F.pmod(partition * 0x9E3779B1, F.lit(1 << 26)))


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT
) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest id, its first row if it has
    several; the first row if none has an id. Rows without words stay."""
    settled = settle(docs.withColumn(ROW, row_number(F.monotonically_increasing_id())))
    found = near_duplicates(settled, ROW, text, size, percent)
    ids = settled.select(ROW, F.col(doc_id).alias("__id"))
    order = F.struct(F.col("__id").isNull(), "__id", row_number(F.col(ROW)))
    kept = found.select(ROW, "component_id").join(ids, ROW).groupBy("component_id").agg(F.min_by(ROW, order).alias(ROW))
    return settled.join(kept.select(ROW), ROW, "left_semi").drop(ROW)
