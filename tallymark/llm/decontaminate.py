"""Benchmark passages in documents, by SimHash fingerprints of windows.

Words are runs of letters and digits, in lower case; a shingle is five of them,
and its weight the number of times it occurs. A window has as many words as an
item of the benchmark. Windows and items get 64-bit SimHash fingerprints. Each
fingerprint is cut into ``BLOCKS`` blocks; two that differ in at most ``RADIUS``
bits differ in at most ``RADIUS // BLOCKS`` bits of some block, so an index by
block and value, probed with the values that few flips lead to, finds all pairs
within the radius. The weighted Jaccard similarity of the shingles, computed
exactly, then decides.

Windows are made of an item's size and begin at a shingle that some item of that
size has, moved left only to fit the end of the document. Sliding a window right
past shingles that its item lacks never lowers its similarity, so these hold the
best window, in whatever order the parts of the item stand. Windows placed as an
item would lie around a shared shingle are made too, so that the first of equally
similar windows is the one that covers the passage. A window is similar only if
most of its shingles are shared: windows with fewer places of shared shingles than
``LEAST`` needs are dropped before their text is made, which loses nothing. The
shingles of the benchmark are broadcast in blocks of at most ``BROADCAST_ROWS``
rows; a larger benchmark takes more passes over the documents. Equal windows are
compared once.

All of it is DataFrame expressions. Texts are read whole.

Defined results: missing or empty texts and items have no words and match
nothing. An item with fewer than five words has its whole sequence as its only
shingle. A document shorter than an item is one window. Rows with equal ids
count as one document, the union of their matches; a missing id is a document
id of its own. Of equal similarities the first of these windows is reported.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.settle import settle
from .text import bound

SHINGLE = 5
LEAST = 0.8
RADIUS, BLOCKS, BLOCK_BITS = 15, 4, 16
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hash of each run of ``size`` words, by its place."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<long>"))


def shingles(words: Column) -> Column:
    """The shingles as texts; the whole sequence if it is shorter than one."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")
    )
    return F.when(F.size(words) >= SHINGLE, runs).otherwise(F.array(F.array_join(words, " ")))


def simhash(features: Column) -> Column:
    """64-bit SimHash; a feature counts as often as it occurs."""

    def of(hashes):
        def side(bit):
            # how many more features have this bit than lack it
            return F.aggregate(
                hashes, F.lit(0),
                lambda acc, h: acc + F.when(F.call_function("shiftright", h, bit).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
            lambda acc, bit: F.when(
                side(bit) > 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
            ).otherwise(acc),
        )

    return bound(F.transform(features, lambda f: F.xxhash64(f)), of)


def index_keys(fingerprint: Column, flips: int) -> Column:
    """(block, value) for each block and each value that at most ``flips`` changed bits give."""
    masks = [
        sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(BLOCK_BITS), n)
    ]
    values = F.array(*[F.lit(m) for m in masks])

    def of(block):
        own = F.shiftrightunsigned(fingerprint, BLOCK_BITS * block).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
        return F.transform(
            values, lambda m: F.struct(F.lit(block).alias("block"), own.bitwiseXOR(m).alias("value"))
        )

    return F.flatten(F.array(*[of(b) for b in range(BLOCKS)]))


def weighted_jaccard(left: Column, right: Column) -> Column:
    """Sum of the smaller weights over the sum of the larger; a weight is a number of occurrences."""

    def times(x, bag):
        return F.size(F.filter(bag, lambda y: y == x))

    shared = F.aggregate(
        F.array_intersect(left, right), F.lit(0), lambda acc, x: acc + F.least(times(x, left), times(x, right))
    )
    return shared / (F.size(left) + F.size(right) - shared)


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    words = words_of(F.col(text))
    rows = benchmark.select(F.col(item_id).alias("item"), words.alias("words")).where(F.size("words") > 0)
    return rows.select("item", "words", F.size("words").alias("size"), shingles(F.col("words")).alias("shingles"))


def shared_places(docs: DataFrame, items: DataFrame, doc_id: str, text: str) -> DataFrame | None:
    """(doc, digest, words, length, size, at, offset): where documents have a shingle of an item of
    ``size`` words, and where the item has it; None without items."""
    texts = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("digest"), words_of(F.col(text)).alias("list"))
    sized = items.select("size", "words", F.least(F.col("size"), F.lit(SHINGLE)).alias("length"))
    found = []
    for (length,) in sized.select("length").distinct().collect():  # at most SHINGLE rows
        places = sized.where(F.col("length") == length).select(
            F.posexplode(shingle_hashes(F.col("words"), length)).alias("offset", "hash"), "size"
        ).distinct()
        blocks = -(-places.count() // BROADCAST_ROWS)
        for block in range(blocks):
            some = places.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == block)
            spread = texts.select(
                "doc", "digest", F.size("list").alias("words"), F.posexplode(shingle_hashes(F.col("list"), length)).alias("at", "hash")
            )
            found.append(spread.join(F.broadcast(some), "hash").select(
                "doc", "digest", "words", F.lit(length).alias("length"), "size", "at", "offset"
            ))
    return reduce(DataFrame.union, found) if found else None


def window_starts(places: DataFrame) -> DataFrame:
    """(doc, digest, size, start): windows with as many places of shared shingles as ``LEAST`` needs.

    One running count over a document's places, read before a window and at its end.
    """
    text = ["doc", "digest", "words", "length", "size"]
    shingles_of = F.least("size", "words") - F.col("length") + 1

    def clamped(start):
        return F.greatest(F.least(start, F.col("words") - F.col("size")), F.lit(0))

    def event(place, kind, start):
        return F.struct(place.alias("place"), F.lit(kind).alias("kind"), start.cast("int").alias("start"))

    events = [event(F.col("at"), 0, F.lit(None))]
    for start in (clamped(F.col("at")), clamped(F.col("at") - F.col("offset"))):
        events += [event(start, -1, start), event(start + shingles_of - 1, 1, start)]
    dealt = places.repartition("doc", "digest", "size")
    told = dealt.select(*text, F.explode(F.array(*events)).alias("e")).select(*text, "e.*").distinct()
    in_order = Window.partitionBy("doc", "digest", "size").orderBy("place", "kind")
    before = F.sum((F.col("kind") == 0).cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    ends = told.withColumn("shared", before).where("kind <> 0")
    counted = ends.groupBy(*text, "start").agg(F.sum(F.col("kind") * F.col("shared")).alias("shared"))
    both = shingles_of + F.col("size") - F.col("length") + 1
    # shared / (both - shared) >= LEAST; a bit less, for rounding
    return counted.where((1 + LEAST) * F.col("shared") >= LEAST * both - 1e-6).select("doc", "digest", "size", "start")


def windows(docs: DataFrame, items: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, start, size, content): the item-sized windows that may be similar to an item."""
    places = shared_places(docs, items, doc_id, text)
    if places is None:
        return docs.where("false").select(
            F.col(doc_id).alias("doc"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("content")
        )
    starts = settle(window_starts(places))
    texts = docs.select(F.col(doc_id).alias("of"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    # texts of one id with one digest share their starts, if they differ at all
    own = starts.groupBy("doc", "digest").agg(F.collect_list(F.struct("size", "start")).alias("starts"))
    held = texts.join(own, ["digest"]).where(F.col("doc").eqNullSafe(F.col("of")))
    each = held.select("doc", words_of(F.col("text")).alias("words"), F.explode("starts").alias("at"))
    content = F.array_join(F.slice("words", F.col("at.start") + 1, F.col("at.size")), " ")
    return each.select("doc", "at.start", "at.size", content.alias("content")).distinct()


def similar(contents: DataFrame, items: DataFrame) -> DataFrame:
    """(size, content, item, similarity) of windows and items of their size that are similar."""
    flips = RADIUS // BLOCKS
    near = flips // 3  # of the flips, windows try these and items the others: the index has fewer rows
    # the rows are small but cost much: a fixed number of tasks, which Spark does not merge
    tasks = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = contents.repartition(tasks, "content").withColumn("shingles", shingles(F.split("content", " ")))
    left = settle(left.withColumn("print", simhash(F.col("shingles"))).drop("shingles"))
    right = items.select("item", "size", F.col("shingles").alias("wanted"), simhash(F.col("shingles")).alias("own"))
    probes = left.select("size", "content", "print", F.explode(index_keys(F.col("print"), near)).alias("key"))
    index = right.select("item", "size", "own", F.explode(index_keys(F.col("own"), flips - near)).alias("key"))
    pairs = (
        probes.join(index, ["size", "key"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("own"))) <= RADIUS)
        .select("size", "content", "item").distinct()
    )
    wanted = right.select("item", F.col("size").alias("item_size"), "wanted")
    same = (F.col("size") == F.col("item_size")) & pairs["item"].eqNullSafe(wanted["item"])
    similarity = weighted_jaccard(shingles(F.split("content", " ")), F.col("wanted"))
    checked = settle(pairs.repartition(tasks, "content", "item").join(wanted, same).select("size", "content", pairs["item"], similarity.alias("similarity")))
    return checked.where(F.col("similarity") >= LEAST).distinct()


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document and item of which it holds a passage: the most similar window, its first
    word's number and its number of words, and the similarity."""
    items = settle(items_of(benchmark, item_id, item_text))
    # written once: the comparison reads the distinct contents, the result all windows
    found = settle(windows(docs, items, doc_id, text))
    matched = similar(found.select("size", "content").distinct(), items)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("best")
    return (
        found.join(matched, ["size", "content"])
        .groupBy("doc", "item").agg(best)
        .select(
            F.col("doc").alias(doc_id), F.col("item").alias(item_id), (-F.col("best.back")).alias("first_word"),
            F.col("best.size").alias("n_words"), F.col("best.similarity").alias("similarity"),
        )
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document holds no passage of ``benchmark``."""
    bad = leaks(docs, benchmark, doc_id, text).select(F.col(doc_id).alias("__leak")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__leak"]), "left_anti")
