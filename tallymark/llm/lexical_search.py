"""Ranked lexical search: a query item's best documents by an integer form of BM25.

Each task holds postings of a run of documents. For an item, the documents are
grouped by presence mask, the set of the item's terms that they hold, with one
bitmap per term. A mask's documents score at most the sum of its terms' highest
contributions. Masks are evaluated by descending maximum, and the item is
finished, with nothing lost, when the next maximum is below the score of the
last place known so far. Before masks are made, documents are left out whose
terms all belong to those that together cannot reach that place.

Texts are read whole and nothing is capped: items are taken in blocks of at most
``BLOCK_TERMS`` terms, each of which reads all documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.settle import settle
from .text import one_by_one

# What a term is made of, in UTF-8, and the constants of the score.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
LENGTH_SHARE, SATURATION, SCALE = 90, 8, 1_000

TOP = 10
BLOCK_TERMS = 500_000  # (item, term) rows that the driver and each task hold
PIECE = 1 << 20  # bytes of a text whose terms are lists at a time
DOCUMENTS = 8_192  # documents whose masks are made at a time
POSTINGS = 2_000_000  # postings looked at a time, unless one document has more
FIRST_EVALUATED = 64  # documents of the highest masks, doubled until an item is finished


def terms(text: str | None) -> Counter:
    """Terms of a whole text with their occurrences; ASCII letters in lower case, none without text."""
    raw, counts, at = (text or "").encode(), Counter(), 0
    while at < len(raw):
        cut = _BREAK.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        counts.update(TERM.findall(raw[at:end].lower()))
        at = end
    return counts


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term): distinct terms of each item; rows of one id, or without id, are one item."""
    pairs = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for i, t in enumerate(one_by_one(batch.column(1))):
                found = list(terms(t))
                ids = pa.array([batch.column(0)[i].as_py()] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary())], names=["item", "term"])

    return pairs.mapInArrow(run, "item long, term binary").distinct()


def postings(docs: DataFrame, doc_id: str, text: str, known: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, times) of each row with a term: its terms with repeats, and which of ``known`` it has how often."""
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    numbers = docs.sparkSession.sparkContext.broadcast(known)  # at most BLOCK_TERMS, or one item's terms

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in enumerate(one_by_one(batch.column(1))):
                counts = terms(t)
                if counts:
                    held = sorted((numbers.value[w], k) for w, k in counts.items() if w in numbers.value)
                    rows.append((i, counts.total(), [t for t, _ in held], [k for _, k in held]))
            at, n, which, times = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()),
                    pa.array(which, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64())),
                ],
                names=["doc", "n", "terms", "times"],
            )

    return pairs.mapInArrow(run, "doc long, n long, terms array<int>, times array<long>")


def document_counts(stored: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of ``size`` terms occurs."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["term", "n"])

    found = np.zeros(size, np.int64)
    parts = stored.select("terms").mapInArrow(run, "term long, n long")
    for term, n in parts.groupBy("term").agg(F.sum("n")).collect():  # a row per known term
        found[term] = n
    return found


def weights(df: np.ndarray, n_documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_documents + 2) / (2 * df + 1))).astype(np.int64)


class _Best:
    """The best documents of one item so far: highest score, then smallest id, rows without id last."""

    def __init__(self, top: int):
        self.top, self.score = top, np.zeros(0, np.int64)
        self.id, self.unnamed = np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def last(self) -> int:
        """A score below this one is not among the best; below 1 none is."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score, ids, unnamed):
        there = score >= self.last
        score, ids, unnamed = (
            np.concatenate([a, b[there]]) for a, b in ((self.score, score), (self.id, ids), (self.unnamed, unnamed))
        )
        order = np.lexsort((ids, unnamed, -score))[: self.top]
        self.score, self.id, self.unnamed = score[order], ids[order], unnamed[order]


class _Shard:
    """Postings of some documents by term: rows, and what each occurrence adds to a score."""

    def __init__(self, ids, unnamed, n, which, times, offsets, weight, n_documents, length):
        self.ids, self.unnamed, self.size = ids, unnamed, len(ids)
        rows = np.repeat(np.arange(self.size), np.diff(offsets))
        slow = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_documents) // length
        part = (SCALE * 1_000_000 * times) // (SCALE * times + SATURATION * slow[rows])
        order = np.argsort(which, kind="stable")
        self.rows, self.part = rows[order], (weight[which] * part)[order]
        self.at = np.searchsorted(which[order], np.arange(len(weight) + 1))
        there = np.flatnonzero(np.diff(self.at))
        self.highest = np.zeros(len(weight), np.int64)
        if len(there):
            self.highest[there] = np.maximum.reduceat(self.part, self.at[there])

    def search(self, item: np.ndarray, best: _Best):
        """Add to ``best`` what these documents have for an item's term numbers."""
        item = item[self.highest[item] > 0]
        item = item[np.argsort(self.highest[item], kind="stable")]
        most = self.highest[item]
        # the terms before this place cannot reach the last place, even together
        needed = int(np.searchsorted(np.cumsum(most), best.last))
        if needed == len(item):
            return
        present = np.zeros((len(item), self.size), bool)
        for i, term in enumerate(item):
            present[i, self.rows[self.at[term] : self.at[term + 1]]] = True
        documents = np.flatnonzero(present[needed:].any(axis=0))
        masks = np.ascontiguousarray(np.packbits(present[:, documents], axis=0).T)
        _, first, group = np.unique(
            masks.view(np.dtype((np.void, masks.shape[1]))).ravel(), return_index=True, return_inverse=True
        )
        maximum = present[:, documents[first]].T @ most
        order = np.argsort(-maximum, kind="stable")
        members = np.argsort(group, kind="stable")
        begin = np.searchsorted(group[members], np.arange(len(first) + 1))
        done, step = 0, FIRST_EVALUATED
        while done < len(order) and maximum[order[done]] >= best.last:
            sizes = np.cumsum(begin[order[done:] + 1] - begin[order[done:]])
            upto = done + 1 + int(np.searchsorted(sizes, step))
            chosen = order[done:upto]
            chosen = chosen[maximum[chosen] >= best.last]
            rows = documents[np.concatenate([members[begin[g] : begin[g + 1]] for g in chosen])]
            best.add(self._scores(item, present, rows), self.ids[rows], self.unnamed[rows])
            done, step = upto, 2 * step

    def _scores(self, item, present, rows):
        i, j = np.nonzero(present[:, rows])
        found = np.zeros(len(rows), np.int64)
        for k, (a, b) in enumerate(zip(*(np.searchsorted(i, np.arange(len(item)) + x) for x in (0, 1)))):
            if a < b:
                low = self.at[item[k]]
                places = low + np.searchsorted(self.rows[low : self.at[item[k] + 1]], rows[j[a:b]])
                found[j[a:b]] += self.part[places]
        return found


def _shards(batches, weight, n_documents, length):
    for batch in batches:
        which = batch.column(2)
        offsets = which.offsets.to_numpy().astype(np.int64)
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(offsets, offsets[at] + POSTINGS, side="right")) - 1
            upto = max(at + 1, min(upto, at + DOCUMENTS))
            part = batch.slice(at, upto - at)
            ids = part.column(0)
            yield _Shard(
                ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False),
                part.column(1).to_numpy(), part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy(),
                offsets[at : upto + 1], weight, n_documents, length,
            )
            at = upto


def _best_of_block(docs, doc_id, text, block: list, top: int) -> DataFrame | None:
    known = {term: i for i, term in enumerate(dict.fromkeys(bytes(t) for _, t in block))}
    of_item: dict = {}
    for item, term in block:
        of_item.setdefault(item, []).append(known[bytes(term)])
    items = list(of_item)
    stored = settle(postings(docs, doc_id, text, known))
    n_documents, length = stored.agg(F.count("*"), F.sum("n")).first()
    if not n_documents:
        return None
    weight = weights(document_counts(stored, len(known)), n_documents)
    wanted = docs.sparkSession.sparkContext.broadcast(([np.array(sorted(t)) for t in of_item.values()], weight))

    def run(batches):
        queries, weight = wanted.value
        best = [_Best(top) for _ in queries]
        for shard in _shards(batches, weight, n_documents, length):
            for query, so_far in zip(queries, best):
                shard.search(query, so_far)
        for number, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([items[number]] * len(b.score), pa.int64()),
                        pa.array(b.id, mask=b.unnamed), pa.array(b.score),
                    ],
                    names=["item", "doc", "score"],
                )

    return stored.mapInArrow(run, "item long, doc long, score long")


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item id, rank, document id, score) of each item's ``top`` best documents with a score above 0.

    Equal scores by document id, rows without id last. Every row of ``docs`` is a
    document of its own, so repeated rows are ranked one by one. Item rows of one
    id are one item with the terms of all of them; those without id are one
    item too. Items without terms, or whose terms no document has, give no rows.
    Building the result runs jobs: postings are written once per block of items.
    """
    pairs = settle(item_terms(items, item_id, item_text))
    total = pairs.count()
    blocks = max(1, -(-total // block_terms))
    found = None
    for b in range(blocks):
        chosen = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else pairs
        # about block_terms rows, and never less than a whole item
        rows = chosen.orderBy("item", "term").collect()
        part = _best_of_block(docs, doc_id, text, rows, top) if rows else None
        found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        found = pairs.limit(0).select("item", F.lit(None).cast("long").alias("doc"), F.lit(0).cast("long").alias("score"))
    place = F.row_number().over(
        Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    )
    best = found.withColumn("rank", place).where(F.col("rank") <= top)
    return best.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
