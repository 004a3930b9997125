from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from awkward import empty, frame

from tallymark.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def brute(docs, items, top=10):
    counts = [(d, Counter(split(t))) for d, t in docs if split(t)]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(split(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, c in counts:
            m = 100 - 90 + (90 * c.total() * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [
    (1, "the quick brown fox"), (1, "the quick brown fox"), (1, "lazy jumping"), (2, None), (3, ""), (4, "--- ..."),
    (None, "passage1 PASSAGE2 passage59"), (None, "one"), (5, "É ſ K é"), (6, "nowhere to be found at all"),
    (7, "alpha1 beta2 gamma3 x177 delta4 ÉÈ5"), (8, "a"),
]


def item_frame(spark, rows=ITEMS):
    rows = spark.createDataFrame(rows, "item_id long, text string")
    return rows.selectExpr("*", "1 as term", "2 as doc_id", "3 as rank", "4 as score")


@pytest.mark.parametrize("block_terms", [500_000, 5])
def test_awkward_rows(spark, block_terms):
    docs = frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(ls.search(docs, item_frame(spark), block_terms=block_terms)) == brute(rows, ITEMS)


def test_empty_tables(spark):
    assert found(ls.search(empty(spark), item_frame(spark))) == []
    assert found(ls.search(frame(spark), item_frame(spark, []))) == []
    assert found(ls.search(empty(spark), item_frame(spark, []))) == []


def corpus(seed, n=600):
    """Texts of few, very frequent words, so that many tie, with some that hold most of an item."""
    rnd = random.Random(seed)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(200)]
    items = [(i, " ".join(rnd.sample(common, 6) + rnd.sample(rare, rnd.randrange(8)))) for i in range(12)]
    docs = []
    for i in range(n):
        text = rnd.choices(common, k=rnd.randrange(1, 12)) + rnd.choices(rare, k=rnd.randrange(3))
        if rnd.random() < 0.05:
            text += rnd.choice(items)[1].split()
        docs.append((rnd.randrange(n), " ".join(text)))
    return docs + docs[:40], items


@pytest.mark.parametrize("seed", range(4))
def test_masks_lose_nothing(spark, seed, monkeypatch):
    docs, items = corpus(seed)
    monkeypatch.setattr(ls, "FIRST_EVALUATED", 1)
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(ls.search(made, item_frame(spark, items))) == brute(docs, items)
    assert found(ls.search(made, item_frame(spark, items), top=3)) == brute(docs, items, top=3)


def test_small_shards_and_finishing_early(monkeypatch):
    """The same best documents from shards of any size, and most documents are never scored."""
    rnd = np.random.default_rng(3)
    terms, n = 40, 3000
    held = [np.flatnonzero(rnd.random(terms) < 0.2) for _ in range(n)]
    offsets = np.cumsum([0, *map(len, held)])
    which, times = np.concatenate(held), rnd.integers(1, 4, offsets[-1])
    weight, size, item = rnd.integers(0, 5000, terms), rnd.integers(5, 50, n), np.arange(0, terms, 3)
    scored = []
    scores = ls._Shard._scores
    monkeypatch.setattr(ls._Shard, "_scores", lambda self, i, p, rows: scored.append(len(rows)) or scores(self, i, p, rows))

    def search(step):
        best = ls._Best(10)
        for a in range(0, n, step):
            b = min(n, a + step)
            part = slice(offsets[a], offsets[b])
            ls._Shard(
                np.arange(a, b), np.zeros(b - a, bool), size[a:b], which[part], times[part], offsets[a : b + 1],
                weight, n, int(size.sum()),
            ).search(item, best)
        return list(zip(best.id.tolist(), best.score.tolist()))

    slow = 10 + (90 * size * n) // size.sum()
    rows = np.repeat(np.arange(n), np.diff(offsets))
    part = weight[which] * ((10**9 * times) // (1000 * times + 8 * slow[rows])) * np.isin(which, item)
    total = np.bincount(rows, part, n).astype(int)
    expected = [(int(i), int(total[i])) for i in np.lexsort((np.arange(n), -total))[:10]]
    assert search(n) == expected
    assert sum(scored) < n / 3
    assert search(100) == search(7) == expected


def test_long_texts_are_read_whole(monkeypatch):
    text = "Alpha beta-GAMMA éa1 x" * 30 + "y" * 50 + " alpha"
    monkeypatch.setattr(ls, "PIECE", 5)
    assert ls.terms(text) == Counter(t.encode() for t in split(text))
    assert ls.terms(None) == Counter()
