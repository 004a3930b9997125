from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from awkward import empty, frame, words

from tallymark.llm import simhash_pivots as sp
from tallymark.llm.components import components
from tallymark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_print(text):
    w = [x.encode().lower() for x in words(text)]
    runs = [w[i : i + 4] for i in range(len(w) - 3)] if len(w) >= 4 else [w] if w else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(prints, radius=4):
    """The smallest place that each print reaches, by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                high, low = sorted((root(i), root(j)), reverse=True)
                parent[high] = low
    return [root(i) for i in range(len(prints))]


def brute(rows):
    prints = [plain_print(t) for _, t in rows]
    of = labels(prints)
    least = {}
    for (doc, _), c in zip(rows, of):
        if doc is not None:
            least[c] = min(least.get(c, doc), doc)
    return sorted(((d, f"{p:016x}", least.get(c)) for (d, _), p, c in zip(rows, prints, of)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(QUERIES["op12_simhash_near_dedup"](spark, SF)) == brute(rows)


def test_awkward_rows(spark):
    docs = frame(spark)
    assert found(sp.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(sp.near_duplicates(empty(spark))) == []


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_long_texts_are_hashed_whole(piece, monkeypatch):
    texts = ["a b c", "a b c d", " A  b\tc d e ", "x" * 100 + " y", "", " \n", "one two three four five six seven " * 9]
    expected = [plain_print(t) for t in texts]
    monkeypatch.setattr(sp, "PIECE", piece)
    assert [sp.fingerprint(t) for t in texts] == expected


def test_pivots_discard_what_is_far_apart():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**63, 500, dtype=np.uint64)
    b = rnd.integers(0, 2**63, 500, dtype=np.uint64)
    difference = sp.distance_table(a).astype(int) - sp.distance_table(b)
    apart = np.bitwise_count(a ^ b).astype(int)
    assert (np.abs(difference).max(axis=0) <= apart).all()
    assert ((difference**2).sum(axis=0) == 64 * apart).all()
    assert (np.abs(difference).max(axis=0)[apart > 16] > 4).all()


def scattered(rnd, n, center, most):
    """Prints that differ from ``center`` in up to ``most`` bits."""
    out = set()
    while len(out) < n:
        p = center
        for bit in rnd.sample(range(64), rnd.randrange(most + 1)):
            p ^= 1 << bit
        out.add(p)
    return list(out)


@pytest.mark.parametrize("seed", range(6))
def test_components_of_groups(seed, monkeypatch):
    monkeypatch.setattr(sp, "SHIFTED", 50)
    rnd = random.Random(seed)
    made = [
        scattered(rnd, 200, rnd.getrandbits(64), 5),  # one large component, few beside it
        scattered(rnd, 150, rnd.getrandbits(64), 12),  # a sparse ball
        [rnd.getrandbits(64) for _ in range(60)], [rnd.getrandbits(64)],
    ]
    rows = [(g, p) for g, prints in enumerate(made) for p in dict.fromkeys(prints)]
    rnd.shuffle(rows)
    order, label = sp.group_components(np.array([g for g, _ in rows]), np.array([p for _, p in rows], np.uint64))
    together = {}
    for place, l in enumerate(label):
        together.setdefault(l, set()).add(rows[order[place]])
    expected = {}
    for g, prints in enumerate(made):
        prints = list(dict.fromkeys(prints))
        for p, l in zip(prints, labels(prints)):
            expected.setdefault((g, l), set()).add((g, p))
    assert sorted(map(sorted, together.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("group_rows", [60, 10_000])
def test_crowded_blocks_are_cut_again(spark, group_rows):
    rnd = random.Random(7)
    center = rnd.getrandbits(64)
    prints = list(dict.fromkeys(scattered(rnd, 300, center, 9) + scattered(rnd, 60, center ^ 0xFFFF, 3)))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    links = sp.print_links(frame, group_rows=group_rows)
    got = {r.node: r.label for r in components(links).collect()}
    together, expected = {}, {}
    for p, l in zip(signed, labels(prints)):
        expected.setdefault(l, set()).add(p)
        together.setdefault(got.get(p, p), set()).add(p)
    assert sorted(map(sorted, together.values())) == sorted(map(sorted, expected.values()))
    sizes = [r["count"] for r in sp.groups(frame, group_rows=group_rows).groupBy("key").count().collect()]
    assert max(sizes) <= group_rows
