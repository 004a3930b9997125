from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from awkward import empty, frame, words

from tallymark.llm import marks, substrings, text
from tallymark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, size):
    """(n_words, kept words) per row, by the definition."""
    first = {}
    for doc, t in rows:
        w = words(t)
        for i in range(len(w) - size + 1 if doc is not None else 0):
            run = tuple(w[i : i + size])
            first[run] = min(first.get(run, doc), doc)
    out = []
    for doc, t in rows:
        w = words(t)
        gone = bytearray(len(w))
        for i in range(len(w) - size + 1 if doc is not None else 0):
            if first[tuple(w[i : i + size])] < doc:
                gone[i : i + size] = b"\1" * size
        out.append((doc, len(w), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def found(docs, size):
    return sorted(((r.doc_id, r.n_words, r.kept) for r in substrings.remove_repeated(docs, size=size).collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = {d: (n, n - len(kept.split()), hashlib.sha256(kept.encode()).hexdigest())
                for d, n, kept in brute([(d.doc_id, d.text) for d in docs], 50)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op6_substring_dedup"](spark, SF).collect()}
    assert got == expected
    assert any(n for _, n, _ in got.values())


def test_awkward_rows(spark):
    docs = frame(spark)
    assert found(docs, 50) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert found(docs, 4) == brute([(r.doc_id, r.text) for r in docs.collect()], 4)
    assert found(empty(spark), 50) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, seed):
    rnd = random.Random(seed)
    passages = [[str(rnd.randint(0, 30)) for _ in range(rnd.randint(3, 30))] for _ in range(12)]
    rows = []
    for doc in range(120):
        parts = [w for _ in range(rnd.randint(0, 5)) for w in rnd.choice(passages)] + [f"u{doc}"]
        rows.append((rnd.choice([doc, doc // 2, None]), rnd.choice([" ", "\n", "\t "]).join(parts), None, None))
    docs = frame(spark, rows, extra=False)
    for size in (2, 5, 9):
        assert found(docs, size) == brute([(r[0], r[1]) for r in rows], size)


def test_a_full_bit_field_changes_nothing(spark, monkeypatch):
    docs = frame(spark, extra=False)
    expected = found(docs, 5)
    monkeypatch.setattr(substrings, "bit_field", lambda values, column, bits: np.full(8, 255, np.uint8))
    assert found(docs, 5) == expected


def test_more_shared_anchors_than_a_field_takes(spark, monkeypatch):
    docs = frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(substrings, "FIELD_VALUES", 0)
    monkeypatch.setattr(substrings, "bit_field", None)
    assert found(docs, 5) == brute(rows, 5)
    marked, marks = substrings.with_marks(docs.selectExpr("doc_id as id", "xxhash64(text) as key", "text"), 50)
    # only windows whose anchor another document has are handed on: none of the text that stands alone
    windows = substrings.repeated_windows(marked, marks, 50)
    assert windows.where("id = 6").isEmpty() and not windows.isEmpty()


def test_many_rows_of_one_id(spark):
    passage = [f"p{i}" for i in range(8)]
    rows = [(1, " ".join(passage), None, None)]
    rows += [(2, " ".join([f"a{i}", *passage[i % 5 :], f"b{i}"]), None, None) for i in range(200)] + rows * 3
    docs = frame(spark, rows, extra=False)
    assert found(docs, 4) == brute([(r[0], r[1]) for r in rows], 4)


def test_windows_with_equal_hashes_are_told_apart(spark, monkeypatch):
    a, b = " ".join("abcdefgh"), " ".join("abcdefgi")
    docs = frame(spark, [(1, a, None, None), (2, b, None, None), (3, a, None, None)], extra=False)
    w = np.array([1, 2, 3, 4], np.uint64)
    assert len(np.unique(substrings.checks(w, 2))) == 3 and substrings.checks(w, 2).dtype == np.int32
    assert found(docs, 8) == brute([(1, a), (2, b), (3, a)], 8)


def test_bit_field(spark):
    values = [-(2**63), -1, 0, 1, 5, 32767, 32768, 2**62]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    field = marks.bit_field(rows, "v", bits=1 << 20)
    assert marks.may_hold(field, np.array(values, np.int64).view(np.uint64)).all()
    others = np.array([2, 3, 70000, 2**50 + 7], np.uint64)
    assert not marks.may_hold(field, others).any()
    assert not marks.may_hold(marks.bit_field(rows.where("false"), "v"), others).any()


def test_intervals_are_maximal():
    assert substrings.intervals(np.array([], int), 3) == []
    assert substrings.intervals(np.array([0, 1, 4, 8, 20]), 3) == [(0, 7), (8, 11), (20, 23)]


def test_word_hashes():
    texts = ["a b", None, "", " \t\x0b", "a  b\n", "A b", "ab", "b a", "É é", "x" * 300_000 + " a b"]
    seen = {}
    for size in (1, 10, 1 << 18):
        got = {}
        for first, hashes, at in text.chunks(texts, lower=False, size=size):
            for i in range(len(at) - 1):
                got[first + i] = hashes[at[i] : at[i + 1]].tolist()
        assert list(got) == list(range(len(texts)))
        assert [len(v) for v in got.values()] == [len(words(t)) for t in texts]
        assert got[0] == got[4] and got[0] == got[7][::-1] and got[9][1:] == got[0] and got[5][1] == got[0][1]
        assert got[5][0] != got[0][0]
        seen.setdefault("hashes", got)
        assert got == seen["hashes"]
    lower = next(text.chunks(["A É"], lower=True))[1]
    assert lower.tolist() == next(text.chunks(["a É"], lower=False))[1].tolist()


def test_words_across_blocks(monkeypatch):
    texts = ["a bc def " * 5, None, "x" * 40, "", " tail", "y" * 7 + " z", "ends " + "w" * 16]
    whole = [(h.tolist(), at.tolist()) for _, h, at in text.chunks(texts, lower=False)]
    runs = {n: text.sequences(np.arange(50, dtype=np.uint64), n).tolist() for n in (1, 3, 20, 50)}
    for block in (1, 2, 3, 7, 8, 16):
        monkeypatch.setattr(text, "BLOCK", block)
        assert [(h.tolist(), at.tolist()) for _, h, at in text.chunks(texts, lower=False)] == whole
        assert {n: text.sequences(np.arange(50, dtype=np.uint64), n).tolist() for n in runs} == runs


def test_memory_beside_a_long_text_does_not_grow():
    long = "word " * 4_000_000
    tracemalloc.start()
    for _, words, _ in text.chunks([long], lower=False):
        held = words.nbytes
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the encoded text twice or so, hashes and places of words, each twice while they are joined
    assert peak < 4 * len(long) + 4 * held + 100 * text.BLOCK
    assert len(text._POWERS[0]) <= 4 * text.BLOCK


def test_sequences():
    w = np.array([1, 2, 3, 1, 2, 3, 9], np.uint64)
    runs = text.sequences(w, 3)
    assert len(runs) == 5 and runs[0] == runs[3] and len(set(runs.tolist())) == 4
    assert len(text.sequences(w, 8)) == 0
    assert text.sequences(w[::-1].copy(), 3)[0] != runs[-1]
