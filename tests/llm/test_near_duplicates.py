from __future__ import annotations

import random
from collections import Counter

import numpy as np
import oracle
import pyarrow as pa
import pytest
import regex
from awkward import empty, frame
from pyspark.sql import functions as F

from tallymark.llm import bpe, decontaminate, jaccard_join
from tallymark.llm.components import components
from tallymark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    """(doc, n, component) by comparing all pairs."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(docs, size, percent):
    return sorted((tuple(r) for r in jaccard_join.near_duplicates(docs, size=size, percent=percent).collect()), key=repr)


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op1_ngram_jaccard_join"](spark, SF).collect()), key=repr) == brute(rows, 4, 85)


def test_awkward_rows(spark):
    docs = frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs, 5, 80) == brute(rows, 5, 80)
    assert found(empty(spark), 5, 80) == []


def mutated(rnd, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10**6)}"
    return out


def cluster(seed, size=90):
    """A large group of near copies of one text, around the threshold, and texts that share a passage."""
    rnd = random.Random(seed)
    base, passage = [f"b{i}" for i in range(120)], [f"p{i}" for i in range(40)]
    rows = [" ".join(mutated(rnd, base, rnd.randrange(5))) for _ in range(size)]
    rows += [" ".join(passage + [f"r{rnd.randrange(10**6)}" for _ in range(rnd.randrange(3, 30))]) for _ in range(size)]
    rows += [rows[0]] * 20 + [" ".join(base[k:]) for k in range(0, 60, 3)]
    return [(i, t, None, None) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_around_the_threshold(spark, seed, monkeypatch):
    # small cells, so that keys are split and groups of others arise
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 16)
    rows = cluster(seed)
    assert found(frame(spark, rows, extra=False), 4, 85) == brute([r[:2] for r in rows], 4, 85)


def test_trees_find_what_all_pairs_find():
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rnd.integers(0, 2**63, rnd.integers(20, 400)).astype(np.uint64)
        for _ in range(rnd.integers(1, 12)):
            keep = base[rnd.random(len(base)) > 0.05]
            sets.append(np.unique(np.concatenate([keep, rnd.integers(0, 2**63, 5).astype(np.uint64)])))
    sets.sort(key=len)
    n = len(sets)
    batch = pa.record_batch(
        [pa.array([0] * n), pa.array([0] * n), pa.array(range(n)), pa.array([len(s) for s in sets]),
         pa.array(range(n)), pa.array([jaccard_join.bitmap(s, jaccard_join.SIGNATURE).tobytes() for s in sets])],
        names=["key", "cell", "class", "n", "label", "signature"],
    )
    rows = jaccard_join.Rows(batch)
    got = set()
    for i, j in jaccard_join.Tree(rows, 0, n).pairs(80):
        i, j, _ = rows.similar(i, j, 80)
        got |= set(zip(i.tolist(), j.tolist()))
    for i in range(n):
        for j in range(i + 1, n):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in got
    rows.label[:] = 7
    assert sum(len(i) for i, _ in jaccard_join.Tree(rows, 0, n).pairs(80)) == 0


@pytest.mark.parametrize("percent", [50, 80, 85, 99])
def test_similar_sets_share_a_key(percent):
    rnd = np.random.default_rng(percent)
    met = 0
    for _ in range(3000):
        a = np.unique(rnd.integers(0, 2**64, rnd.integers(1, 12) ** 2, dtype=np.uint64))
        most = max(1, int(len(a) * (100 - percent) / 100))
        kept = rnd.permutation(a)[rnd.integers(0, most + 1) :]
        b = np.unique(np.concatenate([kept, rnd.integers(0, 2**64, rnd.integers(0, most + 1), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            met += 1
            keys = [jaccard_join.segment_keys(x, percent) for x in (a, b)]
            assert len(np.intersect1d(*keys))
            assert all(len(k) <= 4 + 6 * len(x) for k, x in zip(keys, (a, b)))
    assert met > 500


def test_a_shared_passage_is_no_key():
    rnd = np.random.default_rng(5)
    passage = rnd.integers(0, 2**64, 60, dtype=np.uint64)
    texts = [np.unique(np.concatenate([passage, rnd.integers(0, 2**64, 240, dtype=np.uint64)])) for _ in range(60)]
    keys = np.concatenate([jaccard_join.segment_keys(t, 85) for t in texts])
    assert len(np.unique(keys)) > 0.99 * len(keys)


def test_bounds_never_fall_below_the_overlap():
    rnd = np.random.default_rng(2)
    for _ in range(100):
        a = np.unique(rnd.integers(0, 2**63, rnd.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[:: rnd.integers(1, 4)], rnd.integers(0, 2**63, rnd.integers(1, 900)).astype(np.uint64)]))
        wide = [jaccard_join.bitmap(s, max(512, 1 << int(8 * len(s) - 1).bit_length())).tobytes() for s in (a, b)]
        real = len(np.intersect1d(a, b))
        assert jaccard_join.set_overlap(len(a), a.tobytes(), len(b), b.tobytes()) == real
        assert real <= jaccard_join.wide_overlap(len(a), wide[0], len(b), wide[1])


def test_one_of_each_group_stays(spark):
    docs = frame(spark)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    expected = {d for d, _, c in brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if d == c}
    assert {r.doc_id for r in kept.collect()} == expected | {None}
    assert {1, 3, 4, 5, 6} <= expected and 2 not in expected
    assert jaccard_join.keep_one(empty(spark)).collect() == []


def test_one_row_of_each_group_stays(spark):
    """Rows that stay, counted: ids that occur several times, and rows without id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [
        (1, a), (1, a), (7, a), (2, b), (2, a), (2, b), (3, c + " more"), (None, c), (None, c), (None, d), (None, d), (None, d + " end"),
        (4, ""), (4, ""), (None, None), (None, None), (5, b), (6, "alone"), (6, "other"),
    ]
    docs = frame(spark, [(*r, "en", "s") for r in rows])
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    ends = [x for x in left if x[0] is None and x[1] and x[1].startswith(d)]
    assert len(ends) == 1 and left.pop(ends[0]) == 1
    assert left == Counter(
        [(1, a), (2, b), (3, c + " more"), (4, ""), (4, ""), (None, None), (None, None), (6, "alone"), (6, "other")]
    )
    # a table loaded twice is the table
    twice = docs.where("text <> ''").unionAll(docs.where("text <> ''"))
    assert jaccard_join.keep_one(twice).count() == 6


def test_row_keys_are_one_to_one(spark):
    ids = [(p << 33) + i for p in (0, 1, 2, 77, 2**20) for i in (0, 1, 5, 2**26, 2**33 - 1)]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").withColumn("key", jaccard_join.row_number(F.col("i")))
    got = rows.withColumn("back", jaccard_join.row_number(F.col("key"))).collect()
    assert len({r.key for r in got}) == len(ids) and all(r.back == r.i for r in got)


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + rnd.randrange(200), 1000 + rnd.randrange(200)) for _ in range(120)]
    links += [(-5, 2000), (2000, 2000), (2000, -5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for a, b in links for x in (a, b)}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    assert got == {x: v for x, v in label.items() if x in got}
    assert {x for a, b in links if a != b for x in (a, b)} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# Decontamination

def plain(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def best_windows(docs, items):
    """Highest weighted Jaccard of any item-sized window, for pairs that reach 0.8."""
    out = {}
    for doc, text in docs:
        w = plain(text)
        for item, other in items:
            y = plain(other)
            if not w or not y:
                continue
            wanted, best = bag(y), 0
            for at in range(max(1, len(w) - len(y) + 1)):
                x = bag(w[at : at + len(y)])
                shared = sum((x & wanted).values())
                best = max(best, shared / (sum(x.values()) + sum(wanted.values()) - shared))
            if best >= 0.8:
                out[doc, item] = max(best, out.get((doc, item), 0))
    return out


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.similarity for r in QUERIES["op5_benchmark_decontamination"](spark, SF).collect()}
    assert got == pytest.approx(best_windows(docs, items))


ITEM = " ".join(f"word{i}" for i in range(40))


def test_edits_ends_and_short_items(spark):
    w = ITEM.split()
    texts = [
        (1, "start " + ITEM.upper() + "!!! end"), (2, " ".join(w[:20] + ["changed"] + w[21:])), (3, " ".join(w[2:])),
        (4, " ".join(w[:20])), (5, " ".join(w[:5] * 8)), (6, ITEM + " " + ITEM), (7, None), (8, ""), (9, "say tiny item here"),
        (10, "tiny, item"), (None, ITEM), (1, "other"), (11, "tiny other item"),
    ]
    docs = frame(spark, [(*t, None, None) for t in texts])
    benchmark = spark.createDataFrame(
        [(1, ITEM, "x"), (2, "Tiny item", "x"), (3, None, "x"), (4, " !! ", "x"), (5, ITEM, "x")],
        "item_id long, text string, doc_id string",
    )
    rows = decontaminate.leaks(docs, benchmark).collect()
    expected = best_windows(texts, [(1, ITEM), (2, "Tiny item"), (5, ITEM)])
    assert {(r.doc_id, r.item_id): r.similarity for r in rows} == pytest.approx(expected)
    at = {(r.doc_id, r.item_id): (r.first_word, r.n_words) for r in rows}
    assert at[1, 1] == (1, 40) and at[6, 1] == (0, 40) and at[9, 2] == (1, 2)
    left = decontaminate.without_leaks(docs, benchmark)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {t[0] for t in texts} - {d for d, _ in expected}
    assert decontaminate.leaks(docs, benchmark.where("false")).collect() == []
    assert decontaminate.leaks(empty(spark), benchmark).collect() == []


def test_parts_in_another_order_inside_a_longer_document(spark):
    w = [f"part{i}" for i in range(50)]
    before, after = [f"x{i}" for i in range(60)], [f"y{i}" for i in range(60)]
    texts = [
        (1, before + w[25:] + w[:25] + after), (2, before + w[25:] + w[:25]), (3, w[25:] + w[:25] + after),
        (4, before + w[30:] + w[:30] + after), (5, before + w[:25] + after + w[25:]), (6, before + w[3:] + after),
        (7, before + w[:-4] + after), (8, before + w + after + w), (8, before + w[25:] + w[:25]), (None, w[25:] + w[:25] + after),
    ]
    texts = [(d, " ".join(t)) for d, t in texts]
    benchmark = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    docs = frame(spark, [(*t, None, None) for t in texts])
    rows = decontaminate.leaks(docs, benchmark).collect()
    expected = best_windows(texts, [(1, " ".join(w))])
    assert {(r.doc_id, r.item_id): r.similarity for r in rows} == pytest.approx(expected)
    assert {1, 2, 3, 4, 6, 7, 8, None} == {d for d, _ in expected}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect()} == {5}
    assert {r.doc_id: r.first_word for r in rows}[1] == 60


def test_more_shingles_than_one_broadcast_takes(spark, monkeypatch):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = decontaminate.leaks(docs, benchmark)
    expected = sorted(map(tuple, expected.collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 600)
    assert sorted(map(tuple, decontaminate.leaks(docs, benchmark).collect())) == expected


def test_index_finds_every_fingerprint_within_the_radius(spark):
    rnd = random.Random(6)
    prints = [(i, rnd.getrandbits(64)) for i in range(20)]
    near = []
    for i, p in prints:
        for _ in range(20):
            flips = sum(1 << b for b in rnd.sample(range(64), rnd.randrange(decontaminate.RADIUS + 1)))
            near.append((i, p ^ flips))
    signed = lambda rows: [(i, p - (p >> 63 << 64)) for i, p in rows]
    flips = decontaminate.RADIUS // decontaminate.BLOCKS
    items = spark.createDataFrame(signed(prints), "i long, p long")
    probes = spark.createDataFrame([(n, *x) for n, x in enumerate(signed(near))], "n long, i long, p long")
    a = items.select("i", F.explode(decontaminate.index_keys(F.col("p"), flips - flips // 3)).alias("key"))
    b = probes.select("n", "i", F.explode(decontaminate.index_keys(F.col("p"), flips // 3)).alias("key"))
    assert a.join(b, ["i", "key"]).select("n").distinct().count() == len(near)


def test_simhash(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "a"],), (["a"],), ([],)], "f array<string>")
    got = [r[0] for r in rows.select(decontaminate.simhash(F.col("f"))).collect()]
    hashes = {x: spark.range(1).select(F.xxhash64(F.lit(x))).first()[0] for x in "abc"}
    expected = 0
    for bit in range(64):
        if sum(1 if hashes[x] >> bit & 1 else -1 for x in "abca") > 0:
            expected |= 1 << bit
    assert got == [expected - (expected >> 63 << 64), hashes["a"], 0]


def test_parts_in_another_order_against_sql(spark, tmp_path):
    """An item A + B is found where it stands as B + A, by the operator and by its SQL."""
    a, b = [f"first{i}" for i in range(25)], [f"second{i}" for i in range(25)]
    noise = [f"other{i}" for i in range(60)]
    texts = [noise[:30] + b + a + noise[30:], noise + a + b, a + noise + b, b + a, noise]
    tables = {
        "documents": spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(9, " ".join(a + b))], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / "made" / name))
        (part,) = (tmp_path / "made" / name).glob("*.parquet")
        part.rename(tmp_path / f"{name}.parquet")
    got = QUERIES["op5_benchmark_decontamination"](spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {0, 1, 3}
    assert oracle.spark_rows(got) == oracle.duck_rows(oracle.connect(str(tmp_path)), ORACLES["op5_benchmark_decontamination"])


def test_batches_are_bounded_while_the_join_runs(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    settle = jaccard_join.settle

    def noted(df, *args, **more):
        seen.append(spark.conf.get(name))
        return settle(df, *args, **more)

    monkeypatch.setattr(jaccard_join, "settle", noted)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, f"{text} x"), (3, "other words here")], "doc_id long, text string")
    assert [r[2] for r in found(docs, 4, 85)] == [1, 1, 3]
    assert set(seen[:-2]) == {str(jaccard_join.BATCH_BYTES)} and spark.conf.get(name) == before


def test_classes_hold_no_second_form_of_their_sets(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(6)]
    docs = spark.createDataFrame([(i, t + end) for i, t in enumerate(texts) for end in ("", " more")], "doc long, text string")
    shared = jaccard_join.shared_keys(docs, 4, 85)
    classes = jaccard_join.class_keys(docs, shared, 4, 85)
    assert classes.columns == ["class", "n", "signature", "keys", "shingles"]
    names = [r[0] for r in classes.select("class").distinct().collect()]
    assert len(names) == 12
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a long, b long")
    exact = {tuple(r) for r in jaccard_join.checked(pairs, classes, 85, jaccard_join.set_overlap).collect()}
    wide = jaccard_join.checked(pairs, classes, 85, jaccard_join.wide_overlap, jaccard_join.wide_bitmap)
    assert len(exact) == 6 and exact <= {tuple(r) for r in wide.collect()}


def placed(sets, cells):
    signatures = [jaccard_join.bitmap(s, jaccard_join.SIGNATURE).tobytes() + jaccard_join.parities(s).tobytes() for s in sets]
    columns = {
        "key": cells, "cell": [0] * len(sets), "class": range(len(sets)), "n": [len(s) for s in sets], "label": range(len(sets)),
        "signature": signatures,
    }
    return pa.record_batch([pa.array(c) for c in columns.values()], names=list(columns))


def test_long_texts_that_share_a_part_are_told_apart_in_a_cell():
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 2**64, 1500, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:900], rnd.integers(0, 2**64, 600, dtype=np.uint64)])) for _ in range(60)]
    sets += [np.unique(np.concatenate([base[n:], rnd.integers(0, 2**64, n, dtype=np.uint64)])) for n in range(0, 150, 10)]
    batch = placed(sets, [7] * len(sets))
    rows = next(jaccard_join._cells([batch]))
    got = {(a, b) for i, j in jaccard_join._allowed(rows, 80, "all") for a, b in zip(i.tolist(), j.tolist())}
    similar = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                similar.add((i, j))
    assert similar and similar <= got
    assert len(got) < 2 * len(similar)


def test_parities_never_differ_in_more_bits_than_sets_in_shingles():
    rnd = np.random.default_rng(9)
    for n in (0, 1, 50, 3000, 20_000):
        a = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        for lost in (0, 1, 30, n):
            b = np.unique(np.concatenate([a[lost:], rnd.integers(0, 2**64, lost // 2, dtype=np.uint64)]))
            differ = np.bitwise_count(jaccard_join.parities(a) ^ jaccard_join.parities(b)).sum()
            assert differ <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("mode", ["all", "best"])
def test_small_cells_need_no_tree_each(mode, monkeypatch):
    rnd = np.random.default_rng(10)
    made = []

    class Counted(jaccard_join.Tree):
        def __init__(self, *args):
            made.append(args)
            super().__init__(*args)

    monkeypatch.setattr(jaccard_join, "Tree", Counted)
    monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", 7)
    sets, cells = [], []
    for cell, rows in enumerate([1, 2, 3, 16, 17, 40, 1, 5, 16, 2]):
        base = rnd.integers(0, 2**64, 100, dtype=np.uint64)
        some = [np.unique(np.concatenate([base[k:], rnd.integers(0, 2**64, k, dtype=np.uint64)])) for k in rnd.integers(0, 40, rows)]
        sets += sorted(some, key=len)
        cells += [cell] * rows
    rows = jaccard_join._whole(pa.Table.from_batches([placed(sets, cells)]))
    pairs = [(i, j) for x in jaccard_join._allowed(rows, 80, mode) for i, j in zip(*(y.tolist() for y in x))]
    assert len(made) == 2
    i, j = np.array([(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if cells[i] == cells[j]]).T
    i, j, score = rows.similar(i, j, 80)
    if mode == "all":
        assert sorted(pairs) == sorted(zip(i.tolist(), j.tolist()))
    else:
        best = jaccard_join._best(i, j, score)
        assert sorted(pairs) == sorted(zip(*(x.tolist() for x in best)))


def test_tasks_of_the_join_hold_nothing_of_other_operators():
    from tallymark.llm import kept

    @kept.kept(2)
    def words(n):
        return list(range(n))

    words(5)
    task = kept.alone(lambda batches: ((b, words.cache_info().currsize) for b in batches))
    assert list(task([1, 2])) == [(1, 0), (2, 0)]
    words(5)
    kept.release()
    assert words.cache_info().currsize == 0 and words(3) == [0, 1, 2]
    assert bpe.vocabulary.cache_clear in kept._clear


def test_sets_are_sorted_and_distinct():
    rnd = np.random.default_rng(11)
    for n in (0, 1, 3, 4, 5, 300):
        words = rnd.integers(0, 4, n).astype(np.uint64)
        got = jaccard_join.shingle_set(words, 4)
        assert np.array_equal(got, np.unique(got)) and len(got) == len({tuple(words[k : k + 4]) for k in range(max(1, n - 3))} if n else ())
