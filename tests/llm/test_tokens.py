from __future__ import annotations

import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from awkward import LONG, empty, frame, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm import bpe, token_counts, token_files, wavelet
from tallymark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rnd = random.Random(1)
    letters = "aAbe \n\t\x0b\x1c\x85　éÉΣßİ日本😀'’sStTrvdmlM0123 ٣½²Ⅷ%&-_,.́​ﬁǅ\x00\x7f"
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    out += ["".join(chr(rnd.choice([rnd.randint(32, 0x2FFF), rnd.randint(0x1F000, 0x1FAFF)])) for _ in range(30)) for _ in range(200)]
    return out + [
        None, "", "<|endoftext|>", "a<|startoftext|>B <|endoftext|><|endoftext|>x", "a" * 5000, "the" * 3000,
        "aaaa aaaaa aa a", "ha" * 1001 + "'s", LONG,
    ]


def test_ids_are_the_librarys(library):
    given = odd_texts()
    found = [np.frombuffer(x, "<i4").tolist() for x in bpe.vocabulary(PATH).encode(given)]
    expected = [e.ids for e in library.encode_batch([t or "" for t in given], add_special_tokens=False)]
    assert found == expected
    assert [bpe.vocabulary(PATH).decode(x) for x in found] == [library.decode(x, skip_special_tokens=False) for x in expected]


def test_few_kept_words_give_the_same_ids(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe, "FRESH_WORDS", 20)
    given = odd_texts()
    found = [np.frombuffer(x, "<i4").tolist() for x in bpe.Vocabulary(PATH).encode(given)]
    assert found == [e.ids for e in library.encode_batch([t or "" for t in given], add_special_tokens=False)]


def test_bpe_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: r for r in QUERIES["op9_bpe_encoding_and_decoding"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_awkward_rows(spark, library):
    docs = frame(spark)
    done = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert set(done.columns) == set(docs.columns)
    for r in done.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and r.score == "kept as it is"
    assert bpe.decode(bpe.encode(empty(spark), PATH), PATH).collect() == []


@pytest.mark.parametrize("size,values", [(0, [1]), (1, [0]), (777, [0]), (5000, [3, 5, 9, 4000, 49407]), (600_000, range(70_000))])
def test_wavelet_matrix(size, values, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", 1 << 12 if size < 10_000 else wavelet.BLOCK_BITS)
    ids = np.random.default_rng(0).choice(list(values), size)
    file = io.BytesIO()
    wavelet.write(file, ids, b"about")
    file.seek(0)
    m = wavelet.WaveletMatrix(file, kept_blocks=4)
    assert m.documents == b"about" and m.size == size
    assert (m.all() == ids).all()
    for i in np.linspace(0, size - 1, 50).astype(int) if size else ():
        value = int(ids[i])
        assert m.access(i) == value
        assert m.rank(value, int(i)) == np.count_nonzero(ids[:i] == value)
        places = np.flatnonzero(ids == value)
        assert m.count(value) == len(places)
        assert m.select(value, len(places) // 2) == places[len(places) // 2]
    if 0 < size < 10_000:
        assert list(m.occurrences(int(ids[0]))) == np.flatnonzero(ids == ids[0]).tolist()
    assert m.count(70_001) == 0
    with pytest.raises(IndexError):
        m.access(size)
    with pytest.raises(IndexError):
        m.select(70_001, 0)


def expected_files(library, rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = [tuple(r) for r in QUERIES["op7_token_id_binary_output"](spark, SF).orderBy("doc_id").collect()]
    assert got == expected_files(library, [(d.doc_id, d.text) for d in docs])


def test_many_files_on_awkward_rows(spark, library, monkeypatch):
    docs = frame(spark)
    rows = sorted(((i, t) for i, t, *_ in texts()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    manifest = token_files.write_files(docs, PATH, end_id=2)
    got = sorted((tuple(r) for r in token_files.read_files(manifest).collect()), key=lambda r: r[1])
    assert got == expected_files(library, rows)
    assert token_files.read_files(token_files.write_files(empty(spark), PATH, end_id=2)).collect() == []


def test_rows_of_one_id_are_dealt_to_several_tasks(spark, library):
    rows = [(7, f"text {i % 500} of one id") for i in range(2000)] + [(None, "the same")] * 1000 + [(8, "after"), (1, "before")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows go to one task
    try:
        manifest = token_files.write_files(docs, PATH, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in manifest.collect()}) > 2
    got = sorted((tuple(r) for r in token_files.read_files(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 1000 + [1] + [7] * 2000 + [8]
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    plain = expected_files(library, rows)
    assert sorted((r[0] or 0, *r[2:]) for r in got) == sorted((r[0] or 0, *r[2:]) for r in plain)


def test_control_characters_and_forgotten_words(library, monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 4)
    texts = ["a\x00b \x7f \x1b[0m it's don't x, y! 12ab3 ...", "a b c d e f g a b c", "the the THE tHe", "a\x00b c"]
    found = list(token_files.LibraryVocabulary(PATH).encode(texts))
    assert [np.frombuffer(f, "<i4").tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_file_ends_with_a_document(library, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 5)
    import pyarrow as pa

    batches = [pa.record_batch([pa.array([1, 2, None]), pa.array(["a b c d e f", "g", "h i"])], names=["id", "text"])]
    loads = list(token_files._file_loads(batches, PATH, 2))
    assert [(ids, lengths) for ids, lengths, _ in loads] == [([1], [7]), ([2, None], [2, 3])]
    assert [len(t) for *_, t in loads] == [7, 5]


def brute_sections(text, lengths, rule):
    vocabulary, _ = token_counts.encoding(RANKS, public_tokenizers.PATTERN)
    edges = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    spans, at, tokens = list(zip(edges, edges[1:])), 0, [0] * len(lengths)
    for piece in vocabulary.decode_tokens_bytes(vocabulary.encode_ordinary(text)):
        share = [min(e, at + len(piece)) - max(s, at) for s, e in spans]
        if rule == "first":
            tokens[next(k for k, (s, e) in enumerate(spans) if s <= at < e)] += 1
        else:
            tokens[share.index(max(share))] += 1
        at += len(piece)
    return tokens


@pytest.mark.parametrize("rule", token_counts.RULES)
@pytest.mark.parametrize("sections", [token_counts.lines, token_counts.sentences])
def test_token_counts(spark, rule, sections):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    rows = token_counts.count_sections(docs, RANKS, public_tokenizers.PATTERN, sections=sections, rule=rule).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.section):
        found.setdefault(r.doc_id, []).append((r.n_bytes, r.n_tokens))
    for d in docs.collect():
        lengths = [n for n, _ in found[d.doc_id]]
        assert sum(lengths) == len(d.text.encode())
        assert [n for _, n in found[d.doc_id]] == brute_sections(d.text, lengths, rule)


def test_sections_against_an_own_split(spark):
    """Every byte is in one section, in order, and no section is empty, whatever the text ends with."""
    texts = ["One. Two.\n", "One.\n\nTwo! ", "a? b", "", "\n", "no end", ". . .", "x.\ty", "é. ü.\n\n", "a.b. c\nd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = {token_counts.sentences: r"[.!?][\x20\x09-\x0D]", token_counts.lines: r"\n"}
    for sections, end in patterns.items():
        rows = token_counts.count_sections(docs, RANKS, public_tokenizers.PATTERN, sections=sections).collect()
        for i, text in enumerate(texts):
            cuts = [0, *(m.end() for m in re.finditer(end, text)), len(text)]
            expected = [len(text[a:b].encode()) for a, b in zip(cuts, cuts[1:]) if a < b]
            assert [r.n_bytes for r in sorted(rows, key=lambda r: r.section) if r.doc_id == i] == expected


def test_fields_and_awkward_rows(spark):
    docs = frame(spark)
    whole = F.concat_ws(" ", "lang", "source", "text")

    def fields(_):
        parts = F.array(*[F.octet_length(F.coalesce(c, F.lit(""))) for c in ("lang", "source", "text")])
        return F.transform(parts, lambda n: n)

    rows = token_counts.count_sections(docs.withColumn("whole", whole), RANKS, public_tokenizers.PATTERN, "whole", fields)
    assert {r.section for r in rows.where("doc_id = 1").collect()} == {0, 1, 2}
    counts = token_counts.count_sections(docs, RANKS, public_tokenizers.PATTERN)
    vocabulary, _ = token_counts.encoding(RANKS, public_tokenizers.PATTERN)
    per_row = {(r.doc_id, r.lang): r.n for r in counts.groupBy("doc_id", "lang").agg(F.sum("n_tokens").alias("n")).collect()}
    assert per_row[6, "de"] == len(vocabulary.encode_ordinary(LONG))
    assert per_row[2, "en"] == 2 * per_row[1, "en"]
    assert (3, "en") not in per_row and (4, None) not in per_row
    assert counts.where("doc_id = 1").first().score == "kept as it is"
    assert token_counts.count_sections(empty(spark), RANKS, public_tokenizers.PATTERN).collect() == []


def test_crossing_tokens_over_many_sections():
    ends = np.array([4, 5, 12])
    starts_of, ends_of = np.array([0, 2, 2, 6, 7]), np.array([2, 2, 6, 7, 12])
    assert [x.tolist() for x in token_counts.attribute(ends, starts_of, ends_of, "largest")] == [[1, 0, 1, 0, 1], [1, 0, 0, 0, 1]]
    assert [x.tolist() for x in token_counts.attribute(ends, starts_of, ends_of, "first")] == [[1, 0, 2, 0, 0], [1, 0, 1, 0, 0]]


def test_query_counts_every_token(spark):
    vocabulary, _ = token_counts.encoding(RANKS, public_tokenizers.PATTERN)
    total = QUERIES["op3_token_counts"](spark, SF).agg(F.sum("n_tokens")).first()[0]
    assert total == sum(len(vocabulary.encode_ordinary(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_words_beyond_ascii_are_one_look_each(library, monkeypatch):
    vocabulary = token_files.LibraryVocabulary(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(vocabulary, "pieces", None)  # the way for words of other kinds
    words = ["ouanqué", "ÉLÈVE,", "straße.", "œuvre", "ªº", "ǅx", "ɏɏ", "naïve!", "é", "é,", "abc", "a-b", "x1,"]
    for word in words:
        ids = library.encode(word, add_special_tokens=False).ids
        assert list(np.frombuffer(b"".join(vocabulary.encode([word])), "<u4")) == ids, word
    monkeypatch.undo()
    for word in ["é-è", "é1", "日本,", "ɐb", "é\u0301", "·é", "é\u00ad", "×", "ʼn't", "é's", "\u024f\u0250", "é\u2019s", "e\u0301."]:
        ids = library.encode(word, add_special_tokens=False).ids
        assert list(np.frombuffer(b"".join(vocabulary.encode([word])), "<u4")) == ids, word
