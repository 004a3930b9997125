from __future__ import annotations

import base64
import hashlib
import io
import random
import zlib

import oracle
import pytest

from tallymark.llm import warc
from tallymark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_query_against_sql(spark):
    ours = oracle.spark_rows(QUERIES["op2_warc"](spark, SF))
    assert ours == oracle.duck_rows(oracle.connect(SF), ORACLES["op2_warc"])


PAGES = [
    (3, "http://a/é?x=1 2", "<p>é😀</p>"), (1, None, "<p>é😀</p>"), (2, "http://b", None), (5, "http://b", ""),
    (4, "http://b\r\nX: y", "z" * 3_000_000), (None, "http://n", "<p>é😀</p>"), (7, "u", "<p>é😀</p>"), (7, "u", "<p>é😀</p>"),
    (8, "u", "WARC/1.1\r\n\r\n\x1f\x08"),
]


def pages(spark, rows=None):
    return spark.createDataFrame(PAGES if rows is None else rows, "page_id long, url string, html string").repartition(3)


def read_back(spark, table, size=warc.SPLIT_BYTES, least=0):
    return warc.page_rows(warc.read_archives(warc.splits(warc.write_archives(table, least=least), size))).collect()


@pytest.mark.parametrize("size", [40, 1000, 8 << 20])
def test_any_split_gives_every_record_once(spark, size):
    rows = read_back(spark, pages(spark), size)
    assert len(rows) == len(PAGES)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.page_id, []).append(r)
    for page, url, html in PAGES:
        payload = (html or "").encode()
        for r in by_id[page]:
            assert r.payload_bytes == len(payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert r.url == (url or "")
            assert r.payload is None if r.record_type == "revisit" else r.payload == payload
    assert {p: [(r.record_type, r.refers_to) for r in rs] for p, rs in by_id.items() if p in (1, 2, 3, 4, 5, 7)} == {
        1: [("response", None)], 2: [("response", None)], 3: [("revisit", 1)], 4: [("response", None)],
        5: [("revisit", 2)], 7: [("revisit", 1), ("revisit", 1)],
    }


def test_small_payloads_can_stay_responses(spark):
    rows = {r.page_id: r for r in read_back(spark, pages(spark), least=1)}
    assert rows[5].record_type == "response" and rows[3].record_type == "revisit"


def test_empty_table(spark):
    assert read_back(spark, pages(spark, [])) == []


def test_equal_ids_and_extra_columns(spark):
    table = pages(spark, [(1, "a", "x"), (1, "b", "x"), (1, "a", "y")]).selectExpr("*", "'k' as key", "1 as size", "2 as id")
    assert sorted((r.page_id, r.record_type) for r in read_back(spark, table)) == [(1, "response")] * 3


def archive(seed, n=60):
    rnd = random.Random(seed)
    parts, starts = [], []
    for i in range(n):
        noise = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 10, 500])))
        block = rnd.choice([b"", b"a" * rnd.randrange(5000), noise, b"\x1f\x8b\x08 not a member", zlib.compress(b"x") * 3])
        starts.append(sum(map(len, parts)))
        parts.append(warc.record({"WARC-Type": "response", "N": str(i)}, block))
    return b"".join(parts), starts


@pytest.mark.parametrize("seed", range(5))
def test_ranges_own_the_records_that_begin_in_them(seed, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 777)
    raw, starts = archive(seed)
    rnd = random.Random(seed)
    cuts = sorted({0, len(raw), *(rnd.randrange(len(raw)) for _ in range(25)), *starts[::7]})
    found = []
    for begin, end in zip(cuts, cuts[1:]):
        mine = [(at, int(h["n"])) for at, h, _ in warc.owned_records(io.BytesIO(raw), begin, end)]
        assert all(begin <= at < end for at, _ in mine)
        found += mine
    assert found == [(at, i) for i, at in enumerate(starts)]


def test_members_that_are_no_records_are_passed_over():
    import gzip

    good = warc.record({"N": "1"}, b"block")
    raw = b"junk" + gzip.compress(b"no record") + warc.MAGIC + b"zzz" + good + good[: len(good) // 2]
    found = list(warc.owned_records(io.BytesIO(raw), 0, len(raw)))
    assert [(h["n"], b) for _, h, b in found] == [("1", b"block")]


def test_damage_is_seen(spark):
    bad = warc.record({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:AAAA", "WARC-Record-ID": "<urn:page:1>",
                       "WARC-Target-URI": "u"}, b"block")
    _, headers, block = next(warc.owned_records(io.BytesIO(bad), 0, len(bad)))
    with pytest.raises(ValueError, match="damaged"):
        warc._page_row(headers, block)
