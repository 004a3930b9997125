"""WARC archives: a writer, and a reader that splits them by byte ranges.

Each record is a gzip member of its own. A reading task gets a byte range of an
archive. It looks for gzip magic in it, takes a place for a member only if the
bytes there decompress to the header of a WARC record, and owns the records
that begin inside its range, also where they end beyond it. From one record
the next begins where its member ends; after bytes that are no member the task
looks for magic again.

Defined results: a missing or empty payload is a record of 0 bytes; like any
other payloads, equal ones are one response and revisits. Rows with equal ids
are records each; the first by id, then by row, is the response. A record
without id is written without one and read back as missing. An empty table
makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.settle import new_path, settle
from .files import opened, publish

MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 64 << 20  # an archive ends with the record that reaches so many
SPLIT_BYTES = 8 << 20  # a reading task's byte range
READ_BYTES = 1 << 20
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(header: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member, the same bytes whenever it is made."""
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in header.items()]
    lines.append(f"Content-Length: {len(block)}".encode())
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def with_first(pages: DataFrame, page_id: str, payload: str, least: int) -> DataFrame:
    """``pages`` (id, url, payload) and ``refers_to``, the smallest id with an equal payload, where it is smaller.

    Only payloads that occur more than once are joined back. The smallest ids
    are found by a sum before the shuffle, so a payload that fills a third of
    the table is one row of each task there; the join is left to Spark, which
    splits large partitions.
    """
    content = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col("url"), content.alias("payload"))
    keyed = rows.withColumn("key", F.sha2("payload", 256))
    first = (
        keyed.where(F.octet_length("payload") >= least)
        .groupBy("key").agg(F.min("id").alias("refers_to"), F.max("id").alias("last"))
        .where("refers_to < last").drop("last")
    )
    first = settle(first)
    joined = keyed.join(first, "key", "left")
    return joined.withColumn("refers_to", F.when(F.col("id") > F.col("refers_to"), F.col("refers_to"))).drop("key")


def write_archives(pages: DataFrame, page_id: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """Write a record per row and return the manifest: file, size. Payloads of at least
    ``least`` bytes that an earlier row has too become revisits."""
    folder = new_path(pages.sparkSession)

    def run(batches):
        for number, (count, data) in enumerate(_archives(batches)):
            name = f"part-{TaskContext.get().partitionId():08d}-{number:06d}.warc.gz"
            publish(folder, name, lambda stream: [stream.write(d) for d in data])
            sizes = [[f"{folder}/{name}"], [sum(map(len, data))], [count]]
            yield pa.record_batch(
                [pa.array(sizes[0]), pa.array(sizes[1], pa.int64()), pa.array(sizes[2], pa.int64())],
                names=["file", "size", "records"],
            )

    marked = with_first(pages, page_id, payload, least).select("id", "url", "payload", "refers_to")
    return settle(marked.mapInArrow(run, "file string, size long, records long"))


def _archives(batches):
    """(records, their bytes) of one archive after the other."""
    data, held = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            data.append(_page_record(*row))
            held += len(data[-1])
            if held >= ARCHIVE_BYTES:
                yield len(data), data
                data, held = [], 0
    if data:
        yield len(data), data


def _page_record(page, url, payload, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    header = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
        "WARC-Date": DATE.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": quote(url or "", safe=":/?&=#%+,;@!$'()*[]~"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is None:
        return record(header | {"Content-Type": "text/html"}, payload)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return record(header | {"WARC-Profile": profile, "WARC-Refers-To": f"<urn:page:{refers_to}>"}, b"")


def splits(manifest: DataFrame, size: int = SPLIT_BYTES) -> DataFrame:
    """(file, start, end): byte ranges that cover each file."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long"))
    ranges = manifest.select("file", "size", F.explode(starts).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("start") + size, F.col("size")).alias("end"))
    # the rows are few and small, the ranges are not: a fixed number of tasks, which Spark does not merge
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "file", "start")


def read_archives(ranges: DataFrame) -> DataFrame:
    """One row per record: where it begins, its headers by lower-case name, its block."""

    def run(batches):
        for batch in batches:
            for file, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = opened(file)
                with system.open_input_file(place) as source:
                    yield from _record_batches(file, owned_records(source, start, end))

    return ranges.mapInArrow(run, "file string, offset long, headers map<string,string>, block binary")


def _record_batches(file, records, most=8 << 20):
    rows, held = [], 0

    def made():
        offsets, headers, blocks = zip(*rows)
        return pa.record_batch(
            [
                pa.array([file] * len(rows)), pa.array(offsets, pa.int64()),
                pa.array([list(h.items()) for h in headers], pa.map_(pa.string(), pa.string())),
                pa.array(blocks, pa.binary()),
            ],
            names=["file", "offset", "headers", "block"],
        )

    for row in records:
        rows.append(row)
        held += len(row[2])
        if held >= most:
            yield made()
            rows, held = [], 0
    if rows:
        yield made()


def owned_records(source, start: int, end: int):
    """(offset, headers, block) of the records that begin in [start, end) of a file."""
    window = _Window(source)
    at = start
    while (at := window.find(MAGIC, at, end)) is not None:
        found = _member(window, at)
        if found is None:
            at += 1
            continue
        raw, after = found
        headers, block = parse(raw)
        yield at, headers, block
        at = after


class _Window:
    """Bytes of a file around the place that is read; what lies behind is let go."""

    def __init__(self, source):
        self.source, self.base, self.data = source, 0, b""

    def get(self, at: int, size: int) -> bytes:
        if not self.base <= at < self.base + len(self.data):
            self.source.seek(at)
            self.base, self.data = at, self.source.read(max(size, READ_BYTES))
        elif at + size > self.base + len(self.data):
            kept = self.data[at - self.base :]
            self.source.seek(at + len(kept))
            self.base, self.data = at, kept + self.source.read(max(size - len(kept), READ_BYTES))
        return self.data[at - self.base : at - self.base + size]

    def find(self, what: bytes, at: int, end: int) -> int | None:
        """First place in [at, end) where ``what`` begins; it may reach beyond."""
        while at < end:
            part = self.get(at, min(READ_BYTES, end - at) + len(what) - 1)
            found = part.find(what)
            if 0 <= found < end - at:
                return at + found
            if len(part) < len(what):
                return None
            at += len(part) - len(what) + 1
        return None


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``at`` if it holds a WARC record."""
    unpack, out, place, seen = zlib.decompressobj(31), [], at, False
    while not unpack.eof:
        part = window.get(place, 1 << 16)
        if not part:
            return None
        try:
            out.append(unpack.decompress(part))
        except zlib.error:
            return None
        place += len(part)
        if not seen and (head := b"".join(out)[:5]):
            if not b"WARC/".startswith(head[:5]) and head[:5] != b"WARC/":
                return None
            seen = len(head) == 5
    return (b"".join(out), place - len(unpack.unused_data)) if seen else None


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, of a record's bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, rest[: int(headers.get("content-length", len(rest)))]


def page_rows(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url and the payload
    (missing for a revisit). A response's digest and size are those of its block as it was read."""
    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "url string, payload binary"
    )

    def run(batches):
        for batch in batches:
            rows = [
                _page_row(dict(h), b) for h, b in zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist())
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_PAGE)

    return records.mapInArrow(run, schema)


_PAGE = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
])


def _number(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _page_row(headers, block) -> dict:
    response = headers["warc-type"] == "response"
    claimed = headers["warc-payload-digest"].removeprefix("sha1:")
    if response and digest(block) != claimed:
        raise ValueError(f"damaged record {headers['warc-record-id']}")
    return {
        "page_id": _number(headers["warc-record-id"]),
        "payload_bytes": len(block) if response else int(headers["x-payload-length"]),
        "payload_digest": claimed,
        "record_type": headers["warc-type"],
        "refers_to": _number(headers.get("warc-refers-to")),
        "url": unquote(headers["warc-target-uri"]),
        "payload": block if response else None,
    }
