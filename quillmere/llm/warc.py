"""WARC archives of pages, and the merged index of their captures.

``write_archive`` turns rows into records: of captures with equal payloads of
at least ``LEAST_REVISIT`` bytes the one with the smallest id is a response, the
others are revisits that refer to it.  Every record is a gzip member of its
own, so a reader can start at any offset of the index.

``merged_index`` reads the archives back.  Each file gives a run of captures
sorted by URL key and time.  Runs are cut at common range bounds, and each
range is merged by a loser tree over its runs: the ranges in turn are the
capture history of all URLs in one order.

Defined cases: a null payload is empty; a null url becomes ``urn:page:<id>``;
white space and control characters in a url are escaped; rows with the id of
the response and its payload are all responses; rows with a null id revisit the
smallest id if there is one; an empty table makes an empty archive and an empty
index; other columns are not read.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmere.llm.words import pieces
from quillmere.session import written

LEAST_REVISIT = 100  # bytes of payload
FILE_RECORDS = 2000
FILE_BYTES = 1 << 30  # of an archive file, which is read back as one value: below 2 GB
RECORD_BYTES = 8 << 10  # of a record besides its payload, more than its headers take
RANGE_ROWS = 250_000  # index rows merged by one task
FIRST_CAPTURE = "2020-01-01 00:00:00"  # of pages without a time: this plus the id in seconds
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
_ENDING = b"\r\n\r\n"


def default_time() -> Column:
    shift = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9))
    return F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_CAPTURE)) + shift)


def captures(pages: DataFrame, time: Column | None = None) -> DataFrame:
    """page_id, url, payload, time, digest, bytes, refers_to (null for responses)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
        (default_time() if time is None else time).cast("timestamp").alias("time"),
    ).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    narrow = written(rows.select("page_id", "digest", "bytes"), "page-digests")
    large = narrow.filter(F.col("bytes") >= LEAST_REVISIT)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n"))
    first = groups.filter(F.col("_n") > 1).drop("_n")
    again = large.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = again.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d"))
    return rows.join(again, same, "left").drop("_p", "_d")


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _target(url: str | None, page_id: int | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"


def record(page_id, url, payload: bytes, time: dt.datetime, digest: str, refers_to) -> bytes:
    """A record as one gzip member."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", time.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", _target(url, page_id)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is None:
        body += payload
    else:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page", refers_to)]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    made = gzip.compress(text.encode() + body + _ENDING, 6, mtime=0)
    # The writer ends each value with a zero byte.  A member ends with the high
    # byte of its size, which is zero below 16 MB; above, an empty member follows.
    return (made if made[-1] == 0 else made + gzip.compress(b"", mtime=0))[:-1]


def records_of_a_file(pages: DataFrame, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> int:
    """So many that even the largest pages fill no file beyond ``file_bytes``;
    a page that is larger has a file of its own."""
    html, url = (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ("html", "url"))
    largest = pages.agg(F.max(html + 3 * url)).first()[0] or 0
    largest += largest // 1000 + RECORD_BYTES  # what compression may add
    return max(1, min(file_records, file_bytes // largest))


def write_archive(
    pages: DataFrame, path: str, time: Column | None = None, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES
) -> None:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "payload"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "time", "digest", "refers_to")))
            yield pa.RecordBatch.from_arrays([pa.array([record(*r) for r in rows], pa.binary())], names=["record"])

    rows = captures(pages, time).mapInArrow(records, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option(
        "maxRecordsPerFile", records_of_a_file(pages, file_records, file_bytes)
    ).text(path)


def members(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member that is not empty."""
    at = 0
    while at < len(data):
        reader, first, out = zlib.decompressobj(31), at, []
        while not reader.eof:
            part = data[at : at + (1 << 16)]
            if not len(part):
                raise ValueError("an archive ends within a record")
            out.append(reader.decompress(part))
            at += len(part) - len(reader.unused_data)
        content = b"".join(out)
        if content:
            yield first, at - first, content


def parse(content: bytes) -> dict:
    """What the index holds of a record; a response's payload is measured, a
    revisit's is as its headers say."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    body = rest[: int(headers["content-length"])]
    if not lines[0].startswith("WARC/") or rest[len(body) :] != _ENDING:
        raise ValueError("not a whole record")
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    size = int(headers["x-payload-length"])
    if headers["warc-type"] == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload does not match its digest")
    return {
        "url_key": url_key(headers["warc-target-uri"]),
        "time": headers["warc-date"],
        "page_id": int(headers["x-page-id"]) if headers["x-page-id"] else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": headers["warc-type"],
        "refers_to": int(headers["x-refers-to-page"]) if "x-refers-to-page" in headers else None,
    }


def url_key(url: str) -> str:
    """The host's labels from the right, then the path: pages of a site are
    neighbours in the index."""
    try:
        parts = urlsplit(url.lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    tail = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(labels)) + tail + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


class LoserTree:
    """The smallest head of several sorted runs: each inner node keeps the run
    that lost there, so a new head meets one opponent a level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), max(1, len(runs))
        self.losers = [-1] * k
        for r in range(len(runs)):
            self._play(r)

    def _head(self, r: int):
        return self.runs[r][self.at[r]] if self.at[r] < len(self.runs[r]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, r: int) -> None:
        node = (r + len(self.losers)) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its opponent
                self.losers[node] = r
                return
            if self._beats(other, r):
                self.losers[node], r = r, other
            node //= 2
        self.losers[0] = r

    def __iter__(self) -> Iterator:
        while self.runs:
            winner = self.losers[0]
            head = self._head(winner)
            if head is None:
                return
            yield head
            self.at[winner] += 1
            self._play(winner)


INDEX = (
    "url_key string, time string, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, file string, offset long, length long"
)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archive files, each file's sorted."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [
                    parse(text) | {"file": file, "offset": at, "length": size}
                    for at, size, text in members(memoryview(content.as_buffer()))
                ]
                rows.sort(key=lambda r: (r["url_key"], r["time"], r["page_id"] is not None, r["page_id"] or 0))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    text, number = pa.string(), pa.int64()
    schema = pa.schema([(f.split()[0], number if f.endswith("long") else text) for f in INDEX.split(", ")])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(runs, INDEX)


def merged_index(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures, with their ``position`` in the order of URL key, time and id."""
    runs = written(capture_runs(spark, path), "capture-runs")
    ranges = max(1, -(-runs.count() // range_rows))
    key = ["url_key", "time", "page_id"]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        files = rows.column("file").to_pylist()
        heads = list(zip(
            rows.column("url_key").to_pylist(), rows.column("time").to_pylist(),
            [(p is not None, p or 0) for p in rows.column("page_id").to_pylist()], range(len(files)),
        ))
        bounds = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
        order = [head[-1] for head in LoserTree([heads[a:b] for a, b in zip(bounds, bounds[1:])])]
        first = TaskContext.get().partitionId() << 40
        out = rows.take(pa.array(order)).append_column("position", pa.array(first + np.arange(len(order))))
        yield from out.to_batches()

    dealt = runs.repartitionByRange(ranges, *key).sortWithinPartitions("file", *key, "offset")
    return dealt.mapInArrow(merged, INDEX + ", position long")


def archive_and_index(pages: DataFrame, path: str) -> DataFrame:
    write_archive(pages, path)
    return merged_index(pages.sparkSession, path)


def write_index(index: DataFrame, path: str) -> None:
    """The index as text lines: key, 14-digit time and the rest as JSON."""
    digits = F.regexp_replace("time", "[^0-9]", "")
    rest = F.to_json(F.struct("page_id", "payload_digest", "record_type", "refers_to", "file", "offset", "length"))
    line = F.concat_ws(" ", "url_key", digits, rest)
    index.repartitionByRange("position").sortWithinPartitions("position").select(line.alias("value")).write.text(path)
