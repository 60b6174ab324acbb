"""Web archives: pages as WARC records in gzip members, read back through a globally ordered index of captures.

Writing: equal payloads are found by their SHA-256; the one with the smallest page number is a response, the others revisits
that refer to it and hold HTTP headers only. A record is one gzip member, so it can be read by itself. Spark's text
writer puts the members into files, with its commits and on any store: a member ends with the high byte of its length,
which is zero below 16 MiB, and just that byte is the writer's line separator.

Reading: each archive is parsed in one task, digests are checked, and its captures leave as a run sorted by URL key and
time. Runs are dealt into ranges of (URL key, time, page, place), so one URL's history can span ranges. A range finds the runs
in what it has got and merges them in a loser tree: each step replays one path of the tree, log2(k) comparisons.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.textbatch import release, slices
from patchloom.sources.saved import saved, shared_folder

#: Records in an archive at most, captures in a range of the index on average, and zlib's level.
ARCHIVE_RECORDS, RANGE_ROWS, LEVEL = 8192, 200_000, 4
#: Bytes that are given to zlib at once when an archive is read.
READ_BYTES = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY_MEMBER = zlib.compress(b"", wbits=31)
_CAPTURES = "url_key string, captured long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long, record_length long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def header_uri(url: str | None) -> str:
    """A URL fit for a header line: spaces, controls and non-ASCII characters percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then the path: ``com,example,m)/en/1?q=2``. Scheme, user, default port and fragment don't count."""
    found = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url or "")
    if not found:
        return (url or "").partition("#")[0]
    scheme, host, port, rest = found.groups()
    default = {"http": "80", "https": "443"}.get((scheme or "").lower(), "")
    return ",".join(reversed(host.lower().split("."))) + (f":{port}" if port and port != default else "") + ")" + (rest if rest.startswith("/") else f"/{rest}")


def _date(seconds: int) -> str:
    """Seconds since 1970 as an ISO date; calendar rules as in the proleptic Gregorian calendar, for any year from 0 to 9999."""
    days, second = divmod(seconds, 86400)
    days += 719468
    era, day = divmod(days, 146097)
    year = (day - day // 1460 + day // 36524 - day // 146096) // 365
    day -= 365 * year + year // 4 - year // 100
    month = (5 * day + 2) // 153
    day, month = day - (153 * month + 2) // 5 + 1, month + 3 if month < 10 else month - 9
    return f"{year + 400 * era + (month <= 2):04d}-{month:02d}-{day:02d}T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"


def _seconds(date: str) -> int:
    year, month, day, hour, minute, second = map(int, re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)Z", date).groups())
    year -= month <= 2
    era, of_era = divmod(year, 400)
    of_year = (153 * (month - 3 if month > 2 else month + 9) + 2) // 5 + day - 1
    return (era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719468) * 86400 + hour * 3600 + minute * 60 + second


def _named(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _number(name: str) -> int | None:
    inside = name.removeprefix("<urn:page:").removesuffix(">")
    return int(inside) if inside else None


def record_of(page: int | None, url: str | None, captured: int, payload: bytes, revisits: int | None, is_revisit: bool) -> bytes:
    """One WARC record, not compressed. A revisit's HTTP headers state the length of the payload that it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_named(page)}", f"WARC-Date: {_date(captured)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_named(revisits)}", "WARC-Truncated: length"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member_of(record: bytes) -> bytes:
    """The record as a gzip member that ends with a zero byte; a longer one is followed by an empty member, which does."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def records_in(content: memoryview | bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and bytes of each record of an archive; an empty member belongs to the record before it."""
    view, at, held = memoryview(content), 0, None
    while at < len(view):
        unpack, begin, out = zlib.decompressobj(31), at, []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            out.append(unpack.decompress(view[at : at + READ_BYTES]))
            at += min(READ_BYTES, len(view) - at)
        at -= len(unpack.unused_data)
        record = b"".join(out)
        if not record and held:
            held = (held[0], at - held[0], held[2])
            continue
        if held:
            yield held
        held = (begin, at - begin, record)
    if held:
        yield held


def capture_of(record: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in lower case), payload, and the payload's stated length; a record that is not whole or not true to its digest is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("ascii").split("\r\n")
    fields = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    stated = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
    if fields["warc-type"] == "response" and (len(payload) != stated or fields["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}"):
        raise ValueError(f"{fields['warc-record-id']} is not true to its digest")
    return fields, payload, stated


def write_archives(pages: DataFrame, folder: str, captured: Column | None = None, min_bytes: int = 0) -> None:
    """Writes every row of ``pages`` (page_id, url, html) as a record of an archive below ``folder``.

    Of equal payloads of ``min_bytes`` and more the rows with the smallest page_id are responses, the rest revisits; those
    without any page_id in their group are responses, as nothing could name one. A null html is empty. ``captured`` is a
    column of whole seconds since 1970 (null: 0), page_id where it isn't given. Equal payloads meet in a join that can be
    split; only hashes and page numbers are grouped.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    at = F.least(F.greatest(F.coalesce((F.col("page_id") if captured is None else captured).cast("long"), F.lit(0)), F.lit(0)), F.lit(253402300799))
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), payload.alias("text"), at.alias("at"), F.unhex(F.sha2(payload, 256)).alias("same"))
    first = rows.filter(F.octet_length("text") >= min_bytes).groupBy("same").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for page, url, text, at, first in zip(*[part.column(c).to_pylist() for c in ("page", "url", "text", "at", "first")], strict=True):
                    again = first is not None and page != first
                    out.append(member_of(record_of(page, url, at, text.encode(), first, again))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
        release()

    members = rows.join(first, "same", "left").select("page", "url", "text", "at", "first").mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(folder)


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url (as the archive has it), captured, record_type, refers_to, payload of every record; a revisit's payload is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for _, _, record in records_in(content.as_buffer()):
                    fields, payload, _ = capture_of(record)
                    kind, refers = fields["warc-type"], fields.get("warc-refers-to")
                    row = (_number(fields["warc-record-id"]), fields.get("warc-target-uri"), _seconds(fields["warc-date"]), kind, refers and _number(refers), payload if kind == "response" else None)
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["page_id", "url", "captured", "record_type", "refers_to", "payload"])

    return _archives(spark, folder).mapInArrow(run, "page_id long, url string, captured long, record_type string, refers_to long, payload binary")


def _sort_key(key: str, captured: int, page: int | None, archive: str, offset: int) -> bytes:
    """Bytes that compare as (URL key, time, page, archive, offset), a missing page last."""
    number = b"\1" if page is None else b"\0" + struct.pack(">Q", page + (1 << 63))
    return key.encode() + b"\0" + struct.pack(">Q", captured + (1 << 63)) + number + archive.encode() + b"\0" + struct.pack(">Q", offset)


def capture_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of each archive, one run after the other, each sorted by URL key and time."""
    schema = pa.schema([(f.split()[0], pa.string() if f.split()[1] == "string" else pa.int64()) for f in _CAPTURES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name, found = path.rpartition("/")[2], []
                for offset, length, record in records_in(content.as_buffer()):
                    fields, _, stated = capture_of(record)
                    refers = fields.get("warc-refers-to")
                    found.append((url_key(fields.get("warc-target-uri")), _seconds(fields["warc-date"]), _number(fields["warc-record-id"]), stated, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], refers and _number(refers), name, offset, length))
                found.sort(key=lambda x: _sort_key(x[0], x[1], x[2], x[7], x[8]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
        release()

    return _archives(spark, folder).mapInArrow(run, _CAPTURES)


class LoserTree:
    """Merges sorted sequences: inner nodes hold the loser of the match between their subtrees, the winner stands above the root."""

    def __init__(self, runs: Sequence[Sequence[bytes]]):
        self.runs, self.place, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(len(runs))) + [-1] * (self.k - len(runs))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else winners[self.k]

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or self.place[a] >= len(self.runs[a]):
            return False
        if b < 0 or self.place[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.place[a]], self.runs[b][self.place[b]]
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """The number of the run and the place in it of each entry, in order."""
        while self.winner >= 0 and self.place[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield run, self.place[run]
            self.place[run] += 1
            node, best = (run + self.k) // 2, run
            while node:
                if self._before(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.winner = best


def sorted_runs(keys: list[bytes]) -> list[list[bytes]]:
    """``keys`` cut wherever one is smaller than the one before it."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    return [keys[a:b] for a, b in itertools.pairwise(cuts) if a < b]


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs with ``range_no`` and ``place``: by these two they are in the order of (URL key, time, page, archive, offset).

    Ranges are bounds on that whole order, so neither a URL with very many captures nor repeated pages make one large. A range's
    rows are held as Arrow columns, their keys as bytes. It relies on no order of arrival: what comes is cut into ascending runs.
    """
    n = max(1, -(-runs.count() // range_rows), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.repartitionByRange(n, "url_key", "captured", F.col("page_id").asc_nulls_last(), "archive", "record_offset")
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [_sort_key(*row) for row in zip(*[table.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "archive", "record_offset")], strict=True)]
        parts = sorted_runs(keys)
        begins = [0, *itertools.accumulate(map(len, parts))]
        order = pa.array([begins[r] + i for r, i in LoserTree(parts)], pa.int64())
        merged = table.take(order)
        merged = merged.append_column("range_no", pa.array([TaskContext.get().partitionId()] * len(merged), pa.int32())).append_column("place", pa.array(range(len(merged)), pa.int64()))
        yield from merged.to_batches(max_chunksize=1 << 14)
        release()

    return dealt.select(*names).mapInArrow(run, f"{_CAPTURES}, range_no int, place long")


def archived_pages(pages: DataFrame, captured: Column | None = None, min_bytes: int = 0) -> DataFrame:
    """``pages`` written as archives in the shared folder, read back, and their captures in global order, with the columns of ``merge_runs``.

    A null page_id has no number in the archive and none here; a null url has the empty key. Repeated rows are records of
    their own. An empty table gives archives without a record and no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder, captured, min_bytes)
    return merge_runs(saved(capture_runs(spark, folder), "runs", 1))
