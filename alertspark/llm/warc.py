"""WARC archives of captured pages, and the merge of their index runs.

Writing: each task streams its pages as gzip members into WARC files of its own
under a shared folder and returns index rows, in runs sorted by URL key and
time. The index rows that Spark commits name the files that count: what a lost
or repeated attempt wrote is never listed.

Merging: the runs are dealt into ranges of (URL key, time, id), so a URL with
very many captures is spread over several ranges. Within a range the runs'
shares, still sorted, go through a k-way loser tree. Ranges in order, rows in
order, are the capture history.

Reading: the listed files are cut at records into ranges of some megabytes,
which are dealt out to as many tasks and read record by record; a revisit gets
its payload's length from the response that it refers to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertspark.llm.common import Scratch, slices
from alertspark.session import shared_path

RUN_ROWS = 50_000
FILE_BYTES = 1 << 28
#: Bytes of archive that one task reads back, up to the record that crosses them.
READ_BYTES = 1 << 25
_LEVEL = 4
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "urlkey string, ts string, id long, file string, offset long, length long, record_type string, payload_digest string, refers_to long"
_INDEX_ARROW = pa.schema(
    [("urlkey", pa.string()), ("ts", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then the path and the sorted query; no scheme, www., port or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url if "://" in url else f"http://{url}")
        host = (u.hostname or "").lower()
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return f"{','.join(reversed(host.split('.')))}){u.path.lower() or '/'}{'?' + query if query else ''}"


def _record_id(i: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i}/{digest}')}>"


def warc_record(i: int | None, url: str | None, date: str, payload: bytes, record_type: str, refers_to: int | None) -> tuple[bytes, str]:
    """(the record as one gzip member, the payload's digest)."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if record_type == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_record_id(i, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if record_type == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Source-Id: {refers_to}"]
    if i is not None:
        head.append(f"X-Source-Id: {i}")
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, _LEVEL, mtime=0), digest


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Write captures (id, url, ts, payload, record_type, refers_to) as WARC files; the result is their index, in sorted runs.

    ``folder`` must be one that all executors share. The rows must be committed
    (written) before the files are used.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, name, offset, held, n_files = None, "", 0, [], 0

        def flush():
            held.sort(key=_order)
            made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _INDEX_ARROW)], schema=_INDEX_ARROW)
            held.clear()
            return made

        try:
            for batch in (s for b in batches for s in slices(b, 64)):
                for i, url, ts, text, kind, refers in zip(*(batch.column(c).to_pylist() for c in range(6))):
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n_files}-{uuid.uuid4().hex[:8]}.warc.gz"
                        out, offset, n_files = fs.open_output_stream(f"{root}/{name}", compression=None), 0, n_files + 1
                    date = f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:14]}Z"
                    member, digest = warc_record(i, url, date, text.encode(), kind, refers)
                    out.write(member)
                    held.append((url_key(url), ts, i, name, offset, len(member), kind, digest, refers))
                    offset += len(member)
                    if len(held) >= RUN_ROWS:
                        yield flush()
        finally:
            if out is not None:
                out.close()
        if held:
            yield flush()

    return captures.select("id", "url", "ts", "payload", "record_type", "refers_to").mapInArrow(run, INDEX)


def _order(row: tuple) -> tuple:
    """URL key, time, id (null first), then the place in the archives."""
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4])


class LoserTree:
    """K-way merge: a tournament tree whose inner nodes keep the losers, so each step replays one path only."""

    def __init__(self, runs: list[Iterable], key):
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.head: list = [None] * len(runs)
        self.rank: list = [None] * len(runs)  # None: the run is over
        for i in range(len(runs)):
            self._next(i)
        self.losers = [-1] * max(len(runs), 1)
        for i in range(len(runs)):
            self._replay(i, fresh=True)

    def _next(self, i: int) -> None:
        self.head[i] = next(self.runs[i], None)
        self.rank[i] = None if self.head[i] is None else self.key(self.head[i])

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.rank[a], self.rank[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def _replay(self, i: int, fresh: bool = False) -> None:
        node = (i + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if other < 0 and fresh:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.runs:
            i = self.losers[0]
            if self.rank[i] is None:
                return
            yield self.head[i]
            self._next(i)
            self._replay(i)


def merge_index(index: DataFrame) -> DataFrame:
    """The index rows in global order of URL key, time and id: rows carry ``part`` and ``pos``, their place in the order.

    Equal keys are told apart by file and offset, so repeated captures stay and
    have a defined order. Null ids come first among equals.
    """
    ranges = index.repartitionByRange("urlkey", "ts", "id", "file", "offset")

    def run(batches):
        part = TaskContext.get().partitionId()
        runs: list[list[tuple]] = []
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = _order(row)
                if last is None or key < last:  # the next run's share begins
                    runs.append([])
                runs[-1].append(row)
                last = key
        merged, pos = [], 0
        for row in LoserTree(runs, _order):
            merged.append((*row, part, pos))
            pos += 1
            if len(merged) == 8192:
                yield _history_batch(merged)
                merged = []
        if merged:
            yield _history_batch(merged)

    return ranges.mapInArrow(run, INDEX + ", part int, pos long")


def _history_batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [*_INDEX_ARROW, pa.field("part", pa.int32()), pa.field("pos", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))


def read_members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The records of a WARC file, one gzip member at a time."""
    data = stream.read(size)
    while data:
        unzip = zlib.decompressobj(31)
        parts = []
        while not unzip.eof:
            if not data:
                raise ValueError("the archive ends inside a record")
            parts.append(unzip.decompress(data))
            data = unzip.unused_data if unzip.eof else stream.read(size)
        yield b"".join(parts)
        if not data:
            data = stream.read(size)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block)."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, raw[end + 4 : end + 4 + int(fields["Content-Length"])]


class _Range:
    """The bytes ``start`` to ``end`` of an open file, as a stream."""

    def __init__(self, file, start: int, end: int):
        self.file, self.left = file, end - start
        file.seek(start)

    def read(self, size: int) -> bytes:
        data = self.file.read(min(size, self.left)) if self.left else b""
        if self.left and not data:
            raise ValueError("the archive ends before its last record")
        self.left -= len(data)
        return data


def record_ranges(index: DataFrame) -> DataFrame:
    """(file, start, end) of whole records that follow each other, READ_BYTES or a little more; records of an index don't overlap."""
    piece = F.floor(F.col("offset") / READ_BYTES)
    return index.groupBy("file", piece.alias("piece")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end")).select("file", "start", "end")


def read_archives(ranges: DataFrame, folder: str) -> DataFrame:
    """Records in the ``ranges`` (file, start, end) of the archives: id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are those of the payload that was read; for a revisit,
    which has none, the digest is the stated one and the length null.
    """
    arrow = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for name, start, end in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))):
            rows = []
            with fs.open_input_file(f"{root}/{name}") as file:
                for raw in read_members(_Range(file, start, end)):
                    f, block = parse_record(raw)
                    i, kind = f.get("X-Source-Id"), f["WARC-Type"]
                    digest, size, refers = f["WARC-Payload-Digest"].removeprefix("sha1:"), None, None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest:
                            raise ValueError(f"{name}: the payload of record {i} doesn't have its digest")
                        size = len(payload)
                    else:
                        refers = int(f["X-Refers-To-Source-Id"])
                    rows.append((None if i is None else int(i), f.get("WARC-Target-URI"), size, digest, kind, refers))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    # a stated number of partitions: adaptive execution would put the few narrow rows into one task
    dealt = ranges.select("file", "start", "end").repartition(max(1, ranges.count()))
    return dealt.mapInArrow(run, "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def captures_of(pages: DataFrame, id_col: str, url_col: str, html_col: str, ts: F.Column, scratch: Scratch) -> DataFrame:
    """Rows for ``write_archives``: of equal payloads, the smallest id is the response and the others revisit it."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.date_format(ts, "yyyyMMddHHmmss"), F.lit("19700101000000")).alias("ts"), F.coalesce(html_col, F.lit("")).alias("payload"))
    rows = rows.withColumns({"d": F.sha1(F.col("payload").cast("binary")), "n": F.octet_length("payload")})
    several = rows.groupBy("d", "n").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter("size > 1 and first is not null").select("d", "n", "first")
    rows = rows.join(scratch.keep(several, "several"), ["d", "n"], "left")
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    return rows.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first"))})


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts: F.Column | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Write the pages' archives and merge their index: (capture history, index as written, folder of the archives).

    One record per row. ``ts`` is the capture time (default, and where null: the
    epoch). Null html is an empty payload, a null URL has no target field and the
    key ''. A null id is written without one; it is a response unless a record
    with an id has the same payload. Repeated rows are records of their own; of
    several rows with the response's id all are responses.
    """
    scratch = Scratch(pages.sparkSession)
    folder = shared_path(pages.sparkSession, "warc")
    captures = captures_of(pages, id_col, url_col, html_col, F.lit(None).cast("timestamp") if ts is None else ts, scratch)
    index = scratch.keep(write_archives(captures, folder), "runs")
    return scratch.keep(merge_index(index), "history"), index, folder


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts: F.Column | None = None) -> DataFrame:
    """Archive the pages and read the archives back.

    One row per record: id, payload_bytes, payload_digest (base32 SHA-1, of the
    full payload), record_type, refers_to, url. See ``archive`` for nulls.
    """
    scratch = Scratch(pages.sparkSession)
    history, _, folder = archive(pages, id_col, url_col, html_col, ts)
    ranges = scratch.keep(record_ranges(history), "ranges")
    read = scratch.keep(read_archives(ranges, folder), "records")
    first = read.filter("record_type = 'response' and id is not null").groupBy(F.col("id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
    first = scratch.keep(first, "responses")
    rows = read.join(first, ["refers_to", "payload_digest"], "left")
    out = rows.select(F.col("id").alias(id_col), F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.col("url").alias(url_col))
    return out
