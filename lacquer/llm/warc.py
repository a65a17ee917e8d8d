"""WARC archives with a two-level capture index.

Pages are written as WARC records, each a gzip member of its own; a payload that another page carries
too is written once and revisited by the others. The capture index sorts the records by reversed-host
URL keys into compressed blocks; a sparse directory beside each index file has the first key of every
block. A look-up finds the index file by the files' first keys, the block by binary search in the
directory, and the line by binary search in the block; then the record is read by its byte range.

Files are written by the tasks to a folder that all executors share, by any scheme that pyarrow.fs
knows (file, hdfs, s3, gs). What a task wrote is named in rows that Spark commits, so a task that runs
again leaves at most a file that nothing names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups_for, scratch_path, slices, stage, table

#: Lines in a block of the index, and rows in an index file; there are never more than MOST_FILES of these.
BLOCK_LINES = 3000
FILE_ROWS = 200_000
MOST_FILES = 10_000
LEVEL = 4
#: Bytes of archives that a task reads back, and keys that a task looks up.
TASK_BYTES, TASK_KEYS = 4_000_000, 20_000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "key string, page_id long, file string, offset long, length long, digest string"
ID_SHIFT = 1 << 63


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: scheme, www., port 80 or 443 and fragment dropped, lower case but for the query."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "://" in text else "//" + text)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return quote(text.lower(), safe="/:?&=%,)(")
    head = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return quote(f"{head}){(parts.path or '/').lower()}{'?' + parts.query if parts.query else ''}", safe="/:?&=%,)(")


def capture_key(url: str | None, page_id: int | None) -> str:
    """The sort key of a record: URL key, then page_id in digits that sort as numbers; a null one comes first."""
    return f"{surt(url)} {0 if page_id is None else page_id + ID_SHIFT + 1:020d}"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def header_value(value: str | None) -> str:
    """A URL as it may stand in a header: no control characters or spaces."""
    return quote(value or "urn:none", safe="!#$%&'()*+,/:;=?@[]~-._")


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page refers_to, as a gzip member. A revisit has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(body)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*lines, "", ""]).encode() + body + b"\r\n\r\n") + packer.flush()


def read_record(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the length that the HTTP header gives; raises if lengths or digests don't agree."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    n = int(headers["Content-Length"])
    body = rest[:n]
    if version != "WARC/1.1" or rest[n:] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha1:" + base32_sha1(body):
        raise ValueError(f"a damaged record: {headers.get('WARC-Record-ID')}")
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if headers["WARC-Type"] == "response" and (len(payload) != length or headers["WARC-Payload-Digest"] != "sha1:" + base32_sha1(payload)):
        raise ValueError(f"a damaged payload: {headers['WARC-Record-ID']}")
    return headers, payload, length


class Files:
    """Opens files of one folder, and keeps the last one open for the next range."""

    def __init__(self, base: str):
        self.fs, self.path = pafs.FileSystem.from_uri(base)
        self.name, self.handle = None, None

    def create(self, name: str) -> pa.NativeFile:
        return self.fs.open_output_stream(f"{self.path}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.handle = name, self.fs.open_input_file(f"{self.path}/{name}")
        return self.handle.read_at(length, offset)

    def whole(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.path}/{name}", compression=None) as f:
            return f.read()

    def close(self) -> None:
        if self.handle:
            self.handle.close()
        self.name = self.handle = None


class Archive:
    """Where the records and the index of an archive are. first_keys has the index files in key order, MOST_FILES at most."""

    def __init__(self, base: str, first_keys: list[tuple[str, str]], entries: DataFrame):
        self.base, self.first_keys, self.entries = base, first_keys, entries


def write_records(pages: DataFrame, base: str, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archive files under base; gives a row for each record.

    Of pages with the same payload of at least least_bytes bytes, those with the largest page_id are
    responses and the others revisits. Only digests and ids are grouped, after sums in each task.
    """
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    made = made.withColumn("sha1", F.unhex(F.sha1("payload")))
    shared = made.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("sha1", "newest")
    joined = made.join(shared, "sha1", "left").withColumn("refers_to", F.expr("CASE WHEN page_id IS NULL OR page_id < newest THEN newest END")).drop("newest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, at = Files(base), None, 0
        name = f"records-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        for batch in slices(batches):
            rows: list[tuple] = []
            for page_id, url, payload, sha1, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                out = out or files.create(name)
                digest = base64.b32encode(sha1).decode()
                member = write_record(page_id, url, payload, digest, refers_to)
                out.write(member)
                rows.append((capture_key(url, page_id), page_id, name, at, len(member), digest))
                at += len(member)
            if rows:
                key, ids, names, offsets, lengths, digests = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.string()), "page_id": pa.array(ids, pa.int64()), "file": pa.array(names, pa.string()), "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64()), "digest": pa.array(digests, pa.string())})
        if out:
            out.close()

    return stage(joined.mapInArrow(run, RECORD), "warc-records")


def write_index(entries: DataFrame, base: str, block_lines: int = BLOCK_LINES, file_rows: int = FILE_ROWS) -> list[tuple[str, str]]:
    """Sort the entries by key into index files of compressed blocks, a directory beside each; gives (first key, file)."""
    n = entries.count()
    n_files = max(1, -(-n // max(file_rows, n // MOST_FILES)))
    in_order = entries.repartitionByRange(n_files, "key").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, at, held, directory = Files(base), None, 0, [], []
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.cdxj.gz"

        def close_block() -> None:
            nonlocal at
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            block = packer.compress("".join(line for _, line in held).encode()) + packer.flush()
            out.write(block)
            directory.append(f"{held[0][0]}\t{at}\t{len(block)}\n")
            at += len(block)
            held.clear()

        first = None
        for batch in slices(batches, 4096):
            for r in batch.to_pylist():
                out = out or files.create(name)
                first = first if first is not None else r["key"]
                held.append((r["key"], f"{r['key']} {json.dumps({k: r[k] for k in ('file', 'offset', 'length', 'digest')})}\n"))
                if len(held) == block_lines:
                    close_block()
        if out:
            if held:
                close_block()
            out.close()
            with files.create(name + ".dir") as f:
                f.write("".join(directory).encode())
            yield pa.RecordBatch.from_pydict({"first": [first], "file": [name]})

    rows = stage(in_order.mapInArrow(run, "first string, file string"), "warc-index").collect()
    return sorted((r[0], r[1]) for r in rows)


def write_archive(pages: DataFrame, base: str, least_bytes: int = 0) -> Archive:
    files = Files(base)
    files.fs.create_dir(files.path)
    entries = write_records(pages, base, least_bytes)
    return Archive(base, write_index(entries, base), entries)


class Index:
    """Look-ups in one index file: the directory is held, and the last block."""

    def __init__(self, files: Files, name: str):
        self.files, self.name = files, name
        rows = [x.split("\t") for x in files.whole(name + ".dir").decode().splitlines()]
        self.firsts, self.ranges = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.number, self.keys, self.lines = -1, [], []

    def block(self, number: int) -> None:
        if number != self.number:
            text = zlib.decompress(self.files.read(self.name, *self.ranges[number]), 31).decode()
            self.lines = text.splitlines()
            self.keys = [" ".join(x.split(" ", 2)[:2]) for x in self.lines]
            self.number = number

    def find(self, key: str) -> Iterator[dict]:
        """All entries with this key; those of a repeated key may run over several blocks."""
        number = max(0, bisect_left(self.firsts, key) - 1)
        while number < len(self.firsts) and self.firsts[number] <= key:
            self.block(number)
            for line in self.lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]:
                yield json.loads(line.split(" ", 2)[2])
            number += 1


def look_up(archive: Archive, keys: DataFrame) -> DataFrame:
    """(key, file, offset, length) of the records that have one of the distinct keys (key) given."""
    base, firsts, names = archive.base, [k for k, _ in archive.first_keys], [n for _, n in archive.first_keys]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [max(0, bisect_right(firsts, k) - 1) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(at, pa.int32())], ["key", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, index = Files(base), None
        for batch in slices(batches, 4096):
            rows = []
            for key, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if index is None or index.name != names[part]:
                    index = Index(files, names[part])
                rows += [(key, e["file"], e["offset"], e["length"]) for e in index.find(key)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "offset", "length"])
        files.close()

    if not names:
        return keys.sparkSession.createDataFrame([], "key string, file string, offset long, length long")
    # tasks take ranges of keys, so one index file may serve many of them, each with its own few blocks
    tasks = groups_for(len(names) * FILE_ROWS, TASK_KEYS)
    return keys.mapInArrow(place, "key string, part int").repartitionByRange(tasks, "part", "key").sortWithinPartitions("part", "key").mapInArrow(run, "key string, file string, offset long, length long")


def fetch(archive: Archive, found: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of records by (file, offset, length).

    Ranges of a file are read in order. A revisit has a null payload, and the length and digest of the full one.
    """
    base = archive.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(base)
        for batch in slices(batches):
            rows = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                h, payload, n = read_record(files.read(name, offset, length))
                response = h["WARC-Type"] == "response"
                ids = [int(h[k]) if k in h else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                rows.append((ids[0], h["WARC-Target-URI"], payload if response else None, n, h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], ids[1]))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        files.close()

    # pointers are few bytes to many of records, so partitions follow the records' bytes and are not merged by their own
    pointers = stage(found.select("file", "offset", "length"), "warc-pointers")
    n_bytes = pointers.agg(F.sum("length")).first()[0] or 0
    in_order = pointers.repartitionByRange(groups_for(n_bytes, TASK_BYTES), "file", "offset").sortWithinPartitions("file", "offset")
    return in_order.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def keys_of(pages: DataFrame) -> DataFrame:
    """The distinct capture keys (key) of pages (page_id, url)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [capture_key(u, i) for u, i in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "key string").distinct()


def round_trip(pages: DataFrame, base: str | None = None, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, read back from the archive.

    A null html is an empty payload. Rows that share both the largest page_id and the payload are all
    responses; a row with a null page_id revisits the payload's response, or is one if no row with the
    payload has an id. Null and odd URLs have keys like any other. Repeated rows give a record each, and
    an empty table gives none.
    """
    archive = write_archive(pages, base or scratch_path(pages.sparkSession, "warc"), least_bytes)
    return fetch(archive, look_up(archive, keys_of(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS newest,
         list_transform(range(0, 8), lambda g: ('0x' || substr(hex, 1 + 5 * g, 5))::BIGINT) AS fives
  FROM digests
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 15)::INT, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31)::INT, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31)::INT, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM grouped
"""
