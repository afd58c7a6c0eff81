"""WARC archives packaged in ZIP, written and read back without extraction.

Writing: each task writes archives of bounded size to the shared folder. A member
``archive/data.warc.gz`` holds one gzip member a record and is stored, not
deflated, so a record is a byte range of the archive; ``indexes/index.cdxj`` has
a line for each record. Records go to the file as they come; a task holds one record
and the index lines of one archive. An archive is written under a name of its attempt
and then renamed, so a task that runs again replaces it whole.

Reading: the end of the file gives the central directory (ZIP64 where present),
the directory gives the members, a member's local header gives its first byte.
The index is read, neighbouring records are fetched in one range of bounded size,
and each is inflated by itself. Data members that are not stored are refused.

Of records with one payload the response is that of the largest page_id; others
revisit it. Only narrow digests are grouped, and only those of several rows meet the
pages again: by a broadcast if they were counted to be few, else by a join that adaptive
execution can split.

Defined results: a null html is an empty payload; null urls are written without a
target; rows with null ids are responses if no row of their payload has an id, and
revisits else; rows that repeat the largest id are all responses (ties); a very long page
is one record, and read by one range; empty tables write no archive and read back empty;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.process_cache import frugal
from corpusmill.plans.staging import cut, small_batches, small_or_shuffled, splittable, table, work_folder

#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 32_000_000
#: Most bytes fetched by one range read that joins records (a longer record is one read).
RANGE_BYTES = 4_000_000
#: Smallest payload that may be a revisit.
LEAST_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "archive string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


# --- records -----------------------------------------------------------------


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    x = urn.strip("<>").rpartition(":")[2]
    return int(x) if x else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (refers_to given) keeps HTTP headers and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=_SAFE))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


# printable ASCII but the percent sign and the space: quoting keeps any url on one line
_SAFE = "".join(chr(c) for c in range(33, 127) if c != 37)


def parse(raw: bytes) -> tuple:
    """(page_id, url, type, length, digest, refers_to, payload or None) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    url = fields.get("WARC-Target-URI")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != length:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    refers = _page_id(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _page_id(fields["WARC-Record-ID"]), None if url is None else unquote(url), kind, length, digest, refers, payload if kind == "response" else None


# --- writing -----------------------------------------------------------------


# Schemes that Hadoop file systems give to stores known by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "webhdfs": "hdfs", "abfss": "abfs"}


def _store(uri: str):
    """(file system, path) of a uri that every executor can reach, as Spark names it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.FileSystem.from_uri("file://" + uri)
    if scheme == "file":
        return fs.FileSystem.from_uri("file:///" + rest.lstrip("/"))
    return fs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + ":" + rest)


class _Archive:
    """An archive that is written as records come; of at most about ARCHIVE_BYTES and one record."""

    def __init__(self, folder: str, name: str, attempt: str) -> None:
        self.index, self.size, self.n, self.uri = [], 0, 0, f"{folder}/{name}"
        self.where, path = _store(folder)
        self.where.create_dir(path, recursive=True)
        self.draft, self.final = f"{path}/.{name}.{attempt}", f"{path}/{name}"
        self.file = self.where.open_output_stream(self.draft)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self._member(DATA)

    def _member(self, name: str):
        return self.zip.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True)

    def add(self, page_id: int | None, url: str | None, raw: bytes, digest: str, mime: str) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        line = {"url": url, "mime": mime, "digest": f"sha1:{digest}", "length": len(packed), "offset": self.size, "filename": DATA, "id": page_id}
        self.index.append(f"{quote(url or '', safe=_SAFE)} 20240101000000 {json.dumps(line)}")
        self.data.write(packed)
        self.size += len(packed)
        self.n += 1

    def close(self) -> tuple[str, int]:
        self.data.close()
        with self._member(INDEX) as f:
            f.write("\n".join(self.index).encode())
        self.zip.close()
        size = self.file.tell()
        self.file.close()
        self.where.move(self.draft, self.final)
        return self.uri, size


def assign(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, sha1, n_bytes, refers_to for every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    # a payload of one row is its own response
    first = rows.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    joined = splittable(rows, small_or_shuffled(cut(first)), ["sha1"], "left")
    revisit = (F.col("n_bytes") >= least_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = joined.select("page_id", "url", "payload", "sha1", "n_bytes", F.when(revisit, F.col("first")).alias("refers_to"))
    return out.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """(archive, n_records, n_bytes) of the archives written for ``pages`` (page_id, url, html).

    Materialised: the archives exist when this returns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, attempt = f"part-{task.stageId()}-{task.partitionId()}", str(task.taskAttemptId())
        now, k = None, 0

        def close() -> pa.RecordBatch:
            path, size = now.close()
            return pa.RecordBatch.from_pydict({"archive": [path], "n_records": [now.n], "n_bytes": [size]})

        for b in batches:
            for page_id, url, sha1, size, refers, payload in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "sha1", "n_bytes", "refers_to")], b.column("payload")):
                digest = base64.b32encode(sha1).decode()
                now = now or _Archive(folder, f"{name}-{k}.zip", attempt)
                now.add(page_id, url, record(page_id, url, payload.as_py(), digest, size, refers), digest, "text/html" if refers is None else "warc/revisit")
                if now.size >= archive_bytes:
                    yield close()
                    now, k = None, k + 1
        if now:
            yield close()

    small_batches(pages.sparkSession)
    return cut(assign(pages, least_revisit).mapInArrow(frugal(run), "archive string, n_records long, n_bytes long"))


# --- reading -----------------------------------------------------------------


def members(f, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, packed size, size, local header offset), from the central directory."""
    tail_at = max(0, size - 65_557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and end + tail_at >= 20:
        f.seek(tail_at + end - 20)
        locator = f.read(20)
        if locator[:4] == b"PK\x06\x07":
            f.seek(struct.unpack_from("<Q", locator, 8)[0])
            record64 = f.read(56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("bad ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record64, 32)
    f.seek(start)
    directory, at, out = f.read(length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, full, names, extras, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode("utf-8", "replace")
        extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: only the fields that did not fit, in this order
                big = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = big.pop(0) if full == 0xFFFFFFFF and big else full
                packed = big.pop(0) if packed == 0xFFFFFFFF and big else packed
                offset = big.pop(0) if offset == 0xFFFFFFFF and big else offset
            k += 4 + n
        out[name] = (method, packed, full, offset)
        at += 46 + names + extras + comment
    return out


def first_byte(f, offset: int) -> int:
    """Where a member's data begins, after its local header."""
    f.seek(offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    names, extras = struct.unpack_from("<HH", head, 26)
    return offset + 30 + names + extras


def ranges(entries: list[dict]) -> Iterator[list[dict]]:
    """Index entries in groups whose bytes follow each other and are fetched together."""
    group: list[dict] = []
    for e in sorted(entries, key=lambda e: (e["filename"], e["offset"])):
        if group and (e["filename"] != group[0]["filename"] or e["offset"] != group[-1]["offset"] + group[-1]["length"] or e["offset"] + e["length"] - group[0]["offset"] > RANGE_BYTES):
            yield group
            group = []
        group.append(e)
    if group:
        yield group


def read_archive(uri: str) -> Iterator[tuple]:
    """The records that an archive's indexes list, by range reads."""
    where, path = _store(uri)
    with where.open_input_file(path) as f:
        found = members(f, f.size())
        for name, (method, packed, _, offset) in found.items():
            if not (name.startswith("indexes/") and name.endswith(".cdxj")):
                continue
            f.seek(first_byte(f, offset))
            raw = f.read(packed)
            index = zlib.decompress(raw, -15) if method == 8 else raw
            for group in ranges([json.loads(x[x.index(b"{") :]) for x in index.split(b"\n") if x]):
                data = found[group[0]["filename"]]
                if data[0] != 0:
                    raise ValueError(f"{uri}: {group[0]['filename']} is not stored")
                lo = group[0]["offset"]
                f.seek(first_byte(f, data[3]) + lo)
                window = f.read(group[-1]["offset"] + group[-1]["length"] - lo)
                for e in group:
                    yield parse(gzip.decompress(window[e["offset"] - lo : e["offset"] - lo + e["length"]]))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``archives`` (archive): see ``RECORDS``. Without payloads that column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["archive", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for uri in b.column("archive").to_pylist():
                rows, size = [], 0
                for x in read_archive(uri):
                    rows.append((uri, *x[:6], x[6] if payloads else None))
                    size += len(x[6] or b"") if payloads else 0
                    if len(rows) >= 1000 or size > RANGE_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return archives.select("archive").mapInArrow(frugal(run), RECORDS)


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), work_folder(spark, "warc"))
    return read_archives(written, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, strlen(t)::BIGINT AS payload_bytes, h,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  (((('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
         max(page_id) OVER (PARTITION BY h) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
