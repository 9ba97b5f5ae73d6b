"""WARC records in ZIP packages, read by ranges.

``write_archives`` packs pages as WARC records into ZIP files with two stored (not compressed)
members: ``archive/data.warc.gz``, whose records are gzip members of their own, and
``indexes/index.cdxj``, a line per record with its place in the former.

``read_archives`` takes any such packages.  It reads the end of a file, its central directory
(with the ZIP64 fields and directory where they are used) and the local headers, so it knows
where the stored members lie; then the index; then ranges of records.  Nothing is
extracted or copied, and a large archive is read by many tasks.

Of pages with the same payload of at least ``MIN_REVISIT`` bytes the one with the smallest key is
a response and the others are revisit records without a payload.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_folder

MIN_REVISIT = 100
#: Payload bytes after which a task goes on with a new package, and bytes a read range has at most (or one record).
PACKAGE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
#: Archive bytes a reading task has at most, about.
TASK_BYTES = 128 << 20
DATE = "2000-01-01T00:00:00Z"
# Fixed names and numbers of the formats.
DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or of a local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record(kind: str, key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a WARC record.  Line ends in a URL are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {url} {digest}')}>", f"WARC-Date: {DATE}"]
    if key is not None:
        head.append(f"WARC-Page-ID: {key}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a gzip member."""
    reader = zlib.decompressobj(31)
    raw = reader.decompress(member) + reader.flush()
    if not reader.eof:
        raise ValueError("a record ends early")
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[:int(headers["content-length"])]


def zip_members(f, size: int) -> dict[str, tuple[int, int]]:
    """(offset of the data, length) of each stored member of a ZIP file, by name.

    Members that are compressed or encrypted are left out.  ZIP64 sizes, offsets and
    directories are followed; a file without an end record raises ``ValueError``."""
    def at(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)

    tail_at = max(0, size - 22 - FULL16)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if FULL16 == count or FULL32 in (length, start):
        where = tail_at + end - 20
        locator = at(where, 20) if where >= 0 else b""
        if locator[:4] == LOCATOR64:
            end64 = at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end of the directory")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, p, out = at(start, length), 0, {}
    for _ in range(count):
        if directory[p:p + 4] != CENTRAL:
            raise ValueError("the ZIP directory ends early")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, real = struct.unpack_from("<II", directory, p + 20)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", directory, p + 28)
        (offset,) = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46:p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n_name:p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # ZIP64: of these three, those that didn't fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                real = next(wide) if real == FULL32 else real
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            q += 4 + n
        p += 46 + n_name + n_extra + n_note
        if method == 0 and not flags & 1:
            local = at(offset, 30)
            if local[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            out[name] = (offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
    return out


class Package:
    """A ZIP package while it is written."""

    def __init__(self, folder: str, name: str) -> None:
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        self.path = f"{folder}/{name}"
        self.sink = system.open_output_stream(f"{path}/{name}")
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA_MEMBER, "w", force_zip64=True)
        self.index, self.offset, self.payload = [], 0, 0

    def add(self, member: bytes, entry: dict) -> None:
        self.data.write(member)
        self.index.append(f"{DATE} {json.dumps(entry | {'offset': self.offset, 'length': len(member)})}\n")
        self.offset += len(member)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX_MEMBER, "".join(self.index).encode())
        self.zip.close()
        self.sink.close()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` into packages below ``folder``; returns (path, records).

    A null html is an empty payload; a null URL or key is left out of the record.  Rows with the
    smallest key of an equal payload are all responses; a null key counts as the largest, and if all
    keys are null all are responses.  No rows write no package.  A task that is run again writes
    under a new name; only the paths of the successful attempt are returned.
    """
    own = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    digest, size = F.sha2(F.encode("html", "utf-8"), 256), F.octet_length("html")
    firsts = materialise(own.where(size >= MIN_REVISIT).select(digest.alias("_digest"), "key").groupBy("_digest")
                         .agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"))
    marked = (own.withColumn("digest", digest)
              .join(firsts, F.col("digest") == F.col("_digest"), "left")
              .withColumn("refers_to", F.when(F.coalesce(F.col("key") != F.col("first"), F.col("first").isNotNull()), F.col("first")))
              .select("key", "url", "html", "digest", "refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number, package, done = TaskContext.get(), 0, None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                for k_, u, page, sha, first in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns), strict=True):
                    if package is None:
                        package = Package(folder, f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.zip")
                    payload, kind = page.encode(), "response" if first is None else "revisit"
                    package.add(record(kind, k_, u, payload, sha, first), {"type": kind, "digest": sha})
                    package.payload += len(payload)
                    if package.payload >= PACKAGE_BYTES:
                        package.close()
                        done.append((package.path, len(package.index)))
                        package, number = None, number + 1
        if package is not None:
            package.close()
            done.append((package.path, len(package.index)))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return materialise(marked.mapInArrow(write, "path string, records long"))


def read_archives(packages: DataFrame) -> DataFrame:
    """Every record of the packages in column ``path``: key, url, record_type, payload_digest,
    payload_bytes, refers_to and ``payload`` (null for a revisit).

    The digest and length of a response are computed from its payload, and a digest other than the
    record's raises; those of a revisit are the record's own."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []  # path, first byte, and where in the range its records begin and end
            for path in batch.column(0).to_pylist():
                system, local = file_system(path)
                with system.open_input_file(local) as f:
                    members = zip_members(f, f.size())
                    base, _ = members[DATA_MEMBER]
                    at, n = members[INDEX_MEMBER]
                    f.seek(at)
                    entries = (json.loads(line.partition(" ")[2]) for line in f.read(n).decode().splitlines())
                    start, cuts = 0, []
                    for begin, end in sorted((e["offset"], e["offset"] + e["length"]) for e in entries):
                        if not cuts or end - start > RANGE_BYTES:
                            start, cuts = begin, []
                            found.append((path, base + start, cuts))
                        cuts += [begin - start, end - start]
            columns = list(zip(*found, strict=True)) if found else [[]] * 3
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["path", "start", "cuts"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for path, start, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, local = file_system(path)
                with system.open_input_file(local) as f:
                    f.seek(start)
                    data = f.read(cuts[-1])
                rows = []
                for begin, end in zip(cuts[::2], cuts[1::2], strict=True):
                    head, block = parse_record(data[begin:end])
                    http, _, payload = block.partition(b"\r\n\r\n")
                    sha = head["warc-payload-digest"].partition(":")[2]
                    whole = head["warc-type"] == "response"
                    if whole and hashlib.sha256(payload).hexdigest() != sha:
                        raise ValueError(f"{path}: a payload differs from its digest")
                    said = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    number = lambda name: int(head[name]) if name in head else None  # noqa: E731, B023
                    rows.append((number("warc-page-id"), head.get("warc-target-uri"), head["warc-type"], sha, len(payload) if whole else said,
                                 number("warc-refers-to-page-id"), payload if whole else None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    found = materialise(packages.select("path").mapInArrow(ranges, "path string, start long, cuts array<long>"))
    # as many tasks as the bytes ask for, and as the session wants where there are ranges enough
    size = found.agg(F.count("*").alias("ranges"), F.sum(F.element_at("cuts", -1)).alias("bytes")).first()
    tasks = max(1, min(size["ranges"], max(int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size["bytes"] or 0) // TASK_BYTES)))
    found = found.repartition(tasks)
    return found.mapInArrow(read, "key long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder, read the records back without their payloads, and
    remove the archives."""
    folder = shared_folder(spark, f"warc-{uuid.uuid4().hex}")
    out = materialise(read_archives(write_archives(pages, folder)).drop("payload"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
