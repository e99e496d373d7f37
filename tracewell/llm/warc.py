"""WARC archives as a PySpark data source, for reading and writing.

Archives are gzip members, one per record. Each member names its own compressed length in its
header's extra field, so a reader inflates a record's headers first and, unless its payload is wanted,
seeks to the next one; members without the field are inflated to their end. A partition is a range of bytes of
a compressed file, and has the records that begin there. Where ranges may begin is not guessed from the bytes, since a payload
may itself be an archive: a list of true member starts, written with a file or by ``index_starts``, lies in a folder beside
the file's, named ``.starts``; a file without one is one range.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tracewell.llm.runtime import ship
from tracewell.shared import shared_dir, written

SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, content_type string, headers map<string,string>, payload_bytes long, payload binary, file string, offset long"
FIELDS = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "warc_date", "refers_to", "payload_digest", "content_type")]
    + [("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())]
)
#: Columns that record headers give, and their names there.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a partition, and of a file that is written; bytes between listed member starts at least.
PART_BYTES, STEP = 64 << 20, 16 << 10
STARTS = ".starts"


def starts_path(name: str) -> str:
    """Where an archive's member starts are listed: archives alone lie in their own folder."""
    folder, _, file = name.rpartition("/")
    return f"{folder}{STARTS}/{file}{STARTS}"


DATE = "2024-01-01T00:00:00Z"


def filesystem(path: str):
    """The store of a Hadoop-style path, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sha1_label(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def bare_digest(label: str | None) -> str | None:
    """Lower-case hex of a header's sha1:BASE32 (or hex) digest."""
    if not label:
        return None
    value = label.rpartition(":")[2]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def member(record: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds its compressed and plain lengths."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(record_id: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response, or a revisit: the same HTTP header (with the payload's length) and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": sha1_label(payload), "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", fields | {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": PROFILE}, http)


class _Source:
    """A file read forward in pieces, with positions."""

    def __init__(self, stream) -> None:
        self.stream, self.size = stream, stream.size()

    def at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(n)


def _parse_headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # folded
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _member_start(head: bytes) -> tuple[int, int]:
    """Where the deflated data of a member begin, and its compressed length if it says so (else 0)."""
    if head[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    flags, at, length = head[3], 10, 0
    if flags & 4:
        (size,) = struct.unpack_from("<H", head, at)
        extra = head[at + 2 : at + 2 + size]
        at += 2 + size
        i = 0
        while i + 4 <= len(extra):
            (n,) = struct.unpack_from("<H", extra, i + 2)
            if extra[i : i + 2] == b"sl" and n >= 4:
                (length,) = struct.unpack_from("<I", extra, i + 4)
            i += 4 + n
    for flag in (8, 16):
        if flags & flag:
            at = head.index(b"\0", at) + 1
    return at + (2 if flags & 2 else 0), length


def _thinned(starts: Iterator[int]) -> list[int]:
    """Of rising offsets the first, and each that is ``STEP`` or more behind the last one taken."""
    out: list[int] = []
    for at in starts:
        if not out or at >= out[-1] + STEP:
            out.append(at)
    return out


def _starts_file(size: int, starts: list[int]) -> bytes:
    """A file's size, which says whether the list is its, and member starts."""
    return struct.pack(f"<{len(starts) + 1}Q", size, *starts)


def _ranges(store, name: str, size: int, part_bytes: int) -> Iterator[tuple[str, int, int]]:
    """Ranges of a compressed file that begin at members and are ``part_bytes`` long at least, as far as its starts are known."""
    cuts = [0]
    if size > part_bytes and store.get_file_info(starts_path(name)).is_file:
        with store.open_input_file(starts_path(name)) as stream:
            raw = stream.read()
        whole, *starts = struct.unpack(f"<{len(raw) // 8}Q", raw)
        for at in starts if whole == size else ():
            if at >= cuts[-1] + part_bytes:
                cuts.append(at)
    return ((name, start, end) for start, end in zip(cuts, [*cuts[1:], size], strict=True))


def records(stream, wanted, with_payload: bool, start: int = 0, end: int | None = None) -> Iterator[tuple[dict[str, str], int | None, bytes | None, int]]:
    """(headers, payload length, payload, offset) of the records whose headers ``wanted`` accepts; gzip or plain files.

    ``start``, ``end``: only records that begin there (compressed files); ``start`` must be a member's.
    """
    source = _Source(stream)
    end = source.size if end is None else min(end, source.size)
    at = start
    while at < end:
        head = source.at(at, 8192)
        if head[:5] == b"WARC/":
            split = head.find(b"\r\n\r\n")
            while split < 0:
                more = source.at(at + len(head), 65536)
                if not more:
                    raise ValueError(f"record at {at} has no end of headers")
                head += more
                split = head.find(b"\r\n\r\n")
            headers = _parse_headers(head[:split])
            length = int(headers.get("content-length", 0))
            if wanted(headers):
                # a payload is read whole only if it is asked for; else the start of the block gives its length
                yield (headers, *_payload(headers, source.at(at + split + 4, length if with_payload else min(length, 65536)), length, with_payload), at)
            at += split + 4 + length + 4
        elif head[:2] == b"\r\n":
            at += 2
        else:
            begin, total = _member_start(head)
            unpack = zlib.decompressobj(-15)
            plain, fed = unpack.decompress(head[begin:], 65536), at + len(head)
            while b"\r\n\r\n" not in plain and not unpack.eof:
                more = unpack.unconsumed_tail or source.at(fed, 65536)
                fed += 0 if unpack.unconsumed_tail else len(more)
                if not more:
                    raise ValueError(f"member at {at} is cut short")
                plain += unpack.decompress(more, 65536)
            split = plain.find(b"\r\n\r\n")
            headers = _parse_headers(plain[:split])
            take = wanted(headers)
            length = int(headers.get("content-length", 0))
            if not total or take and with_payload:
                parts = [plain]
                while not unpack.eof:
                    more = unpack.unconsumed_tail or source.at(fed, 1 << 18)
                    fed += 0 if unpack.unconsumed_tail else len(more)
                    if not more:
                        raise ValueError(f"member at {at} is cut short")
                    got = unpack.decompress(more, 1 << 20)
                    if take:
                        parts.append(got)
                total = fed - len(unpack.unused_data) - at + 8
                plain = b"".join(parts)
                tail = unpack.unused_data[:4] if len(unpack.unused_data) >= 4 else source.at(at + total - 8, 4)
                if take and zlib.crc32(plain) != int.from_bytes(tail, "little"):
                    raise ValueError(f"member at {at} is damaged")
            if take:
                yield (headers, *_payload(headers, plain[split + 4 : split + 4 + length], length, with_payload), at)
            at += total


def _payload(headers: dict[str, str], block: bytes, length: int, with_payload: bool) -> tuple[int | None, bytes | None]:
    """Length and bytes of the payload: what follows the HTTP header of a block, or the block itself."""
    if not headers.get("content-type", "").startswith("application/http"):
        return length, block if with_payload else None
    split = block.find(b"\r\n\r\n")
    declared = _parse_headers(block[: max(split, 0)]).get("content-length")
    if headers.get("warc-type") == "revisit":
        return (int(declared) if declared else None), None
    size = length - split - 4 if split >= 0 else length
    return size, block[split + 4 :] if with_payload else None


@dataclass
class WarcPartition(InputPartition):
    #: (file, first byte, end) of each range.
    ranges: tuple[tuple[str, int, int], ...]

    def __init__(self, ranges: tuple[tuple[str, int, int], ...]) -> None:
        super().__init__(None)
        self.ranges = ranges


class WarcReader(DataSourceReader):
    """Partitions are ranges of large compressed files, or groups of smaller files; a file of no known member starts stays whole, since its payloads may hold records.

    Predicates on header columns are decided before a payload is touched.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith)):
                values = tuple(f.value) if isinstance(f, In) else (f.value,)
                self.tests.append(("starts" if isinstance(f, StringStartsWith) else "in", HEADERS[column], values))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append(("there", HEADERS[column], ()))
            else:
                yield f

    def partitions(self) -> list[WarcPartition]:
        from pyarrow import fs

        store, path = filesystem(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        ranges = [r for name, size in files if name.endswith(".gz") for r in _ranges(store, name, size, self.part_bytes)]
        ranges += [(name, 0, size) for name, size in files if not name.endswith(".gz")]
        parts: list[list[tuple[str, int, int]]] = []
        room = 0
        for name, start, end in sorted(ranges, key=lambda r: (r[1] - r[2], r)):
            if not parts or room < end - start:
                parts.append([])
                room = self.part_bytes
            parts[-1].append((name, start, end))
            room -= end - start
        return [WarcPartition(tuple(p)) for p in parts or [[]]]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for kind, name, values in self.tests:
            value = headers.get(name)
            if value is None or kind == "in" and _plain(name, value) not in values or kind == "starts" and not _plain(name, value).startswith(values[0]):
                return False
        return True

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        for name, start, end in partition.ranges:
            with store.open_input_file(name) as stream:
                rows: list[tuple] = []
                size = 0
                for headers, length, payload, offset in records(stream, self._wanted, self.with_payload, start, end):
                    values = [_plain(h, headers[h]) if h in headers else None for h in HEADERS.values()]
                    rows.append((*values, list(headers.items()), length, payload, name, offset))
                    size += len(payload or b"") + 500
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)


def _plain(name: str, value: str) -> str:
    """Identifiers without their angle brackets, digests as bare hex: what the columns hold."""
    if name in ("warc-record-id", "warc-refers-to"):
        return value.strip("<>")
    return bare_digest(value) if name == "warc-payload-digest" else value


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FIELDS.types, strict=True)], schema=FIELDS)


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_id, target_uri, payload, refers_to) as records; files of about partBytes, renamed when the job commits."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, path = filesystem(self.path.rstrip("/"))
        for folder in (path, path + STARTS):
            store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        stem = f"{path}/part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}"
        rows = (row for batch in iterator for row in zip(*(batch.column(c).to_pylist() for c in ("record_id", "target_uri", "payload", "refers_to")), strict=True))
        files, row = [], next(rows, None)
        while row is not None:
            files.append(f"{stem}-{len(files):04d}.warc.gz")
            size, starts = 0, []
            with store.open_output_stream(files[-1] + ".open", compression=None) as out:
                out.write(member(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, files[-1])}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                while row is not None and size < self.part_bytes:
                    record_id, uri, payload, refers_to = row
                    starts.append(out.tell())
                    size += out.write(member(page_record(record_id, " ".join((uri or "").split()), payload or b"", refers_to)))
                    row = next(rows, None)
                total = out.tell()
            with store.open_output_stream(starts_path(files[-1]), compression=None) as out:
                out.write(_starts_file(total, _thinned(starts)))
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = filesystem(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            store.move(name + ".open", name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = filesystem(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            for written_ in (name + ".open", starts_path(name)):
                store.delete_file(written_)


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; options: path, partBytes, payload (false: headers only).

    Load anew for each query: Spark keeps the predicates that one query has pushed down with the loaded table, and a later
    query of the same DataFrame without any would still have them applied.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def index_starts(spark: SparkSession, path: str) -> DataFrame:
    """Write the member starts of archives from elsewhere beside their folders, so that large ones are read in ranges: (file, starts).

    One task walks a file, by the members' own lengths where they say them. Run it once, and again for files that have changed.
    """
    register(spark)
    root, part_bytes = path, PART_BYTES

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(root)
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            with store.open_input_file(name) as stream:
                starts, size = _thinned(at for *_, at in records(stream, lambda headers: True, False)), stream.size()
            store.create_dir(starts_path(name).rpartition("/")[0], recursive=True)
            with store.open_output_stream(starts_path(name), compression=None) as out:
                out.write(_starts_file(size, starts))
            yield pa.RecordBatch.from_pydict({"file": [name], "starts": [len(starts)]})

    store, _ = filesystem(path)
    large = [(name,) for p in WarcReader({"path": path}).partitions() for name, start, end in p.ranges if name.endswith(".gz") and end - start > part_bytes]
    files = spark.createDataFrame(large, "file string")
    return written(files.repartition(max(1, len(large))).mapInArrow(walk, "file string, starts long"), "starts")


PREFIX = "urn:page:"
LEAST = 1000


def page_records(pages: DataFrame) -> DataFrame:
    """Records to write: of equal payloads of at least 1000 bytes the largest page_id is kept, the others refer to it."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    large = F.octet_length("payload") >= LEAST
    digests = rows.where(large).select("page_id", F.sha1("payload").alias("digest"))
    # stored, so that its size is known: a small table is sent to the payloads, and only for a large one do payloads move
    several = written(digests.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keep"), "repeated-digests")
    # a smaller page has no digest to look for; its key says which page it is, so that such pages are not one group
    named = rows.withColumn("digest", F.when(large, F.sha1("payload")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "target_uri", "payload").cast("string"))))
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    record_id = F.concat(F.lit(PREFIX), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    return named.join(several, "digest", "left").select(
        record_id.alias("record_id"), "target_uri", "payload", F.when(again, F.concat(F.lit(PREFIX), F.col("keep").cast("string"))).alias("refers_to")
    )


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC files (into the shared folder if no path is given) and read them back, one row per page.

    Null html counts as empty, a null url as ''. A null page_id never is the response of a group that has
    other ids. Repeated rows of the page that others refer to are all responses.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    page_records(pages).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))
    return read.select(
        F.expr(f"try_cast(substring(record_id, {len(PREFIX) + 1}) AS long)").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        # of what was read back; a revisit has no payload, so its header says it
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.expr(f"try_cast(substring(refers_to, {len(PREFIX) + 1}) AS long)").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
k AS (SELECT d, max(page_id) AS keep FROM q WHERE n >= 1000 GROUP BY d)
SELECT q.page_id, CAST(q.n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
  CASE WHEN k.keep IS NULL OR k.keep = q.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k.keep <> q.page_id THEN k.keep END AS refers_to
FROM q LEFT JOIN k ON q.d = k.d AND q.n >= 1000
"""
