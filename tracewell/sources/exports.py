"""Exported artifacts as splittable data sources: a record on each line, event records as XML or registry values as JSON.

A partition is a range of bytes of a large file, or several smaller ones, of one file or of many. Each range begins at the first line that starts in
it and ends with the last one that does, so an export of any size is read by many tasks and every record once. What a record
is (its provider and event id, or its key's path) is read before the rest, and predicates on that are decided in the reader.
A record that is not well-formed, or lacks what every record must have, is an error whatever the predicates.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from tracewell.errors import ParseError
from tracewell.shared import ship, store_of

#: Bytes of a partition, of one read, and of a batch for Spark.
PART_BYTES, READ, BATCH = 64 << 20, 1 << 20, 4 << 20
#: Partitions that small ranges are put together to, unless one would then have more than ``PART_BYTES``: a task costs more than a short range.
PARTS = 512
#: Endings of exports that stand for binary logs and hives.
XML_EXPORT, VALUE_EXPORT = ".events.xml", ".values.jsonl"


class Range(NamedTuple):
    path: str
    rel_path: str
    start: int
    end: int


class ExportPartition(InputPartition):
    def __init__(self, ranges: list[Range]) -> None:
        super().__init__(None)
        self.ranges = ranges


def lines(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end); line ends and blank lines are left out."""
    # a line begins at ``start`` if the byte before ends one
    at = max(start - 1, 0)
    stream.seek(at)
    held, fresh = stream.read(READ), start == 0
    while held and at < end:
        cut = held.find(b"\n")
        if cut < 0:
            more = stream.read(max(READ, len(held)))
            if more:
                held += more
                continue
            cut = len(held)
        if fresh and at < end and (line := held[:cut].rstrip(b"\r")).strip():
            yield at, line
        fresh = True
        # the rest of what was read is cut once, not for each line
        begin, at = cut + 1, at + cut + 1
        while at < end and (cut := held.find(b"\n", begin)) >= 0:
            if (line := held[begin:cut].rstrip(b"\r")).strip():
                yield at, line
            at += cut + 1 - begin
            begin = cut + 1
        held = held[begin:] or stream.read(READ)


def event_head(line: bytes) -> tuple[str, str]:
    """Provider and event id of a record; an error where one or the time is missing, or the XML is not well-formed."""
    found: dict[str, str] = {}
    path: list[str] = []
    parser = expat.ParserCreate()

    def start(name: str, attributes: dict[str, str]) -> None:
        path.append(name)
        if path == ["Event", "System", "Provider"]:
            found.setdefault("provider", attributes.get("Name", "").strip())
        elif path == ["Event", "System", "TimeCreated"]:
            found.setdefault("time", attributes.get("SystemTime", "").strip())

    def text(data: str) -> None:
        if path == ["Event", "System", "EventID"]:
            found["event_id"] = found.get("event_id", "") + data

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda name: path.pop(), text
    try:
        parser.Parse(line, True)
    except expat.ExpatError as e:
        raise ParseError(f"event record is not well-formed: {e}") from e
    provider, event_id = found.get("provider", ""), found.get("event_id", "").strip()
    if not (provider and event_id and found.get("time")):
        raise ParseError("event record without provider, id or time")
    return provider, event_id


def value_head(line: bytes) -> tuple[str]:
    """The key of a registry value; an error where there is none, or the line is no JSON object."""
    try:
        found = json.loads(line)
    except ValueError as e:
        raise ParseError(f"registry value is not JSON: {e}") from e
    if not isinstance(found, dict) or not isinstance(found.get("key_path"), str):
        raise ParseError("registry value without a key path")
    return (found["key_path"],)


class ExportReader(DataSourceReader):
    def __init__(self, options: dict[str, str], suffix: str, head, columns: tuple[str, ...]) -> None:
        self.root, self.suffix = options["path"], options.get("suffix", suffix).lower()
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.head, self.columns = head, columns
        self.tests: list[tuple[str, str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in self.columns and isinstance(f, IsNotNull):
                continue  # they never are null
            if column in self.columns and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append(("starts" if isinstance(f, StringStartsWith) else "in", column, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[ExportPartition]:
        from pyarrow import fs

        store, path = store_of(self.root)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(self.suffix))
        base = path.rstrip("/") + "/"
        name = lambda p: p.removeprefix(base) if p.startswith(base) else p.rpartition("/")[2]
        ranges = [Range(p, name(p), at, min(at + self.part_bytes, size)) for p, size in files for at in range(0, size, self.part_bytes)]
        parts: list[ExportPartition] = []
        most, room = max(self.part_bytes, min(PART_BYTES, -(-sum(size for _, size in files) // PARTS))), 0
        for r in sorted(ranges, key=lambda r: (r.start - r.end, r)):
            if not parts or room < r.end - r.start:
                parts.append(ExportPartition([]))
                room = most
            parts[-1].ranges.append(r)
            room -= r.end - r.start
        return parts or [ExportPartition([])]

    def _wanted(self, head: tuple[str, ...]) -> bool:
        values = dict(zip(self.columns, head, strict=True))
        return all(values[c] in wanted if kind == "in" else values[c].startswith(wanted[0]) for kind, c, wanted in self.tests)

    def read(self, partition: ExportPartition) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.root)
        names = ["source_artifact", "record_ord", *self.columns, "record"]
        types = [pa.string(), pa.int64(), *[pa.string()] * (len(self.columns) + 1)]
        rows: list[tuple] = []
        size = 0
        for r in partition.ranges:
            with store.open_input_file(r.path) as stream:
                for at, line in lines(stream, r.start, r.end):
                    try:
                        head = self.head(line)
                    except ParseError as e:
                        raise ParseError(f"{r.rel_path}, byte {at}: {e}") from e
                    if self._wanted(head):
                        rows.append((r.rel_path, at, *head, line.decode()))
                        size += len(line) + 100
                    if size > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class EventExports(DataSource):
    """(source_artifact, record_ord, provider, event_id, record); options: path, suffix, partBytes. record_ord is the record's first byte.

    Load anew for each query: Spark keeps the predicates that one query has pushed down with the loaded table.
    """

    @classmethod
    def name(cls) -> str:
        return "event_exports"

    def schema(self) -> str:
        return "source_artifact string, record_ord long, provider string, event_id string, record string"

    def reader(self, schema: StructType) -> ExportReader:
        return ExportReader(dict(self.options), XML_EXPORT, event_head, ("provider", "event_id"))


class ValueExports(DataSource):
    """(source_artifact, record_ord, key_path, record); options as those of ``EventExports``."""

    @classmethod
    def name(cls) -> str:
        return "value_exports"

    def schema(self) -> str:
        return "source_artifact string, record_ord long, key_path string, record string"

    def reader(self, schema: StructType) -> ExportReader:
        return ExportReader(dict(self.options), VALUE_EXPORT, value_head, ("key_path",))


def exported(spark: SparkSession, kind: type[DataSource], root: str, **options: object) -> DataFrame:
    """The records of all exports of a kind below ``root``."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(**options).load(root)
