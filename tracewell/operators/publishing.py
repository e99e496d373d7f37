"""All reports of a case as one committed write.

Reports are lines of one table (report, part, line), the lines of a part in order and in one task. Tasks write each part to a
staging folder; only when every task has finished does the commit name the parts in their order and put each report in its
place, the manifest last. A task that fails, because a line claims too much or a row can't be read, ends the job, and the
abort removes what was staged: the reports that were there before stay as they were.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tracewell.errors import ReportError
from tracewell.shared import ship, store_of, width

MANIFEST = "case_manifest"
#: Whether Spark deals two sides of a join anew where they are dealt by some of its keys only.
WHOLE_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass
class Staged(WriterCommitMessage):
    """The files of one task: (report, part, path)."""

    files: tuple[tuple[str, int, str], ...]


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Buffer]]:
    """(report, part, bytes) of each run of rows of one report and part; a text column's bytes are those of its lines one after another."""
    report, part, line = batch.column("report").dictionary_encode(), batch.column("part").to_numpy(zero_copy_only=False), batch.column("line")
    codes = report.indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(part)]
    _, offsets, data = line.buffers()
    kind = np.int64 if pa.types.is_large_string(line.type) else np.int32
    ends = np.frombuffer(offsets, kind)[line.offset :]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield report.dictionary[int(codes[a])].as_py(), int(part[a]), data.slice(int(ends[a]), int(ends[b] - ends[a])) if data is not None else pa.py_buffer(b"")


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.target = options["path"].rstrip("/")
        self.staging = f"{store_of(self.target)[1]}.staged-{options['job']}"
        self.reports = tuple(options["reports"].split(","))
        self.ending = {"none": "", "gzip": ".gz"}[options.get("compression", "none")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, _ = store_of(self.target)
        store.create_dir(self.staging, recursive=True)
        files, now, streams, own = [], None, [], uuid.uuid4().hex
        try:
            for batch in iterator:
                for report, part, text in stretches(batch):
                    if report not in self.reports:
                        raise ReportError(f"no such report: {report}")
                    if (report, part) != now:
                        while streams:
                            streams.pop().close()
                        now = (report, part)
                        files.append((*now, f"{self.staging}/{report}-{part}-{own}-{len(files)}"))
                        streams.append(store.open_output_stream(files[-1][2], compression=None))
                        if self.ending:
                            streams.append(gzip.GzipFile("", "wb", 1, streams[-1], 0))
                    streams[-1].write(text)
        finally:
            while streams:
                streams.pop().close()
        return Staged(tuple(files))

    def commit(self, messages: list[Staged | None]) -> None:
        """Parts in order, a folder for each report (an empty one too), the manifest's last; folders of an earlier run are replaced."""
        store, target = store_of(self.target)
        files = sorted(f for m in messages if m is not None for f in m.files)
        if len({f[:2] for f in files}) < len(files):
            raise ReportError("a part of a report is in several pieces")
        for report in self.reports:
            whole = f"{self.staging}/{report}"
            store.create_dir(whole, recursive=True)
            for k, (_, _, path) in enumerate(f for f in files if f[0] == report):
                store.move(path, f"{whole}/part-{k:05d}{self.ending}")
        store.create_dir(target, recursive=True)
        for report in sorted(self.reports, key=lambda r: (r == MANIFEST, r)):
            place = f"{target}/{report}"
            if store.get_file_info(place).type.name == "Directory":
                store.move(place, f"{self.staging}/{report}-before")
            store.move(f"{self.staging}/{report}", place)
        store.delete_dir(self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _ = store_of(self.target)
        if store.get_file_info(self.staging).type.name == "Directory":
            store.delete_dir(self.staging)


class CaseReports(DataSource):
    """``df.write.format("case_reports")`` of (report, part, line), in order within a part; options: path, job, reports (their names, comma-joined), compression (none or gzip)."""

    @classmethod
    def name(cls) -> str:
        return "case_reports"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options))


def sortable(*values: Column) -> Column:
    """Keys of several kinds as texts that sort as they do: numbers with leading zeros, times by microseconds, nulls last."""
    return F.array(*[F.coalesce(v, F.lit("\U0010ffff")) for v in values])


def report(name: str, rows: DataFrame, line: Column, *key: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("report"), sortable(*key).alias("key"), line.alias("line"))


def placed(lines: DataFrame) -> DataFrame:
    """(report, part, line) of (report, key, line), put in order by ranges of keys: for reports of few lines."""
    order = ["report", "key", "line"]
    return lines.repartitionByRange(width(lines.sparkSession), *order).sortWithinPartitions(*order).select("report", F.spark_partition_id().cast("long").alias("part"), "line")


def publish(lines: list[DataFrame], names: tuple[str, ...], folder: str, compression: str = "none") -> None:
    """Write all reports, or none: ``lines`` are tables of (report, part, line), all lines of a part in order and in one task."""
    spark = lines[0].sparkSession
    ship(spark)
    spark.dataSource.register(CaseReports)
    whole = lines[0]
    for more in lines[1:]:
        whole = whole.unionByName(more)
    ended = whole.select("report", "part", F.concat("line", F.lit("\n")).alias("line"))
    # joins within parts stay where their parts are; the commit sees to it
    before = spark.conf.get(WHOLE_KEYS)
    spark.conf.set(WHOLE_KEYS, "false")
    try:
        ended.write.format("case_reports").option("job", uuid.uuid4().hex).option("reports", ",".join(names)).option("compression", compression).mode("append").save(folder)
    finally:
        spark.conf.set(WHOLE_KEYS, before)
