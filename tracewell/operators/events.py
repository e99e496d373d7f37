"""The event timeline: schema, validation, order, counts.

An event row: case_id, event_type, timestamp_utc, raw_timestamp, source_artifact, parser_name, parser_version,
device_id, serial_number, vendor, product, friendly_name, file_path, file_size_bytes, details (JSON) and
ingest_ord, the row's place in its input. A case is one machine's evidence; many are processed at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.shared import ranged, running

EVENTS = (
    "case_id string, event_type string, timestamp_utc timestamp, raw_timestamp string, source_artifact string, parser_name string, parser_version string, "
    "device_id string, serial_number string, vendor string, product string, friendly_name string, file_path string, file_size_bytes long, details string, ingest_ord long"
)
INSERT, REMOVE, ACCESS = "usb_insert", "usb_remove", "file_access"


def order_key() -> list[Column]:
    """Total order of a timeline; the place in the input decides what is equal in all else."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.col("timestamp_utc"), F.col("event_type"), F.col("source_artifact"), blank("file_path"), blank("device_id"), F.col("parser_name"), F.col("parser_version"), F.col("raw_timestamp"), F.col("ingest_ord")]


def timeline(events: DataFrame) -> DataFrame:
    return events.orderBy("case_id", *order_key())


ORDERED = ("case_id", "timestamp_utc", "event_type", "source_artifact", "file_path", "device_id", "parser_name", "parser_version", "raw_timestamp", "ingest_ord")


def positions(events: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``events`` with their place in their case's timeline: ranges of it are counted, then numbered, so a case may have any size.

    ``keep``: columns that are wanted besides those that decide the order, which alone are then stored and sorted.
    """
    narrow = events if keep is None else events.select(*ORDERED, *[c for c in keep if c not in ORDERED])
    dealt = ranged(narrow, ["case_id", *order_key()], "timeline")
    order = [*order_key(), F.col("row")]
    return running(dealt, ["case_id"], "part", order, F.lit(1).cast("long"), "before").withColumn("position", F.col("before") + 1).drop("before", "part", "row")


def united(*streams: DataFrame) -> DataFrame:
    """The rows of all streams, each with the number of its stream."""
    parts = [s.withColumn("stream", F.lit(i)) for i, s in enumerate(streams)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_key() -> list[Column]:
    """Order of merged streams: that of a timeline, and of equal events the earlier stream's first."""
    return [*order_key()[:-1], F.col("stream"), F.col("ingest_ord")]


def merged(*streams: DataFrame) -> DataFrame:
    """Union of streams in timeline order; of equal events the earlier stream's comes first."""
    return united(*streams).orderBy("case_id", *merge_key()).drop("stream")


def merge_positions(*streams: DataFrame) -> DataFrame:
    """The merged streams as a table: each event with its stream and its place in its case."""
    dealt = ranged(united(*streams), ["case_id", *merge_key()], "merged")
    return running(dealt, ["case_id"], "part", [*merge_key(), F.col("row")], F.lit(1).cast("long"), "before").withColumn("position", F.col("before") + 1).drop("before", "part", "row")


def problems() -> Column:
    """What is wrong with a row, as an array of names; empty if nothing is."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    checks = [F.when(F.col("timestamp_utc").isNull(), F.lit("timestamp_utc"))]
    checks += [F.when(blank(c), F.lit(c)) for c in ("raw_timestamp", "source_artifact", "parser_name", "parser_version")]
    checks += [F.when(F.col("event_type").isin(INSERT, REMOVE) & blank("device_id"), F.lit("device_id")), F.when((F.col("event_type") == ACCESS) & (F.coalesce("file_path", F.lit("")) == ""), F.lit("file_path"))]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def violations(events: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rules that they break: what a tolerant run sets aside."""
    return events.withColumn("problems", problems()).where(F.size("problems") > 0)


def validated(events: DataFrame, strict: bool = True) -> DataFrame:
    """Valid rows only; strict: the first invalid one ends the job."""
    if not strict:
        return events.where(F.size(problems()) == 0)
    # in the column that every later step reads, since a filter's branches may be taken apart
    wrong = F.raise_error(F.concat(F.lit("invalid event: "), F.array_join(problems(), ", "))).cast("string")
    return events.withColumn("event_type", F.when(F.size(problems()) == 0, F.col("event_type")).otherwise(wrong))


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
