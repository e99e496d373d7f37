"""Event-log records as XML text, one Event per row (source_artifact, record_ord, xml), to timeline events.

Each record is parsed once, into a row of what events are made of; the rest is columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.errors import ParseError
from tracewell.functions.timestamps import iso8601
from tracewell.shared import ship
from tracewell.sources.exports import EventExports, exported

NAME, VERSION = "evtx_parser", "1.0.0"
# Providers, event ids and what they say.
DFU, PNP, SECURITY = "Microsoft-Windows-DriverFrameworks-UserMode", "Microsoft-Windows-Kernel-PnP", "Microsoft-Windows-Security-Auditing"
KINDS = ((DFU, "2003", "usb_insert"), (DFU, "2100", "usb_remove_pending"), (DFU, "2102", "usb_remove"), (PNP, "20001", "usb_device_install"), (PNP, "20003", "usb_device_install"), (SECURITY, "4663", "file_access"))
DEVICE_FIELDS = ("DeviceInstanceId", "DeviceInstanceID", "InstanceId", "DeviceId")
FILE_FIELDS = ("AccessMask", "AccessList", "ProcessName", "ProcessId", "SubjectUserName")


#: Columns of a parsed record, in the order of ``fields``; ``data`` are the named data, in their order.
HEAD = ("provider", "event_id", "raw", "record_id", "channel", "user_device")
PARSED = "source_artifact string, record_ord long, " + ", ".join(f"{c} string" for c in HEAD) + ", data array<struct<name: string, value: string>>"
TEXTS = {("Event", "System", "EventID"): "event_id", ("Event", "System", "EventRecordID"): "record_id", ("Event", "System", "Channel"): "channel"}
ATTRIBUTES = {("Event", "System", "Provider"): ("Name", "provider"), ("Event", "System", "TimeCreated"): ("SystemTime", "raw")}


def fields(xml: str) -> tuple[dict[str, str], list[dict[str, str]]]:
    """What a record says of itself and its device, the first of each, and its named data; an error where the XML is not well-formed.

    An element's text is that of all within it. Names are compared as they are written, without regard to name spaces, and those of a device
    in user data by what follows a prefix.
    """
    found: dict[str, str] = {}
    data: list[dict[str, str]] = []
    path: list[str] = []
    held: list[tuple[int, str, dict, list[str]]] = []
    parser = expat.ParserCreate()

    def start(name: str, attributes: dict[str, str]) -> None:
        path.append(name)
        depth = len(path)
        if depth < 3 or path[0] != "Event":
            return
        if path[1] == "System":
            if depth == 3:
                at = tuple(path)
                if at in TEXTS and TEXTS[at] not in found:
                    found[TEXTS[at]] = ""
                    held.append((depth, TEXTS[at], found, []))
                elif at in ATTRIBUTES and ATTRIBUTES[at][0] in attributes:
                    found.setdefault(ATTRIBUTES[at][1], attributes[ATTRIBUTES[at][0]])
        elif path[1] == "EventData":
            if depth == 3 and name == "Data" and "Name" in attributes:
                data.append({"name": attributes["Name"], "value": ""})
                held.append((depth, "value", data[-1], []))
        elif path[1] == "UserData" and "user_device" not in found and name.rpartition(":")[2] in DEVICE_FIELDS:
            found["user_device"] = ""
            held.append((depth, "user_device", found, []))

    def end(_: str) -> None:
        if held and held[-1][0] == len(path):
            _, key, into, texts = held.pop()
            into[key] = "".join(texts)
        path.pop()

    def text(part: str) -> None:
        if held:
            held[-1][3].append(part)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as e:
        raise ParseError(f"event record is not well-formed: {e}") from e
    return found, data


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    for batch in batches:
        rows = [fields(xml) if xml is not None else ({}, []) for xml in batch.column("xml").to_pylist()]
        columns = [pa.array([found.get(c) for found, _ in rows], pa.string()) for c in HEAD]
        yield pa.RecordBatch.from_arrays([batch.column("source_artifact"), batch.column("record_ord"), *columns, pa.array([data for _, data in rows], kind)], names=["source_artifact", "record_ord", *HEAD, "data"])


def _text(value: Column | str) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _data(name: str) -> Column:
    return _text(F.try_element_at(F.filter("data", lambda d: d["name"] == name), F.lit(1))["value"])


def event_type(provider: Column, event_id: Column) -> Column:
    out = F.lit(None).cast("string")
    for p, e, kind in KINDS:
        out = F.when((provider == p) & (event_id == e), F.lit(kind)).otherwise(out)
    return out


def _required(value: Column, what: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"event record without {what}: "), "source_artifact")).cast("string"))


def events(records: DataFrame, case_id: str = "") -> DataFrame:
    """Supported records only; a record of any kind without provider, id or time is an error, as are duplicate data names."""
    ship(records.sparkSession)
    names = F.col("data.name")
    parsed = records.select(F.col("source_artifact").cast("string").alias("source_artifact"), F.col("record_ord").cast("long").alias("record_ord"), "xml").mapInArrow(_parsed, PARSED)
    head = parsed.select("source_artifact", "record_ord", "data", *[_text(c).alias(c) for c in HEAD])
    # checked within the type, since that is what the filter reads first
    whole = F.col("provider").isNotNull() & F.col("event_id").isNotNull() & F.col("raw").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("event record without provider, id or time: "), "source_artifact")).cast("string")
    head = head.withColumn("event_type", F.when(whole, event_type(F.col("provider"), F.col("event_id"))).otherwise(wrong)).where("event_type IS NOT NULL")
    is_file = F.col("event_type") == "file_access"
    kind = F.when(is_file, _required(_data("ObjectType"), "an object type"))
    rows = head.withColumn("kind", kind).where(~is_file | (F.lower("kind") == "file"))
    once = F.when(F.size(names) == F.size(F.array_distinct(names)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("duplicate data name: "), "source_artifact")).cast("boolean"))
    device = F.coalesce(*[_data(n) for n in DEVICE_FIELDS], F.col("user_device"))
    details = F.to_json(F.struct("provider", "event_id", "record_id", "channel", *[F.when(is_file, _data(n)).alias(n) for n in FILE_FIELDS]))
    none = F.lit("")
    # a time without an offset could be of any zone
    at = F.coalesce(iso8601(F.col("raw")), F.raise_error(F.concat(F.lit("event record whose time is no ISO 8601 time with an offset: "), "source_artifact")).cast("timestamp"))
    return rows.where(once).select(
        F.lit(case_id).alias("case_id"), "event_type", at.alias("timestamp_utc"), F.col("raw").alias("raw_timestamp"), "source_artifact", F.lit(NAME).alias("parser_name"), F.lit(VERSION).alias("parser_version"),
        F.when(~is_file, _required(device, "a device")).alias("device_id"), none.alias("serial_number"), none.alias("vendor"), none.alias("product"), none.alias("friendly_name"),
        F.when(is_file, _required(_data("ObjectName"), "an object name")).alias("file_path"), F.lit(None).cast("long").alias("file_size_bytes"), details.alias("details"), F.col("record_ord").cast("long").alias("ingest_ord"),
    )


def read(spark: SparkSession, root: str, case_id: str = "", **options: object) -> DataFrame:
    """Events of all exported logs below ``root``; records of other providers and ids are left out where they are read."""
    records = exported(spark, EventExports, root, **options)
    known = F.col("provider").isin(*sorted({p for p, _, _ in KINDS})) & F.col("event_id").isin(*sorted({e for _, e, _ in KINDS}))
    return events(records.where(known).select("source_artifact", "record_ord", F.col("record").alias("xml")), case_id)
