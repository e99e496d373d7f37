"""Registry values as a flat table, to timeline events.

A row: source_artifact, key_path, key_last_write, value_ord, value_name, value_str, value_int, value_bytes;
a key without values has one row with null value columns.

Each value is told once which entry of the registry it belongs to: a device instance, whatever depth of its tree the value is
at, a portable device, a mount point, or a drive letter. One grouping by entry then gives all that is known of it, and events
are made of the groups; hives are judged by one more, narrow grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import timestamps, windows
from tracewell.sources.exports import ValueExports, exported

NAME, VERSION = "registry_parser", "1.0.0"
# Places in the registry, and the device properties that hold times.
PROPERTIES = "{83da6326-97a6-4088-9453-a1923f573b29}"
TIMES = {"0064": "usb_device_first_install", "0066": "usb_insert", "0067": "usb_remove"}
REGISTERED, LETTER, MOUNT = "usb_device_registered", "usb_drive_letter_assigned", "usb_user_mount"
PORTABLE = r"Microsoft\Windows Portable Devices\Devices"
MOUNTPOINTS = r"Software\Microsoft\Windows\CurrentVersion\Explorer\MountPoints2"
SELECT, LETTERS, STORAGE = "Select", "MountedDevices", r"\Enum\USBSTOR"
VALUES = "key_path string, key_last_write timestamp, value_ord int, value_name string, value_str string, value_int long, value_bytes binary"


def read(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The values of all exported hives below ``root``."""
    records = exported(spark, ValueExports, root, **options)
    return records.select("source_artifact", F.from_json("record", VALUES).alias("v")).select("source_artifact", "v.*")


def hives(values: DataFrame) -> DataFrame:
    """(source_artifact, control_set, fault): the current control set of hives that have one, and what is wrong with a hive."""
    key = F.col("key_path")
    machine = (key == SELECT) | key.startswith(SELECT + "\\") | (key == LETTERS) | key.rlike(r"^ControlSet\d+\\")
    user = key.startswith(PORTABLE) | key.startswith(MOUNTPOINTS)
    current = F.max(F.when((key == SELECT) & (F.col("value_name") == "Current"), F.coalesce("value_int", F.lit(0))))
    found = values.groupBy("source_artifact").agg(F.bool_or(machine).alias("machine"), F.bool_or(user).alias("user"), current.alias("current"))
    fault = F.when(~F.col("machine") & ~F.col("user"), F.lit("unsupported hive: ")).when(F.col("machine") & (F.coalesce("current", F.lit(0)) <= 0), F.lit("no control set in "))
    return found.select("source_artifact", F.when(F.col("current") > 0, F.format_string("ControlSet%03d", "current")).alias("control_set"), F.concat(fault, "source_artifact").alias("fault"))


def _below(parent: str) -> Column:
    """The direct subkey of ``parent`` that the row is of; null for rows elsewhere, and deeper."""
    entry = F.substr("key_path", F.lit(len(parent) + 2))
    return F.when(F.col("key_path").startswith(parent + "\\") & ~entry.contains("\\"), entry)


def entries(values: DataFrame) -> DataFrame:
    """Each known entry once: source_artifact, kind, entry, parts, key_path, written, friendly, device_desc, target, value_name and the ticks of ``TIMES``."""
    parts = F.split("key_path", r"\\")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    instance = F.when(F.col("control_set").isNotNull() & F.col("key_path").startswith(F.concat("control_set", F.lit(STORAGE + "\\"))) & at(5).isNotNull(), F.concat_ws("\\", F.slice(parts, 1, 5)))
    target = windows.mounted_target(F.col("value_bytes"))
    letter = F.when((F.col("key_path") == LETTERS) & F.upper(target).contains("USBSTOR"), F.concat_ws("\\", F.col("key_path"), F.col("value_ord").cast("string"), "value_name", F.col("key_last_write").cast("string"), F.hex("value_bytes")))
    kinds = [("instance", instance), ("portable", _below(PORTABLE)), ("mount", _below(MOUNTPOINTS)), ("letter", letter)]
    place = F.coalesce(*[F.when(entry.isNotNull(), F.struct(F.lit(kind).alias("kind"), entry.alias("entry"))) for kind, entry in kinds])
    rows = values.join(hives(values).select("source_artifact", "control_set"), "source_artifact").withColumn("place", place).where("place IS NOT NULL")
    # what the entry's own key says; of its device properties, deeper in its tree, the first value that holds a time
    own = (F.col("place.kind") != "instance") | (F.size(parts) == 5)
    named = lambda name: F.max(F.when(own & (F.col("value_name") == name), F.col("value_str")))
    ticks = F.coalesce(timestamps.filetime_bytes(F.col("value_bytes")), F.nullif(F.col("value_int").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")))
    timed = (F.size(parts) == 8) & (at(6) == "Properties") & (F.lower(at(7)) == PROPERTIES) & ticks.isNotNull()
    first = lambda p: F.min_by(ticks, F.when(timed & (at(8) == p), F.coalesce("value_ord", F.lit(0)))).alias(f"ticks_{p}")
    return rows.groupBy("source_artifact", "place.kind", "place.entry").agg(
        F.bool_or(own).alias("seen"), F.min(F.when(own, F.col("key_path"))).alias("key_path"), F.max(F.when(own, F.col("key_last_write"))).alias("written"), named("FriendlyName").alias("friendly"), named("DeviceDesc").alias("device_desc"),
        F.min(F.when(F.col("place.kind") == "letter", target)).alias("target"), F.min("value_name").alias("value_name"), *[first(p) for p in TIMES],
    ).where("seen")


def _made(kind: Column | str, at: Column, raw: Column, *details: Column | str) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), at.alias("timestamp_utc"), raw.alias("raw_timestamp"), F.to_json(F.struct(*details)).alias("details"))


def events(values: DataFrame, case_id: str = "") -> DataFrame:
    """Events of all hives. A hive with none of the known keys is an error, as is a machine's without a current control set.

    A device instance has its installation, arrival and removal, and its registration, by the key's last write, if it has none.
    """
    kind, written, entry, target = F.col("kind"), F.col("written"), F.col("entry"), F.col("target")
    parts = F.split("key_path", r"\\")
    device_key, serial = F.try_element_at(parts, F.lit(4)), F.try_element_at(parts, F.lit(5))
    key = windows.device_key(device_key)
    from_write = F.lit(True).alias("timestamp_from_key_lastwrite")
    where = F.col("key_path").alias("registry_key")
    stamp = timestamps.isoformat(written)
    base = [where, key["device_class"].alias("device_class"), key["revision"].alias("revision"), windows.generated_serial(serial).alias("windows_generated_serial"), F.nullif("device_desc", F.lit("")).alias("device_desc")]
    lifecycle = F.array(*[
        F.when(F.col(f"ticks_{p}").isNotNull(), _made(what, timestamps.filetime(F.col(f"ticks_{p}")), F.col(f"ticks_{p}").cast("string"), *base, F.lit(f"{PROPERTIES}\\{p}").alias("device_property"), F.lit(True if what != TIMES["0064"] else None).cast("boolean").alias("records_most_recent_only")))
        for p, what in TIMES.items()
    ])
    lifecycle = F.filter(lifecycle, lambda e: e.isNotNull())
    registered = F.array(_made(REGISTERED, written, stamp, *base, from_write))
    blank = lambda c: F.nullif(c, F.lit(""))
    guid = F.coalesce(blank(windows.volume_guid(F.col("value_name"))), blank(windows.volume_guid(target)))
    letter = F.array(_made(LETTER, written, stamp, where, blank(windows.drive_letter(F.col("value_name"))).alias("drive_letter"), guid.alias("volume_guid"), from_write))
    portable = F.array(_made(REGISTERED, written, stamp, where, entry.alias("portable_device_entry"), from_write))
    mounted = blank(windows.volume_guid(entry))
    mount = F.array(_made(MOUNT, written, stamp, where, entry.alias("mount_point_entry"), from_write, mounted.alias("volume_guid"), F.when(mounted.isNull(), F.lit("drive_letter_or_share")).alias("mount_point_kind")))
    made = F.when(kind == "instance", F.when(F.size(lifecycle) > 0, lifecycle).otherwise(registered)).when(kind == "letter", letter).when(kind == "portable", portable).otherwise(mount)
    named = F.when(kind == "letter", windows.device_of_path(target)).when(kind == "portable", windows.device_of_path(entry)).when(kind == "instance", F.concat_ws("\\", F.lit("USBSTOR"), device_key, serial))
    none = F.lit("")
    found = entries(values).withColumn("device_id", named).where((kind == "mount") | F.col("device_id").isNotNull())
    rows = found.select(
        "source_artifact", "key_path", "kind", "entry", "device_id", F.coalesce(F.when(kind == "instance", serial), F.try_element_at(F.split("device_id", r"\\"), F.lit(3)), none).alias("serial_number"),
        F.when(kind == "instance", key["vendor"]).otherwise(none).alias("vendor"), F.when(kind == "instance", key["product"]).otherwise(none).alias("product"),
        F.when(kind.isin("instance", "portable"), F.coalesce("friendly", none)).otherwise(none).alias("friendly_name"), F.explode(made).alias("e"),
    )
    out = rows.select(
        F.lit(case_id).alias("case_id"), "e.event_type", "e.timestamp_utc", "e.raw_timestamp", "source_artifact", F.lit(NAME).alias("parser_name"), F.lit(VERSION).alias("parser_version"), "device_id", "serial_number", "vendor", "product", "friendly_name",
        F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("long").alias("file_size_bytes"), "e.details", F.xxhash64("source_artifact", "kind", "entry", "e.event_type").alias("ingest_ord"),
    )
    # no row comes of it, but an error where there is one
    wrong = hives(values).where("fault IS NOT NULL").select(F.raise_error(F.col("fault")).cast("string").alias("event_type"))
    return out.unionByName(wrong, allowMissingColumns=True)
