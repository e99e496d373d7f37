"""One identity for each device, however artifacts name it.

Event logs name an instance id, registry entries another one of the same serial, mount points a volume GUID and file paths a
drive letter. What an event names together is linked, within a case; connected components of the links are devices, and each is
called by its least instance id. So mounts and file paths, which name no device, get one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import windows
from tracewell.operators.components import connected_components
from tracewell.operators.events import ACCESS
from tracewell.shared import written

DEVICE, SERIAL, VOLUME, LETTER = "device", "serial", "volume", "letter"


def serial_of(device_id: Column) -> Column:
    """The serial that an instance id ends in, in capitals, without an instance's number; null for one that Windows made up, which says nothing."""
    last = F.element_at(F.split(device_id, r"[\\#]"), -1)
    bare = F.upper(F.regexp_replace(last, r"&\d+$", ""))
    return F.when((bare != "") & ~windows.generated_serial(last), bare)


def names_of(events: DataFrame) -> DataFrame:
    """``events`` with ``names``: what each names of a device, as kind and value; its instance id first, if it has one."""
    # a column of its own, so that details are parsed once, not for each name
    parsed = events.withColumn("_details", F.try_parse_json("details"))
    detail = lambda name: F.nullif(F.try_variant_get("_details", f"$.{name}", "string"), F.lit(""))
    letter = F.upper(F.coalesce(detail("drive_letter"), F.when(detail("mount_point_kind").isNotNull(), F.concat(F.regexp_extract(detail("mount_point_entry"), "^([A-Za-z]):?$", 1), F.lit(":")))))
    # a file's path begins with a letter that its volume has
    path = F.when(F.col("event_type") == ACCESS, F.upper(F.nullif(F.regexp_extract("file_path", "^([A-Za-z]:)", 1), F.lit(""))))
    device = F.when(F.trim(F.coalesce("device_id", F.lit(""))) != "", F.col("device_id"))
    found = [(DEVICE, device), (SERIAL, serial_of(device)), (VOLUME, F.lower(detail("volume_guid"))), (LETTER, F.when(F.length(letter) == 2, letter)), (LETTER, path)]
    # each value is a column before it is looked at, and a null one gives a null name
    valued = parsed.withColumns({f"_value{i}": value for i, (_, value) in enumerate(found)})
    names = F.array(*[F.concat(F.lit(f"{kind}:"), F.col(f"_value{i}")) for i, (kind, _) in enumerate(found)])
    return valued.withColumn("names", F.array_compact(names)).drop("_details", *[f"_value{i}" for i in range(len(found))])


def identities(events: DataFrame) -> DataFrame:
    """(case_id, name, identity): of each name that is linked to a device the least instance id in reach."""
    return _linked(names_of(events))


def _linked(named: DataFrame) -> DataFrame:
    linked = named.where(F.size("names") > 0).select("case_id", "names").distinct()
    # a case's names are nodes of their own: the case's length keeps any two apart
    node = lambda n: F.concat(F.length("case_id").cast("string"), F.lit(":"), "case_id", F.lit(":"), n)
    links = linked.select("case_id", F.col("names")[0].alias("first"), F.explode("names").alias("name"))
    edges = written(links.select("case_id", "name", node(F.col("first")).alias("a"), node(F.col("name")).alias("b")).distinct(), "named-together")
    found = connected_components(edges.where("a <> b").select("a", "b"))
    whole = edges.select("case_id", "name", F.col("b").alias("set_key")).distinct().join(found, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    device = F.when(F.col("name").startswith(f"{DEVICE}:"), F.substr("name", F.lit(len(DEVICE) + 2)))
    least = whole.groupBy("component").agg(F.min(device).alias("identity")).where("identity IS NOT NULL")
    return whole.join(least, "component").select("case_id", "name", "identity")


def with_identity(events: DataFrame) -> DataFrame:
    """``events`` with ``identity``: the device that each belongs to, null where nothing that it names is linked to one.

    Null cases are one case; events without any name keep a null. One name decides, since an event's names are of one identity.
    """
    # stored, so that names are told once of each event: a filter on them would tell them anew, and so would each part of the union
    stored = written(names_of(events), "named-events")
    known = written(_linked(stored.fillna("", ["case_id"])), "identities")
    named = stored.withColumn("_case", F.coalesce("case_id", F.lit(""))).withColumn("_name", F.try_element_at("names", F.lit(1))).drop("names")
    with_name = named.where("_name IS NOT NULL").join(known.select(F.col("case_id").alias("_case"), F.col("name").alias("_name"), "identity"), ["_case", "_name"], "left")
    columns = [*events.columns, "identity"]
    return with_name.select(*columns).unionByName(named.where("_name IS NULL").withColumn("identity", F.lit(None).cast("string")).select(*columns))
