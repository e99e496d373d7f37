"""Shortcut files and jump lists from their bytes (source_artifact, content) to timeline events.

A shortcut's layout is read by expressions: each step adds columns for the block that the one before has placed, and what is
wrong with the bytes is a column, ``fault``, so that a corrupt entry of a list can be told from a corrupt file. Custom lists are
carved by splitting at the signature. Only the sectors of compound files are put together in Python, in tasks.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.errors import ParseError
from tracewell.functions import timestamps, windows
from tracewell.shared import ship

# Fixed values of the formats.
SIGNATURE = bytes.fromhex("4c0000000114020000000000c000000000000046")
HAS_IDS, HAS_INFO, UNICODE = 0x1, 0x2, 0x80
TEXTS = ((0x4, "name"), (0x8, "relative_path"), (0x10, "working_dir"), (0x20, "arguments"), (0x40, "icon"))
HEADER, LEAST_INFO, WIDE_INFO, LEAST_VOLUME = 76, 28, 36, 16
JUMP_NAME = re.compile(r"([0-9a-f]{16})\.(automatic|custom)destinations-ms$", re.IGNORECASE)
LNK, JUMP = ("lnk_parser", "1.0.0"), ("jumplist_parser", "0.1.0")
ENTRIES = "source_artifact string, app_id string, stream_name string, entry long, content binary"
FIELDS = ("target_path", "size", "attributes", "created", "accessed", "modified", "serial", "drive")
#: Characters of the Western code page where it differs from Latin-1.
WESTERN = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))
LATIN = "".join(map(chr, range(0x80, 0xA0)))


def little(data: Column, at: Column | int, n: int) -> Column:
    """The little-endian number of ``n`` bytes at an offset; null where the data end before."""
    at = at if isinstance(at, Column) else F.lit(at)
    digits = F.concat(*[F.hex(F.substring(data, (at + i).cast("int"), F.lit(1))) for i in range(n, 0, -1)])
    return F.when((at >= 0) & (at + n <= F.octet_length(data)), F.conv(digits, 16, 10).cast("decimal(20,0)" if n > 4 else "long"))


def western(data: Column) -> Column:
    return F.translate(F.decode(data, "ISO-8859-1"), LATIN, WESTERN)


def wide(data: Column) -> Column:
    """UTF-16 text; half of a pair without the other is replaced."""
    n = F.octet_length(data)
    units = F.when(n >= 2, F.array_join(F.transform(F.sequence(F.lit(1), (n / 2).cast("int")), lambda i: F.hex(F.substring(data, i * 2 - 1, F.lit(2)))), " ")).otherwise(F.lit(""))
    low_alone = r"(?<![0-9A-F]{2}D[89AB] )\b[0-9A-F]{2}D[C-F]\b"
    high_alone = r"\b[0-9A-F]{2}D[89AB]\b(?! [0-9A-F]{2}D[C-F])"
    whole = F.regexp_replace(F.regexp_replace(units, low_alone, "FDFF"), high_alone, "FDFF")
    return F.decode(F.unhex(F.replace(whole, F.lit(" "), F.lit(""))), "UTF-16LE")


def ended(data: Column, at: Column, is_wide: bool) -> Column:
    """The text from an offset to its closing zero; null if it has none."""
    rest = F.substring(data, (at + 1).cast("int"), F.octet_length(data))
    if is_wide:
        n = F.octet_length(rest)
        units = F.when(n >= 2, F.transform(F.sequence(F.lit(1), (n / 2).cast("int")), lambda i: F.hex(F.substring(rest, i * 2 - 1, F.lit(2)))))
        end = F.coalesce(F.array_position(units, "0000"), F.lit(0))
        return F.when(end > 0, wide(F.substring(rest, F.lit(1), ((end - 1) * 2).cast("int"))))
    end = F.instr(F.decode(rest, "ISO-8859-1"), "\0")
    return F.when(end > 0, western(F.substring(rest, F.lit(1), (end - 1).cast("int"))))


def _has(flags: str, bit: int) -> Column:
    return F.col(flags).bitwiseAND(bit) != 0


def _fault(*checks: tuple[Column, str]) -> Column:
    """The first fault, that of an earlier step before all; a check that comes to null is one."""
    return F.coalesce("fault", *[F.when(F.coalesce(wrong, F.lit(True)), F.lit(says)) for wrong, says in checks])


def _link_info(rows: DataFrame) -> DataFrame:
    """Add path, tail, serial and drive of the LinkInfo block in ``info`` (null: none)."""
    n = {name: little(F.col("info"), at, 4) for at, name in ((4, "i_head"), (8, "i_flags"), (12, "i_volume"), (16, "i_base"), (24, "i_common"))}
    rows = rows.withColumns(n)
    is_wide = F.col("i_head") >= WIDE_INFO
    rows = rows.withColumns({name: F.when(is_wide, little(F.col("info"), at, 4)).otherwise(F.lit(0).cast("long")) for at, name in ((28, "i_wide_base"), (32, "i_wide_tail"))})
    local, there = _has("i_flags", 1), F.col("info").isNotNull()
    # what the header points at stands behind it, and inside the block
    outside = lambda c: (F.col(c) < F.col("i_head")) | (F.col(c) >= F.octet_length("info"))
    used = {"i_volume": local, "i_base": local, "i_common": F.col("i_common") != 0, "i_wide_base": F.col("i_wide_base") != 0, "i_wide_tail": F.col("i_wide_tail") != 0}
    rows = rows.withColumn("fault", _fault(*[(there & F.coalesce(use, F.lit(True)) & F.coalesce(outside(c), F.lit(True)), f"link block points outside itself ({c[2:]})") for c, use in used.items()]))
    good = there & F.col("fault").isNull()
    text = lambda c, use, is_wide: F.when(good & use, ended(F.col("info"), F.col(c), is_wide))
    rows = rows.withColumns({
        "t_base": text("i_base", local, False), "t_tail": text("i_common", used["i_common"], False), "t_wide_base": text("i_wide_base", local & used["i_wide_base"], True), "t_wide_tail": text("i_wide_tail", used["i_wide_tail"], True),
        **{name: F.when(good & local, little(F.col("info"), F.col("i_volume") + at, 4)) for at, name in ((0, "v_size"), (4, "drive"), (8, "serial"))},
    })
    no_end = [(good & use & F.col(c).isNull(), "text has no end") for c, use in (("t_base", local), ("t_tail", used["i_common"]), ("t_wide_base", local & used["i_wide_base"]), ("t_wide_tail", used["i_wide_tail"]))]
    rows = rows.withColumn("fault", _fault(*[(F.coalesce(wrong, F.lit(False)), says) for wrong, says in no_end], (F.coalesce(good & local, F.lit(False)) & F.coalesce((F.col("v_size") < LEAST_VOLUME) | F.col("serial").isNull(), F.lit(True)), "volume block too small")))
    path, tail = F.coalesce("t_wide_base", "t_base"), F.coalesce("t_wide_tail", "t_tail", F.lit(""))
    apart = (tail != "") & ~F.endswith(F.lower(path), F.lower(tail))
    joined = F.when(apart, F.concat(F.regexp_replace(path, r"\\+$", ""), F.lit("\\"), F.regexp_replace(tail, r"^\\+", ""))).otherwise(path)
    return rows.withColumn("path", joined).drop(*n, "i_wide_base", "i_wide_tail", "t_base", "t_tail", "t_wide_base", "t_wide_tail", "v_size")


def decoded(entries: DataFrame) -> DataFrame:
    """``entries`` (with ``content``: a shortcut and whatever follows) with ``FIELDS`` and ``fault``, null where the shortcut is whole."""
    data = F.col("content")
    size = F.octet_length(data)
    rows = entries.withColumns({c: little(data, at, n) for c, at, n in (("flags", 20, 4), ("attributes", 24, 4), ("created", 28, 8), ("accessed", 36, 8), ("modified", 44, 8), ("size", 52, 4))})
    rows = rows.withColumn("fault", F.lit(None).cast("string")).withColumn("fault", _fault((F.substring(data, 1, len(SIGNATURE)) != F.lit(SIGNATURE), "not a shortcut"), (F.col("size").isNull(), "shortcut cut short")))
    at = F.when(_has("flags", HAS_IDS), HEADER + 2 + little(data, HEADER, 2)).otherwise(F.lit(HEADER).cast("long"))
    rows = rows.withColumn("at", at).withColumn("length", F.when(_has("flags", HAS_INFO), little(data, F.col("at"), 4)).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("fault", _fault((_has("flags", HAS_INFO) & F.coalesce((F.col("length") < LEAST_INFO) | (F.col("at") + F.col("length") > size), F.lit(True)), "link block exceeds its file")))
    info = F.when(_has("flags", HAS_INFO) & F.col("fault").isNull(), F.substring(data, (F.col("at") + 1).cast("int"), F.col("length").cast("int")))
    rows = _link_info(rows.withColumn("info", info)).withColumn("at", F.col("at") + F.col("length"))
    for bit, name in TEXTS:
        has, width = _has("flags", bit), F.when(_has("flags", UNICODE), 2).otherwise(1)
        rows = rows.withColumn("length", F.when(has, little(data, F.col("at"), 2) * width))
        rows = rows.withColumn("fault", _fault((has & F.coalesce(F.col("at") + 2 + F.col("length") > size, F.lit(True)), f"{name} exceeds its file")))
        if name == "relative_path":
            raw = F.when(has & F.col("fault").isNull(), F.substring(data, (F.col("at") + 3).cast("int"), F.col("length").cast("int")))
            rows = rows.withColumn("relative", F.when(_has("flags", UNICODE), wide(raw)).otherwise(western(raw)))
        rows = rows.withColumn("at", F.when(has, F.col("at") + 2 + F.col("length")).otherwise(F.col("at")))
    target = F.coalesce(F.nullif("path", F.lit("")), F.nullif("relative", F.lit("")))
    rows = rows.withColumn("target_path", target).withColumn("fault", _fault((F.col("target_path").isNull(), "shortcut has no target path")))
    return rows.select(*[c for c in entries.columns if c != "content"], *FIELDS, "fault")


def _take(data: bytes, layout: str, at: int) -> tuple:
    try:
        return struct.unpack_from("<" + layout, data, at)
    except struct.error as e:
        raise ParseError(f"shortcut cut short at {at}") from e


def container_streams(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Name and bytes of each stream of a compound file."""
    if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        raise ParseError("not a compound file")
    shift, small_shift = _take(data, "2H", 30)
    fat_count, first_dir, _, cutoff, first_mini, mini_count, first_difat, difat_count = _take(data, "8I", 44)
    sector = 1 << shift
    piece = lambda n: data[(n + 1) * sector : (n + 2) * sector]
    difat = list(_take(data, "109I", 76))
    for _ in range(difat_count):
        block = struct.unpack(f"<{sector // 4}I", piece(first_difat))
        difat, first_difat = difat + list(block[:-1]), block[-1]
    fat = [x for n in difat[:fat_count] for x in struct.unpack(f"<{sector // 4}I", piece(n))]

    def chain(start: int, table: list[int]) -> list[int]:
        seen = []
        while start < 0xFFFFFFFA:
            if start >= len(table) or len(seen) > len(table):
                raise ParseError("broken sector chain")
            seen.append(start)
            start = table[start]
        return seen

    entries = b"".join(piece(n) for n in chain(first_dir, fat))
    mini_fat = [x for n in chain(first_mini, fat) for x in struct.unpack(f"<{sector // 4}I", piece(n))] if mini_count else []
    root = b""
    for at in range(0, len(entries), 128):
        entry = entries[at : at + 128]
        (length,), kind = _take(entry, "H", 64), entry[66]
        start, size = _take(entry, "IQ", 116)
        if kind == 5:
            root = b"".join(piece(n) for n in chain(start, fat)) if size else b""
        elif kind == 2:
            name = entry[: max(0, length - 2)].decode("utf-16-le")
            if size < cutoff:
                yield name, b"".join(root[n << small_shift : (n + 1) << small_shift] for n in chain(start, mini_fat))[:size]
            else:
                yield name, b"".join(piece(n) for n in chain(start, fat))[:size]


def _streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, data in zip(batch["source_artifact"], batch["content"], strict=True):
            app = JUMP_NAME.search(name)[1].lower()
            rows = [(name, app, stream, i, body) for i, (stream, body) in enumerate(x for x in container_streams(bytes(data)) if x[0] != "DestList")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRIES.split(", ")])


def carved(files: DataFrame) -> DataFrame:
    """``ENTRIES`` of custom jump lists: from each signature on, to the end of the file."""
    pieces = F.split(F.decode("content", "ISO-8859-1"), "".join(f"\\x{b:02x}" for b in SIGNATURE))
    starts = F.transform(F.sequence(F.lit(1), F.size("pieces") - 1), lambda i: F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p)) + (i - 1) * len(SIGNATURE))
    rows = files.withColumn("pieces", pieces).withColumn("starts", F.when(F.size("pieces") > 1, starts).otherwise(F.array().cast("array<int>")))
    at = rows.select("source_artifact", "content", F.posexplode("starts").alias("entry", "start"))
    app = F.lower(F.regexp_extract("source_artifact", "(?i)([0-9a-f]{16})[.]customdestinations-ms$", 1))
    return at.select("source_artifact", app.alias("app_id"), F.lit(None).cast("string").alias("stream_name"), F.col("entry").cast("long").alias("entry"), F.substring("content", F.col("start") + 1, F.octet_length("content")).alias("content"))


def flat(files: DataFrame) -> DataFrame:
    """One row per shortcut of each file (source_artifact, content): what its bytes say.

    A corrupt shortcut file is an error. A corrupt entry of a list is left out; a list without a good one is an error, as is a list
    whose name doesn't say its application.
    """
    ship(files.sparkSession)
    low = F.lower("source_artifact")
    listed = low.endswith("destinations-ms")
    named = lambda kind: low.rlike(rf"[0-9a-f]{{16}}[.]{kind}destinations-ms$")
    unnamed = F.raise_error(F.concat(F.lit("not a jump list name: "), "source_artifact")).cast("string")
    source = files.select(F.when(listed & ~named("(automatic|custom)"), unnamed).otherwise(F.col("source_artifact")).alias("source_artifact"), "content")
    none = F.lit(None).cast("string")
    single = source.where(~listed).select("source_artifact", none.alias("app_id"), none.alias("stream_name"), F.lit(0).cast("long").alias("entry"), "content")
    automatic = source.where(named("automatic")).mapInPandas(_streams, ENTRIES)
    # a row for each list itself, so that one without any entry is seen
    lists = source.where(listed).select("source_artifact", F.lit("").alias("app_id"), none.alias("stream_name"), F.lit(-1).cast("long").alias("entry"), F.lit(b"").alias("content"))
    # dealt anew, since a list's entries come from one file; the steps below are then planned once, not for each kind of file
    entries = single.unionByName(automatic).unionByName(carved(source.where(named("custom")))).unionByName(lists).repartition("source_artifact", "entry")
    rows = decoded(entries)
    good = F.max(F.col("fault").isNull()).over(Window.partitionBy("source_artifact"))
    wrong = lambda says: F.raise_error(F.concat("source_artifact", F.lit(": "), says)).cast("string")
    checked = F.when(F.col("app_id").isNull() & F.col("fault").isNotNull(), wrong(F.col("fault"))).when(~F.col("good"), wrong(F.lit("no shortcut in it"))).otherwise(F.col("source_artifact"))
    # one condition, so that no row is left out before it is checked
    kept = F.when(F.col("source_artifact").isNotNull(), (F.col("entry") >= 0) & (F.col("app_id").isNull() | F.col("fault").isNull())).otherwise(F.lit(False))
    return rows.withColumn("good", good).withColumn("source_artifact", checked).where(kept).drop("good", "fault")


def details(kind: Column) -> Column:
    return F.struct(
        kind.alias("timestamp_kind"), windows.attribute_names(F.col("attributes")).alias("target_file_attributes"), F.col("attributes").alias("target_file_attributes_raw"),
        F.lpad(F.hex("serial"), 8, "0").alias("volume_serial_number"), windows.drive_type(F.col("drive").cast("int")).alias("drive_type"), F.col("drive").alias("drive_type_code"),
        F.col("app_id"), F.when(F.col("app_id").isNotNull(), windows.application(F.col("app_id"))).alias("application"), F.col("stream_name"),
    )


def events(files: DataFrame, case_id: str = "") -> DataFrame:
    """Up to three events per shortcut: created, accessed, modified; a time of 0 is none, and a shortcut file without one an error."""
    rows = flat(files)
    times = F.array(*[F.struct(F.lit(t).alias("event_type"), F.lit(k).alias("kind"), F.col(c).alias("ticks"), F.lit(i).alias("n")) for i, (t, k, c) in enumerate((("file_created", "creation", "created"), ("file_access", "access", "accessed"), ("file_modified", "modification", "modified")))])
    kept = F.filter(times, lambda t: t["ticks"] != 0)
    kept = F.when((F.size(kept) > 0) | F.col("app_id").isNotNull(), kept).otherwise(F.raise_error(F.concat(F.lit("shortcut without a time: "), "source_artifact")).cast(kept_type()))
    rows = rows.withColumn("t", F.explode(kept))
    jump = F.col("app_id").isNotNull()
    none = F.lit("")
    return rows.select(
        F.lit(case_id).alias("case_id"), F.col("t.event_type").alias("event_type"), timestamps.filetime(F.col("t.ticks")).alias("timestamp_utc"), F.col("t.ticks").cast("string").alias("raw_timestamp"), "source_artifact",
        F.when(jump, F.lit(JUMP[0])).otherwise(F.lit(LNK[0])).alias("parser_name"), F.when(jump, F.lit(JUMP[1])).otherwise(F.lit(LNK[1])).alias("parser_version"),
        F.lit(None).cast("string").alias("device_id"), none.alias("serial_number"), none.alias("vendor"), none.alias("product"), none.alias("friendly_name"),
        F.col("target_path").alias("file_path"), F.col("size").alias("file_size_bytes"), F.to_json(details(F.col("t.kind"))).alias("details"), (F.col("entry") * 3 + F.col("t.n")).alias("ingest_ord"),
    )


def kept_type() -> str:
    return "array<struct<event_type:string,kind:string,ticks:decimal(20,0),n:int>>"
