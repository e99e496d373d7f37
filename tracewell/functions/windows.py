"""Windows names, paths and codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the formats' codes.
ATTRIBUTES = {0x1: "read_only", 0x2: "hidden", 0x4: "system", 0x10: "directory", 0x20: "archive", 0x40: "device", 0x80: "normal", 0x100: "temporary", 0x200: "sparse_file", 0x400: "reparse_point", 0x800: "compressed", 0x1000: "offline", 0x2000: "not_content_indexed", 0x4000: "encrypted"}
DRIVES = {0: "unknown", 1: "no_root_directory", 2: "removable", 3: "fixed", 4: "remote", 5: "cdrom", 6: "ramdisk"}
APPLICATIONS = {
    "1b4dd67f29cb1962": "Windows Explorer",
    "f01b4d95cf55d32a": "Windows Explorer",
    "918e0ecb43d17e23": "Notepad",
    "5b0a6ed0f523a518": "Microsoft Word",
    "b8ab77100df80ab2": "Microsoft Excel",
    "28c8b86deab549a1": "Internet Explorer",
    "5a4bc032130dfcde": "Mozilla Firefox",
    "74d7f43c1561fc1c": "Microsoft Edge",
}


def _lookup(codes: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])


def suffix(path: Column) -> Column:
    """Last suffix of a Windows path's name, lower case; '' for none. A name that only starts with a dot has none."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z]:", ""), r"[\\/]+$", "")
    name = F.regexp_extract(bare, r"([^\\/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.][^\\/]*?(\.[^.\\/]+)$", 1))


def attribute_names(bits: Column) -> Column:
    return F.filter(F.array(*[F.when(bits.bitwiseAND(m) != 0, F.lit(n)) for m, n in ATTRIBUTES.items()]), lambda x: x.isNotNull())


def drive_type(code: Column) -> Column:
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(_lookup(DRIVES), code), F.lit("unrecognized")))


def application(app_id: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(APPLICATIONS), app_id), F.concat(F.lit("unknown ("), app_id, F.lit(")")))


def device_key(name: Column) -> Column:
    """Class, vendor, product and revision of a key such as Disk&Ven_A&Prod_B_C&Rev_1."""
    part = lambda tag: F.trim(F.replace(F.regexp_extract(name, rf"&{tag}_([^&]*)", 1), F.lit("_"), F.lit(" ")))
    return F.struct(F.regexp_extract(name, "^([^&]*)", 1).alias("device_class"), part("Ven").alias("vendor"), part("Prod").alias("product"), part("Rev").alias("revision"))


def generated_serial(serial: Column) -> Column:
    """Whether Windows made the serial up: its second character is &."""
    return F.coalesce(F.substring(serial, 2, 1) == "&", F.lit(False))


def volume_guid(name: Column) -> Column:
    return F.regexp_extract(name, r"(\{[^}]*\})", 1)


def drive_letter(name: Column) -> Column:
    return F.regexp_extract(name, r"^\\DosDevices\\(.*)$", 1)


def device_of_path(path: Column) -> Column:
    """USBSTOR\\key\\serial of a device path with # or \\ between its parts; null if it names none."""
    parts = F.filter(F.split(path, r"[\\#]"), lambda x: x != "")
    at = F.array_position(F.transform(parts, F.upper), "USBSTOR")
    return F.when((at > 0) & (F.size(parts) >= at + 2), F.concat_ws("\\", F.lit("USBSTOR"), F.try_element_at(parts, (at + 1).cast("int")), F.try_element_at(parts, (at + 2).cast("int"))))


def mounted_target(raw: Column) -> Column:
    """Device path held by a MountedDevices value as UTF-16 text; null if it holds something else."""
    text = F.rtrim(F.regexp_replace(F.decode(raw, "UTF-16LE"), "\u0000+$", ""))
    return F.when((F.octet_length(raw) >= 8) & (F.substring(F.hex(raw), 3, 2) == "00") & text.startswith("\\"), text)
