"""Artifacts built here, byte by byte, and what the sources read from them."""

import struct
from datetime import datetime

import pytest

from tracewell.sources import event_xml, intake, registry, shortcuts

NS = 'xmlns="http://schemas.microsoft.com/win/2004/08/events/event"'


def event(provider, eid, body="", time="2026-01-01T12:00:00.0000000Z", extra=""):
    created = f'<TimeCreated SystemTime="{time}"/>' if time else ""
    return f'<Event {NS}><System><Provider Name="{provider}"/><EventID>{eid}</EventID>{created}{extra}</System>{body}</Event>'


def data(**values):
    return "<EventData>" + "".join(f'<Data Name="{k}">{v}</Data>' for k, v in values.items()) + "</EventData>"


def read_xml(spark, *xml):
    return event_xml.events(spark.createDataFrame([("a.evtx", i, x) for i, x in enumerate(xml)], "source_artifact string, record_ord long, xml string")).orderBy("ingest_ord").collect()


def test_event_xml(spark):
    got = read_xml(
        spark,
        event(event_xml.DFU, 2003, data(DeviceInstanceId="USB\\A"), extra="<EventRecordID>42</EventRecordID>"),
        event(event_xml.DFU, 2102, '<UserData><X xmlns="urn:other"><InstanceId>USB\\B</InstanceId><DeviceId>no</DeviceId></X></UserData>'),
        event(event_xml.PNP, 20001, data(DeviceId="USB\\C")),
        event(event_xml.SECURITY, 4663, data(ObjectType="File", ObjectName="E:\\secret.txt", ProcessId="0x1")),
        event(event_xml.SECURITY, 4663, data(ObjectType="Key", ObjectName="HKLM")),
        event("Other", 1),
    )
    assert [(r.event_type, r.device_id, r.file_path) for r in got] == [("usb_insert", "USB\\A", None), ("usb_remove", "USB\\B", None), ("usb_device_install", "USB\\C", None), ("file_access", None, "E:\\secret.txt")]
    assert got[0].timestamp_utc == datetime(2026, 1, 1, 12) and '"record_id":"42"' in got[0].details and '"ProcessId":"0x1"' in got[3].details


@pytest.mark.parametrize("xml", [event("Other", 1, time=""), event(event_xml.DFU, 2003), event(event_xml.SECURITY, 4663, data(ObjectName="x")), "<Event", event(event_xml.DFU, 2003, '<EventData><Data Name="A">1</Data><Data Name="A">2</Data><Data Name="DeviceInstanceId">d</Data></EventData>')])
def test_event_xml_errors(spark, xml):
    with pytest.raises(Exception):  # noqa: B017
        read_xml(spark, xml)


def ticks(*when):
    return int((datetime(*when) - datetime(1601, 1, 1)).total_seconds()) * 10_000_000


def values(spark, *rows):
    written = datetime(2026, 3, 3, 11)
    full = [(r[0], r[1], written, i, *(list(r[2:]) + [None] * (6 - len(r)))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "source_artifact string, key_path string, key_last_write timestamp, value_ord int, value_name string, value_str string, value_int long, value_bytes binary")


def test_registry(spark):
    usb = "ControlSet001\\Enum\\USBSTOR\\Disk&Ven_Synthetic&Prod_Test_Stick&Rev_1.0"
    times = lambda n, *t: ("SYSTEM", f"{usb}\\FAKESERIAL001\\Properties\\{registry.PROPERTIES}\\{n}", "", None, None, bytearray(struct.pack("<Q", ticks(*t) if t else 0)))
    target = "\\??\\USBSTOR#Disk&Ven_Synthetic#FAKESERIAL001#{g}".encode("utf-16-le")
    got = registry.events(
        values(
            spark, ("SYSTEM", "Select", "Current", None, 1), ("SYSTEM", f"{usb}\\FAKESERIAL001", "FriendlyName", "Synthetic Stick"), times("0064", 2026, 3, 1, 8), times("0066", 2026, 3, 2, 9, 30), times("0067"),
            ("SYSTEM", f"{usb}\\7&1a2b3c4d&0"), ("SYSTEM", "MountedDevices", "\\DosDevices\\E:", None, None, bytearray(target)), ("SYSTEM", "MountedDevices", "\\DosDevices\\C:", None, None, bytearray(b"abcdefghijkl")),
            ("SOFTWARE", registry.PORTABLE + "\\SWD#X#_??_USBSTOR#Disk#S9#{g}"), ("SOFTWARE", registry.PORTABLE + "\\SWD#USBSTOR#Disk#S9#{g}", "FriendlyName", "BACKUP"),
            ("NTUSER", registry.MOUNTPOINTS + "\\{11111111-2222-3333-4444-555555555555}"), ("NTUSER", registry.MOUNTPOINTS + "\\E"),
        )
    ).collect()
    kinds = sorted(((r.source_artifact, r.event_type, r.device_id) for r in got), key=str)
    one, two = "USBSTOR\\Disk&Ven_Synthetic&Prod_Test_Stick&Rev_1.0\\FAKESERIAL001", "USBSTOR\\Disk&Ven_Synthetic&Prod_Test_Stick&Rev_1.0\\7&1a2b3c4d&0"
    assert kinds == sorted([("SYSTEM", "usb_device_first_install", one), ("SYSTEM", "usb_insert", one), ("SYSTEM", "usb_device_registered", two), ("SYSTEM", "usb_drive_letter_assigned", "USBSTOR\\Disk&Ven_Synthetic\\FAKESERIAL001"), ("SOFTWARE", "usb_device_registered", "USBSTOR\\Disk\\S9"), ("NTUSER", "usb_user_mount", None), ("NTUSER", "usb_user_mount", None)], key=str)
    insert = next(r for r in got if r.event_type == "usb_insert")
    assert insert.timestamp_utc == datetime(2026, 3, 2, 9, 30) and insert.product == "Test Stick" and insert.friendly_name == "Synthetic Stick" and "records_most_recent_only" in insert.details
    for rows, fault in (([("ODD", "Nothing")], "unsupported hive: ODD"), ([("SYSTEM", "MountedDevices", "x")], "no control set in SYSTEM"), ([("SYSTEM", "Select", "Current", None, 0)], "no control set in SYSTEM")):
        with pytest.raises(Exception, match=fault):
            registry.events(values(spark, *rows)).collect()


def shortcut(path="E:\\Evidence\\plans.txt", flags=0x2 | 0x80, access=133486419060000000):
    base = path.encode("cp1252") + b"\0"
    volume = struct.pack("<4I", 17, 2, 0xA1B2C3D4, 16) + b"\0"
    info = struct.pack("<7I", 28 + len(volume) + len(base) + 1, 28, 1, 28, 28 + len(volume), 0, 28 + len(volume) + len(base)) + volume + base + b"\0"
    return shortcuts.SIGNATURE + struct.pack("<IIQQQI", flags, 0x21, 0, access, 0, 123456) + bytes(20) + info


def files(spark, *items):
    return spark.createDataFrame([(n, bytearray(b)) for n, b in items], "source_artifact string, content binary")


def test_shortcut(spark):
    (r,) = shortcuts.events(files(spark, ("a.lnk", shortcut()))).collect()
    assert (r.event_type, r.file_path, r.file_size_bytes, r.timestamp_utc) == ("file_access", "E:\\Evidence\\plans.txt", 123456, datetime(2024, 1, 2, 4, 5, 6))
    for part in ('"target_file_attributes":["read_only","archive"]', '"volume_serial_number":"A1B2C3D4"', '"drive_type":"removable"'):
        assert part in r.details
    for bad in (shortcut()[:80], b"x" * 100, shortcut(access=0)):
        with pytest.raises(Exception):  # noqa: B017
            shortcuts.events(files(spark, ("a.lnk", bad))).collect()


def compound(streams):
    """A compound file with all streams in regular sectors (cutoff 0)."""
    bodies, entries, start = [], [("Root Entry", 5, 0xFFFFFFFE, 0)], 2
    fat = [0xFFFFFFFD, 0xFFFFFFFE]
    for name, body in streams:
        n = max(1, -(-len(body) // 512))
        entries.append((name, 2, start, len(body)))
        fat += [start + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
        bodies.append(body.ljust(n * 512, b"\0"))
        start += n
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<8I", 1, 1, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    folder = b"".join(e[0].encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(e[0]) + 2, e[1]) + bytes(49) + struct.pack("<IQ", e[2], e[3]) for e in entries)
    return head + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + folder.ljust(512, b"\0") + b"".join(bodies)


def test_jump_lists(spark):
    custom = b"junk" + shortcut("E:\\a.txt") + b"zz" + shortcuts.SIGNATURE + b"corrupt"
    auto = compound([("DestList", b"d" * 700), ("1", shortcut("E:\\b.txt")), ("3", b"bad")])
    got = shortcuts.events(files(spark, ("5b0a6ed0f523a518.customDestinations-ms", custom), ("0000000000000000.automaticDestinations-ms", auto))).collect()
    assert sorted(r.file_path for r in got) == ["E:\\a.txt", "E:\\b.txt"]
    assert {r.parser_name for r in got} == {"jumplist_parser"} and any('"application":"Microsoft Word"' in r.details for r in got) and any("unknown (0000000000000000)" in r.details for r in got)
    for name, body in (("xyz.customDestinations-ms", custom), ("5b0a6ed0f523a518.customDestinations-ms", b"none"), ("5b0a6ed0f523a518.automaticDestinations-ms", b"none")):
        with pytest.raises(Exception):  # noqa: B017
            shortcuts.events(files(spark, (name, body))).collect()
    with pytest.raises(Exception, match="not a shortcut"):
        shortcuts.events(files(spark, ("a.lnk", b""))).collect()
    wrong = {r.entry: r.fault for r in shortcuts.decoded(shortcuts.carved(files(spark, ("5b0a6ed0f523a518.customDestinations-ms", custom)))).collect()}
    assert wrong[0] is None and wrong[1]


def wide_shortcut(base, tail, at=None):
    """A shortcut whose LinkInfo has wide texts besides narrow ones that say something else, and a relative path."""
    narrow, wide = b"C:\\narrow\0", [x.encode("utf-16-le", "surrogatepass") + b"\0\0" for x in (base, tail)]
    volume = struct.pack("<4I", 17, 3, 0xFFFFFFFF, 16) + b"\0"
    places = [36, 36 + len(volume), 36 + len(volume) + len(narrow), 36 + len(volume) + len(narrow) + 1]
    ends = [places[3], at or places[3] + len(wide[0])]
    body = volume + narrow + b"\0" + wide[0] + wide[1]
    info = struct.pack("<9I", 36 + len(body), 36, 1, places[0], places[1], 0, places[2], *ends) + body
    texts = b"".join(struct.pack("<H", len(t)) + t.encode("utf-16-le") for t in ("a name", "..\\rel.txt"))
    return shortcuts.SIGNATURE + struct.pack("<IIQQQI", 0x1 | 0x2 | 0x4 | 0x8 | 0x80, 0x21, 0, 133486419060000000, 0, 5) + bytes(20) + struct.pack("<H", 4) + b"idid" + info + texts


def test_wide_link_info(spark):
    path = lambda *a: [r.file_path for r in shortcuts.events(files(spark, ("a.lnk", wide_shortcut(*a)))).collect()]
    assert path("E:\\\u4e2d\u6587", "x.txt") == ["E:\\\u4e2d\u6587\\x.txt"] and path("E:\\dir\\", "\\\U0001f600.txt") == ["E:\\dir\\\U0001f600.txt"]
    assert path("E:\\a.txt", "A.TXT") == ["E:\\a.txt"] and path("E:\\\ud83d!", "") == ["E:\\\ufffd!"]
    for at in (20, 5000):
        with pytest.raises(Exception, match="outside itself"):
            path("E:\\a", "b", at)


def test_intake(spark, tmp_path):
    for name, body in {"hives/SYSTEM": b"regf1234", "logs/a.evtx": b"ElfFile\0xx", "r.lnk": bytes.fromhex("4c000000"), "_hidden/.x": b"", "notes.txt": b"n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    found = intake.artifacts(spark, str(tmp_path))
    assert {r.rel_path: r.artifact_type for r in found.collect()} == {"hives/SYSTEM": "registry_hive", "logs/a.evtx": "evtx_log", "r.lnk": "lnk_shortcut", "_hidden/.x": "unknown", "notes.txt": "unknown"}
    assert [r.rel_path for r in intake.in_order(found).collect()][0] == "_hidden/.x"
    before = spark.createDataFrame(found.collect())
    assert intake.compared(before, found).first().verdict == "verified"
    (tmp_path / "notes.txt").write_bytes(b"changed")
    assert intake.compared(before, intake.artifacts(spark, str(tmp_path))).first().verdict == "failed"
    (tmp_path / "logs/bad.evtx").write_bytes(b"no")
    with pytest.raises(Exception, match="mislabelled"):
        intake.artifacts(spark, str(tmp_path)).collect()
    assert intake.artifacts(spark, str(tmp_path), strict=False).where("artifact_type = '!evtx_log'").count() == 1
    with pytest.raises(NotADirectoryError):
        intake.listed(spark, str(tmp_path / "none"))


def test_a_record_is_parsed_once(spark):
    """no path is evaluated on the text of a record, which would parse it for each; what a record says is the first of each."""
    record = '<Event><System><Provider Guid="x"/><Provider Name=" P&amp;Q "/><EventID Qualifiers="1">20<!-- c -->03</EventID><EventID>9</EventID><TimeCreated SystemTime="t"/></System><EventData><Data>none</Data><Data Name="a">x<b>y</b>z</Data></EventData><EventData><Data Name="c"><![CDATA[<&>]]></Data></EventData><UserData><o:X xmlns:o="u"><o:InstanceId>D<i>1</i></o:InstanceId><DeviceId>D2</DeviceId></o:X></UserData></Event>'
    found, data = event_xml.fields(record)
    assert found == {"provider": " P&Q ", "event_id": "2003", "raw": "t", "user_device": "D1"}
    assert data == [{"name": "a", "value": "xyz"}, {"name": "c", "value": "<&>"}]
    one = spark.createDataFrame([(record,)], "xml string")
    paths = ["/Event/System/Provider/@Name", "/Event/System/EventID", "/Event/EventData/Data[@Name='a']", "/Event/EventData/Data[@Name='c']", "(/Event/UserData//*[local-name()='InstanceId' or local-name()='DeviceId'])[1]"]
    assert one.selectExpr(*[f'xpath_string(xml, "{p}") AS p{i}' for i, p in enumerate(paths)]).first() == (" P&Q ", "2003", "xyz", "<&>", "D1")
    rows = event_xml.events(spark.createDataFrame([("a", 1, record)], "source_artifact string, record_ord long, xml string"))
    assert "xpath" not in rows._jdf.queryExecution().optimizedPlan().toString()
