"""Exports read in ranges, predicates decided in the reader, and records that may not be skipped."""

import io
import json
import random

import pyarrow as pa
import pytest

from tests.unit.test_sources import data, event
from tracewell.sources import event_xml, exports, intake


def test_ranges_hold_each_line_once(monkeypatch):
    monkeypatch.setattr(exports, "READ", 16)
    rng = random.Random(1)
    for _ in range(500):
        body = b"".join(rng.choice([b"", b"a", b"bb" * rng.randrange(20), b"x\r", b"  "]) + b"\n" for _ in range(rng.randrange(12))) + rng.choice([b"", b"tail"])
        want, at = [], 0
        for line in body.split(b"\n"):
            want += [(at, line.rstrip(b"\r"))] if line.strip() else []
            at += len(line) + 1
        size = rng.randrange(1, 30)
        assert [x for s in range(0, len(body), size) for x in exports.lines(pa.PythonFile(io.BytesIO(body), "r"), s, min(s + size, len(body)))] == want


def test_one_export_is_many_tasks(spark, tmp_path):
    at = lambda i: f"2026-03-01T09:{i // 60 % 60:02d}:{i % 60:02d}.0000000Z"
    kinds = [lambda i: event(event_xml.DFU, 2003, data(DeviceInstanceId=f"USB\\{i}"), time=at(i)), lambda i: event(event_xml.SECURITY, 4663, data(ObjectType="File", ObjectName=f"E:\\{i}" + "x" * (i % 700)), time=at(i)), lambda i: event("Other", i, time=at(i))]
    records = [kinds[i % 3](i) for i in range(3000)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.events.xml").write_text("\n".join(records))
    (tmp_path / "_b.EVENTS.XML").write_text(records[0] + "\r\n\r\n" + records[1])
    read = lambda **options: exports.exported(spark, exports.EventExports, str(tmp_path), **options)
    whole = sorted((r.source_artifact, r.record_ord, r.record) for r in read().collect())
    assert len(whole) == 3002 and whole[0][0] == "_b.EVENTS.XML" and {w[0] for w in whole[2:]} == {"sub/a.events.xml"}
    for size in (10_000, 77_777, 1 << 20):
        got = read(partBytes=size)
        assert sorted((r.source_artifact, r.record_ord, r.record) for r in got.collect()) == whole
        assert got.rdd.getNumPartitions() > (50 if size == 10_000 else 0)
    some = read(partBytes=10_000).where(f"provider = '{event_xml.DFU}' AND event_id IN ('2003', '1')")
    assert some.count() == 1001
    got = event_xml.read(spark, str(tmp_path), partBytes=10_000)
    assert got.groupBy("event_type").count().orderBy("event_type").collect() == [("file_access", 1001), ("usb_insert", 1001)]


def test_predicates_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringStartsWith

    reader = exports.ExportReader({"path": "x"}, exports.VALUE_EXPORT, exports.value_head, ("key_path",))
    left = list(reader.pushFilters([StringStartsWith(("key_path",), "A\\"), IsNotNull(("key_path",)), In(("key_path",), ("A\\b", "C")), GreaterThan(("record_ord",), 5), EqualTo(("record",), "r")]))
    assert [type(f) for f in left] == [GreaterThan, EqualTo] and reader._wanted(("A\\b",)) and not reader._wanted(("C",)) and not reader._wanted(("A\\c",))


@pytest.mark.parametrize("line", ["<Event", event("Other", 1, time=""), "<Event><System/></Event>", event("Other", 1) + "x"])
def test_broken_records_are_errors_whatever_is_asked(spark, tmp_path, line):
    (tmp_path / "a.events.xml").write_text(event("Other", 1) + "\n" + line)
    with pytest.raises(Exception, match="a.events.xml, byte"):
        exports.exported(spark, exports.EventExports, str(tmp_path)).where("provider = 'none'").count()


def test_values(spark, tmp_path):
    (tmp_path / "S.values.jsonl").write_text("\n".join(json.dumps({"key_path": k, "value_int": i}) for i, k in enumerate(["A\\b", "A\\c", "B"])))
    read = lambda: exports.exported(spark, exports.ValueExports, str(tmp_path))
    assert read().count() == 3 and read().where("key_path LIKE 'A%'").count() == 2
    for line in ("no json", "[1]", '{"value_int": 1}'):
        (tmp_path / "S.values.jsonl").write_text(line)
        with pytest.raises(Exception, match="S.values.jsonl, byte 0"):
            read().count()
    assert exports.exported(spark, exports.ValueExports, str(tmp_path), suffix=".none").count() == 0


def test_times_without_an_offset_are_errors(spark, tmp_path):
    (tmp_path / "a.events.xml").write_text(event(event_xml.DFU, 2003, data(DeviceInstanceId="d"), time="2026-01-01T12:00:00"))
    with pytest.raises(Exception, match="with an offset"):
        event_xml.read(spark, str(tmp_path)).collect()


def test_listing_of_deep_and_wide_folders(spark, tmp_path):
    names = [f"wide/f{i}" for i in range(300)] + ["/".join("abcdef"[: k + 1]) + "/x.txt" for k in range(6)] + ["_hidden/.y", ".z"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "wide/loop").symlink_to(tmp_path)
    (tmp_path / "link").symlink_to(tmp_path / ".z")
    found = {r.rel_path: r.size_bytes for r in intake.listed(spark, str(tmp_path)).collect()}
    assert found == {n: len(n) for n in names} | {"link": 2}


def test_many_small_ranges_are_few_tasks(spark, tmp_path):
    """ranges stay small where that is asked for, but tasks do not grow in number with the export."""
    lines = [json.dumps({"key_path": f"Select\\{i}"}) for i in range(6000)]
    (tmp_path / "a.values.jsonl").write_text("\n".join(lines))
    read = exports.exported(spark, exports.ValueExports, str(tmp_path), partBytes=16)
    reader = exports.ValueExports({"path": str(tmp_path), "partbytes": "16"}).reader(None)
    parts = reader.partitions()
    assert len(parts) <= 2 * exports.PARTS and max(r.end - r.start for p in parts for r in p.ranges) == 16
    assert read.count() == read.select("key_path").distinct().count() == 6000
