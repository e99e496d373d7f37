"""A case from its evidence folder to its reports."""

import base64
import json
import struct
from datetime import datetime, timezone

import pytest

from tests.unit.test_sources import data, event, shortcut, ticks
from tracewell.errors import ArtifactError, IntegrityError
from tracewell.operators import reports
from tracewell.plans.config import CaseConfig
from tracewell.plans.evidence import dispatched, examine
from tracewell.sources import event_xml, intake


@pytest.fixture
def folder(tmp_path):
    usb = "ControlSet001\\Enum\\USBSTOR\\Disk&Ven_V&Prod_P&Rev_1\\SERIAL1"
    written = "2026-03-01T08:00:00"
    prop = base64.b64encode(struct.pack("<Q", ticks(2026, 3, 1, 8))).decode()
    values = [
        {"key_path": "Select", "value_name": "Current", "value_int": 1, "value_ord": 0},
        {"key_path": usb, "key_last_write": written, "value_name": "FriendlyName", "value_str": "Stick", "value_ord": 0},
        {"key_path": usb + "\\Properties\\{83da6326-97a6-4088-9453-a1923f573b29}\\0064", "value_name": "", "value_bytes": prop, "value_ord": 0},
    ]
    at = lambda minute, second=0: f"2026-03-01T09:{minute:02d}:{second:02d}.0000000Z"
    records = [
        event(event_xml.DFU, 2003, data(DeviceInstanceId="USB\\A"), time=at(0)),
        event(event_xml.SECURITY, 4663, data(ObjectType="File", ObjectName="E:\\dump.sql", ProcessName="x.exe"), time=at(0, 10)),
        event(event_xml.DFU, 2102, data(DeviceInstanceId="USB\\A"), time=at(30)),
    ]
    root = tmp_path / "evidence"
    for name, body in {"logs/a.events.xml": "\n".join(records), "SYSTEM.values.jsonl": "\n".join(map(json.dumps, values)), "notes.txt": "n", "deep/er/.hidden": ""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / "r.lnk").write_bytes(shortcut(access=ticks(2026, 3, 1, 9, 5)))
    return root


def test_examine(spark, folder, tmp_path):
    out = tmp_path / "out"
    got = examine(spark, CaseConfig(str(folder), str(out), "c1", "me"))
    assert sorted(r.rel_path for r in got.artifacts.collect()) == ["SYSTEM.values.jsonl", "deep/er/.hidden", "logs/a.events.xml", "notes.txt", "r.lnk"]
    kinds = sorted((r.parser_name, r.event_type) for r in got.case.events.collect())
    assert kinds == [("evtx_parser", "file_access"), ("evtx_parser", "usb_insert"), ("evtx_parser", "usb_remove"), ("lnk_parser", "file_access"), ("registry_parser", "usb_device_first_install")]
    (f,) = got.case.findings.collect()
    assert (f.total_score, f.confidence_level) == (25 + 15 + 15, "MEDIUM") and got.verdict.first().verdict == "verified"
    record = {(r.kind, r.name): r.value for r in got.manifest.collect()}
    assert record["case", "examiner"] == "me" and record["setting", "idle_gap"] == "0:15:00" and record["parser", "lnk_parser"] == "1.0.0"
    assert ("case", "started_utc") in record and sum(k == "digest" for k, _ in record) == sum(k == "post_digest" for k, _ in record) == 5
    text = lambda name: "".join(p.read_text() for p in (out / name).glob("part-*"))
    assert "<li>logs/a.events.xml</li>" in text("report_html") and '"ProcessName":"x.exe"' in text("findings_json") and '"parser_version":"1.0.0"' in text("findings_json")
    assert "<h2>Limitations</h2>" in text("report_frame") and "<td>artifacts</td><td>5</td>" in text("report_frame") and "<td>digest</td>" in text("report_frame")
    assert got.counts == {"findings": 1, "artifacts": 5, "artifacts_after": 5, "events": 5}
    assert record["case", "integrity_verdict"] == "verified" and record["case", "tool_name"] == reports.TOOL
    lines = text("findings_csv").splitlines()
    assert sum(line.startswith("session_id,") for line in lines) == 1 and lines[0].startswith("session_id,") and len(lines) == 4
    names = [json.loads(line)["name"] for line in text("case_manifest").splitlines() if '"kind":"digest"' in line]
    assert names == ["SYSTEM.values.jsonl", "deep/er/.hidden", "logs/a.events.xml", "notes.txt", "r.lnk"]


def test_no_reports_without_the_gate(spark, folder, tmp_path):
    examine(spark, CaseConfig(str(folder), str(tmp_path / "none"), "c1", "me"), write_reports=False)
    assert not (tmp_path / "none").exists()


def test_verification(spark, folder):
    found = intake.artifacts(spark, str(folder))
    before = spark.createDataFrame(found.collect(), found.schema)
    none = spark.createDataFrame([], "parser_name string, parser_version string")
    record = reports.manifest("c", "e", before, none, ended=datetime(2026, 1, 1, tzinfo=timezone.utc))
    assert reports.verified(record, found).first().verified is True and intake.confirmed(before, found).count() == 5
    (folder / "notes.txt").write_text("changed")
    assert reports.verified(record, intake.artifacts(spark, str(folder))).first().verified is False
    with pytest.raises(Exception, match="digest mismatch: notes.txt"):
        intake.confirmed(before, intake.artifacts(spark, str(folder))).collect()
    (folder / "notes.txt").unlink()
    assert reports.verified(record, intake.artifacts(spark, str(folder))).first().verified is False
    with pytest.raises(Exception, match="nothing to verify"):
        reports.verified(record.where("kind <> 'digest'"), found).collect()


def test_unparsed_evidence_has_no_events(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert dispatched(intake.artifacts(spark, str(tmp_path)), str(tmp_path), "c").count() == 0


def test_empty_evidence_is_an_error(spark, tmp_path):
    (tmp_path / "evidence").mkdir()
    with pytest.raises(ArtifactError, match="no evidence"):
        examine(spark, CaseConfig(str(tmp_path / "evidence"), str(tmp_path / "out"), "c1", "me"))
    assert not (tmp_path / "out").exists()


def test_parsers_without_events_are_named(spark, tmp_path):
    (tmp_path / "a.events.xml").write_text(event("Other", 1))
    (tmp_path / "limitations.md").write_text("They stole it")
    got = examine(spark, CaseConfig(str(tmp_path), str(tmp_path.parent / "out-none"), "c1", "me"))
    assert [(r.name, r.value) for r in got.manifest.where("kind = 'parser'").collect()] == [("evtx_parser", "1.0.0")] and got.counts["events"] == 0


def published(out):
    return {p.relative_to(out).parts[0]: "".join(q.read_text() for q in sorted(p.glob("part-*"))) for p in sorted(out.iterdir())}


def test_a_failing_case_publishes_nothing(spark, folder, tmp_path):
    """Neither where a line claims too much nor where evidence has changed; what was published before stays, and runs with fixed times agree."""
    out, now = tmp_path / "out", datetime(2026, 5, 1, tzinfo=timezone.utc)
    run = lambda **more: examine(spark, CaseConfig(str(folder), str(out), "c1", "me"), started=now, ended=now, **more)
    with pytest.raises(Exception, match="overstates"):
        run(limitations=f"They stole it; {reports.DISCLAIMER}")
    assert not out.exists() and not list(tmp_path.glob("*.staged-*"))
    run()
    first = published(out)
    assert set(first) == {*reports.REPORTS, reports.FRAME, "case_manifest"} and all(first.values())
    with pytest.raises(Exception, match="disclaimer"):
        run(limitations="nothing")
    run()
    assert published(out) == first and not list(tmp_path.glob("*.staged-*"))


def test_changed_evidence(spark, folder, tmp_path, monkeypatch):
    out, real = tmp_path / "out", intake.artifacts
    seen = []

    def changing(*args, **more):
        if seen:
            (folder / "notes.txt").write_text("changed")
        seen.append(1)
        return real(*args, **more)

    monkeypatch.setattr(intake, "artifacts", changing)
    with pytest.raises(IntegrityError, match="changed"):
        examine(spark, CaseConfig(str(folder), str(out), "c1", "me"))
    assert not out.exists()
    seen.clear()
    (folder / "notes.txt").write_text("n")
    got = examine(spark, CaseConfig(str(folder), str(out), "c1", "me"), strict=False)
    assert got.verdict.first().verdict == "failed" and '"name":"integrity_verdict","value":"failed"' in published(out)["case_manifest"]


def test_disclaimer_and_wording(spark):
    said = lambda text: spark.createDataFrame([(text,)], "t string").select(reports.careful(reports.F.col("t"))).collect()
    assert said(f"approved, {reports.DISCLAIMER}")
    for text, fault in ((f"They stole it; {reports.DISCLAIMER}", "wording"), ("nothing said", "disclaimer")):
        with pytest.raises(Exception, match=fault):
            said(text)
