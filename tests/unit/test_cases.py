"""Scenarios and session cases with known results."""

from datetime import datetime, timedelta

import pytest

from tracewell import shared
from tracewell.errors import ConfigError, PathOverlapError
from tracewell.operators import events as E
from tracewell.operators import identity, reports, scoring, sessions
from tracewell.plans.config import CaseConfig, SessionConfig, Thresholds, Weights
from tracewell.plans.pipeline import correlate

T0 = datetime(2026, 3, 1, 9)
DEV = "USB\\VID_1234&PID_5678\\SERIAL001"


def rows(spark, *items, sha=None):
    """(type, minutes, device or path)"""
    out = []
    for i, (kind, minutes, what) in enumerate(items):
        t = T0 + timedelta(minutes=minutes)
        device = kind != E.ACCESS
        out.append(("c", kind, t, t.isoformat(), "System.evtx" if device else "Recent.lnk", "p", "0", what if device else None, "S", "V", "Stick", "", None if device else what, 10, '{"sha256": "%s"}' % sha if sha else "{}", i))
    return spark.createDataFrame(out, E.EVENTS)


def span(spark, *items, **kw):
    got = sessions.reconstruct(rows(spark, *items), **kw).orderBy("start_utc", "device_id").collect()
    return [((r.start_utc - T0).total_seconds() / 60, r.start_observed, (r.end_utc - T0).total_seconds() / 60, r.end_observed) for r in got]


def test_session_boundaries(spark):
    assert span(spark, ("usb_insert", 0, "a"), ("usb_remove", 30, "a")) == [(0, True, 30, True)]
    assert span(spark, ("usb_insert", 0, "a"), config=SessionConfig(timedelta(minutes=20))) == [(0, True, 20, False)]
    assert span(spark, ("usb_remove", 45, "a"), config=SessionConfig(timedelta(minutes=10))) == [(35, False, 45, True)]
    assert span(spark, ("usb_insert", 60, "a"), ("usb_insert", 0, "a")) == [(0, True, 60, False), (60, True, 75, False)]
    assert span(spark, ("usb_insert", 0, "a"), ("usb_remove", 5, "a"), ("usb_remove", 9, "a")) == [(-6, False, 9, True), (0, True, 5, True)]
    assert span(spark, ("x", 0, "a"), ("y", 3, "a"), inserts=("x",), removes=("x", "y")) == [(0, True, 3, True)]
    assert span(spark, (E.ACCESS, 0, "f")) == []
    got = sessions.reconstruct(rows(spark, ("usb_insert", 0, "a"))).first()
    assert got.session_id == "a:2026-03-01T09:00:00+00:00" and got.duration_us == 15 * 60 * 10**6
    with pytest.raises(Exception, match="no device"):
        sessions.reconstruct(rows(spark, ("usb_insert", 0, " "))).collect()


@pytest.mark.parametrize("bucket", [None, timedelta(minutes=7), timedelta(days=1)])
def test_files_join_every_open_session(spark, bucket):
    e = rows(spark, ("usb_insert", 0, "a"), ("usb_remove", 40, "a"), ("usb_insert", 10, "b"), ("usb_remove", 50, "b"), (E.ACCESS, 20, "both"), (E.ACCESS, 180, "none"), (E.ACCESS, 40, "edge"), (E.ACCESS, 10, "edge2"), ("file_created", 20, "no"))
    found = sessions.reconstruct(e)
    inside = sessions.files_in_sessions(found, e, bucket)
    assert sorted((r.device_id, r.file_path) for r in inside.collect()) == [("a", "both"), ("a", "edge"), ("a", "edge2"), ("b", "both"), ("b", "edge"), ("b", "edge2")]
    assert sessions.without_files(found, inside).count() == 0
    if bucket:
        assert "NestedLoop" not in inside._jdf.queryExecution().executedPlan().toString()


SCENARIOS = {
    "normal": ([("usb_insert", 0, DEV), ("usb_remove", 125, DEV), (E.ACCESS, 120, "E:\\notes.txt")], [(0, "NONE")]),
    "theft": ([("usb_insert", 0, DEV), ("usb_remove", 10, DEV), (E.ACCESS, 5 / 60, "E:\\db_dump.sql"), (E.ACCESS, 12 / 60, "E:\\keys.pem")], [(95, "HIGH")]),
    "archive": ([("usb_insert", 0, DEV), ("usb_remove", 15, DEV), (E.ACCESS, 10 / 60, "E:\\project_export.zip"), (E.ACCESS, 3, "E:\\project_export.zip")], [(70, "HIGH")]),
    "unrelated": ([(E.ACCESS, 0, "C:\\quarterly_report.docx")], []),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(spark, name):
    items, want = SCENARIOS[name]
    got = correlate(rows(spark, *items))
    assert [(r.total_score, r.confidence_level) for r in got.findings.collect()] == want


def test_all_rules(spark):
    w = Weights(protected_directories=("C:\\Projects\\confidential",))
    items = [("usb_insert", 0, DEV), ("usb_remove", 60, DEV), (E.ACCESS, 10 / 60, "C:\\Projects\\Confidential\\a.docx"), (E.ACCESS, 10, "c:/projects/confidential/dump.SQL"), (E.ACCESS, 2, "x.env")]
    got = correlate(rows(spark, *items, sha="AB"), weights=w, hashes=spark.createDataFrame([("ab",)], "sha256 string"))
    fired = {}
    for r in got.contributions.collect():
        fired.setdefault(r.rule, []).append(r.explanation)
    assert {k: len(v) for k, v in fired.items()} == {"activity_within_30s": 1, "activity_within_5min": 1, "protected_directory": 2, "sensitive_extension": 2, "destination_hash_match": 3, "multiple_confidential_files": 1}
    assert fired["activity_within_30s"] == ["'C:\\Projects\\Confidential\\a.docx' was accessed 10s after the session started, within the 30-second window."]
    f = got.findings.first()
    assert (f.total_score, f.confidence_level) == (25 + 15 + 40 + 30 + 150 + 15, "CONFIRMED")


def test_settings():
    for bad in (lambda: SessionConfig(timedelta(0)), lambda: Weights(sensitive_extension=-1), lambda: Thresholds(60, 60), lambda: CaseConfig("/a", "/b", " ", "x")):
        with pytest.raises(ConfigError):
            bad()
    for a, b in (("/a", "/a"), ("/a", "/a/b"), ("/a/b", "/a")):
        with pytest.raises(PathOverlapError):
            CaseConfig(a, b, "id", "me")


def test_validation_and_merge(spark):
    e = rows(spark, ("usb_insert", 0, DEV), (E.ACCESS, 1, "f"))
    assert E.violations(e).count() == 0 and E.validated(e).count() == 2
    bad = e.withColumn("parser_name", e.parser_version.substr(2, 0))
    assert E.validated(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="parser_name"):
        E.validated(bad).collect()
    assert [r.ingest_ord for r in E.merged(e.where("ingest_ord = 1"), e.where("ingest_ord = 0")).collect()] == [0, 1]


def test_reports(spark, tmp_path):
    got = correlate(rows(spark, *SCENARIOS["theft"][0], ("usb_insert", 300, 'a,"b')))
    lines = []
    for run in ("one", "two"):
        got.write_reports(str(tmp_path / run))
        lines.append({k: "".join(p.read_text() for p in sorted((tmp_path / run / k).glob("part-*"))) for k in ("findings_csv", "timeline_csv", "findings_json", "report_html")})
    assert lines[0] == lines[1]
    assert lines[0]["findings_csv"].count("\n") == 1 + 5 + 1 and ',NONE,No scoring rule fired for this session.,,,,' in lines[0]["findings_csv"] and '"a,""b"' in lines[0]["findings_csv"]
    assert reports.DISCLAIMER in lines[0]["report_html"]
    wrong = got.findings.selectExpr("* EXCEPT (confidence_reason)", "'He stole it' AS confidence_reason")
    with pytest.raises(Exception, match="wording"):
        reports.html_fragments(wrong, got.devices).collect()


def test_digests_of_file_events_alone_meet_the_table(spark, monkeypatch):
    """Whatever the filter lets through, hits are those of a set; only texts are digests, and device events are not shuffled."""
    details = ['{"sha256": "%s"}' % d for d in ("AA", "bb", "zz", "")] + ['{"sha256": 12}', '{"sha256": ["aa"]}', '{"sha256": null}', "{}", "no json", None]
    items = [(i, kind, d) for i, (kind, d) in enumerate((kind, d) for kind in (E.ACCESS, E.INSERT) for d in details)] + [(100 + i, E.ACCESS, '{"sha256": "h%d"}' % i) for i in range(500)]
    events = spark.createDataFrame(items, "ingest_ord long, event_type string, details string")
    known = [("aa",), ("bb",), ("12",), ("aa",), (None,)] + [(f"h{i}",) for i in range(0, 500, 3)]
    for bits in (1 << 15, 64):
        monkeypatch.setattr(shared, "LEAST_BITS", bits)
        monkeypatch.setattr(shared, "MOST_BITS", bits)
        marked = scoring.with_hash_hits(events, spark.createDataFrame(known, "sha256 string"))
        got = {r.ingest_ord for r in marked.where("hash_hit").collect()}
        assert got == {0, 1} | {100 + i for i in range(0, 500, 3)} and marked.count() == len(items)
    assert scoring.with_hash_hits(events, spark.createDataFrame([], "sha256 string")).where("hash_hit").count() == 0


def test_identity_across_artifacts(spark):
    made = [
        (1, "c", E.INSERT, "USB\\VID_1\\SER1", None, "{}"), (2, "c", "usb_device_registered", "USBSTOR\\Disk\\SER1&0", None, "{}"),
        (3, "c", "usb_drive_letter_assigned", "USBSTOR\\Disk\\ser1&0", None, '{"drive_letter": "E:", "volume_guid": "{AB}"}'), (4, "c", "usb_user_mount", None, None, '{"volume_guid": "{ab}", "mount_point_entry": "{ab}"}'),
        (5, "c", E.ACCESS, None, "e:\\x.txt", "{}"), (6, "c", E.ACCESS, None, "C:\\y.txt", "{}"), (7, "d", E.ACCESS, None, "e:\\x.txt", "{}"), (8, "c", E.INSERT, "USB\\VID_1\\7&1a&0", None, "{}"), (9, "c", E.REMOVE, "USBSTOR\\Disk\\7&1a&0", None, "{}"),
        (10, "c", "usb_user_mount", None, None, '{"mount_point_entry": "E", "mount_point_kind": "drive_letter_or_share"}'), (11, None, E.INSERT, "USB\\X\\S9", None, None), (12, "c", "x", None, None, "no json"), (13, "c", E.ACCESS, None, "\\\\share\\f", "{}"),
    ]
    events = spark.createDataFrame(made, "ingest_ord long, case_id string, event_type string, device_id string, file_path string, details string")
    got = {r.ingest_ord: r.identity for r in identity.with_identity(events).collect()}
    one = "USBSTOR\\Disk\\SER1&0"
    assert len(got) == 13 and {got[i] for i in (1, 2, 3, 4, 5, 10)} == {min(one, "USB\\VID_1\\SER1")}
    # a serial that Windows made up links nothing; other cases, letters and shares are no one's
    assert got[8] == "USB\\VID_1\\7&1a&0" and got[9] == "USBSTOR\\Disk\\7&1a&0" and got[11] == "USB\\X\\S9" and {got[i] for i in (6, 7, 12, 13)} == {None}
