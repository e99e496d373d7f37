"""lines of reports have their parts before they are made: no report is sorted or shuffled as text, and a long session is cut."""

import json

import pyarrow as pa
import pytest

from tests.unit.test_cases import DEV, rows
from tracewell.errors import ReportError
from tracewell.operators import events as E
from tracewell.operators import placing, publishing, reports
from tracewell.plans.pipeline import correlate
from tracewell.shared import written

OTHER = "USB\\OTHER"


@pytest.fixture
def case(spark, monkeypatch):
    for name, value in (("LEAST", 16), ("MOST", 16), ("OWN", 3), ("BLOCK", 4)):
        monkeypatch.setattr(placing, name, value)
    names = ["a.sql", 'b,"x".pem', "c.txt", "d.env", "e.zip"]
    files = [(E.ACCESS, i / 4, f"E:\\{i % 3}{names[i % 5]}") for i in range(120)]
    items = [("usb_insert", 0, DEV), ("usb_remove", 29, DEV), ("usb_insert", 1, OTHER), ("usb_remove", 2, OTHER), ("usb_insert", 3, OTHER), ("usb_remove", 20, OTHER), ("usb_insert", 300, 'a,"b')]
    return correlate(rows(spark, *items, *files))


def test_parts_in_order_are_the_reports(spark, case, tmp_path):
    case.write_reports(str(tmp_path))
    read = lambda name: [r.value for part in sorted((tmp_path / name).glob("part-*")) for r in spark.read.text(str(part)).collect()]
    assert len(list((tmp_path / "findings_csv").iterdir())) > 10
    explained = case.explained
    want = reports.findings_rows(explained).orderBy("order.case_id", "order.start_utc", "order.device_id", "order.session_id", "order.ordinal", "order.last", "order.file_ord", "order.rule_idx").drop("order")
    line = lambda df: [r.line for r in df.select(reports.F.to_csv(reports.F.struct(*df.columns), reports.CSV).alias("line")).collect()]
    assert read("findings_csv") == [",".join(reports.FINDINGS_COLUMNS), *line(want)]
    timeline = case.timeline.orderBy("timestamp_utc", "session_id", "source_artifact", *case.timeline.columns)
    assert read("timeline_csv") == [",".join(reports.TIMELINE_COLUMNS), *line(timeline)]
    found = [json.loads(x) for x in read("findings_json")]
    kinds = ["finding" if "score" in d else "event" if "event_type" in d else "contribution" for d in found]
    assert (kinds.count("finding"), kinds.count("event"), kinds.count("contribution")) == (case.sessions.count(), case.files.count(), case.contributions.count())
    sections = read("report_html")
    order = [r.session_id for r in case.sessions.orderBy("start_utc", "device_id").collect()]
    assert list(dict.fromkeys(d["session_id"] for d in found)) == order and len(sections) == len(order)
    for r in case.files.select("session_id", reports.event_document().alias("d")).limit(20).collect():
        assert r.d in {x for x, k in zip(read("findings_json"), kinds) if k == "event"}
    cited = {a for r in case.contributions.where("file_ord IS NOT NULL").select("source_artifacts").collect() for a in r.source_artifacts}
    assert all(f"<li>{a}</li>" in sections[order.index(found[0]["session_id"])] for a in cited)


def test_pairs_are_not_shuffled(spark, case):
    stored = case.stored()
    spark.conf.set(publishing.WHOLE_KEYS, "false")
    try:
        for lines in stored.lines(written(stored.scored, "findings"))[1:]:
            lines.collect()
            plan = lines._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
            assert "Exchange" not in plan[: plan.index("Join")] and "Join" in plan
    finally:
        spark.conf.unset(publishing.WHOLE_KEYS)


def test_bytes_of_lines_are_told_by_parts():
    batch = pa.RecordBatch.from_pydict({"report": ["a", "a", "a", "b", "a"], "part": [1, 1, 2, 2, 2], "line": ["x\n", "é\n", "", "y\n", "z\n"]}).slice(1)
    assert [(r, p, b.to_pybytes().decode()) for r, p, b in publishing.stretches(batch)] == [("a", 1, "é\n"), ("a", 2, ""), ("b", 2, "y\n"), ("a", 2, "z\n")]


def test_a_part_in_two_tasks_is_an_error(tmp_path):
    writer = publishing.ReportWriter({"path": str(tmp_path / "out"), "job": "j", "reports": "a"})
    staged = [publishing.Staged((("a", 0, "x"),)), publishing.Staged((("a", 0, "y"),))]
    with pytest.raises(ReportError, match="several pieces"):
        writer.commit(staged)
    assert not (tmp_path / "out").exists()
