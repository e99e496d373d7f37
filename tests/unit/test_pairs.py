"""What is said of sessions and their files does not need their pairs, and is what the pairs say."""

import random
from datetime import datetime, timedelta

import pytest

from tracewell.operators import events as E
from tracewell.operators import identity, reports, sessions
from tracewell.plans.config import Weights
from tracewell.plans.pipeline import correlate

T0 = datetime(2026, 3, 1, 9)
W = Weights(protected_directories=("C:\\safe",))


def made(spark, seed, cases=2, events=160):
    """Events at few times, so that many are at one time or at an end of a session, and long runs of one confidential path."""
    r, out = random.Random(seed), []
    for i in range(events):
        kind = r.choice([E.INSERT, E.REMOVE, E.ACCESS, E.ACCESS, E.ACCESS])
        device = kind != E.ACCESS
        at = T0 + timedelta(seconds=10 * r.randrange(events * 3))
        path = r.choice(["a.sql", "a.sql", "a.sql", "C:\\safe\\b", "plain.txt", "other.txt"]) if r.random() < 0.2 else r.choice(["a.sql", "plain.txt"])
        out.append((f"c{r.randrange(cases)}", kind, at, at.isoformat(), f"s{r.randrange(2)}", "p", "0", f"d{r.randrange(4)}" if device else None, "S", "V", "", "", None if device else path, 1, '{"sha256": "%s"}' % r.choice(["aa", "bb", "cc", "dd", "ee", "ff"]), i))
    return spark.createDataFrame(out, E.EVENTS)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("bucket", [None, timedelta(minutes=4), timedelta(days=1)])
def test_counts_are_those_of_the_pairs(spark, bucket):
    got = correlate(made(spark, 5), weights=W, hashes=spark.createDataFrame([("aa",)], "sha256 string"), bucket=bucket)
    pairs = {}
    for p in got.files.collect():
        pairs.setdefault((p.case_id, p.device_id, p.ordinal), []).append(p)
    kinds = set()
    for f in got.findings.collect():
        files = pairs.get((f.case_id, f.device_id, f.ordinal), [])
        secret = {p.file_path for p in files if p.file_path in ("a.sql", "C:\\safe\\b")}
        points = sum((25 if p.offset_us <= 30_000_000 else 15 if p.offset_us <= 300_000_000 else 0) + {"a.sql": 15, "C:\\safe\\b": 20}.get(p.file_path, 0) + 50 * p.hash_hit for p in files)
        assert (f.several, f.hash_hit, f.total_score) == (len(secret) > 1, any(p.hash_hit for p in files), points + 15 * (len(secret) > 1))
        kinds.add((len(secret), f.several))
    assert {(0, False), (1, False), (2, True)} <= kinds
    empty = {(s.case_id, s.device_id, s.ordinal) for s in got.idle.collect()}
    assert empty and empty == {(s.case_id, s.device_id, s.ordinal) for s in got.sessions.collect()} - set(pairs)


def test_findings_meet_no_files(spark):
    """no join of sessions and files by time, whose rows grow with the square of a case."""
    got = correlate(made(spark, 6), weights=W, bucket=timedelta(minutes=4))
    for df in (got.findings, got.idle):
        assert "timestamp_utc" not in "".join(line for line in plan(df).splitlines() if "Join" in line)
    assert "timestamp_utc" in "".join(line for line in plan(got.files).splitlines() if "Join" in line)


def test_sessions_of_null_cases_have_no_files(spark):
    e = made(spark, 7).withColumn("case_id", E.F.lit(None).cast("string"))
    found = correlate(e, weights=W, bucket=timedelta(minutes=4))
    assert {r.total_score for r in found.findings.collect()} == {0} and found.findings.count() == sessions.reconstruct(e).count()


@pytest.mark.parametrize("bucket", [None, timedelta(minutes=4), timedelta(days=1)])
def test_several_paths_without_pairs(spark, bucket):
    """paths of several words of bits, told at the ends of sessions; no session meets a file."""
    F = E.F
    many = made(spark, 9, events=400).withColumn("file_path", F.when(F.col("file_path").isNotNull(), F.concat(F.lit("p"), (F.col("ingest_ord") % 150).cast("string"), F.lit(".sql"))))
    got = correlate(many.unionByName(many.where("case_id = 'c0'").withColumn("case_id", F.lit(None).cast("string"))), weights=W, bucket=bucket)
    want = {}
    for p in got.files.collect():
        want.setdefault((p.case_id, p.device_id, p.ordinal), set()).add(p.file_path)
    said = got.contributions_of(("multiple_confidential_files",))
    assert {(r.case_id, r.device_id, r.ordinal): r.source_artifacts for r in said.collect()} == {k: sorted(v) for k, v in want.items() if len(v) > 1}
    assert max(map(len, want.values())) > 20 and len(set().union(*want.values())) > 128 and "timestamp_utc" not in "".join(line for line in plan(said).splitlines() if "Join" in line)


def test_what_files_say_is_said_once_of_each(spark):
    """A pair of a session and a file computes no text that the file alone decides, and each time rule only its own."""
    got = correlate(made(spark, 8), weights=W, bucket=timedelta(minutes=4))
    above = lambda rule: plan(got.contributions_of((rule,))).split("Join")[0]
    assert "sensitive" not in above("sensitive_extension") and "protected" not in above("protected_directory")
    assert "filter(" not in above("activity_within_5min") and "bround" not in above("activity_within_5min")
    assert got.contributions_of(("activity_within_5min",)).count() > 0


def test_pairs_compute_no_texts_or_times(spark):
    """Above the join of sessions and files there is only a subtraction; texts are of files."""
    got = correlate(made(spark, 8), weights=W, bucket=timedelta(minutes=4))
    for df in (got.pairs, got.timeline):
        above = plan(df).split("Join")[0]
        assert "timestampdiff" not in above and "date_format" not in above and "coalesce" not in above
    text = lambda rows: sorted(map(tuple, rows.collect()))
    assert text(got.timeline) == text(reports.timeline_rows(got.files)) and got.timeline.count() == got.pairs.count() > 0


def test_names_of_a_device_are_told_once(spark):
    """what joins events and identities reads names from a table, it does not parse details again."""
    assert "parse_json" not in plan(identity.with_identity(made(spark, 4, events=40))).lower()


@pytest.mark.parametrize("block", [256, 7])
def test_pairs_come_session_by_session(spark, monkeypatch, block):
    """blocks meet, and a session's files of a block follow one another in order of time, so that files of the pairs are small; no pair is lost between blocks."""
    F = E.F
    monkeypatch.setattr(sessions, "BLOCK", block, raising=False)
    events = made(spark, 12, events=700)
    got = correlate(events.unionByName(events.where("case_id = 'c0'").withColumn("case_id", F.lit(None).cast("string"))), weights=W, bucket=timedelta(hours=1))
    rows = got.pairs.collect()
    session = lambda r: (r.case_id, r.device_id, r.ordinal)
    plain = sessions.sessions_with_files(got.sessions, got.events, None, "inner").collect()
    assert len(rows) > 1000 and sorted((*session(r), r.ingest_ord, r.offset_us) for r in rows) == sorted((*session(r), r.ingest_ord, r.offset_us) for r in plain)
    if block == 256:
        together = [(a, b) for a, b in zip(rows, rows[1:]) if session(a) == session(b)]
        assert len(rows) - len(together) <= 2 * len(set(map(session, rows))) and all(a.timestamp_utc <= b.timestamp_utc for a, b in together)
    few = got.pairs_of(("session_id",), ("ingest_ord",))
    assert sorted(map(tuple, few.collect())) == sorted((*session(r), r.session_id, r.ingest_ord, r.offset_us) for r in plain)


def test_pairs_make_no_rules_or_cells(spark):
    """rules that a file fires whenever it is met, and cells of reports, are there before sessions meet files; nothing is put in an array for a pair."""
    got = correlate(made(spark, 8), weights=W, bucket=timedelta(minutes=4))
    above = plan(got.contributions).split("Join")[0]
    assert "sensitive" not in above.split("Union")[-1] and "array(" not in above and "concat(" not in above
    table = got.findings_table
    assert "date_format" not in plan(table) and "array_join" not in plan(table).split("Join")[0]
    text = lambda rows: sorted(map(tuple, rows.collect()))
    want = reports.findings_rows(got.explained).drop("order")
    assert table.columns == want.columns and text(table) == text(want) and {r.rule for r in table.collect()} >= {"", "activity_within_5min", "sensitive_extension", "multiple_confidential_files"}
