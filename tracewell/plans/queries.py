"""Queries of the library for the driver contract, and the SQL that must give the same rows.

The test tables hold no forensic evidence, so ``events`` is read as evidence: a signup is an insert and an
error a removal of the user's device, everything else a file access. Users are dealt to 50 cases; all rows take part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import timestamps, windows
from tracewell.operators import events as E
from tracewell.operators import identity, reports, scoring, sessions
from tracewell.plans.config import Weights
from tracewell.plans.pipeline import CaseResult, correlate
from tracewell.shared import shared_dir, width, written
from tracewell.sources import event_xml, intake, registry, shortcuts
from tracewell.streaming import sessions as arriving

Query = Callable[[SparkSession, str], DataFrame]
WEIGHTS = Weights(protected_directories=("C:\\Projects\\confidential",))
#: Time bucket of the interval join: a sixtieth of a day, as the events are.
BUCKET = timedelta(minutes=24)
FOUND: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items()}


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as timeline events, a month of them within half a day, so that files follow connections by seconds too."""
    close = F.expr("timestampadd(MICROSECOND, timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', cast(ts AS timestamp_ntz)) div 60, timestamp_ntz'2024-01-01')")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", close).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    device = F.col("event_type").isin("signup", "error")
    kind = F.when(F.col("event_type") == "signup", F.lit(E.INSERT)).when(F.col("event_type") == "error", F.lit(E.REMOVE)).otherwise(F.lit(E.ACCESS))
    folder = F.when(F.col("k") % 7 == 0, F.lit("confidential")).otherwise(F.concat(F.lit("d"), (F.col("k") % 7).cast("string")))
    ending = F.element_at(F.array(*map(F.lit, (".sql", ".pem", ".env", ".zip", ".txt", ".txt", ".txt", ".txt"))), (F.col("k") % 8 + 1).cast("int"))
    none = F.lit("")
    return e.select(
        F.concat(F.lit("CASE"), (F.col("user_id") % 50).cast("string")).alias("case_id"), kind.alias("event_type"), F.col("ts").alias("timestamp_utc"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("raw_timestamp"),
        F.concat(F.lit("evidence/"), "event_type").alias("source_artifact"), F.lit("table").alias("parser_name"), F.lit("1").alias("parser_version"),
        F.when(device, F.concat(F.lit("USBSTOR#DEV"), F.col("user_id").cast("string"))).alias("device_id"), F.col("user_id").cast("string").alias("serial_number"), none.alias("vendor"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Stick "), F.col("user_id").cast("string"))).otherwise(none).alias("product"), none.alias("friendly_name"),
        F.when(~device, F.concat(F.lit("C:\\Projects\\"), folder, F.lit("\\f"), F.col("k").cast("string"), ending)).alias("file_path"), F.col("k").alias("file_size_bytes"),
        F.to_json(F.struct(F.sha2(F.concat(F.lit("f"), F.col("k").cast("string")).cast("binary"), 256).alias("sha256"))).alias("details"), F.col("event_id").alias("ingest_ord"),
    )


def destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).where("file_size_bytes % 97 = 0").select(F.get_json_object("details", "$.sha256").alias("sha256")).distinct()


def case(spark: SparkSession, sf_dir: str) -> CaseResult:
    return correlate(evidence(spark, sf_dir), weights=WEIGHTS, hashes=destination(spark, sf_dir), bucket=BUCKET)


ISO = "CASE WHEN strftime({0}, '%f') = '000000' THEN strftime({0}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'"
EV = r"""WITH raw AS (SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_microseconds(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 60) AS ts), CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type IN ('signup', 'error') AS dev FROM events),
ev AS (SELECT 'CASE' || CAST(user_id % 50 AS VARCHAR) AS case_id, CASE event_type WHEN 'signup' THEN 'usb_insert' WHEN 'error' THEN 'usb_remove' ELSE 'file_access' END AS event_type, ts AS timestamp_utc,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS raw_timestamp, 'evidence/' || event_type AS source_artifact, 'table' AS parser_name, '1' AS parser_version, CASE WHEN dev THEN 'USBSTOR#DEV' || user_id END AS device_id, CAST(user_id AS VARCHAR) AS serial_number, '' AS vendor,
  CASE WHEN user_id % 3 = 0 THEN 'Stick ' || user_id ELSE '' END AS product, '' AS friendly_name,
  CASE WHEN NOT dev THEN 'C:\Projects\' || CASE WHEN k % 7 = 0 THEN 'confidential' ELSE 'd' || (k % 7) END || '\f' || k || CASE k % 8 WHEN 0 THEN '.sql' WHEN 1 THEN '.pem' WHEN 2 THEN '.env' WHEN 3 THEN '.zip' ELSE '.txt' END END AS file_path,
  k AS file_size_bytes, '{"sha256":"' || sha256('f' || k) || '"}' AS details, event_id AS ingest_ord, k FROM raw)"""
LC = EV + """,
lc AS (SELECT *, event_type = 'usb_insert' AS ins, lead(event_type) OVER w AS nt, lead(timestamp_utc) OVER w AS nts, lag(event_type) OVER w AS pt, row_number() OVER w AS ordinal FROM ev WHERE device_id IS NOT NULL
  WINDOW w AS (PARTITION BY case_id, device_id ORDER BY timestamp_utc, source_artifact, event_type, ingest_ord))"""
SE = LC + f""",
s0 AS (SELECT case_id, device_id, ordinal, CASE WHEN ins THEN timestamp_utc ELSE timestamp_utc - INTERVAL 15 MINUTE END AS start_utc, ins AS start_observed,
  CASE WHEN NOT ins THEN timestamp_utc WHEN nts IS NOT NULL THEN nts ELSE timestamp_utc + INTERVAL 15 MINUTE END AS end_utc, (NOT ins OR coalesce(nt = 'usb_remove', false)) AS end_observed FROM lc WHERE ins OR coalesce(pt <> 'usb_insert', true)),
se AS (SELECT *, device_id || ':' || {ISO.format('start_utc')} AS session_id, start_observed AND end_observed AS fully_observed, date_diff('microsecond', start_utc, end_utc) AS duration_us FROM s0)"""
SF = SE + """,
sf AS (SELECT se.case_id, se.device_id, se.ordinal, session_id, start_utc, end_utc, event_type, timestamp_utc, source_artifact, parser_name, parser_version, file_path, file_size_bytes, ingest_ord, k, raw_timestamp, date_diff('microsecond', start_utc, timestamp_utc) AS offset_us
  FROM se JOIN ev ON se.case_id = ev.case_id AND ev.event_type = 'file_access' AND ev.timestamp_utc BETWEEN se.start_utc AND se.end_utc)"""
QUOTED = "'''' || file_path || ''''"
CO = SF + f""",
sq AS (SELECT *, row_number() OVER (PARTITION BY case_id, device_id, ordinal ORDER BY timestamp_utc, source_artifact, event_type, file_path, ingest_ord) AS file_ord, CAST(CAST(round_even(offset_us / 1000000.0, 0) AS BIGINT) AS VARCHAR) AS sec FROM sf),
co AS (SELECT case_id, device_id, ordinal, file_ord, 0 AS rule_idx, 'activity_within_30s' AS rule, 25 AS points, source_artifact AS src, {QUOTED} || ' was accessed ' || sec || 's after the session started, within the 30-second window.' AS explanation FROM sq WHERE offset_us <= 30000000
  UNION ALL SELECT case_id, device_id, ordinal, file_ord, 0, 'activity_within_5min', 15, source_artifact, {QUOTED} || ' was accessed ' || sec || 's after the session started, within the 5-minute window.' FROM sq WHERE offset_us > 30000000 AND offset_us <= 300000000
  UNION ALL SELECT case_id, device_id, ordinal, file_ord, 1, 'sensitive_extension', 15, source_artifact, {QUOTED} || ' has a sensitive extension.' FROM sq WHERE k % 8 < 4
  UNION ALL SELECT case_id, device_id, ordinal, file_ord, 2, 'protected_directory', 20, source_artifact, {QUOTED} || ' is located in a protected project directory.' FROM sq WHERE k % 7 = 0
  UNION ALL SELECT case_id, device_id, ordinal, file_ord, 3, 'destination_hash_match', 50, source_artifact, {QUOTED} || ' has a SHA-256 hash matching a file found on the destination USB.' FROM sq WHERE k % 97 = 0
  UNION ALL SELECT case_id, device_id, ordinal, NULL, 4, 'multiple_confidential_files', 15, string_agg(DISTINCT file_path, ';' ORDER BY file_path), count(DISTINCT file_path) || ' distinct confidential files were accessed in this session.' FROM sq WHERE k % 8 < 4 OR k % 7 = 0 GROUP BY ALL HAVING count(DISTINCT file_path) >= 2)"""
FI = CO + """,
sc AS (SELECT case_id, device_id, ordinal, sum(points) AS t, bool_or(rule = 'destination_hash_match') AS h, bool_or(rule = 'multiple_confidential_files') AS m FROM co GROUP BY ALL),
f0 AS (SELECT se.*, CAST(coalesce(t, 0) AS BIGINT) AS total_score, coalesce(h, false) AS hash_hit, coalesce(m, false) AS several FROM se LEFT JOIN sc USING (case_id, device_id, ordinal)),
f1 AS (SELECT *, CASE WHEN hash_hit THEN 4 WHEN total_score >= 60 AND fully_observed THEN 3 WHEN total_score >= 40 OR several THEN 2 WHEN total_score > 0 THEN 1 ELSE 0 END AS r FROM f0),
fi AS (SELECT *, CAST(r AS BIGINT) AS confidence_rank, ['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CONFIRMED'][r + 1] AS confidence_level,
  CASE r WHEN 4 THEN 'A cryptographic hash match was found between a source file and a file on the destination USB.'
  WHEN 3 THEN 'Score ' || total_score || ' meets the High threshold (60) and both session boundaries are backed by an observed device event, not inferred.'
  WHEN 2 THEN 'Score ' || total_score || ' meets the Medium threshold (40), or multiple related files were accessed shortly after insertion, consistent with staging behaviour.'
  WHEN 1 THEN 'Score ' || total_score || ' is above zero but below the Medium threshold (40).' ELSE 'No scoring rule fired for this session.' END AS confidence_reason FROM f1)"""
EVENT_COLUMNS = "case_id, event_type, timestamp_utc, raw_timestamp, source_artifact, parser_name, parser_version, device_id, serial_number, vendor, product, friendly_name, file_path, file_size_bytes, details, ingest_ord"
KEYS = "case_id, device_id, CAST(ordinal AS BIGINT) AS ordinal"
SESSION_COLUMNS = KEYS + ", start_utc, start_observed, end_utc, end_observed, session_id, fully_observed, duration_us"


@query(f"{EV} SELECT {EVENT_COLUMNS} FROM ev")
def event_canonicalize(spark, sf):
    return evidence(spark, sf)


@query(EV + " SELECT ingest_ord, 'device_id' AS problem FROM ev WHERE event_type = 'usb_insert' UNION ALL SELECT ingest_ord, 'file_path' FROM ev WHERE event_type = 'file_access' AND k % 8 >= 4 AND k % 8 <= 5 UNION ALL SELECT ingest_ord, 'raw_timestamp' FROM ev WHERE k % 9 = 0")
def event_validate_violations(spark, sf):
    broken = evidence(spark, sf).withColumn("device_id", F.when(F.col("event_type") != E.INSERT, F.col("device_id")).otherwise(F.lit(" ")))
    broken = broken.withColumn("file_path", F.when(F.col("file_size_bytes") % 8 == 5, F.lit("")).when(F.col("file_size_bytes") % 8 != 4, F.col("file_path"))).withColumn("raw_timestamp", F.when(F.col("file_size_bytes") % 9 != 0, F.col("raw_timestamp")).otherwise(F.lit("")))
    return E.violations(broken).select("ingest_ord", F.explode("problems").alias("problem"))


@query(EV + " SELECT event_type, count(*) AS n FROM ev GROUP BY ALL")
def event_type_counts(spark, sf):
    return E.type_counts(evidence(spark, sf))


@query(EV + " SELECT case_id, ingest_ord, row_number() OVER (PARTITION BY case_id ORDER BY timestamp_utc, event_type, source_artifact, coalesce(file_path, ''), coalesce(device_id, ''), ingest_ord) AS position FROM ev")
def timeline_order(spark, sf):
    return E.positions(evidence(spark, sf), keep=()).select("case_id", "ingest_ord", "position")


@query(LC + " SELECT case_id, device_id, ordinal, ins AS is_insert, nt = 'usb_insert' AS next_insert, nts AS next_time, pt = 'usb_insert' AS previous_insert FROM lc")
def device_lifecycle_lead_lag(spark, sf):
    return sessions.lifecycle(evidence(spark, sf)).select("case_id", "device_id", "ordinal", "is_insert", "next_insert", "next_time", "previous_insert")


@query(f"{SE} SELECT {SESSION_COLUMNS} FROM se")
def usb_sessions(spark, sf):
    return sessions.reconstruct(evidence(spark, sf))


@query(f"{SE} SELECT {SESSION_COLUMNS} FROM se")
def streamed_sessions(spark, sf):
    """The same sessions of events that arrive in several files, in the order of their numbers; a quarter of them is a step of the stream."""
    folder = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    e = evidence(spark, sf).withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp"))
    # a step is several files, so that many tasks write and read it
    files = -(-width(spark) // 4)
    e.repartitionByRange(4 * files, "ingest_ord").write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/events")
    # files may arrive in any order of their times, so nothing is late
    found = arriving.track(stream, delay="400 days")
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/sessions").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return arriving.settled(spark.read.schema(found.schema).parquet(f"{folder}/sessions"))


def _some(condition: str, where: str) -> tuple[str, str]:
    return condition, f"{SE} SELECT {SESSION_COLUMNS} FROM se WHERE {where}"


DOUBLE = _some("start_observed AND NOT end_observed AND duration_us <> 900000000", "start_observed AND NOT end_observed AND duration_us <> 900000000")
ORPHAN = _some("NOT start_observed", "NOT start_observed")
OPEN = _some("start_observed AND NOT end_observed AND duration_us = 900000000", "start_observed AND NOT end_observed AND duration_us = 900000000")


@query(DOUBLE[1])
def session_double_insert(spark, sf):
    return sessions.reconstruct(evidence(spark, sf)).where(DOUBLE[0])


@query(ORPHAN[1])
def session_orphan_removal(spark, sf):
    return sessions.reconstruct(evidence(spark, sf)).where(ORPHAN[0])


@query(OPEN[1])
def session_open_ended(spark, sf):
    return sessions.reconstruct(evidence(spark, sf)).where(OPEN[0])


@query(SE + " SELECT case_id, count(*) AS n, CAST(sum(duration_us) AS BIGINT) AS total_us, max(duration_us) AS longest_us, CAST(sum(CASE WHEN fully_observed THEN 1 ELSE 0 END) AS BIGINT) AS observed FROM se GROUP BY ALL")
def session_duration(spark, sf):
    return sessions.reconstruct(evidence(spark, sf)).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_us").alias("total_us"), F.max("duration_us").alias("longest_us"), F.sum(F.col("fully_observed").cast("long")).alias("observed"))


@query(EV + ", d AS (SELECT *, row_number() OVER (PARTITION BY case_id, device_id ORDER BY ingest_ord) AS n FROM ev WHERE device_id IS NOT NULL) SELECT case_id, device_id, serial_number, vendor, product, friendly_name, CASE WHEN product <> '' THEN product ELSE device_id END AS display_name FROM d WHERE n = 1")
def device_first_seen(spark, sf):
    return sessions.first_seen_devices(evidence(spark, sf))


PAIRS = f"{SF} SELECT {KEYS}, session_id, ingest_ord, offset_us FROM sf"


@query(PAIRS)
def session_file_join(spark, sf):
    e = evidence(spark, sf)
    return sessions.pairs_of(sessions.reconstruct(e), e, ("session_id",), ("ingest_ord",), timedelta(minutes=6))


@query(PAIRS)
def session_file_join_bucketed(spark, sf):
    return case(spark, sf).pairs_of(("session_id",), ("ingest_ord",))


@query(f"{SF} SELECT {SESSION_COLUMNS} FROM se WHERE NOT EXISTS (SELECT 1 FROM sf WHERE sf.case_id = se.case_id AND sf.device_id = se.device_id AND sf.ordinal = se.ordinal)")
def session_no_activity(spark, sf):
    c = case(spark, sf)
    return c.idle.select(*c.sessions.columns)


CO_COLUMNS = f"{KEYS}, CAST(file_ord AS BIGINT) AS file_ord, CAST(rule_idx AS BIGINT) AS rule_idx, rule, CAST(points AS BIGINT) AS points, src AS source_artifacts, explanation"

def _told() -> dict[str, Column]:
    """Artifacts are joined once of each file, not of each pair."""
    return {c: F.col(c) for c in ("rule_idx", "rule", "points")} | {"source_artifacts": F.array_join("source_artifacts", ";"), "explanation": F.col("explanation")}


def _rule(name: str) -> None:
    def run(spark, sf):
        return case(spark, sf).contributions_of((name,), _told())

    run.__name__ = f"rule_{name}"
    query(f"{CO} SELECT {CO_COLUMNS} FROM co WHERE rule = '{name}'")(run)


for _name in ("activity_within_30s", "activity_within_5min", "sensitive_extension", "protected_directory", "destination_hash_match", "multiple_confidential_files"):
    _rule(_name)


@query(f"{CO} SELECT {CO_COLUMNS} FROM co")
def contributions_all(spark, sf):
    return case(spark, sf).contributions_of(tuple(scoring.RULE_INDEX), _told())


@query(f"{FI} SELECT {KEYS}, total_score, hash_hit, several FROM fi")
def session_scores(spark, sf):
    return case(spark, sf).findings.select("case_id", "device_id", "ordinal", "total_score", "hash_hit", "several")


FINDINGS = f"{FI} SELECT {SESSION_COLUMNS}, hash_hit, several, total_score, confidence_rank, confidence_level, confidence_reason FROM fi"


@query(FINDINGS)
def findings(spark, sf):
    f = case(spark, sf).findings
    return f.select("case_id", "device_id", "ordinal", *[c for c in f.columns if c not in scoring.SESSION])


@query(FI + " SELECT confidence_level, count(*) AS n, CAST(sum(total_score) AS BIGINT) AS points FROM fi GROUP BY ALL")
def findings_by_confidence(spark, sf):
    return case(spark, sf).findings.groupBy("confidence_level").agg(F.count(F.lit(1)).alias("n"), F.sum("total_score").alias("points"))


YES = "CASE WHEN {0} THEN 'True' ELSE 'False' END AS {0}"


@query(
    FI + f""", dv AS (SELECT case_id, device_id, any_value(product) AS product FROM ev WHERE device_id IS NOT NULL GROUP BY ALL)
SELECT session_id, device_id, CASE WHEN product <> '' THEN product ELSE device_id END AS device_friendly_name, {ISO.format('start_utc')} AS start_timestamp_utc, {YES.format('start_observed')}, {ISO.format('end_utc')} AS end_timestamp_utc, {YES.format('end_observed')},
CAST(total_score AS VARCHAR) AS total_score, confidence_level, confidence_reason, coalesce(rule, '') AS rule, coalesce(CAST(points AS VARCHAR), '') AS rule_points, coalesce(src, '') AS rule_source_artifacts, coalesce(explanation, '') AS rule_explanation
FROM fi LEFT JOIN dv USING (case_id, device_id) LEFT JOIN co USING (case_id, device_id, ordinal)"""
)
def findings_csv_rows(spark, sf):
    return case(spark, sf).findings_table


@query(FOUND["findings_csv_rows"][1])
def published_findings_csv(spark, sf):
    """All reports of all cases, published together; the findings' table is what the CSV says when it is read again."""
    folder = f"{shared_dir(spark)}/case-{uuid.uuid4().hex}"
    case(spark, sf).write_reports(folder, "gzip")
    return reports.read_csv(spark, f"{folder}/{reports.FINDINGS_CSV}", list(reports.FINDINGS_COLUMNS))


@query(f"{SF} SELECT session_id, {ISO.format('timestamp_utc')} AS timestamp_utc, event_type, file_path, CAST(file_size_bytes AS VARCHAR) AS file_size_bytes, source_artifact, parser_name, parser_version FROM sf")
def timeline_csv_rows(spark, sf):
    return case(spark, sf).timeline


@query(EV + " SELECT case_id, ingest_ord, CASE event_type WHEN 'usb_insert' THEN 0 WHEN 'usb_remove' THEN 1 ELSE 2 END AS stream, row_number() OVER (PARTITION BY case_id ORDER BY timestamp_utc, event_type, source_artifact, coalesce(file_path, ''), coalesce(device_id, ''), ingest_ord) AS position FROM ev")
def merge_order(spark, sf):
    e = evidence(spark, sf)
    return E.merge_positions(*[e.where(F.col("event_type") == t) for t in (E.INSERT, E.REMOVE, E.ACCESS)]).select("case_id", "ingest_ord", "stream", "position")


@query(EV + " SELECT parser_name, parser_version, source_artifact, count(*) AS n FROM ev GROUP BY ALL")
def parser_union(spark, sf):
    e = evidence(spark, sf)
    parts = [e.where(F.col("event_type") == t) for t in (E.INSERT, E.REMOVE, E.ACCESS)]
    return E.merged(*parts).groupBy("parser_name", "parser_version", "source_artifact").agg(F.count(F.lit(1)).alias("n"))


XML_ROWS = EV + " SELECT ingest_ord, event_type, " + ISO.format("timestamp_utc") + " AS iso, device_id, file_path, CAST(ingest_ord AS VARCHAR) AS record_id FROM ev WHERE k % 11 <> 0 AND NOT (event_type = 'file_access' AND k % 5 = 0)"


def event_records(spark, sf) -> DataFrame:
    """(source_artifact, record_ord, xml): each row of ``events`` as a log record; every eleventh k is another provider's, every fifth file a key."""
    e = evidence(spark, sf)
    data = lambda name, value: F.concat(F.lit(f'<Data Name="{name}">'), value, F.lit("</Data>"))
    insert, remove = F.col("event_type") == E.INSERT, F.col("event_type") == E.REMOVE
    provider = F.when(F.col("file_size_bytes") % 11 == 0, F.lit("Other")).when(insert | remove, F.lit(event_xml.DFU)).otherwise(F.lit(event_xml.SECURITY))
    number = F.when(insert, F.lit("2003")).when(remove, F.lit("2102")).otherwise(F.lit("4663"))
    body = F.when(insert, F.concat(F.lit("<EventData>"), data("DeviceInstanceId", F.col("device_id")), F.lit("</EventData>"))).when(
        remove, F.concat(F.lit('<UserData><X xmlns="urn:other"><InstanceId>'), F.col("device_id"), F.lit("</InstanceId></X></UserData>"))
    ).otherwise(F.concat(F.lit("<EventData>"), data("ObjectType", F.when(F.col("file_size_bytes") % 5 == 0, F.lit("Key")).otherwise(F.lit("File"))), data("ObjectName", F.col("file_path")), F.lit("</EventData>")))
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="'), provider, F.lit('"/><EventID>'), number, F.lit('</EventID><TimeCreated SystemTime="'), F.col("raw_timestamp"), F.lit('0Z"/><EventRecordID>'),
        F.col("ingest_ord").cast("string"), F.lit("</EventRecordID></System>"), body, F.lit("</Event>"),
    )
    return e.select("source_artifact", F.col("ingest_ord").alias("record_ord"), xml.alias("xml"))


@query(XML_ROWS)
def event_xml_rows(spark, sf):
    """Every row of ``events`` as the XML of a log record, read back."""
    read = event_xml.events(event_records(spark, sf))
    return read.select("ingest_ord", "event_type", timestamps.isoformat(F.col("timestamp_utc")).alias("iso"), "device_id", "file_path", F.get_json_object("details", "$.record_id").alias("record_id"))


@query(XML_ROWS.replace("SELECT ingest_ord, event_type", "SELECT event_type"))
def event_export_rows(spark, sf):
    """The same records as files of exports, read in ranges of 256 KB; what is of no use is left out by its provider and id as it is read."""
    folder = f"{shared_dir(spark)}/event-exports-{uuid.uuid4().hex}"
    event_records(spark, sf).select("xml").write.text(folder)
    read = event_xml.read(spark, folder, suffix=".txt", partBytes=256 << 10)
    return read.select("event_type", timestamps.isoformat(F.col("timestamp_utc")).alias("iso"), "device_id", "file_path", F.get_json_object("details", "$.record_id").alias("record_id"))


@query(EV + " SELECT 'SYSTEM-' || case_id AS source_artifact, 'usb_drive_letter_assigned' AS event_type, 'USBSTOR\\Disk&Ven_V\\S' || serial_number AS device_id, " + ISO.format("timestamp_utc") + " AS iso, chr(CAST(65 + k % 26 AS INTEGER)) || ':' AS drive_letter FROM ev WHERE device_id IS NOT NULL AND k % 3 <> 0")
def registry_mount_rows(spark, sf):
    """Every device event of ``events`` as a value of its case's hive, read back; every third names no storage device."""
    e = evidence(spark, sf).where("device_id IS NOT NULL")
    hive = F.concat(F.lit("SYSTEM-"), "case_id")
    target = F.concat(F.lit("\\??\\"), F.when(F.col("file_size_bytes") % 3 == 0, F.lit("SCSI")).otherwise(F.lit("USBSTOR")), F.lit("#Disk&Ven_V#S"), F.col("serial_number"), F.lit("#{guid}"))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda key, at, name, number, raw: [hive.alias("source_artifact"), F.lit(key).alias("key_path"), at.cast("timestamp").alias("key_last_write"), F.lit(0).alias("value_ord"), name.alias("value_name"), none("string").alias("value_str"), number.alias("value_int"), raw.alias("value_bytes")]
    letter = F.concat(F.lit("\\DosDevices\\"), F.chr(F.col("file_size_bytes") % 26 + 65), F.lit(":"))
    values = e.select(*row("MountedDevices", F.col("timestamp_utc"), letter, none("long"), F.encode(target, "UTF-16LE")))
    current = e.select(*row("Select", none("timestamp"), F.lit("Current"), F.lit(1).cast("long"), none("binary"))).distinct()
    read = registry.events(values.unionByName(current))
    return read.select("source_artifact", "event_type", "device_id", timestamps.isoformat(F.col("timestamp_utc")).alias("iso"), F.get_json_object("details", "$.drive_letter").alias("drive_letter"))


HIVE_ROWS = (
    EV + r""", u AS (SELECT *, CAST(serial_number AS BIGINT) AS n FROM ev),
d AS (SELECT *, 'USBSTOR\Disk&Ven_V' || (n % 5) || '&Prod_P_' || (n % 7) || '&Rev_1\S' || n AS instance FROM u WHERE device_id IS NOT NULL),
r AS (SELECT 'SYSTEM-' || case_id AS source_artifact, event_type, instance AS device_id, 'S' || n AS serial_number, 'V' || (n % 5) AS vendor, 'P ' || (n % 7) AS product, 'F' || n AS friendly_name, arg_min(timestamp_utc, ingest_ord) AS seen_at, NULL AS volume_guid FROM d WHERE n % 11 <> 0 GROUP BY case_id, event_type, instance, n
UNION ALL SELECT 'SYSTEM-' || case_id, 'usb_device_registered', instance, 'S' || n, 'V' || (n % 5), 'P ' || (n % 7), 'F' || n, max(timestamp_utc), NULL FROM d WHERE n % 11 = 0 GROUP BY case_id, instance, n
UNION ALL SELECT 'SOFTWARE-' || case_id, 'usb_device_registered', 'USBSTOR\Disk&Ven_V\S' || n, 'S' || n, '', '', 'Drive ' || n, max(timestamp_utc), NULL FROM d GROUP BY case_id, n
UNION ALL SELECT 'NTUSER-' || case_id, 'usb_user_mount', NULL, '', '', '', '', max(timestamp_utc), CASE WHEN k % 2 = 0 THEN '{V' || (k % 20) || '}' END FROM u WHERE device_id IS NULL GROUP BY case_id, CASE WHEN k % 2 = 0 THEN k % 20 ELSE 100 + k % 26 END, CASE WHEN k % 2 = 0 THEN '{V' || (k % 20) || '}' END)
SELECT source_artifact, event_type, device_id, serial_number, vendor, product, friendly_name, """
    + ISO.format("seen_at")
    + " AS iso, volume_guid FROM r"
)


def hive_values(spark, sf) -> DataFrame:
    """Each row of ``events`` as values of its case's hives: device events of two, file events of the user's."""
    e = evidence(spark, sf).withColumn("n", F.col("serial_number").cast("long"))
    number = F.col("n").cast("string")
    none = {"key_last_write": F.lit(None).cast("timestamp"), "value_ord": F.lit(0), "value_name": F.lit(None).cast("string"), "value_str": F.lit(None).cast("string"), "value_int": F.lit(None).cast("long"), "value_bytes": F.lit(None).cast("binary")}
    row = lambda rows, hive, key, **more: rows.select(F.concat(F.lit(f"{hive}-"), "case_id").alias("source_artifact"), key.alias("key_path"), *[v.alias(c) for c, v in (none | more).items()])
    devices, files, at = e.where("device_id IS NOT NULL"), e.where("device_id IS NULL"), F.col("timestamp_utc").cast("timestamp")
    instance = F.concat(F.lit("ControlSet001\\Enum\\USBSTOR\\Disk&Ven_V"), (F.col("n") % 5).cast("string"), F.lit("&Prod_P_"), (F.col("n") % 7).cast("string"), F.lit("&Rev_1\\S"), number)
    digits = F.lpad(F.hex(F.unix_micros(at) * 10 + F.lit(timestamps.EPOCH_GAP * 10)), 16, "0")
    little = F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))
    prop = F.concat(instance, F.lit(f"\\Properties\\{registry.PROPERTIES}\\"), F.when(F.col("event_type") == E.INSERT, F.lit("0066")).otherwise(F.lit("0067")))
    entry = F.when(F.col("file_size_bytes") % 2 == 0, F.concat(F.lit("{V"), (F.col("file_size_bytes") % 20).cast("string"), F.lit("}"))).otherwise(F.chr(F.col("file_size_bytes") % 26 + 65))
    parts = [
        row(e, "SYSTEM", F.lit("Select"), value_name=F.lit("Current"), value_int=F.lit(1).cast("long")).distinct(),
        row(devices, "SYSTEM", instance, key_last_write=at, value_name=F.lit("FriendlyName"), value_str=F.concat(F.lit("F"), number)),
        row(devices.where("n % 11 <> 0"), "SYSTEM", prop, value_name=F.lit(""), value_ord=F.col("ingest_ord").cast("int"), value_bytes=little),
        row(devices, "SOFTWARE", F.concat(F.lit(registry.PORTABLE + "\\SWD#USBSTOR#Disk&Ven_V#S"), number, F.lit("#{g}")), key_last_write=at, value_name=F.lit("FriendlyName"), value_str=F.concat(F.lit("Drive "), number)),
        row(files, "NTUSER", F.concat(F.lit(registry.MOUNTPOINTS + "\\"), entry), key_last_write=at),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _hive_rows(found: DataFrame) -> DataFrame:
    return found.select("source_artifact", "event_type", "device_id", "serial_number", "vendor", "product", "friendly_name", timestamps.isoformat(F.col("timestamp_utc")).alias("iso"), F.get_json_object("details", "$.volume_guid").alias("volume_guid"))


@query(HIVE_ROWS)
def registry_hive_rows(spark, sf):
    return _hive_rows(registry.events(hive_values(spark, sf)))


@query(HIVE_ROWS)
def registry_export_rows(spark, sf):
    """The same values as a file of exports for each hive, read in ranges of 256 KB."""
    folder = f"{shared_dir(spark)}/value-exports-{uuid.uuid4().hex}"
    v = hive_values(spark, sf)
    v.select(F.col("source_artifact").alias("hive"), F.to_json(F.struct(*[c for c in v.columns if c != "source_artifact"]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value")).repartition("hive").write.partitionBy("hive").text(folder)
    read = registry.read(spark, folder, suffix=".txt", partBytes=256 << 10)
    # entries, hives and their faults are told of one reading
    values = written(read.withColumn("source_artifact", F.regexp_extract("source_artifact", "hive=([^/]+)/", 1)), "registry-values")
    return _hive_rows(registry.events(values))


SHORTCUT_ROWS = (
    EV + r""", f AS (SELECT *, CAST(serial_number AS BIGINT) AS n, ['file_created', 'file_access', 'file_modified'] AS kinds FROM ev WHERE event_type = 'file_access'),
x AS (SELECT *, unnest([1, 2, 3]) AS i FROM f)
SELECT ingest_ord, kinds[i] AS event_type, """
    + ISO.format("timestamp_utc + to_seconds(i)")
    + r""" AS iso, CASE k % 3 WHEN 0 THEN file_path WHEN 1 THEN 'E:\wide\' || k || '\' || chr(CAST(20013 + k % 50 AS INTEGER)) || '.txt' ELSE '..\rel' || k END AS file_path, k AS file_size_bytes,
  CASE WHEN k % 3 < 2 THEN upper(lpad(hex(n * 7919), 8, '0')) END AS volume_serial_number, CASE WHEN k % 3 < 2 THEN CASE k % 2 WHEN 0 THEN 'removable' ELSE 'fixed' END END AS drive_type, k % 4 = 0 AS in_list FROM x WHERE i <> 1 OR k % 5 <> 0"""
)


@query(SHORTCUT_ROWS)
def shortcut_rows(spark, sf):
    """Each file event of ``events`` as a shortcut file's bytes, or as an entry of a custom jump list, read back: narrow and wide paths, and relative ones."""
    k, n = F.col("file_size_bytes"), F.col("serial_number").cast("long")
    e = evidence(spark, sf).where(F.col("event_type") == E.ACCESS)

    def number(value: Column, size: int) -> Column:
        digits = F.lpad(F.hex(value), 2 * size, "0")
        return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(2 * size - 1, 0, -2)]))

    lit = lambda b: F.lit(b)
    ticks = lambda i: (F.unix_micros(F.col("timestamp_utc").cast("timestamp")) + i * 1_000_000) * 10 + F.lit(timestamps.EPOCH_GAP * 10)
    word = lambda v, size=4: number(v if isinstance(v, Column) else F.lit(v), size)
    created = F.when(k % 5 == 0, F.lit(0).cast("long")).otherwise(ticks(1))
    flags = F.when(k % 3 == 2, F.lit(0x8 | 0x80)).otherwise(F.lit(0x2 | 0x80))
    head = F.concat(lit(shortcuts.SIGNATURE), word(flags), word(0x21), word(created, 8), word(ticks(2), 8), word(ticks(3), 8), word(k), lit(bytes(20)))
    volume = F.concat(word(17), word(F.when(k % 2 == 0, F.lit(2)).otherwise(F.lit(3))), word(n * 7919), word(16), lit(b"\0"))
    base = F.concat(F.encode("file_path", "ISO-8859-1"), lit(b"\0"))
    narrow = F.concat(volume, base, lit(b"\0"))
    size = lambda c: F.octet_length(c)
    info = F.concat(word(size(narrow) + 28), word(28), word(1), word(28), word(28 + 17), word(0), word(size(narrow) + 27), narrow)
    start = F.concat(F.encode(F.concat(F.lit("E:\\wide\\"), k.cast("string")), "UTF-16LE"), lit(b"\0\0"))
    tail = F.concat(F.encode(F.concat(F.decode(number(F.lit(20013) + k % 50, 2), "UTF-16LE"), F.lit(".txt")), "UTF-16LE"), lit(b"\0\0"))
    body = F.concat(narrow, start, tail)
    wide = F.concat(word(size(body) + 36), word(36), word(1), word(36), word(36 + 17), word(0), word(size(narrow) + 35), word(size(narrow) + 36), word(size(narrow) + 36 + size(start)), body)
    relative = F.concat(F.lit("..\\rel"), k.cast("string"))
    content = F.concat(head, F.when(k % 3 == 0, info).when(k % 3 == 1, wide).otherwise(F.concat(word(F.length(relative), 2), F.encode(relative, "UTF-16LE"))))
    listed = k % 4 == 0
    name = F.concat(F.col("ingest_ord").cast("string"), F.when(listed, F.lit("/5b0a6ed0f523a518.customDestinations-ms")).otherwise(F.lit(".lnk")))
    made = e.select(name.alias("source_artifact"), F.when(listed, F.concat(lit(b"head"), content, lit(b"between"), lit(shortcuts.SIGNATURE), lit(b"corrupt"))).otherwise(content).alias("content"))
    detail = lambda c: F.get_json_object("details", f"$.{c}").alias(c)
    found = shortcuts.events(written(made, "shortcut-files"))
    return found.select(
        F.regexp_extract("source_artifact", r"^(\d+)", 1).cast("long").alias("ingest_ord"), "event_type", timestamps.isoformat(F.col("timestamp_utc")).alias("iso"), "file_path", "file_size_bytes", detail("volume_serial_number"), detail("drive_type"),
        (F.col("parser_name") == shortcuts.JUMP[0]).alias("in_list"),
    )


IDENTITY = EV + r""", u AS (SELECT *, CAST(serial_number AS BIGINT) AS n FROM ev),
m AS (SELECT case_id, ingest_ord, list_filter(CASE WHEN event_type = 'usb_insert' THEN ['device:USB\VID_1\S' || n, 'serial:S' || n] WHEN event_type = 'usb_remove' THEN ['device:USBSTOR\Disk\S' || n || '&0', 'serial:S' || n, 'volume:{v' || (n // 50 % 2) || '}', 'letter:' || chr(CAST(65 + n // 50 % 20 AS INTEGER)) || ':']
  WHEN k % 2 = 0 THEN ['volume:{v' || (n // 50 % 3) || '}'] ELSE ['letter:' || chr(CAST(65 + k % 26 AS INTEGER)) || ':'] END, lambda x: x IS NOT NULL) AS names FROM u),
l AS (SELECT DISTINCT case_id, names FROM m),
e AS (SELECT DISTINCT case_id, names[1] AS a, unnest(names) AS b FROM l),
b AS (SELECT case_id, a, b FROM e UNION SELECT case_id, b, a FROM e),
r AS (SELECT DISTINCT case_id, a AS node, a AS other FROM b UNION SELECT r.case_id, r.node, b.b FROM r JOIN b ON r.case_id = b.case_id AND r.other = b.a),
i AS (SELECT case_id, node, min(substr(other, 8)) FILTER (other LIKE 'device:%') AS identity FROM r GROUP BY ALL)
SELECT m.ingest_ord, i.identity FROM m LEFT JOIN i ON m.case_id = i.case_id AND m.names[1] = i.node"""


@query(IDENTITY.replace("WITH raw", "WITH RECURSIVE raw", 1))
def device_identity(spark, sf):
    """Each row of ``events`` names devices as logs, hives, mount points or paths do; its identity is the least instance id in reach."""
    n, k = F.col("serial_number").cast("long"), F.col("file_size_bytes")
    e = evidence(spark, sf)
    insert, remove, mount = F.col("event_type") == E.INSERT, F.col("event_type") == E.REMOVE, (F.col("event_type") == E.ACCESS) & (k % 2 == 0)
    guid = lambda of: F.concat(F.lit("{V"), F.expr(f"cast(serial_number AS long) div 50 % {of}").cast("string"), F.lit("}"))
    details = F.when(remove, F.to_json(F.struct(guid(2).alias("volume_guid"), F.concat(F.chr(F.expr("cast(serial_number AS long) div 50 % 20") + 65), F.lit(":")).alias("drive_letter")))).when(mount, F.to_json(F.struct(guid(3).alias("mount_point_entry"), guid(3).alias("volume_guid"))))
    named = e.select(
        "case_id", "ingest_ord", F.when(mount, F.lit(registry.MOUNT)).when(remove, F.lit(registry.LETTER)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(insert, F.concat(F.lit("USB\\VID_1\\S"), n.cast("string"))).when(remove, F.concat(F.lit("USBSTOR\\Disk\\S"), n.cast("string"), F.lit("&0"))).alias("device_id"),
        F.concat(F.chr(k % 26 + 65), F.lit(":\\f")).alias("file_path"), F.coalesce(details, F.lit("{}")).alias("details"),
    )
    return identity.with_identity(named).select("ingest_ord", "identity")


@query(
    EV + r""" SELECT ingest_ord, '{"details":{"flag":' || (k % 2 = 0) || ',"half":' || k || '.5,"k":' || k || ',"list":[' || k || ',"x",null],"nested":{"a":{},"b":"' || k || '"}},"event_type":"file_access","file_path":"' || replace(file_path, '\', '\\') || '","file_size_bytes":' || k ||
 ',"parser_name":"table","parser_version":"1","raw_timestamp":"' || raw_timestamp || '","session_id":"s","source_artifact":"' || source_artifact || '","timestamp_utc":"' || """ + ISO.format("timestamp_utc") + """ || '"}' AS document FROM ev WHERE event_type = 'file_access'"""
)
def typed_event_documents(spark, sf):
    """Details of all types, keys in no order, pass into the report's documents as they are."""
    k = F.col("file_size_bytes").cast("string")
    details = F.concat(F.lit('{"list":['), k, F.lit(',"x",null],"k":'), k, F.lit(',"nested":{"b":"'), k, F.lit('","a":{}},"half":'), k, F.lit('.5,"flag":'), (F.col("file_size_bytes") % 2 == 0).cast("string"), F.lit("}"))
    files = evidence(spark, sf).where(F.col("event_type") == E.ACCESS).withColumn("details", details).withColumn("session_id", F.lit("s"))
    return files.select("ingest_ord", reports.event_document().alias("document"))


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


#: Edge cases of the functions below, for tests: column, its type, values, and the expressions in both languages.
EDGES: dict[str, tuple[str, str, list, dict[str, Callable[[Column], Column]], dict[str, str]]] = {}


def _values(name: str, column: str, kind: str, rows: list, out: dict[str, Callable[[Column], Column]], sql: dict[str, str]) -> None:
    """Queries of these functions over every row of ``orders`` and of ``events``."""
    EDGES[name] = (column, kind, rows, out, sql)
    _over_table(name, "orders", {"id": "o_orderkey", "k": "o_orderkey % 1000", "user_id": "o_custkey", "ts": "CAST(o_orderdate AS TIMESTAMP)", "event_type": "o_orderpriority"}, column, out, sql)
    _over_events(name, column, out, sql)


def edge_sql(name: str) -> str:
    """The SQL of the edge cases of ``name`` as inline rows."""
    column, kind, rows, _, sql = EDGES[name]
    cast = {"long": "BIGINT", "string": "VARCHAR", "int": "INTEGER"}[kind]
    inline = ", ".join(f"(CAST({_sql(r)} AS {cast}))" for r in rows)
    return f"WITH v({column}) AS (VALUES {inline}) SELECT {column}, {', '.join(f'{s} AS {n}' for n, s in sql.items())} FROM v"


#: Inputs of the same functions from every row of ``events``; both engines read these expressions ({us}: microseconds since 1970).
INPUTS = {
    "filetime_roundtrip": "CASE WHEN k % 11 = 0 THEN -1 - k WHEN k % 13 = 0 THEN NULL ELSE ({us}) * 10 + 116444736000000000 + k % 10 END",
    "iso8601_parse": "CASE k % 5 WHEN 0 THEN concat(stamp, 'Z') WHEN 1 THEN concat(' ', stamp, CAST(user_id % 10 AS STRING), 'Z ') WHEN 2 THEN concat(stamp, '+02:00') WHEN 3 THEN stamp ELSE concat('noon ', CAST(k AS STRING)) END",
    "dos_datetime_parse": "CAST((year(ts) - 1980) * 33554432 + (CASE WHEN k % 9 = 0 THEN 0 ELSE month(ts) END) * 2097152 + day(ts) * 65536 + hour(ts) * 2048 + minute(ts) * 32 + k % 30 AS BIGINT)",
    "windows_suffix": "concat('C:', chr(92), 'd', CAST(k % 7 AS STRING), CASE k % 3 WHEN 0 THEN '/' ELSE chr(92) END, CASE k % 4 WHEN 0 THEN '.' ELSE 'f' END, CAST(user_id AS STRING), CASE k % 5 WHEN 0 THEN '.SQL' WHEN 1 THEN '.tar.zip' WHEN 2 THEN concat('.x', chr(92)) WHEN 3 THEN '' ELSE concat('.', event_type) END)",
    "device_key_parse": "concat(CASE k % 2 WHEN 0 THEN 'Disk' ELSE 'CdRom' END, CASE WHEN k % 5 = 0 THEN '' ELSE concat('&Ven_V_', CAST(user_id AS STRING)) END, '&Prod_', event_type, '&Rev_', CAST(k AS STRING))",
    "generated_serial_flag": "concat(CAST(k % 20 AS STRING), CASE WHEN user_id % 3 = 0 THEN '&' ELSE '' END, CAST(user_id AS STRING), '&0')",
    "drive_type_lookup": "CAST(CASE WHEN k % 13 = 0 THEN NULL ELSE k % 9 - 1 END AS INT)",
    "appid_lookup": "CASE k % 3 WHEN 0 THEN '1b4dd67f29cb1962' WHEN 1 THEN '5b0a6ed0f523a518' ELSE CAST(user_id AS STRING) END",
    "attribute_bits": "CAST((k * 331 + user_id) % 65536 AS BIGINT)",
    "volume_guid_extract": "CASE k % 3 WHEN 0 THEN concat(chr(92), '??', chr(92), 'Volume{', CAST(user_id AS STRING), '-', CAST(k AS STRING), '}') WHEN 1 THEN concat(chr(92), 'DosDevices', chr(92), chr(CAST(65 + user_id % 26 AS INT)), ':') ELSE concat('{open', CAST(k AS STRING)) END",
    "device_path_normalize": "concat(CASE k % 3 WHEN 0 THEN concat(chr(92), '??', chr(92), 'USBSTOR#') WHEN 1 THEN concat('usbstor', chr(92)) ELSE 'none' END, 'Disk&Ven_', event_type, CASE k % 2 WHEN 0 THEN '#' ELSE chr(92) END, 'S', CAST(user_id AS STRING), CASE WHEN k % 5 = 0 THEN '#{guid}' ELSE '' END)",
    "artifact_classify": "concat(CASE k % 5 WHEN 0 THEN '72656766AA' WHEN 1 THEN '456C6646696C6500' WHEN 2 THEN '4C0000000102' WHEN 3 THEN 'D0CF11E0A1B11AE1' ELSE '0011' END, '|f', CAST(k AS STRING), CASE user_id % 5 WHEN 0 THEN '.evtx' WHEN 1 THEN '.EVTX' WHEN 2 THEN '.lnk' WHEN 3 THEN '.automaticDestinations-ms' ELSE '.txt' END)",
    "evtx_event_filter": "CASE k % 8 WHEN 0 THEN 'UserMode|2003' WHEN 1 THEN 'UserMode|2100' WHEN 2 THEN 'UserMode|2102' WHEN 3 THEN 'PnP|20001' WHEN 4 THEN 'PnP|20003' WHEN 5 THEN 'Auditing|4663' ELSE concat('Auditing|', CAST(30000 + user_id AS STRING)) END",
}
#: What the inline query lists as literals, computed.
COMPUTED = {"iso8601_parse": {"iso": "CASE WHEN trim(text) LIKE '%Z' THEN " + ISO.format("CAST(left(trim(text), 26) AS TIMESTAMP)") + " WHEN text LIKE '%+02:00' THEN " + ISO.format("(CAST(left(text, 26) AS TIMESTAMP) - INTERVAL 2 HOUR)") + " END"}}


def _over_table(name: str, table: str, columns: dict[str, str], column: str, out: dict[str, Callable[[Column], Column]], sql: dict[str, str]) -> None:
    names = ", ".join(f"{expression} AS {n}" for n, expression in columns.items())

    def run(spark, sf):
        e = spark.read.parquet(f"{sf}/{table}.parquet").selectExpr(*[f"{expression} AS {n}" for n, expression in columns.items()]).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        made = e.select("id", F.expr(INPUTS[name].replace("{us}", "unix_micros(CAST(ts AS TIMESTAMP))")).alias(column))
        return made.select("id", column, *[f(F.col(column)).alias(n) for n, f in out.items()])

    run.__name__ = name
    made = INPUTS[name].replace("{us}", "epoch_us(ts)")
    raw = f"SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp FROM (SELECT {names} FROM {table})"
    query(f"WITH raw AS ({raw}), v AS (SELECT id, {made} AS {column} FROM raw) SELECT id, {column}, {', '.join(f'{s} AS {n}' for n, s in COMPUTED.get(name, sql).items())} FROM v")(run)


def _over_events(name: str, column: str, out: dict[str, Callable[[Column], Column]], sql: dict[str, str]) -> None:
    """The same functions over the whole ``events`` table, as a query of its own."""

    def run(spark, sf):
        e = spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        made = e.select("event_id", F.expr(INPUTS[name].replace("{us}", "unix_micros(CAST(ts AS TIMESTAMP))")).alias(column))
        return made.select("event_id", column, *[f(F.col(column)).alias(n) for n, f in out.items()])

    run.__name__ = f"{name}_events"
    made = INPUTS[name].replace("{us}", "epoch_us(ts)")
    raw = "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp FROM events"
    query(f"WITH raw AS ({raw}), v AS (SELECT event_id, {made} AS {column} FROM raw) SELECT event_id, {column}, {', '.join(f'{s} AS {n}' for n, s in COMPUTED.get(name, sql).items())} FROM v")(run)


_values("filetime_roundtrip", "ticks", "long", [0, 9, 10, 116444736000000000, 133486419060000000, 2650467743999999999, -1, None], {"iso": lambda c: timestamps.isoformat(timestamps.filetime(c, strict=False))}, {"iso": f"CASE WHEN ticks BETWEEN 0 AND 2650467743999999999 THEN {ISO.format('make_timestamp(ticks // 10 - 11644473600000000)')} END"})
_values("iso8601_parse", "text", "string", ["2024-01-02T04:05:06Z", " 2024-01-02T04:05:06.1234567Z ", "2024-01-02T04:05:06+02:00", "2024-01-02T04:05:06", "", None, "noon"], {"iso": lambda c: timestamps.isoformat(timestamps.iso8601(c))}, {"iso": "CASE trim(text) WHEN '2024-01-02T04:05:06Z' THEN '2024-01-02T04:05:06+00:00' WHEN '2024-01-02T04:05:06.1234567Z' THEN '2024-01-02T04:05:06.123456+00:00' WHEN '2024-01-02T04:05:06+02:00' THEN '2024-01-02T02:05:06+00:00' END"})
_values("dos_datetime_parse", "packed", "long", [0x50680BC0, 0x21000000, 0x5A21BF7D, 0x50E80BC0, 0x500F0000], {"iso": lambda c: timestamps.isoformat(timestamps.dos_datetime(F.shiftright(c, 16).cast("int"), c.bitwiseAND(0xFFFF).cast("int"), "Etc/GMT+5"))}, {"iso": "CASE WHEN (packed >> 21) & 15 BETWEEN 1 AND 12 AND (packed >> 16) & 31 > 0 THEN strftime(make_timestamp(1980 + (packed >> 25), (packed >> 21) & 15, (packed >> 16) & 31, (packed >> 11) & 31, (packed >> 5) & 63, CAST((packed & 31) * 2 AS DOUBLE)) + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') || '+00:00' END"})
_values("windows_suffix", "path", "string", ["C:\\a\\b.SQL", "b.tar.zip", ".env", "a/.env", "x.env", "x.", "C:a.pem", "dir.zip\\", "d.zip\\n", "", "é.Pem"], {"suffix": windows.suffix}, {"suffix": r"lower(regexp_extract(regexp_extract(regexp_replace(regexp_replace(path, '^[A-Za-z]:', ''), '[\\/]+$', ''), '([^\\/]*)$', 1), '[^.].*?(\.[^.]+)$', 1))"})
_values("device_key_parse", "name", "string", ["Disk&Ven_Synthetic&Prod_TestStick&Rev_1.0", "CdRom&Ven_A_B&Prod_&Rev_9", "Disk", ""], {n: (lambda c, n=n: windows.device_key(c)[n]) for n in ("device_class", "vendor", "product", "revision")}, {"device_class": "split_part(name, '&', 1)"} | {n: f"trim(replace(regexp_extract(name, '&{t}_([^&]*)', 1), '_', ' '))" for n, t in (("vendor", "Ven"), ("product", "Prod"), ("revision", "Rev"))})
_values("generated_serial_flag", "serial", "string", ["7&1a2b3c4d&0", "FAKESERIAL001", "&", "", "a&"], {"generated": windows.generated_serial}, {"generated": "substr(serial, 2, 1) = '&'"})
_values("drive_type_lookup", "code", "int", [0, 1, 2, 3, 4, 5, 6, 7, -1, None], {"kind": windows.drive_type}, {"kind": "CASE WHEN code BETWEEN 0 AND 6 THEN ['unknown', 'no_root_directory', 'removable', 'fixed', 'remote', 'cdrom', 'ramdisk'][code + 1] WHEN code IS NOT NULL THEN 'unrecognized' END"})
_values("appid_lookup", "app_id", "string", ["1b4dd67f29cb1962", "5b0a6ed0f523a518", "0000000000000000"], {"application": windows.application}, {"application": "CASE app_id WHEN '1b4dd67f29cb1962' THEN 'Windows Explorer' WHEN '5b0a6ed0f523a518' THEN 'Microsoft Word' ELSE 'unknown (' || app_id || ')' END"})
_values("attribute_bits", "bits", "long", [0, 0x21, 0x7, 0x4000, 0x8000, 0x7FFF], {"names": lambda c: F.array_join(windows.attribute_names(c), ",")}, {"names": "array_to_string(list_filter([" + ", ".join(f"CASE WHEN bits & {m} <> 0 THEN '{n}' END" for m, n in windows.ATTRIBUTES.items()) + "], lambda x: x IS NOT NULL), ',')"})
_values("volume_guid_extract", "name", "string", ["\\??\\Volume{11111111-2222-3333-4444-555555555555}", "\\DosDevices\\E:", "{a}{b}", "{open", ""], {"guid": windows.volume_guid, "letter": windows.drive_letter}, {"guid": r"regexp_extract(name, '(\{[^}]*\})', 1)", "letter": r"regexp_extract(name, '^\\DosDevices\\(.*)$', 1)"})
_values("device_path_normalize", "path", "string", ["\\??\\USBSTOR#Disk&Ven_A#S1#{guid}", "USBSTOR\\Disk\\S2", "x#usbstor#k#s", "USBSTOR#only", "none", ""], {"device": windows.device_of_path}, {"device": r"CASE WHEN regexp_matches(path, '(?i)(^|[\\#])usbstor[\\#]+[^\\#]+[\\#]+[^\\#]+') THEN 'USBSTOR\' || regexp_extract(path, '(?i)(?:^|[\\#])usbstor[\\#]+([^\\#]+)', 1) || '\' || regexp_extract(path, '(?i)(?:^|[\\#])usbstor[\\#]+[^\\#]+[\\#]+([^\\#]+)', 1) END"})
_values(
    "artifact_classify", "file", "string", ["72656766AA|SYSTEM", "456C6646696C6500|a.evtx", "4C0000000102|x.bin", "00|a.EVTX", "00|b.lnk", "0011|c.automaticDestinations-ms", "D0CF11E0A1B11AE1|c.automaticDestinations-ms", "|notes.txt"],
    {"kind": lambda c: intake.artifact_type(F.unhex(F.substring_index(c, "|", 1)), F.substring_index(c, "|", -1))},
    {"kind": "CASE WHEN file LIKE '72656766%' THEN 'registry_hive' WHEN file LIKE '456C6646696C6500%' THEN 'evtx_log' WHEN file LIKE '4C000000%' THEN 'lnk_shortcut' WHEN lower(file) LIKE '%.evtx' THEN '!evtx_log' WHEN lower(file) LIKE '%.lnk' THEN '!lnk_shortcut' WHEN lower(file) LIKE '%destinations-ms' THEN CASE WHEN instr(file, '|') > 16 THEN 'jump_list' ELSE '!jump_list' END ELSE 'unknown' END"},
)
_values("evtx_event_filter", "code", "string", ["UserMode|2003", "UserMode|2100", "UserMode|2102", "PnP|20001", "PnP|20003", "Auditing|4663", "Auditing|4624"], {"kind": lambda c: event_xml.event_type(F.when(c.startswith("UserMode"), F.lit(event_xml.DFU)).when(c.startswith("PnP"), F.lit(event_xml.PNP)).otherwise(F.lit(event_xml.SECURITY)), F.substring_index(c, "|", -1))}, {"kind": "CASE split_part(code, '|', 2) WHEN '2003' THEN 'usb_insert' WHEN '2100' THEN 'usb_remove_pending' WHEN '2102' THEN 'usb_remove' WHEN '20001' THEN 'usb_device_install' WHEN '20003' THEN 'usb_device_install' WHEN '4663' THEN 'file_access' END"})


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def sha256_digest(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query("SELECT CASE WHEN count(*) = 0 THEN 'pending' WHEN bool_or(page_id % 97 = 3) THEN 'failed' ELSE 'verified' END AS changed, CASE WHEN count(*) = 0 THEN 'pending' WHEN bool_and(sha256(html) = sha256(html || '')) THEN 'verified' ELSE 'failed' END AS same FROM pages")
def digest_verify(spark, sf):
    """Digests of all pages against themselves, and against digests of pages of which some have changed."""
    digest = F.sha2(F.col("html").cast("binary"), 256)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    first = pages.select(F.col("page_id").cast("string").alias("rel_path"), digest.alias("sha256"))
    changed = pages.withColumn("html", F.when(F.col("page_id") % 97 == 3, F.concat("html", F.lit("!"))).otherwise(F.col("html"))).select(F.col("page_id").cast("string").alias("rel_path"), digest.alias("sha256"))
    both = intake.compared(first, changed).withColumn("which", F.lit("changed")).unionByName(intake.compared(first, first).withColumn("which", F.lit("same")))
    return both.groupBy().pivot("which", ["changed", "same"]).agg(F.first("verdict"))
