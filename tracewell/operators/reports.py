"""Reports as tables that Spark writes: findings and timeline CSV, JSON lines, HTML fragments, manifest."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.errors import IntegrityError, ReportError
from tracewell.functions.timestamps import isoformat
from tracewell.operators import placing, publishing, scoring
from tracewell.operators.events import ACCESS
from tracewell.operators.scoring import SESSION
from tracewell.operators.sessions import met
from tracewell.plans.config import Weights
from tracewell.shared import written

# What a report must say and must not say.
DISCLAIMER = "consistent with possible exfiltration"
FORBIDDEN = ("proved", "proof that", "confirmed theft", "stole", "definitely exfiltrated", "definitively")
#: Quoting as RFC 4180 has it, and empty cells for empty text.
CSV = {"header": "true", "escape": '"', "emptyValue": "", "nullValue": "", "lineSep": "\n"}


def _said(flag: Column) -> Column:
    return F.when(flag, F.lit("True")).otherwise(F.lit("False"))


FINDINGS_COLUMNS = (
    "session_id", "device_id", "device_friendly_name", "start_timestamp_utc", "start_observed", "end_timestamp_utc", "end_observed", "total_score", "confidence_level", "confidence_reason",
    "rule", "rule_points", "rule_source_artifacts", "rule_explanation",
)


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _finding_cells() -> list[Column]:
    """Cells of a finding, with its device's display_name."""
    return [
        F.col("session_id"), F.col("device_id"), F.coalesce("display_name", "device_id").alias("device_friendly_name"), isoformat(F.col("start_utc")).alias("start_timestamp_utc"), _said(F.col("start_observed")).alias("start_observed"),
        isoformat(F.col("end_utc")).alias("end_timestamp_utc"), _said(F.col("end_observed")).alias("end_observed"), _text("total_score").alias("total_score"), F.col("confidence_level"), F.col("confidence_reason"),
    ]


def _rule_cells(rule: Column, points: Column, artifacts: Column, explanation: Column) -> list[Column]:
    """Cells of a contribution; empty ones where there is none."""
    return [_text(rule).alias("rule"), _text(points).alias("rule_points"), _text(F.array_join(artifacts, ";")).alias("rule_source_artifacts"), _text(explanation).alias("rule_explanation")]


def findings_rows(rows: DataFrame) -> DataFrame:
    """One row per contribution, one with empty rule cells for a finding without any; sort keys come last.

    ``rows``: contributions with their findings' columns and display_name, as ``CaseResult.explained`` has them.
    """
    order = F.struct("case_id", "start_utc", "device_id", "session_id", "ordinal", F.col("file_ord").isNull().alias("last"), "file_ord", "rule_idx").alias("order")
    return rows.select(*_finding_cells(), *_rule_cells(*map(F.col, ("rule", "points", "source_artifacts", "explanation"))), order)


def findings_table(sessions: DataFrame, events: DataFrame, weights: Weights | None = None, thresholds: Thresholds | None = None, bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """``findings_rows`` without their order, of sessions with their devices' display_name; cells are made once of each session and each file, not of each pair."""
    ruled = dict(zip(FINDINGS_COLUMNS[-4:], _rule_cells(*map(F.col, ("rule", "points", "source_artifacts", "explanation")))))
    found = dict(zip(FINDINGS_COLUMNS, _finding_cells()))
    return scoring.explained(sessions, events, weights, thresholds, bucket, found, ruled).select(*FINDINGS_COLUMNS)


TIMELINE_COLUMNS = ("session_id", "timestamp_utc", "event_type", "file_path", "file_size_bytes", "source_artifact", "parser_name", "parser_version")


def timeline_rows(inside: DataFrame) -> DataFrame:
    """One row per file event of a session."""
    return inside.select("session_id", *_told())


def _told() -> list[Column]:
    """What a row of the timeline says of its file."""
    return [isoformat(F.col("timestamp_utc")).alias("timestamp_utc"), F.col("event_type"), _text("file_path").alias("file_path"), _text("file_size_bytes").alias("file_size_bytes"), F.col("source_artifact"), F.col("parser_name"), F.col("parser_version")]


def timeline_of(sessions: DataFrame, events: DataFrame, bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """``timeline_rows`` of the pairs of sessions and files; the texts are made once of each file, not of each pair."""
    files = events.where(F.col("event_type") == ACCESS).select("case_id", "timestamp_utc", F.struct(*_told()).alias("told"))
    return met(sessions.select("case_id", "start_utc", "end_utc", "session_id"), files, bucket).select("session_id", "told.*")


def finding_document() -> Column:
    """A finding as JSON, keys in alphabetical order, on a table of findings with their devices' columns."""
    ends = lambda p: F.struct(F.col(f"{p}_observed").alias("observed"), isoformat(F.col(f"{p}_utc")).alias("timestamp_utc"))
    return F.to_json(
        F.struct(
            F.struct(F.col("confidence_level").alias("level"), F.col("confidence_reason").alias("reason")).alias("confidence"),
            F.struct("device_id", "friendly_name", "product", "serial_number", "vendor").alias("device"), ends("end").alias("end"), F.struct(F.col("total_score").alias("total")).alias("score"), F.col("session_id"), ends("start").alias("start"),
        )
    )


def members(document: Column) -> Column:
    """The members of a JSON object, at least one, without its braces."""
    return F.substr(document, F.lit(2), F.length(document) - 2)


def joined_json(before: Column | str, session: Column | str, after: Column | str) -> Column:
    """One object of the members of three."""
    return F.concat(F.lit("{"), before, F.lit(","), session, F.lit(","), after, F.lit("}"))


#: Members of an event's document before its session's id.
BEFORE = ("details", "event_type", "file_path", "file_size_bytes", "parser_name", "parser_version", "raw_timestamp")


def event_document() -> Column:
    """An event of a session as JSON. Its details keep their types, lists and nested objects too, keys in alphabetical order."""
    details = F.parse_json("details")
    return F.to_json(F.struct(details.alias("details"), "event_type", "file_path", "file_size_bytes", "parser_name", "parser_version", "raw_timestamp", "session_id", "source_artifact", isoformat(F.col("timestamp_utc")).alias("timestamp_utc")))


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def careful(html: Column) -> Column:
    """``html``, or an error if its wording claims more than evidence can show, or leaves out what must be said."""
    pattern = "|".join(rf"\b{re.escape(p)}\b" for p in FORBIDDEN)
    fault = lambda says: F.raise_error(F.lit(f"{ReportError.__name__}: {says}")).cast("string")
    low = F.lower(html)
    return F.when(low.rlike(pattern), fault("wording overstates the evidence")).when(~low.contains(DISCLAIMER), fault("the disclaimer is missing")).otherwise(html)


def html_section() -> Column:
    """The section of a finding, on a table of findings with their devices' display_name and ``cited``, an array of artifacts."""
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss 'UTC'")
    seen = lambda c: F.when(F.col(c), F.lit("Observed")).otherwise(F.lit("Inferred"))
    list_ = F.when(F.size("cited") > 0, F.concat(F.lit("<ul><li>"), F.array_join(F.transform("cited", escaped), "</li><li>"), F.lit("</li></ul>"))).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<section><h2>"), escaped(F.coalesce("display_name", "device_id")), F.lit("</h2><p>Activity "), F.lit(DISCLAIMER), F.lit(". Score "), F.col("total_score").cast("string"), F.lit(", "), F.initcap(F.lower("confidence_level")),
        F.lit(": "), escaped(F.col("confidence_reason")), F.lit("</p><p>Start "), when("start_utc"), F.lit(" "), seen("start_observed"), F.lit("; end "), when("end_utc"), F.lit(" "), seen("end_observed"), F.lit("</p>"), list_, F.lit("</section>"),
    )
    return careful(html)


def html_fragments(findings: DataFrame, devices: DataFrame) -> DataFrame:
    """(session_id, html): one section per finding, with the disclaimer that every report must carry."""
    named = findings.join(devices.select("case_id", "device_id", "display_name"), ["case_id", "device_id"], "left").withColumn("cited", F.array().cast("array<string>"))
    return named.select("session_id", html_section().alias("html"))


def limitations(text: str | None = None) -> str:
    """The text on what the results can't show: the examiner's, or this. It never comes from the evidence."""
    return text if text is not None else f"Results are {DISCLAIMER}. Artifacts may be missing, altered or overwritten, and clocks may be wrong; an inferred end of a session is an assumption."


def report_frame(spark: SparkSession, manifest: DataFrame, text: str, counts: dict[str, int] | None = None) -> DataFrame:
    """(section, html): the limitations, what was counted, and the custody record as a row for each entry of the manifest."""
    said = spark.createDataFrame([(text,)], "text string").select(F.lit("limitations").alias("section"), careful(F.concat(F.lit("<section><h2>Limitations</h2><p>"), escaped(F.col("text")), F.lit("</p></section>"))).alias("html"))
    cell = lambda *texts: F.concat(F.lit("<tr>"), *[x for t in texts for x in (F.lit("<td>"), escaped(t), F.lit("</td>"))], F.lit("</tr>"))
    numbers = spark.createDataFrame(sorted((k, str(v)) for k, v in (counts or {}).items()), "what string, n string")
    counted = numbers.select(F.lit("counts").alias("section"), cell(F.col("what"), F.col("n")).alias("html"))
    return said.unionByName(counted).unionByName(manifest.select(F.lit("custody").alias("section"), cell(F.col("kind"), F.col("name"), F.col("value")).alias("html")))


# The tool's name and version, and the version of the manifest's form.
TOOL, TOOL_VERSION, SCHEMA_VERSION = "tracewell", "0.3.0", "1.0"


def manifest(
    case_id: str, examiner: str, artifacts: DataFrame, parsers: DataFrame, settings: dict[str, str] | None = None, started: datetime | None = None, ended: datetime | None = None,
    after: DataFrame | None = None, verdict: str = "pending",
) -> DataFrame:
    """Custody rows: (kind, name, value) for the case, its times, settings and verdict, each artifact's digest at intake and afterwards, and each parser.

    Times must say their zone.
    """
    if any(at is not None and at.tzinfo is None for at in (started, ended)):
        raise ReportError("times of a manifest must say their zone")
    spark = artifacts.sparkSession
    head = [("case", "case_id", case_id), ("case", "examiner", examiner), ("case", "schema_version", SCHEMA_VERSION), ("case", "tool_name", TOOL), ("case", "tool_version", TOOL_VERSION), ("case", "integrity_verdict", verdict)]
    head += [("case", name, at.isoformat()) for name, at in (("started_utc", started), ("ended_utc", ended)) if at]
    head += [("setting", name, value) for name, value in sorted((settings or {}).items())]
    digests = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), F.col("rel_path").alias("name"), F.col("sha256").alias("value"))
    out = spark.createDataFrame(head, "kind string, name string, value string").unionByName(digests(artifacts, "digest"))
    if after is not None:
        out = out.unionByName(digests(after, "post_digest"))
    return out.unionByName(parsers.select(F.lit("parser").alias("kind"), F.col("parser_name").alias("name"), F.col("parser_version").alias("value")).distinct())


def manifest_documents(manifest: DataFrame) -> DataFrame:
    """A JSON line for each row of a manifest."""
    return manifest.select(F.to_json(F.struct("kind", "name", "value")).alias("document"))


def verified(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """(verified): whether every file of the manifest is there with the digest of its intake; a manifest without any is an error."""
    kept = manifest.where("kind = 'digest'").join(now.select(F.col("rel_path").alias("name"), F.col("sha256").alias("now")), "name", "left")
    empty = F.raise_error(F.lit(f"{IntegrityError.__name__}: the manifest has no digests, so there is nothing to verify")).cast("boolean")
    return kept.agg(F.when(F.count(F.lit(1)) == 0, empty).otherwise(F.bool_and(F.col("value").eqNullSafe(F.col("now")))).alias("verified"))


FINDINGS_CSV, TIMELINE_CSV, FINDINGS_JSON, REPORT_HTML, FRAME = "findings_csv", "timeline_csv", "findings_json", "report_html", "report_frame"
REPORTS = (FINDINGS_CSV, TIMELINE_CSV, FINDINGS_JSON, REPORT_HTML)


#: Places of a session's own lines before and after those of its files.
FIRST, LAST = -1, (1 << 63) - 1


def lines(scored: DataFrame, devices: DataFrame, events: DataFrame, weights: Weights | None = None, bucket: timedelta | None = timedelta(days=1)) -> list[DataFrame]:
    """The reports on sessions as (report, part, line), in the order that each has.

    ``scored``: findings with ``fired``; ``events``: with hash_hit; all stored. Findings come by case, start and device, in JSON and HTML too;
    a finding's document is followed by its events, each with what it contributes, and by what the session itself does.
    What a file or a session says is text before they meet, so that a pair's lines are only put together (``placing``).
    """
    w = weights or Weights()
    p = placing.placed(scored, events)
    sessions = p.sessions.join(devices, ["case_id", "device_id"], "left")
    several = written(scoring.several_confidential(scored.select(*SESSION, "start_utc", "end_utc"), events, w, bucket).drop("start_utc", "end_utc", "file_ord"), "several-confidential")
    artifacts = scoring.cited(scored, events, w, bucket).join(several.select(*SESSION, F.col("source_artifacts").alias("_own")), list(SESSION), "full")
    none = F.array().cast("array<string>")
    artifacts = artifacts.select(*SESSION, F.sort_array(F.array_distinct(F.concat(F.coalesce("artifacts", none), F.coalesce("_own", none)))).alias("_cited"))
    named = sessions.join(artifacts, list(SESSION), "left").withColumn("cited", F.coalesce("_cited", none))
    named = named.select("*", F.to_csv(F.struct(*_finding_cells()), CSV).alias("csv"), members(F.to_json(F.struct("session_id"))).alias("json"))
    told = replace(p, sessions=written(named, "sessions-told"))

    line = lambda report, text: F.struct(F.lit(report).alias("report"), text.alias("line"))
    ruled = lambda rule, points, artifacts, explanation: F.concat(F.lit(","), F.to_csv(F.struct(*_rule_cells(rule, points, artifacts, explanation)), CSV))
    head = lambda rule, points, explanation: members(F.to_json(F.struct(explanation.alias("explanation"), points.cast("long").alias("points"), rule.alias("rule"))))
    tail = lambda artifacts: members(F.to_json(F.struct(artifacts.alias("source_artifacts"))))
    cells = [F.col(c) for c in ("rule", "points", "source_artifacts", "explanation")]
    of = lambda at, place: [placing.part_of(at, p.size).alias("part"), F.col("at"), F.lit(place).cast("long").alias("place")]
    whole = F.array(line(FINDINGS_JSON, finding_document()), line(REPORT_HTML, html_section()), line(FINDINGS_CSV, F.when(F.col("fired") == 0, F.concat("csv", F.lit(",,,,")))))
    after = F.array(line(FINDINGS_JSON, joined_json(head(cells[0], cells[1], cells[3]), "json", tail(cells[2]))), line(FINDINGS_CSV, F.concat("csv", ruled(*cells))))
    own = told.sessions.select(*of(F.col("at"), FIRST), whole.alias("own")).unionByName(
        told.sessions.select(*SESSION, "at", "n", "csv", "json").join(several, list(SESSION)).select(*of(F.col("at") + placing.OWN + F.col("n") - 1, LAST), after.alias("own"))
    )

    path, artifact, rules = F.col("file_path"), F.array("source_artifact"), scoring.fired_rules(w)
    fires = {name: (path.isNotNull() & holds, F.lit(name), F.lit(points), scoring.said(name, path=path)) for name, (holds, points) in rules.items() if name not in scoring.SOON}
    before = members(F.to_json(F.struct(*[F.parse_json("details").alias("details") if c == "details" else F.col(c) for c in BEFORE])))
    then = members(F.to_json(F.struct("source_artifact", isoformat(F.col("timestamp_utc")).alias("timestamp_utc"))))
    files = p.files.select(
        F.col("place").alias("_place"), F.col("timestamp_utc").alias("_at"), path.alias("_path"), artifact.alias("_artifact"), before.alias("_before"), then.alias("_after"), tail(artifact).alias("_tail"),
        *[F.when(holds, ruled(rule, points, artifact, explains)).alias(f"_csv_{name}") for name, (holds, rule, points, explains) in fires.items()],
        *[F.when(holds, head(rule, points, explains)).alias(f"_json_{name}") for name, (holds, rule, points, explains) in fires.items()],
    )
    rows = placing.met(p, placing.pieces(told, "csv", "json", "start_utc"), own, files).withColumn("offset_us", F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("start_utc").cast("timestamp")))
    soon = {name: (F.col("_path").isNotNull() & rules[name][0], F.lit(name), F.lit(rules[name][1]), scoring.said(name, path=F.col("_path"), seconds=scoring.whole_seconds())) for name in scoring.SOON}
    joined = lambda json: joined_json(json, "json", "_tail")
    of_csv = [*[F.when(holds, F.concat("csv", ruled(rule, points, F.col("_artifact"), explains))) for holds, rule, points, explains in soon.values()], *[F.concat("csv", f"_csv_{name}") for name in fires]]
    of_json = [joined_json("_before", "json", "_after"), *[F.when(holds, joined(head(rule, points, explains))) for holds, rule, points, explains in soon.values()], *[joined(f"_json_{name}") for name in fires]]
    # a file's lines in a report are one text
    both = F.array(line(FINDINGS_CSV, F.concat_ws("\n", *of_csv)), line(FINDINGS_JSON, F.concat_ws("\n", *of_json)))
    made = rows.select("part", "at", F.coalesce("_place", "place").alias("place"), F.explode(F.when(F.col("_place").isNotNull(), both).otherwise(F.col("own"))).alias("l")).where("l.line <> ''")
    made = made.select("l.report", "part", "at", "place", "l.line").sortWithinPartitions("report", "part", "at", "place").select("report", "part", "line")

    stated = p.files.select("case_id", "timestamp_utc", "open", "source_artifact", F.concat(F.lit(","), F.to_csv(F.struct(*_told()), CSV)).alias("told"))
    pairs = placing.by_time(p, p.sessions.select("case_id", "session_id", "start_utc", "end_utc", F.to_csv(F.struct("session_id"), CSV).alias("csv")), stated)
    timeline = pairs.select(F.lit(TIMELINE_CSV).alias("report"), "part", "_timestamp_utc", "session_id", "_source_artifact", F.concat("csv", "_told").alias("line"))
    timeline = timeline.sortWithinPartitions("part", "_timestamp_utc", "session_id", "_source_artifact", "line").select("report", "part", "line")
    heads = [(FINDINGS_CSV, -1, ",".join(FINDINGS_COLUMNS)), (TIMELINE_CSV, -1, ",".join(TIMELINE_COLUMNS))]
    return [scored.sparkSession.createDataFrame(heads, "report string, part long, line string"), made, timeline]


def record_lines(manifest: DataFrame, frame: DataFrame) -> list[DataFrame]:
    """The manifest, paths by their components, and the report's frame as (report, part, line)."""
    rows = manifest.withColumn("document", F.to_json(F.struct("kind", "name", "value")))
    parts = F.replace("name", F.lit("/"), F.lit("\x01"))
    kept = [publishing.report(publishing.MANIFEST, rows, F.col("document"), F.col("kind"), parts), publishing.report(FRAME, frame, F.col("html"), F.when(F.col("section") == "limitations", F.lit("0")).when(F.col("section") == "counts", F.lit("1")).otherwise(F.lit("2")))]
    return [publishing.placed(r) for r in kept]


def read_csv(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """A published CSV as a table of texts; its one header is told by its cells, since it is the first part's alone."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).options(**CSV | {"header": "false"}).csv(folder)
    header = F.lit(True)
    for c in columns:
        header = header & F.col(c).eqNullSafe(F.lit(c))
    return rows.where(~header).select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])
