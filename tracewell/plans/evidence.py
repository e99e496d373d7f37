"""From a folder of evidence to published reports: intake, dispatch to parsers, correlation, a second look at every digest."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracewell.errors import ArtifactError, IntegrityError
from tracewell.operators import events as E
from tracewell.operators import publishing, reports
from tracewell.plans.config import CaseConfig, SessionConfig, Thresholds, Weights
from tracewell.plans.pipeline import CaseResult, correlate
from tracewell.shared import written
from tracewell.sources import event_xml, intake, registry, shortcuts
from tracewell.sources.exports import VALUE_EXPORT, XML_EXPORT


@dataclass(frozen=True)
class Examined:
    artifacts: DataFrame
    case: CaseResult
    manifest: DataFrame
    #: One row: verified, or failed.
    verdict: DataFrame
    #: What was counted in the passes that read and wrote it: artifacts, artifacts_after, events, and findings of written reports.
    counts: dict[str, int] = field(default_factory=dict)


def counted(df: DataFrame, name: str, label: str, counts: dict[str, int]) -> DataFrame:
    """``df``, stored; its number of rows is observed as it is written, not by another scan."""
    seen = Observation(name)
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    counts[name] = seen.get["n"]
    return out


def parser_of(name: Column, kind: Column) -> Column:
    """(parser_name, parser_version) of the parser that an artifact goes to; null for what no parser reads."""
    one = lambda parser, version: F.struct(F.lit(parser).alias("parser_name"), F.lit(version).alias("parser_version"))
    low = F.lower(name)
    out = F.when(low.endswith(XML_EXPORT), one(event_xml.NAME, event_xml.VERSION)).when(low.endswith(VALUE_EXPORT), one(registry.NAME, registry.VERSION))
    return out.when(kind == intake.SHORTCUT, one(*shortcuts.LNK)).when(kind == intake.JUMP_LIST, one(*shortcuts.JUMP))


def parsers_of(found: DataFrame) -> DataFrame:
    """(parser_name, parser_version) of all artifacts' parsers, whether they gave events or not."""
    return found.select(parser_of(F.col("rel_path"), F.col("artifact_type")).alias("p")).where("p IS NOT NULL").select("p.*").distinct()


def dispatched(found: DataFrame, root: str, case_id: str) -> DataFrame:
    """Events of all artifacts, each kind by its parser; what no parser reads is hashed and has no events."""
    spark = found.sparkSession
    values = written(registry.read(spark, root), "registry-values")
    binary = intake.contents(found.where(F.col("artifact_type").isin(intake.SHORTCUT, intake.JUMP_LIST)))
    return E.united(event_xml.read(spark, root, case_id), registry.events(values, case_id), shortcuts.events(binary, case_id)).drop("stream")


def examine(
    spark: SparkSession, config: CaseConfig, session: SessionConfig | None = None, weights: Weights | None = None, thresholds: Thresholds | None = None,
    hashes: DataFrame | None = None, write_reports: bool = True, limitations: str | None = None, started: datetime | None = None, ended: datetime | None = None, strict: bool = True,
) -> Examined:
    """Run a case from its evidence folder to its reports (none are written without ``write_reports``).

    Without any artifact there is nothing to examine: an error. All reports are published together, or none: a line that claims
    too much ends the run, and so does evidence that has changed meanwhile, unless ``strict`` is off; then the manifest says that
    verification failed. ``started`` and ``ended`` fix the times of the manifest, ``limitations`` is the examiner's text on what
    results can't show. With fixed times two runs write the same bytes.
    """
    began, counts = started or datetime.now(timezone.utc), {}
    found = counted(intake.artifacts(spark, config.evidence_dir), "artifacts", "artifacts", counts)
    if not counts["artifacts"]:
        raise ArtifactError(f"no evidence below {config.evidence_dir}")
    events = counted(dispatched(found, config.evidence_dir, config.case_id), "events", "events", counts)
    case = correlate(events, session, weights, thresholds, hashes)
    after = counted(intake.artifacts(spark, config.evidence_dir), "artifacts_after", "artifacts-after", counts)
    verdict = written(intake.compared(found, after), "verdict")
    said = verdict.first().verdict
    if strict and said != "verified":
        raise IntegrityError("the evidence has changed since intake; nothing was published")
    settings = {k: v for part in (config, session or SessionConfig(), weights or Weights(), thresholds or Thresholds()) for k, v in part.snapshot().items()}
    record = reports.manifest(config.case_id, config.examiner, found, parsers_of(found), settings, began, ended or datetime.now(timezone.utc), after, said)
    if write_reports:
        case = case.stored()
        lines = case.lines(counted(case.scored, "findings", "findings", counts))
        frame = reports.report_frame(spark, record, reports.limitations(limitations), counts)
        publishing.publish([*lines, *reports.record_lines(record, frame)], (*reports.REPORTS, reports.FRAME, publishing.MANIFEST), config.output_dir)
    return Examined(found, case, record, verdict, counts)
