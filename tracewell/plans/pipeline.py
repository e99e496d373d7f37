"""The whole case: events to sessions, contributions, findings and reports."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame

from tracewell.operators import events as E
from tracewell.operators import publishing, reports, scoring, sessions
from tracewell.plans.config import SessionConfig, Thresholds, Weights
from tracewell.shared import written


@dataclass(frozen=True)
class CaseResult:
    """Lazy tables of stored events; nothing more runs until one is written or read."""

    events: DataFrame
    sessions: DataFrame
    devices: DataFrame
    #: Digests of files on the destination, and events with hash_hit where these are stored.
    hashes: DataFrame | None = None
    kept: DataFrame | None = None
    bucket: timedelta | None = None
    weights: Weights | None = None
    thresholds: Thresholds | None = None

    @property
    def marked(self) -> DataFrame:
        """Events with hash_hit."""
        return self.kept if self.kept is not None else scoring.with_hash_hits(self.events, self.hashes)

    @property
    def inside(self) -> DataFrame:
        """Sessions with their files: as many rows as there are pairs."""
        return sessions.sessions_with_files(self.sessions, self.marked, self.bucket)

    @property
    def files(self) -> DataFrame:
        return sessions.files_in_sessions(self.sessions, self.marked, self.bucket)

    @property
    def pairs(self) -> DataFrame:
        """``files`` without hash_hit, so that no digest is looked up."""
        return sessions.files_in_sessions(self.sessions, self.events, self.bucket)

    def pairs_of(self, of_session: tuple[str, ...], of_file: tuple[str, ...]) -> DataFrame:
        """Those columns of ``pairs``, after the session's key, and offset_us; only they are shuffled."""
        return sessions.pairs_of(self.sessions, self.events, of_session, of_file, self.bucket)

    @property
    def timeline(self) -> DataFrame:
        """Rows of the timeline CSV. What a row says of a file is text before the file meets sessions."""
        return reports.timeline_of(self.sessions, self.events, self.bucket)

    @property
    def contributions(self) -> DataFrame:
        return self.contributions_of(tuple(scoring.RULE_INDEX))

    def contributions_of(self, rules: tuple[str, ...], told: dict[str, Column] | None = None) -> DataFrame:
        keys = self.sessions.select(*scoring.SESSION, "start_utc", "end_utc")
        # digests are looked up for those who want to know of them
        marked = self.marked if "destination_hash_match" in rules else scoring.with_hash_hits(self.events, None)
        return scoring.contributions(keys, marked, self.weights, self.bucket, rules, told).drop("start_utc", "end_utc")

    @property
    def findings(self) -> DataFrame:
        return scoring.findings(self.sessions, self.marked, self.weights, self.thresholds, self.bucket)

    @property
    def scored(self) -> DataFrame:
        """Findings with the number of their contributions."""
        return scoring.scored(self.sessions, self.marked, self.weights, self.thresholds, self.bucket)

    @property
    def idle(self) -> DataFrame:
        return sessions.idle(self.sessions, self.events, self.bucket)

    @property
    def explained(self) -> DataFrame:
        """Contributions with their findings and the devices' names."""
        return scoring.explained(self._named, self.marked, self.weights, self.thresholds, self.bucket)

    @property
    def _named(self) -> DataFrame:
        """Sessions with their devices' display_name."""
        return self.sessions.join(self.devices.select("case_id", "device_id", "display_name"), ["case_id", "device_id"], "left")

    @property
    def findings_table(self) -> DataFrame:
        """``reports.findings_rows`` of ``explained``, without their order; cells are text before sessions meet files."""
        return reports.findings_table(self._named, self.marked, self.weights, self.thresholds, self.bucket)

    def stored(self) -> CaseResult:
        """The same with sessions, devices and marked events stored, for those who want more than one of its results; pairs of sessions and files are not."""
        return replace(self, sessions=written(self.sessions, "sessions"), devices=written(self.devices, "devices"), kept=written(self.marked, "marked-events"))

    def lines(self, scored: DataFrame) -> list[DataFrame]:
        """Lines of the reports on sessions, of a stored case and its stored ``scored``."""
        return reports.lines(scored, self.devices, self.marked, self.weights, self.bucket)

    def write_reports(self, folder: str, compression: str = "none") -> None:
        """All reports on sessions, or none if a line of one claims too much."""
        case = self.stored()
        publishing.publish(case.lines(written(case.scored, "findings")), reports.REPORTS, folder, compression)


def correlate(
    events: DataFrame, session: SessionConfig | None = None, weights: Weights | None = None, thresholds: Thresholds | None = None,
    hashes: DataFrame | None = None, bucket: timedelta | None = timedelta(days=1), strict: bool = True,
) -> CaseResult:
    """Correlate the events of any number of cases at once. Valid events are stored, since each result reads them several times."""
    valid = written(E.validated(events, strict), "valid-events")
    found = sessions.reconstruct(valid, session)
    return CaseResult(valid, found, sessions.first_seen_devices(valid), hashes, None, bucket, weights, thresholds)
