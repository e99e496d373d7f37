"""Sessions of events that arrive over time: keyed state for each device, a watermark for what is final, late events told.

A session depends on the events before and after it, so what lies behind the watermark is final and the rest provisional. The
state of a device holds its last final insert, if that is open, and the events that the watermark has not passed; both are
few. Whenever events of a device arrive, its final sessions are given once, and its provisional ones anew under a higher
version, as if the stream ended there: an open insert ends after the idle gap. ``settled`` reads such a table: final sessions,
and each device's provisional ones of its highest version. At the end of the stream that is what ``sessions.reconstruct``
gives for the same events. There are no timers: with them Spark would drop late events before anything could tell of them,
and they would change no session that ``settled`` reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.functions.timestamps import isoformat
from tracewell.operators.events import INSERT, REMOVE, order_key
from tracewell.plans.config import SessionConfig
from tracewell.shared import ship

STATE = "seen long, version long, open_us long, times array<long>, ties array<string>, inserts array<boolean>"
OUT = "case_id string, device_id string, status string, version long, ordinal long, start_us long, start_observed boolean, end_us long, end_observed boolean"
FINAL, PROVISIONAL, MARK, LATE = "final", "provisional", "mark", "late"
#: Columns whose order decides between events of one device and time; those of ``sessions.lifecycle``.
TIED = (2, 1, 3, 4, 5, 6, 7)


def _sessions(open_us: int | None, seen: int, events: list[tuple[int, str, bool]], gap: int) -> Iterator[tuple]:
    """(ordinal, start, whether observed, end, whether observed, whether a later event ends it) from events in order.

    ``open_us``: the time of an insert before them, number ``seen``, whose session no event has ended yet.
    """
    previous = (open_us, seen) if open_us is not None else None
    for ordinal, (at, _, insert) in enumerate(events, seen + 1):
        if previous:
            yield previous[1], previous[0], True, at, not insert, True
        elif not insert:
            yield ordinal, at - gap, False, at, True, True
        previous = (at, ordinal) if insert else None
    if previous:
        yield previous[1], previous[0], True, previous[0] + gap, False, False


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    """``rows`` as a table of ``OUT``; numbers that may be missing are made of arrays and their masks, since a device has few rows."""
    status, version, *rest = zip(*rows, strict=True)
    out = {"case_id": [key[0]] * len(rows), "device_id": [key[1]] * len(rows), "status": list(status), "version": np.array(version, dtype="int64")}
    for name, values in zip(("ordinal", "start_us", "start_observed", "end_us", "end_observed"), rest, strict=True):
        missing, flag = np.array([v is None for v in values]), name.endswith("observed")
        filled = np.array([v or 0 for v in values], dtype="bool" if flag else "int64")
        out[name] = pd.arrays.BooleanArray(filled, missing) if flag else pd.arrays.IntegerArray(filled, missing)
    return pd.DataFrame(out)


def _tracked(gap: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, version, open_us, times, ties, inserts = state.get if state.exists else (0, 0, None, [], [], [])
        passed = state.getCurrentWatermarkMs() * 1000
        held, rows = list(zip(times, ties, inserts, strict=True)), []
        for batch in batches:
            for at, tie, insert in zip(batch["at_us"].tolist(), batch["tie"].tolist(), batch["is_insert"].tolist(), strict=True):
                if at <= passed and version:
                    # what the watermark has passed is final; the event is told and changes nothing
                    rows.append((LATE, version, None, at, insert, at, insert))
                else:
                    held.append((at, tie, insert))
        held.sort()
        cut = sum(at <= passed for at, _, _ in held)
        version += 1
        for ordinal, *ends, ended in _sessions(open_us, seen, held[:cut], gap):
            if ended:
                rows.append((FINAL, version, ordinal, *ends))
        if cut:
            open_us = held[cut - 1][0] if held[cut - 1][2] else None
            seen, held = seen + cut, held[cut:]
        rows += [(PROVISIONAL, version, ordinal, *ends) for ordinal, *ends, _ in _sessions(open_us, seen, held, gap)]
        rows.append((MARK, version, None, None, None, None, None))
        state.update((seen, version, open_us, *(list(c) for c in (zip(*held, strict=True) if held else ([], [], [])))))
        yield _frame(key, rows)

    return run


def track(events: DataFrame, config: SessionConfig | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream of events to a stream of sessions: status, version, and the session's columns; see ``settled``.

    ``delay``: how much later than others an event may arrive; one that is later still gives a row of status 'late' and no session.
    Events without a device are left to ``events.violations``.
    """
    ship(events.sparkSession)
    gap = int((config or SessionConfig()).idle_gap / timedelta(microseconds=1))
    order = order_key()
    tie = F.concat_ws("\x01", *[order[i].cast("string") for i in TIED], F.lpad(F.col("ingest_ord").cast("string"), 19, "0"))
    rows = events.where(F.col("event_type").isin(INSERT, REMOVE) & (F.trim(F.coalesce("device_id", F.lit(""))) != "")).withColumn("at", F.col("timestamp_utc").cast("timestamp")).withWatermark("at", delay)
    narrow = rows.select("case_id", "device_id", "at", F.unix_micros("at").alias("at_us"), tie.alias("tie"), (F.col("event_type") == INSERT).alias("is_insert"))
    return narrow.groupBy("case_id", "device_id").applyInPandasWithState(_tracked(gap), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def settled(rows: DataFrame) -> DataFrame:
    """Sessions as ``sessions.reconstruct`` has them, of the table that ``track`` was written to."""
    last = rows.groupBy("case_id", "device_id").agg(F.max("version").alias("last"))
    valid = rows.join(last, ["case_id", "device_id"]).where((F.col("status") == FINAL) | ((F.col("status") == PROVISIONAL) & (F.col("version") == F.col("last"))))
    start, end = F.timestamp_micros("start_us"), F.timestamp_micros("end_us")
    named = valid.select("case_id", "device_id", "ordinal", start.alias("start_utc"), "start_observed", end.alias("end_utc"), "end_observed", F.concat_ws(":", "device_id", isoformat(start)).alias("session_id"))
    return named.withColumn("fully_observed", F.col("start_observed") & F.col("end_observed")).withColumn("duration_us", F.expr("timestampdiff(MICROSECOND, start_utc, end_utc)"))
