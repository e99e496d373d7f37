"""Timestamps of Windows artifacts as column expressions (session time zone: UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds between 1601-01-01 and 1970-01-01, and the last FILETIME before the year 10000.
EPOCH_GAP = 11_644_473_600_000_000
LAST_FILETIME = 2_650_467_743_999_999_999


def filetime(ticks: Column, strict: bool = True) -> Column:
    """100 ns ticks since 1601 as a timestamp, rounded down; 0 is 1601. Out of range: an error, or null if not strict."""
    value = ticks.cast("decimal(20,0)")
    good = F.timestamp_micros((F.floor(value / 10) - F.lit(EPOCH_GAP)).cast("long"))
    bad = F.raise_error(F.concat(F.lit("FILETIME out of range: "), ticks.cast("string"))).cast("timestamp") if strict else F.lit(None).cast("timestamp")
    return F.when(ticks.isNull(), F.lit(None).cast("timestamp")).when((value >= 0) & (value <= LAST_FILETIME), good).otherwise(bad)


def filetime_bytes(raw: Column) -> Column:
    """Ticks of 8 little-endian bytes as decimal; null if there are not 8 or all are 0."""
    digits = F.concat_ws("", F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(F.hex(raw), i, F.lit(2))))
    return F.when(F.octet_length(raw) == 8, F.nullif(F.conv(digits, 16, 10).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")))


def dos_datetime(date: Column, time: Column, zone: str) -> Column:
    """Packed DOS date and time of a local zone as UTC; null for impossible fields and for times that a clock change skips.

    A time that occurs twice is taken as the first.
    """
    part = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(mask)
    local = F.try_make_timestamp_ntz(part(date, 9, 127) + 1980, part(date, 5, 15), part(date, 0, 31), part(time, 11, 31), part(time, 5, 63), part(time, 0, 31) * 2)
    utc = F.to_utc_timestamp(local.cast("timestamp"), zone)
    return F.when(F.from_utc_timestamp(utc, zone) == local.cast("timestamp"), utc)


def iso8601(text: Column) -> Column:
    """ISO 8601 with an offset as UTC, digits under a microsecond cut off; null without an offset."""
    clean = F.trim(text)
    return F.when(clean.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$"), clean.try_cast("timestamp"))


def isoformat(ts: Column) -> Column:
    """2026-01-01T09:00:00+00:00, with six digits of fraction if there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))
