"""Connection sessions from insert and remove events, and the file activity inside them.

An insert always opens a session and a remove always closes what is open, so a session depends only
on neighbouring events of its device: one window per device, no state. Files join sessions by
time alone, within a case: an interval join, dealt by time buckets. What is only counted of a session's files is
told by running sums at its ends, so that work grows with events and sessions, not with their pairs.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.errors import SessionError
from tracewell.functions.timestamps import isoformat
from tracewell.operators.events import ACCESS, INSERT, REMOVE, order_key
from tracewell.plans.config import SessionConfig
from tracewell.shared import running, width, written

DEVICE = ("serial_number", "vendor", "product", "friendly_name")
#: Sessions, and files, that meet at once; time buckets in which blocks are made, as a session is told anew in each; and tasks for each that Spark
#: would take, as few rows give many pairs.
BLOCK, SPAN, DEALT = 256, 2, 4


def _gap(config: SessionConfig | None) -> Column:
    return F.expr(f"INTERVAL '{(config or SessionConfig()).idle_gap / timedelta(seconds=1):.6f}' SECOND")


def lifecycle(events: DataFrame, inserts: tuple[str, ...] = (INSERT,), removes: tuple[str, ...] = (REMOVE,)) -> DataFrame:
    """Insert and remove events with their neighbours of the same device. A type in both sets is an insert; a missing device is an error."""
    rows = events.where(F.col("event_type").isin(*inserts, *removes))
    known = F.when(F.trim(F.coalesce("device_id", F.lit(""))) != "", F.col("device_id")).otherwise(F.raise_error(F.lit(f"{SessionError.__name__}: a lifecycle event has no device")).cast("string"))
    rows = rows.withColumn("device_id", known).withColumn("is_insert", F.col("event_type").isin(*inserts))
    # within a device: time, then source, then the rest of the timeline's order
    key = order_key()
    order = Window.partitionBy("case_id", "device_id").orderBy(key[0], key[2], key[1], *key[3:])
    return (
        rows.withColumn("next_insert", F.lead("is_insert").over(order))
        .withColumn("next_time", F.lead("timestamp_utc").over(order))
        .withColumn("previous_insert", F.lag("is_insert").over(order))
        .withColumn("ordinal", F.row_number().over(order).cast("long"))
    )


def reconstruct(events: DataFrame, config: SessionConfig | None = None, inserts: tuple[str, ...] = (INSERT,), removes: tuple[str, ...] = (REMOVE,)) -> DataFrame:
    """Sessions: case_id, device_id, ordinal (key within a device), both ends and whether they were observed, session_id, duration.

    Insert then remove: both ends observed. Insert then insert: ends, inferred, at the second. Insert alone: ends, inferred,
    after the idle gap. Remove without an insert before: started, inferred, the idle gap earlier.
    """
    rows = lifecycle(events, inserts, removes).where(F.col("is_insert") | ~F.coalesce("previous_insert", F.lit(False)))
    gap, at, insert = _gap(config), F.col("timestamp_utc"), F.col("is_insert")
    start = F.when(insert, at).otherwise(at - gap)
    end = F.when(~insert, at).when(F.col("next_time").isNotNull(), F.col("next_time")).otherwise(at + gap)
    sessions = rows.select("case_id", "device_id", "ordinal", start.alias("start_utc"), insert.alias("start_observed"), end.alias("end_utc"), (~insert | F.coalesce(~F.col("next_insert"), F.lit(False))).alias("end_observed"))
    return sessions.withColumn("session_id", F.concat_ws(":", "device_id", isoformat(F.col("start_utc")))).withColumn("fully_observed", F.col("start_observed") & F.col("end_observed")).withColumn("duration_us", F.expr("timestampdiff(MICROSECOND, start_utc, end_utc)"))


def first_seen_devices(events: DataFrame, types: tuple[str, ...] = (INSERT, REMOVE)) -> DataFrame:
    """Attributes of each device as its first lifecycle event in the input has them, and the name to show."""
    rows = events.where(F.col("event_type").isin(*types)).groupBy("case_id", "device_id").agg(F.min_by(F.struct(*DEVICE), "ingest_ord").alias("d")).select("case_id", "device_id", "d.*")
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.withColumn("display_name", F.coalesce(text("friendly_name"), text("product"), "device_id"))


def bucket_of(time: str, bucket: timedelta | None) -> Column:
    """Number of the time bucket; one for all times without ``bucket``."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast({time} AS timestamp_ntz)) div {int(bucket / timedelta(microseconds=1))}") if bucket else F.lit(0).cast("long")


def gathered(rows: DataFrame, cell: list[str], order: list[Column], until: Column) -> DataFrame:
    """``rows`` of each cell in arrays of ``BLOCK`` at most, in ``order``: the cell, first_ and last_ (from the first time to the latest of ``until``) and block_."""
    placed = rows.withColumn("_until", until).withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    own = F.struct("_n", *[c for c in rows.columns if c not in cell])
    return placed.groupBy(*cell, F.expr(f"(_n - 1) div {BLOCK}").alias("_block")).agg(F.min(order[0]).alias("first_"), F.max("_until").alias("last_"), F.sort_array(F.collect_list(own)).alias("block_")).drop("_block")


def met(sessions: DataFrame, files: DataFrame, bucket: timedelta | None, how: str = "inner", until: str = "end_utc") -> DataFrame:
    """Sessions with the files of their case between their start and ``until``, both included.

    ``bucket``: both sides are dealt by case and time bucket, a session once to each bucket it touches, so that the join
    is an equi-join whose tasks stay small; None: the plain condition on the case, for few sessions.

    With ``bucket`` and for an inner join, blocks of sessions meet blocks of files, both in order of time, and pairs are made
    where they are wanted: session after session, each with the files of a block in order. Columns of sessions are then long
    runs and those of files repeat, so that a columnar file of the pairs is small. No pair is sorted.
    """
    # microseconds are counted once of each row, not of each pair
    micros = lambda time: F.unix_micros(F.col(time).cast("timestamp"))
    ends, files = sessions.withColumn("_start_us", micros("start_utc")), files.withColumnRenamed("case_id", "_case").withColumn("_at_us", micros("timestamp_utc"))
    tasks = width(sessions.sparkSession)
    same, inside = F.col("case_id") == F.col("_case"), F.expr(f"timestamp_utc BETWEEN start_utc AND {until}")
    if bucket and how == "inner":
        bucket, tasks = SPAN * bucket, DEALT * tasks
    if bucket:
        ends = ends.withColumn("bucket", F.explode(F.sequence(bucket_of("start_utc", bucket), bucket_of(until, bucket))))
        files = files.withColumn("_bucket", bucket_of("timestamp_utc", bucket))
        same = same & (F.col("bucket") == F.col("_bucket"))
        if how == "inner":
            ends, files = ends.where("case_id IS NOT NULL"), files.where("_case IS NOT NULL")
        # a given number of tasks, since few rows give many pairs: Spark would put small parts together
        ends, files = ends.repartition(tasks, "case_id", "bucket"), files.repartition(tasks, "_case", "_bucket")
    if bucket and how == "inner":
        of = lambda array, rows, cell: [F.col(f"{array}.{c}") for c in rows.columns if c not in cell]
        left = gathered(ends, ["case_id", "bucket"], [F.col("start_utc"), F.col(until)], F.col(until)).withColumnRenamed("block_", "_sessions")
        right = gathered(files, ["_case", "_bucket"], [F.col("timestamp_utc")], F.col("timestamp_utc")).withColumnsRenamed({"first_": "timestamp_utc", "last_": "_latest", "block_": "_files"})
        # blocks are few but wide: sorted, since an estimate of their size would send them to all tasks
        blocks = left.join(right.hint("merge"), same & F.expr("timestamp_utc <= last_ AND first_ <= _latest"))
        each = blocks.select("case_id", F.col("timestamp_utc").alias("_first"), "_latest", "_files", F.explode("_sessions").alias("_s")).where(F.expr(f"_first <= _s.{until} AND _s.start_utc <= _latest"))
        each = each.select("case_id", *of("_s", ends, ("case_id", "bucket")), "_files").select("*", F.explode("_files").alias("_f")).drop("_files")
        pairs = each.select(*sessions.columns, "_start_us", *of("_f", files, ("_case", "_bucket"))).where(inside)
    else:
        pairs = ends.join(files, same & inside, how).drop("bucket", "_bucket", "_case")
    return pairs.withColumn("offset_us", F.col("_at_us") - F.col("_start_us")).drop("_at_us", "_start_us")


def sessions_with_files(sessions: DataFrame, events: DataFrame, bucket: timedelta | None = timedelta(days=1), how: str = "left") -> DataFrame:
    """Each session with each file event of its case within it, both ends included; rows without a file keep sessions that have none.

    ``bucket`` as in ``met``; a bucket of a session without a file is a row without one, unless ``how`` is inner.
    """
    files = events.where(F.col("event_type") == ACCESS)
    files = files.drop("device_id", *DEVICE, *[c for c in (*sessions.columns, "bucket") if c in files.columns and c not in ("case_id", "device_id")])
    return met(sessions, files, bucket, how)


def files_in_sessions(sessions: DataFrame, events: DataFrame, bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """File events within sessions of their case, both ends included; a file joins every session that holds it."""
    return files_of(sessions_with_files(sessions, events, bucket, "inner"))


def pairs_of(sessions: DataFrame, events: DataFrame, of_session: tuple[str, ...], of_file: tuple[str, ...], bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """Columns of ``files_in_sessions``: the session's key, ``of_session``, ``of_file`` and offset_us. Only they are gathered."""
    key, times = ("case_id", "device_id", "ordinal"), ("start_utc", "end_utc")
    own = sessions.select(*dict.fromkeys((*key, *times, *of_session)))
    files = events.where(F.col("event_type") == ACCESS).select(*dict.fromkeys(("case_id", "timestamp_utc", *of_file)))
    return met(own, files, bucket).select(*key, *of_session, *of_file, "offset_us")


def files_of(inside: DataFrame) -> DataFrame:
    return inside.where("event_type IS NOT NULL").drop("start_observed", "end_observed", "fully_observed", "duration_us")


def without_files(sessions: DataFrame, inside: DataFrame) -> DataFrame:
    return sessions.join(inside.select("case_id", "device_id", "ordinal").distinct(), ["case_id", "device_id", "ordinal"], "left_anti")


def tallied(sessions: DataFrame, files: DataFrame, sums: dict[str, tuple[Column, timedelta | None]], mark: Column | None = None, bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """``sessions`` with sums over the files that each holds, without its pairs with them.

    ``sums``: for each name a whole number of a file, and how long after a session's start files count (None: to its end).
    ``mark``: a text of some files; ``several`` says whether a session's files have two different ones.

    Files and the ends of sessions, probes, are put in order within time buckets of a case, and a probe takes what came before
    it; totals of whole buckets are added. A session's sum is the difference of two probes. Marks are numbered in their order,
    and a probe knows the number of the last one that differs from the mark before it: a session has two different marks
    if that comes after the first one in it.
    """
    names, spans = list(sums), sorted({span for _, span in sums.values() if span is not None})
    mark = F.lit(None).cast("string") if mark is None else mark
    end = lambda span: F.least(F.col("end_utc"), F.col("start_utc") + F.expr(f"INTERVAL '{span / timedelta(seconds=1):.6f}' SECOND"))
    probe = lambda number, at, side: F.struct(F.lit(number).alias("probe"), at.alias("at"), F.lit(side).alias("side"))
    # at one time: starts, files, ends
    probes = [probe(0, F.col("start_utc"), 0), probe(1, F.col("end_utc"), 2), *[probe(i, end(span), 2) for i, span in enumerate(spans, 2)]]
    asked = sessions.select("case_id", "device_id", "ordinal", F.explode(F.array(*probes)).alias("p")).select("case_id", "device_id", "ordinal", "p.*")
    given = files.select("case_id", F.col("timestamp_utc").alias("at"), F.lit(1).alias("side"), mark.alias("mark"), *[value.cast("long").alias(name) for name, (value, _) in sums.items()])
    rows = given.unionByName(asked, allowMissingColumns=True).withColumn("bucket", bucket_of("at", bucket))
    order = Window.partitionBy("case_id", "bucket").orderBy("at", "side", "mark")
    past, until = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    rows = rows.select("*", F.last("mark", ignorenulls=True).over(past).alias("_before"), F.count("mark").over(until).alias("_marks"), F.lead("side").over(order).isNull().alias("_last"), F.first("mark", ignorenulls=True).over(until).alias("_first"))
    rows = rows.select(
        "case_id", "bucket", "device_id", "ordinal", "probe", "_last", "_marks", F.max(F.when(F.col("mark") != F.col("_before"), F.col("_marks"))).over(until).alias("_changed"),
        *[F.coalesce(F.sum(name).over(until), zero).alias(name) for name in names], *[F.when(F.col("_last"), c).alias(c_) for c_, c in (("_head", F.col("_first")), ("_tail", F.coalesce("mark", "_before")))],
    )
    kept = written(rows.where("probe IS NOT NULL OR _last"), "session-probes")
    earlier = Window.partitionBy("case_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = kept.where("_last").select("*", F.coalesce(F.sum("_marks").over(earlier), zero).alias("_base"), (F.col("_head") != F.last("_tail", ignorenulls=True).over(earlier)).alias("_turns"))
    # the first mark of a bucket is judged by the last one of the buckets before
    changed = F.col("_base") + F.coalesce("_changed", F.when(F.coalesce("_turns", F.lit(False)) & (F.col("_marks") > 0), F.lit(1)))
    whole = whole.withColumn("_own", changed).select("case_id", "bucket", "_base", "_turns", F.last("_own", ignorenulls=True).over(earlier).alias("_changed_before"), *[F.coalesce(F.sum(name).over(earlier), zero).alias(f"_{name}") for name in names])
    met = kept.where("probe IS NOT NULL").join(whole, ["case_id", "bucket"]).withColumn("_at", F.coalesce(changed, "_changed_before", zero)).withColumn("_marks", F.col("_marks") + F.col("_base"))
    of = lambda number, value: F.max(F.when(F.col("probe") == number, value))
    number = lambda span: 1 if span is None else spans.index(span) + 2
    total = lambda name: F.col(name) + F.col(f"_{name}")
    found = met.groupBy("case_id", "device_id", "ordinal").agg(*[(of(number(span), total(name)) - of(0, total(name))).alias(name) for name, (_, span) in sums.items()], (of(1, F.col("_at")) >= of(0, F.col("_marks")) + 2).alias("several"))
    none = {name: F.coalesce(name, zero) for name in names} | {"several": F.coalesce("several", F.lit(False))}
    return sessions.join(found, ["case_id", "device_id", "ordinal"], "left").withColumns(none)


def joined_bits(sessions: DataFrame, files: DataFrame, bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """(case_id, device_id, ordinal, word, bits): of the files that each session holds the bits, joined, without its pairs with them.

    ``files``: case_id, timestamp_utc, word, bits. The moments of files are numbered within time buckets of a case. Two numbers
    part at their highest differing bit: what lies between them is the end of one block of that size and the beginning of the
    next. Bits are joined from the middle outwards in each block that is asked for, so a session within a bucket takes two of
    these sums, and one over several buckets their ends and whole buckets. A moment is in one sum for each size of blocks.
    """
    given = files.where("case_id IS NOT NULL").groupBy("case_id", bucket_of("timestamp_utc", bucket).alias("bucket"), F.col("timestamp_utc").alias("at"), "word").agg(F.bit_or("bits").alias("bits"))
    given = written(given, "moments-of-files")
    ends = F.explode(F.array(F.struct(F.col("start_utc").alias("at"), F.lit(0).alias("side")), F.struct(F.col("end_utc").alias("at"), F.lit(2).alias("side")))).alias("p")
    asked = sessions.where("case_id IS NOT NULL").select("case_id", "device_id", "ordinal", ends).select("case_id", "device_id", "ordinal", "p.*").withColumn("bucket", bucket_of("at", bucket))
    # at one time: starts, files, ends
    until = Window.partitionBy("case_id", "bucket").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    rows = given.select("case_id", "bucket", "at", F.lit(1).alias("side")).distinct().unionByName(asked, allowMissingColumns=True)
    placed = written(rows.withColumn("place", F.count(F.when(F.col("side") == 1, 1)).over(until)), "moments-in-order")
    at = lambda side, value: F.max(F.when(F.col("side") == side, value))
    spans = placed.where("side <> 1").groupBy("case_id", "device_id", "ordinal").agg(at(0, F.col("bucket")).alias("b"), at(2, F.col("bucket")).alias("b_last"), at(0, F.col("place")).alias("lo"), at(2, F.col("place") - 1).alias("hi"))
    spans = spans.where("b < b_last OR lo <= hi").withColumn("l", F.expr("cast(length(bin(lo ^ hi)) - 1 AS int)"))
    # blocks with even numbers end in the middle, those with odd ones begin there; level -1 is the whole bucket, both ways
    ask = lambda b, level, block, place: f"named_struct('bucket', {b}, 'level', {level}, 'block', {block}, 'place', {place})"
    within = f"array({ask('b', 'l', 'shiftright(lo, l)', 'lo')}, {ask('b', 'l', 'shiftright(hi, l)', 'hi')})"
    across = f"array({ask('b', '-1', '0L', 'lo')}, {ask('b_last', '-1', '1L', 'hi')})"
    whole = f"transform(sequence(b + 1, b_last - 1), x -> {ask('x', '-1', '1L', 'cast(9223372036854775807 AS long)')})"
    sums = F.expr(f"CASE WHEN b = b_last THEN {within} WHEN b + 1 = b_last THEN {across} ELSE concat({across}, {whole}) END")
    probes = written(spans.select("case_id", "device_id", "ordinal", F.explode(sums).alias("p")).select("case_id", "device_id", "ordinal", "p.*"), "sums-asked")
    levels = probes.select("case_id", "bucket", "level").distinct()
    numbered_ = given.join(placed.where("side = 1").select("case_id", "bucket", "at", (F.col("place") - 1).alias("place")), ["case_id", "bucket", "at"]).join(levels, ["case_id", "bucket"])
    dealt = numbered_.select("case_id", "bucket", "level", F.explode(F.expr("CASE WHEN level < 0 THEN array(0L, 1L) ELSE array(shiftright(place, level)) END")).alias("block"), "place", "word", "bits")
    wanted = probes.join(given.select("case_id", "bucket", "word").distinct(), ["case_id", "bucket"])
    outwards = Window.partitionBy("case_id", "bucket", "level", "block", "word").orderBy(F.when(F.col("block") % 2 == 0, -F.col("place")).otherwise(F.col("place")), F.col("ordinal").isNotNull())
    met = dealt.unionByName(wanted, allowMissingColumns=True).withColumn("bits", F.bit_or("bits").over(outwards.rowsBetween(Window.unboundedPreceding, 0)))
    return met.where("ordinal IS NOT NULL AND bits IS NOT NULL").groupBy("case_id", "device_id", "ordinal", "word").agg(F.bit_or("bits").alias("bits"))


def idle(sessions: DataFrame, events: DataFrame, bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """Sessions without a file event of their case in them, told by counts."""
    counted = tallied(sessions, events.where(F.col("event_type") == ACCESS), {"_files": (F.lit(1), None)}, bucket=bucket)
    return counted.where("_files = 0").select(*sessions.columns)


def numbered(sessions: DataFrame, files: DataFrame, order: list[Column], bucket: timedelta | None = timedelta(days=1)) -> tuple[DataFrame, DataFrame]:
    """``sessions`` and ``files`` with ``before``, the files of the case that come before; files of one time are in ``order``.

    A file's place in a session is the difference of the two, so no session's files are gathered to number them.
    """
    starts = sessions.select("case_id", "device_id", "ordinal", F.col("start_utc").alias("timestamp_utc"), F.lit(0).alias("_file"))
    rows = files.withColumn("_file", F.lit(1)).unionByName(starts, allowMissingColumns=True).withColumn("bucket", bucket_of("timestamp_utc", bucket))
    placed = written(running(rows, ["case_id"], "bucket", [F.col("timestamp_utc"), F.col("_file"), *order], F.col("_file").cast("long"), "before"), "files-in-order")
    return sessions.join(placed.where("_file = 0").select("case_id", "device_id", "ordinal", "before"), ["case_id", "device_id", "ordinal"]), placed.where("_file = 1").select(*files.columns, "before")
