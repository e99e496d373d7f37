"""Where each line of the reports goes, told before any line is made.

Files and the ends of sessions are numbered in one order of case and time, so that a session's files are a range of numbers.
Sessions are laid one after another in the order of the findings, each as long as its files are many, and cut into parts of
near-equal length; a session with many files is cut too. A part meets the files of its pieces and no others: what is shuffled
are sessions and files, not their pairs, and lines are made where they are written. The timeline is cut by moments likewise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.events import ACCESS, order_key
from tracewell.shared import ranged, running, width, written

SESSION = ("case_id", "device_id", "ordinal")
#: Pairs in a part, at least and at most; what a session counts besides its files; the numbers of files that are met together.
LEAST, MOST, OWN, BLOCK = 1 << 12, 1 << 16, 32, 256
#: What a file or the start of a session counts in the timeline besides pairs, and tasks at most: beyond them a task has several parts.
ALONE, TASKS = 8, 1 << 13


@dataclass(frozen=True)
class Placed:
    """``sessions``: with first (number of the first file), n (files) and at (place among all lines); ``files``: with place."""

    sessions: DataFrame
    files: DataFrame
    #: Length of a part, and number of tasks.
    size: int
    tasks: int


def placed(sessions: DataFrame, events: DataFrame) -> Placed:
    """Number the files and lay out the sessions, whose columns case_id, device_id, ordinal, start_utc, end_utc and session_id are looked at."""
    ends = F.explode(F.array(F.struct(F.col("start_utc").alias("timestamp_utc"), F.lit(0).alias("_side")), F.struct(F.col("end_utc").alias("timestamp_utc"), F.lit(2).alias("_side")))).alias("p")
    asked = sessions.select(*SESSION, ends).select(*SESSION, "p.*")
    rows = events.where(F.col("event_type") == ACCESS).withColumn("_side", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    # at one time: starts, files, ends
    order = [F.col("case_id"), F.col("timestamp_utc"), F.col("_side"), *[order_key()[i] for i in (2, 1, 3, 5, 6, 7, 8)]]
    dealt = ranged(rows, order, "files-by-case", out="_range")
    step = F.when(F.col("_side") == 0, F.lit(1)).when(F.col("_side") == 2, F.lit(-1)).otherwise(F.lit(0)).cast("long")
    counted = running(dealt, [], "_range", [*order, F.col("row")], (F.col("_side") == 1).cast("long"), "place")
    counted = written(running(counted, [], "_range", [*order, F.col("row")], step, "open").drop("row", "_range"), "files-in-order")
    at = lambda side: F.max(F.when(F.col("_side") == side, F.col("place")))
    spans = counted.where("_side <> 1").groupBy(*SESSION).agg(at(0).alias("first"), (at(2) - at(0)).alias("n"))
    none = F.lit(0).cast("long")
    found = sessions.join(spans, list(SESSION), "left").withColumns({"first": F.coalesce("first", none), "n": F.coalesce("n", none)})
    last = F.asc_nulls_last
    order = [last("case_id"), last("start_utc"), last("device_id"), last("session_id"), last("ordinal")]
    laid = written(running(ranged(found, order, "sessions-by-start", out="_range"), [], "_range", [*order, F.col("row")], F.col("n") + OWN, "at").drop("row", "_range"), "sessions-in-order")
    total = laid.agg(F.sum(F.col("n") + OWN)).first()[0] or 0
    size = max(LEAST, min(MOST, -(-total // (2 * width(sessions.sparkSession)))))
    return Placed(laid, counted.where("_side = 1").drop("_side", "ordinal"), size, max(fewest(sessions.sparkSession), min(TASKS, -(-total // size))))


def fewest(spark: SparkSession) -> int:
    """Tasks that Spark wants for a join: with fewer it deals both sides anew."""
    return max(width(spark), int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 0))


def part_of(at: Column, size: int) -> Column:
    return F.floor(at / F.lit(size)).cast("long")


def pieces(p: Placed, *columns: str) -> DataFrame:
    """``columns`` of sessions for each part and block of files that a session has files in: part, block, at, and the numbers lo to hi of its files there."""
    begin = F.col("at") + OWN
    cut = p.sessions.where("n > 0").select(*columns, "at", "first", "n", F.explode(F.sequence(part_of(begin, p.size), part_of(begin + F.col("n") - 1, p.size))).alias("part"))
    cut = cut.withColumn("lo", F.col("first") + F.greatest(F.col("part") * p.size - begin, F.lit(0))).withColumn("hi", F.col("first") + F.least((F.col("part") + 1) * p.size - begin, F.col("n")) - 1)
    return cut.drop("first", "n").withColumn("block", F.explode(F.sequence(part_of(F.col("lo"), BLOCK), part_of(F.col("hi"), BLOCK))))


def met(p: Placed, pieces: DataFrame, own: DataFrame, files: DataFrame) -> DataFrame:
    """``pieces`` with their files, and ``own``, rows of sessions that meet none, all rows of a part in one task.

    ``files``: columns whose names begin with _, _place among them.
    """
    numbered = files.withColumn("_block", part_of(F.col("_place"), BLOCK))
    wanted = pieces.select(F.col("part").alias("_part"), F.col("block").alias("_block")).distinct()
    right = numbered.join(wanted, "_block").repartition(p.tasks, "_part")
    left = pieces.unionByName(own, allowMissingColumns=True).repartition(p.tasks, "part")
    return left.join(right, (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block")) & F.expr("_place BETWEEN lo AND hi"), "left").where("block IS NULL OR _place IS NOT NULL")


def by_time(p: Placed, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of ``sessions`` and ``files``, the files' columns with _ before them, all pairs of a part in one task; a part is a range of moments.

    A moment is not cut.
    """
    ends = [sessions.select(F.col(end).alias("at"), F.lit(weight).alias("weight")) for end, weight in (("start_utc", ALONE), ("end_utc", 0))]
    moments = files.select(F.col("timestamp_utc").alias("at"), (F.col("open") + ALONE).alias("weight")).unionByName(ends[0]).unionByName(ends[1]).groupBy("at").agg(F.sum("weight").alias("weight"))
    cut = running(ranged(moments, ["at"], "moments", out="_range"), [], "_range", [F.col("at")], F.col("weight"), "before").select("at", part_of(F.col("before"), p.size).alias("part"))
    cut = written(cut, "moments-in-order")
    to = lambda rows, time, name: rows.join(cut.select(F.col("at").alias(time), F.col("part").alias(name)), time)
    left = to(to(sessions, "start_utc", "_from"), "end_utc", "_to").withColumn("part", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    right = to(files, "timestamp_utc", "part").drop("open")
    right = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns])
    same = (F.col("part") == F.col("_part")) & (F.col("case_id") == F.col("_case_id"))
    return left.repartition(p.tasks, "part").join(right.repartition(p.tasks, "_part"), same & F.expr("_timestamp_utc BETWEEN start_utc AND end_utc"))
