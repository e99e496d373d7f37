"""Sessions of arriving events: steps, late events, and the same rows as of all events at once."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.unit.test_cases import T0, rows
from tracewell.operators import sessions
from tracewell.streaming import sessions as arriving


def run(spark, tmp_path, steps, delay):
    """Each step is a file; the stream takes one at a time, in order."""
    schema = steps[0].schema
    for i, step in enumerate(steps):
        step.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    out = None
    for i in range(len(steps)):
        # a restart between steps: state comes from the checkpoint
        stream = spark.readStream.schema(schema).parquet(*[f"{tmp_path}/in/{{{','.join(map(str, range(i + 1)))}}}"])
        out = arriving.track(stream, delay=delay)
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")


def test_steps_give_the_sessions_of_all_events(spark, tmp_path):
    rng = random.Random(6)
    items = sorted((rng.choice(["usb_insert", "usb_remove"]), rng.randrange(600), rng.choice(["a", "b"])) for _ in range(60))
    items.sort(key=lambda x: x[1])
    whole = rows(spark, *items)
    steps = [whole.where((F.col("ingest_ord") >= lo) & (F.col("ingest_ord") < lo + 20)) for lo in (0, 20, 40)]
    table = run(spark, tmp_path, steps, "5 minutes")
    want = sessions.reconstruct(whole)
    got = arriving.settled(table).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert table.where("status = 'final'").count() > 20 and not table.where("status = 'late'").count()


def test_late_events_are_told(spark, tmp_path):
    first = rows(spark, ("usb_insert", 0, "a"), ("usb_remove", 30, "a"), ("usb_insert", 300, "a"))
    late = rows(spark, ("usb_remove", 10, "a"), ("usb_remove", 310, "a"))
    third = rows(spark, ("usb_insert", 320, "b"))
    table = run(spark, tmp_path, [first, late, third], "10 minutes")
    got = sorted(((r.start_utc - T0) // timedelta(minutes=1), (r.end_utc - T0) // timedelta(minutes=1), r.end_observed) for r in arriving.settled(table).where("device_id = 'a'").collect())
    assert got == [(0, 30, True), (300, 310, True)] and datetime.min < T0
    assert [r.start_us for r in table.where("status = 'late'").collect()] == [int((T0 - datetime(1970, 1, 1)).total_seconds() + 600) * 10**6]


def test_rows_of_a_device_keep_what_is_missing():
    """the table that a device gives has whole numbers and flags, some missing, without casts of each column."""
    got = arriving._frame(("c", "d"), [("final", 2, 3, 2**60 + 1, True, 7, False), ("mark", 2, None, None, None, None, None)])
    assert [c.split()[0] for c in arriving.OUT.split(", ")] == list(got.columns)
    assert got["start_us"].tolist()[0] == 2**60 + 1 and got["end_observed"].tolist()[0] is False
    assert got.loc[1, ["ordinal", "start_us", "start_observed", "end_us", "end_observed"]].isna().all()
