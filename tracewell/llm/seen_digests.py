"""Exact duplicates against a history: a minimal perfect hash over its distinct digests.

The history's digests are dealt to buckets of a bounded number of keys. In each bucket a cascade of bit arrays (a key goes to
the first level where it meets no other) numbers the keys without gaps, by about four bits a key: a key's slot is the number
of set bits before its own. A slot holds the whole digest and where the winner of its text is, so any digest can be asked for:
its slot's bytes either are its own, and it is a repeat, or it is none of the history's. What is asked are distinct digests,
counted before they are dealt, so a text that a third of all rows hold is one question; nonmembers are grouped among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.kernels import mix
from tracewell.llm.runtime import ship
from tracewell.shared import width, written

WHITE = " \t\n\x0b\x0c\r"
#: Keys of a bucket, about, and bits of a level for each key that comes to it.
BUCKET, ROOM = 16_384, 2
#: Levels of the cascade; the few keys that meet on all of them are numbered in their order.
LEVELS = 24
SLOT = "struct<digest:binary,length:long,doc_id:long,row:long,held:long>"
INDEX = f"bucket long, sizes array<long>, bits binary, rest array<long>, slots array<{SLOT}>"
FOUND = "digest binary, member boolean, slot long, length long, doc_id long, row long, held long"
HELD = ("length", "doc_id", "row", "held")
FIELDS = [("digest", pa.binary()), *[(c, pa.int64()) for c in HELD]]
SCHEMA = pa.schema([("bucket", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("rest", pa.list_(pa.int64())), ("slots", pa.list_(pa.struct(FIELDS)))])
ANSWER = pa.schema([("digest", pa.binary()), ("member", pa.bool_()), ("slot", pa.int64()), *[(c, pa.int64()) for c in HELD]])


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys (two 64-bit halves a row) stand in a level of so many bits."""
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (mix(keys[:, 0] ^ seed) + mix(keys[:, 1] + seed)) % np.uint64(size)


def halves(digests: np.ndarray) -> np.ndarray:
    """The first 16 bytes of 32-byte digests as two integers."""
    return np.ascontiguousarray(digests[:, :16]).view("<u8")


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits one behind the other, and the keys (by number) that no level tells apart."""
    left, sizes, bits = np.arange(len(keys)), [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = 8 * max(1, -(-ROOM * len(left) // 8))
        at = _places(keys[left], level, size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool), left


def slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 for a key that meets another on every level. Keys outside the set get any slot."""
    rank = np.cumsum(bits) - bits
    out = np.full(len(keys), -1, dtype=np.int64)
    left, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = _places(keys[left], level, size).astype(np.int64) + base
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def _index(group: pa.Table) -> pa.Table:
    keys = halves(_matrix(group.column("digest")))
    sizes, bits, rest = build(keys)
    slot = slots(keys, sizes, bits)
    # keys that met another on all levels take the slots behind the others
    slot[rest] = int(bits.sum()) + np.arange(len(rest))
    held = group.select([c for c, _ in FIELDS]).take(pa.array(np.argsort(slot))).to_struct_array().combine_chunks()
    columns = [group.column("bucket")[:1], pa.array([sizes], pa.list_(pa.int64())), pa.array([np.packbits(bits).tobytes()]), pa.array([sorted(slot[rest].tolist())], pa.list_(pa.int64()))]
    return pa.table([*columns, pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), held)], schema=SCHEMA)


def _look_up(asked: pa.Table, index: pa.Table) -> pa.Table:
    """Answers for the asked digests of one bucket."""
    n = asked.num_rows
    if not n:
        return ANSWER.empty_table()
    if not index.num_rows:
        return pa.table([asked.column("digest"), pa.array([False] * n), *[pa.nulls(n, pa.int64())] * 5], schema=ANSWER)
    held = index.column("slots").combine_chunks().flatten()
    sizes, rest = (index.column(c)[0].as_py() for c in ("sizes", "rest"))
    ours, stored = _matrix(asked.column("digest")), _matrix(held.field("digest"))
    bits = np.unpackbits(np.frombuffer(index.column("bits")[0].as_py(), dtype=np.uint8), count=sum(sizes)).astype(bool)
    slot = slots(halves(ours), sizes, bits)
    behind = {stored[s].tobytes(): s for s in rest}
    for i in np.flatnonzero(slot < 0) if behind else ():
        slot[i] = behind.get(ours[i].tobytes(), -1)
    # the bytes decide: a digest that the history does not hold comes to some slot, or to none
    member = (slot >= 0) & (stored[np.maximum(slot, 0)] == ours).all(axis=1)
    at = pa.array(slot, mask=~member)
    return pa.table([asked.column("digest"), pa.array(member), at, *[held.field(c).take(at) for c in HELD]], schema=ANSWER)


def normalised(text: Column) -> Column:
    """What must be identical in equal texts: everything but ASCII white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, length, row), stored: SHA-256 of each normalised text, code points of the original, and a number of its own for each row."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("length"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def _better() -> Column:
    """The order of winners: the longest text, then the smallest id (a missing one last), then the row's own number."""
    return F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")


def _winners(rows: DataFrame) -> DataFrame:
    """(digest, length, doc_id, row, held): the winner of each text and how many rows hold it; counted in each task first."""
    best = rows.groupBy("digest").agg(F.min(_better()).alias("w"), F.count(F.lit(1)).alias("held"))
    return best.select("digest", (-F.col("w.shorter")).alias("length"), "w.doc_id", "w.row", "held")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")


def index_of(history: DataFrame) -> DataFrame:
    """The index of rows of ``digests``, stored: a row for each bucket of some thousand distinct digests."""
    ship(history.sparkSession)
    distinct = written(_winners(history), "history")
    buckets = max(4 * width(history.sparkSession), -(-distinct.count() // BUCKET))
    indexed = distinct.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(_index, INDEX)
    return written(indexed.withColumn("buckets", F.lit(buckets)), "index")


def looked_up(index: DataFrame, arrived: DataFrame) -> DataFrame:
    """(digest, member, slot, winner's length, doc_id and row, held) for each distinct digest of ``arrived``, rows of ``digests``."""
    ship(arrived.sparkSession)
    first = index.select("buckets").first()
    buckets = first[0] if first else 4 * width(arrived.sparkSession)
    asked = arrived.select("digest").distinct().withColumn("bucket", _bucket(buckets))
    return asked.groupBy("bucket").cogroup(index.drop("buckets").groupBy("bucket")).applyInArrow(_look_up, FOUND)


def dedup(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """Each document with the one of its text that stays: doc_id, keep_id, group_size, kept, text_sha256, and in_history.

    ``history``: which rows the index is built of, a condition on doc_id (default: up to the median id, and without an id); all
    others arrive. The result is the same wherever the line is: an arriving repeat that is longer than the history's winner, or
    as long with a smaller id, takes its place. Texts are equal when they differ in ASCII white space only; null and empty texts
    are one group with texts of nothing else. Of rows with one id and length one stays. A null id stays only where no other row
    is as long. Other columns are left out; an empty table gives no rows.
    """
    rows = digests(docs)
    if history is None:
        median = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        history = F.coalesce(F.col("doc_id") <= median, F.lit(True)) if median is not None else F.lit(True)
    rows = rows.withColumn("old", history)
    index = index_of(rows.where("old"))
    arrived = rows.where("NOT old")
    answers = looked_up(index, arrived)
    # repeats are held against the history's winner, nonmembers are grouped with one another
    met = written(_winners(arrived).select("digest", F.struct("length", "doc_id", "row", "held").alias("new")).join(answers, "digest"), "answers")
    old = index.select(F.inline("slots"))
    groups = met.select("digest", "new.*").unionByName(old)
    total = groups.groupBy("digest").agg(F.min(_better()).alias("w"), F.sum("held").alias("group_size"))
    members = met.where("member").select("digest", F.lit(True).alias("member"))
    found = total.join(members, "digest", "left").select("digest", F.col("w.row").alias("keep_row"), F.col("w.doc_id").alias("keep_id"), "group_size", "member")
    # a table of its own, so that both sides of the join are plain scans, whose hot digests Spark can split
    answered = written(found, "groups")
    return rows.join(answered, "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), (F.col("old") | F.coalesce("member", F.lit(False))).alias("in_history"))


ORACLE = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS length, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY length DESC, doc_id NULLS LAST) AS n FROM d)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, n = 1 AS kept, text_sha256 FROM w WINDOW g AS (PARTITION BY text_sha256 ORDER BY n)"""
