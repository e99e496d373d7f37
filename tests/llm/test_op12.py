import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import seen_digests as S

ODD = [
    (5, "a b", 9), (3, "ab", 9), (7, " a b ", 9), (2, "a\tb\n", 9), (9, "ab ", 9), (4, "", 1), (6, None, 2), (8, " \r\n\x0b\x0c", 3), (None, "ab", 1), (None, "alone", 1),
    (1, "x" * 200_000, 0), (11, "x" * 100_000 + " " + "x" * 100_000, 0), (10, "same", 0), (10, "same", 0), (12, "\U0001f600 z", 1), (13, "\U0001f600z", 1),
]


def brute(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) by one dictionary."""
    groups = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()].append((-len(text or ""), i is None, i or 0, n, i))
    return sorted(((m[4], min(g)[4], len(g), m == min(g), d) for d, g in groups.items() for m in g), key=str)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "q", 7, True) for r in ODD], "doc_id long, text string, n_chars long, digest string, row int, member boolean")
    want = brute([r[:2] for r in ODD])
    # wherever the line between history and arrivals is, also with all or nothing on one side
    for history in (None, F.lit(True), F.lit(False), F.coalesce(F.col("doc_id") > 6, F.lit(False))):
        got = S.dedup(docs, history)
        assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == want
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lookup_tells_members_from_others(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3000}") for i in range(6000)] + [(10_000 + i, f"other {i}") for i in range(500)], "doc_id long, text string")
    rows = S.digests(docs)
    index = S.index_of(rows.where("doc_id < 6000"))
    assert index.select(F.sum(F.size("slots"))).first()[0] == 3000
    found = S.looked_up(index, rows.where("doc_id >= 3000")).select("digest", "member", "held").join(rows, "digest").select("doc_id", "member", "held").where("doc_id >= 3000").collect()
    assert {(r.member, r.held) for r in found if r.doc_id < 6000} == {(True, 2)} and {(r.member, r.held) for r in found if r.doc_id >= 10_000} == {(False, None)}


def test_slots_are_minimal_and_perfect():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 17, 20_000):
        keys = rng.integers(0, 2**63, (n, 2)).astype(np.uint64)
        sizes, bits, rest = S.build(keys)
        got = S.slots(keys, sizes, bits)
        assert sorted(got[got >= 0].tolist()) == list(range(n - len(rest))) and sum(sizes) <= 6 * n + 300
    same = np.zeros((3, 2), dtype=np.uint64)
    sizes, bits, rest = S.build(same)
    assert len(rest) == 3 and (S.slots(same, sizes, bits) == -1).all()


def test_keys_that_no_level_tells_apart():
    """Digests that agree in their first 16 bytes: numbered behind the others, told apart by all their bytes."""
    import pyarrow as pa

    made = [bytes(16) + bytes([i]) * 16 for i in range(3)] + [hashlib.sha256(bytes([i])).digest() for i in range(50)]
    n = len(made)
    group = pa.table({"digest": pa.array(made, pa.binary()), **{c: pa.array(range(n), pa.int64()) for c in S.HELD}, "bucket": pa.array([0] * n, pa.int64())})
    index = S._index(group)
    asked = pa.table({"digest": pa.array([*made, bytes(32)[:-1] + b"z", hashlib.sha256(b"none").digest()], pa.binary())})
    got = S._look_up(asked, index).to_pylist()
    assert [r["row"] for r in got] == [*range(n), None, None] and sorted(r["slot"] for r in got[:n]) == list(range(n))
