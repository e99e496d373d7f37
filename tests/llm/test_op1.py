import hashlib
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.llm import spotsigs


def spots(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    anchors, content, out = set(spotsigs.ANCHORS), [], set()
    for i, w in enumerate(words):
        if w not in anchors:
            content.append((w, i > 0 and words[i - 1] in anchors))
    out = {tuple(w for w, _ in content[k : k + 3]) for k, (_, marked) in enumerate(content) if marked and k + 3 <= len(content)}
    out = out or {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
    return out or ({tuple(words)} if words else {text} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


ODD = [(5_000_000_000, None), (7_000_000_000, ""), (8_000_000_000, "!!! ***"), (9_000_000_000, "One"), (9_000_000_001, "the of"), (-4, "x " * 40000), (9_100_000_000, "Ünïcode the straße, die Größe! weiß")]


@pytest.mark.parametrize("odd", [False, True])
def test_against_brute_force(spark, odd, monkeypatch):
    if odd:
        monkeypatch.setattr(spotsigs, "RANGES", 17)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + (ODD if odd else [])
    got = spotsigs.fingerprints(spark.createDataFrame([Row(doc_id=i, text=t, block=1, last="q", n_chars=-1) for i, t in rows])).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = by[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(spots(t), spots(edited))) and r.near_next == pytest.approx(jaccard(spots(t), spots(nxt)))
        assert len(r.fingerprint) == 16 * len(spots(t))
        for is_near, a, b in ((r.edited_is_near, t, edited), (r.next_is_near, t, nxt)):
            assert is_near == (100 * len(spots(a) & spots(b)) >= 80 * len(spots(a) | spots(b)))
    long = [r.near_edited for r in got if r.n_chars > 1500]
    assert sum(long) / len(long) > 0.4


def test_native_plan_and_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b c d e")], "doc_id long, text string")
    plan = spotsigs.fingerprints(docs)
    assert not re.search("Python|Arrow", plan._jdf.queryExecution().executedPlan().toString())
    assert plan.count() == 3
    one = spotsigs.fingerprints(docs.where("text like 'b%'")).first()
    assert one.near_next == 1.0
    assert spotsigs.fingerprints(docs.limit(0)).count() == 0


def test_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: spots(r.text or "") for r in docs.select("doc_id", "text").collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                c = len(sets[a] & sets[b])
                if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in spotsigs.near_groups(docs).collect()}
    assert got == {i: find(i) for i in ids}


def test_groups_of_odd_rows(spark):
    text = "the old mill by the river was closed in the spring of that year for repairs and the miller left"
    rows = [(4, text), (4, text), (None, text), (9, None), (8, ""), (7, "one two"), (6, "two one"), (3, text + " the end of it came soon")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, own=1, token="x", partition=2, n=3) for i, t in rows])
    got = sorted(((r.doc_id or 0), r.component_id) for r in spotsigs.near_groups(docs).collect())
    assert len(got) == 8 and [c for i, c in got if i in (0, 4)] == [4, 4, 4] and all(i == c for i, c in got if i > 5)
    assert spotsigs.near_groups(docs.limit(0)).count() == 0


def test_near_sets_are_in_neighbouring_partitions(spark):
    sizes = spark.range(1, 3000).select("id", spotsigs.size_partition(F.col("id")).alias("p")).collect()
    by = {r.id: r.p for r in sizes}
    assert all(by[n] - by[m] <= 1 for n in by for m in range(-(-n * 80 // 100), n + 1))


def test_ranges_follow_the_ids(spark):
    """A far id, many rows of one id and many without any leave no range with more than a small part of the rows."""
    rows = [(i, f"text {i}") for i in range(4000)] + [(2**60, "far")] + [(77, f"same id {i}") for i in range(2000)] + [(None, f"no id {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("mark"))
    block, blocks = spotsigs._range_of(docs, key)
    sizes = [r["count"] for r in docs.groupBy(block.alias("b")).count().collect()]
    assert len(sizes) == blocks > 20 and max(sizes) < 4 * len(rows) / blocks
    got = spotsigs.fingerprints(docs).select("doc_id", "edited_sha256").collect()
    order = sorted(((i is not None, i or 0), t) for i, t in rows if i != 77 and i is not None)
    want = {}
    for k, ((_, i), t) in enumerate(order):
        nxt = order[k - 1][1]
        want[i] = hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()
    wrong = [r.doc_id for r in got if r.doc_id not in (None, 77, 78, 0) and r.edited_sha256 != want[r.doc_id]]
    assert len(got) == len(rows) and not wrong
