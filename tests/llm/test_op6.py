import re
from collections import defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.llm import mixing


def brute_targets(rows):
    size = defaultdict(int)
    for s, t in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * size[s] for s in capped)
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s] + 1e-9]
        if not over:
            return size, {s: 3.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        capped |= set(over)


@pytest.mark.parametrize("small", [False, True])
def test_targets_and_taken(spark, small):
    if small:
        rows = [(1, "b", "one two"), (2, "a", None), (3, None, "x " * 5000), (4, "ä", " y\tz "), (5, "", "w " * 9), (6, "a", ""), (None, "b", "q"), (1, "b", "one two")]
    else:
        rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs = spark.createDataFrame([Row(doc_id=i, source=s, text=t, size="x", number=0, take=1, begin=2) for i, s, t in rows])
    size, target = brute_targets([(s, t) for _, s, t in rows])
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for i, s, t in rows:
        by[i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))].append(s)
    taken = defaultdict(int)
    for r in got:
        s = by[r.doc_id, r.size].pop()
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in target:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([(1, 256 * 100), (2, 256 * 300), (3, 256 * 600), (4, 1)], "number int, take long")
    slots = sorted((r.slot, r.number, r["rank"]) for r in mixing.schedule(targets).collect())
    assert sorted((n, k) for _, n, k in slots) == [(n, k) for n, m in ((1, 100), (2, 300), (3, 600), (4, 1)) for k in range(m)]
    seen = defaultdict(int)
    for t, n, _ in slots:
        seen[n] += 1
        assert all(abs(seen[m] - (t + 1) * p) < 5 for m, p in ((1, 0.1), (2, 0.3), (3, 0.6)))


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_the_sequence_decides_the_mix(spark, monkeypatch):
    """Another sequence of points gives other slots, and another order of the mixed documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sources = {r.doc_id: r.source for r in docs.collect()}

    def run():
        slots = {r.doc_id: r.first_slot for r in mixing.mix(docs).collect()}
        return slots, [r.doc_id for r in mixing.mixed(docs).collect()]

    slots, order = run()
    copies = {i: order.count(i) for i in order}
    firsts = [slots[i] for i in dict.fromkeys(order)]
    assert firsts == sorted(firsts)
    # every stretch of the mix holds many sources
    assert all(len({sources[i] for i in order[k : k + 40]}) >= 3 for k in range(0, len(order) // 2, 40))
    monkeypatch.setattr(mixing, "GOLDEN", 0)
    other, moved = run()
    assert other != slots and moved != order and {i: moved.count(i) for i in moved} == copies


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_taken_against_brute_force(spark, sf):
    """Each document's words, recounted from the blocks that a plain walk over the points gives to each source."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    sizes = mixing.sized(docs)
    placed = {r.row: r for r in mixing._placed(sizes, mixing.source_targets(sizes)).collect()}
    takes = {r.number: r.take for r in mixing.source_targets(sizes).collect() if r.take}
    blocks = {n: -(-t // mixing.BLOCK) for n, t in takes.items()}
    total, edges, low = sum(blocks.values()), [], 0
    for n in sorted(blocks):
        edges.append((int(low * (2**32 / total)), int((low + blocks[n]) * (2**32 / total)), n))
        low += blocks[n]
    ranks, given = dict.fromkeys(blocks, 0), set()
    for t in range(total):
        point = t * mixing.GOLDEN % 2**32
        n = next((n for a, b, n in edges if a <= point < b), None)
        if n is not None:
            given |= {(n, ranks[n])} if ranks[n] < blocks[n] else set()
            ranks[n] += 1
    given |= {(n, k) for n in blocks for k in range(ranks[n], blocks[n])}
    words = defaultdict(int)
    for row, r in placed.items():
        for lap in range(3):
            for w in range(r.size):
                at = lap * r.length + r.begin + w
                words[row] += at < r.take and (r.number, at // mixing.BLOCK) in given
    ids = {r.row: r.doc_id for r in sizes.collect()}
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken} == {ids[row]: n for row, n in words.items() if n}


def test_mixed_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    words = out.withColumn("n", F.regexp_count("text", F.lit(mixing.WORD))).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r.doc_id: r.n for r in words} == want
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_repeated_and_null_rows_are_mixed_each(spark):
    """Rows that agree in doc_id and size, or have no id, give as many words as the mix takes of them."""
    rows = [(i % 2 or None, f"one two three w{i % 3}", s, "x", i) for i in range(40) for s in ("a", "b")] + [(7, None, "c", "x", 0), (8, " ", None, "x", 0), (9, "x " * 700, "c", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, lap int")
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    per, taken = defaultdict(int), defaultdict(int)
    for r in out.collect():
        per[r.doc_id] += len(WORDS.findall(r.text))
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    assert per == {i: n for i, n in taken.items() if n} and len(per) == 3
