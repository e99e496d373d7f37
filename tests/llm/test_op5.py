import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import Row

from tracewell.llm import ngram_jaccard
from tracewell.operators.components import connected_components
from tracewell.llm.ngram_jaccard import link_counts, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    common = defaultdict(int)
    for ids in inverted.values():
        if len(ids) > 1:
            for a in ids:
                for b in ids:
                    if a < b:
                        common[a, b] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == want
    assert sum(1 for i, (_, c) in got.items() if c != i) > 5


def test_chain_and_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, "\t".join(base).upper()), (9, None), (8, ""), (7, " \n"), (6, "one two"), (5, "ONE  two"), (4, "one two three"), (None, " ".join(base)), (3, " ".join(base))]
    # a chain: each differs from the one before by a little, the ends by much
    for k in range(12):
        base = base[4:] + [f"x{k}a", f"x{k}b", f"x{k}c", f"x{k}d"]
        rows.append((100 + k, " ".join(base)))
    rows.append((2, "\t".join(rows[0][1].split()).upper()))
    docs = spark.createDataFrame([Row(doc_id=i, text=t, key=7, chunk=1, token="x", n=3) for i, t in rows])
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    by = {i: (n, c) for i, n, c in got}
    want = brute([r for r in rows if r[0] is not None])
    assert {k: v for k, v in by.items() if k is not None} == want
    assert by[None] == (56, 1)
    assert want[111][1] == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0


def test_all_links_of_a_group(spark):
    """Edits of one text: each pair is a link, also between two that aren't the leader; an equal text counts as a link too."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 200, 16)]
    texts += [texts[0], " ".join(base), "alone here with other words altogether", "", None]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    want = {i: sum(i != j and bool(x) and 100 * len(x & y) >= 80 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)}
    assert sum(want.values()) > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in link_counts(docs).collect()} == want


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(4)
    names = [f"{rng.randrange(16**8):08x}" for _ in range(600)]
    links = [(names[k], names[k + 1]) for k in range(120)] + [(names[150], names[k]) for k in range(151, 350)] + [tuple(rng.sample(names[360:], 2)) for _ in range(150)] + [(names[0], names[0])]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.set_key: r.component for r in connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}


def test_order_of_rows_does_not_matter(spark):
    """Classes are numbered in the order of their keys: another order or dealing of the rows gives the same result."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        again = spark.createDataFrame(rows, "doc_id long, text string").coalesce(seed)
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(again).collect()} == want


def test_a_hot_shingle_with_one_stranger(spark):
    """Of a passage that many linked copies and one other text hold, the copies don't meet each other again."""
    rows = [("t", f"k{i:04d}", 100, 0, 1, "group") for i in range(3000)] + [("t", "stranger", 100, 0, 1, "other")]
    prefix = spark.createDataFrame(rows, "token string, set_key string, n long, unshared long, pos long, label string")
    pairs = ngram_jaccard._strangers(prefix, 80)
    assert pairs.count() == 3000 and pairs.where("a <> 'stranger' and b <> 'stranger'").count() == 0
    plan = pairs._jdf.queryExecution().toString()
    assert "Join" in plan


def test_groups_that_share_a_passage(spark):
    """Two large groups of near copies, one text near to a member of each, and strangers that hold the same passage."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(30)]
    bodies = [[f"g{g}w{i}" for i in range(170)] for g in range(2)]
    rows = []
    for g, body in enumerate(bodies):
        for k in range(60):
            words = body.copy()
            words[rng.randrange(170)] = f"x{k}"
            rows.append((1000 * g + k, " ".join(passage + words)))
    rows += [(5000 + k, " ".join(passage + [f"s{k}w{i}" for i in range(20 + 3 * k)])) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
