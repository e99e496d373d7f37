import hashlib
import zlib
from collections import Counter, defaultdict

from tracewell.llm import merkle as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root, and each node's steps [(left, right), ...]."""
    steps, spans, digests = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(digests) > 1:
        up, over = [], []
        for at in range(0, len(digests), 16):
            run = digests[at : at + 16]
            for k in range(len(run)):
                for i in spans[at + k]:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            over.append([i for s in spans[at : at + 16] for i in s])
        digests, spans = up, over
    return digests[0], steps


def brute(rows):
    lower = str.maketrans(M.UPPER, M.LOWER)
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append(r)
    subroots, own = {}, {}
    for source, members in trees.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroots[source], own[source] = climb([leaf(r) for r in members])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, over = climb([subroots[s] for s in order])
    for n, source in enumerate(order):
        for r, steps in zip(trees[source], own[source], strict=True):
            steps = steps + over[n]
            changed = r[:4] + (r[4].translate(lower),) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
            node = leaf(changed)
            for left, right in steps:
                node = sha(left, node, right)
            yield (r[0], leaf(r), subroots[source], root, sha(*(x for s in steps for x in s)), node, node == root)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def same(spark, rows, extra=""):
    docs = spark.createDataFrame([(*r, *([1, "x", True, "z"] if extra else [])) for r in rows], COLUMNS + extra)
    assert Counter(tuple(r) for r in M.verified(docs).collect()) == Counter(brute(rows))


def test_odd_rows(spark):
    rows = [(i, "big", "en", i * 7, f"Text {i}") for i in range(300)] + [(i, f"s{i}", None, None, "T") for i in range(1000, 1018)]
    rows += [(None, None, None, None, None), (-5, None, "de", -3, ""), (7, "", "en", 0, "É Ü ABC"), (7, "", "en", 0, "É Ü ABC"), (7, "", "en", 0, "other"), (2**40, "ünï", "x", 1, "A" * 300_000), (8, "solo", "en", 1, None)]
    same(spark, rows, ", tree int, digest string, place boolean, `a b.c` string")


def test_few_rows(spark):
    same(spark, [(3, "a", "en", 1, "Only")])
    same(spark, [(3, "a", "en", 1, "One"), (4, "a", "en", 1, "Two")])
    same(spark, [(i, "a", "en", 1, "T") for i in range(257)])
    assert M.verified(spark.createDataFrame([], COLUMNS)).count() == 0


def test_only_changed_texts_fail(spark):
    got = M.verified(spark.createDataFrame([(i, "a", "en", 1, "lower" if i % 2 else "Upper") for i in range(100)], COLUMNS)).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(0, 100, 2) if zlib.crc32(str(i).encode()) % 5 == 0}
