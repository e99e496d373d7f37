import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from tracewell.llm import suffix_dedup
from tracewell.llm.suffix_dedup import remove_repeats


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if first.get(w, 1 << 62) > i:
                first[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize(("sf", "chunk_docs"), [("sf0.001", 3), ("sf0.001", 700), ("sf0.01", 700)])
def test_against_brute_force(spark, sf, chunk_docs):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = result(remove_repeats(docs, chunk_docs=chunk_docs))
    assert got == want
    assert sum(r[2] for r in got) > 1000


def test_edits_and_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh é") for _ in range(90))
    rows = []
    for i in range(60):
        t = "".join(rng.choice("abcdxyz \n") for _ in range(rng.randrange(200)))
        rows.append((i * 1000003 * (1 << 20), t + line[rng.randrange(30) :] + t[:40] + line))
    base = "".join(rng.choice("mnopq ") for _ in range(900))
    for i in range(30):
        at = rng.randrange(880)
        rows.append((7 + i, base[:at] + "#" + base[at + 1 :]))
    rows += [(900001, None), (900002, ""), (900003, "short"), (900004, "a" * 400), (900005, "a" * 70), (900005, "a" * 70)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, chunk="x", key=1.5) for i, t in rows])
    assert result(remove_repeats(docs, chunk_docs=5)) == brute(rows)


def test_long_text_is_cut_in_slices(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(2_300_000))
    rows = [(1, text[1_000_000:1_200_000]), (2, text), (None, text)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].n_removed == 0 and (by[2].n_removed, by[2].n_spans) == (200_000, 1)
    assert by[2].spans == [1_000_000, 1_200_000]
    assert by[None].n_removed == len(text)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert suffix_dedup.QGRAM < 50


def test_names_are_made_of_later_offsets(monkeypatch):
    """Windows have the same name where they are the same string, and every round reads only names of the round before."""
    rng = random.Random(9)
    text = bytes(rng.choice(b"ab") for _ in range(3000)) + b"ab" * 200
    grams, names = suffix_dedup._names(np.frombuffer(text, dtype=np.uint8), 50)
    by = {}
    for k, name in enumerate(names.tolist()):
        assert by.setdefault(text[k : k + 50], name) == name
    assert len(set(by.values())) == len(by) and len(names) == len(text) - 49
    # names follow from the q-gram buckets alone
    step = suffix_dedup._pair(grams[:-20], grams[20:])
    assert (suffix_dedup._pair(step[:-10], step[10:]) == names).all()


def test_many_repeated_rows_travel_once(spark):
    text = "one line that many rows of one document repeat, of more than fifty bytes"
    rows = [(5, text)] * 4000 + [(None, text)] * 300 + [(3, text[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = remove_repeats(docs, chunk_docs=100).collect()
    by = {(r.doc_id, r.n_removed) for r in got}
    assert len(got) == len(rows) and by == {(3, 0), (5, 60), (None, len(text))}
