import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from pyspark.sql import functions as F

from tests.llm.test_op5 import brute
from tests.llm.test_op8 import check
from tracewell.llm import mixing, packing, quality, secrets
from tracewell.shared import written

SF = "/root/testdata/sf0.01"


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    schema, seen = docs.schema, {}
    for name, stage in P.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        if name == "packing":
            # mixing repeats documents; with ids of their own the copies can be told apart, and pack as the stage packs them
            single = written(before.withColumn("doc_id", F.monotonically_increasing_id()), "single")
            assert check([(r.doc_id, r.text) for r in single.collect()], packing.pack(single).collect()) < 0.05
            ids = {r._row: r.doc_id for r in written(before.withColumn("_row", F.monotonically_increasing_id()), "rows").collect()}
            pieces = lambda rows, name: Counter((name(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
            assert pieces(docs.collect(), lambda i: i) == pieces(packing.pack(single).collect(), ids.__getitem__)
            continue
        assert docs.schema == schema
        old, new = defaultdict(list), defaultdict(list)
        for r in before.collect():
            old[r.doc_id].append(r)
        for r in docs.collect():
            new[r.doc_id].append(r)
        seen[name] = (len(old), len(new))
        if name == "quality":
            want = {r.doc_id for r in quality.classify(before, labels).where("predicted = 1").collect()}
            assert set(new) == want
            assert all(new[i] == old[i] for i in new)
        elif name == "near_duplicates":
            assert set(new) == {c for _, c in brute([(i, r[0].text) for i, r in old.items()]).values()}
        elif name == "secrets":
            for i, (r,) in old.items():
                (n,) = new[i]
                found = secrets.spans((r.text or "").encode())
                assert (n.text == r.text) == (not found) and (n.text or "").count("[SECRET]") >= bool(found)
                assert n.n_chars == (len(n.text) if found else r.n_chars)
        elif name == "mixing":
            taken = {r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken}
            assert {i: sum(len(re.findall(mixing.WORD, r.text)) for r in rs) for i, rs in new.items()} == taken
    assert seen["quality"][0] > seen["quality"][1] and seen["near_duplicates"][0] > seen["near_duplicates"][1]


def test_run(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_many_repeats_of_one_document(spark):
    text = "a text of more than five words that is repeated many times"
    rows = [(1, text, "a", k % 3) for k in range(3000)] + [(1, text + " and more", "a", 7)] + [(2, "  ", None, k) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = P.distinct_documents(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text or "", r.n_chars) for r in got if r.doc_id == 1) == [(1, text, 0), (1, text + " and more", 7)]
    assert sum(r.doc_id == 2 for r in got) == 50


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_repeated_rows_are_one_document(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a", 33), (1, text, "a", 33), (2, text, "b", 33), (None, text, "a", 33), (5, "", "a", 0), (5, "", "a", 0), (6, None, None, None), (7, "other words that nobody else has here", "a", 38)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = P.distinct_documents(spark, docs, SF)
    assert got.schema == docs.schema
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, text), (1, text), (5, ""), (5, ""), (6, ""), (7, rows[-1][1])]


def test_columns_of_any_name_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("a b", "a.b", "a-b", "c`d", "row", "slot", "score", "digest", "component_id"))])
    for name, stage in P.STAGES[:-1]:
        got = written(stage(spark, odd, SF), name)
        assert got.dtypes == odd.dtypes and got.where("`a.b` = 1 and `c``d` = 3 and component_id = 8").count() == got.count() > 0, name
        odd = got
    assert P.STAGES[-1][1](spark, odd, SF).count() > 0
