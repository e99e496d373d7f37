import numpy as np
import pytest
import zstandard
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(rows) > 700
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    good = [r.predicted for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.99
    assert got.count() == docs.count()


def test_odd_rows(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text=None, score="x", row=1), Row(doc_id=None, text="", score="y", row=2), Row(doc_id=3, text="word " * 50000, score=None, row=3)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 3 and {r.score for r in got} == {0.5}
    assert quality.keep_good(docs, none).columns == docs.columns
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.classify(empty, none).count() == 0


def test_stage_keeps_columns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.keep_good(docs, labels)
    want = quality.classify(docs, labels).where("predicted = 1").count()
    assert kept.schema == docs.schema and kept.count() == want
    assert kept.join(docs, docs.columns, "left_anti").where(F.col("text").isNotNull()).count() == 0


def test_long_bad_texts_are_rejected(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    long = docs.where(F.length("text") > 8000).select("doc_id")
    rows = quality.classify(docs, labels).join(labels, "doc_id").join(long, "doc_id").select("predicted", "quality").collect()
    bad, good = ([r.predicted for r in rows if r.quality == q] for q in (0, 1))
    assert len(bad) == 30 and sum(bad) <= 3
    assert len(good) > 150 and all(good)


def test_dictionaries_see_text_ends(spark):
    """Good and bad texts that differ only behind their first 9,000 characters."""
    start = " ".join(f"word{i * i % 997}" for i in range(1200))
    ends = ["the river runs past quiet hills and old stone mills at dusk " * 40, "click now win cash prize free bonus casino jackpot deal hurry " * 40]
    rows = [(i, start + " " + str(i) + ends[i % 2]) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    assert len(start) > 8000
    assert all(r.predicted == 1 - r.doc_id % 2 for r in quality.classify(docs, labels).collect())


def test_stage_without_model_keeps_all(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 30)) for i in range(40)], "doc_id long, quality int")
    with pytest.warns(UserWarning, match="all documents are kept"):
        kept = quality.keep_good(docs, labels)
    assert kept.count() == 41


def slow_score(model, text):
    """The score by its definition, block by block, with fresh compressors."""
    raw, n = text.encode(), max(1, -(-len(text.encode()) // quality.BLOCK))
    parts = []
    for i in range(n):
        block = raw[i * len(raw) // n : (i + 1) * len(raw) // n]
        good, bad = (len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(block)) for d in (model.good, model.bad))
        parts.append((bad - good) / max(good, bad))
    return np.interp(np.quantile(parts, quality.QUARTILE), model.at, model.scores)


def test_scores_are_those_of_a_slow_version(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert list(model.at) == sorted(model.at) and list(model.scores) == sorted(model.scores)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    # compressors that hold their tables ready may choose other matches for a byte or two
    near = [abs(got[r.doc_id] - slow_score(model, r.text or "")) < 0.02 for r in rows]
    assert sum(near) > 0.97 * len(near)


def test_calibration_is_the_best_rising_fit():
    rng = np.random.default_rng(5)
    rows = [(float(x), int(rng.random() < x)) for x in np.round(rng.random(60), 1)]
    at, scores = quality._calibrated(rows)
    ours = sum((y - np.interp(x, at, scores)) ** 2 for x, y in rows)
    grid = np.unique([x for x, _ in rows])
    best = {0.0: 0.0}  # least error over rising steps of hundredths, by dynamic programming over the distinct differences
    for x in grid:
        labels = np.array([y for z, y in rows if z == x])
        errors = {round(v, 2): ((labels - v) ** 2).sum() for v in np.arange(0, 1.005, 0.01)}
        best = {v: e + min(b for u, b in best.items() if u <= v) for v, e in errors.items()}
    assert ours <= min(best.values()) + 0.05 * len(rows) and scores == tuple(sorted(scores))


def test_only_the_difference_counts(spark):
    """Texts whose blocks have the same difference have the same score, however long they are."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    block = docs.where(F.length("text") > quality.BLOCK).first().text.encode()[: quality.BLOCK].decode("ascii", "ignore").ljust(quality.BLOCK, "x")
    rows = [(n, block * n) for n in (1, 2, 50, 50)]
    scores = {r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert len(scores) == 1


def test_missing_ids_are_not_held_out(spark):
    docs = spark.createDataFrame([(None, "words"), (5, "words")] * 2, "doc_id long, text string")
    got = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == 4 and {r.held_out for r in got if r.doc_id is None} == {False}
