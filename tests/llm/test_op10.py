import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.identify(docs)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 2000
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, lang=g, score=1) for i, t, g in [(1, None, "en"), (2, "12 ½ ...", "en"), (3, "the house and the tree", "en"), (4, "das Haus und der Baum", "de"), (None, "the", None), (5, "der Baum " * 100000, "de")]])
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[2].score == 0
    assert got[5].lang_pred in ("en", "de")
    empty = spark.createDataFrame([], docs.schema)
    assert langid.identify(empty).count() == 0


def bucket(gram):
    """The bucket of an n-gram by whole numbers: a polynomial over its code points, mixed."""
    h = len(gram)
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
    return (h ^ h >> 31) % langid.BUCKETS


def slow(model, text):
    """Language and score by definition: the mean embedding of all subwords, one after the other."""
    found = []
    for word in re.findall(r"[^\W\d_]+", text or ""):
        marked = f"<{word.lower()}>"
        found += [bucket(marked[i : i + n]) for n in (3, 4, 5) for i in range(len(marked) - n + 1)] if any(map(str.isalpha, word)) else []
    if not found:
        return "und", 0.0
    z = (model.table[found].mean(0) + model.bias) * model.sharpness
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.languages[int(p.argmax())], float(p.max())


def test_predictions_are_those_of_a_slow_version(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    for together in (langid.TOGETHER, 500):
        monkeypatch.setattr(langid, "TOGETHER", together)
        got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
        for r in docs.collect():
            lang, score = slow(model, r.text)
            assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score)


def test_whole_texts_are_learned(spark):
    """Two languages that differ only behind their first 3,000 characters."""
    start = "zzz yyy xxx " * 260
    rows = [(i, start + (" alpha beta gamma" if i % 2 else " delta epsilon zeta") * 200, "ab"[i % 2]) for i in range(300)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == "ab"[r.doc_id % 2] for r in got)


def test_sample_is_bounded(spark, monkeypatch):
    """100,000 repeats of a row count once, rows without an id are sampled like others, and so are dirty language names."""
    seen = []
    train = langid.train
    monkeypatch.setattr(langid, "train", lambda rows: seen.append(rows) or train(rows))
    monkeypatch.setattr(langid, "LANGUAGES", 5)
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same row again and again").alias("text"), F.lit("en").alias("lang"))
    null = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("der Baum "), "id").alias("text"), F.lit("de").alias("lang"))
    dirty = spark.range(300).select("id", F.lit("mot").alias("text"), F.concat(F.lit("x"), "id").alias("lang"))
    docs = many.union(null).union(dirty)
    model = langid.fit(docs, sample_rows=100)
    langs = [lang for lang, _, _ in seen[0]]
    assert langs.count("en") <= 1 and 60 < langs.count("de") < 150 and len(set(langs)) <= 5 and len(model.languages) <= 5
    assert langid.predict(docs, model).count() == 103_300
