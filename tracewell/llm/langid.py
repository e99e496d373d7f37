"""Language identification: averaged hashed subword embeddings and a linear softmax.

The model is linear behind the average, so a word's part in the sum of logits depends on
the word alone; tasks compute it once per word and add up whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import kernels
from tracewell.llm.runtime import crc_fold, ship

#: Bounds of the training sample: rows of each language (about), and languages, those of most rows.
SAMPLE_ROWS, LANGUAGES = 800, 200
BUCKETS, WIDTH, EPOCHS, RATE, BATCH = 1 << 16, 12, 6, 0.5, 32
GRAMS = (3, 4, 5)
#: Share of right predictions on the calibration rows that rejection may lose.
LOST = 0.01
CACHED = 500_000
#: Characters of texts whose words are looked up together.
TOGETHER = 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")
PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"
FIELDS = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def subwords(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: their buckets, word after word, and how many each word has.

    A word is taken in lower case between < and >; one without letters has none. All words are hashed at once.
    """
    marked = [f"<{w.lower()}>" if any(map(str.isalpha, w)) else "" for w in words]
    sizes = np.array([len(w) for w in marked], dtype=np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    for n in GRAMS:
        if len(codes) < n:
            yield np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(kernels.BASES[0]) + codes[k : len(codes) - n + 1 + k]
        inside = of[: len(h)] == of[n - 1 :]
        yield (kernels.mix(h[inside]) % np.uint64(BUCKETS)).astype(np.int64), np.maximum(sizes - n + 1, 0)


def histogram(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and how often each occurs: at most ``BUCKETS`` numbers, however long the text is."""
    found = Counter(LETTERS.findall(text))
    times = np.array(list(found.values()), dtype=np.int64)
    parts = [(buckets, np.repeat(times, sizes)) for buckets, sizes in subwords(list(found))]
    buckets, where = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True)
    return buckets, np.bincount(where, weights=np.concatenate([t for _, t in parts]), minlength=len(buckets)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # logits of each bucket: embeddings times softmax weights
    bias: np.ndarray
    sharpness: float
    reject_below: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """``rows``: (language, buckets, counts) in a fixed order. Every fifth row calibrates, the others train."""
    data = [(lang, s, (n / n.sum()).astype(np.float32)) for lang, s, n in rows if len(s)]
    languages = tuple(sorted({lang for lang, _, _ in data}))
    if not languages:
        return None
    index = {lang: i for i, lang in enumerate(languages)}
    fitted, held = [r for i, r in enumerate(data) if i % 5], data[::5]
    fitted = fitted or data
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    soft, bias = np.zeros((WIDTH, len(languages)), dtype=np.float32), np.zeros(len(languages), dtype=np.float32)
    steps, done = EPOCHS * -(-len(fitted) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fitted))
        for at in range(0, len(order), BATCH):
            batch = [fitted[i] for i in order[at : at + BATCH]]
            sizes = np.array([len(s) for _, s, _ in batch])
            flat = np.concatenate([s for _, s, _ in batch])
            share = np.concatenate([n for _, _, n in batch])[:, None]
            mean = np.add.reduceat(embed[flat] * share, np.cumsum(sizes) - sizes)
            wrong = _softmax(mean @ soft + bias)
            wrong[np.arange(len(batch)), [index[lang] for lang, _, _ in batch]] -= 1
            rate = RATE * (1 - done / steps)
            back = wrong @ soft.T
            soft -= rate * mean.T @ wrong / len(batch)
            bias -= rate * wrong.mean(0) * 0.1
            steps_back = np.repeat(-rate * WIDTH * back, sizes, axis=0).astype(np.float32) * share
            for k in range(WIDTH):  # repeated buckets add up
                embed[:, k] += np.bincount(flat, weights=steps_back[:, k], minlength=BUCKETS).astype(np.float32)
            done += 1
    table = (embed @ soft).astype(np.float64)
    logits = np.array([n @ table[s] + bias for _, s, n in held])
    truth = np.array([index[lang] for lang, _, _ in held])
    # one factor on the logits, chosen by likelihood, makes the scores probabilities
    factors = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(logits * f)[np.arange(len(truth)), truth], 1e-12)).mean() for f in factors]
    sharp = float(factors[int(np.argmin(loss))])
    p = _softmax(logits * sharp)
    right = p.max(1)[p.argmax(1) == truth]
    return Model(languages, table, bias.astype(np.float64), sharp, float(np.quantile(right, LOST)) if len(right) else 0.0)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histograms as bytes: 16 bits of each bucket, 32 of its count."""
    for batch in batches:
        found = [histogram(text.as_py()) for text in batch.column(2)]
        packed = [pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in zip(zip(*found, strict=True), (np.uint16, np.uint32), strict=True)] if found else [pa.array([], pa.binary())] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["lang", "place", "buckets", "counts"])


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Train on whole texts of rows outside the held-out fold: of each language about ``sample_rows``, those of least hash.

    The hash is of id and text, so that rows without an id are sampled like others; rows equal in both count once. At most
    ``LANGUAGES`` languages are learned, those of most rows, and at most twice ``sample_rows`` rows of each on average
    reach the driver, as bucket counts.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & (F.length("text") > 0) & (crc_fold(F.col("doc_id"), folds) != held_out))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    part = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample_rows / n))])
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text"))
    chosen = rows.where(F.pmod("place", F.lit(1_000_003)) / F.lit(1_000_003.0) < F.try_element_at(part, F.col("lang"))).groupBy("lang", "place").agg(F.min("text").alias("text"))
    sample = chosen.mapInArrow(_histograms, "lang string, place long, buckets binary, counts binary").orderBy("place", "lang").limit(2 * sample_rows * len(counts)).collect()
    return train([(r.lang, np.frombuffer(r.buckets, np.uint16).astype(np.int32), np.frombuffer(r.counts, np.uint32)) for r in sample])


class _Words(dict):
    """Row of a word in ``parts``: its sum of logits and its number of subwords."""

    def __init__(self, model: Model) -> None:
        self.model, self.parts = model, np.zeros((0, len(model.languages) + 1))

    def learn(self, words: list[str]) -> None:
        new = np.zeros((len(words), self.parts.shape[1]))
        for buckets, sizes in subwords(words):
            held = sizes > 0
            if held.any():
                new[held, :-1] += np.add.reduceat(self.model.table[buckets], (np.cumsum(sizes) - sizes)[held])
            new[:, -1] += sizes
        self.update(zip(words, range(len(self), len(self) + len(words)), strict=True))
        self.parts = np.concatenate([self.parts, new])

    def sums(self, texts: list[str]) -> np.ndarray:
        """A row for each text: all its words added up at once."""
        if len(self) > CACHED:
            self.clear()
            self.parts = self.parts[:0]
        found = [LETTERS.findall(t) for t in texts]
        self.learn(sorted(set(chain.from_iterable(found)).difference(self)))
        sizes = np.array([len(w) for w in found])
        out = np.zeros((len(texts), self.parts.shape[1]))
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=sizes.sum())
        if len(rows):
            held = sizes > 0
            out[held] = np.add.reduceat(self.parts[rows], (np.cumsum(sizes) - sizes)[held])
        return out


def _grouped(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts (null: empty) in order, some megabytes at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _predict(model: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value if model else None
        words = _Words(m) if m else None
        for batch in batches:
            out = []
            for texts in _grouped(batch.column(1).to_pylist()):
                if words is None:
                    out += [("und", 0.0, True)] * len(texts)
                    continue
                sums = words.sums(texts)
                p = _softmax((sums[:, :-1] / np.maximum(sums[:, -1:], 1) + m.bias) * m.sharpness)
                best = p.argmax(1)
                for k, (n, i) in enumerate(zip(sums[:, -1], best.tolist(), strict=True)):
                    out.append((m.languages[i], float(p[k, i]), bool(p[k, i] < m.reject_below)) if n else ("und", 0.0, True))
            if out:
                langs, scores, rejected = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected)], schema=FIELDS)

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score and whether the calibrated score is too low to trust.

    ``und`` with score 0 for null texts, texts without a letter, and all texts if nothing could be learned. Of equally likely
    languages the first by name is predicted. Repeated rows each return; an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_predict(spark.sparkContext.broadcast(model) if model else None), PREDICTED)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """``predict`` with a model of ``docs``' own rows outside the held-out fold, and ``held_out``; a null doc_id is in no fold, so not held out."""
    return predict(docs, fit(docs, folds, held_out)).select("doc_id", (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score", "rejected")
