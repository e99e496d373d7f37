"""Secret scan: fixed patterns, and passwords whose guess cost is high where credentials stand.

The guess cost of a value is the least sum over its segmentations into common words, dates,
repeats, sequences, keyboard walks and brute-force characters, in powers of ten. Words are a short fixed list, and all
words that two documents or more hold, ranked by how many do, whatever their language. The ranked words stay a table: values
of credential contexts are told apart, the words that they may hold are joined to their ranks, and each distinct value is
priced once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracewell.llm.kernels import LOWER
from tracewell.llm.runtime import columns_of, quoted, ship
from tracewell.shared import ranged, running, written

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A keyword starts after a non-letter, or as a capital after a small letter (dbPassword); compass and shopping hold none.
CONTEXT = re.compile(r"""(?:(?u:(?<![^\W\d_]))|(?<=[a-z])(?=[A-Z]))(?i:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|auth|credentials?|private[_-]?key|access[_-]?key)["']?(?:\x20+is|\x20*[:=])\x20*(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"']{6,}))""", re.ASCII)
KINDS = ("assign", "access", "hex", "guess")
#: Characters of a value, at least: after an assignment of a fixed pattern, and for a guess cost to say anything.
SHORTEST_ASSIGNED, SHORTEST_GUESSED = 8, 6
#: Guesses, as a power of ten, from which a value in a credential context counts as a secret.
STRONG = 9.0
#: Words that guessers try first, most common first.
COMMON = (
    "password 123456 qwerty letmein welcome admin dragon monkey football baseball iloveyou master sunshine "
    "princess shadow superman michael login abc123 starwars hello freedom whatever trustno1 secret summer winter "
    "spring autumn love money flower ninja hunter soccer killer jordan george charlie andrew daniel jessica "
    "computer internet service server system default changeme example test user root guest public private token "
    "access pass word key the and for you are not with this that from have your home time life best good happy"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
#: Words of documents: letters of a word, and documents that hold it at least.
WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST, FEWEST = 4, 32, 2
#: What every text with a finding holds, for Spark's own pattern matching.
FLAG = "(?i:pass|pwd|pin|auth|credential|key|secret|token)|AKIA|[0-9a-f]{32}"
LEET = str.maketrans("@4301$5!7", "aaeolssit")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
AT = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)", re.ASCII)
HEXED = bytes(120 if chr(b) in "0123456789abcdef" else 46 for b in range(256))


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _near(a: str, b: str) -> bool:
    (r, i), (s, j) = AT.get(a, (-9, -9)), AT.get(b, (9, 9))
    return abs(r - s) <= 1 and abs(i - j) <= 1 and a != b


def _run_ends(n: int, goes_on: Callable[[int], bool]) -> list[int]:
    """Per position the end of the longest run from there; ``goes_on(j)``: j continues the run of j - 1."""
    ends = list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if goes_on(i + 1):
            ends[i] = ends[i + 1]
    return ends


def guess_cost(value: str, words: dict[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation, in time that grows with the length of the value."""
    n, low = len(value), value.lower()
    low = low if len(low) == n else value
    plain = low.translate(LEET)
    same = _run_ends(n, lambda j: value[j] == value[j - 1])
    # periods[size][i]: where the stretch from i of characters equal to those ``size`` before ends
    periods = {}
    for size in (2, 3, 4):
        ends = list(range(n + 1))
        for i in range(n - 1, size - 1, -1):
            if value[i] == value[i - size]:
                ends[i] = ends[i + 1]
        periods[size] = ends
    rises = _run_ends(n, lambda j: low[j].isalnum() and ord(low[j]) - ord(low[j - 1]) == 1)
    falls = _run_ends(n, lambda j: low[j].isalnum() and ord(low[j]) - ord(low[j - 1]) == -1)
    walks = _run_ends(n, lambda j: _near(low[j - 1], low[j]))
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i] + (0.3 if i else 0.0)  # each further segment doubles the ways to combine them
        best[i + 1] = min(best[i + 1], best[i] + _alphabet(value[i]))
        reached = []
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = words.get(low[i:j]) or words.get(plain[i:j])
            if rank:
                as_listed = value[i:j] == low[i:j] == plain[i:j]
                reached.append((j, math.log10(rank + 1) + (0.0 if as_listed else 0.6)))
        if m := DATE.match(value, i):
            reached.append((m.end(), 4.6 if m.end() - i > 4 else 2.1))
        if (j := same[i]) - i >= 3:
            reached.append((j, _alphabet(value[i]) + math.log10(j - i)))
        for size, ends in periods.items():
            times = 1 + (ends[i + size] - i - size) // size if i + size <= n else 1
            if times >= 2:
                reached.append((i + times * size, sum(map(_alphabet, value[i : i + size])) + math.log10(times)))
        for ends in (rises, falls):
            if (j := ends[i]) - i >= 3:
                reached.append((j, 1.5 + math.log10(j - i)))
        if (j := walks[i]) - i >= 3:
            reached.append((j, 1.7 + 0.5 * (j - i)))
        for j, cost in reached:
            best[j] = min(best[j], here + cost)
    return best[n]


def _named(low: bytes) -> bool:
    return any(k in low for k in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"))


def _in_context(low: bytes) -> bool:
    return _named(low) or ((b":" in low or b"=" in low or b" is " in low) and any(k in low for k in (b"pass", b"pwd", b"pin", b"auth", b"credential", b"key")))


def looked(raw: bytes) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The text, spans (start, number of the kind, end) of the fixed patterns, and the values in credential contexts."""
    low = raw.translate(LOWER)
    named = _named(low)
    access, hexed = b"AKIA" in raw, b"x" * 32 in raw.translate(HEXED)
    context = _in_context(low)
    if not (named or access or hexed or context):
        return "", [], []
    text = raw.decode()
    found, values = [], set()
    if named:
        for m in ASSIGN.finditer(text):
            values.add(m.span(2))
            if len(m[2]) >= SHORTEST_ASSIGNED:
                found.append((m.start(), 0, m.end()))
    if access:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if hexed:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if context:
        values |= {m.span(m.lastindex) for m in CONTEXT.finditer(text)}
    trimmed = sorted({(start, start + len(text[start:end].rstrip(".,;:!?)"))) for start, end in values})
    return text, sorted(found), [(start, end) for start, end in trimmed if end - start >= SHORTEST_GUESSED]


def judged(raw: bytes, words: dict[str, int] = RANK) -> tuple[list[tuple[int, str, int]], float | None]:
    """Spans (start, kind, end) in code points, by start, then kind as in ``KINDS``; and the highest guess cost of any value.

    The value of every credential context is judged by its guess cost, one that a fixed pattern names as well: it is
    then a span of its own inside that pattern's. The cost is None if no value stands in such a context.
    """
    text, found, values = looked(raw)
    costs = [guess_cost(text[start:end], words) for start, end in values]
    found += [(start, 3, end) for (start, end), cost in zip(values, costs, strict=True) if cost >= STRONG]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)], max(costs, default=None)


def spans(raw: bytes, words: dict[str, int] = RANK) -> list[tuple[int, str, int]]:
    return judged(raw, words)[0]


def _held(raw: bytes) -> set[str]:
    """Words of a text, without values that stand in credential contexts: a leaked password must not become common."""
    text = raw.decode()
    if _in_context(raw.translate(LOWER)):
        at, parts = 0, []
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            parts.append(text[at:start])
            at = end
        text = " ".join([*parts, text[at:]])
    return {w for w in WORD.findall(text.lower()) if SHORTEST <= len(w) <= LONGEST}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter()
        for text in batch.column(0):
            if text.is_valid:
                counts.update(_held(text.as_buffer().to_pybytes()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def ranked_words(docs: DataFrame) -> DataFrame:
    """(word, rank) of all words of ``docs`` that ``FEWEST`` documents hold, behind the fixed list: by documents, then by name."""
    ship(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    dealt = ranged(counted.where(F.col("n") >= FEWEST), [F.desc("n"), "word"], "ranged-words")
    placed = running(dealt, [], "part", [F.desc("n"), F.col("word")], F.lit(1).cast("long"), "before")
    return placed.select("word", (F.col("before") + len(COMMON) + 1).alias("rank"))


def candidates(value: str) -> set[str]:
    """What of a value may be a word: its stretches of letters, as they are and with letters for what looks like them."""
    low = value.lower()
    low = low if len(low) == len(value) else value
    runs = {m[0] for text in (low, low.translate(LEET)) for m in WORD.finditer(text)}
    return {run[i:j] for run in runs for i in range(len(run)) for j in range(i + SHORTEST, min(len(run), i + LONGEST) + 1)}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column(0).to_pylist():
            if words := sorted(candidates(value)):
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(words)), pa.array(words)], names=["value", "word"])


def _price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value, words, ranks = (c.to_pylist() for c in batch.columns)
        costs = [guess_cost(v, dict(zip(w or (), r or (), strict=True)) | RANK) for v, w, r in zip(value, words, ranks, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.float64())], names=["value", "cost"])


def priced(values: DataFrame, words: DataFrame) -> DataFrame:
    """(value, cost) of distinct values; ``words``: (word, rank). A value meets the words that it may hold, no others."""
    held = values.mapInArrow(_candidates, "value string, word string").join(words, "word").groupBy("value").agg(F.collect_list(F.struct("word", "rank")).alias("held"))
    known = values.join(held, "value", "left")
    return written(known.select("value", F.col("held.word").alias("words"), F.col("held.rank").alias("ranks")).mapInArrow(_price, "value string, cost double"), "priced-values")


def _joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


LOOKED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, held array<struct<start:int,end:int,value:string>>"
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
HELD = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
FIELDS = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", SPAN), ("held", HELD)])


def _looked_at(text: pa.StringScalar) -> tuple[list[dict], list[dict]]:
    """Spans of the fixed patterns and the values in credential contexts, as rows of ``SPAN`` and ``HELD``."""
    whole, base, values = looked(text.as_buffer().to_pybytes()) if text.is_valid else ("", [], [])
    return [{"start": s, "kind": k, "end": e} for s, k, e in base], [{"start": s, "end": e, "value": whole[s:e]} for s, e in values]


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            base, held = _looked_at(text)
            kinds = [x["kind"] for x in base]
            digest = hashlib.sha256(_joined([(x["start"], KINDS[x["kind"]], x["end"]) for x in base]).encode()).hexdigest()
            rows.append((doc_id, *(kinds.count(k) for k in range(3)), digest, base, held))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FIELDS.types, strict=True)], schema=FIELDS)


def _look_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_looked_at(text) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in found], SPAN), pa.array([h for _, h in found], HELD)], names=["digest", "base", "held"])


def _found(looks: DataFrame, words: DataFrame) -> DataFrame:
    """``looks``, stored, with a number, with ``spans``, by start and kind, and ``guess_cost``, the highest of any value."""
    values = looks.select("row", F.inline("held"))
    costs = priced(values.select("value").distinct(), words)
    guessed = F.when(F.col("cost") >= STRONG, F.struct("start", F.lit(3).alias("kind"), "end"))
    strong = values.join(costs, "value").groupBy("row").agg(F.max("cost").alias("guess_cost"), F.collect_list(guessed).alias("guessed"))
    return looks.join(strong, "row", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("guessed", F.array().cast("array<struct<start:int,kind:int,end:int>>")))))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts of the fixed kinds, a digest of their spans, all spans, and guess_cost.

    Spans are kind:start:end in code points, comma-joined, by start and then kind. guess_cost is the highest cost, in powers
    of ten, of a value in a credential context, null if there is none. Null and empty texts have no spans; a null doc_id is
    kept; repeated rows each return. An empty table gives an empty result. Other columns are ignored.
    """
    words = ranked_words(docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    looks = written(source.mapInArrow(_look, LOOKED).withColumn("row", F.monotonically_increasing_id()), "looks")
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    joined = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return _found(looks, words).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", joined.alias("spans"), "guess_cost")


def _redact(mask: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                whole = text.as_py()
                if not found:
                    out.append(whole)
                    continue
                at, parts = 0, []
                for span in found:
                    if span["end"] > at:
                        parts += [whole[at : max(at, span["start"])], mask] if span["start"] >= at else []
                        at = span["end"]
                out.append("".join([*parts, whole[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    return run


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``, and n_chars set to the new length if there is such a column.

    Overlapping spans become one mask. Null texts stay null, and rows without a find stay as they are, repeated ones too;
    other columns, whatever their names, are kept. An empty table gives an empty result. Only texts that may hold a secret
    meet their spans, by digest, so equal texts are looked at once.
    """
    words = ranked_words(docs)
    columns = columns_of(docs)
    text = F.col("text").cast("string")
    flagged = docs.where(F.coalesce(text.rlike(FLAG), F.lit(False))).select(F.struct(*columns).alias("row"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"))
    once = flagged.groupBy("digest").agg(F.first("text").alias("text"))
    numbered = written(once.mapInArrow(_look_named, "digest string, base array<struct<start:int,kind:int,end:int>>, held array<struct<start:int,end:int,value:string>>").withColumn("row", F.monotonically_increasing_id()), "looks")
    cuts = written(_found(numbered, words).where(F.size("spans") > 0).select("digest", "spans"), "spans")
    schema = StructType([flagged.schema["row"], StructField("text", StringType())])
    done = flagged.join(cuts, "digest", "left").select("row", "text", "spans").mapInArrow(_redact(mask), schema)
    length = F.length("text").cast("long")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("text") == F.col("row.text"), F.col("row.n_chars")).otherwise(length)}
    masked = done.select(*[changed[c].alias(c) if c in changed else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
    return docs.where(~F.coalesce(text.rlike(FLAG), F.lit(False))).select(*columns).unionByName(masked)
