import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers as P
from pyspark.sql import Row
from tokenizers import Tokenizer

from tracewell.llm.packing import CAPACITY, Words, cuts, pack


def check(rows, got):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in rows]
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, ids in want:
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    padded = 0
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY and {r.sequence_length for r in b} == {at if at & (at - 1) == 0 else CAPACITY}
        padded += b[0].sequence_length - at
    return padded / (sum(len(x) for _, x in want) + padded)


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check(rows, pack(docs).collect()) < 0.02


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Ω ΑΣ ΑΣ. é É K İ x y <|ENDOFTEXT|> a<|endoftext|>b 12,5"), (4, "word " * 9000), (5, "don't DON'T we'll ... a.b a,, é. 5."), (None, "x")]
    got = pack(spark.createDataFrame([Row(doc_id=i, text=t, length="q", bin=1, rank=2) for i, t in rows])).collect()
    check(rows, got)
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_are_the_tokenizers():
    """Random texts of letters of many scripts, combining marks, digits, punctuation and special tokens."""
    path = P.path("word_bpe_49k.json")
    plain, words, rng = Tokenizer.from_file(path), Words(path), random.Random(11)
    parts = [*"aZ\u0130\u0131\u015e\u00df\u00c9\u00e9\u01c5\u1e9e\u03a3\u03c2\u0416\u05d0\u0627\u4e2d\uac00\u1100\u1161\u2126\u212a", *"\u0301\u0307\u0327\u0345\u200d\ufe0f", *"019\u00bd\u0665", *".,;:!?'\"&-_()/", "'s", "'LL", " ", " ", "\n", "\t", "\x1f", "\u00a0", "\u2028", "<|endoftext|>", "<|startoftext|>", "<|"]
    texts = ["T\u00dcRK\u0130YE'DEK\u0130.", "\u015e\u0130RKET\u0130, yeni", "X&\u0130!"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(20_000)]
    wrong = [t for t in texts if struct.pack(f"<{len(ids := plain.encode(t, add_special_tokens=False).ids)}I", *ids) != words.ids(t.encode())]
    assert not wrong, wrong[:5]


def test_capitals_before_marks():
    """Each ASCII letter before each combining mark, bare and with punctuation, then 200,000 random strings of such parts."""
    path = P.path("word_bpe_49k.json")
    plain, words, rng = Tokenizer.from_file(path), Words(path), random.Random(12)
    letters = [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    marks = [chr(c) for c in range(0x300, 0x370)] + [chr(c) for c in (*range(0x1AB0, 0x1AC0), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x20F1), *range(0xFE20, 0xFE30), 0x3099, 0x309A, 0x345)]
    texts = [a + m + p for a in letters for m in marks for p in ("", ".", "x,")]
    texts += ["".join(x for _ in range(rng.randrange(1, 4)) for x in (rng.choice(letters), rng.choice([*marks, ""]), rng.choice([*".,;:!?'-& ", ""]))) for _ in range(200_000)]
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        for text, want in zip(part, plain.encode_batch(part, add_special_tokens=False), strict=True):
            assert words.ids(text.encode()) == struct.pack(f"<{len(want.ids)}I", *want.ids), repr(text)


def test_marks_do_not_multiply_words():
    """A rare word is merged once, whatever stands beside it and whether it has capitals, and no chunk goes through the whole tokenizer."""
    path = P.path("word_bpe_49k.json")
    plain, words, met = Tokenizer.from_file(path), Words(path), []
    merge = words.merge
    words.encode, words.merge = None, lambda part: met.append(part) or merge(part)
    for text in ("zorblat", "zorblat, (Zorblat) zorblat. 7", 'ZORBLAT! "zorblat"; zorblat_7', "zorblat... zorblat's $$$", "zorbl\u00e2t, \u00c9zorblat \u00abzorblat\u00bb 7", "\u00e9zorblat? ZORBL\u00c2T", "zorblat\u00d7, zorblat"):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert words.ids(text.encode()) == struct.pack(f"<{len(ids)}I", *ids), text
    assert met.count("zorblat") == 1 and len(met) == len(set(met))


def test_another_tokenizer():
    """One that keeps case and white space gets whole texts."""
    path = P.path("byte_bpe_50k.json")
    plain, words = Tokenizer.from_file(path), Words(path)
    assert Words(P.path("word_bpe_49k.json")).known
    for text in ("", "Two  Words, don't\n", "\u00c9t\u00e9 <|endoftext|> \u2014 7"):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert words.ids(text.encode()) == struct.pack(f"<{len(ids)}I", *ids), text


def test_characters_below_marks():
    """Each character below U+0300, alone and among letters, digits, marks and white space, then random strings of them."""
    path = P.path("word_bpe_49k.json")
    plain, words, rng = Tokenizer.from_file(path), Words(path), random.Random(13)
    chars = [chr(c) for c in range(0x300)]
    texts = [form.format(c) for c in chars for form in ("{0}", "a{0}b", "a{0}, x", "x,{0}", "{0}{0} 1{0}2", "'{0}'s", "\u00e9{0}.", "{0}<|endoftext|>{0}", "{0} \u2014 A{0}")]
    texts += ["".join(rng.choices(rng.choice([chars, chars[:128], chars[0x41:0x250], [*"ab,. \u00e9\u00d7", rng.choice(chars)]]), k=rng.randrange(1, 12))) for _ in range(60_000)]
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        for text, want in zip(part, plain.encode_batch(part, add_special_tokens=False), strict=True):
            assert words.ids(text.encode()) == struct.pack(f"<{len(want.ids)}I", *want.ids), repr(text)


def test_repeated_rows_are_packed_each(spark):
    rows = [(i % 3, "one two three four") for i in range(60)] + [(None, "x y")] * 7
    got = pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 67 and sum(r.length for r in got) == 60 * 5 + 7 * 3


def test_cuts():
    for n in range(1, 3 * CAPACITY):
        pieces = cuts(n)
        assert sum(x for x, _ in pieces) == n and all(x * k <= CAPACITY for x, k in pieces)
