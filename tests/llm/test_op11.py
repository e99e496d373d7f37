import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from tracewell.llm import token_links as T

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
VOCAB = {i: t for t, i in json.load(open(P.path("byte_bpe_50k.json")))["model"]["vocab"].items()}


def bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def tokens(text):
    """Ids and byte ranges of both, by the whole text at once; None if the bytes differ."""
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    pa, pb = [bytes(T.BYTES[c] for c in VOCAB[i]) for i in a], [bytes_b(i) for i in b]
    return (a, spans(pa), b, spans(pb)) if text and b"".join(pa) == b"".join(pb) == (" " + text).encode() else None


def brute(rows):
    pairs, found = Counter(), []
    for i, text in rows:
        if (t := tokens(text or "")) is None:
            found.append((i, 0, 0, 0, [], ""))
            continue
        a, sa, b, sb = t
        links = [(x, y) for x, (s, e) in zip(a, sa, strict=True) for y, (u, v) in zip(b, sb, strict=True) if s < v and u < e]
        pairs.update(links)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [",".join(str(x) for x, (s, e) in zip(a, sa, strict=True) if lo <= s and e <= hi) + "|" + ",".join(str(x) for x, (s, e) in zip(b, sb, strict=True) if lo <= s and e <= hi) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    return Counter((i, n_a, n_b, n_g, len(links), sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links), sha) for i, n_a, n_b, n_g, links, sha in found)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b\n\n c \n  d"), (5, "line;\r\nnext\r \r\n{\r"), (6, "▁ no"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"), (8, "中文 café \U0001f600 naïve x　y"),
    (9, "it's DON'T 1234567 ... !!"), (9, "it's DON'T 1234567 ... !!"), (None, "the cat"), (10, "the cat " * 300), (11, "x" * 3000), (12, "\x00\x01 \x1c a"), (13, "\t\ttab sep  é"), (14, "﻿a​b �"),
]


def test_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "q", 1, 2) for r in ODD], "doc_id long, text string, kind string, row int, bucket int")
    assert Counter(tuple(r) for r in T.aligned(docs).collect()) == brute(ODD)
    assert T.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(rows) > 100 and Counter(tuple(r) for r in T.aligned(docs).collect()) == brute(rows)


def test_pieces_are_aligned_as_the_whole_text():
    """Random texts of white space of all kinds, letters of many scripts, digits, marks and the tokenizers' own characters."""
    words, rng = T.Aligner(*T.default_paths()), random.Random(3)
    parts = [*T.WHITE, *"     \n\r\r", *"aZéЖא中가\U0001f600", *"́‍️", *"019", *".,;:!?'\"&-_()/{}*", "'s", "'LL", " the", "ing", ");", "<|endoftext|>", "<0x0A>", "<s>", "\x1c", "▁"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 16)))
        number = words.numbers(words.pieces.findall(" " + text))
        want = tokens(text)
        assert (want is None) == (not words.bad.isdisjoint(number)), repr(text)
        if want:
            a, sa, b, sb = want
            links = sorted(y << 16 | x for x, (s, e) in zip(a, sa, strict=True) for y, (u, v) in zip(b, sb, strict=True) if s < v and u < e)
            assert sorted(x for n in number for x in words.links[words.starts[n] : words.starts[n + 1]]) == links, repr(text)
            assert [sum(words.sums[4 * n + k] for n in number) for k in (0, 1, 3)] == [len(a), len(b), len(links)], repr(text)


def test_salts_steps_and_small_caches(monkeypatch):
    """A task that forgets words, splits documents over steps and blocks, and passes pair counts on early gives the same sums."""
    monkeypatch.setattr(T, "STEP", 7)
    monkeypatch.setattr(T, "CACHED", 5)
    monkeypatch.setattr(T, "COUNTED", 10)
    task = T._Task(T.Aligner(*T.default_paths()), 100)
    rows = []
    for i, text in ODD:
        task.add(i, text)
        rows += [r for b in task.flush() for r in b.to_pylist()]
    rows += [r for b in task.pairs() for r in b.to_pylist()]
    counts = Counter()
    for r in rows:
        if r["kind"] == 2:
            counts[r["b"], r["a"]] += r["n"]
    want = brute(ODD)
    assert {(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in rows if r["kind"] == 0} == {w[:5] + w[7:] for w in want}
    assert sum(counts.values()) == sum(w[4] * n for w, n in want.items())


def test_hot_ranges_are_salted(spark, monkeypatch):
    monkeypatch.setattr(T, "GROUP", 50)
    docs = spark.createDataFrame([(i, f"the cat {i % 7} sat on the mat") for i in range(200)], "doc_id long, text string").repartition(8)
    rows = [(i, f"the cat {i % 7} sat on the mat") for i in range(200)]
    assert Counter(tuple(r) for r in T.aligned(docs).collect()) == brute(rows)
