"""Alignment of two tokenizers by corpus-wide counts of linked ids: a postings cogroup.

Tokens of both kinds are laid over the bytes of a text; two tokens whose ranges overlap are linked. Each task turns its
documents into postings, a document's multiplicity of each linked id pair, sorted by side id (the second tokenizer's), and
deals them as blocks by ranges of side ids. Counts of pairs are summed in each task first, then over all; their number and the
pairs of one side id are bounded by the vocabularies. Blocks of one range meet its counts in a cogroup: sorted streams, so a
pair's documents lie side by side, and each block gives what its pairs add to each of its documents, which is summed by
document. A range that holds more postings than a task should read is salted by blocks; its counts then go to each salt.

Texts are cut at white space, where neither tokenizer's merges cross (checked on the vocabulary), so that the alignment of
a recurring word is computed once in a task; bytes of both kinds of tokens are held against the text's all the same.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.runtime import ship
from tracewell.shared import written

#: Ranges of side ids, and postings that one group of the cogroup reads, about.
BUCKETS, GROUP = 128, 8_000_000
#: Words and links that a task remembers, words of one step, pairs that it counts before it passes them on.
CACHED, CACHED_LINKS, STEP, COUNTED = 500_000, 4_000_000, 200_000, 1_000_000
#: White space as Unicode has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARK = "\u2581"
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level alphabets write a byte as the character of its number if that is printable, else as the next one from 256 on.
BYTES = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
STORED = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, entries long, postings binary, b int, a int, n long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
FIELDS = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in STORED.split(", "))])
ADDED = "base long, docs binary, n_best binary, count_sum binary"
ADDED_FIELDS = pa.schema([("base", pa.int64()), ("docs", pa.binary()), ("n_best", pa.binary()), ("count_sum", pa.binary())])
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(ids_a: list[int], sizes_a: list[int], ids_b: list[int], sizes_b: list[int]) -> tuple[list[str], list[int]]:
    """Groups, as 'a,a|b', and all links, as b * 65536 + a, of two token rows over the same bytes."""
    groups, links = [], []
    i = j = first_a = first_b = 0
    last, end_a, end_b = len(ids_a), sizes_a[0], sizes_b[0]
    while True:
        links.append(ids_b[j] << 16 | ids_a[i])
        if end_a == end_b:
            if i == first_a and j == first_b:
                groups.append(f"{ids_a[i]}|{ids_b[j]}")
            else:
                groups.append(",".join(map(str, ids_a[first_a : i + 1])) + "|" + ",".join(map(str, ids_b[first_b : j + 1])))
            first_a = i = i + 1
            first_b = j = j + 1
            if i == last:
                return groups, links
            end_a += sizes_a[i]
            end_b += sizes_b[j]
        elif end_a < end_b:
            i += 1
            end_a += sizes_a[i]
        else:
            j += 1
            end_b += sizes_b[j]


class Aligner(dict):
    """Number of each piece of text in the tables below, which hold its alignment; unknown pieces are learned together."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        # tasks are what runs side by side
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        known = {i: bytes(map(BYTES.__getitem__, token)) for token, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [known.get(i, b"") for i in range(max(known) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.mark = self.b.piece_to_id(MARK)
        # white space that some piece of the second tokenizer has behind other characters: no cut there
        glued = {y for p in pieces for x, y in itertools.pairwise(p.replace(MARK, " ")) if x not in WHITE and y in WHITE}
        white, more = f"[{WHITE}]", f"(?:[{re.escape(''.join(sorted(glued)))}][{WHITE}]*[^{WHITE}]*)*" if glued else ""
        self.pieces = re.compile(f"{white}*[^{WHITE}]+{more}|{white}+")
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.groups: list[str] = []
        self.bad: set[int] = set()
        #: Tokens of both kinds, groups and links of each piece, four numbers in a row; where its links begin; all links.
        self.sums, self.starts, self.links = array.array("q"), array.array("q", [0]), array.array("q")

    def full(self) -> bool:
        return len(self) > CACHED or len(self.links) > CACHED_LINKS

    def learn(self, texts: list[str]) -> None:
        """Align new pieces of texts; those that the tokens of either kind do not give back are noted as bad."""
        # the second tokenizer puts a space first: a piece's own, or one that must stay a token by itself
        all_b = self.b.encode([text[1:] if text[0] == " " else text for text in texts], num_threads=1)
        all_a = [row.ids for row in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        bytes_a, bytes_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for text, ids_a, ids_b in zip(texts, all_a, all_b, strict=True):
            if text[0] != " ":
                ids_b = ids_b[1:] if ids_b and ids_b[0] == self.mark else []
            elif len(text) == 1:
                ids_b = [self.mark]
            own_a, own_b, raw = list(map(bytes_a, ids_a)), list(map(bytes_b, ids_b)), text.encode()
            self[text] = len(self.groups)
            if b"".join(own_a) == raw == b"".join(own_b):
                groups, links = align(ids_a, list(map(len, own_a)), ids_b, list(map(len, own_b)))
                self.groups.append(";".join(groups))
                self.sums.extend((len(ids_a), len(ids_b), len(groups), len(links)))
                self.links.extend(links)
            else:
                self.bad.add(len(self.groups))
                self.groups.append("")
                self.sums.extend((0, 0, 0, 0))
            self.starts.append(len(self.links))

    def numbers(self, texts: list[str]) -> list[int]:
        """The numbers of pieces, which are learned where they are new."""
        if new := list(dict.fromkeys(itertools.filterfalse(self.__contains__, texts))):
            self.learn(new)
        return list(map(self.__getitem__, texts))


def aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return keys[first], np.add.reduceat(counts[order], first)


def _least(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them."""
    most = int(values.max(initial=0))
    return values.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * np.dtype(t).itemsize))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as bytes: for each the size of a number and the count, then all numbers."""
    small = [_least(x) for x in arrays]
    return b"".join(np.array([x.itemsize, len(x)], dtype="<u8").tobytes() + x.tobytes() for x in small)


def unpacked(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        size, n = np.frombuffer(raw, "<u8", 2, at).tolist()
        out.append(np.frombuffer(raw, f"<u{size}", n, at + 16))
        at += 16 + size * n
    return out


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (codes >> 16) % BUCKETS


class _Task:
    """What one task gathers: words of documents, to be given as rows of ``STORED``."""

    def __init__(self, words: Aligner, first_row: int) -> None:
        self.words, self.row, self.base = words, first_row, first_row
        self.docs: list[dict] = []
        self.held: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []

    def steps(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, of a long one some at a time."""
        if len(text) <= STEP:
            yield self.words.pieces.findall(" " + text)
        else:
            pieces = (m[0] for m in self.words.pieces.finditer(" " + text))
            while step := list(itertools.islice(pieces, STEP)):
                yield step

    def add(self, doc_id: int | None, text: str | None) -> None:
        words, digest, sums, whole = self.words, hashlib.sha256(), np.zeros(4, dtype=np.int64), bool(text)
        mine = []
        for step in self.steps(text) if text else ():
            numbers = words.numbers(step)
            whole = whole and (not words.bad or words.bad.isdisjoint(numbers))
            if not whole:
                break
            digest.update(((";" if mine else "") + ";".join(map(words.groups.__getitem__, numbers))).encode())
            number, n = _summed(np.array(numbers), np.ones(len(numbers), dtype=np.int64))
            sums += n @ np.frombuffer(words.sums, dtype=np.int64).reshape(-1, 4)[number]
            mine.append(self._links(number, n))
            if words.full():
                words.clear()
        if whole:
            codes, n = _summed(*(np.concatenate(x) for x in zip(*mine, strict=True)))
            self.held.append((self.row, codes, n))
        self.docs.append({"kind": 0, "row": self.row, "doc_id": doc_id, "groups_sha256": digest.hexdigest() if whole else ""} | dict(zip(("n_a", "n_b", "n_groups", "n_links"), (sums if whole else sums * 0).tolist(), strict=True)))
        self.row += 1

    def _links(self, number: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pair codes of words and how often each occurs."""
        starts, links = np.frombuffer(self.words.starts, dtype=np.int64), np.frombuffer(self.words.links, dtype=np.int64)
        size = starts[number + 1] - starts[number]
        at = np.repeat(starts[number] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return links[at], np.repeat(n, size)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Rows of the documents so far, and their postings as a block for each range of side ids."""
        if self.docs:
            yield pa.RecordBatch.from_pylist(self.docs, schema=FIELDS)
        if self.held:
            docs = np.repeat([row - self.base for row, _, _ in self.held], [len(c) for _, c, _ in self.held])
            codes, n = (np.concatenate([h[k] for h in self.held]) for k in (1, 2))
            order = np.lexsort((docs, codes, _bucket(codes)))
            docs, codes, n = docs[order], codes[order], n[order]
            blocks = []
            for part in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(_bucket(codes))) + 1):
                pairs, size = np.unique(codes[part], return_counts=True)
                blocks.append({"kind": 1, "row": self.base, "bucket": int(_bucket(pairs[:1])[0]), "entries": len(part), "postings": packed(pairs, size, docs[part], n[part])})
            yield pa.RecordBatch.from_pylist(blocks, schema=FIELDS)
            self.counts.append(_summed(codes, n))
        self.docs, self.held, self.base = [], [], self.row
        if sum(len(c) for c, _ in self.counts) > COUNTED:
            yield from self.pairs(COUNTED // 2)

    def pairs(self, keep: int = -1) -> Iterator[pa.RecordBatch]:
        """Rows of counted pairs, unless there are no more than ``keep``."""
        if self.counts:
            codes, n = _summed(*(np.concatenate(x) for x in zip(*self.counts, strict=True)))
            self.counts = [(codes, n)]
            if len(codes) > keep:
                own = {"kind": pa.array(np.full(len(codes), 2), pa.int32()), "b": pa.array(codes >> 16, pa.int32()), "a": pa.array(codes & 65535, pa.int32()), "n": pa.array(n, pa.int64())}
                yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(codes), f.type)) for f in FIELDS], schema=FIELDS)
                self.counts = []


def _postings(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers that no other task gives; the table that they go to is written once
        task = _Task(aligner(paths), TaskContext.get().partitionId() << 36)
        for batch in batches:
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                task.add(doc_id, text.as_py())
                held += len(task.held[-1][1]) if task.held else 0
                if held > CACHED_LINKS:
                    yield from task.flush()
                    held = 0
            yield from task.flush()
        yield from task.pairs()

    return run


def _pack_counts(pairs: pa.Table) -> pa.Table:
    codes = pairs.column("b").to_numpy().astype(np.int64) << 16 | pairs.column("a").to_numpy()
    order = np.argsort(codes)
    raw = packed(codes[order], pairs.column("n").to_numpy()[order], pairs.column("best").to_numpy()[order])
    return pa.table({"bucket": pairs.column("bucket")[:1], "counts": pa.array([raw], pa.binary())})


def _contributions(postings: pa.Table, counts: pa.Table) -> pa.Table:
    """What the pairs of one range add to the documents of each block."""
    rows = []
    if postings.num_rows:
        known, total, best = unpacked(counts.column("counts")[0].as_py())
        for base, raw in zip(postings.column("row").to_pylist(), postings.column("postings"), strict=True):
            pairs, size, docs, n = (x.astype(np.int64) for x in unpacked(raw.as_py()))
            at = np.repeat(np.searchsorted(known, pairs), size)
            _, own = _summed(docs, n * best[at])
            who, sums = _summed(docs, n * total[at].astype(np.int64))
            rows.append({"base": base, "docs": packed(who), "n_best": packed(own), "count_sum": packed(sums)})
    return pa.Table.from_pylist(rows, schema=ADDED_FIELDS)


def _by_document(added: pa.Table) -> pa.Table:
    """Sums over the ranges for each document of a block."""
    base = added.column("base")[0].as_py()
    docs, best, sums = (np.concatenate([unpacked(x.as_py())[0].astype(np.int64) for x in added.column(c)]) for c in ("docs", "n_best", "count_sum"))
    (who, own), (_, total) = _summed(docs, best), _summed(docs, sums)
    return pa.table({"row": pa.array(who + base), "n_best": pa.array(own), "count_sum": pa.array(total)})


def pair_counts(stored: DataFrame) -> DataFrame:
    """(b, a, n, best) of all linked id pairs; best: no pair of that side id has a higher count."""
    pairs = stored.where("kind = 2").groupBy("b", "a").agg(F.sum("n").alias("n"))
    # a window holds at most the first tokenizer's vocabulary
    return pairs.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy("b"))).cast("long"))


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    Null and empty texts, and texts that the tokenizers do not give back byte for byte, have zeros and '' and count nowhere.
    Repeated rows, and rows without an id, count each. Other columns are left out; an empty table gives no rows.
    ``paths``: files of the two tokenizers, as executors see them.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = written(source.mapInArrow(_postings(paths or default_paths()), STORED), "postings")
    blocks = stored.where("kind = 1")
    # one row for each range of side ids: a fixed number
    salts = blocks.groupBy("bucket").agg(F.ceil(F.sum("entries") / GROUP).cast("int").alias("salts"))
    packed_counts = pair_counts(stored).withColumn("bucket", F.pmod("b", F.lit(BUCKETS))).groupBy("bucket").applyInArrow(_pack_counts, "bucket int, counts binary")
    known = packed_counts.join(F.broadcast(salts), "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "counts")
    dealt = blocks.join(F.broadcast(salts), "bucket").select("bucket", F.pmod(F.xxhash64("row"), "salts").cast("int").alias("salt"), "row", "postings")
    added = dealt.groupBy("bucket", "salt").cogroup(known.groupBy("bucket", "salt")).applyInArrow(_contributions, ADDED)
    sums = added.groupBy("base").applyInArrow(_by_document, "row long, n_best long, count_sum long")
    # a document too long for one block is in several
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = stored.where("kind = 0").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    none = F.lit(0).cast("long")
    return own.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
