"""Harmonic packing: reciprocal-capacity classes, each bin of class k filled with k pieces.

A piece of length in (capacity/(k+1), capacity/k] is of class k, and any k of them fit one bin;
so bins need no search, and workers fill them independently from a piece's number in its class.
Documents may be cut, so a length that would waste much of its class is cut to the next
reciprocal and the rest is classed again: what remains of padding is a part of a bin each.
Only the last, incomplete bin of each class is left over. There are at most ``capacity`` classes,
so these pieces are a bounded number whatever the input, and first-fit-decreasing packs them.
"""

from __future__ import annotations

import array
import itertools
import json
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.runtime import ship
from tracewell.shared import ranged, running, written

CAPACITY = 2048
#: Padding in tokens that a class may leave in a bin before its pieces are cut, and a length that is never cut.
SLACK, SMALL = 32, 64
END = 1
CACHED = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long"
FIELDS = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class")])
#: Byte-level alphabets write a byte as the character of its number if that is printable, else as the next one from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_NEXT = itertools.count(256)
VISIBLE = "".join(chr(b if b in _SHOWN else next(_NEXT)) for b in range(256))
#: The normalizer and the pre-tokenizer that ``parts`` holds for.
KNOWN = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
#: What the tokenizer cannot be told of in parts: special tokens, and what normalising may join or turn into marks.
WHOLE = re.compile("[\u0130\u023a\u023e\u0300-\U0010ffff]|<\\|")


def _below(category: str) -> str:
    return "".join(c for c in map(chr, range(0x300)) if unicodedata.category(c)[0] == category)


#: The pre-tokenizer's parts of lower-cased text of characters below U+0300, where normalising leaves text as it is.
PARTS = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_below('L')}]+|[{_below('N')}]|[^{_below('L')}{_below('N')}\x09-\x0d\x20\x85\xa0]+")
#: Characters that are a part each if none stands beside another, bytes of texts that hold but them, letters, digits and
#: white space, which bytes are such characters, and what those bytes may also write.
LONE = [c for c in string.punctuation if c != "'"]
PLAIN = bytes([*range(9, 14), 32, *map(ord, LONE), *map(ord, string.ascii_letters + string.digits), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
MARKED = bytes(ord("." if chr(b) in LONE else "a") for b in range(256))
OTHERS = re.compile("[\u00d7\u00f7\u0130\u023a\u023e]")
_TOKENIZERS: dict[str, Words] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Token ids of a text's parts, words and punctuation, packed as little-endian unsigned 32-bit.

    Tokenizers that do not normalise and cut as ``KNOWN`` says, or have other special tokens, get whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        steps = [x and json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
        self.known = steps == KNOWN and all(re.fullmatch(r"<\|\S+", t.content) and not t.normalized for t in tokenizer.get_added_tokens_decoder().values())

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            ids = array.array("I", [t.id for t in self.merge(part)]).tobytes()
        elif WHOLE.search(part):
            ids = array.array("I", self.encode(part, add_special_tokens=False).ids).tobytes()
        elif len(found := PARTS.findall(part)) == 1:
            # straight to the merges, at a quarter of the cost
            ids = array.array("I", [t.id for t in self.merge(found[0].encode().decode("latin-1").translate(VISIBLE))]).tobytes()
        else:
            ids = b"".join(map(self.__getitem__, found))
        if len(self) >= CACHED:
            self.clear()
        self[part] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        if not self.known:
            return array.array("I", self.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, parts(text)))


def parts(text: bytes) -> list[str]:
    """Words and punctuation of a text, lower-cased, as few different ones as can be: rare words are met with many marks behind them."""
    shown = text.decode()
    if not text.translate(None, PLAIN) and b".." not in text.translate(MARKED) and (shown.isascii() or not OTHERS.search(shown)):
        # splitting is several times faster than matching
        shown = shown.lower()
        for mark in LONE:
            shown = shown.replace(mark, f" {mark} ")
        return shown.split()
    if shown.isascii() and "<|" not in shown or not WHOLE.search(shown):
        return PARTS.findall(shown.lower())
    # special tokens are matched as written, and a capital and the mark behind it may compose to another letter than the
    # small ones do, so chunks that hold such keep their case
    out: list[str] = []
    for chunk in map(bytes.decode, text.split()):
        out += [chunk] if WHOLE.search(chunk) else PARTS.findall(chunk.lower())
    return out


def tokenizer(path: str) -> Words:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Words(path)
    return _TOKENIZERS[path]


def cuts(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of each piece of a document of so many tokens."""
    out = [(capacity, 1)] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest
        if rest <= SMALL or capacity - k * rest <= SLACK:
            out.append((rest, k))
            break
        length = capacity // (k + 1)
        out.append((length, k + 1))
        rest -= length
    return out


def _pieces(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path or default_tokenizer())
        end = array.array("I", [END]).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_buffer().to_pybytes() if text.is_valid else b"") + end
                at, total = 0, len(ids) // 4
                for length, k in cuts(total, capacity):
                    rows.append((doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total, k))
                    at += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=FIELDS)

    return run


BINNED = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place")])


def _first_fit(capacity: int):
    def run(pieces: pa.Table) -> pa.Table:
        free: list[int] = []
        rows = []
        for piece in sorted(pieces.drop_columns("all").to_pylist(), key=lambda r: (-r["length"], r["doc_id"] or 0, r["start"], r["ids_crc32"])):
            b = next((i for i, f in enumerate(free) if f >= piece["length"]), len(free))
            if b == len(free):
                free.append(capacity)
            free[b] -= piece["length"]
            rows.append(piece | {"sequence_id": b, "place": len(rows)})
        return pa.Table.from_pylist(rows, schema=BINNED)

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack the tokens of all texts (null: empty), each closed by id 1, into sequences of ``capacity``.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    sequence_length (``capacity``, or the tokens held if they are a power of two). A null doc_id is
    kept; repeated rows are packed each for itself, and equal pieces are dealt to as many tasks as any others.
    No rows for an empty table; other columns are ignored.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(source.mapInArrow(_pieces(tokenizer_path, capacity), PIECES), "pieces")
    dealt = ranged(pieces.withColumn("mark", F.xxhash64("doc_id", "start", "ids_crc32")), ["class", "mark"], "ranged-pieces")
    placed = running(dealt, ["class"], "part", [F.col("mark"), F.col("row")], F.lit(1).cast("long"), "rank", "many").withColumn("bin", F.expr("rank div class"))
    whole = F.col("bin") < F.expr("many div class")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = placed.where(whole).select(*columns, (F.shiftleft("class", 40) + F.col("bin")).alias("sequence_id"), F.col("rank").alias("place"))
    left = placed.where(~whole).select(*columns, F.lit(0).alias("all")).groupBy("all").applyInArrow(_first_fit(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    every = full.unionByName(left)
    sequence = Window.partitionBy("sequence_id")
    before = sequence.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    held = F.sum("length").over(sequence)
    return every.select(
        *columns,
        "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
        F.when(held.bitwiseAND(held - 1) == 0, held).otherwise(F.lit(capacity).cast("long")).alias("sequence_length"),
    )
