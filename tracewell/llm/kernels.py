"""Vectorised text hashing used inside tasks.

A polynomial over random byte values modulo 2^64 with an odd base: prefix sums give
the hash of any substring, wherever it stands, from two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SLICE = 1 << 20
_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or of its inverse."""
    got = _POWERS.get((which, inverse))
    if got is None or len(got) < n:
        base = BASES[which]
        if inverse:
            base = pow(base, -1, 1 << 64)
        size = max(n, SLICE + 65536)
        fill = np.full(size, base, dtype=np.uint64)
        fill[0] = 1
        got = np.multiply.accumulate(fill)
        if n <= 4 * SLICE:
            _POWERS[which, inverse] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(buf: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[which][buf] * powers(which, len(buf)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the substrings [start, end); equal strings of equal length agree."""
    return mix((sums[end] - sums[start]) * powers(which, len(sums), inverse=True)[start] + (end - start).astype(np.uint64))


def _pieces(texts: Sequence[bytes]) -> Iterator[tuple[int, bytes]]:
    """(text number, piece); long texts are cut at white space."""
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > SLICE:
            end = at + SLICE
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                later = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(c, end)) >= 0]
                cut = min(later) if later else len(text)
            yield i, text[at:cut]
            at = cut
        yield i, text[at:]


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, in order, and the number of words of each text."""
    counts = np.zeros(len(texts), dtype=np.int64)
    found: list[np.ndarray] = []
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        buf = np.frombuffer(b"\n".join(p for _, p in held) + b"\n", dtype=np.uint8)
        space = SPACE[buf]
        edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
        start, end = edge[0::2], edge[1::2]
        if len(start):
            found.append(span_hashes(prefix_sums(buf), start, end))
        ends = np.cumsum([len(p) + 1 for _, p in held])
        upto = np.searchsorted(start, ends)
        np.add.at(counts, [i for i, _ in held], np.diff(upto, prepend=0))

    for i, piece in _pieces(texts):
        held.append((i, piece))
        size += len(piece) + 1
        if size >= SLICE:
            flush()
            held, size = [], 0
    if held:
        flush()
    return (np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)), counts


def shingle_sets(texts: Sequence[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each lower-cased text; shorter texts have one, empty ones none."""
    words, counts = word_hashes([t.translate(LOWER) for t in texts])
    weights = powers(1, width + 1)[1:]
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled += words[k : len(words) - width + 1 + k] * weights[k]
    rolled = mix(rolled)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[end - n : end - width + 1]))
        elif n:
            short = (words[end - n : end] * weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
