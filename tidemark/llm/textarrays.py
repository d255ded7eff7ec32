"""Whole texts of an Arrow column as flat arrays: words, spans and 64-bit hashes, without a Python loop over words.

A word is a run of bytes other than space and ``\\x09-\\x0D``. Null texts count as empty. Work goes in slices of a few
megabytes; only a single text that is larger makes a larger slice.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

SLICE_BYTES = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def worker_cache(owner: str = "words") -> dict:
    """Objects kept in a Python worker between tasks (functions shipped by value share no globals between tasks).

    One owner's at a time: Spark uses its workers again for other operators, which get the memory back.
    """
    name = "_tidemark_llm_worker"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("held", {})
    if owner not in held:
        held.clear()
    return held.setdefault(owner, {})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0xD1B54A32D192ED03) + U(seed)) | U(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker at the largest length asked for (up to 32 MB)."""
    cache = worker_cache()
    known = cache.get(("powers", int(base)))
    if known is None or len(known) < n:
        known = np.full(n, base, U)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 4 << 20:
            cache["powers", int(base)] = known
    return known[:n]


@dataclass
class Texts:
    data: np.ndarray  # UTF-8 bytes of all texts, one after the other
    offsets: np.ndarray  # of each text, and the end

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each."""
    yield from cuts(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64), most)


def cuts(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` in all; a single row may be larger."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def packed(column: pa.Array) -> pa.Array:
    """Texts compressed one by one, for the way through joins: about a third of their bytes."""
    pack = zstandard.ZstdCompressor(level=3)
    return pa.array([pack.compress(text.as_buffer()) for text in column.fill_null("").cast(pa.binary())], pa.binary())


def unpacked(column: pa.Array) -> pa.Array:
    opener = zstandard.ZstdDecompressor()
    return pa.array([opener.decompress(raw.as_py()) for raw in column], pa.binary()).cast(pa.string())


def texts_of(column: pa.Array, lower: bool = False) -> Texts:
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[bounds[0] : bounds[-1]]
    if lower:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        raw = table[raw]
    return Texts(raw, bounds - bounds[0])


def word_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the word offsets of each text."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    inside = ~space[texts.data]
    size = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = texts.offsets[(texts.offsets > 0) & (texts.offsets < size)]  # words end where a text ends
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, equal for equal content at any place.

    ``data``: bytes or small code points. One prefix sum of a polynomial serves all spans.
    """
    with np.errstate(over="ignore"):
        letters = mix(np.arange(1, (int(data.max()) if len(data) else 0) + 2, dtype=U))
        total = np.zeros(len(data) + 1, U)
        np.cumsum(letters[data] * powers(BASE, len(data)) if len(data) else total[1:], out=total[1:])
        value = (total[ends] - total[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts]
        return mix(value + (ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F))


def run_hashes(words: np.ndarray, length: int, multipliers: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``length`` words (runs that cross a text border included)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        value = words[:n] * multipliers[0]
        for j in range(1, length):
            value += words[j : n + j] * multipliers[j]
        return mix(value)
