"""Counts of words, symbols, repeated lines and repeated word triples of whole texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from tidemark.llm.textarrays import U, mix, odd_multipliers, run_hashes, slices, span_hashes, texts_of, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"


def keyed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that also tell the texts of a slice apart."""
    with np.errstate(over="ignore"):
        return mix(hashes + (owner.astype(U) + U(1)) * U(0x9FB21C651E98DF25))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[offsets])


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text; null counts as empty.

    ``n_dup_lines``: lines with a word that equal an earlier line of the text. ``n_repeat_words``: words inside a window
    of three words that occurs twice or more in the text, the first occurrence included.
    """
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    triple = odd_multipliers(3, 3)
    out = {name: np.zeros(len(column), np.int64) for name in COUNTS}
    for low, high in slices(column):
        texts = texts_of(column.slice(low, high - low))
        data, offsets = texts.data, texts.offsets
        starts, ends, words = word_spans(texts)
        out["n_words"][low:high] = np.diff(words)
        begins = (data & 0xC0) != 0x80  # first bytes of code points
        points = np.append(0, np.cumsum(begins, dtype=np.int64))
        sizes = np.append(0, np.cumsum(points[ends] - points[starts]))
        out["word_chars"][low:high] = np.diff(sizes[words])
        out["n_symbols"][low:high] = per_text(symbol[data], offsets)

        breaks = np.flatnonzero(data == 10)
        line_starts = np.union1d(offsets[:-1], breaks + 1)
        line_starts = line_starts[line_starts < len(data)]
        line_ends = np.append(line_starts[1:], len(data))[: len(line_starts)]
        line_ends = line_ends - (data[line_ends - 1] == 10)
        filled = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
        line_starts, line_ends = line_starts[filled], line_ends[filled]
        owner = np.searchsorted(offsets, line_starts, "right") - 1
        lines = pd.Series(keyed(span_hashes(data, line_starts, line_ends), owner))
        out["n_dup_lines"][low:high] = np.bincount(owner[lines.duplicated().to_numpy()], minlength=high - low)

        hashes = span_hashes(data, starts, ends)
        owner = np.repeat(np.arange(high - low), np.diff(words))
        windows = run_hashes(hashes, 3, triple)
        inside = owner[: len(windows)] == owner[2:] if len(windows) else np.zeros(0, bool)
        windows = keyed(windows, owner[: len(windows)])
        twice = np.zeros(len(windows), bool)
        at = np.flatnonzero(inside)
        twice[at] = pd.Series(windows[at]).duplicated(keep=False).to_numpy()
        covered = np.zeros(len(hashes), bool)
        for j in range(3):
            covered[j : j + len(windows)] |= twice
        out["n_repeat_words"][low:high] = per_text(covered, words)
    return out
