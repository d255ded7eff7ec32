"""Shingle sets of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from tidemark.llm.text_stats import keyed
from tidemark.llm.textarrays import U, mix, odd_multipliers, run_hashes, span_hashes, texts_of, word_spans


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text (A-Z in lower case), one text after the other, and the texts' offsets.

    A text with fewer words than ``width`` has its whole sequence as its one shingle; one without words has none.
    """
    texts = texts_of(column, lower=True)
    starts, ends, words = word_spans(texts)
    hashes = span_hashes(texts.data, starts, ends)
    sizes = np.diff(words)
    owner = np.repeat(np.arange(len(texts)), sizes)
    factors = odd_multipliers(width, 7)
    runs = run_hashes(hashes, width, factors)
    whole = owner[: len(runs)] == owner[width - 1 :] if len(runs) else np.zeros(0, bool)
    values, owners = [runs[whole]], [owner[: len(runs)][whole]]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    with np.errstate(over="ignore"):
        single = [(hashes[words[i] : words[i + 1]] * factors[: sizes[i]]).sum(dtype=U) + U(sizes[i]) for i in short]
        values.append(mix(np.array(single, U) ^ U(0x5851F42D4C957F2D)))
    owners.append(short)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    value, owner = value[order], owner[order]
    first = ~pd.Series(keyed(value, owner)).duplicated().to_numpy()
    value, owner = value[first], owner[first]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def shared(left: pa.Array, right: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersection and the union of the shingle sets of each pair of texts."""
    a, a_offsets = shingle_sets(left, width)
    b, b_offsets = shingle_sets(right, width)
    a_owner = np.repeat(np.arange(len(left)), np.diff(a_offsets))
    b_owner = np.repeat(np.arange(len(right)), np.diff(b_offsets))
    keys = pd.Series(np.concatenate([keyed(a, a_owner), keyed(b, b_owner)]))
    common = np.bincount(b_owner[keys.duplicated().to_numpy()[len(a) :]], minlength=len(left))
    return common, np.diff(a_offsets) + np.diff(b_offsets) - common


def minhash(values: np.ndarray, offsets: np.ndarray, size: int, bits: int) -> np.ndarray:
    """``size`` b-bit MinHash symbols for each non-empty set (zeros for an empty one)."""
    filled = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, size), np.uint16)
    if len(filled):
        begins = offsets[:-1][filled]
        with np.errstate(over="ignore"):
            for i, factor in enumerate(odd_multipliers(size, 11)):
                least = np.minimum.reduceat(mix_light(values, factor), begins)
                out[filled, i] = (mix(least) >> U(64 - bits)).astype(np.uint16)
    return out


def mix_light(values: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = values * factor
    x ^= x >> U(32)
    x *= factor
    return x

