"""Pre-tokens of a byte-level BPE as arrays, and the ids or token counts of distinct pre-tokens from the library.

The split is that of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, found from changes
of character class. It is used for texts whose characters all have a sure class (``SURE``); other texts, and texts
holding an added token's string, go to the library whole. A BPE merges inside pre-tokens only, so the ids of a text are
those of its pre-tokens, one after the other. Pre-tokens are told apart by a 64-bit hash.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.textarrays import slices, span_hashes, worker_cache

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
# Latin script and general punctuation: classes have not changed between versions of Unicode.
SURE = (*range(0x0250), *range(0x2010, 0x2028), 0x2030, 0x20AC, 0x2122)
CACHE_MOST = 300_000  # distinct pre-tokens whose ids a worker keeps


def character_classes() -> np.ndarray:
    table = np.full(max(SURE) + 2, UNSURE, np.uint8)
    for point in SURE:
        kind = unicodedata.category(chr(point))[0]
        spaces = point in (0x20, 0x85, 0xA0) or 9 <= point <= 13
        table[point] = SPACE if spaces else {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    return table


def token_starts(points: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; ``offsets`` are the texts' borders."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    change = border[:n].copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    spaces = kinds[starts] == SPACE
    begins = np.zeros(n, bool)
    begins[starts[spaces]] = True
    goes_on = ~border[ends]  # something of the same text follows the run
    begins[(ends - 1)[spaces & goes_on]] = True
    solid = starts[~spaces]
    blank = (~border[solid]) & (points[np.maximum(solid - 1, 0)] == 32)
    begins[solid[~blank]] = True
    begins[solid[blank] - 1] = True
    # Contractions: an apostrophe alone, no space before it, and letters after it.
    lone = (kinds[starts] == OTHER) & (ends - starts == 1) & (points[starts] == 39) & goes_on
    at = np.flatnonzero(lone)
    at = at[(border[starts[at]] | (points[np.maximum(starts[at] - 1, 0)] != 32))]
    at = at[kinds[ends[at]] == LETTER] if len(at) else at
    for i in at:
        p, stop = int(ends[i]), int(ends[i + 1])
        word = points[p : min(p + 2, stop)].tolist()
        length = 1 if word[0] in (115, 116, 109, 100) else 2 if word in ([114, 101], [118, 101], [108, 108]) else 0
        if length:
            begins[p] = False
            if p + length < stop:
                begins[p + length] = True
    return begins


def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> dict[bytes, int]:
    """Bytes of each token and its id, added tokens left out."""
    letters = byte_letters()
    names = tokenizer(path).get_vocab(with_added_tokens=False)
    added = added_tokens(path)
    return {bytes(letters[c] for c in name): i for name, i in names.items() if name not in added}


def added_tokens(path: str) -> dict[str, int]:
    return {token.content: i for i, token in tokenizer(path).get_added_tokens_decoder().items()}


def merger(path: str):
    """The same vocabulary and merges in an encoder that is about five times as fast; ids are the same."""
    cache = worker_cache()
    if ("merger", path) not in cache:
        import tiktoken

        cache["merger", path] = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks=vocabulary(path), special_tokens=added_tokens(path)
        )
    return cache["merger", path]


def tokenizer(path: str):
    cache = worker_cache()
    if ("tokenizer", path) not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        cache["tokenizer", path] = Tokenizer.from_file(path)
    return cache["tokenizer", path]


def split(column: pa.Array, added: tuple[str, ...]):
    """Slices of a text column: (first row, last row, rows for the library, the pre-tokens of the other rows).

    Pre-tokens come as (string of the slice, starts, ends, hashes, offsets of each row).
    """
    table = character_classes()
    column = column.fill_null("")
    for low, high in slices(column):
        part = column.slice(low, high - low)
        special = np.zeros(high - low, bool)
        for string in added:
            special |= np.asarray(pc.match_substring(part, string), dtype=bool)
        strings = part.to_pylist()
        joined = "".join(strings)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.zeros(len(strings) + 1, np.int64)
        np.cumsum([len(s) for s in strings], out=offsets[1:])
        kinds = table[np.minimum(points, len(table) - 1)]
        unsure = np.append(0, np.cumsum(kinds == UNSURE))
        special |= unsure[offsets[1:]] > unsure[offsets[:-1]]
        begins = np.flatnonzero(token_starts(points, offsets, kinds))
        ends = np.append(begins[1:], len(points))
        hashes = span_hashes(np.minimum(points, len(table) - 1), begins, ends)
        yield low, high, special, (joined, begins, ends, hashes, np.searchsorted(begins, offsets))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each value, the distinct values, and the place where each occurs first."""
    codes, values = pd.factorize(hashes)
    if not len(codes):
        return codes, values, codes
    seen = np.maximum.accumulate(codes)
    return codes, values, np.flatnonzero(np.diff(seen, prepend=-1))
