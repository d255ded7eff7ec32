"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter n-gram is the product of its letters'
vectors, each permuted (rolled) by its place; word borders count as a letter. A text is the sum of its n-gram vectors, a
language the sum over its training texts; a text gets the language whose vector has the largest cosine with its own,
the first in alphabetical order on a tie. Because sums commute, n-grams are counted first and multiplied with their
vectors as a matrix.

Null texts and texts without a letter are ``und`` with score 0; so is every text if nothing could be learned. Null
languages teach nothing. The score is the cosine, from 0 on. Repeated rows count each; columns of the input named like a
result are replaced, all others carried. Training sums are one vector per language and task, added up by Spark; what
reaches the driver is one vector per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textarrays import slices, worker_cache

DIMENSIONS, LETTERS = 1024, 3
BLOCK = 4096  # n-grams multiplied at once
CELLS = 2 << 20  # counts of texts by n-grams held at once; many short texts take their n-grams in smaller steps
KNOWN_MOST = 40_000  # n-gram vectors that a worker keeps
MOST_LANGUAGES = 2000
UNDETERMINED = "und"
Profiles = tuple[list[str], np.ndarray]


def letter_vector(point: int, dimensions: int) -> np.ndarray:
    cache = worker_cache("languages").setdefault(("letters", dimensions), {})
    if point not in cache:
        if len(cache) > 20_000:
            cache.clear()
        cache[point] = np.random.default_rng([2024, point]).choice(np.array([-1, 1], np.int8), dimensions)
    return cache[point]


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of n-grams, each a row of code points."""
    bound = None
    for place in range(grams.shape[1]):
        points, codes = np.unique(grams[:, place], return_inverse=True)
        table = np.stack([letter_vector(int(p), dimensions) for p in points])
        rolled = np.roll(table, grams.shape[1] - 1 - place, axis=1)[codes]
        bound = rolled if bound is None else bound * rolled
    return bound


def gram_table(codes: np.ndarray, grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of distinct n-grams, most of them from the worker's table."""
    cache = worker_cache("languages")
    known, table, used = cache.get(("grams", dimensions), ({}, None, 0))
    if table is None or len(known) + len(codes) > KNOWN_MOST:
        known, table, used = {}, np.empty((KNOWN_MOST, dimensions), np.int8), 0
    if len(codes) > KNOWN_MOST:
        return gram_vectors(grams, dimensions)
    keys = codes.tolist()
    new = [i for i, key in enumerate(keys) if key not in known]
    if new:
        table[used : used + len(new)] = gram_vectors(grams[new], dimensions)
        known.update(zip((keys[i] for i in new), range(used, used + len(new)), strict=True))
        used += len(new)
    cache["grams", dimensions] = (known, table, used)
    return table[[known[key] for key in keys]]


def letter_grams(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner text and code of each n-gram of a slice, the distinct n-grams by code, and which texts have letters."""
    lowered = [s.lower() for s in strings]
    points = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(s) + 2 for s in lowered])
    kinds, codes = np.unique(points, return_inverse=True)
    letter = np.array([chr(p).isalpha() for p in kinds])[codes]
    points = np.where(letter, points, 32).astype(np.int64)
    keep = letter.copy()  # letters, and one border between words (two between texts)
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    owner = np.searchsorted(ends, np.arange(len(points)), "right")[keep]
    points, letter = points[keep], letter[keep]
    if len(points) < LETTERS:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros((0, LETTERS), np.int64), np.zeros(len(strings), bool)
    n = len(points) - LETTERS + 1
    code = np.zeros(n, np.int64)
    for j in range(LETTERS):
        code = (code << 21) | points[j : n + j]
    inside = (owner[:n] == owner[LETTERS - 1 :]) & letter[1 : n + 1]
    code, owner_of = code[inside], owner[:n][inside]
    codes, values = pd.factorize(code)
    grams = np.stack([(values >> (21 * (LETTERS - 1 - j))) & 0x1FFFFF for j in range(LETTERS)], 1)
    lettered = np.bincount(owner[letter], minlength=len(strings))[: len(strings)] > 0
    return owner_of, codes, grams, lettered


def text_vectors(
    strings: list[str], groups: np.ndarray | None, n_groups: int, dimensions: int, distinct: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n-gram vectors per text (or per group of texts), and which texts have letters.

    The numbers of distinct n-grams are added to ``distinct``.
    """
    owner, codes, grams, lettered = letter_grams(strings)
    rows = n_groups if groups is not None else len(strings)
    total = np.zeros((rows, dimensions), np.float64 if groups is not None else np.float32)
    if groups is not None and len(owner):
        taught = groups[owner] >= 0
        owner, codes = groups[owner[taught]], codes[taught]
    if not len(owner):
        return total, lettered
    values = (grams[:, 0] << 42) | (grams[:, 1] << 21) | grams[:, 2]
    step = max(1, min(BLOCK, CELLS // rows))
    for low in range(0, len(grams), step):
        high = min(low + step, len(grams))
        part = (codes >= low) & (codes < high)
        counts = np.bincount(owner[part] * (high - low) + codes[part] - low, minlength=rows * (high - low))
        vectors = gram_table(values[low:high], grams[low:high], dimensions).astype(np.float32)
        total += counts.reshape(rows, high - low).astype(np.float32) @ vectors
        if distinct is not None:
            distinct += np.count_nonzero(counts.reshape(rows, high - low), axis=1)
    return total, lettered


def learn_profiles(docs: DataFrame, taught: Column, dimensions: int = DIMENSIONS) -> Profiles:
    """Language vectors from the rows where ``taught`` holds and text and lang are not null."""
    rows = docs.filter(taught & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for low, high in slices(batch.column(1)):
                names, groups = np.unique(np.array(batch.column(0).slice(low, high - low).to_pylist(), object), return_inverse=True)
                vectors, _ = text_vectors(batch.column(1).slice(low, high - low).to_pylist(), groups, len(names), dimensions)
                for name, vector in zip(names, vectors, strict=True):
                    sums[name] = sums.get(name, 0) + vector.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
            names=["lang", "vector"],
        )

    partial = rows.mapInArrow(run, "lang string, vector array<long>")
    added = partial.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = added.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value")))["value"].alias("vector"))
    found = sorted(vectors.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.array([row.vector for row in found], np.float32).reshape(len(found), dimensions)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return [row.lang for row in found], table / np.maximum(norms, 1e-9)


def identify_languages(docs: DataFrame, profiles: Profiles, dimensions: int = DIMENSIONS, evidence: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score; with ``evidence`` also n_grams, the number of distinct n-grams."""
    names, table = profiles
    found = {"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)} | ({"n_grams": F.lit(0).cast("long")} if evidence else {})
    wide, added = docs.drop(*found).withColumns(found), len(found)
    place = wide.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.full(len(batch.column(place)), -1)
            score = np.zeros(len(best))
            grams = np.zeros(len(best), np.int64)
            column = batch.column(place).fill_null("")
            for low, high in slices(column):
                distinct = grams[low:high] if evidence else None
                vectors, lettered = text_vectors(column.slice(low, high - low).to_pylist(), None, 0, dimensions, distinct)
                if names:
                    cosines = vectors @ table.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                    best[low:high] = np.where(lettered, cosines.argmax(1), -1)
                    score[low:high] = np.where(lettered, np.clip(cosines.max(1), 0, 1), 0)
            told = [names[b] if b >= 0 else UNDETERMINED for b in best.tolist()]
            columns = [*batch.columns[:-added], pa.array(told, pa.string()), pa.array(score.astype(float))]
            columns += [pa.array(grams)] if evidence else []
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return wide.mapInArrow(run, wide.schema)


def crc_remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def held_out(modulus: int, remainder: int) -> Column:
    """Rows without an id are not held out: they have no remainder."""
    return F.coalesce(crc_remainder(modulus) == remainder, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn_profiles(docs, ~held_out(4, 2))
    found = identify_languages(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), profiles)
    return found.select("doc_id", "held_out", "lang_pred", "score")
