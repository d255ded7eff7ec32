"""Token counts by the whole-token shortcut.

Offline, ``prove_whole_tokens`` asks the library which strings of the vocabulary are one pre-token and encode alone as
one token. Pre-tokens among them count one; only the distinct others are merged (``pretokens.merger``).
Null and empty texts have no bytes and no tokens. Rows stay as they are: repeated rows are counted each, other columns
are carried, columns named like a result are replaced. Texts with an added token's string, or with characters outside
``pretokens.SURE``, are encoded whole by the library. Memory of a task: a slice of text, and ``CACHE_MOST`` counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pretokens
from tidemark.llm.textarrays import worker_cache

OUT = ("n_bytes", "n_tokens", "over_limit")


def prove_whole_tokens(path: str) -> np.ndarray:
    """Sorted hashes of the vocabulary's strings that are one pre-token and one token."""
    library = pretokens.tokenizer(path)
    texts = []
    for raw in pretokens.vocabulary(path):
        text = raw.decode("utf-8", "ignore")
        if text and text.encode() == raw:
            texts.append(text)
    proven = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1]
    hashes = []
    for _, _, special, (_, begins, ends, values, offsets) in pretokens.split(pa.array(proven), tuple(pretokens.added_tokens(path))):
        alone = (np.diff(offsets) == 1) & ~special
        hashes.append(values[offsets[:-1][alone]])
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def count_column(column: pa.Array, path: str, whole: np.ndarray) -> np.ndarray:
    library = pretokens.tokenizer(path)
    added, merge = tuple(pretokens.added_tokens(path)), pretokens.merger(path).encode_ordinary
    known: dict[int, int] = worker_cache().setdefault(("counts", path), {})
    counts = np.zeros(len(column), np.int64)
    for low, high, special, (joined, begins, ends, hashes, offsets) in pretokens.split(column, added):
        each = np.ones(len(hashes), np.int64)
        rest = np.flatnonzero(~is_in(hashes, whole))
        codes, values, first = pretokens.distinct(hashes[rest])
        keys = values.tolist()
        if len(known) + len(keys) > pretokens.CACHE_MOST:
            known.clear()
        new = [i for i, key in enumerate(keys) if key not in known]
        where = rest[first[new]] if new else []
        for i, place in zip(new, where, strict=True):
            known[keys[i]] = len(merge(joined[begins[place] : ends[place]]))
        each[rest] = np.array([known[key] for key in keys], np.int64)[codes] if keys else 0
        sums = np.append(0, np.cumsum(each))[offsets]
        counts[low:high] = np.diff(sums)
        for i in np.flatnonzero(special):
            counts[low + i] = len(library.encode(column[low + int(i)].as_py(), add_special_tokens=False).ids)
    return counts


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit) of the column ``text``."""
    whole = prove_whole_tokens(path)  # at most one entry for each string of the vocabulary
    kept = docs.drop(*OUT)
    wide = kept.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    wide = wide.withColumn("n_tokens", F.lit(0).cast("long"))
    place = wide.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_column(batch.column(place), path, whole)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], schema=batch.schema)

    return wide.mapInArrow(run, wide.schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return counted.select("doc_id", *OUT)
