r"""Ranked lexical search, reversed: documents stream through an inverted index of the items.

Terms are runs of ASCII letters, digits and any character above U+007F, only A-Z lower-cased. The items' terms make an
inverted index (term to items with multiplicity), which is broadcast. First pass: each text is cut into terms once and
the counts of those that any item holds are kept (term numbers and frequencies, a table far smaller than the texts).
It gives the number N of documents with a term, the number L of all terms, and how many documents hold each term (df).
Second pass: the kept counts stream through the index. Scores of some documents and all items are summed in a small
dense block, and each item keeps a bounded heap of its best documents: one document enters only if it beats or ties the
worst one kept. A task ends with its heaps; they are merged per item.

The score of a document is the sum over the item's terms, repeats included, of
w * ((1000000000 * tf) div (1000 * tf + 8 * m)) with w = floor(1000 * ln((2 N + 2) / (2 df + 1))) and
m = 25 + (75 * n * N) div L for a document of n terms, in 64-bit integers; documents with a score of 0 are not returned.

Items go in blocks of about ``BLOCK_BYTES`` of text (``ITEM_BYTES`` added for each), so that index and heaps are bounded
however many items there are; each block takes one pass over all texts. Terms are found by a 64-bit hash and compared
by their bytes.

Null and empty texts have no terms: such a document is not counted in N, such an item has no results. Equal (item_id,
text) rows are one item; rows that share an id but not a text are items of their own, each with its ranks. Rows of
documents are documents of their own, repeated rows too, and equal scores are ordered by ascending id, null last (ids are
whole numbers). Long texts are read whole; a task holds a slice of about a megabyte of text, or one longer text. An
empty table gives an empty result. Columns other than the ids and texts are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.stages import drop_stages
from tidemark.llm.textarrays import Texts, slices, span_hashes, texts_of
from tidemark.sources.stages import Stage, write_stage

BLOCK_BYTES = 8 << 20
ITEM_BYTES = 256
CELLS = 1 << 20  # of a block of scores
STEPS = 1 << 20  # additions to scores that are laid out at once

Arrays = dict[str, np.ndarray]


def term_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all terms, and the number of terms before each text."""
    term = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        term[low : high + 1] = True
    inside = term[texts.data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(inside))]  # terms end where a text ends
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of several ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def inverted_index(item_texts: pa.Array) -> Arrays:
    """Sorted hashes and bytes of all terms, and for each the items that hold it with their counts."""
    texts = texts_of(item_texts, lower=True)
    starts, ends, offsets = term_spans(texts)
    hashes = span_hashes(texts.data, starts, ends)
    known, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
    if not same_bytes(texts.data, starts, ends, texts.data, starts[first][codes], ends[first][codes]).all():
        raise ValueError("two terms of the items share a hash")
    item = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs, counts = np.unique(codes.astype(np.int64) * max(1, len(texts)) + item, return_counts=True)
    term, item = np.divmod(pairs, max(1, len(texts)))
    lengths = (ends - starts)[first]
    return {
        "hash": known,
        "data": texts.data[ranges(starts[first], lengths)],
        "begin": np.append(0, np.cumsum(lengths)),
        "posting": np.searchsorted(term, np.arange(len(known) + 1)),
        "item": item,
        "count": counts,
        "n_items": np.array(len(texts)),
    }


def same_bytes(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether the spans of ``a`` and ``b`` are equal, pair by pair (none is empty)."""
    lengths = a_ends - a_starts
    equal = lengths == b_ends - b_starts
    kept = np.flatnonzero(equal)
    if len(kept):
        alike = a[ranges(a_starts[kept], lengths[kept])] == b[ranges(b_starts[kept], lengths[kept])]
        equal[kept] = np.logical_and.reduceat(alike, np.append(0, np.cumsum(lengths[kept])[:-1]))
    return equal


def count_terms(column: pa.Array, index: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: all terms; and (text, term, frequency) of those in the index, by text and term."""
    texts = texts_of(column, lower=True)
    starts, ends, offsets = term_spans(texts)
    known, begin = index["hash"], index["begin"]
    hashes = span_hashes(texts.data, starts, ends)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1) if len(known) else np.zeros(len(hashes), np.int64)
    hit = np.flatnonzero(known[place] == hashes) if len(known) else np.zeros(0, np.int64)
    term = place[hit]
    real = same_bytes(texts.data, starts[hit], ends[hit], index["data"], begin[term], begin[term + 1])
    hit, term = hit[real], term[real]
    text = np.searchsorted(offsets, hit, "right") - 1
    pairs, counts = np.unique(text * max(1, len(known)) + term, return_counts=True)
    return np.diff(offsets), *np.divmod(pairs, max(1, len(known))), counts


def term_counts(docs: DataFrame, index) -> DataFrame:  # index: a broadcast variable of Arrays
    """(doc_id, n, terms, counts) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                n, text, term, count = count_terms(batch.column(1).slice(low, high - low), index.value)
                offsets = pa.array(np.searchsorted(text, np.arange(high - low + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (term, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class Heaps:
    """The ``most`` best documents of each item: highest score first, then lowest id, null ids last."""

    def __init__(self, n_items: int, most: int):
        self.most = most
        self.least = np.ones(n_items, np.int64)  # a score to reach
        self.rows = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, bool, np.int64))  # item, score, null, id

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """``scores``: a row per document, a column per item."""
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        new = (item, scores[doc, item], null[doc], ids[doc])
        item, score, null, ids = (np.concatenate(both) for both in zip(self.rows, new, strict=True))
        order = np.lexsort((ids, null, -score, item))
        begins = np.searchsorted(item[order], np.arange(len(self.least)))
        rank = np.arange(len(order)) - begins[item[order]]
        kept = order[rank < self.most]
        self.rows = item[kept], score[kept], null[kept], ids[kept]
        last = order[rank == self.most - 1]
        self.least[item[last]] = score[last]


def contributions(term: np.ndarray, count: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m))


def block_scores(doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int, index: Arrays) -> np.ndarray:
    """Scores (documents, items): each (document, term, value) goes to all items that hold the term."""
    n_items = int(index["n_items"])
    scores = np.zeros(n_docs * n_items, np.int64)
    lengths = np.diff(index["posting"])[term]
    laid = np.append(0, np.cumsum(lengths))
    low = 0
    while low < len(term):
        high = max(low + 1, int(np.searchsorted(laid, laid[low] + STEPS, "right")) - 1)
        postings = ranges(index["posting"][term[low:high]], lengths[low:high])
        cell = np.repeat(doc[low:high] * n_items, lengths[low:high]) + index["item"][postings]
        np.add.at(scores, cell, np.repeat(value[low:high], lengths[low:high]) * index["count"][postings])
        low = high
    return scores.reshape(n_docs, n_items)


def best_of_tasks(counted: DataFrame, index, weights: np.ndarray, n_docs: int, n_terms: int, most: int) -> DataFrame:
    """(item, doc_id, score): the heaps of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = index.value
        n_items = int(arrays["n_items"])
        heaps = Heaps(n_items, most)
        step = max(1, CELLS // max(1, n_items))
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0))
            null = np.asarray(batch.column(0).is_null())
            m = np.array([25 + (75 * n * n_docs) // n_terms for n in batch.column(1).to_pylist()], np.int64)
            sizes = np.asarray(pa.compute.list_value_length(batch.column(2)), dtype=np.int64)
            bounds = np.append(0, np.cumsum(sizes))
            term, count = (np.asarray(batch.column(i).flatten(), dtype=np.int64) for i in (2, 3))
            doc = np.repeat(np.arange(len(ids)), sizes)
            value = contributions(term, count, m[doc], weights)
            for low in range(0, len(ids), step):
                high = min(len(ids), low + step)
                part = slice(bounds[low], bounds[high])
                heaps.offer(block_scores(doc[part] - low, term[part], value[part], high - low, arrays), ids[low:high], null[low:high])
        item, score, null, ids = heaps.rows
        columns = [pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item long, doc_id long, score long")


def search_block(docs: DataFrame, rows: list, id_type: str, most: int, stage: Stage) -> DataFrame | None:
    """Results for the items ``rows`` (item_id, text); None where no document or no item has a term."""
    spark = docs.sparkSession
    index = inverted_index(pa.array([row.text for row in rows], pa.string()))
    shared = spark.sparkContext.broadcast(index)
    counted = stage(term_counts(docs, shared), "term_counts")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs or not len(index["hash"]):
        return None
    holding = np.zeros(len(index["hash"]), np.int64)  # df; a row per term of the block at most
    for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[term] = df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
    found = best_of_tasks(counted, shared, weights, n_docs, n_terms, most)
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank")
    names = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(rows)], f"item long, item_id {id_type}")
    result = stage(ranked.filter(F.col("rank") <= most).join(names, "item").select("item_id", "rank", "doc_id", "score"), "search_results")
    drop_stages(counted)
    shared.unpersist()
    return result


def search(docs: DataFrame, items: DataFrame, most: int = 10, block_bytes: int = BLOCK_BYTES, stage: Stage = write_stage) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the ``most`` documents with the highest score above 0."""
    id_type = items.schema["item_id"].dataType.simpleString()
    wanted = stage(items.select("item_id", "text").distinct(), "items")
    bytes_of = F.coalesce(F.octet_length("text"), F.lit(0)) + ITEM_BYTES
    blocks = max(1, math.ceil((wanted.agg(F.sum(bytes_of)).first()[0] or 0) / block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = [search_block(docs, wanted.filter(block == number).collect(), id_type, most, stage) for number in range(blocks)]
    found = [part for part in parts if part is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return search(docs, items, most=10)


_SQL_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
OP11_SQL = f"""
WITH wanted AS (
  SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark) GROUP BY ALL
), docs AS (
  SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM (SELECT doc_id, {_SQL_TERMS} AS terms FROM documents) WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs
), held AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs) SEMI JOIN wanted USING (term) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total
), scored AS (
  SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM held JOIN weights USING (term) JOIN wanted USING (term), total GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
