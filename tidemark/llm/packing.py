"""Best-fit-decreasing packing of tokenised documents into windows, without a shuffle.

A document is its ids and then ``end_id``. Overlong documents are first cut into full windows; what is left over goes,
longest first, into the tightest open window, which a segment tree over remaining capacities finds in log(window) steps.
A task packs its own rows in blocks of about ``BLOCK_TOKENS`` ids, so memory is bounded and a lost task packs the same
rows anew, with the sequence numbers of its partition. Windows that a block leaves with a gap over ``loose`` are joined
and cut at full windows again, so a block ends with one half-filled window at most.

Null and empty texts are a document of ``end_id`` alone. Repeated rows, and rows without an id, are packed each for
itself. An empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pretokens

BLOCK_TOKENS = 4 << 20
SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity 0..window: a segment tree of counts over stacks of window numbers."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, number: int) -> None:
        self.stacks[capacity].append(number)
        node = capacity + self.size
        while node:
            self.tree[node] += 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, number) of the window with the least capacity >= need."""
        node, tree = need + self.size, self.tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up until a right sibling holds a window
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.size
        while node:
            tree[node] -= 1
            node >>= 1
        return capacity, self.stacks[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Windows as lists of piece numbers; pieces of equal length go in the order given."""
    tree, windows = OpenWindows(window), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = tree.take_tightest(need)
        if found is None:
            windows.append([piece])
            left, number = window - need, len(windows) - 1
        else:
            left, number = found[0] - need, found[1]
            windows[number].append(piece)
        if left:
            tree.add(left, number)
    return windows


def pack_lengths(totals: np.ndarray, window: int, loose: int) -> np.ndarray:
    """Pieces (document, start, length, sequence, offset) of documents with ``totals`` ids each."""
    full = totals // window
    docs = np.repeat(np.arange(len(totals)), full)
    starts = (np.arange(len(docs)) - np.repeat(np.cumsum(full) - full, full)) * window
    rows = [np.stack([docs, starts, np.full(len(docs), window), np.arange(len(docs)), np.zeros(len(docs), np.int64)], 1)]
    sequence = len(docs)
    rest = np.flatnonzero(totals % window)
    sizes, begins = totals[rest] % window, full[rest] * window
    tight, gaps = [], []
    for pieces in best_fit_decreasing(sizes, window):
        (gaps if window - int(sizes[pieces].sum()) > loose else tight).append(pieces)
    placed = []
    for pieces in tight:
        offset = 0
        for piece in pieces:
            placed.append((rest[piece], begins[piece], sizes[piece], sequence, offset))
            offset += int(sizes[piece])
        sequence += 1
    offset = 0
    for piece in (p for pieces in gaps for p in pieces):
        done, size = 0, int(sizes[piece])
        while done < size:
            length = min(size - done, window - offset)
            placed.append((rest[piece], begins[piece] + done, length, sequence, offset))
            done, offset = done + length, offset + length
            if offset == window:
                sequence, offset = sequence + 1, 0
    rows.append(np.array(placed, np.int64).reshape(-1, 5))
    return np.concatenate(rows)


def pack_documents(
    docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, loose: int | None = None
) -> DataFrame:
    """One row per piece. ``ids`` are little-endian unsigned 32-bit numbers; pieces of a sequence lie gapless from 0."""
    slack = window // 32 if loose is None else loose
    texts = docs.select("doc_id", "text")
    id_type = texts.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pretokens.merger(path).encode_to_numpy
        number = TaskContext.get().partitionId() << 40
        names, ids, held = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            totals = np.array([len(x) for x in ids], np.int64)
            pieces = pack_lengths(totals, window, slack)
            for part in np.array_split(pieces, max(1, len(pieces) // 4096)):
                payload = [ids[d][s : s + n].tobytes() for d, s, n in part[:, :3].tolist()]
                columns = [
                    pa.array([names[d] for d in part[:, 0].tolist()], names_type),
                    pa.array(part[:, 1]),
                    pa.array(part[:, 2]),
                    pa.array(payload, pa.binary()),
                    pa.array(totals[part[:, 0]]),
                    pa.array(part[:, 3] + number),
                    pa.array(part[:, 4]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=OUT)
            number += int(pieces[:, 3].max()) + 1 if len(pieces) else 0

        for batch in batches:
            names_type = batch.column(0).type
            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                names.append(batch.column(0)[row].as_py())
                ids.append(np.append(encode(text, allowed_special="all"), np.uint32(end_id)).astype("<u4"))
                held += len(ids[-1])
                if held >= BLOCK_TOKENS:
                    yield from packed()
                    names, ids, held = [], [], 0
        if ids:
            yield from packed()

    return texts.mapInArrow(run, SCHEMA.format(id=id_type.simpleString()))


OUT = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)
    digest = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset")
