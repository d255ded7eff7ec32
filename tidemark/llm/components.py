"""Connected components of an edge table by alternating stars, with a union-find inside each task first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.stages import write_stage

BLOCK_EDGES = 1 << 20
EDGES = "u long, v long"


def forest(edges: DataFrame) -> DataFrame:
    """Edges (node, least node of its tree) that connect what the edges of a task connect, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def out() -> pa.RecordBatch:
            rows = np.array([(node, top) for node in parent if (top := root(node)) != node], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
            if len(parent) > BLOCK_EDGES:
                yield out()
                parent.clear()
        yield out()

    return edges.select("u", "v").mapInArrow(run, EDGES)


def larger_to_least(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least of its neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def smaller_to_least(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another; the component is its least node.

    Rounds end when the edges no longer change: they are stars then. Each round's edges are written.
    """
    current = write_stage(forest(edges.filter("u <> v")), "edges")
    before = digest(current)
    while before[0]:
        turned = current.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        current = write_stage(smaller_to_least(larger_to_least(turned)), "edges")
        now = digest(current)
        if now == before:
            break
        before = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
