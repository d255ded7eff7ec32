"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts give a logistic model over text statistics that minimises the non-negative
unbiased risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).  The class prior is estimated
from the two samples themselves: a first model tells positives from unlabelled texts, and among the texts it ranks
highest the share of unlabelled to positive ones is the least where hardly any negatives are left (best bin).

The statistics of every whole text are computed once and kept; at most ``most`` rows of either sample, those with the
least hash of their id, are fitted on the driver. That bound is the only one. Null texts count as empty; they, like all
texts, get a score. Rows without an id are scored and are never labelled or held out. If an id is labelled twice, the
lower label counts. Without positives or unlabelled rows the score is 0.5. Repeated rows are scored each; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.language_id import held_out
from tidemark.llm.text_stats import count_texts, keyed, per_text
from tidemark.llm.textarrays import slices, span_hashes, texts_of, word_spans
from tidemark.sources.stages import write_stage

SHARES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b".,;:?", b"*#$%&<>{}[]=@~^_/\\", bytes(range(128, 256)))
N_STATS = 6 + len(SHARES)


def describe(column: pa.Array) -> np.ndarray:
    """A row of N_STATS statistics for each text."""
    counts = count_texts(column)
    n = np.maximum(counts["n_words"], 1)
    chars = np.maximum(counts["word_chars"], 1)
    size = np.zeros(len(column))
    distinct = np.zeros(len(column))
    shares = np.zeros((len(SHARES), len(column)))
    for low, high in slices(column):
        texts = texts_of(column.slice(low, high - low))
        starts, ends, words = word_spans(texts)
        owner = np.repeat(np.arange(high - low), np.diff(words))
        first = ~pd.Series(keyed(span_hashes(texts.data, starts, ends), owner)).duplicated().to_numpy()
        distinct[low:high] = per_text(first, words)
        size[low:high] = np.diff(texts.offsets)
        for k, letters in enumerate(SHARES):
            table = np.zeros(256, bool)
            table[list(letters)] = True
            shares[k, low:high] = per_text(table[texts.data], texts.offsets)
    rates = np.sqrt(shares / np.maximum(size, 1))
    return np.stack(
        [
            np.log(n),
            np.log(chars / n),
            np.sqrt(counts["n_symbols"] / chars),
            np.sqrt(counts["n_dup_lines"] / n),
            np.sqrt(counts["n_repeat_words"] / n),
            distinct / n,
            *rates,
        ],
        axis=1,
    )


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(basis(stats, self.centre, self.scale) @ self.weights, -30, 30)))


def basis(stats: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((stats - centre) / scale, -8, 8)
    return np.concatenate([z, np.abs(z), z * z / 4, np.ones((len(z), 1))], axis=1)


def descend(gradient, size: int, steps: int = 600, rate: float = 0.03) -> np.ndarray:
    """Adam on the whole sample."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, ridge: float = 1e-4) -> float:
    """Best bin: the least ratio of unlabelled to positive texts above a threshold, on the odd rows of a model of the even."""
    p, q = positive[::2], unlabelled[::2]

    def gradient(w: np.ndarray) -> np.ndarray:
        return p.T @ (sigmoid(p @ w) - 1) / len(p) + q.T @ sigmoid(q @ w) / len(q) + ridge * w

    w = descend(gradient, positive.shape[1], 300)
    over_p, over_q = np.sort(positive[1::2] @ w), np.sort(unlabelled[1::2] @ w)
    borders = np.quantile(over_p, np.linspace(0.0, 0.9, 91))
    share_p = 1 - np.searchsorted(over_p, borders) / len(over_p)
    share_q = 1 - np.searchsorted(over_q, borders) / len(over_q)
    slack = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(over_p)) + 1 / np.sqrt(len(over_q)))
    best = int(np.argmin((share_q + slack) / share_p))
    return float(np.clip(share_q[best] / share_p[best], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, ridge: float = 1e-4) -> Model:
    centre = np.median(unlabelled, axis=0)
    scale = np.maximum(unlabelled.std(axis=0), 1e-3)
    p, u = basis(positive, centre, scale), basis(unlabelled, centre, scale)
    prior = estimate_prior(p, u)

    def gradient(w: np.ndarray) -> np.ndarray:
        yes_p, yes_u = sigmoid(p @ w), sigmoid(u @ w)
        as_positive = prior * (p.T @ (yes_p - 1)) / len(p)
        negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        as_negative = u.T @ yes_u / len(u) - prior * (p.T @ yes_p) / len(p)
        # Where the risk of the negatives falls below zero the model has begun to overfit: step back.
        return as_positive + as_negative + ridge * w if negative >= 0 else -as_negative

    return Model(centre, scale, descend(gradient, p.shape[1]), prior)


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with the array ``stats`` in place of the text."""
    wide = docs.withColumn("stats", F.array().cast("array<double>"))
    place = wide.columns.index("text")
    out = wide.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array(describe(batch.column(place)).tolist(), pa.list_(pa.float64()))
            kept = [i for i in range(batch.num_columns - 1) if i != place]
            names = [batch.schema.names[i] for i in kept]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], stats], names=[*names, "stats"])

    return wide.mapInArrow(run, out.schema)


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """Statistics of at most ``most`` rows: those with the least hash of their id.

    Rows over the hash that about 1.2 * ``most`` rows stay under are left where they are, so that tasks send no more.
    """
    hashed = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "stats")
    share = min(1.0, 1.2 * (most + 100) / max(1, hashed.count()))
    border = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    taken = hashed.filter(F.col("h") <= border).orderBy("h", "doc_id").limit(most).collect()
    return np.array([row.stats for row in taken], float).reshape(-1, N_STATS)


def learn(described: DataFrame, labels: DataFrame, usable: Column, most: int = 20_000) -> Model | None:
    """From labels of quality 1 and all rows where ``usable`` holds; ``described`` has doc_id and stats."""
    rows = described.filter(usable & F.col("doc_id").isNotNull())
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    positive = sample(rows.join(trusted, "doc_id", "left_semi"), most)
    unlabelled = sample(rows, most)
    return fit(positive, unlabelled) if len(positive) > 3 and len(unlabelled) > 3 else None


def score_texts(described: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """score and predicted in place of stats."""
    wide = described.drop("score", "predicted").withColumn("score", F.lit(0.5))
    place = wide.columns.index("stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = batch.column(place)
            scores = np.full(len(stats), 0.5)
            if model is not None:
                scores = model.score(np.asarray(stats.flatten(), float).reshape(-1, N_STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], schema=batch.schema)

    predicted = (F.col("score") >= threshold).cast("int")
    return wide.mapInArrow(run, wide.schema).withColumn("predicted", predicted).drop("stats")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held_out(5, 0).alias("held_out"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    described = write_stage(with_stats(docs), "text_statistics")
    model = learn(described, labels, ~F.col("held_out"))
    return score_texts(described, model)
