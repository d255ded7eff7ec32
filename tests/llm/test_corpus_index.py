"""Exact dedup by the hash index: against a dictionary, with forced collisions, and at the edges."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tidemark.llm import hash_index

SCHEMA = "doc_id long, text string"


def by_dictionary(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=repr)


def check(found, rows):
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == by_dictionary(rows)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    classes = {re.sub(r"[\x20\x09-\x0D]+", " ", text or "") for _, text in rows}
    assert sorted(r.text_sha256 for r in found if r.kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in classes)


def some_rows(n, seed):
    rnd = random.Random(seed)
    words = ["a", "b", " ", "  ", "\t", "\n", "é", "\x0b", " "]
    rows = [(i, "".join(rnd.choice(words) for _ in range(rnd.randint(0, 5)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "x " * 200_000), (n + 3, "x\n" * 200_000)]


@pytest.mark.parametrize("bits,capacity", [(64, 4), (5, 2), (1, 1)])
def test_rows_equal_a_dictionary_whatever_the_key(spark, bits, capacity):
    """With few bits nearly every key is a chain of collisions."""
    rows = some_rows(150, bits)
    docs = spark.createDataFrame(rows, SCHEMA)
    check(hash_index.exact_duplicates(docs, capacity=capacity, bits=bits).collect(), rows)


def test_long_lists_of_repeated_keys_are_joined_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(hash_index, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(hash_index, "HEAVY", 4)
    rows = [(i, "hot") for i in range(40)] + some_rows(60, 3)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    check(hash_index.exact_duplicates(spark.createDataFrame(rows, SCHEMA), capacity=8).collect(), rows)


def test_ids_that_repeat_or_are_null(spark):
    rows = [(3, "a  b"), (3, "a b"), (5, "a\tb"), (None, "a b"), (None, None), (None, ""), (1, "c"), (1, "c"), (1, "d")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS row", "3 AS n", "'x' AS keep_id")
    check(hash_index.exact_duplicates(docs).collect(), rows)
    check(hash_index.exact_duplicates(docs, bits=1).collect(), rows)
    assert hash_index.exact_duplicates(docs.limit(0)).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    """Keys crowd under one prefix: its bucket is deep, the other half of the directory shares one bucket."""
    from tidemark.sources.stages import write_stage

    keys = spark.createDataFrame([(k,) for k in [*range(64), 200, 201, 255]], "key long")
    directory, depth = hash_index.grow_directory(keys, 4, 8, write_stage)
    rows = directory.collect()
    assert depth == 6 and sorted(r.slot for r in rows) == list(range(1 << depth))
    buckets = {r.bucket: r for r in rows}
    assert max(r.n for r in buckets.values()) <= 4 and sum(r.n for r in buckets.values()) == 67
    assert {r.bucket for r in rows if r.slot >= 32} == {32} and buckets[32].depth == 1
    for r in rows:  # a key finds its bucket through its slot
        assert r.slot >> (depth - r.depth) == r.bucket >> (depth - r.depth)


def test_index_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], SCHEMA)
    plan = hash_index.exact_duplicates(docs, bits=1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
