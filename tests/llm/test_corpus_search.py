"""Ranked lexical search: against plain code, whatever the blocks, and at the edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import lexical_search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plainly(docs, items, most):
    counted = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    n_docs = sum(bool(c) for _, c in counted)
    n_terms = sum(c.total() for _, c in counted)
    df = Counter(term for _, c in counted for term in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for doc_id, c in counted:
            m = 25 + (75 * c.total() * n_docs) // n_terms if n_terms else 0
            score = 0
            for term in terms_of(text):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1000000000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else i, -score) for rank, (score, null, i) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, most=10, **more):
    rows = lexical_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), most, **more)
    assert dict(rows.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    return sorted((tuple(r) for r in rows.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def some_tables(seed, n_docs=300, n_items=25):
    rnd = random.Random(seed)
    words = [*"abcdefgh", "The", "the", "THE", "É", "é", "K", "k", "x1", "_", "ß-ss", "中文", "🙂", "don't"]

    def text(most):
        return rnd.choice([" ", "\n", ", "]).join(rnd.choice(words) for _ in range(rnd.randint(0, most)))

    docs = [(rnd.choice([i, i, i, None]), text(20)) for i in range(n_docs)]
    return [*docs, (-5, None), (n_docs, "a " * 50_000), (7, "twice c"), (7, "twice c")], [(i, text(8)) for i in range(n_items)]


def test_ranks_equal_plain_code(spark):
    docs, items = some_tables(1)
    items += [(None, "a b"), (None, "a b"), (3, "another c"), (99, None), (98, "neverseen")]
    assert found(spark, docs, items) == plainly(docs, items, 10)


def test_blocks_of_items_and_small_steps_change_nothing(spark, monkeypatch):
    docs, items = some_tables(2, 120, 12)
    monkeypatch.setattr(lexical_search, "CELLS", 30)
    monkeypatch.setattr(lexical_search, "STEPS", 7)
    assert found(spark, docs, items, 3, block_bytes=1000) == plainly(docs, items, 3)


def test_ties_go_to_the_lowest_ids(spark):
    docs = [(i, "same words") for i in range(40, 0, -1)] + [(None, "same words"), (50, "rest")]
    assert found(spark, docs, [(1, "same")], 5) == [(1, i, i, found(spark, docs, [(1, "same")], 1)[0][3]) for i in range(1, 6)]


def test_empty_tables(spark):
    docs, items = some_tables(3, 5, 2)
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [(1, None), (2, "--")], items) == []


def test_extra_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS).selectExpr("*", "1 AS item_id", "2 AS rank", "3 AS n", "4 AS terms")
    items = spark.createDataFrame([(4, "b")], ITEMS).selectExpr("*", "7 AS doc_id", "8 AS item")
    assert [r.doc_id for r in lexical_search.search(docs, items).collect()] == [1]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """With a hash of the length alone, terms of other bytes are still not taken for the item's."""
    monkeypatch.setattr(lexical_search, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    index = lexical_search.inverted_index(pa.array(["ab c"]))
    n, text, term, count = lexical_search.count_terms(pa.array(["ab xy c c", "zz"]), index)
    assert n.tolist() == [4, 1] and text.tolist() == [0, 0] and sorted(count.tolist()) == [1, 2]
