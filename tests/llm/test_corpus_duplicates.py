"""Substring dedup, near-duplicates, components and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tidemark.llm import components, contamination, near_duplicates, repeats, textarrays

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passages(seed, n=60, vocabulary=3):
    """Texts of a small vocabulary with shared passages, periodic stretches, copies and short ones."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [[rnd.choice(words) for _ in range(rnd.randint(8, 60))] for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            parts += rnd.choice([rnd.choice(shared), [rnd.choice("abc")] * rnd.randint(1, 30), ["x", "y"] * rnd.randint(1, 15), [rnd.choice(words) for _ in range(10)]])
        texts.append(rnd.choice([" ", "  ", "\n"]).join(parts))
    return texts + texts[:3] + ["", None, " \n", "é é é", "A a A a"]


def kept_words(texts, window):
    split = [WORD.findall(t or "") for t in texts]
    starts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for words in split:
        gone = {i + j for i in range(len(words) - window + 1) if starts[tuple(words[i : i + window])] > 1 for j in range(window)}
        out.append(([w for i, w in enumerate(words) if i not in gone], len(words)))
    return out


@pytest.mark.parametrize(("window", "most"), [(12, 1000), (12, 3), (35, 1000), (9, 2)])
def test_repeated_words_equal_brute_force(spark, monkeypatch, window, most):
    monkeypatch.setattr(repeats, "GROUP_MOST", most)
    texts = passages(window + most)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.repeated_words(docs, window).collect()}
    for i, (kept, n) in enumerate(kept_words(texts, window)):
        assert got[i] == (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()), texts[i]


def test_texts_without_repeats(spark):
    long = " ".join(f"u{i}" for i in range(40))
    rows = [(1, long, 5), (None, "a  b", 6), (None, None, 7), (2, long + " tail", 8), (3, "x " * 50, 9), (3, "x " * 50, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "1 AS d1", "'q' AS kept_sha256")
    out = repeats.without_repeats(docs, 35)
    assert out.columns == [*docs.columns, "emptied"]
    got = sorted(((r.doc_id, r.text, r.n_chars, r.emptied) for r in out.collect()), key=repr)
    assert got == sorted([(1, "", 0, True), (None, "a  b", 6, False), (None, None, 7, False), (2, "tail", 4, False), (3, "", 0, True), (3, "", 0, True)], key=repr)
    assert repeats.without_repeats(docs.limit(0), 35).count() == 0


def sets_of(texts, width):
    out = []
    for text in texts:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        out.append(runs or ({tuple(words)} if words else set()))
    return out


def edited(seed, n=150):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 120))] for _ in range(12)]
    texts = []
    for _ in range(n):
        copy = list(rnd.choice(base))
        for _ in range(rnd.randint(0, max(1, len(copy) // 12))):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        texts.append(" ".join(w.upper() if rnd.random() < 0.1 else w for w in copy))
    return [*texts, "", None, "one", "ONE", " "]


@pytest.mark.parametrize(("width", "listed", "block"), [(2, 1024, 250_000), (5, 1024, 250_000), (2, 0, 200)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, listed, block):
    monkeypatch.setattr(near_duplicates, "LISTED_MOST", listed)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", block)
    texts = edited(width)
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = sets_of(texts, width)
    least = {100 - i: 100 - i for i in range(len(texts))}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root(100 - i), root(100 - j)
                least[max(x, y)] = min(x, y)
    for row in near_duplicates.near_duplicates(docs, width).collect():
        assert (row.component_id, row.n_shingles) == (root(row.doc_id), len(sets[100 - row.doc_id]))
        assert row.kept == (row.component_id == row.doc_id)


def test_near_duplicates_edges(spark):
    long = " ".join(f"v{i}" for i in range(30))
    rows = [(5, long), (5, "p q r"), (3, "p q r"), (None, long), (9, long), (9, long), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS component_id", "1 AS kept")
    got = sorted({(r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates.near_duplicates(docs).collect()})
    # Document 5 has two texts: it ties 3 and 9 together. The row without an id is in no component.
    assert got == [(0, 0, True), (1, 1, True), (3, 3, True), (5, 3, False), (9, 3, False)]
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_pairs_within_the_guaranteed_distance_share_a_key(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    size = near_duplicates.SYMBOLS
    base = rnd.integers(0, 1 << near_duplicates.BITS, size).astype(np.uint16)
    rows = [(0, base.tobytes())]
    for i in range(1, 200):
        other = base.copy()
        other[rnd.choice(size, 2 * near_duplicates.CHUNKS - 1, replace=False)] ^= 1
        rows.append((i, other.tobytes()))
    keys = near_duplicates.bucket_keys(spark.createDataFrame(rows, "node long, symbols binary")).collect()
    own = {k.key for k in keys if k.node == 0}
    assert {k.node for k in keys if k.key in own} == set(range(200))


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(rnd.randrange(400, 700), rnd.randrange(400, 700)) for _ in range(150)] + [(9, 9)]
    least = list(range(701))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        least[max(x, y)] = min(x, y)
    found = components.components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()
    tied = {r.node: r.component for r in found if r.node != r.component}
    assert tied == {x: root(x) for x in range(701) if root(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_contamination_equals_brute_force(spark):
    rnd = random.Random(8)
    words = [f"t{i}" for i in range(50)]
    items = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(25)]
    docs = []
    for _ in range(120):
        parts = [rnd.choice(words) for _ in range(rnd.randint(0, 300))]
        if rnd.random() < 0.6:
            planted = rnd.choice(items).upper().split()
            for _ in range(rnd.randint(0, 2)):
                planted[rnd.randrange(len(planted))] = "CHANGED"
            at = rnd.randint(0, len(parts))
            parts = parts[:at] + planted + parts[at:]
        docs.append("\t".join(parts))
    docs += [items[0], "", None, "t1 t2"]
    items += ["T1  t2", "", None]
    d = spark.createDataFrame([*enumerate(docs), (None, items[1]), (0, docs[0])], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS hash")
    b = spark.createDataFrame([*enumerate(items), (3, items[3])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in contamination.contaminated(d, b).collect()}
    left, right = sets_of(docs, 5), sets_of(items, 5)
    expected = {(i, j): (len(x & y), len(y)) for i, x in enumerate(left) for j, y in enumerate(right) if y and 100 * len(x & y) >= 80 * len(y)}
    assert {k: v for k, v in got.items() if k[0] is not None} == expected
    assert (None, 1) in got
    assert contamination.contaminated(d.limit(0), b).count() == 0 == contamination.contaminated(d, b.limit(0)).count()


def test_contamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", 0)
    d = spark.createDataFrame([(1, "x a b c d e f y"), (2, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a b c d e f")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_shared) for r in contamination.contaminated(d, b).collect()] == [(1, 7, 2)]


def test_items_without_an_id_or_of_one_id_are_all_found(spark):
    """Each row of the benchmark is an item of its own, in the operator and in the SQL."""
    import duckdb

    a, b, c = ("a1 a2 a3 a4 a5 a6 a7", "b1 b2 b3 b4 b5 b6 b7 b8", "c1 c2 c3 c4 c5 c6")
    rows, wanted = [(1, f"x {a} y"), (2, f"{b} z"), (3, c), (4, f"{a} {b} {c}")], [(None, a), (7, b), (7, c), (7, c), (None, None)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(wanted, "item_id long, text string")
    found = contamination.contaminated(docs, items)
    assert sorted((r.doc_id, r.item_id or 0, r.n_item) for r in found.collect()) == [(1, 0, 3), (2, 7, 4), (3, 7, 2), (4, 0, 3), (4, 7, 2), (4, 7, 4)]
    con = duckdb.connect()
    for name, columns, listed in (("documents", "doc_id BIGINT, text VARCHAR", rows), ("benchmark", "item_id BIGINT, text VARCHAR", wanted)):
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", listed)
    told = con.execute(f"SELECT doc_id, coalesce(item_id, 0), n_item FROM ({contamination.OP2_SQL}) ORDER BY ALL").fetchall()
    assert told == [(1, 0, 3), (2, 7, 4), (3, 7, 2), (4, 0, 3), (4, 7, 2), (4, 7, 4)]


def test_texts_of_pairs_travel_compressed_and_empty_ones_link_nothing(spark):
    rnd = random.Random(8)
    words = [" ".join(rnd.choice(["ash", "birch", "cedar", "elm", "fir"]) + str(rnd.randint(0, 400)) for _ in range(600)) for _ in range(2)]
    docs = spark.createDataFrame([(1, words[0]), (2, words[0] + " x"), (3, words[1]), (4, None), (5, "")], "doc_id long, text string")
    texts = near_duplicates.texts_of_nodes(docs, docs.select("doc_id")).toArrow().combine_chunks()
    sent = {i: raw for i, raw in zip(texts["doc_id"].to_pylist(), texts["packed"].to_pylist(), strict=True)}
    assert sum(map(len, sent.values())) < 0.6 * sum(texts["size"].to_pylist())
    read = textarrays.unpacked(texts["packed"].combine_chunks())
    assert dict(zip(texts["doc_id"].to_pylist(), read.to_pylist(), strict=True)) == {1: words[0], 2: words[0] + " x", 3: words[1], 4: "", 5: ""}
    pairs = spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "a long, b long")
    links = near_duplicates.confirmed(pairs, near_duplicates.texts_of_nodes(docs, docs.select("doc_id")), 5, 80)
    assert [tuple(r) for r in links.collect()] == [(2, 1)]


def test_a_worker_keeps_the_objects_of_one_operator():
    textarrays.worker_cache("languages")["table"] = 1
    textarrays.worker_cache()["powers"] = 2
    assert textarrays.worker_cache() == {"powers": 2}
    assert textarrays.worker_cache("languages") == {}
