"""The pipeline against plain Python, row by row, on a table with planted cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from tidemark.llm import language_id

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def trigrams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    return Counter(f" {w} "[i : i + 3] for w in letters.split() for i in range(len(w)))


def vector(counts, known):
    total = np.zeros(language_id.DIMENSIONS)
    for gram, n in counts.items():
        if gram not in known:
            known[gram] = language_id.gram_vectors(np.array([[ord(c) for c in gram]]), language_id.DIMENSIONS)[0].astype(float)
        total += n * known[gram]
    return total


def by_language(rows, pipeline):
    known, profiles, taught = {}, defaultdict(lambda: np.zeros(language_id.DIMENSIONS)), Counter()
    vectors = [vector(trigrams(text or ""), known) for _, text, *_ in rows]
    for (_, text, lang, *_), v in zip(rows, vectors, strict=True):
        if text is not None and lang is not None:
            profiles[lang] += v
            taught[lang] += 1
    kept = []
    for row, v in zip(rows, vectors, strict=True):
        text = row[1]
        if text is None or not re.search(r"[^\W\d_]", text):
            continue
        cosine, lang = max((float(v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-9)), lang) for lang, p in profiles.items())
        n = len(trigrams(text))
        short, long = pipeline.SHORT_COSINE, pipeline.LONG_COSINE
        place = math.log(n / pipeline.FEW_GRAMS) / math.log(pipeline.MANY_GRAMS / pipeline.FEW_GRAMS)
        border = 0.0 if n < pipeline.FEW_GRAMS else min(long, short + (long - short) * place)
        if max(0.0, cosine) >= border * taught[lang] ** 2 / (taught[lang] ** 2 + pipeline.FAMILIAR**2):
            kept.append(row)
    return kept


def shingles(text, width=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def without_near(rows):
    sets = [shingles(row[1]) for row in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            parent[root(i)] = root(first.setdefault(row[0], i))
        for j in range(i):
            if row[0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(least.get(root(i), row[0]), row[0])
    out, seen = [], set()
    for i, row in enumerate(rows):
        if row[0] is None:
            out.append(row)
        elif row[0] == least[root(i)] and row[:2] not in seen:
            seen.add(row[:2])
            out.append(row)
    return out


def without_passages(rows, window=35):
    split = [WORD.findall(row[1]) for row in rows]
    starts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for row, words in zip(rows, split, strict=True):
        gone = {i + j for i in range(len(words) - window + 1) if starts[tuple(words[i : i + window])] > 1 for j in range(window)}
        left = [w for i, w in enumerate(words) if i not in gone]
        if not gone:
            out.append(row)
        elif left:
            out.append((row[0], " ".join(left), *row[2:]))
    return out


def without_items(rows, items):
    wanted = [s for s in (shingles(text or "") for text in items) if s]
    return [row for row in rows if not any(100 * len(shingles(row[1]) & s) >= 80 * len(s) for s in wanted)]


def test_run_equals_a_plain_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(6)
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS).collect()]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [row[1] for row in given if row[1] and len(row[1]) > 600]
    passage = " ".join(rnd.choice(texts[9].split()) for _ in range(50))
    long = max(texts, key=len)
    planted = [
        (10_001, re.sub("[a-z]", lambda m: m[0].upper(), texts[0]), "en", "s", 1),
        (10_002, f"{texts[1][:300]} {passage} {texts[2][-300:]}", "en", "s", 1),
        (10_003, f"{' '.join(texts[9].split()[-30:])} {passage}", None, None, None),
        (10_004, f"{texts[4][:200]} {items.first()['text']} {texts[5][:200]}", "en", "s", 1),
        (10_005, texts[6][:250], None, "s", 1),
        (10_005, texts[7][:250], None, "s", 1),
        (10_005, texts[7][:250], None, "t", 2),
        (10_006, " ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(200)), None, "s", 1),
        (10_007, "12 34 !!", "en", "s", 1),
        (10_008, "", "en", "s", 1),
        (10_009, None, "en", "s", None),
        (10_010, "Ünïcode word", None, None, None),
        (10_011, f"{long} {long[:2000]} ending", "en", "s", 1),
        (None, f"no id {texts[8][:200]}", None, None, None),
    ]
    rows = given + planted
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score").write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    left = by_language(rows, pipeline)
    assert {10_006, 10_007, 10_008, 10_009} & {row[0] for row in left} == set() and len(left) > 150
    left = without_items(without_passages(without_near(left)), [r.text for r in items.collect()])
    assert {10_001, 10_004} & {row[0] for row in left} == set() and {10_002, 10_003, 10_010, None} <= {row[0] for row in left}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter((row[0], len(library.encode(row[1], add_special_tokens=False).ids) + 1) for row in left)
    pieces = pipeline.run(spark, folder).collect()
    found, length = Counter(), Counter()
    for piece in pieces:
        found[(piece.doc_id, piece.doc_tokens)] += piece.start == 0
        length[(piece.doc_id, piece.doc_tokens)] += piece.length
    assert found == expected
    assert all(length[key] == n * key[1] for key, n in expected.items())
