"""Fill-in-middle by piece tables: against plain string code, round trips, and the edges."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import piece_table
from tidemark.llm.textarrays import texts_of

SCHEMA = "doc_id long, text string"
PARTS = ["ab", "Z", " ", "\n", "é", "🙂", "<P>", "<", ">", "<S", "P>", "M", "<M>", "1", "中", "İ", "K"]


def plainly(doc_id, text, fim=90, spm=20, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts(n, seed, most=12):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_outputs_equal_plain_code_and_are_restored(spark):
    texts = [*some_texts(700, 4), None, "", "word " * 60_000, "é" * 50_000, "<P", "<S><M>"]
    rows = [*((i - 3, text) for i, text in enumerate(texts)), (None, "no id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = piece_table.restore(piece_table.fill_in_middle(docs, fim_percent=80, spm_percent=40, seed=7)).collect()
    assert len(found) == len(rows) and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, r.text, 80, 40, 7)
        assert r.restored == (r.text or "")
        assert r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        sources = ((r.text or "").encode(), piece_table.SENTINELS)
        assert b"".join(sources[p.buffer][p.start : p.start + p.length] for p in r.pieces).decode() == r.output


@pytest.mark.parametrize("form", list(piece_table.ARRANGEMENTS))
def test_inverse_permutation(form):
    order = piece_table.ARRANGEMENTS[form]
    table = np.arange(6)[None, :]
    there = piece_table.arranged(order, table, table, table)
    assert (piece_table.arranged(piece_table.inverse(order), *there)[0] == table).all()


def test_slices_do_not_leak_into_each_other():
    """Units, sentinels and cuts end where a text ends, whatever stands before and after it."""
    texts = ["ab", "cd", "<", "P>", "", "x<", "M>"]
    h = np.tile(np.array([[10**9 + 7, 12345, 0, 99]]), (len(texts), 1))
    made = piece_table.cut_and_arrange(texts_of(pa.array(texts)), h, 90, 20)
    for i, text in enumerate(texts):
        alone = piece_table.cut_and_arrange(texts_of(pa.array([text])), h[:1], 90, 20)
        assert [column[i].as_py() for column in made] == [column[0].as_py() for column in alone]


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], SCHEMA).selectExpr("*", "'x' AS form", "1.5D AS n", "'y' AS restored", "array(1) AS tags")
    out = piece_table.restore(piece_table.fill_in_middle(docs))
    row = out.first()
    assert (row.n, row.form) == plainly(1, "a b c")[:2] and row.restored == "a b c" and row.tags == [1]
    assert piece_table.restore(piece_table.fill_in_middle(docs.limit(0))).count() == 0


def test_broken_outputs_are_refused():
    for output, form in (("<P>a<S>b", "psm"), ("<S>a<P>b<M>c", "psm"), ("x<P>a<S>b<M>c", "psm"), ("a", "other")):
        with pytest.raises(ValueError):
            piece_table.inverted(texts_of(pa.array([output])), np.array([form], dtype=object))
