"""Token counts, packing and chat formatting: against the library, as exact round trips, and at the edges."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from tidemark.llm import chat_format, packing, pretokens, text_stats, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("ab cdéÈ  \n\t'sstmdrevel1234.,!?- ’“中") + ["<|endoftext|>", " ", "🙂"]


def random_texts(n, seed=0, most=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(library):
    texts = [*random_texts(3000), "it's we'll 'sun ''s !'s 'S", "  a   b", "a" * 5000, None]
    counts = token_counts.count_column(pa.array(texts), PATH, token_counts.prove_whole_tokens(PATH))
    expected = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == expected


def test_proven_strings_are_one_token(library):
    whole = token_counts.prove_whole_tokens(PATH)
    for string in (" the", "ing", "a", "\n"):
        (_, _, _, (_, _, _, hashes, _)), = pretokens.split(pa.array([string]), ())
        assert (token_counts.is_in(hashes, whole)[0]) == (len(library.encode(string).ids) == 1)


def test_count_tokens_replaces_clashing_columns(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = token_counts.count_tokens(docs, PATH, limit=1).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == [
        (-1, 0, 0, False), (1, 3, 2, True), (1, 3, 2, True), (2, 0, 0, False)
    ]
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_best_fit_takes_the_tightest_window():
    windows = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(map(sorted, windows)) == [[0, 2], [1, 3, 4]]


def test_tree_finds_least_sufficient_capacity():
    rnd = random.Random(3)
    tree, open_ = packing.OpenWindows(64), []
    for number in range(2000):
        if rnd.random() < 0.6 or not open_:
            capacity = rnd.randint(1, 64)
            tree.add(capacity, number)
            open_.append(capacity)
        else:
            need = rnd.randint(1, 64)
            fitting = [c for c in open_ if c >= need]
            found = tree.take_tightest(need)
            assert (found is None) == (not fitting)
            if fitting:
                assert found[0] == min(fitting)
                open_.remove(found[0])


def check_packing(pieces, ids, window):
    """``ids``: the ids of each document by id; pieces must cover each once, sequences be gapless."""
    covered, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert np.array(part, "<u4").tobytes() == bytes(p.ids) and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for doc, spans in covered.items():
        assert sum(n for _, n in spans) == len(ids[doc]) and len({s for s, _ in spans}) == len(spans)
    padding = 0
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= window
        padding += window - end
    return padding / max(1, sum(map(len, ids.values())))


def test_packing_is_exact_and_tight(spark, library):
    rnd = random.Random(5)
    texts = {i: " ".join(rnd.choice(["alpha", "beta", "gämma", "<|endoftext|>", "qqx"]) for _ in range(rnd.randint(0, 300))) for i in range(400)}
    texts[400], texts[401] = None, "z " * 4000
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    pieces = packing.pack_documents(docs, PATH, window=128, end_id=0).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    assert {p.doc_id for p in pieces} == set(ids)
    assert check_packing(pieces, ids, 128) < 0.02


def test_packing_blocks_and_repeated_rows(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 50)
    docs = spark.createDataFrame([(7, "a b c " * 30)] * 3 + [(None, "x")], "doc_id long, text string").coalesce(1)
    pieces = packing.pack_documents(docs, PATH, window=16).collect()
    one = len(library.encode("a b c " * 30).ids) + 1
    assert sum(p.length for p in pieces if p.doc_id == 7) == 3 * one
    assert sum(p.length for p in pieces if p.doc_id is None) == 2
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


CONTROL = ["### ", "</turn>\n", "<turn>", "\\", "\\l", "#", "<", "\n", ": ", "a", "é", "=", "🙂"]


def test_chat_round_trip(spark):
    rnd = random.Random(2)

    def text():
        return "".join(rnd.choice(CONTROL) for _ in range(rnd.randint(0, 8)))

    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "System", "", text()]), text()) for c in range(60) for t in range(rnd.randint(1, 6))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    F = chat_format.F
    done = chat_format.format_conversations(turns)
    back = done.select("conv_id", "formatted", "loss", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("text"))
    expected = defaultdict(list)
    for conv, turn, role, body in sorted(rows):
        expected[conv].append((role, body))
    for row in back.collect():
        assert [(t.role, t.text) for t in row.turns] == expected[row.conv_id]
        assert row.text == "".join(body for role, body in expected[row.conv_id] if role == "assistant")
        marked = "".join(row.formatted[s.start : s.start + s.length] for s in row.loss)
        assert "<" not in marked and "#" not in marked
        assert row.formatted.count("### ") == 1 + sum(a[0] != b[0] for a, b in zip(expected[row.conv_id], expected[row.conv_id][1:]))


def test_one_conversation_of_a_hundred_thousand_turns(spark):
    """Time grows with the turns, not with their square."""
    F = chat_format.F
    n = 100_000
    turns = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t<"), F.col("id").cast("string")).alias("text"),
    )
    done = chat_format.format_conversations(turns)
    row = done.select(F.size(chat_format.read_turns(F.col("formatted"))).alias("n"), F.size("loss").alias("spans"), chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("text")).first()
    assert row.n == n and row.spans == sum(i % 3 > 0 for i in range(n))
    assert row.text == "".join(f"t<{i}" for i in range(n) if i % 3)


def test_chat_nulls_ties_and_empty_tables(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, None, None), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS name")
    found = {r.conv_id: r.formatted for r in chat_format.format_conversations(turns).collect()}
    assert found == {1: "### =: </turn>\n### User: a<turn>b</turn>\n", None: "### Assistant: x<turn>x</turn>\n"}
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_native_operators_run_no_python(spark):
    from tidemark.llm import contamination

    turns = spark.createDataFrame([(1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    words = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = words.withColumnRenamed("doc_id", "item_id")
    for df in (chat_format.format_conversations(turns), contamination.contaminated(words, items)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_counts(text):
    import re
    from collections import Counter

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)]


def test_text_counts_equal_brute_force():
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["a", "b", "é", " ", "  ", "\n", "\n", "#", "\x0b", "c d e "]) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    counts = text_stats.count_texts(pa.array([*texts, None, ""]))
    got = np.stack([counts[name] for name in text_stats.COUNTS], 1).tolist()
    assert got == [brute_counts(t) for t in [*texts, "", ""]]


def test_crc_of_ids_is_that_of_zlib(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    row = packing.pack_documents(docs, PATH).select("ids", packing.F.crc32("ids").alias("crc")).first()
    assert row.crc == zlib.crc32(bytes(row.ids))
