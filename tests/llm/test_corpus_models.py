"""Language ID, quality classifier, robust rules, page text and the pipeline: held-out accuracy, brute force, edges."""

import base64
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, language_id, near_duplicates, quality_classifier, repeats, robust_rules
from tidemark.llm.html_text import Page

SF = "/root/testdata/sf0.001"


def test_gram_vectors_bind_permuted_letters():
    grams = np.array([[97, 98, 99]])
    a, b, c = (language_id.letter_vector(p, 64) for p in (97, 98, 99))
    assert (language_id.gram_vectors(grams, 64)[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()


def test_text_vectors_equal_brute_force():
    texts = ["Ab c", "", "12", "x-y zé"]
    vectors, lettered = language_id.text_vectors(texts, None, 0, 32)
    for text, vector, has in zip(texts, vectors, lettered, strict=True):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        expected = np.zeros(32)
        for word in words:
            padded = [32, *map(ord, word), 32]
            for i in range(len(padded) - 2):
                expected += language_id.gram_vectors(np.array([padded[i : i + 3]]), 32)[0]
        assert has == bool(words)
        assert (vector == expected).all()


def test_many_short_texts_are_counted_in_small_steps():
    rnd = np.random.default_rng(1)
    texts = ["".join(map(chr, rnd.integers(97, 123, 9))) for _ in range(10_000)]
    language_id.text_vectors(texts[:10], None, 0, 16)
    tracemalloc.start()
    vectors, _ = language_id.text_vectors(texts, None, 0, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # counts of 10,000 texts by 4,096 n-grams alone would be 328 MB
    few, _ = language_id.text_vectors(texts[:50], None, 0, 16)
    assert (vectors[:50] == few).all()


def test_languages_on_held_out_documents(spark):
    found = language_id.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_language_edges(spark):
    rows = [(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, None, "en"), (4, "123 !", None), (None, "the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'z' AS score", "1 AS vector")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(docs, language_id.learn_profiles(docs, F.lit(True))).collect()}
    assert got[3] == got[4] == ("und", 0.0)
    assert (got[1][0], got[2][0], got[None][0]) == ("de", "en", "en")
    nothing = language_id.learn_profiles(docs.limit(0), F.lit(True))
    assert nothing[0] == []
    assert {r.lang_pred for r in language_id.identify_languages(docs, nothing).collect()} == {"und"}
    assert language_id.identify_languages(docs.limit(0), nothing).count() == 0


def test_classifier_learns_from_positives_and_unlabelled_only():
    rnd = np.random.default_rng(0)
    n = quality_classifier.N_STATS
    good, bad = rnd.normal(0, 1, (4000, n)), rnd.normal(2, 1, (1000, n))
    model = quality_classifier.fit(good[:2000], np.concatenate([good[2000:], bad])[rnd.permutation(3000)])
    assert abs(model.prior - 2 / 3) < 0.12
    assert (model.score(good) >= 0.3).mean() > 0.97
    assert (model.score(bad) < 0.3).mean() > 0.9


def test_classifier_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    scored = quality_classifier.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = scored.filter("held_out").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    poor = [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.95
    assert np.mean(poor) <= 0.3


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, ""), (2, "")], "doc_id long, text string").selectExpr("*", "'s' AS score")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    described = quality_classifier.with_stats(docs)
    model = quality_classifier.learn(described, labels, F.lit(True))
    assert model is None
    assert [r.score for r in quality_classifier.score_texts(described, model).collect()] == [0.5] * 4
    assert quality_classifier.score_texts(described.limit(0), model).count() == 0


def brute_rules(rows, core=0.5, quantile=0.99999, steps=None, prior=50):
    """The same estimates with numpy; rows are (language, source, vector, usable)."""
    limit, factor = robust_rules.chi2_quantile(quantile, 5), robust_rules.consistency(core, 5)
    x, use = np.array([row[2] for row in rows]), np.array([row[3] for row in rows])
    members = {}
    for i, (language, source, _, usable) in enumerate(rows):
        for key in ((language, source), (language,), ()) if usable else ():
            members.setdefault(key, []).append(i)

    def lower(values, share):
        return np.sort(values)[max(0, int(np.ceil(share * len(values))) - 1)]

    def distances(values, centre, scatter):
        gaps = values - centre
        return np.einsum("ij,jk,ik->i", gaps, np.linalg.inv(scatter + np.diag(robust_rules.FLOORS)), gaps)

    state = {}
    for key, own in members.items():
        centre = np.array([lower(x[own][:, j], 0.5) for j in range(5)])
        mad = np.array([lower(np.abs(x[own][:, j] - centre[j]), 0.5) for j in range(5)])
        state[key] = (centre, np.diag((1.4826 * mad) ** 2), None)
    for step in range(robust_rules.MOST_STEPS if steps is None else steps):
        last, state = state, {}
        for key, own in members.items():
            d = distances(x[own], *last[key][:2])
            border = lower(d, core)
            central = x[own][d <= border]
            state[key] = (central.mean(axis=0), np.cov(central.T, bias=True).reshape(5, 5) * factor if len(central) > 1 else np.zeros((5, 5)), border)
        if steps is None and step and all(abs(state[k][2] - last[k][2]) <= robust_rules.SETTLED * last[k][2] for k in state):
            break
    out = np.zeros(len(rows))
    for i, (language, source, vector, _) in enumerate(rows):
        centre, scatter, _ = state[()]
        for key in ((language,), (language, source)):
            if key in state:
                own = len(members[key]) / (len(members[key]) + prior)
                centre, scatter = centre + own * (state[key][0] - centre), scatter + own * (state[key][1] - scatter)
        out[i] = distances(np.array([vector]), centre, scatter)[0]
    return out, limit


@pytest.mark.parametrize("more", [{}, {"core": 0.75, "steps": 3, "prior": 5}])
def test_robust_rules_equal_brute_force(spark, more):
    """With the query's own settings too; most groups of this table are small, and each row gets a verdict of its group."""
    # Starting medians are exact below 1,000 rows; settled estimates do not depend on them.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'" if more else "true")
    table = robust_rules.quality_rules(docs, **more).withColumns(robust_rules.features()).collect()
    rows = [(r.lang, r.source, [r[f] for f in robust_rules.FEATURES], not r.base_failed) for r in table]
    expected, limit = brute_rules(rows, **more)
    usable = [i for i, row in enumerate(rows) if row[3]]
    assert len(usable) > (150 if more else 800) and all(table[i].distance2 is not None for i in usable)
    assert np.allclose([table[i].distance2 for i in usable], expected[usable], rtol=1e-5)
    assert [r.kept for r in table] == [bool(row[3] and d <= limit) for row, d in zip(rows, expected, strict=True)]


def test_a_verdict_changes_gradually_as_a_group_grows(spark):
    """Beside a large source, the limits of a small one move towards its own rows without a jump."""
    labels = spark.createDataFrame([("g", "l")], "_group string, _language string")
    one, other = ([0.0] * 5, [0.0] * 25, 1.0), ([1.0] * 5, np.eye(5).reshape(-1).tolist(), 1.0)
    estimate = spark.createDataFrame([("g", *one), ("l", *other), ("all", *other)], "_group string, centre array<double>, scatter array<double>, _border double")
    centres = []
    for n in (1, 10, 50, 1000):
        sizes = spark.createDataFrame([("g", n), ("l", 10**9), ("all", 10**9)], "_group string, _rows long")
        centres.append(robust_rules.drawn_together(labels, estimate, sizes, 50).first().centre[0])
    assert centres == pytest.approx([50 / 51, 50 / 60, 0.5, 50 / 1050], abs=1e-6)


def test_robust_rules_reject_junk_that_fills_a_third_of_a_group(spark, tmp_path):
    rnd = np.random.default_rng(5)
    words = [f"{'abcdefgh'[i % 8] * (3 + i % 4)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(600)]

    def clean():
        return " ".join(rnd.choice(words, int(rnd.integers(80, 500)), replace=False))

    def symbols():
        return " ".join("#$%{}<>"[: int(rnd.integers(3, 7))] + rnd.choice(words)[:4] for _ in range(int(rnd.integers(80, 400))))

    one = " ".join(f"zx{i}{{}}#" for i in range(120))
    rows = []
    for source, junk in (("third", symbols), ("copies", lambda: one), ("clean", None)):
        for i in range(300):
            bad = junk is not None and i % 3 == 0
            rows.append((len(rows), junk() if bad else clean(), "en", source, bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bad boolean")
    docs.drop("bad").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id: (r.base_failed, r.kept) for r in robust_rules.op9_quality_rules(spark, str(tmp_path)).collect()}
    assert not any(base for base, _ in kept.values())
    assert [i for i, *_, bad in rows if bad and kept[i][1]] == []
    assert [i for i, *_, bad in rows if not bad and not kept[i][1]] == []


def test_robust_rules_edges(spark):
    rows = [(1, None, None, None), (2, "a " * 60, "en", None), (None, "# " * 60, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS kept", "2 AS n_words")
    got = {r.doc_id: (r.n_words, r.base_failed, r.kept, r.distance2) for r in robust_rules.quality_rules(docs).collect()}
    assert got == {1: (0, True, False, None), 2: (60, True, False, None), None: (60, True, False, None)}
    assert robust_rules.quality_rules(docs.limit(0)).count() == 0


def test_chi_squared():
    assert abs(robust_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(robust_rules.chi2_cdf(3.841459, 1) - 0.95) < 1e-6


PAGE = """<html><body class="has-sidebar"><div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header>
<div class="post-12 entry"><h2>T &amp; x</h2><p>Hello&nbsp;there <a href="x">link</a> wor<b>ld</b>.<br>next<p>two<div class="ad-slot">BUY</div>
<ul><li>i1<li>i2</ul><script>if (a < b) "<p>"</script><!-- <p>c</p> --></div><section id="comments"><p>nice post</p></section><form><p>f</p></form></body>"""


def test_page_text():
    assert Page(PAGE).text(None) == "T & x\nHello there link world. next\ntwo\ni1\ni2"
    assert Page("a < b <c").text(None) == "a < b <c"
    assert Page("").text(None) == ""
    assert Page("<p>one<p hidden>two</p><p>three").text(None) == "one\nthree"


def test_host_consensus_leads_pages_whose_own_best_differs(spark):
    body = "<div class='main-1'><p>{0}</p></div><div class='other'><p>{1}</p></div>"
    rows = [(i, "https://h.example/p", body.format("long text here " * 20, "x")) for i in range(5)]
    rows += [(9, "http://u@H.example:80/q", body.format("short", "very long other text " * 5)), (10, None, body.format("short", "very long other text")), (11, "https://h.example", None), (12, "https://h.example", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(pages).collect()}
    assert got[9] == ("short", 5)
    assert got[10][0] == "very long other text"
    assert got[11] == got[12] == ("", 0)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_page_text_keeps_what_lies_around_inner_containers():
    long = "some words of a part " * 20
    parts = "".join(f"<section><h2>Part {i}</h2><p>{long}</p></section>" for i in range(4))
    nested = Page(f"<body><article><h1>Title</h1><p>Lead.</p>{parts}</article></body>").text(None)
    assert nested.split("\n") == ["Title", "Lead.", *[line for i in range(4) for line in (f"Part {i}", long.strip())]]
    for tag in ("article", "div class=post"):
        page = f"<body><{tag}><h1>Title</h1><div class=content><p>{long}</p></div></{tag.split()[0]}></body>"
        assert Page(page).text(None).split("\n") == ["Title", long.strip()]
    cells = "".join(f"<tr><td>{long}</td><td>{i}</td></tr>" for i in range(5))
    table = Page(f"<body><article><p>Prose before.</p><table>{cells}</table><p>Prose after.</p></article></body>").text(None)
    assert table.startswith("Prose before.") and table.endswith("Prose after.") and table.count("some words") == 100
    links = "".join(f"<p><a href=x>link number {i}</a></p>" for i in range(9))
    assert Page(f"<body><div class=list>{links}</div><div class=main><p>{long}</p></div></body>").text(None) == long.strip()


def test_hosts_with_two_templates_and_a_page_with_a_short_section(spark):
    long = "some words of a part " * 20
    first = f"<body><article><p>Lead.</p><section><p>{long}</p></section><section><p>{long}</p></section></article></body>"
    second = f"<body><div class=teaser><p>{long}</p></div><div class=post><p>{long * 3}</p></div></body>"
    short = f"<body><article><p>{long}</p><section><p>Short.</p></section></article></body>"
    rows = [(i, "https://h.example/p", first) for i in range(5)] + [(i, "https://h.example/p", second) for i in range(5, 8)]
    pages = spark.createDataFrame([*rows, (8, "https://h.example/p", short)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html_text.extract_text(pages).collect()}
    assert got[0] == ["Lead.", long.strip(), long.strip()]
    assert got[5] == [(long * 3).strip()]
    assert got[8] == [long.strip(), "Short."]


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    long = " ".join(f"u{i}" for i in range(60))
    passage = " ".join(f"pass{i}" for i in range(40))
    first, second = (" ".join(f"{x}{i}" for i in range(15)) for x in ("one", "two"))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [
        (1, "the cat and the dog sat " + long, "en", "s", 9),
        (2, "the cat and the dog sat " + long, "en", "s", 9),
        (3, None, "en", "s", None),
        (4, "1234 !!", "en", "s", 7),
        (5, f"{first} {passage}", "en", "s", 9),
        (6, f"{passage} {second}", "en", "t", 9),
        (7, "so it said " + item, "en", None, 9),
        (None, "a text without an id", None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs.withColumn("_extra", F.lit(1)), SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append((name, sorted((r.doc_id or 0) for r in docs.collect())))
    assert seen == [
        ("language_id", [0, 1, 2, 5, 6, 7]),
        ("near_dedup", [0, 1, 5, 6, 7]),
        ("substring_dedup", [0, 1, 5, 6, 7]),
        ("decontamination", [0, 1, 5, 6]),
    ]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert (texts[5], texts[6], texts[None]) == (first, second, "a text without an id")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_rejects_gibberish_and_unknown_scripts_and_keeps_clean_texts(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = np.random.default_rng(3)
    scripts = {"random": "abcdefghijklmnopqrstuvwxyz", "consonants": "bcdfghjklmnpqrstvwxz"}
    scripts |= {"cyrillic": "".join(map(chr, range(0x430, 0x450))), "cjk": "".join(map(chr, range(0x4E00, 0x5500)))}
    made = [
        (f"{name}{i}", " ".join("".join(rnd.choice(list(letters), int(rnd.integers(3, 9)))) for _ in range(n)), None, None, n)
        for name, letters in scripts.items()
        for i, n in enumerate((25, 60, 200, 3000))
    ]
    made += [(f"base{i}", base64.b64encode(rnd.bytes(3 * n // 4)).decode(), None, None, n) for i, n in enumerate((200, 3000, 30000))]
    made.append(("digits", "12 34", None, None, 5))
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string")).unionByName(spark.createDataFrame(made, "doc_id string, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    assert kept & {row[0] for row in made} == set()
    letters = {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()} - {row[0] for row in made}
    assert letters - kept == set()


def test_pipeline_run_agrees_with_its_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pieces = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = near_duplicates.near_duplicates(corpus_pipeline.identify_language(spark, docs, SF))
    assert {p.doc_id for p in pieces} <= {r.doc_id for r in judged.filter("kept").collect()}
    assert repeats.repeated_words(docs).count() == docs.count()


def test_the_estimate_of_all_rows_joins_without_a_product_of_partitions(spark):
    labels = spark.createDataFrame([("g", "l")], "_group string, _language string")
    size = len(robust_rules.FEATURES)
    known = [(key, [0.0] * size, [0.0] * size**2) for key in ("g", "l", robust_rules.ALL)]
    estimate = spark.createDataFrame(known, "_group string, centre array<double>, scatter array<double>")
    sizes = spark.createDataFrame([(row[0], 10) for row in known], "_group string, _rows long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drawn = robust_rules.drawn_together(labels, estimate, sizes, 50)
        assert "CartesianProduct" not in drawn._jdf.queryExecution().executedPlan().toString()
        assert [row["_group"] for row in drawn.collect()] == ["g"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_round_takes_exact_borders_from_counts_and_sums(spark, monkeypatch):
    """Quantile sketches of many groups sort all rows in every round, and are wrong beyond their accuracy."""
    kept, write = {}, robust_rules.write_stage
    monkeypatch.setattr(robust_rules, "write_stage", lambda df, name: kept.setdefault(name, (df, write(df, name)))[1])
    text = "transform(sequence(1, 50 + cast(pow(id * 7919 % 40009, 0.6) AS int)), x -> concat('w', x * (id % 331 + 3), repeat('x', cast(id * x % 13 AS int))))"
    docs = spark.range(0, 40_000, 1, 8).selectExpr("id AS doc_id", f"array_join({text}, if(id % 3 = 0, ' ', ' # ')) AS text", "'en' AS lang", "concat('s', id % 2) AS source")
    copies = spark.range(300).selectExpr("-1 - id AS doc_id", "concat('z ', repeat('one two # ', 1), array_join(transform(sequence(1, 80), x -> 'q' || x), ' ')) AS text", "'xx' AS lang", "'c' AS source")
    robust_rules.quality_rules(docs.unionByName(copies), steps=2)
    vectors = [(r["_group"], r["_language"], [r[f] for f in robust_rules.FEATURES]) for r in kept["quality_vectors"][1].filter("NOT base_failed").collect()]
    x = np.array([row[2] for row in vectors])
    members = {}
    for i, row in enumerate(vectors):
        for key in (row[0], row[1], robust_rules.ALL):
            members.setdefault(key, []).append(i)
    for name, before in (("quality_step0", "quality_start"), ("quality_step1", "quality_step0")):
        plan = kept[name][0]._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
        last, found = ({r["_group"]: r for r in kept[stage][1].collect()} for stage in (before, name))
        assert set(found) == set(members) and len(members[robust_rules.ALL]) > 30_000
        for key, own in members.items():
            gaps = x[own] - np.array(last[key].centre)
            inverse = np.linalg.inv(np.array(last[key].scatter).reshape(5, 5) + np.diag(robust_rules.FLOORS))
            d = np.einsum("ij,jk,ik->i", gaps, inverse, gaps)
            border = np.sort(d)[(len(d) + 1) // 2 - 1]
            assert found[key]["_border"] == pytest.approx(border, rel=1e-9, abs=1e-9), (name, key)
            assert np.allclose(found[key].centre, x[own][d <= border * (1 + 1e-12) + 1e-12].mean(axis=0), rtol=1e-9, atol=1e-12)
