import pytest
from helpers import values
from pyspark.sql import functions as F

from tidemark.functions import taxonomy as T
from tidemark.operators import compare as C
from tidemark.operators import contracts as X
from tidemark.operators import ranking as R
from tidemark.operators import review as V
from tidemark.operators import summaries as S


def change_profile(spark, rows):
    """(window, event, exchange, metric, from value, to value)"""
    full = [
        (w, e, "UP", x, "Sym", m, "bucket_60_30s", "bucket_30_10s", a, b, None if a is None or b is None else b - a,
         None if a in (None, 0.0) or b is None else (b - a) / abs(a))
        for w, e, x, m, a, b in rows
    ]
    return spark.createDataFrame(
        full,
        "window_id string, event_id string, direction string, exchange string, symbol string, metric_name string, from_bucket string, "
        "to_bucket string, from_bucket_value double, to_bucket_value double, absolute_change double, relative_change double",
    )


METRIC = "avg_spread_bps"


def both(spark, event, normals):
    own = change_profile(spark, [("e", "e", "a", METRIC, *event)])
    other = change_profile(spark, [(f"e__normal_{n:03d}", "e", "a", METRIC, *pair) for n, pair in enumerate(normals, 1)])
    return own, other


def test_distribution_over_controls(spark):
    own, other = both(spark, (1.0, 3.0), [(1.0, 1.0 + k) for k in (1, 2, 3, 4)] + [(1.0, None)])
    rows = {r.metric_name: r for r in C.distribution_compare(own, other, C.REPORTS["change"]).collect()}
    row = rows[f"{METRIC}.absolute_change"]
    assert (row.normal_mean, row.normal_median, row.normal_p25, row.normal_p75) == (2.5, 2.0, 1.0, 3.0)
    assert (row.normal_min, row.normal_max, row.normal_sample_count, row.normal_non_null_count) == (1.0, 4.0, 5, 4)
    assert row.normal_stddev == pytest.approx(1.2909944487358056)
    assert (row.signed_diff_vs_mean, row.absolute_diff_vs_mean, row.ratio_vs_mean, row.normal_percentile_rank) == (-0.5, 0.5, 0.8, 0.5)
    assert (row.metric_group, row.report_group, row.symbol_key) == ("signal_candidate", "bucket_change_profile", "sym")
    assert rows[f"{METRIC}.relative_change"].metric_group == "unstable"
    exact = C.distribution_compare(own, other, C.REPORTS["change"], exact=True).filter("metric_group <> 'unstable'").first()
    assert (exact.normal_median, exact.normal_p25) == (2.5, 1.75)


def test_near_zero_denominators_are_flagged(spark):
    own, other = both(spark, (0.0, 2.0), [(0.0, 0.0), (0.0, 1e-12), (0.0, -1e-12)])
    rows = {r.metric_name: r for r in C.distribution_compare(own, other, C.REPORTS["change"]).collect()}
    absolute, relative = rows[f"{METRIC}.absolute_change"], rows[f"{METRIC}.relative_change"]
    assert (absolute.normal_zero_or_near_zero_count, absolute.ratio_unstable, absolute.relative_change_unstable) == (3, True, False)
    assert (relative.event_value, relative.normal_mean, relative.normal_percentile_rank) == (None, None, None)
    assert (relative.relative_change_unstable, relative.small_denominator_flag, relative.z_score_vs_normal) == (True, True, None)


def test_equal_controls_have_no_z_score(spark):
    own, other = both(spark, (1.0, 3.0), [(1.0, 2.0)] * 3)
    row = C.distribution_compare(own, other, C.REPORTS["change"]).filter("metric_group <> 'unstable'").first()
    assert (row.normal_stddev, row.z_score_vs_normal, row.normal_percentile_rank) == (0.0, None, 1.0)


def test_single_comparison(spark):
    own, other = both(spark, (1.0, 3.0), [(1.0, 5.0)])
    row = C.single_compare(own, other, C.REPORTS["change"]).filter("metric_group <> 'unstable'").first()
    assert (row.signed_diff, row.absolute_diff, row.ratio, row.small_denominator_flag) == (-2.0, 2.0, 0.5, False)
    assert (row.event_from_bucket_value, row.normal_to_bucket_value) == (1.0, 5.0)


def test_keys_of_one_side_only(spark):
    own, other = both(spark, (1.0, 3.0), [(1.0, 5.0)])
    assert C.unmatched_keys(own, other, C.REPORTS["change"]).count() == 0
    extra = change_profile(spark, [("e", "e", "b", METRIC, 1.0, 2.0)])
    assert values(C.unmatched_keys(own.unionByName(extra), other, C.REPORTS["change"]), "exchange", "unmatched") == [("b", "event_only")]
    assert values(C.unmatched_keys(own, other.unionByName(extra), C.REPORTS["change"]), "exchange", "unmatched") == [("b", "normal_only")]


def test_missing_curated_metrics_fail(spark):
    own, other = both(spark, (1.0, 3.0), [(1.0, 5.0)])
    with pytest.raises(ValueError, match="relative_change"):
        C.single_compare(own.drop("relative_change"), other, C.REPORTS["change"])


@pytest.mark.parametrize(
    ("metric", "group"),
    [
        ("avg_book_imbalance.relative_change", "unstable"),
        ("seconds_compared", "context"),
        ("last_mid_return_bps", "price_dislocation"),
        ("avg_spread_bps.absolute_change", "signal_candidate"),
    ],
)
def test_metric_groups(spark, metric, group):
    assert spark.range(1).select(T.metric_group(F.lit(metric))).first()[0] == group


def test_unknown_metrics_raise_unless_lenient(spark):
    frame = spark.createDataFrame([("what",)], "m string")
    assert frame.select(T.metric_group(F.col("m"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="no metric group"):
        frame.select(T.metric_group(F.col("m"))).collect()


REVIEW_COLUMNS = (
    "event_id string, event_direction string, report_group string, metric_group string, metric_name string, exchange string, "
    "symbol_key string, exchange_pair string, window_mode string, window_label string, from_bucket string, to_bucket string, rank_type string, "
    "rank int, signed_diff_vs_mean double, absolute_diff_vs_mean double, z_score_vs_normal double, normal_percentile_rank double, "
    "ratio_unstable boolean, relative_change_unstable boolean, small_denominator_flag boolean"
)


def reviewed(spark, rows):
    """(event, direction, group, metric, window, rank, signed diff, risk[, pair])"""
    full = []
    for event, direction, group, metric, window, rank, signed, risk, *pair in rows:
        full.append(
            (event, direction, "exchange_profile", group, metric, None if pair else "binance", "btcusdt", pair[0] if pair else None, "trailing",
             window, None, None, "top_absolute_diff", rank, signed, abs(signed), signed * 2, 0.75, False, False, risk)
        )
    return spark.createDataFrame(full, REVIEW_COLUMNS)


def test_recurrence_within_the_top_k(spark):
    rows = [
        ("e1", "UP", T.PRICE_DISLOCATION, "last_mid_return_bps", "last_60s", 1, 2.0, False),
        ("e2", "DOWN", T.PRICE_DISLOCATION, "last_mid_return_bps", "last_60s", 2, -3.0, True),
        ("e3", "UP", T.PRICE_DISLOCATION, "last_mid_return_bps", "last_60s", 3, 1.0, False),
        ("e4", "UP", T.PRICE_DISLOCATION, "last_mid_return_bps", "last_60s", 30, -9.0, False),
    ]
    found = V.metric_recurrence(reviewed(spark, rows), top_k=20, source_event_count=F.lit(4)).collect()
    assert len(found) == 1
    row = found[0]
    assert (row.n_events_seen_in_top_k, row.n_up_events_seen, row.n_down_events_seen, row.median_rank) == (3, 2, 1, 2.0)
    assert (row.denominator_risk_event_count, row.direction_normalized_sign_consistency, row.recommendation) == (1, "positive", "diagnostic")
    assert row.median_percentile_extremeness == 0.75


def test_direction_consistency(spark):
    rows = [
        ("e1", "UP", T.SIGNAL_CANDIDATE, "trade_imbalance_qty_sum", "last_60s", 1, 2.0, False),
        ("e2", "DOWN", T.SIGNAL_CANDIDATE, "trade_imbalance_qty_sum", "last_60s", 1, -3.0, False),
        ("e3", "DOWN", T.SIGNAL_CANDIDATE, "trade_imbalance_qty_sum", "last_60s", 1, 1.0, False),
    ]
    row = V.direction_consistency(reviewed(spark, rows)).first()
    assert (row.up_positive_count, row.down_negative_count, row.down_positive_count) == (1, 1, 1)
    assert (row.observed_positive_count, row.observed_negative_count, row.direction_normalized_sign) == (2, 1, "mixed")
    assert row.sign_consistency_rate == pytest.approx(2 / 3)
    assert row.expected_sign_policy == "observed_signed"


def test_context_dominance(spark):
    rows = [
        ("e1", "UP", T.CONTEXT, "trade_count_sum", "last_60s", 1, 2.0, False),
        ("e1", "UP", T.CONTEXT, "seconds_observed", "last_60s", 2, 2.0, False),
        ("e1", "UP", T.SIGNAL_CANDIDATE, "avg_spread_bps_mean", "last_60s", 1, 2.0, False),
        ("e1", "UP", T.UNSTABLE, "avg_spread_bps.relative_change", "last_60s", 1, 2.0, False),
    ]
    row = V.context_dominance(reviewed(spark, rows), top_k=20).first()
    assert (row.context_metric_count, row.context_share, row.dominant_metric_group) == (2, 0.5, "context")
    assert row.recommended_action == "review_context_as_filter"


def test_policy_follows_one_branch(spark):
    rows = [
        ("e1", "UP", T.PRICE_DISLOCATION, "last_mid_return_bps", "last_60s", 1, 2.0, False),
        ("e1", "UP", T.CONTEXT, "trade_count_sum", "last_60s", 1, 2.0, False),
        ("e1", "UP", T.UNSTABLE, "avg_spread_bps.relative_change", "last_60s", 1, 2.0, True),
        ("e1", "UP", T.SIGNAL_CANDIDATE, "avg_spread_bps_mean", "last_60s", 1, 2.0, True),
    ]
    recurrence = V.metric_recurrence(reviewed(spark, rows), top_k=20, source_event_count=F.lit(1))
    assert values(V.metric_policy(recurrence), "metric_name", "policy_bucket", "reason", "denominator_risk_policy") == [
        ("avg_spread_bps.relative_change", "diagnostic", "unstable_or_relative_change_metric", "appendix_only"),
        ("avg_spread_bps_mean", "exclude", "denominator_risk_in_all_source_events", "exclude_primary"),
        ("last_mid_return_bps", "core_feature", "price_dislocation_candidate_seen_in_1_events", "none_observed"),
        ("trade_count_sum", "context_filter", "context_metric_for_matching_regime_or_diagnostic", "none_observed"),
    ]


def test_narrative(spark):
    rows = [
        ("e1", "UP", T.SIGNAL_CANDIDATE, "trade_imbalance_qty_sum", "last_10s", 1, 2.0, False),
        ("e1", "UP", T.PRICE_DISLOCATION, "last_mid_return_bps", "last_60s", 1, 2.0, True, "binance__okx"),
    ]
    events = spark.createDataFrame([("e1", 1, "BTC", "UP"), ("e2", 2, "BTC", "UP")], "event_id string, event_rank int, symbol string, direction string")
    events = events.withColumns({"event_start_ts": F.timestamp_micros(F.lit(0)), "event_end_ts": F.timestamp_micros(F.lit(1))})
    status = spark.createDataFrame([("e1", 10), ("e2", 3)], "event_id string, normal_selection_count long")
    found = {r.event_id: r for r in V.event_narrative(events, reviewed(spark, rows), status, controls_per_event=10).collect()}
    row = found["e1"]
    assert (row.trade_flow_pattern, row.price_return_pattern, row.book_spread_pattern) == (
        "present_rows=1",
        "present_rows=1",
        "not_observed_in_review_rows",
    )
    assert (row.dominant_exchange_pattern, row.cross_exchange_pattern, row.suspected_late_reaction_flags) == ("binance", "binance__okx", "last_10s")
    assert (row.metric_anomalies, row.normal_sample_quality) == ("denominator_risk_rows=1;unstable_rows=0", "selected_normal_count_valid")
    assert (found["e2"].dominant_exchange_pattern, found["e2"].normal_sample_quality) == ("not_observed_in_top_diffs", "review_normal_sample_count")


def test_relevance_and_proximity_labels(spark):
    frame = spark.createDataFrame(
        [("binance", None, "last_10s"), (None, "binance__okx", "last_30s"), (None, "bybit__okx", "last_300s"), ("okx", None, None)],
        "exchange string, exchange_pair string, window_label string",
    )
    rows = V.metric_relevance(frame, "Binance").collect()
    assert [r.entity_relevance for r in rows] == ["binance_exchange", "binance_pair", "non_binance_pair", "no_binance_reference"]
    assert [r.window_proximity for r in rows] == ["late_reaction", "event_proximate", "earlier", "earlier"]


def ranked(spark):
    rows = []
    for group, size in ((T.CONTEXT, 10), (T.UNSTABLE, 3)):
        for n in range(size):
            rows.append(("e1", "UP", group, f"m{n:02d}", "last_60s", 0, float(n - 5), False))
    rows.append(("e1", "UP", T.CONTEXT, "m98", "last_60s", 0, 5.0, False))
    return reviewed(spark, rows).drop("rank", "rank_type")


def test_rankings_and_their_row_formula(spark):
    top = R.rank_top_diffs(ranked(spark), 4)
    assert top.count() == X.expected_top_diff_rows([11, 3], 4) == 21
    assert X.expected_top_diff_rows([100, 3], 20) == 69
    first = top.filter("rank_type = 'top_absolute_diff' and metric_group = 'context'").orderBy("rank")
    # |-5| and |5| tie: the name decides.
    assert [r.metric_name for r in first.collect()] == ["m00", "m98", "m01", "m09"]
    lowest = top.filter("rank_type = 'top_signed_negative' and metric_group = 'context' and rank = 1").first()
    assert lowest.metric_name == "m00"
    assert S.top_diff_reconcile(ranked(spark), top, 4).count() == 0
    assert S.top_diff_reconcile(ranked(spark), top.filter("rank < 4"), 4).count() == 1


def test_nulls_rank_last(spark):
    frame = ranked(spark).withColumn("signed_diff_vs_mean", F.when(F.col("metric_name") != "m00", F.col("signed_diff_vs_mean")))
    top = R.rank_top_diffs(frame, 50).filter("metric_group = 'unstable'")
    last = top.groupBy("rank_type").agg(F.max_by("metric_name", "rank").alias("last"))
    assert values(last, "rank_type", "last") == [("top_absolute_diff", "m02"), ("top_signed_negative", "m00"), ("top_signed_positive", "m00")]


def test_flagged_rows_do_not_enter_z_and_percentile_rankings(spark):
    frame = ranked(spark).withColumn("small_denominator_flag", F.col("metric_name") == "m00")
    assert R.top_by_abs_z(frame, 1).filter("metric_group = 'context'").first().metric_name == "m98"
    assert R.top_by_extreme(frame, 1).filter("metric_group = 'context'").first().metric_name == "m01"


def test_expectations_in_one_pass(spark):
    frame = ranked(spark)
    report = X.check(
        frame,
        [
            X.expect_count(14),
            X.expect_no_null("metric_group"),
            X.expect_no_null("exchange_pair"),
            X.expect_abs_diff("signed_diff_vs_mean", "absolute_diff_vs_mean"),
            X.expect_single_row(["event_id"]),
            X.expect_single_row(["metric_group"]),
            X.expect_domain("metric_group", ["context", "unstable"]),
            X.expect_domain("metric_group", ["context", "other"]),
            X.expect_sample_count("event_id", "e1"),
        ],
    )
    assert [(r.check, r.passed, r.observed) for r in report.collect()] == [
        ("count", True, 14),
        ("no_null:metric_group", True, 0),
        ("no_null:exchange_pair", False, 14),
        ("abs_diff:absolute_diff_vs_mean", True, 0),
        ("single:event_id", True, 1),
        ("single:metric_group", False, 0),
        ("domain:metric_group", True, 0),
        ("domain:metric_group", False, 4),
        ("sample_count:event_id", True, 0),
    ]
    with pytest.raises(RuntimeError, match="no_null:exchange_pair"):
        X.raise_on_failure(report)
    X.raise_on_failure(report.filter("passed"))


def test_formulas_give_the_published_row_counts():
    assert X.expected_panel_rows(1, 3, 300) == 900
    assert X.expected_profile_rows(10, 3) == {"entity": 300, "pair": 300, "change": 480}
    assert X.expected_comparison_rows(10, 3) == {"entity": 6600, "pair": 1500, "change": 960}


def test_metadata_mismatch(spark):
    left = spark.createDataFrame([("e", 1), ("f", 1)], "id string, v int")
    right = spark.createDataFrame([("e", 1), ("g", 1)], "id string, v int")
    assert values(X.metadata_mismatches(left, right, ["id", "v"]), "id", "only_in") == [("f", "left"), ("g", "right")]


def test_status_stages(spark):
    events = spark.createDataFrame([(i, n, "UP") for n, i in enumerate("abcd", 1)], "event_id string, event_rank int, direction string")
    quality = spark.createDataFrame([("a", "missing_date"), *[(i, "quality_pass_preview") for i in "bcd"]], "event_id string, quality_reason string")
    controls = spark.createDataFrame([(i,) for i in "ccdd"], "event_id string")
    status = S.processing_status(events, quality, controls, events.filter("event_id = 'd'"))
    assert values(status, "event_id", "processing_stage", "exclusion_reason", "normal_selection_count") == [
        ("a", "event_quality_failed", "missing_date", 0),
        ("b", "normal_selection_failed", "insufficient_normal_windows", 0),
        ("c", "not_needed", None, 0),
        ("d", "selected", None, 2),
    ]
