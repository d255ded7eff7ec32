import random

import pytest
from helpers import values
from pyspark.sql import functions as F

from tidemark.operators import controls as K

GRID = {"lookback": 30, "horizon": 6, "step": 7, "span_buckets": 200}


def bars(spark, ranges):
    rows = [(name, at) for name, (lo, hi) in ranges.items() for at in (lo, (lo + hi) // 2, hi)]
    return spark.createDataFrame(rows, "exchange string, bucket long")


def anchor_list(lo, hi, span):
    first = max(lo, span * 200) + 30
    last = min(hi, span * 200 + 200) - 6
    return list(range(first, last + 1, 7))


def test_anchors_stay_inside_the_common_range_and_their_span(spark):
    found = K.enumerate_anchors(bars(spark, {"a": (20, 700), "b": (55, 450)}), **GRID)
    expected = [(span, at) for span in range(3) for at in anchor_list(55, 450, span)]
    assert values(found, "span", "anchor_bucket") == expected
    only = K.enumerate_anchors(bars(spark, {"a": (20, 700), "b": (55, 450)}), spans=spark.createDataFrame([(1,)], "span long"), **GRID)
    assert values(only, "anchor_bucket") == [(at,) for at in anchor_list(55, 450, 1)]


def test_no_common_range_no_anchors(spark):
    assert K.enumerate_anchors(bars(spark, {"a": (0, 50), "b": (400, 900)}), **GRID).count() == 0


def anchors(spark, places):
    return spark.createDataFrame([(at,) for at in places], "anchor_bucket long")


def starts(spark, places):
    return spark.createDataFrame([(at,) for at in places], "start_bucket long")


@pytest.mark.parametrize(
    ("start", "proximity", "horizon", "lookback", "reason"),
    [
        (11_700, 1800, 60, 300, "candidate_within_anchor_proximity"),
        (10_030, 10, 60, 300, "candidate_inside_post_anchor_horizon"),
        (9_800, 10, 60, 300, "candidate_inside_normal_window"),
        (10_000, 0, 60, 300, "candidate_within_anchor_proximity"),
        (10_061, 10, 60, 300, None),
        (9_699, 10, 60, 300, None),
    ],
)
def test_exclusion_ladder(spark, start, proximity, horizon, lookback, reason):
    found = K.anchor_exclusion(
        anchors(spark, [10_000]), starts(spark, [start]), lookback=lookback, horizon=horizon, proximity=proximity, span_buckets=86_400
    )
    assert found.first().exclusion_reason == reason


def test_nearest_distance_with_and_without_candidates(spark):
    found = K.nearest_event_distance(anchors(spark, [10_000]), starts(spark, [8_000, 14_000]), 86_400)
    assert found.first().nearest_candidate_distance == 2000
    assert K.nearest_event_distance(anchors(spark, [10_000]), starts(spark, []), 86_400).first().nearest_candidate_distance is None


@pytest.mark.parametrize("span", [10, 100, 100_000])
def test_nearest_distance_crosses_spans(spark, span):
    rng = random.Random(span)
    places, marks = rng.sample(range(1000), 60), rng.sample(range(200, 800), 15)
    found = K.nearest_event_distance(anchors(spark, places), starts(spark, marks + marks[:3]), span)
    expected = sorted(
        (at, max((m for m in marks if m <= at), default=None), min((m for m in marks if m >= at), default=None), min(abs(m - at) for m in marks))
        for at in places
    )
    got = [tuple(r) for r in found.select("anchor_bucket", "previous_start", "next_start", "nearest_candidate_distance").collect()]
    assert sorted(got) == expected


def market(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for exchange in ("a", "b"):
        for at in range(0, 420):
            if rng.random() < 0.5:
                rows.append((exchange, rng.choice("xy"), at, rng.randrange(3), float(rng.randrange(5)), float(rng.randrange(50)), rng.randrange(3)))
    # A bucket has a trade or a quote, or no row; sums are null where nothing traded.
    rows = [r if r[3] else (*r[:4], None, None, r[6]) for r in rows if r[3] or r[6]]
    schema = "exchange string, symbol string, bucket long, trade_count long, trade_volume double, trade_notional double, bbo_update_count long"
    return spark.createDataFrame(rows, schema), rows


@pytest.mark.parametrize(("lookback", "step"), [(30, 6), (30, 7), (5, 12), (30, 45)])
def test_slots_sum_like_a_range_join(spark, lookback, step):
    frame, rows = market(spark)
    grid = {"lookback": lookback, "horizon": 6, "step": step, "span_buckets": 200}
    ends = bars(spark, {"a": (3, 415), "b": (0, 410)})
    activity = K.anchor_activity(frame, ends, exchanges=("A", "b"), **grid)
    expected = {}
    for anchor in K.enumerate_anchors(ends, **grid).collect():
        for exchange, symbol, at, n, volume, _, quotes in rows:
            if anchor.anchor_bucket - lookback <= at < anchor.anchor_bucket:
                key = (anchor.anchor_bucket, exchange, symbol)
                old = expected.get(key, (0, 0.0, 0))
                expected[key] = (old[0] + n, old[1] + (volume or 0.0), old[2] + quotes)
    got = {
        (r.anchor_bucket, r.exchange, r.symbol): (r.trade_count_sum, r.trade_volume_sum, r.quote_count_sum) for r in activity.collect()
    }
    assert got == expected


def test_window_quality_ladder(spark):
    activity = spark.createDataFrame(
        [
            (1, "a", "x", 5, 5),
            (1, "b", "x", 5, 5),
            (2, "a", "x", 0, 5),
            (3, "a", "x", 5, 0),
            (4, "a", "x", 5, 5),
            (4, "b", "x", 0, 5),
            (5, "a", "x", 5, 5),
            (5, "b", "x", 5, 0),
            (6, "a", "x", 5, 5),
            (6, "b", "x", 5, 5),
            (6, "b", "y", 1, 0),
        ],
        "anchor_bucket long, exchange string, symbol string, trade_count_sum long, quote_count_sum long",
    )
    rated = K.window_quality(anchors(spark, range(1, 8)), activity, expected_exchanges=2, lookback=10)
    assert [tuple(r) for r in rated.orderBy("anchor_bucket").select("quality_failure", "snapshot_row_count").collect()] == [
        (None, 20),
        ("trade_count_zero", 10),
        ("bbo_count_zero", 10),
        ("trade_exchange_coverage", 20),
        ("bbo_exchange_coverage", 20),
        ("snapshot_row_count", 30),
        ("trade_count_zero", 0),
    ]


def candidates(spark, rows):
    return spark.createDataFrame(
        [("e", *row) for row in rows], "event_id string, anchor_bucket long, activity_distance double, nearest_candidate_distance long"
    )


def test_spaced_selection_prefers_near_activity_then_remoteness(spark):
    rows = [(7200, 0.2, 9999), (3600, 0.1, 2000), (10_800, 0.1, 5000)]
    found = K.spaced_select(candidates(spark, rows), count=2, spacing=1800)
    assert [tuple(r) for r in found.orderBy("sample_rank").select("sample_rank", "anchor_bucket", "nearest_candidate_distance").collect()] == [
        (1, 10_800, 5000),
        (2, 3600, 2000),
    ]


def test_spacing_is_exclusive_and_absent_remoteness_comes_last(spark):
    rows = [(0, 0.1, 1), (1799, 0.2, 1), (1800, 0.3, 1)]
    assert values(K.spaced_select(candidates(spark, rows), count=10, spacing=1800), "anchor_bucket") == [(0,), (1800,)]
    rows = [(0, 0.1, None), (5000, 0.1, 0)]
    found = K.spaced_select(candidates(spark, rows), count=10, spacing=10).orderBy("sample_rank").collect()
    assert [(r.anchor_bucket, r.nearest_candidate_distance) for r in found] == [(5000, 0), (0, None)]


def test_greedy_selection_equals_a_plain_walk(spark):
    rng = random.Random(5)
    rows = [(at, rng.randrange(20) / 10, rng.randrange(4)) for at in rng.sample(range(2000), 150)]
    kept = []
    for at, _, _ in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        if len(kept) < 8 and all(abs(at - other) >= 90 for other in kept):
            kept.append(at)
    found = K.spaced_select(candidates(spark, rows), count=8, spacing=90).orderBy("sample_rank")
    assert [r.anchor_bucket for r in found.collect()] == kept


def activity(spark, key, rows):
    return spark.createDataFrame(rows, f"{key}, exchange string, trade_count_sum long, trade_volume_sum double, trade_notional_sum double")


def test_equal_activity_has_distance_zero_and_missing_venues_drop_out(spark):
    events = spark.createDataFrame([("e", 0)], "event_id string, span long")
    own = activity(spark, "event_id string", [("e", v, 10, 10.0, 10.0) for v in "abc"])
    rows = [(0, 50, v, 10, 10.0, 10.0) for v in "abc"] + [(0, 60, v, 0, 10.0, 10.0) for v in "abc"] + [(0, 70, v, 10, 10.0, 10.0) for v in "ab"]
    sums = activity(spark, "span long, anchor_bucket long", rows)
    places = spark.createDataFrame([(0, at, 5) for at in (50, 60, 70)], "span long, anchor_bucket long, nearest_candidate_distance long")
    found = K.activity_distance(events, own, places, sums, 3)
    got = {r.anchor_bucket: r.activity_distance for r in found.collect()}
    assert set(got) == {50, 60} and got[50] == 0.0 and got[60] == pytest.approx(2.3978952727983707 / 3)


def test_events_short_of_controls_get_none(spark):
    events = spark.createDataFrame([("e", 0), ("f", 1)], "event_id string, span long")
    own = activity(spark, "event_id string", [(e, "a", 10, 10.0, 10.0) for e in "ef"])
    places = [(0, 50), (0, 90), (1, 250)]
    sums = activity(spark, "span long, anchor_bucket long", [(s, at, "a", 9, 9.0, 9.0) for s, at in places])
    rated = spark.createDataFrame([(s, at, 5) for s, at in places], "span long, anchor_bucket long, nearest_candidate_distance long")
    rated = rated.withColumns({"exclusion_reason": F.lit(None).cast("string"), "quality_failure": F.lit(None).cast("string")})
    found = K.match_controls(events, own, rated, sums, exchanges=1, count=2, spacing=10)
    assert values(found, "event_id", "sample_id", "anchor_bucket") == [("e", "e__normal_001", 50), ("e", "e__normal_002", 90)]


@pytest.mark.parametrize("block,first,spacing", [(4, 1, 7), (8, 2, 40), (64, 4, 7), (4, 1, 10_000)])
def test_best_first_search_picks_what_the_full_table_does(spark, block, first, spacing):
    """Ties, anchors without a nearest candidate, venues that are absent, spans of different size, events without activity."""
    rnd = random.Random(block + spacing)
    venues = ("a", "b")

    def activity():
        return [(venue, rnd.randint(1, 40), float(rnd.randint(1, 5)), float(rnd.choice([1, 10, 1000]))) for venue in venues]

    sizes = {0: 150, 1: 30, 2: 3}
    places = [(span, span * 1000 + 3 * i, rnd.choice([None, 5, 5, 90])) for span, n in sizes.items() for i in range(n)]
    sums = [(span, anchor, *row) for span, anchor, _ in places for row in activity()[: 1 if rnd.random() < 0.05 else 2]]
    events = [(f"e{i}", rnd.choice([0, 0, 1, 2, 3])) for i in range(40)]
    own = [(event, *row) for event, _ in events[1:] for row in activity()]
    measures = "exchange string, trade_count_sum long, trade_volume_sum double, trade_notional_sum double"
    tables = (
        spark.createDataFrame(events, "event_id string, span long"),
        spark.createDataFrame(own, f"event_id string, {measures}"),
        spark.createDataFrame(places, "span long, anchor_bucket long, nearest_candidate_distance long"),
        spark.createDataFrame(sums, f"span long, anchor_bucket long, {measures}"),
    )
    expected = K.spaced_select(K.activity_distance(*tables, 2), count=4, spacing=spacing)
    found = K.nearest_controls(*tables, exchanges=2, count=4, spacing=spacing, block=block, first_blocks=first)
    columns = ["event_id", "sample_rank", "anchor_bucket", "activity_distance", "nearest_candidate_distance"]
    assert values(found, *columns) == values(expected, *columns)
    if spacing == 7 and block == 4:
        pairs = {r.event_id: r.pairs for r in found.collect() if dict(events)[r.event_id] == 0}
        assert sum(pairs.values()) / len(pairs) < sizes[0] / 2


def test_hot_spans_get_copies_of_their_anchors(spark, monkeypatch):
    monkeypatch.setattr(K, "EVENTS_PER_COPY", 3)
    events = spark.createDataFrame([(f"e{i}", 0) for i in range(10)] + [("x", 1)], "event_id string, span long")
    dealt, per_span = K._spread(events)
    assert values(per_span, "span", "_copies") == [(0, 4), (1, 1)]
    assert K._copied(spark.createDataFrame([(0, "r"), (1, "s")], "span long, r string"), per_span).count() == 5
    assert {r["_copy"] for r in dealt.collect()} <= set(range(4))
