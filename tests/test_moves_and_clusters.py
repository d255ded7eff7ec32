import random

import pytest
from helpers import at, bars, bucket, candidates, starts_of, values
from pyspark.sql import functions as F

from tidemark.operators import clusters as C
from tidemark.operators import moves as M

START = bucket(at("2026-04-23 12:00:00"))


@pytest.mark.parametrize(
    ("up", "down", "direction"),
    [(3, None, "UP"), (None, 3, "DOWN"), (2, 5, "UP"), (5, 2, "DOWN"), (4, 4, "AMBIGUOUS"), (None, None, None)],
)
def test_direction_of_first_touches(spark, up, down, direction):
    frame = spark.createDataFrame([(up, down)], "u long, d long")
    assert frame.select(M.resolve_direction(F.col("u"), F.col("d"))).first()[0] == direction


def test_threshold_is_inclusive_and_uses_the_extreme_of_the_bar(spark):
    frame = bars(spark, [("a", 0, 100, 100, 100), ("a", 3, 101, 100, 100.5), ("a", 10, 120, 99, 100)])
    found = M.scan_moves(frame, 1.0, 5)
    # From bar 0: high 101 of bar 3 is exactly +1 %. Bar 10 is out of reach of bar 0 but not of itself.
    assert values(found, "direction", "start_bucket", "end_bucket", "touch_price") == [("UP", 0, 3, 101.0)]
    assert found.first().move_pct == pytest.approx(1.0)


def test_horizon_ends_at_its_last_bucket(spark):
    frame = bars(spark, [("a", 0, 100, 100, 100), ("a", 5, 102, 100, 100), ("b", 0, 100, 100, 100), ("b", 6, 102, 100, 100)])
    assert values(M.scan_moves(frame, 1.0, 5), "exchange") == [("a",)]


def test_both_ways_in_one_bar_is_ambiguous(spark):
    row = M.scan_moves(bars(spark, [("a", 0, 100, 100, 100), ("a", 1, 102, 98, 100)]), 1.0, 5).first()
    assert (row.direction, row.is_ambiguous, row.touch_price, row.move_pct) == ("AMBIGUOUS", True, None, None)


def brute_force_moves(rows, threshold, horizon):
    found = []
    for exchange, start, _, _, close in rows:
        up = down = None
        for other, at_, high, low, _ in sorted(rows, key=lambda r: r[1]):
            if other == exchange and start < at_ <= start + horizon:
                if up is None and high >= close * (1 + threshold / 100):
                    up = at_
                if down is None and low <= close * (1 - threshold / 100):
                    down = at_
        if up is not None or down is not None:
            direction = "AMBIGUOUS" if up == down else "UP" if down is None or (up is not None and up < down) else "DOWN"
            found.append((exchange, start, direction, up if direction != "DOWN" else down))
    return sorted(found)


@pytest.mark.parametrize("prefilter", [True, False])
def test_scan_equals_brute_force(spark, prefilter):
    rng = random.Random(7)
    rows = []
    for exchange in ("a", "b"):
        for at_ in sorted(rng.sample(range(-50, 250), 180)):
            close = 100 + rng.gauss(0, 1)
            rows.append((exchange, at_, close + abs(rng.gauss(0, 1)), close - abs(rng.gauss(0, 1)), close))
    found = M.scan_moves(bars(spark, rows), 2.5, 7, prefilter=prefilter)
    assert values(found, "exchange", "start_bucket", "direction", "end_bucket") == brute_force_moves(rows, 2.5, 7)


def chained(frame, horizon=60, **options):
    return C.cluster_chained(frame, horizon, **options)


def anchored(frame, horizon=60, **options):
    return C.cluster_anchored(frame, horizon, **options)


def test_the_case_that_tells_the_clusterings_apart(spark):
    frame = starts_of(spark, [0, 60, 61], START)
    assert values(chained(frame), "raw_candidate_count", "group_number") == [(3, 1)]
    assert values(anchored(frame), "raw_candidate_count", "group_number") == [(1, 2), (2, 1)]


def test_sixty_starts_in_a_row(spark):
    row = anchored(starts_of(spark, range(60), START)).first()
    assert (row.raw_candidate_count, row.candidate_group_end_bucket - START) == (60, 59)


def test_chained_across_midnight(spark):
    origin = bucket(at("2026-04-23 23:59:30"))
    events = chained(starts_of(spark, [0, 59, 121], origin)).orderBy("event_rank").collect()
    assert [e.raw_candidate_count for e in events] == [2, 1]
    assert events[0].selected_date == "20260423"
    assert events[0].candidate_group_end_bucket == bucket(at("2026-04-24 00:00:29"))
    assert [e.event_id for e in events] == ["binance_btcusdt_20260423_up_001", "binance_btcusdt_20260424_up_002"]


def test_numbers_restart_per_date_if_asked(spark):
    origin = bucket(at("2026-04-23 23:59:30"))
    events = chained(starts_of(spark, [0, 121, 300], origin), scope="date")
    assert values(events, "selected_date", "group_number") == [("20260423", 1), ("20260424", 1), ("20260424", 2)]
    with pytest.raises(ValueError):
        chained(starts_of(spark, [0]), scope="week")


@pytest.mark.parametrize("cluster", [chained, anchored])
def test_keys_do_not_mix_and_symbols_compare_lower_cased(spark, cluster):
    rows = [
        ("binance", "BTCUSDT", "UP", START, START + 1, 1.0, 2.0, 1.0),
        ("BINANCE", "btcusdt", "UP", START + 1, START + 2, 1.0, 2.0, 1.0),
        ("binance", "BTCUSDT", "DOWN", START, START + 1, 1.0, 2.0, -1.0),
        ("okx", "BTCUSDT", "UP", START, START + 1, 1.0, 2.0, 1.0),
        ("okx", "ETHUSDT", "UP", START, START + 1, 1.0, 2.0, 1.0),
    ]
    events = cluster(candidates(spark, rows))
    assert values(events, "exchange", "symbol", "direction", "raw_candidate_count") == [
        ("binance", "BTCUSDT", "DOWN", 1),
        ("binance", "BTCUSDT", "UP", 2),
        ("okx", "BTCUSDT", "UP", 1),
        ("okx", "ETHUSDT", "UP", 1),
    ]


def test_chained_keeps_the_first_of_the_strongest_moves_and_the_latest_end(spark):
    rows = [
        ("a", "S", "UP", START, START + 40, 100.0, 101.0, 1.0),
        ("a", "S", "UP", START + 5, START + 30, 90.0, 92.0, 2.0),
        ("a", "S", "UP", START + 9, START + 20, 80.0, 82.0, 2.0),
    ]
    event = chained(candidates(spark, rows)).first()
    assert (event.base_price, event.touch_price, event.move_pct) == (100.0, 92.0, 2.0)
    assert (event.event_end_bucket - START, event.duration_seconds) == (40, 40)
    first = anchored(candidates(spark, rows)).first()
    assert (first.touch_price, first.move_pct, first.event_end_bucket - START) == (101.0, 1.0, 40)


def walk(starts, horizon, anchored_rule):
    groups = []
    for start in sorted(starts):
        limit = (groups[-1][0] if anchored_rule else groups[-1][-1]) + horizon if groups else None
        if limit is None or start > limit:
            groups.append([start])
        else:
            groups[-1].append(start)
    return sorted((g[0], len(g)) for g in groups)


@pytest.mark.parametrize("chunk", [16, 40, 10_000])
@pytest.mark.parametrize("anchored_rule", [True, False])
def test_clusters_equal_a_plain_walk_whatever_the_chunk(spark, chunk, anchored_rule):
    rng = random.Random(chunk)
    # Long dense stretches, so that runs of candidates cross many chunk edges.
    starts = {"a": sorted(rng.sample(range(600), 320)), "b": list(range(-30, 90)), "c": [0, 500, 1000, 1011, 1012, 1022]}
    frame = None
    for exchange, offsets in starts.items():
        part = starts_of(spark, offsets, exchange=exchange)
        frame = part if frame is None else frame.unionByName(part)
    events = (anchored if anchored_rule else chained)(frame, 10, chunk_buckets=chunk)
    found = events.collect()
    for exchange, offsets in starts.items():
        own = sorted((e.event_start_bucket, e.raw_candidate_count, e.group_number) for e in found if e.exchange == exchange)
        assert [(start, size) for start, size, _ in own] == walk(offsets, 10, anchored_rule)
        assert [number for _, _, number in own] == list(range(1, len(own) + 1))
    assert sorted(e.event_rank for e in found) == list(range(1, len(found) + 1))


@pytest.mark.parametrize("chunk", [16, 10_000])
def test_approx_groups_counts_chained_clusters(spark, chunk):
    rng = random.Random(3)
    frame = starts_of(spark, sorted(rng.sample(range(900), 150)))
    assert M.approx_groups(frame, 10, chunk_buckets=chunk).count() == chained(frame, 10).count()


def test_ambiguous_events_are_marked_in_the_id(spark):
    frame = candidates(spark, [("a", "S", "AMBIGUOUS", START, START + 1, 100.0, None, None, True)])
    event = chained(frame, scope="date").first()
    assert event.event_id == "a_s_20260423_ambiguous_ambiguous_001"
    assert (event.touch_price, event.move_pct) == (None, None)


def test_balanced_selection_fills_up_from_the_rest(spark):
    rows = [("a", "S", "DOWN", START + i * 1000, START + i * 1000 + 1, 1.0, 1.0, -1.0) for i in range(3)]
    rows.append(("a", "S", "UP", START + 1500, START + 1501, 1.0, 1.0, 1.0))
    events = chained(candidates(spark, rows))
    assert C.balanced_select(events, 4).count() == 4
    assert values(C.balanced_select(events, 2), "direction", "event_start_bucket") == [("DOWN", START), ("UP", START + 1500)]
    note = C.balance_note(events, C.balanced_select(events, 4)).first()[0]
    assert note == "direction_balance_best_effort:available_up=1,available_down=3,selected_up=1,selected_down=3"
    assert C.balance_note(events, C.balanced_select(events, 2)).first()[0] == "balanced"


@pytest.mark.parametrize("fan", [2, 3, 128])
def test_anchored_clusters_do_not_depend_on_how_chunks_are_composed(spark, fan):
    rng = random.Random(fan)
    offsets = sorted({*rng.sample(range(2000), 500), *range(700, 760), *range(1500, 1800, 11)})
    expected = [start for start, _ in walk(offsets, 10, True)]
    found = C.cluster_anchored(starts_of(spark, offsets), 10, chunk_buckets=11, fan=fan)
    assert [r[0] for r in values(found, "event_start_bucket")] == expected


def test_one_run_of_a_hundred_thousand_chunks(spark):
    """Entries of all chunks are found level by level; the run is never gathered."""
    step, n = 4, 150_000
    rows = spark.range(n).select(
        *[F.lit(v).alias(name) for name, v in (("exchange", "a"), ("symbol", "S"), ("direction", "UP"))],
        (F.col("id") * step + F.col("id") % 3).alias("start_bucket"),
        (F.col("id") * step + 5).alias("end_bucket"),
        *[F.lit(100.0).alias(name) for name in ("base_price", "touch_price", "move_pct")],
        F.lit(False).alias("is_ambiguous"),
    )
    anchors = C._anchors(C.with_keys(rows), 5, 6, C.FAN)
    expected, last = [], None
    for start in (i * step + i % 3 for i in range(n)):
        if last is None or start > last + 5:
            expected.append(start)
            last = start
    assert expected[-1] // 6 > 99_000
    assert sorted(r.anchor for r in anchors.select("anchor").collect()) == expected


def test_anchored_clusters_of_one_long_key(spark):
    """A key with many runs, one of them longer than several chunks, against a plain walk."""
    offsets, at_ = [], 0
    for n in range(6000):
        at_ += 7 if n % 50 else 500  # runs of 50 starts
        offsets.append(at_)
    offsets += [at_ + 10_000 + 9 * n for n in range(3000)]  # one run over several chunks
    horizon, expected, last = 20, [], None
    for start in offsets:
        if last is None or start > last + horizon:
            expected.append(start)
            last = start
    found = C.cluster_anchored(starts_of(spark, offsets), horizon, chunk_buckets=4096)
    assert [r[0] for r in values(found, "event_start_bucket")] == expected
