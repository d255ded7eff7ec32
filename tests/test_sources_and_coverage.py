import json
import os

import pytest
from helpers import at, bucket, candidates, values
from pyspark.sql import functions as F

from tidemark.operators import coverage as V
from tidemark.operators import quality as Q
from tidemark.operators.bars import clean_ticks
from tidemark.operators.clusters import cluster_chained
from tidemark.plans.coverage_probe import probe_coverage
from tidemark.plans.event_map import Detector
from tidemark.sources import catalog as K
from tidemark.sources import scans, sinks, stages

NAMES = ("binance", "bybit", "okx")


def manifest(tmp_path, document):
    path = tmp_path / "manifest.json"
    path.write_text(document if isinstance(document, str) else json.dumps(document))
    return str(path)


def test_manifest_rows(spark, tmp_path):
    key = "exchange=binance/stream=bbo/symbol=btcusdt/date=20260425/data.parquet"
    streams = {
        "bbo": {"symbols": {"btcusdt": {"available": True, "artifacts": {"data_key": key, "meta_key": "m/meta.json"}}}},
        "trade": {"symbols": {"btcusdt": {"available": False}}},
    }
    document = {"schema_version": 1, "dates": {"20260425": {"exchanges": {"binance": {"streams": streams}}}}}
    rows = K.read_catalog(spark, manifest(tmp_path, document)).orderBy("stream").collect()
    assert [(r.date, r.exchange, r.stream, r.symbol, r.available, r.data_key, r.quality_day_key) for r in rows] == [
        ("20260425", "binance", "bbo", "btcusdt", True, key, None),
        ("20260425", "binance", "trade", "btcusdt", False, None, None),
    ]


@pytest.mark.parametrize("text", ["   \n", "{not json"])
def test_broken_manifests_raise(spark, tmp_path, text):
    with pytest.raises(Exception, match="manifest is"):
        K.read_catalog(spark, manifest(tmp_path, text)).collect()


def test_partition_from_path(spark):
    frame = spark.createDataFrame(
        [("s3://b/x/exchange=okx/stream=trade/symbol=BTC/date=20260423/data.parquet",), ("exchange=a/stream=b/symbol=c/date=d",), ("nowhere/at=all",)],
        "path string",
    )
    assert values(K.partition_from_path(frame), "exchange", "stream", "symbol", "date") == [("a", "b", "c", "d"), ("okx", "trade", "BTC", "20260423")]


def catalog(spark, rows):
    return spark.createDataFrame(rows, "date string, exchange string, stream string, symbol string, available boolean")


def test_select_partitions(spark):
    rows = [
        ("20260423", "Binance", "trade", "BTCUSDT", True),
        ("20260423", "bybit", "trade", "BTCUSDT", None),
        ("20260423", "okx", "trade", "BTCUSDT", False),
        ("20260423", "okx", "trade", "ETHUSDT", True),
        ("20260423", "okx", "bbo", "BTCUSDT", True),
        ("20260423", "other", "trade", "BTCUSDT", True),
        ("20260425", "okx", "trade", "BTCUSDT", True),
    ]
    frame = catalog(spark, rows)
    picked = K.select_partitions(frame, exchanges=NAMES, symbol_family="btc", dates=["20260423"])
    assert values(picked, "exchange", "symbol") == [("Binance", "BTCUSDT"), ("bybit", "BTCUSDT")]
    ranged = K.select_partitions(frame, exchanges=NAMES, symbol_family="btc", first_date="20260424", last_date="20260430")
    assert values(K.catalog_dates(ranged), "date") == [("20260425",)]
    assert values(K.requested_dates(frame.select("date")), "date") == [("20260423",), ("20260424",), ("20260425",)]
    assert values(K.requested_dates(frame.select("date"), "20260422"), "date")[0] == ("20260422",)
    with pytest.raises(Exception, match="before first"):
        K.requested_dates(frame.select("date"), "20260430", "20260401").collect()


def coverage_rows(dates):
    return [(date, name, "trade", "BTC", True) for date, names in dates.items() for name in names]


@pytest.mark.parametrize(
    ("dates", "best"),
    [
        ({"20260424": NAMES, "20260425": NAMES[:2]}, "20260424"),
        ({"20260424": NAMES[:2], "20260425": NAMES[1:]}, "20260425"),
        ({"20260424": NAMES[:1]}, None),
    ],
)
def test_best_date(spark, dates, best):
    table = V.coverage_table(catalog(spark, coverage_rows(dates)), NAMES)
    found = V.best_date(table, len(NAMES)).first()
    assert (found.date if found else None) == best


def test_coverage_sets(spark):
    frame = catalog(spark, coverage_rows({"20260424": ("okx", "BINANCE", "else")}))
    row = V.coverage_table(frame, NAMES).first()
    assert (row.present_exchanges, row.missing_exchanges, row.coverage_count) == (["binance", "okx"], ["bybit"], 2)
    strict, partial = (V.exchange_coverage(frame, NAMES, ["date"], strict=s).first().covered for s in (True, False))
    assert (strict, partial) == (False, True)


def full(date):
    return [(date, name, stream, "BTC", True) for name in NAMES for stream in ("trade", "bbo")]


def diagnostics(spark, partitions, dates, everything=None):
    family = catalog(spark, partitions)
    requested = spark.createDataFrame([(d,) for d in dates], "date string")
    return V.coverage_diagnostics(requested, catalog(spark, everything or partitions), family, NAMES)


def test_diagnostics_name_what_is_missing(spark):
    partitions = [*full("20260422"), ("20260423", "okx", "trade", "BTC", True)]
    everything = [*partitions, ("20260424", "okx", "trade", "ETH", True)]
    rows = diagnostics(spark, partitions, ["20260422", "20260423", "20260424", "20260425"], everything).orderBy("date").collect()
    assert [r.missing_reasons for r in rows] == [
        "",
        "missing_binance_trade;missing_binance_bbo;missing_bybit_trade;missing_bybit_bbo;missing_okx_bbo",
        "date_missing_family_streams",
        "date_missing_all_streams",
    ]
    assert [(r.has_full_trade_bbo_coverage, r.event_scan_possible, r.trade_coverage_count) for r in rows[:2]] == [(True, True, 3), (False, True, 1)]


def events(spark, *moves, scope="date"):
    rows = [("binance", "BTC", d, bucket(at(t)), bucket(at(t)) + 1, 1.0, 1.0, 1.0, d == "AMBIGUOUS") for d, t in moves]
    return cluster_chained(candidates(spark, rows), 60, scope=scope)


def test_event_quality_ladder(spark):
    found = events(spark, ("UP", "2026-04-23 00:02:00"), ("DOWN", "2026-04-23 12:00:00"), ("UP", "2026-04-25 12:00:00"), ("AMBIGUOUS", "2026-04-23 13:00:00"), ("UP", "2026-04-24 12:00:00"))
    partitions = [*full("20260423"), *[p for p in full("20260424") if p[2] == "trade"]]
    quality = V.event_quality(found, diagnostics(spark, partitions, ["20260423", "20260424"]), lookback=300)
    rows = {(r.selected_date, r.direction, r.quality_reason): r for r in quality.collect()}
    assert set(rows) == {
        ("20260423", "UP", "pre_window_partition_missing"),
        ("20260423", "DOWN", "quality_pass_preview"),
        ("20260425", "UP", "missing_date"),
        ("20260423", "AMBIGUOUS", "ambiguous_event"),
        ("20260424", "UP", "missing_bbo_coverage"),
    }
    assert rows["20260423", "UP", "pre_window_partition_missing"].pre_window_partition_dates == "20260422,20260423"


@pytest.mark.parametrize(
    ("moves", "covered", "status"),
    [
        ((("UP", "2026-04-23 01:00:00"),), False, "no_event_scan_possible"),
        ((("UP", "2026-04-24 01:00:00"),), True, "no_quality_preview_events"),
        ((("UP", "2026-04-23 01:00:00"),), True, "weak_multi_event_coverage"),
        ((("UP", "2026-04-23 01:00:00"), ("UP", "2026-04-23 03:00:00")), True, "direction_imbalanced"),
        ((("UP", "2026-04-23 01:00:00"), ("DOWN", "2026-04-23 03:00:00")), True, "ready_for_phase3a_trial"),
    ],
)
def test_scope_status(spark, moves, covered, status):
    partitions = full("20260423") if covered else [("20260423", "binance", "bbo", "BTC", True)]
    cover = diagnostics(spark, partitions, ["20260423"])
    found = events(spark, *moves)
    row = V.scope_recommendation(cover, found, V.event_quality(found, cover, lookback=300)).first()
    assert row.scope_status == status


def test_probe_has_seven_tables(spark):
    rows = [("binance", "BTC", "UP", bucket(at("2026-04-23 01:00:00")), bucket(at("2026-04-23 01:00:05")), 1.0, 1.0, 1.0, False)]
    frame = candidates(spark, rows)
    tables = probe_coverage(catalog(spark, full("20260423")), frame, exchanges=NAMES, symbol_family="btc", detector=Detector(), lookback=300)
    assert {name: table.count() for name, table in tables.items()} == {
        "coverage_by_date": 1,
        "missing_dates": 0,
        "raw_candidate_summary": 2,
        "grouped_events": 1,
        "event_quality": 1,
        "direction_distribution": 1,
        "recommended_scope": 1,
    }


def test_drifted_schemas_are_read_together(spark, tmp_path):
    root = tmp_path / "exchange=okx" / "stream=trade" / "symbol=BTC"
    spark.range(2).write.parquet(str(root / "date=20260423"))
    spark.range(2).withColumn("extra", F.lit("x")).write.parquet(str(root / "date=20260424"))
    paths = [str(root / f"date={d}") for d in ("20260423", "20260424")]
    assert values(scans.scan_dated(spark, paths), "id", "extra", "source_partition_date") == [
        (0, None, "20260423"),
        (0, "x", "20260424"),
        (1, None, "20260423"),
        (1, "x", "20260424"),
    ]
    assert scans.scan_paths(spark, ["date=20260423"], root=str(root)).count() == 2
    with pytest.raises(ValueError):
        scans.scan_paths(spark, [])


def test_run_tables_are_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int").write.parquet(path)
    assert values(scans.scan_run_table(spark, path, equals={"run_id": "r2"}), "v") == [(2,)]
    with pytest.raises(ValueError, match="no rows"):
        scans.scan_run_table(spark, path, equals={"run_id": "r3"})
    with pytest.raises(ValueError, match="lacks"):
        scans.scan_run_table(spark, path, required=["w"])


def test_verified_writes(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.write_verified(spark.range(7), path).count() == 7
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_verified(spark.range(7), path)
    with pytest.raises(RuntimeError, match="nothing"):
        sinks.write_verified(spark.range(0), str(tmp_path / "none"), mode="light")
    assert sinks.write_verified(spark.range(0), str(tmp_path / "empty"), allow_empty=True).count() == 0
    with pytest.raises(ValueError):
        sinks.write_verified(spark.range(1), str(tmp_path / "x"), mode="loose")


def test_stage_tables_live_in_the_configured_folder(spark):
    table = stages.write_stage(spark.range(3), "numbers")
    assert values(table, "id") == [(0,), (1,), (2,)]
    assert table.inputFiles()[0].removeprefix("file://").startswith(stages.stage_root(spark).removeprefix("file:"))


def test_sparse_sequences_share_chunks(spark):
    rows = [("a", "S", at("2026-04-23 00:00:00").replace(second=n % 60), 1.0, 1.0, 10**15 + n * 10**9) for n in range(200)]
    ticks = clean_ticks(spark.createDataFrame(rows, "exchange string, symbol string, ts_event timestamp, price double, qty double, seq long"))
    row = Q.seq_order_check(ticks.withColumn("ts_recv", F.col("ts_event")), chunk_rows=50).first()
    assert row.out_of_order_ts_event_count == 3


def test_dense_and_sparse_venues_are_cut_evenly(spark):
    """Ids that count up, ids from a clock, and ids that jump: no chunk holds much more than its share."""
    seqs = {"dense": range(20_000), "clock": range(10**15, 10**15 + 20_000 * 10**9, 10**9), "jump": [*range(5_000), *range(10**12, 10**12 + 15_000)]}
    parts = []
    for exchange, listed in seqs.items():
        first, rest = listed[0], listed[1] - listed[0]
        parts.append(spark.range(20_000).selectExpr(f"'{exchange}' AS exchange", "'S' AS symbol", "timestamp_micros(id * 1000000) AS ts_event", f"{first} + id * {rest} AS seq", "id"))
    ticks = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ticks = ticks.withColumn("seq", F.when((F.col("exchange") == "jump") & (F.col("id") >= 5000), F.lit(10**12) + F.col("id") - 5000).otherwise(F.col("seq")))
    edges = Q.sequence_edges(Q.sequence_marks(ticks), 1000)
    assert values(edges.select("exchange", F.size("edges").alias("n")), "exchange", "n") == [("clock", 64), ("dense", 64), ("jump", 64)]
    placed = Q._with_cells(ticks.withColumn("_seq", F.col("seq")), edges)
    sizes = placed.groupBy("exchange", "_cell", "_part").count().groupBy("exchange").agg(F.max("count").alias("most"), F.count("*").alias("n"))
    assert all(row.most <= 1500 and row.n >= 14 for row in sizes.collect())
    assert Q.sequence_edges(Q.sequence_marks(ticks), 20_000).count() == 0
    few = Q.sequence_edges(Q.sequence_marks(ticks), 10)  # more chunks than cells: each cell is cut by its width
    placed = Q._with_cells(ticks.withColumn("_seq", F.col("seq")), few)
    assert placed.groupBy("exchange", "_cell", "_part").count().agg(F.max("count")).first()[0] <= 900


def test_duplicates_by_id_and_by_fields(spark):
    moment = at("2026-04-23 00:00:00")
    rows = [("a", "S", moment, 1.0, 1.0, 1, i, "buy") for i in ("x", "x", "y", None, None)] + [("a", "S", moment, 2.0, 1.0, 1, "z", None)] * 2
    frame = spark.createDataFrame(rows, "exchange string, symbol string, ts_event timestamp, price double, qty double, seq long, trade_id string, side string")
    assert values(Q.duplicate_profile(frame), *Q.duplicate_profile(frame).columns) == [("exact_id", 2, 4), ("same_fields", 2, 7)]
    assert values(Q.duplicate_profile(frame.limit(0)), *Q.duplicate_profile(frame).columns) == [("exact_id", 0, 0), ("same_fields", 0, 0)]


def test_a_stage_folder_is_removed_as_a_whole(spark):
    with stages.StageFolder(spark) as stage:
        table = stage(spark.range(3), "numbers")
        path = table.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert table.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


@pytest.mark.parametrize("chunk", [2, 1000])
def test_sequence_regressions_cross_chunks(spark, chunk):
    seconds = [0, 5, 4, 6, 6, 3, 9, 1]
    rows = [("a", "S", at("2026-04-23 00:00:00").replace(second=s), 1.0, 1.0, n * 3) for n, s in enumerate(seconds)]
    ticks = clean_ticks(spark.createDataFrame(rows, "exchange string, symbol string, ts_event timestamp, price double, qty double, seq long"))
    ticks = ticks.withColumn("ts_recv", F.col("ts_event"))
    row = Q.seq_order_check(ticks, chunk_rows=chunk).first()
    assert (row.out_of_order_ts_event_count, row.out_of_order_ts_recv_count) == (3, 3)
    gaps = Q.gap_profile(ticks, 1, thresholds=(1, 2), chunk_buckets=chunk).first()
    assert (gaps.max_gap, gaps.gaps_gt_1, gaps.gaps_gt_2) == (3, 2, 1)


def test_the_tick_report_equals_its_single_profiles(spark):
    moments = [at("2026-04-23 00:00:00").replace(second=s) for s in (0, 1, 1, 7, 30)]
    rows = [(v, "S", t, 1.0 + n, 2.0 * n, n, str(n % 4), side) for n, (t, v, side) in enumerate(zip(moments, "aabab", ("buy", None, "sell", "buy", "buy"), strict=True))]
    ticks = clean_ticks(
        spark.createDataFrame(rows, "exchange string, symbol string, ts_event timestamp, price double, qty double, seq long, trade_id string, side string")
    ).withColumn("ts_recv", F.col("ts_event"))
    report = Q.profile_ticks(ticks)
    single = {
        "counts": Q.count_profile,
        "latency": Q.latency_profile,
        "values": Q.value_profile,
        "nulls": Q.null_profile,
        "categories": Q.category_profile,
        "duplicates": Q.duplicate_profile,
        "sequence": Q.seq_order_check,
        "density": Q.density_profile,
        "gaps": Q.gap_profile,
    }
    assert list(report) == list(single)
    for name, profile in single.items():
        assert sorted(map(repr, report[name].collect())) == sorted(map(repr, profile(ticks).collect())), name


def test_quantiles_of_many_latencies_and_counts_are_order_statistics(spark):
    n = 150_001
    latency = F.pmod(F.col("id") * 7_919, F.lit(n)) * F.col("id") % 1_000_003
    numbered = spark.range(0, n, 1, 6).select("id", latency.alias("l"))
    ticks = numbered.select(
        F.lit("a").alias("exchange"), F.lit("S").alias("symbol"), F.timestamp_micros(F.lit(0).cast("long")).alias("ts_event"), F.timestamp_micros("l").alias("ts_recv")
    )
    ordered = sorted(row.l for row in numbered.collect())
    expected = [ordered[-(-n * percent // 100) - 1] / 1000.0 for percent in (50, 95, 99)]
    made = Q.latency_profile(ticks).first()
    assert [made.p50, made.p95, made.p99] == expected
    active = numbered.select(
        F.lit(None).cast("string").alias("exchange"), F.lit("S").alias("symbol"), F.col("id").alias("bucket"), F.col("l").alias("trade_count")
    )
    made = Q._density(active, lambda df, name: df.localCheckpoint()).first()
    assert [made.p50 / 1000.0, made.p95 / 1000.0, made.p99 / 1000.0] == expected


def test_latency_without_rows_or_receive_times_is_null(spark):
    schema = "exchange string, symbol string, ts_event timestamp, ts_recv timestamp"
    for rows in ([], [("a", "S", at("2026-04-23 00:00:00"), None)]):
        made = Q.latency_profile(spark.createDataFrame(rows, schema)).collect()
        assert [(row.avg_latency_ms, row.p50, row.p99) for row in made] == [(None, None, None)]
