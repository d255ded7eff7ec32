"""What the physical plans must and must not contain, and the registered queries against their SQL."""

import pytest
from helpers import at, bucket
from oracle_check import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as contract
from registry.queries import QUERIES
from tidemark.operators import bars as B
from tidemark.operators import moves as M
from tidemark.operators import quality as Q
from tidemark.operators import windows as W
from tidemark.sources.stages import write_stage

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    """The whole plan: long lists of aggregates are not cut short."""
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def ticks(spark):
    rows = [("a", "S", at("2026-04-23 00:00:00"), 1.0, 1.0, 1, "1", "buy")]
    return spark.createDataFrame(
        rows, "exchange string, symbol string, ts_event timestamp, price double, qty double, seq long, trade_id string, side string"
    )


@pytest.mark.usefixtures("no_broadcast")
def test_range_joins_hash_on_slices_when_too_large_to_broadcast(spark):
    bars = B.ohlcv_bars(B.clean_ticks(ticks(spark)))
    events = spark.createDataFrame([("e", "UP", bucket(at("2026-04-23 00:01:00")))], "event_id string, direction string, event_start_bucket long")
    for df in (
        M.scan_moves(bars, 1.0, 60),
        W.extract_windows(B.clean_ticks(ticks(spark)), W.event_windows(events, 300), slice_seconds=300),
    ):
        text = plan_of(df)
        assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" in text


def test_ticks_combine_before_the_shuffle(spark):
    text = plan_of(B.tick_buckets(B.clean_ticks(ticks(spark))))
    assert text.count("Exchange") == 1 and "partial_max" in text.split("Exchange")[1]


def test_sequence_check_reads_and_shuffles_rows_once(spark):
    """The small table of edges is broadcast where its size allows; the rows move once."""
    frame = B.clean_ticks(ticks(spark)).withColumn("ts_recv", F.col("ts_event"))
    edges = write_stage(Q.sequence_edges(Q.sequence_marks(frame), 10), "edges")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        text = plan_of(Q.seq_order_check(frame, edges=edges))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert text.count("Join") == text.count("BroadcastHashJoin") == 1
    assert text.replace("BroadcastExchange", "").count("Exchange") <= 3


def test_only_the_dates_of_the_windows_are_read(spark, tmp_path):
    path = str(tmp_path / "ticks")
    days = ticks(spark).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(9))))
    days.select("*", F.date_format(F.date_add("ts_event", F.col("d")), "yyyyMMdd").alias("date")).drop("d").write.partitionBy("date").parquet(path)
    events = spark.createDataFrame([("e", "UP", bucket(at("2026-04-23 00:01:00")))], "event_id string, direction string, event_start_bucket long")
    stored = spark.read.schema("exchange string, symbol string, ts_event timestamp, price double, qty double, seq long, date string").parquet(path)
    found = W.extract_windows(
        B.clean_ticks(stored, keep=["date"]), W.event_windows(events, 300), slice_seconds=300, date_column="date"
    )
    assert "dynamicpruning" in plan_of(found)
    assert [(r.window_id, r.date) for r in found.collect()] == [("e", "20260423")]


def test_only_the_spans_of_the_windows_are_read(spark, tmp_path):
    """Files of other spans are made unreadable: panels and anchor activity do not open them."""
    from registry import adapters
    from registry.settings import FINE
    from tidemark.operators import controls as K
    from tidemark.operators import panel as P
    from tidemark.plans.study import market_stage
    from tidemark.sources.stages import StageFolder

    folder = StageFolder(spark, str(tmp_path))
    market = market_stage(adapters.event_ticks(spark, SMALL), adapters.event_quotes(spark, SMALL), FINE, folder)["market"]
    span = market.agg(F.min("span")).first()[0] + 2
    end = span * FINE.span + FINE.lookback // 2  # the window begins in the span before
    events = spark.createDataFrame([("e", "UP", end)], "event_id string, direction string, event_start_bucket long")
    windows = W.event_windows(events, FINE.lookback, bucket_seconds=FINE.bucket_seconds)
    sparse = P.window_buckets(market, windows, FINE.lookback, span_buckets=FINE.span)
    everything = P.window_buckets(market.drop("span"), windows, FINE.lookback)
    expected = sorted(map(repr, everything.select(sorted(everything.columns)).collect()))
    grid = {"lookback": FINE.lookback, "horizon": FINE.horizon, "step": FINE.anchor_step, "span_buckets": FINE.span}
    bars = write_stage(B.bars_from_buckets(market), "bars")
    wanted = spark.createDataFrame([(span,)], "span long").filter("span > 0")
    activity = K.anchor_activity(market, bars, exchanges=FINE.exchanges, spans=wanted, **grid)
    assert "dynamicpruning" in plan_of(sparse) and "dynamicpruning" in plan_of(activity)
    for file in market.inputFiles():
        if f"span={span}/" not in file and f"span={span - 1}/" not in file:
            with open(file.removeprefix("file://").removeprefix("file:"), "wb") as f:
                f.write(b"unreadable")
    found = P.window_buckets(market, windows, FINE.lookback, span_buckets=FINE.span)
    assert expected and sorted(map(repr, found.select(sorted(found.columns)).collect())) == expected
    assert K.anchor_activity(market, bars, exchanges=FINE.exchanges, spans=wanted, **grid).count() > 0


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "bars")
    B.ohlcv_bars(B.clean_ticks(ticks(spark))).write.parquet(path)
    text = plan_of(spark.read.parquet(path).filter("bucket > 5").select("exchange"))
    assert "GreaterThan(bucket,5)" in text and "ReadSchema: struct<bucket:bigint,exchange:string>" in text


def test_every_query_has_its_sql():
    own = [{name for name in names() if name.startswith("q_")} for names in (contract.queries, contract.oracle_sql)]
    assert own == [set(QUERIES), set(QUERIES)]


def test_numeric_epochs_take_one_scan(spark, tmp_path):
    path = str(tmp_path / "epochs")
    ticks(spark).withColumns({"ts_event": F.unix_micros("ts_event"), "ts_recv": F.unix_micros("ts_event")}).write.parquet(path)
    text = plan_of(B.tick_buckets(B.clean_ticks(spark.read.parquet(path))))
    assert text.count("Location:") == 1 and "Subquery" not in text


def test_a_whole_study(spark):
    from registry import adapters
    from registry.settings import FINE
    from tidemark.operators.contracts import raise_on_failure
    from tidemark.plans.study import run_study
    from tidemark.sources.stages import StageFolder

    with StageFolder(spark) as stage:
        frames = adapters.event_ticks(spark, SMALL), adapters.event_quotes(spark, SMALL)
        study = run_study(*frames, FINE, stage)
        selected = {r.event_id for r in study["selected_events"].collect()}
        assert {r.event_id for r in study["processing_status"].filter("selected").collect()} == selected
        assert study["processing_status"].count() == study["events"].count()
        assert {r.event_id for r in study["event_profiles"]["entity"].select("event_id").distinct().collect()} == selected
        raise_on_failure(study["contracts"])
        with pytest.raises(RuntimeError, match="are needed"):
            run_study(*frames, FINE, stage, min_events=10_000)


@pytest.mark.parametrize(
    "name",
    ["q_quote_buckets", "q_scan_moves", "q_cluster_anchored", "q_event_quality", "q_read_catalog", "q_panel_ffill", "q_anchor_exclusion", "q_review"],
)
def test_queries_agree_with_sql(spark, name):
    df = contract.queries()[name](spark, SMALL)
    cursor = connect(SMALL).execute(contract.oracle_sql()[name])
    theirs = ([d[0] for d in cursor.description], cursor.fetchall())
    assert compare(name, (df.columns, [tuple(r) for r in df.collect()]), theirs).startswith("ok")


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:3] == ["event_id", "event_rank", "exchange"] and df.count() > 0


def test_expectations_are_observed_while_a_table_is_written(spark):
    """A failing table is written and reported; no expectation starts a job of its own; a lazy stage works too."""
    from tidemark.operators import contracts as K

    rows = spark.range(100).select(F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id")).alias("x"), (F.col("id") % 7).alias("rank"), F.lit("w").alias("window_label"))
    wanted = [K.expect_no_null("x"), K.expect_rank_within("rank", 6), K.expect_full_window("rank", "w", 3), K.expect_single_row(["window_label"]), K.expect_count(100)]
    expected = [("t", e.check, r.observed) for e, r in zip(wanted, K.check(rows, wanted).collect(), strict=True)]
    writes = []

    def written(df, name):
        spark.sparkContext.setJobGroup("watched", name)
        writes.append(name)
        return write_stage(df, name)

    for stage in (written, lambda df, name: df):
        watched = K.Watched(stage)
        kept = watched(rows, "t", wanted)
        assert kept.count() == 100
        report = watched.report(rows)
        assert [(r.table, r["check"], r.observed) for r in report.collect()] == expected
        assert not all(r.passed for r in report.collect())
        with pytest.raises(RuntimeError, match="no_null:x: observed 10, expected 0"):
            K.raise_on_failure(report)
    assert writes == ["t"]
    empty = K.Watched(write_stage)
    empty(rows.limit(0), "t", wanted[:1])
    assert empty.report(rows).first().observed == 0
