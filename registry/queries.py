"""One registered query per operator: how to run it on Spark, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import adapters, oracles
from registry.oracles import BASE, COMPARED, EVENT_COLUMNS, EVENT_PROFILES, FINE_DETECTION, HOURLY_DETECTION
from registry.oracles import ANCHORS, COVERAGE, IDENTITY, PROBE, RECURRENCE, REVIEWED, STUDY, TOPS
from registry.oracles import balanced, buckets, clustered, day, flags, ntz, policy, select, us
from registry.settings import FINE, HOURLY, LOOKBACK, RAW_LOOKBACK
from registry.workspace import Workspace, workspace
from tidemark.functions import measures, naming, taxonomy
from tidemark.functions.exact import exact_sum
from tidemark.functions.timeaxis import bucket_index, normalize_ts, window_dates
from tidemark.operators import bars, clusters, compare, contracts, controls, coverage, moves, panel, profiles, quality
from tidemark.operators import ranking, review, summaries, windows
from tidemark.plans.coverage_probe import probe_coverage
from tidemark.plans.event_map import detect, event_map
from tidemark.plans.study import with_span
from tidemark.sources import catalog as catalogs
from tidemark.sources import scans, sinks
from tidemark.sources.stages import stage_root

Columns = dict[str, str]


@dataclass(frozen=True)
class Query:
    run: Callable[[Workspace], DataFrame]
    columns: Columns
    sql: str | None


QUERIES: dict[str, Query] = {}


def kinds(**names: str) -> Columns:
    """Columns by kind: ``kinds(s="a b", i="n")`` is {"a": "s", "b": "s", "n": "i"}."""
    return {name: kind for kind, listed in names.items() for name in listed.split()}


def register(name: str, columns: Columns, chain: str | None, source: str = ""):
    def add(run: Callable[[Workspace], DataFrame]):
        sql = None if chain is None else select(chain, source, columns)
        QUERIES[f"q_{name}"] = Query(run, columns, sql)
        return run

    return add


def canonical(df: DataFrame, columns: Columns) -> DataFrame:
    shapes = {
        "i": lambda c: c.cast("long"),
        "d": lambda c: F.round(c.cast("double"), 6),
        "g": lambda c: c.cast("double") + F.lit(0.0),
        "s": lambda c: c.cast("string"),
        "b": lambda c: c.cast("boolean"),
        "t": lambda c: c.cast("timestamp_ntz"),
    }
    return df.select(*[shapes[kind](F.col(name)).alias(name) for name, kind in columns.items()])


def runnable(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return canonical(query.run(workspace(spark, sf_dir)), query.columns)

    return run


def fresh_path(w: Workspace, name: str) -> str:
    import uuid

    return f"{stage_root(w.spark)}/tidemark-{uuid.uuid4().hex}/{name}"


def joined(column: str) -> F.Column:
    return F.array_join(column, ",")


# --- sources and sinks -----------------------------------------------------------------------------

CATALOG = kinds(s="date exchange stream symbol data_key meta_key quality_day_key", b="available")


def manifest_of(catalog: DataFrame) -> DataFrame:
    """The catalog as one nested JSON document (a manifest lists partitions, not rows of data)."""
    artifacts = F.create_map(
        *[x for key in ("data_key", "meta_key", "quality_day_key") for x in (F.lit(key), F.col(key))]
    )
    nested = catalog.withColumn("_entry", F.struct("available", artifacts.alias("artifacts")))
    keys = ["date", "exchange", "stream", "symbol"]
    for level, name in (("symbol", "symbols"), ("stream", "streams"), ("exchange", "exchanges")):
        keys.remove(level)
        nested = nested.groupBy(*keys).agg(
            F.struct(F.map_from_entries(F.collect_list(F.struct(level, "_entry"))).alias(name)).alias("_entry")
        )
    dates = F.map_from_entries(F.collect_list(F.struct("date", "_entry"))).alias("dates")
    document = F.struct(F.lit(1).alias("schema_version"), F.lit("2024-02-01").alias("updated_at"), dates)
    return nested.agg(F.to_json(document).alias("value"))


@register("read_catalog", CATALOG, BASE, "catalog")
def _(w):
    path = fresh_path(w, "manifest")
    manifest_of(w.catalog).write.text(path)
    return catalogs.read_catalog(w.spark, path)


@register("partition_from_path", kinds(s="path exchange stream symbol date"), BASE, "(SELECT *, 'root/' || data_key AS path FROM catalog)")
def _(w):
    return catalogs.partition_from_path(w.catalog.select(F.concat(F.lit("root/"), "data_key").alias("path")))


@register(
    "select_partitions",
    CATALOG,
    BASE,
    f"catalog WHERE available AND exchange IN ({oracles.VENUE_LIST}) AND stream = 'trade' AND date BETWEEN '20240101' AND '20240131'",
)
def _(w):
    return catalogs.select_partitions(
        w.catalog,
        exchanges=[name.upper() for name in FINE.exchanges],
        streams=("trade",),
        symbol_family="idx",
        first_date="20240101",
        last_date="20240131",
    )


@register("catalog_dates", kinds(s="date"), f"{BASE},{COVERAGE}", "(SELECT DISTINCT date FROM family)")
def _(w):
    return catalogs.catalog_dates(w.family)


@register("requested_dates", kinds(s="date"), f"{BASE},{COVERAGE}", "requested")
def _(w):
    return catalogs.requested_dates(w.family)


TICK_COLUMNS = kinds(s="exchange symbol trade_id", i="seq", d="price qty", t="ts_event ts_recv")


@register("scan_paths", TICK_COLUMNS, BASE, "(SELECT * FROM raw_ticks UNION ALL SELECT * FROM raw_ticks)")
def _(w):
    ticks = bars.clean_ticks(w.ticks)
    paths = [fresh_path(w, f"part_{n}") for n in (1, 2)]
    for path in paths:
        ticks.write.parquet(path)
    return scans.scan_paths(w.spark, paths)


@register(
    "scan_dated",
    kinds(s="exchange source_partition_date", i="seq", d="price"),
    BASE,
    f"(SELECT *, {day('ts_event')} AS source_partition_date FROM raw_ticks)",
)
def _(w):
    root = fresh_path(w, "ticks")
    ticks = bars.clean_ticks(w.ticks).withColumns(
        {"stream": F.lit("trade"), "date": F.date_format("ts_event", "yyyyMMdd")}
    )
    ticks.repartition("date").write.partitionBy("exchange", "stream", "symbol", "date").parquet(root)
    return scans.scan_dated(w.spark, [root])


@register("scan_run_table", EVENT_COLUMNS, FINE_DETECTION, "evt")
def _(w):
    path = fresh_path(w, "events")
    w.found["events"].withColumn("run_id", F.lit("run_1")).write.parquet(path)
    return scans.scan_run_table(w.spark, path, required=["event_id", "run_id"], equals={"run_id": "run_1"})


BAR_COLUMNS = kinds(s="exchange symbol", i="bucket trade_count", d="open_price high_price low_price close_price volume")
HOURLY_BUCKETS = f"{BASE},{buckets(HOURLY.bucket_seconds)}"
FINE_BUCKETS = f"{BASE},{buckets(FINE.bucket_seconds)}"


@register("write_verified", BAR_COLUMNS, FINE_BUCKETS, "bars")
def _(w):
    return sinks.write_verified(w.market["bars"], fresh_path(w, "bars"), mode="strict")


@register(
    "normalize_ts",
    kinds(i="seq", t="from_ns from_us from_ms from_s from_mixed"),
    BASE,
    "(SELECT seq, CASE WHEN seq % 3 = 0 THEN date_trunc('millisecond', ts_event) ELSE ts_event END AS from_mixed, ts_event AS from_ns, ts_event AS from_us, date_trunc('millisecond', ts_event) AS from_ms, "
    "date_trunc('second', ts_event) AS from_s FROM raw_ticks)",
)
def _(w):
    micros = F.unix_micros(F.col("ts_event").cast("timestamp"))
    epochs = w.ticks.select(
        "seq",
        (micros * 1000).alias("from_ns"),
        micros.alias("from_us"),
        F.floor(micros / 1000).alias("from_ms"),
        F.floor(micros / 1_000_000).cast("int").alias("from_s"),
        F.when(F.col("seq") % 3 == 0, F.floor(micros / 1000)).when(F.col("seq") % 3 == 1, micros).otherwise(micros * 1000).alias("from_mixed"),
    )
    for column in ("from_ns", "from_us", "from_ms", "from_s", "from_mixed"):
        epochs = normalize_ts(epochs, column)
    return epochs


@register(
    "union_drifted",
    kinds(s="exchange", i="seq", d="price bid_price"),
    BASE,
    "(SELECT exchange, seq, price, NULL AS bid_price FROM raw_ticks UNION ALL SELECT exchange, seq, NULL, bid_price FROM raw_quotes)",
)
def _(w):
    return scans.union_drifted(
        [
            bars.clean_ticks(w.ticks).select("exchange", "seq", "price"),
            bars.clean_quotes(w.quotes).select("exchange", "seq", "bid_price"),
        ]
    )


# --- row expressions -------------------------------------------------------------------------------


@register("clean_ticks", TICK_COLUMNS, BASE, "raw_ticks")
def _(w):
    return bars.clean_ticks(w.ticks)


@register(
    "window_filter",
    kinds(i="seq", d="seconds_before_event"),
    BASE,
    """(SELECT seq, epoch_us(date_trunc('day', ts_event) + INTERVAL 12 HOUR - ts_event) / 1e6 AS seconds_before_event
        FROM raw_ticks WHERE ts_event >= date_trunc('day', ts_event) + INTERVAL 6 HOUR
         AND ts_event < date_trunc('day', ts_event) + INTERVAL 12 HOUR)""",
)
def _(w):
    midnight = F.date_trunc("day", "ts_event")
    timed = bars.clean_ticks(w.ticks).withColumns(
        {"_from": midnight + F.expr("interval 6 hours"), "_to": midnight + F.expr("interval 12 hours")}
    )
    return windows.window_filter(timed, "ts_event", "_from", "_to")


@register("window_dates", kinds(s="event_id partition_date"), PROBE, "touched")
def _(w):
    events = clusters.cluster_chained(
        w.hourly_candidates, HOURLY.horizon, bucket_seconds=HOURLY.bucket_seconds, scope="date"
    )
    timed = windows.event_windows(events, RAW_LOOKBACK, bucket_seconds=HOURLY.bucket_seconds)
    return window_dates(timed, "window_start_ts", "window_end_ts")


QUOTE_COLUMNS = kinds(
    s="exchange", i="seq", d="bid_price bid_qty ask_price ask_qty mid_price spread spread_bps book_imbalance"
)


@register("quote_metrics", QUOTE_COLUMNS, BASE, "raw_quotes")
def _(w):
    return bars.clean_quotes(w.quotes)


@register(
    "negative_spread_count",
    kinds(s="exchange", i="quote_count negative_spread_count"),
    BASE,
    "(SELECT exchange, count(*) AS quote_count, count(*) FILTER (spread < 0) AS negative_spread_count FROM raw_quotes GROUP BY 1)",
)
def _(w):
    return bars.negative_spread_count(bars.clean_quotes(w.quotes))


@register(
    "normalize_side",
    kinds(s="side_raw side", i="row_count"),
    BASE,
    "(SELECT side_raw, side, count(*) AS row_count FROM raw_ticks GROUP BY 1, 2)",
)
def _(w):
    sides = w.ticks.select(F.col("side").alias("side_raw"), measures.side_of(F.col("side")).alias("side"))
    return sides.groupBy("side_raw", "side").agg(F.count(F.lit(1)).alias("row_count"))


@register(
    "bps_math",
    kinds(i="l_orderkey l_linenumber l_partkey l_suppkey", d="ratio return_bps diff_bps absolute_change relative_change"),
    "keyed AS (SELECT *, l_tax - 0.02 AS x, l_discount - 0.02 AS y FROM lineitem)",
    """(SELECT *, CASE WHEN y <> 0 THEN x / y END AS ratio, CASE WHEN y <> 0 THEN (x / y - 1.0::DOUBLE) * 1e4 END AS return_bps,
        CASE WHEN y <> 0 THEN (x - y) / y * 1e4 END AS diff_bps, x - y AS absolute_change,
        CASE WHEN y <> 0 THEN (x - y) / abs(y) END AS relative_change FROM keyed)""",
)
def _(w):
    item = adapters.table(w.spark, w.sf_dir, "lineitem")
    x, y = F.col("l_tax") - 0.02, F.col("l_discount") - 0.02
    return item.withColumns(
        {
            "ratio": measures.ratio(x, y),
            "return_bps": measures.return_bps(y, x),
            "diff_bps": measures.diff_bps(x, y),
            "absolute_change": x - y,
            "relative_change": measures.relative_change(y, x),
        }
    )


# --- bars and buckets ------------------------------------------------------------------------------


@register("ohlcv_bars", BAR_COLUMNS, FINE_BUCKETS, "bars")
def _(w):
    return bars.ohlcv_bars(bars.clean_ticks(w.ticks), FINE.bucket_seconds)


@register(
    "first_last_rank",
    kinds(s="exchange symbol", i="bucket", d="first_price last_price"),
    f"{BASE}, days AS (SELECT epoch_us(ts_event) // {us(86400)} AS bucket, * FROM li_ticks)",
    """(SELECT bucket, exchange, symbol, arg_min(price, row(seq, trade_id)) AS first_price,
        arg_max(price, row(seq, trade_id)) AS last_price FROM days GROUP BY 1, 2, 3)""",
)
def _(w):
    ticks = bars.clean_ticks(adapters.lineitem_ticks(w.spark, w.sf_dir))
    return bars.ohlcv_bars(ticks, 86_400).select(
        "bucket", "exchange", "symbol", F.col("open_price").alias("first_price"), F.col("close_price").alias("last_price")
    )


TRADE_BUCKET = kinds(
    s="exchange symbol",
    i="bucket trade_count buy_trade_count sell_trade_count",
    d="trade_volume trade_notional buy_qty sell_qty buy_notional sell_notional trade_imbalance_qty open_price "
    "last_trade_price min_trade_price max_trade_price",
)
QUOTE_BUCKET = kinds(
    s="exchange symbol",
    i="bucket bbo_update_count",
    t="last_bbo_update_ts",
    d=" ".join(f"last_{name}" for name in bars.QUOTE_LAST) + " avg_spread_bps max_spread_bps avg_book_imbalance",
)


@register("tick_buckets", TRADE_BUCKET, FINE_BUCKETS, "tb")
def _(w):
    return bars.tick_buckets(bars.clean_ticks(w.ticks), FINE.bucket_seconds)


@register("quote_buckets", QUOTE_BUCKET, FINE_BUCKETS, "qb")
def _(w):
    return bars.quote_buckets(bars.clean_quotes(w.quotes), FINE.bucket_seconds)


@register("market_buckets", {**TRADE_BUCKET, **QUOTE_BUCKET}, FINE_BUCKETS, "market")
def _(w):
    return w.market["market"]


# --- moves and clusters ----------------------------------------------------------------------------


@register(
    "lookahead_join",
    kinds(s="exchange symbol", i="start_bucket touch_bucket", d="base_price high_price low_price"),
    FINE_DETECTION,
    "ahead",
)
def _(w):
    return moves.lookahead_join(w.market["bars"], FINE.horizon)


@register(
    "first_touch",
    kinds(s="exchange symbol", i="start_bucket up_bucket down_bucket", d="base_price up_price down_price"),
    HOURLY_DETECTION,
    "touch",
)
def _(w):
    return moves.first_touch(w.hourly_bars, HOURLY.threshold_pct, HOURLY.horizon)


CANDIDATE = kinds(
    s="exchange symbol direction",
    b="is_ambiguous",
    i="start_bucket end_bucket duration_seconds",
    d="base_price touch_price move_pct",
)


@register("scan_moves", CANDIDATE, HOURLY_DETECTION, "cands")
def _(w):
    return moves.scan_moves(
        w.hourly_bars, HOURLY.threshold_pct, HOURLY.horizon, bucket_seconds=HOURLY.bucket_seconds
    )


@register(
    "label_candidates",
    {**CANDIDATE, **kinds(s="selected_date detection_version source_stream", d="threshold_pct", i="horizon_buckets")},
    HOURLY_DETECTION,
    f"""(SELECT *, {day(ntz("start_bucket", HOURLY.bucket_seconds))} AS selected_date, '{HOURLY.version}' AS detection_version,
        'trade' AS source_stream, {HOURLY.threshold_pct} AS threshold_pct, {HOURLY.horizon} AS horizon_buckets FROM cands)""",
)
def _(w):
    return detect(w.ticks, HOURLY)["candidates"]


KEY = "exchange, symbol, direction"


@register(
    "approx_groups",
    CANDIDATE,
    HOURLY_DETECTION,
    f"""(SELECT * FROM (SELECT *, start_bucket - lag(start_bucket) OVER (PARTITION BY {KEY} ORDER BY start_bucket) AS gap FROM clear)
        WHERE gap IS NULL OR gap > {HOURLY.horizon})""",
)
def _(w):
    return moves.approx_groups(w.hourly_candidates.filter("not is_ambiguous"), HOURLY.horizon, chunk_buckets=48)


def hourly_clusters(name: str, **options) -> str:
    return f"{HOURLY_DETECTION},{clustered(name, 'clear', HOURLY.horizon, HOURLY.bucket_seconds, **options)}"


@register("cluster_chained", EVENT_COLUMNS, hourly_clusters("ev"), "ev")
def _(w):
    clear = w.hourly_candidates.filter("not is_ambiguous")
    return clusters.cluster_chained(
        clear, HOURLY.horizon, bucket_seconds=HOURLY.bucket_seconds, chunk_buckets=48
    )


@register("cluster_anchored", EVENT_COLUMNS, hourly_clusters("ev", anchored=True), "ev")
def _(w):
    clear = w.hourly_candidates.filter("not is_ambiguous")
    return clusters.cluster_anchored(
        clear, HOURLY.horizon, bucket_seconds=HOURLY.bucket_seconds, chunk_buckets=48
    )


@register("event_map", EVENT_COLUMNS, hourly_clusters("ev"), "ev")
def _(w):
    return event_map(w.ticks, HOURLY)


@register("event_id", kinds(s="event_id", i="event_rank"), PROBE, "probe_events")
def _(w):
    return clusters.cluster_chained(
        w.hourly_candidates, HOURLY.horizon, bucket_seconds=HOURLY.bucket_seconds, scope="date"
    )


@register("balanced_select", EVENT_COLUMNS, f"{FINE_DETECTION},{balanced('evt', 15)}", "members")
def _(w):
    return clusters.balanced_select(w.found["events"], 15)


@register(
    "balance_note",
    kinds(s="direction_balance_note"),
    f"{FINE_DETECTION},{balanced('evt', 15)}",
    """(SELECT CASE WHEN su = sd THEN 'balanced' ELSE printf('direction_balance_best_effort:available_up=%d,available_down=%d,selected_up=%d,selected_down=%d',
        au, ad, su, sd) END AS direction_balance_note
        FROM (SELECT count(*) FILTER (direction = 'UP') AS au, count(*) FILTER (direction = 'DOWN') AS ad FROM evt),
             (SELECT count(*) FILTER (direction = 'UP') AS su, count(*) FILTER (direction = 'DOWN') AS sd FROM members))""",
)
def _(w):
    events = w.found["events"]
    return clusters.balance_note(events, clusters.balanced_select(events, 15))


@register("ordered_sample", CANDIDATE, HOURLY_DETECTION, "(SELECT * FROM clear ORDER BY start_bucket, exchange, direction LIMIT 20)")
def _(w):
    clear = w.hourly_candidates.filter("not is_ambiguous")
    return ranking.ordered_sample(clear, [F.col("start_bucket"), F.col("exchange"), F.col("direction")], 20)


# --- data quality ----------------------------------------------------------------------------------


@register(
    "count_profile",
    kinds(s="profile_level exchange symbol", i="row_count distinct_exchange_count distinct_symbol_count"),
    BASE,
    """(SELECT CASE WHEN grouping(exchange) = 1 THEN 'all' WHEN grouping(symbol) = 1 THEN 'exchange' ELSE 'exchange_symbol' END AS profile_level,
        exchange, symbol, count(*) AS row_count, count(DISTINCT exchange) AS distinct_exchange_count, count(DISTINCT symbol) AS distinct_symbol_count
        FROM li_ticks GROUP BY GROUPING SETS ((exchange), (exchange, symbol), ()))""",
)
def _(w):
    return quality.count_profile(bars.clean_ticks(adapters.lineitem_ticks(w.spark, w.sf_dir)))


@register(
    "latency_profile",
    kinds(t="min_ts_event max_ts_event min_ts_recv max_ts_recv", d="min_latency_ms max_latency_ms avg_latency_ms p50 p95 p99"),
    BASE,
    """(SELECT min(ts_event) AS min_ts_event, max(ts_event) AS max_ts_event, min(ts_recv) AS min_ts_recv, max(ts_recv) AS max_ts_recv,
        min(ms) AS min_latency_ms, max(ms) AS max_latency_ms, avg(ms) AS avg_latency_ms, quantile_disc(ms, 0.5) AS p50,
        quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99
        FROM (SELECT *, epoch_us(ts_recv - ts_event) / 1000.0 AS ms FROM raw_ticks))""",
)
def _(w):
    return quality.latency_profile(bars.clean_ticks(w.ticks))


@register(
    "value_profile",
    kinds(s="column_name exchange", d="min_value max_value avg_value", i="null_count non_positive_count"),
    f"""{BASE}, unfolded AS (SELECT exchange, 'price' AS column_name, price AS value FROM raw_ticks
        UNION ALL SELECT exchange, 'qty', qty FROM raw_ticks)""",
    """(SELECT column_name, exchange, min(value) AS min_value, max(value) AS max_value, avg(value) AS avg_value,
        count(*) FILTER (value IS NULL) AS null_count, count(*) FILTER (value <= 0) AS non_positive_count
        FROM unfolded GROUP BY GROUPING SETS ((column_name), (column_name, exchange)))""",
)
def _(w):
    return quality.value_profile(bars.clean_ticks(w.ticks))


@register(
    "null_profile",
    kinds(s="column_name", i="null_count"),
    f"{BASE}, sides AS (SELECT count(*) FILTER (side IS NULL) AS n FROM raw_ticks)",
    """(SELECT 'price' AS column_name, 0 AS null_count UNION ALL SELECT 'ts_recv', 0 UNION ALL SELECT 'side', n FROM sides
        UNION ALL SELECT 'stream_version', -1)""",
)
def _(w):
    ticks = bars.clean_ticks(w.ticks).withColumn("side", measures.side_of(F.col("side")))
    return quality.null_profile(ticks, ["price", "ts_recv", "side", "stream_version"])


@register(
    "category_profile",
    kinds(s="profile_level exchange category", i="row_count"),
    BASE,
    """(SELECT CASE WHEN grouping(exchange) = 1 THEN 'side' ELSE 'exchange_side' END AS profile_level, exchange,
        side AS category, count(*) AS row_count FROM li_ticks GROUP BY GROUPING SETS ((side), (exchange, side)))""",
)
def _(w):
    return quality.category_profile(bars.clean_ticks(adapters.lineitem_ticks(w.spark, w.sf_dir)))


@register(
    "duplicate_profile",
    kinds(s="duplicate_kind", i="duplicate_group_count duplicate_row_count"),
    f"""{BASE}, pairs AS (SELECT count(*) AS n FROM li_ticks GROUP BY exchange, symbol, seq HAVING n > 1),
    same AS (SELECT count(*) AS n FROM li_ticks GROUP BY exchange, symbol, ts_event, price, qty, side HAVING n > 1)""",
    """(SELECT 'exact_id' AS duplicate_kind, count(*) AS duplicate_group_count, coalesce(sum(n), 0) AS duplicate_row_count FROM pairs
        UNION ALL SELECT 'same_fields', count(*), coalesce(sum(n), 0) FROM same)""",
)
def _(w):
    ticks = bars.clean_ticks(adapters.lineitem_ticks(w.spark, w.sf_dir))
    return quality.duplicate_profile(ticks, exact=("exchange", "symbol", "seq"))


@register(
    "duplicate_examples",
    kinds(s="exchange symbol", i="seq row_count"),
    BASE,
    """(SELECT exchange, symbol, seq, count(*) AS row_count FROM li_ticks GROUP BY 1, 2, 3 HAVING count(*) > 1
        ORDER BY row_count DESC, exchange, symbol, seq LIMIT 20)""",
)
def _(w):
    ticks = bars.clean_ticks(adapters.lineitem_ticks(w.spark, w.sf_dir))
    return quality.duplicate_examples(ticks, ("exchange", "symbol", "seq"))


@register(
    "seq_order_check",
    kinds(s="exchange symbol", i="out_of_order_ts_event_count out_of_order_ts_recv_count"),
    f"""{BASE}, linked AS (SELECT *, lag(ts_event) OVER (PARTITION BY exchange, symbol ORDER BY seq, ts_event, ts_recv) AS prev
        FROM li_ticks)""",
    """(SELECT exchange, symbol, count(*) FILTER (ts_event < prev) AS out_of_order_ts_event_count,
        count(*) FILTER (ts_recv < prev) AS out_of_order_ts_recv_count FROM linked GROUP BY 1, 2)""",
)
def _(w):
    ticks = bars.clean_ticks(adapters.lineitem_ticks(w.spark, w.sf_dir))
    return quality.seq_order_check(ticks, chunk_rows=500)


@register(
    "density_profile",
    kinds(
        s="exchange symbol",
        i="min_trade_count max_trade_count min_bucket max_bucket active_bucket_count p50 p95 p99",
        d="avg_trade_count",
    ),
    f"{BASE}, active AS (SELECT exchange, symbol, epoch_us(ts_event) // {us(86400)} AS bucket, count(*) AS n FROM li_ticks GROUP BY 1, 2, 3)",
    """(SELECT exchange, symbol, min(n) AS min_trade_count, max(n) AS max_trade_count, avg(n) AS avg_trade_count,
        quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99, min(bucket) AS min_bucket,
        max(bucket) AS max_bucket, count(*) AS active_bucket_count FROM active GROUP BY 1, 2)""",
)
def _(w):
    return quality.density_profile(bars.clean_ticks(adapters.lineitem_ticks(w.spark, w.sf_dir)), 86_400)


@register(
    "gap_profile",
    kinds(s="exchange symbol", i="max_gap gaps_gt_1 gaps_gt_5 gaps_gt_10"),
    FINE_BUCKETS,
    """(SELECT exchange, symbol, max(gap) AS max_gap, count(*) FILTER (gap > 1) AS gaps_gt_1, count(*) FILTER (gap > 5) AS gaps_gt_5,
        count(*) FILTER (gap > 10) AS gaps_gt_10
        FROM (SELECT *, bucket - lag(bucket) OVER (PARTITION BY exchange, symbol ORDER BY bucket) AS gap FROM bars) GROUP BY 1, 2)""",
)
def _(w):
    return quality.gap_profile(bars.clean_ticks(w.ticks), FINE.bucket_seconds, chunk_buckets=288)


Facts = dict[str, tuple[tuple[str, ...], tuple[str, ...], str]]  # table: key columns, measures, SQL


def facts_sql(facts: Facts) -> str:
    """All tables of a report as (table_name, row_key, measure, value)."""
    parts = []
    for table, (keys, names, sql) in facts.items():
        key = f"concat_ws('|', {', '.join(keys)})" if keys else "''"
        listed = ", ".join(f"CAST({name} AS DOUBLE)" for name in names)
        parts.append(f"SELECT '{table}' AS table_name, {key} AS row_key, unnest({list(names)}) AS measure, unnest([{listed}]) AS value FROM ({sql})")
    return "(" + " UNION ALL ".join(parts) + ")"


def facts_of(tables: dict[str, DataFrame], facts: Facts) -> DataFrame:
    parts = []
    for table, (keys, names, _) in facts.items():
        measured = F.inline(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("value")) for name in names]))
        parts.append(tables[table].select(F.lit(table).alias("table_name"), F.concat_ws("|", *keys).alias("row_key"), measured))
    return compare.union_reports(parts)


FACTS = kinds(s="table_name row_key measure", d="value")
CLEANED = ("exchange", "symbol", "ts_event", "price", "qty", "ts_recv", "seq", "trade_id", "side")
ORDERED = ("out_of_order_ts_event_count", "out_of_order_ts_recv_count")
TICK_FACTS: Facts = {
    "counts": (
        ("profile_level", "exchange", "symbol"),
        ("row_count", "distinct_exchange_count", "distinct_symbol_count"),
        """SELECT CASE WHEN grouping(exchange) = 1 THEN 'all' WHEN grouping(symbol) = 1 THEN 'exchange' ELSE 'exchange_symbol' END AS profile_level,
        exchange, symbol, count(*) AS row_count, count(DISTINCT exchange) AS distinct_exchange_count, count(DISTINCT symbol) AS distinct_symbol_count
        FROM raw_ticks GROUP BY GROUPING SETS ((exchange), (exchange, symbol), ())""",
    ),
    "latency": (
        (),
        ("min_latency_ms", "max_latency_ms", "avg_latency_ms", "p50", "p95", "p99"),
        """SELECT min(ms) AS min_latency_ms, max(ms) AS max_latency_ms, avg(ms) AS avg_latency_ms, quantile_disc(ms, 0.5) AS p50,
        quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99
        FROM (SELECT epoch_us(ts_recv - ts_event) / 1000.0 AS ms FROM raw_ticks)""",
    ),
    "values": (
        ("column_name", "exchange"),
        ("min_value", "max_value", "avg_value", "null_count", "non_positive_count"),
        """SELECT column_name, exchange, min(value) AS min_value, max(value) AS max_value, avg(value) AS avg_value,
        count(*) FILTER (value IS NULL) AS null_count, count(*) FILTER (value <= 0) AS non_positive_count
        FROM (SELECT exchange, 'price' AS column_name, price AS value FROM raw_ticks UNION ALL SELECT exchange, 'qty', qty FROM raw_ticks)
        GROUP BY GROUPING SETS ((column_name), (column_name, exchange))""",
    ),
    "nulls": (
        ("column_name",),
        ("null_count",),
        " UNION ALL ".join(
            f"SELECT '{name}' AS column_name, count(*) FILTER ({'side_raw' if name == 'side' else name} IS NULL) AS null_count FROM raw_ticks"
            for name in CLEANED
        ),
    ),
    "categories": (
        ("profile_level", "exchange", "category"),
        ("row_count",),
        """SELECT CASE WHEN grouping(exchange) = 1 THEN 'side' ELSE 'exchange_side' END AS profile_level, exchange, side_raw AS category,
        count(*) AS row_count FROM raw_ticks GROUP BY GROUPING SETS ((side_raw), (exchange, side_raw))""",
    ),
    "duplicates": (
        ("duplicate_kind",),
        ("duplicate_group_count", "duplicate_row_count"),
        """SELECT 'exact_id' AS duplicate_kind, count(*) AS duplicate_group_count, coalesce(sum(n), 0) AS duplicate_row_count
        FROM (SELECT count(*) AS n FROM raw_ticks GROUP BY exchange, symbol, trade_id HAVING n > 1)
        UNION ALL SELECT 'same_fields', count(*), coalesce(sum(n), 0)
        FROM (SELECT count(*) AS n FROM raw_ticks GROUP BY exchange, symbol, ts_event, price, qty, side_raw HAVING n > 1)""",
    ),
    "sequence": (
        ("exchange", "symbol"),
        ORDERED,
        """SELECT exchange, symbol, count(*) FILTER (ts_event < prev_event) AS out_of_order_ts_event_count,
        count(*) FILTER (ts_recv < prev_recv) AS out_of_order_ts_recv_count
        FROM (SELECT *, lag(ts_event) OVER w AS prev_event, lag(ts_recv) OVER w AS prev_recv FROM raw_ticks
              WINDOW w AS (PARTITION BY exchange, symbol ORDER BY seq, ts_event, ts_recv)) GROUP BY 1, 2""",
    ),
    "density": (
        ("exchange", "symbol"),
        ("min_trade_count", "max_trade_count", "avg_trade_count", "p50", "p95", "p99", "min_bucket", "max_bucket", "active_bucket_count"),
        """SELECT exchange, symbol, min(trade_count) AS min_trade_count, max(trade_count) AS max_trade_count, avg(trade_count) AS avg_trade_count,
        quantile_disc(trade_count, 0.5) AS p50, quantile_disc(trade_count, 0.95) AS p95, quantile_disc(trade_count, 0.99) AS p99,
        min(bucket) AS min_bucket, max(bucket) AS max_bucket, count(*) AS active_bucket_count FROM bars GROUP BY 1, 2""",
    ),
    "gaps": (
        ("exchange", "symbol"),
        ("max_gap", "gaps_gt_1", "gaps_gt_5", "gaps_gt_10"),
        """SELECT exchange, symbol, max(gap) AS max_gap, count(*) FILTER (gap > 1) AS gaps_gt_1, count(*) FILTER (gap > 5) AS gaps_gt_5,
        count(*) FILTER (gap > 10) AS gaps_gt_10
        FROM (SELECT *, bucket - lag(bucket) OVER (PARTITION BY exchange, symbol ORDER BY bucket) AS gap FROM bars) GROUP BY 1, 2""",
    ),
}


@register("profile_ticks", FACTS, FINE_BUCKETS, facts_sql(TICK_FACTS))
def _(w):
    report = quality.profile_ticks(bars.clean_ticks(w.ticks), bucket_seconds=FINE.bucket_seconds, chunk_rows=500)
    return facts_of(report, TICK_FACTS)


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each table of a report has."""
    counted = [
        table.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for name, table in tables.items()
    ]
    return compare.union_reports(counted)


@register(
    "candidate_profile",
    kinds(
        s="profile_level exchange symbol direction",
        i="candidate_count min_duration_seconds max_duration_seconds",
        d="avg_duration_seconds min_move_pct max_move_pct avg_move_pct",
    ),
    HOURLY_DETECTION,
    """(SELECT coalesce(nullif(concat_ws('_', CASE WHEN grouping(exchange) = 0 THEN 'exchange' END, CASE WHEN grouping(symbol) = 0 THEN 'symbol' END,
          CASE WHEN grouping(direction) = 0 THEN 'direction' END), ''), 'all') AS profile_level, exchange, symbol, direction,
        count(*) AS candidate_count, min(duration_seconds) AS min_duration_seconds, max(duration_seconds) AS max_duration_seconds,
        avg(duration_seconds) AS avg_duration_seconds, min(move_pct) AS min_move_pct, max(move_pct) AS max_move_pct, avg(move_pct) AS avg_move_pct
        FROM clear GROUP BY GROUPING SETS ((direction), (exchange), (symbol), (exchange, direction), ()))""",
)
def _(w):
    return quality.candidate_profile(w.hourly_candidates.filter("not is_ambiguous"))


@register(
    "candidate_rollup",
    kinds(s="summary_level selected_date exchange direction", i="raw_candidate_count ambiguous_candidate_count"),
    f"{HOURLY_DETECTION}, dated AS (SELECT *, {day(ntz('start_bucket', HOURLY.bucket_seconds))} AS selected_date FROM cands)",
    """(SELECT CASE WHEN grouping(direction) = 0 THEN 'date_exchange_direction' ELSE 'total' END AS summary_level, selected_date, exchange,
        direction, count(*) FILTER (NOT is_ambiguous) AS raw_candidate_count, count(*) FILTER (is_ambiguous) AS ambiguous_candidate_count
        FROM dated GROUP BY GROUPING SETS ((selected_date, exchange, direction), ()))""",
)
def _(w):
    return quality.candidate_rollup(w.hourly_candidates, bucket_seconds=HOURLY.bucket_seconds)


# --- coverage --------------------------------------------------------------------------------------

PRESENT = f"""{BASE},{COVERAGE}, present AS (
  SELECT date, list_sort(list(DISTINCT exchange)) AS seen FROM catalog WHERE available AND stream = 'bbo' GROUP BY 1)"""
MISSING = "list_filter([{0}], lambda v: NOT list_contains(seen, v))".format(oracles.VENUE_LIST)


def bbo_partitions(w: Workspace) -> DataFrame:
    return catalogs.select_partitions(w.catalog, exchanges=FINE.exchanges, streams=("bbo",), symbol_family="idx")


@register(
    "coverage_table",
    kinds(s="date present missing", i="coverage_count"),
    PRESENT,
    f"(SELECT date, array_to_string(seen, ',') AS present, array_to_string({MISSING}, ',') AS missing, len(seen) AS coverage_count FROM present)",
)
def _(w):
    table = coverage.coverage_table(bbo_partitions(w), FINE.exchanges)
    return table.select("date", joined("present_exchanges").alias("present"), joined("missing_exchanges").alias("missing"), "coverage_count")


@register(
    "best_date",
    kinds(s="date", i="coverage_count"),
    PRESENT,
    f"(SELECT date, len(seen) AS coverage_count FROM present WHERE len(seen) >= 2 ORDER BY (len(seen) = {len(FINE.exchanges)}) DESC, date DESC LIMIT 1)",
)
def _(w):
    return coverage.best_date(coverage.coverage_table(bbo_partitions(w), FINE.exchanges), len(FINE.exchanges))


@register(
    "exchange_coverage",
    kinds(s="date observed missing", b="covered"),
    PRESENT,
    f"(SELECT date, array_to_string(seen, ',') AS observed, array_to_string({MISSING}, ',') AS missing, len({MISSING}) = 0 AS covered FROM present)",
)
def _(w):
    table = coverage.exchange_coverage(bbo_partitions(w), FINE.exchanges, keys=["date"])
    return table.select("date", joined("observed_exchanges").alias("observed"), joined("missing_exchanges").alias("missing"), "covered")


HAS = " ".join(f"has_{venue}_{kind}" for kind in ("trade", "bbo") for venue in FINE.exchanges)


@register(
    "coverage_diagnostics",
    kinds(
        s="date missing_reasons",
        b="is_present_in_catalog is_present_in_family has_full_trade_coverage has_full_bbo_coverage "
        f"has_full_trade_bbo_coverage event_scan_possible {HAS}",
        i="trade_coverage_count bbo_coverage_count",
    ),
    f"{BASE},{COVERAGE}",
    "coverage",
)
def _(w):
    return w.diagnostics


QUALITY = kinds(
    s="event_id direction selected_date pre_window_partition_dates quality_reason",
    b="has_full_trade_coverage has_full_bbo_coverage pre_window_partitions_available",
    i="trade_coverage_count bbo_coverage_count",
)


def probe(w: Workspace) -> dict[str, DataFrame]:
    return probe_coverage(
        w.catalog,
        w.hourly_candidates,
        exchanges=FINE.exchanges,
        symbol_family="idx",
        detector=HOURLY,
        lookback=RAW_LOOKBACK,
    )


@register("event_quality", QUALITY, PROBE, "quality")
def _(w):
    return probe(w)["event_quality"]


DIRECTIONS = f"""(SELECT selected_date, direction, count(*) FILTER (kind = 1) AS raw_candidate_count, count(*) FILTER (kind = 2) AS grouped_event_count,
        count(*) FILTER (kind = 3) AS quality_pass_count
        FROM (SELECT {day(ntz("start_bucket", HOURLY.bucket_seconds))} AS selected_date, direction, 1 AS kind FROM cands WHERE NOT is_ambiguous
              UNION ALL SELECT selected_date, direction, 2 FROM probe_events
              UNION ALL SELECT selected_date, direction, 3 FROM quality WHERE quality_reason = 'quality_pass_preview') GROUP BY 1, 2)"""


@register(
    "direction_distribution",
    kinds(s="selected_date direction", i="raw_candidate_count grouped_event_count quality_pass_count"),
    PROBE,
    DIRECTIONS,
)
def _(w):
    return probe(w)["direction_distribution"]


@register(
    "scope_recommendation",
    kinds(
        s="requested_start_date requested_end_date recommended_start_date recommended_end_date scope_status",
        i="available_date_count full_coverage_date_count grouped_event_count quality_pass_count up_count down_count "
        "recommended_max_events recommended_min_events",
        b="direction_balance_possible",
    ),
    PROBE,
    """(SELECT *, least(10, quality_pass_count) AS recommended_max_events, least(2, quality_pass_count) AS recommended_min_events,
        up_count > 0 AND down_count > 0 AS direction_balance_possible,
        CASE WHEN NOT scan THEN 'no_event_scan_possible' WHEN quality_pass_count = 0 THEN 'no_quality_preview_events'
             WHEN quality_pass_count = 1 THEN 'weak_multi_event_coverage' WHEN up_count = 0 OR down_count = 0 THEN 'direction_imbalanced'
             ELSE 'ready_for_phase3a_trial' END AS scope_status
        FROM (SELECT min(date) AS requested_start_date, max(date) AS requested_end_date,
                     count(*) FILTER (is_present_in_family) AS available_date_count,
                     count(*) FILTER (has_full_trade_bbo_coverage) AS full_coverage_date_count, bool_or(event_scan_possible) AS scan FROM coverage),
             (SELECT count(*) AS grouped_event_count FROM probe_events),
             (SELECT count(*) AS quality_pass_count, count(*) FILTER (direction = 'UP') AS up_count,
                     count(*) FILTER (direction = 'DOWN') AS down_count, min(selected_date) AS recommended_start_date,
                     max(selected_date) AS recommended_end_date FROM quality WHERE quality_reason = 'quality_pass_preview'))""",
)
def _(w):
    return probe(w)["recommended_scope"]


@register(
    "probe_coverage",
    kinds(s="table_name", i="row_count"),
    PROBE,
    f"""(SELECT 'coverage_by_date' AS table_name, count(*) AS row_count FROM coverage
        UNION ALL SELECT 'missing_dates', count(*) FROM coverage WHERE missing_reasons <> ''
        UNION ALL SELECT 'raw_candidate_summary', 1 + count(DISTINCT row({day(ntz("start_bucket", HOURLY.bucket_seconds))}, exchange, direction)) FROM cands
        UNION ALL SELECT 'grouped_events', count(*) FROM probe_events UNION ALL SELECT 'event_quality', count(*) FROM quality
        UNION ALL SELECT 'direction_distribution', count(*) FROM {DIRECTIONS} UNION ALL SELECT 'recommended_scope', 1)""",
)
def _(w):
    return table_sizes(probe(w))


# --- windows and panels ----------------------------------------------------------------------------

OWN_BOUNDS = f"""{FINE_DETECTION}, own AS (
  SELECT event_id AS window_id, direction AS event_direction, {ntz(f"event_start_bucket - {LOOKBACK}", FINE.bucket_seconds)} AS window_start_ts,
         {ntz("event_start_bucket", FINE.bucket_seconds)} AS window_end_ts FROM evt)"""
INSIDE = """JOIN own ON ts_event >= window_start_ts AND ts_event < window_end_ts"""
OFFSET = "epoch_us(window_end_ts - ts_event) / 1e6 AS seconds_before_event"


@register(
    "extract_windows_ticks",
    kinds(s="window_id event_direction exchange symbol trade_id", i="seq", d="price qty seconds_before_event", t="ts_event window_start_ts window_end_ts"),
    OWN_BOUNDS,
    f"(SELECT *, {OFFSET} FROM raw_ticks {INSIDE})",
)
def _(w):
    return windows.extract_windows(bars.clean_ticks(w.ticks), w.own_windows, slice_seconds=FINE.bucket_seconds * LOOKBACK)


@register(
    "extract_windows_quotes",
    {**QUOTE_COLUMNS, **kinds(s="window_id", d="seconds_before_event", t="ts_event")},
    OWN_BOUNDS,
    f"(SELECT *, {OFFSET} FROM raw_quotes {INSIDE})",
)
def _(w):
    return windows.extract_windows(bars.clean_quotes(w.quotes), w.own_windows, slice_seconds=FINE.bucket_seconds * LOOKBACK)


@register(
    "extract_windows",
    kinds(s="window_id kind", i="row_count", d="nearest farthest"),
    OWN_BOUNDS,
    f"""(SELECT window_id, kind, count(*) AS row_count, min(seconds_before_event) AS nearest, max(seconds_before_event) AS farthest
        FROM (SELECT window_id, 'tick' AS kind, {OFFSET} FROM raw_ticks {INSIDE}
              UNION ALL SELECT window_id, 'quote', {OFFSET} FROM raw_quotes {INSIDE}) GROUP BY 1, 2)""",
)
def _(w):
    span = FINE.bucket_seconds * LOOKBACK
    kinds_of_rows = {"tick": bars.clean_ticks(w.ticks), "quote": bars.clean_quotes(w.quotes)}
    parts = [
        windows.extract_windows(rows, w.own_windows, slice_seconds=span).select(
            "window_id", F.lit(kind).alias("kind"), "seconds_before_event"
        )
        for kind, rows in kinds_of_rows.items()
    ]
    return compare.union_reports(parts).groupBy("window_id", "kind").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("seconds_before_event").alias("nearest"),
        F.max("seconds_before_event").alias("farthest"),
    )


@register(
    "range_join_bucketed",
    kinds(s="window_id exchange", i="row_count"),
    OWN_BOUNDS,
    f"(SELECT window_id, exchange, count(*) AS row_count FROM raw_ticks {INSIDE} GROUP BY 1, 2)",
)
def _(w):
    ticks = bars.clean_ticks(w.ticks).withColumn("bucket", bucket_index(F.col("ts_event"), FINE.bucket_seconds))
    matched = windows.range_join_bucketed(
        ticks,
        w.own_windows.select("window_id", "window_start_bucket", "window_end_bucket"),
        position=F.col("bucket"),
        start=F.col("window_start_bucket"),
        end=F.col("window_end_bucket"),
        width=LOOKBACK,
        salts=4,
        salt_by=["exchange", "seq"],
    )
    return matched.groupBy("window_id", "exchange").agg(F.count(F.lit(1)).alias("row_count"))


@register(
    "range_join_broadcast",
    kinds(s="exchange", i="anchor_bucket row_count"),
    f"{FINE_DETECTION},{ANCHORS}",
    f"""(SELECT anchor_bucket, exchange, count(*) AS row_count FROM all_anchors
        JOIN (SELECT *, epoch_us(ts_event) // {us(FINE.bucket_seconds)} AS bucket FROM raw_ticks)
          ON bucket >= anchor_bucket - {LOOKBACK} AND bucket < anchor_bucket GROUP BY 1, 2)""",
)
def _(w):
    """Anchors against ticks without comparing ranges: the regular anchors' slots carry the counts."""
    sums = controls.activity_sums(w.rated["activity"])
    return sums.select("exchange", "anchor_bucket", F.col("trade_count_sum").alias("row_count"))


@register(
    "window_metadata_join",
    kinds(s="window_id event_id direction exchange symbol"),
    EVENT_PROFILES,
    "o_present",
)
def _(w):
    sparse = panel.window_buckets(w.market["market"], w.own_windows, LOOKBACK, span_buckets=FINE.span)
    return sparse.select("window_id", "event_id", "direction", "exchange", "symbol").distinct()


@register("cross_grid", kinds(s="window_id exchange symbol", i="bucket second_before_event"), EVENT_PROFILES, "o_grid")
def _(w):
    sparse = panel.window_buckets(w.market["market"], w.own_windows, LOOKBACK, span_buckets=FINE.span)
    before = F.col("window_end_bucket") - F.col("bucket")
    return panel.densify(panel.panel_ffill(sparse)).withColumn("second_before_event", before)


PANEL_KEY = kinds(s="window_id exchange symbol", i="second_before_event")


@register(
    "panel_join",
    {
        **PANEL_KEY,
        **kinds(
            i="trade_count bbo_update_count",
            d="trade_volume last_trade_price min_trade_price max_trade_price avg_spread_bps max_spread_bps avg_book_imbalance",
        ),
    },
    EVENT_PROFILES,
    "o_full",
)
def _(w):
    return panel.build_panel(w.market["market"], w.own_windows, LOOKBACK, bucket_seconds=FINE.bucket_seconds, span_buckets=FINE.span)


@register(
    "panel_ffill",
    {
        **PANEL_KEY,
        **kinds(
            d=" ".join(f"last_{name}" for name in bars.QUOTE_LAST),
            t="last_bbo_update_ts",
            b="has_bbo_update is_bbo_forward_filled",
            i="bbo_quote_age_seconds",
        ),
    },
    EVENT_PROFILES,
    "o_full",
)
def _(w):
    return w.own["panel"]


@register(
    "zero_fill",
    {**PANEL_KEY, **kinds(i="trade_count buy_trade_count sell_trade_count", d="trade_volume trade_notional buy_qty sell_qty buy_notional sell_notional trade_imbalance_qty last_trade_price")},
    EVENT_PROFILES,
    "o_full",
)
def _(w):
    return panel.build_panel(w.market["market"], w.own_windows, LOOKBACK, bucket_seconds=FINE.bucket_seconds, span_buckets=FINE.span)


@register(
    "build_panel",
    {**PANEL_KEY, **kinds(i="trade_count bbo_update_count bbo_quote_age_seconds", d="trade_notional last_mid_price last_spread_bps", t="ts_second")},
    EVENT_PROFILES,
    f"(SELECT *, {ntz('bucket', FINE.bucket_seconds)} AS ts_second FROM o_full)",
)
def _(w):
    return panel.build_panel(w.market["market"], w.own_windows, LOOKBACK, bucket_seconds=FINE.bucket_seconds, span_buckets=FINE.span)


# --- profiles --------------------------------------------------------------------------------------

PROFILE_KEY = kinds(s="window_id direction exchange symbol window_mode window_label")
COUNTED = (
    "seconds_observed seconds_with_trades seconds_with_bbo_update seconds_forward_filled_bbo trade_count_sum "
    "trade_count_per_second_max bbo_quote_age_seconds_max"
)
MEASURED = (
    " ".join(m for m in taxonomy.ENTITY_METRICS if m not in COUNTED.split())
    + " first_last_trade_price last_last_trade_price min_last_trade_price max_last_trade_price first_last_mid_price last_last_mid_price"
)


@register("entity_profile", {**PROFILE_KEY, **kinds(i=COUNTED, d=MEASURED)}, EVENT_PROFILES, "o_entity")
def _(w):
    return profiles.entity_profile(w.own["panel"], FINE.windows)


@register(
    "pair_self_join",
    kinds(s="window_id symbol_key exchange_pair exchange_a exchange_b", i="second_before_event", d="mid_a mid_b mid_diff_bps"),
    EVENT_PROFILES,
    "o_mids",
)
def _(w):
    return profiles.pair_mids(w.own["panel"], FINE.exchanges)


@register(
    "pair_profile",
    kinds(
        s="window_id direction symbol_key window_mode window_label exchange_pair exchange_a exchange_b",
        i="seconds_compared",
        d="avg_mid_diff_bps max_abs_mid_diff_bps last_mid_diff_bps last_abs_mid_diff_bps",
    ),
    EVENT_PROFILES,
    "o_pair",
)
def _(w):
    return profiles.pair_profile(w.own["panel"], FINE.exchanges, FINE.windows)


@register(
    "pair_name",
    kinds(s="exchange_pair"),
    EVENT_PROFILES,
    "(SELECT DISTINCT exchange_pair FROM o_pair)",
)
def _(w):
    pairs = w.own["pair"].select("exchange_a", "exchange_b").distinct()
    return pairs.select(naming.pair_name(F.upper("exchange_a"), F.upper("exchange_b")).alias("exchange_pair"))


CHANGE = kinds(
    s="window_id exchange symbol from_bucket to_bucket metric_name",
    d="from_bucket_value to_bucket_value absolute_change relative_change",
)


@register("bucket_change", CHANGE, EVENT_PROFILES, "o_change")
def _(w):
    return profiles.bucket_change(w.own["entity"], FINE.windows)


@register("adjacent_self_join", kinds(s="window_id exchange symbol from_bucket to_bucket metric_name", d="from_bucket_value to_bucket_value"), EVENT_PROFILES, "o_change")
def _(w):
    return w.own["change"]


@register(
    "build_profiles",
    kinds(s="table_name", i="row_count"),
    EVENT_PROFILES,
    """(SELECT 'entity' AS table_name, count(*) AS row_count FROM o_entity UNION ALL SELECT 'pair', count(*) FROM o_pair
        UNION ALL SELECT 'change', count(*) FROM o_change)""",
)
def _(w):
    return table_sizes(profiles.build_profiles(w.own["panel"], FINE.exchanges, FINE.windows))


# --- controls --------------------------------------------------------------------------------------

ANCHORED = f"{FINE_DETECTION},{ANCHORS}"
GRID = {
    "lookback": FINE.lookback,
    "horizon": FINE.horizon,
    "step": FINE.anchor_step,
    "span_buckets": FINE.span,
}


@register("enumerate_anchors", kinds(i="span first_anchor anchor_bucket"), ANCHORED, "all_anchors")
def _(w):
    return controls.enumerate_anchors(w.market["bars"], **GRID)


@register(
    "nearest_event_distance",
    kinds(i="anchor_bucket previous_start next_start nearest_candidate_distance"),
    ANCHORED,
    "near",
)
def _(w):
    anchors = controls.enumerate_anchors(w.market["bars"], **GRID)
    return controls.nearest_event_distance(anchors, w.found["candidates"], FINE.span)


@register(
    "anchor_exclusion",
    kinds(i="span anchor_bucket nearest_candidate_distance", s="exclusion_reason"),
    ANCHORED,
    "excluded",
)
def _(w):
    return controls.anchor_exclusion(
        controls.enumerate_anchors(w.market["bars"], **GRID),
        w.found["candidates"],
        lookback=FINE.lookback,
        horizon=FINE.horizon,
        proximity=FINE.proximity,
        span_buckets=FINE.span,
    )


@register(
    "exclusion_counts",
    kinds(s="reason", i="anchor_count"),
    ANCHORED,
    "(SELECT coalesce(exclusion_reason, 'eligible') AS reason, count(*) AS anchor_count FROM excluded GROUP BY 1)",
)
def _(w):
    return controls.exclusion_counts(w.rated["anchors"])


@register(
    "anchor_activity",
    kinds(s="exchange symbol", i="span anchor_bucket trade_count_sum quote_count_sum", d="trade_volume_sum trade_notional_sum"),
    ANCHORED,
    "act",
)
def _(w):
    return controls.anchor_activity(w.market["market"], w.market["bars"], exchanges=FINE.exchanges, **GRID)


@register(
    "activity_sums",
    kinds(s="exchange", i="span anchor_bucket trade_count_sum", d="trade_volume_sum trade_notional_sum"),
    ANCHORED,
    "sums",
)
def _(w):
    return controls.activity_sums(w.rated["activity"])


WINDOW_COUNTS = (
    "trade_count bbo_count trade_exchange_count bbo_exchange_count snapshot_exchange_symbol_count "
    "snapshot_exchange_count snapshot_row_count"
)


@register("window_quality", kinds(i=f"anchor_bucket {WINDOW_COUNTS}", s="exclusion_reason quality_failure"), ANCHORED, "rated")
def _(w):
    anchors = w.rated["anchors"].select("span", "anchor_bucket", "exclusion_reason")
    return controls.window_quality(
        anchors, w.rated["activity"], expected_exchanges=len(FINE.exchanges), lookback=LOOKBACK
    )


@register("metrics_assemble", kinds(i=f"anchor_bucket {WINDOW_COUNTS}"), ANCHORED, "rated")
def _(w):
    return w.rated["anchors"]


@register(
    "first_quality_window",
    kinds(i="span anchor_bucket"),
    ANCHORED,
    "(SELECT span, min(anchor_bucket) AS anchor_bucket FROM rated WHERE exclusion_reason IS NULL AND quality_failure IS NULL GROUP BY 1)",
)
def _(w):
    return controls.first_quality_window(w.rated["anchors"])


DISTANCE = kinds(s="event_id", i="span anchor_bucket nearest_candidate_distance", d="activity_distance")


def distances(w: Workspace) -> DataFrame:
    usable = w.rated["anchors"].filter("exclusion_reason is null and quality_failure is null")
    return controls.activity_distance(
        with_span(w.found["events"], FINE),
        w.own_activity,
        usable.select("span", "anchor_bucket", "nearest_candidate_distance"),
        controls.activity_sums(w.rated["activity"]),
        len(FINE.exchanges),
    )


@register("activity_distance", DISTANCE, STUDY, "dist")
def _(w):
    return distances(w)


@register(
    "activity_join",
    kinds(s="event_id", i="anchor_count", d="closest farthest"),
    STUDY,
    "(SELECT event_id, count(*) AS anchor_count, min(activity_distance) AS closest, max(activity_distance) AS farthest FROM dist GROUP BY 1)",
)
def _(w):
    return distances(w).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("anchor_count"),
        F.min("activity_distance").alias("closest"),
        F.max("activity_distance").alias("farthest"),
    )


SAMPLE = kinds(s="event_id", i="sample_rank anchor_bucket nearest_candidate_distance", d="activity_distance")


@register("spaced_select", SAMPLE, STUDY, "taken")
def _(w):
    return controls.spaced_select(distances(w), count=FINE.controls_per_event, spacing=FINE.spacing)


@register("match_controls", {**SAMPLE, **kinds(s="sample_id")}, STUDY, "controls")
def _(w):
    return controls.match_controls(
        with_span(w.found["events"], FINE),
        w.own_activity,
        w.rated["anchors"],
        controls.activity_sums(w.rated["activity"]),
        exchanges=len(FINE.exchanges),
        count=FINE.controls_per_event,
        spacing=FINE.spacing,
        bucket_seconds=FINE.bucket_seconds,
    )


@register("sample_id", kinds(s="sample_id owner"), STUDY, "(SELECT sample_id, event_id AS owner FROM controls)")
def _(w):
    return w.controls.select("sample_id", naming.sample_owner(F.col("sample_id")).alias("owner"))


@register("select_events", {**EVENT_COLUMNS, **kinds(i="selection_order")}, STUDY, "chosen")
def _(w):
    return w.selected


@register(
    "selection_quality",
    kinds(s="event_id", i="selected_normal_count min_nearest_candidate_distance", d="avg_activity_distance max_activity_distance"),
    STUDY,
    """(SELECT event_id, count(*) AS selected_normal_count, min(nearest_candidate_distance) AS min_nearest_candidate_distance,
        avg(activity_distance) AS avg_activity_distance, max(activity_distance) AS max_activity_distance FROM kept_controls GROUP BY 1)""",
)
def _(w):
    return summaries.selection_quality(w.kept_controls)


STATUS = kinds(s="event_id direction processing_stage exclusion_reason", i="event_rank normal_selection_count", b="selected")


@register(
    "status_join",
    STATUS,
    STUDY,
    """(SELECT e.event_id, direction, 'selected' AS processing_stage, NULL AS exclusion_reason, event_rank, true AS selected,
        (SELECT count(*) FROM kept_controls k WHERE k.event_id = e.event_id) AS normal_selection_count FROM chosen e)""",
)
def _(w):
    return w.final["status"]


PROCESSED = """(SELECT e.event_id, e.direction, e.event_rank,
        CASE WHEN c.event_id IS NULL THEN 'normal_selection_failed' WHEN k.event_id IS NOT NULL THEN 'selected' ELSE 'not_needed' END AS processing_stage,
        CASE WHEN c.event_id IS NULL THEN 'insufficient_normal_windows' END AS exclusion_reason, k.event_id IS NOT NULL AS selected,
        CASE WHEN k.event_id IS NOT NULL THEN c.n ELSE 0 END AS normal_selection_count
        FROM evt e LEFT JOIN (SELECT event_id, count(*) AS n FROM controls GROUP BY 1) c USING (event_id) LEFT JOIN chosen k USING (event_id))"""


def processed(w: Workspace) -> DataFrame:
    events = w.found["events"]
    passed = events.select("event_id", F.lit(coverage.PASS).alias("quality_reason"))
    return summaries.processing_status(events, passed, w.controls, w.selected)


@register("processing_status", STATUS, STUDY, PROCESSED)
def _(w):
    return processed(w)


@register(
    "status_counts",
    kinds(s="summary_level direction processing_stage exclusion_reason", i="event_count"),
    STUDY,
    f"""(SELECT CASE WHEN grouping(direction) = 0 THEN 'direction' ELSE 'stage_reason' END AS summary_level, direction, processing_stage,
        exclusion_reason, count(*) AS event_count FROM {PROCESSED} GROUP BY GROUPING SETS ((direction), (processing_stage, exclusion_reason)))""",
)
def _(w):
    return summaries.status_counts(processed(w))


# --- comparison ------------------------------------------------------------------------------------

PLACE = "report_group metric_group metric_name exchange symbol_key exchange_pair window_mode window_label from_bucket to_bucket"
FLAGS = "ratio_unstable relative_change_unstable small_denominator_flag"


@register(
    "event_normal_join",
    kinds(s=f"event_id sample_id event_direction {PLACE}", g="event_value normal_value event_from_bucket_value normal_from_bucket_value"),
    COMPARED,
    "samples",
)
def _(w):
    parts = [compare.event_normal_join(w.own[name], w.other[name], report) for name, report in compare.REPORTS.items()]
    return compare.union_reports(parts)


SINGLE = f"""(SELECT *, event_value - normal_value AS signed_diff, abs(event_value - normal_value) AS absolute_diff,
        CASE WHEN normal_value <> 0 THEN event_value / normal_value END AS ratio, {flags("normal_value")} FROM samples)"""


@register(
    "single_compare",
    kinds(s=f"event_id sample_id {PLACE}", g="event_value normal_value signed_diff absolute_diff ratio", b=FLAGS),
    COMPARED,
    SINGLE,
)
def _(w):
    return compare.union_reports(list(compare.compare_profiles(w.own, w.other, single=True).values()))


SPREAD = kinds(
    s=f"event_id event_direction symbol {PLACE}",
    g="event_value normal_mean normal_median normal_min normal_max normal_p25 normal_p75 normal_stddev signed_diff_vs_mean "
    "absolute_diff_vs_mean normal_percentile_rank event_from_bucket_value normal_from_bucket_value "
    "event_to_bucket_value normal_to_bucket_value ratio_vs_mean z_score_vs_normal",
    i="normal_sample_count normal_non_null_count normal_zero_or_near_zero_count",
    b=FLAGS,
)


@register("distribution_compare", SPREAD, COMPARED, "comparison")
def _(w):
    return compare.union_reports(list(compare.compare_profiles(w.own, w.other).values()))


@register(
    "compare_profiles",
    kinds(s="report_group event_id metric_name", i="row_count samples flagged ranked", g="event_total mean_total spread_total z_total"),
    COMPARED,
    f"""(SELECT report_group, event_id, metric_name, count(*) AS row_count, sum(normal_non_null_count) AS samples,
        count(*) FILTER (small_denominator_flag) AS flagged, count(normal_percentile_rank) AS ranked, {oracles.exact_sum("abs(event_value)")} AS event_total,
        {oracles.exact_sum("abs(normal_mean)")} AS mean_total, {oracles.exact_sum("normal_stddev")} AS spread_total, {oracles.exact_sum("abs(z_score_vs_normal)")} AS z_total
        FROM compared GROUP BY 1, 2, 3)""",
)
def _(w):
    tables = compare.compare_profiles(w.selected_own, w.other)
    return compare.union_reports(list(tables.values())).groupBy("report_group", "event_id", "metric_name").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("normal_non_null_count").alias("samples"),
        F.count_if("small_denominator_flag").alias("flagged"),
        F.count("normal_percentile_rank").alias("ranked"),
        exact_sum(F.abs("event_value")).alias("event_total"),
        exact_sum(F.abs("normal_mean")).alias("mean_total"),
        exact_sum("normal_stddev").alias("spread_total"),
        exact_sum(F.abs("z_score_vs_normal")).alias("z_total"),
    )


@register(
    "compare_math",
    kinds(s=f"event_id {PLACE}", g="signed_diff_vs_mean absolute_diff_vs_mean normal_percentile_rank ratio_vs_mean z_score_vs_normal"),
    COMPARED,
    "comparison",
)
def _(w):
    return w.comparison


@register(
    "metric_group",
    kinds(s="metric_name metric_group", i="row_count"),
    COMPARED,
    "(SELECT metric_name, metric_group, count(*) AS row_count FROM compared GROUP BY 1, 2)",
)
def _(w):
    labelled = w.comparison.withColumn("metric_group", taxonomy.metric_group(F.col("metric_name")))
    return labelled.groupBy("metric_name", "metric_group").agg(F.count(F.lit(1)).alias("row_count"))


@register(
    "denominator_flags",
    kinds(s="metric_name", i="ratio_unstable_count relative_change_unstable_count small_denominator_count"),
    COMPARED,
    """(SELECT metric_name, count(*) FILTER (ratio_unstable) AS ratio_unstable_count,
        count(*) FILTER (relative_change_unstable) AS relative_change_unstable_count,
        count(*) FILTER (small_denominator_flag) AS small_denominator_count FROM compared GROUP BY 1)""",
)
def _(w):
    return w.comparison.groupBy("metric_name").agg(
        F.count_if("ratio_unstable").alias("ratio_unstable_count"),
        F.count_if("relative_change_unstable").alias("relative_change_unstable_count"),
        F.count_if("small_denominator_flag").alias("small_denominator_count"),
    )


REPORT_KEYS = {"entity": "exchange lower(symbol) window_mode window_label", "pair": "symbol_key exchange_pair window_mode window_label", "change": "exchange lower(symbol) metric_name from_bucket to_bucket"}


def unmatched_sql(name: str, keys: str) -> str:
    key = f"concat_ws('|', event_id, {', '.join(keys.split())})"
    return f"""SELECT '{name}' AS report, row_key, CASE WHEN bool_or(mine) THEN 'event_only' ELSE 'normal_only' END AS unmatched
        FROM (SELECT {key} AS row_key, true AS mine FROM o_{name} UNION ALL SELECT {key}, false FROM c_{name})
        GROUP BY 1, 2 HAVING bool_and(mine) OR NOT bool_or(mine)"""


@register(
    "unmatched_keys",
    kinds(s="report row_key unmatched"),
    COMPARED,
    "(" + " UNION ALL ".join(unmatched_sql(name, keys) for name, keys in REPORT_KEYS.items()) + ")",
)
def _(w):
    parts = []
    for name, report in compare.REPORTS.items():
        left = compare.unmatched_keys(w.own[name], w.other[name], report)
        parts.append(left.select(F.lit(name).alias("report"), F.concat_ws("|", "event_id", *report.keys).alias("row_key"), "unmatched"))
    return compare.union_reports(parts)


ROWS_PER_EVENT = contracts.expected_comparison_rows(1, len(FINE.exchanges))
EXPECTED_SQL = " UNION ALL ".join(
    f"SELECT event_id, '{report.group}' AS report_group, {ROWS_PER_EVENT[name]} AS expected_count FROM chosen"
    for name, report in compare.REPORTS.items()
)


@register(
    "count_reconcile",
    kinds(s="event_id report_group", i="expected_count observed_count"),
    COMPARED,
    f"""(SELECT event_id, report_group, coalesce(expected_count, -1) AS expected_count, coalesce(observed_count, -1) AS observed_count
        FROM ({EXPECTED_SQL}) FULL OUTER JOIN (SELECT event_id, report_group, count(*) AS observed_count FROM compared GROUP BY 1, 2)
        USING (event_id, report_group) WHERE coalesce(expected_count, -1) <> coalesce(observed_count, -1))""",
)
def _(w):
    expected = compare.union_reports(
        [
            w.selected.select(
                "event_id", F.lit(report.group).alias("report_group"), F.lit(ROWS_PER_EVENT[name]).cast("long").alias("expected_count")
            )
            for name, report in compare.REPORTS.items()
        ]
    )
    observed = w.comparison.groupBy("event_id", "report_group").agg(F.count(F.lit(1)).alias("observed_count"))
    return summaries.count_reconcile(expected, observed, ["event_id", "report_group"])


@register(
    "sign_distribution",
    kinds(s="report_group", i="positive_count negative_count zero_count null_count"),
    COMPARED,
    """(SELECT report_group, count(*) FILTER (signed_diff_vs_mean > 0) AS positive_count, count(*) FILTER (signed_diff_vs_mean < 0) AS negative_count,
        count(*) FILTER (signed_diff_vs_mean = 0) AS zero_count, count(*) FILTER (signed_diff_vs_mean IS NULL) AS null_count FROM comparison GROUP BY 1)""",
)
def _(w):
    return summaries.sign_distribution(w.comparison, "signed_diff_vs_mean")


# --- rankings --------------------------------------------------------------------------------------

RANKED = kinds(s=f"event_id {PLACE}", i="rank", d="event_value normal_mean z_score_vs_normal normal_percentile_rank")
TOPPED = f"{COMPARED},{TOPS}"


@register("rank_top_diffs", {**RANKED, **kinds(s="rank_type", d="signed_diff_vs_mean absolute_diff_vs_mean")}, TOPPED, "tops")
def _(w):
    return ranking.rank_top_diffs(w.comparison, FINE.top_n)


TRUSTED = "(SELECT * FROM comparison WHERE NOT small_denominator_flag)"


@register("top_by_abs_z", RANKED, TOPPED, f"({oracles.top('abs(z_score_vs_normal) DESC NULLS LAST', None, TRUSTED)})")
def _(w):
    return ranking.top_by_abs_z(w.comparison, FINE.top_n)


EXTREME = "greatest(normal_percentile_rank, 1.0 - normal_percentile_rank)"


@register(
    "top_by_extreme",
    {**RANKED, **kinds(d="percentile_extremity")},
    TOPPED,
    f"(SELECT *, {EXTREME} AS percentile_extremity FROM ({oracles.top(f'{EXTREME} DESC NULLS LAST', None, TRUSTED)}))",
)
def _(w):
    return ranking.top_by_extreme(w.comparison, FINE.top_n)


@register(
    "metric_group_summary",
    kinds(s="event_id report_group metric_group", i="row_count small_denominator_count"),
    COMPARED,
    """(SELECT event_id, report_group, metric_group, count(*) AS row_count, count(*) FILTER (small_denominator_flag) AS small_denominator_count
        FROM comparison GROUP BY 1, 2, 3)""",
)
def _(w):
    return summaries.metric_group_summary(w.comparison)


# A row per direction, and one for the only stage and reason (selected) if an event was.
STATUS_COUNTS = "count(DISTINCT direction) + least(count(*), 1)"
TOP_SIZES = f"""SELECT 'top_diffs' AS table_name, count(*) AS row_count FROM tops
        UNION ALL SELECT 'status', count(*) FROM chosen
        UNION ALL SELECT 'status_counts', {STATUS_COUNTS} FROM chosen
        UNION ALL SELECT 'selection_quality', count(DISTINCT event_id) FROM kept_controls
        UNION ALL SELECT 'metric_group_summary', count(DISTINCT row(event_id, report_group, metric_group)) FROM comparison
        UNION ALL SELECT 'top_by_abs_z', count(*) FROM ({oracles.top('abs(z_score_vs_normal) DESC NULLS LAST', None, TRUSTED)})
        UNION ALL SELECT 'top_by_extreme', count(*) FROM ({oracles.top(f'{EXTREME} DESC NULLS LAST', None, TRUSTED)})"""


@register("finalize", kinds(s="table_name", i="row_count"), TOPPED, f"({TOP_SIZES})")
def _(w):
    return table_sizes(w.final)


# --- review ----------------------------------------------------------------------------------------


@register(
    "review_flags",
    kinds(
        s=f"event_id rank_type {PLACE}",
        i="rank signed_value direction_normalized_sign",
        b="denominator_risk_flag unstable_metric_flag",
        d="percentile_extremeness",
    ),
    REVIEWED,
    "flagged_tops",
)
def _(w):
    return review.review_flags(w.final["top_diffs"])


@register(
    "signed_normalize",
    kinds(s="event_direction", i="signed_value direction_normalized_sign row_count"),
    REVIEWED,
    "(SELECT event_direction, signed_value, direction_normalized_sign, count(*) AS row_count FROM flagged_all GROUP BY 1, 2, 3)",
)
def _(w):
    keys = ("event_direction", "signed_value", "direction_normalized_sign")
    return review.review_flags(w.comparison).groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))


SIGN_POLICY = """CASE WHEN metric_name LIKE '%abs%' THEN 'no_directional_sign'
        WHEN metric_group = 'unstable' OR metric_name LIKE '%.relative_change' THEN 'unstable_no_primary_sign'
        WHEN metric_group = 'context' THEN 'context_no_signal_sign'
        WHEN metric_group = 'price_dislocation' AND (metric_name LIKE '%return_bps%' OR metric_name LIKE '%mid_diff_bps') THEN 'direction_normalized'
        ELSE 'observed_signed' END AS expected_sign_policy"""


@register(
    "expected_sign_policy",
    kinds(s="metric_group metric_name expected_sign_policy"),
    COMPARED,
    f"(SELECT DISTINCT metric_group, metric_name, {SIGN_POLICY} FROM comparison)",
)
def _(w):
    metrics = w.comparison.select("metric_group", "metric_name").distinct()
    return metrics.withColumn(
        "expected_sign_policy", taxonomy.expected_sign_policy(F.col("metric_group"), F.col("metric_name"))
    )


PROXIMITY = """CASE WHEN window_label IN ('last_10s', 'bucket_10_0s') THEN 'late_reaction'
        WHEN window_label IN ('last_30s', 'bucket_30_10s') THEN 'event_proximate' ELSE 'earlier' END"""
RELEVANCE = """CASE WHEN exchange = 'click' THEN 'click_exchange' WHEN exchange_pair LIKE '%click%' THEN 'click_pair'
        WHEN exchange_pair IS NOT NULL THEN 'non_click_pair' ELSE 'no_click_reference' END"""


def _labelled(w: Workspace, label: str) -> DataFrame:
    rows = review.metric_relevance(w.final["top_diffs"], "Click")
    return rows.groupBy("event_id", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("row_count"))


@register(
    "window_proximity",
    kinds(s="event_id label", i="row_count"),
    REVIEWED,
    f"(SELECT event_id, {PROXIMITY} AS label, count(*) AS row_count FROM tops GROUP BY 1, 2)",
)
def _(w):
    return _labelled(w, "window_proximity")


@register(
    "entity_relevance",
    kinds(s="event_id label", i="row_count"),
    REVIEWED,
    f"(SELECT event_id, {RELEVANCE} AS label, count(*) AS row_count FROM tops GROUP BY 1, 2)",
)
def _(w):
    return _labelled(w, "entity_relevance")


METRIC = kinds(s=" ".join(review.METRIC_IDENTITY))


@register(
    "metric_recurrence",
    {
        **METRIC,
        **kinds(
            i="n_events_seen_in_top_k n_up_events_seen n_down_events_seen denominator_risk_event_count unstable_event_count source_event_count",
            d="median_rank median_abs_diff_vs_mean median_abs_z_score median_percentile_extremeness",
            s="direction_normalized_sign_consistency recommendation",
        ),
    },
    f"{REVIEWED},{RECURRENCE}",
    f"(SELECT *, {oracles.SIGN_LABEL} AS direction_normalized_sign_consistency, {policy('policy_bucket')} AS recommendation FROM recurring)",
)
def _(w):
    return w.reviewed["metric_recurrence"]


CONSISTENCY = f"""(SELECT {IDENTITY}, count(*) FILTER (event_direction = 'UP' AND signed_value > 0) AS up_positive_count,
        count(*) FILTER (event_direction = 'UP' AND signed_value < 0) AS up_negative_count,
        count(*) FILTER (event_direction = 'DOWN' AND signed_value > 0) AS down_positive_count,
        count(*) FILTER (event_direction = 'DOWN' AND signed_value < 0) AS down_negative_count,
        count(*) FILTER (signed_value > 0) AS observed_positive_count, count(*) FILTER (signed_value < 0) AS observed_negative_count,
        count(*) FILTER (signed_value = 0) AS observed_zero_count, count(*) FILTER (direction_normalized_sign > 0) AS aligned,
        count(*) FILTER (direction_normalized_sign < 0) AS opposed FROM flagged_all GROUP BY ALL)"""


@register(
    "direction_consistency",
    {
        **METRIC,
        **kinds(
            i="up_positive_count up_negative_count down_positive_count down_negative_count observed_positive_count observed_negative_count observed_zero_count",
            d="sign_consistency_rate",
            s="expected_sign_policy direction_normalized_sign",
        ),
    },
    REVIEWED,
    f"""(SELECT *, {SIGN_POLICY}, CASE WHEN aligned + opposed > 0 THEN greatest(aligned, opposed) / (aligned + opposed)::DOUBLE END AS sign_consistency_rate,
        {oracles.SIGN_LABEL} AS direction_normalized_sign FROM {CONSISTENCY})""",
)
def _(w):
    return w.reviewed["direction_consistency"]


DOMINANCE = """(SELECT report_group, rank_type, count(*) FILTER (metric_group = 'context') AS context_metric_count,
        count(*) FILTER (metric_group = 'signal_candidate') AS signal_candidate_count,
        count(*) FILTER (metric_group = 'price_dislocation') AS price_dislocation_count,
        count(*) FILTER (metric_group = 'unstable') AS unstable_count, count(*) FILTER (denominator_risk_flag) AS denominator_risk_count,
        count(*)::DOUBLE AS n FROM flagged_tops GROUP BY 1, 2)"""


@register(
    "context_dominance",
    kinds(
        s="report_group rank_type dominant_metric_group recommended_action",
        i="context_metric_count signal_candidate_count price_dislocation_count unstable_count denominator_risk_count",
        d="context_share unstable_share denominator_risk_share",
    ),
    REVIEWED,
    f"""(SELECT *, context_metric_count / n AS context_share, unstable_count / n AS unstable_share, denominator_risk_count / n AS denominator_risk_share,
        CASE greatest(context_metric_count, signal_candidate_count, price_dislocation_count, unstable_count)
          WHEN context_metric_count THEN 'context' WHEN signal_candidate_count THEN 'signal_candidate'
          WHEN price_dislocation_count THEN 'price_dislocation' ELSE 'unstable' END AS dominant_metric_group,
        CASE WHEN context_metric_count / n >= 0.5 THEN 'review_context_as_filter'
          WHEN unstable_count > 0 OR denominator_risk_count > 0 THEN 'demote_unstable_or_denominator_risk'
          ELSE 'review_signal_candidate_content' END AS recommended_action FROM {DOMINANCE})""",
)
def _(w):
    return w.reviewed["context_dominance"]


def _sql_presence(*tokens: str) -> str:
    hits = " OR ".join(f"metric_name LIKE '%{token}%'" for token in tokens)
    return (
        f"CASE WHEN count(*) FILTER ({hits}) > 0 THEN 'present_rows=' || count(*) FILTER ({hits}) "
        "ELSE 'not_observed_in_review_rows' END"
    )


@register(
    "event_narrative",
    kinds(
        s="event_id symbol direction dominant_exchange_pattern cross_exchange_pattern book_spread_pattern trade_flow_pattern "
        "price_return_pattern normal_sample_quality metric_anomalies suspected_late_reaction_flags",
        i="event_rank",
        t="event_start_ts event_end_ts",
    ),
    REVIEWED,
    f"""(SELECT c.event_id, c.symbol, c.direction, c.event_rank, {ntz("event_start_bucket", FINE.bucket_seconds)} AS event_start_ts,
        {ntz("event_end_bucket", FINE.bucket_seconds)} AS event_end_ts, t.* EXCLUDE (event_id),
        'selected_normal_count_valid' AS normal_sample_quality
        FROM chosen c JOIN (SELECT event_id,
          array_to_string(list_sort(list(DISTINCT exchange) FILTER (exchange IS NOT NULL)), ',') AS dominant_exchange_pattern,
          array_to_string(list_sort(list(DISTINCT exchange_pair) FILTER (exchange_pair IS NOT NULL)), ',') AS cross_exchange_pattern,
          coalesce(array_to_string(list_sort(list(DISTINCT window_label) FILTER (window_label IN ('last_10s', 'bucket_10_0s'))), ','), '') AS suspected_late_reaction_flags,
          {_sql_presence("book", "spread")} AS book_spread_pattern, {_sql_presence("trade_imbalance", "trade_count")} AS trade_flow_pattern,
          {_sql_presence("return", "mid_diff")} AS price_return_pattern,
          'denominator_risk_rows=' || count(*) FILTER (denominator_risk_flag) || ';unstable_rows=' || count(*) FILTER (unstable_metric_flag) AS metric_anomalies
          FROM flagged_tops GROUP BY 1) t USING (event_id))""",
)
def _(w):
    return w.reviewed["event_narrative"]


POLICY_COLUMNS = kinds(
    s="metric_name metric_group exchange exchange_pair window_label policy_bucket reason denominator_risk_policy",
    b="is_feature_candidate",
)
POLICY_SQL = f"""(SELECT DISTINCT metric_name, metric_group, exchange, exchange_pair, window_label, {policy("policy_bucket")} AS policy_bucket,
        {policy("reason")} AS reason, {policy("denominator_risk_policy")} AS denominator_risk_policy,
        {policy("policy_bucket")} = 'core_feature' AS is_feature_candidate FROM recurring)"""


@register("metric_policy", POLICY_COLUMNS, f"{REVIEWED},{RECURRENCE}", POLICY_SQL)
def _(w):
    return w.reviewed["metric_policy"]


@register(
    "policy_bucket",
    kinds(s="metric_group policy_bucket", i="metric_count"),
    f"{REVIEWED},{RECURRENCE}",
    f"(SELECT metric_group, policy_bucket, count(*) AS metric_count FROM {POLICY_SQL} GROUP BY 1, 2)",
)
def _(w):
    policies = w.reviewed["metric_policy"]
    return policies.groupBy("metric_group", "policy_bucket").agg(F.count(F.lit(1)).alias("metric_count"))


@register(
    "review",
    kinds(s="table_name", i="row_count"),
    f"{REVIEWED},{RECURRENCE}",
    f"""(SELECT 'metric_recurrence' AS table_name, count(*) AS row_count FROM recurring
        UNION ALL SELECT 'direction_consistency', count(*) FROM {CONSISTENCY} UNION ALL SELECT 'context_dominance', count(*) FROM {DOMINANCE}
        UNION ALL SELECT 'event_narrative', count(*) FROM chosen UNION ALL SELECT 'metric_policy', count(*) FROM {POLICY_SQL})""",
)
def _(w):
    return table_sizes(w.reviewed)


# --- contracts -------------------------------------------------------------------------------------

CHECK = kinds(s="check", b="passed", i="observed expected")


def checked(name: str, label: str, expectation, sql_observed: str, sql_expected: str = "0"):
    """A query for one expectation on the comparison table."""

    @register(
        name,
        CHECK,
        COMPARED,
        f"(SELECT '{label}' AS \"check\", ({sql_observed}) = {sql_expected} AS passed, ({sql_observed}) AS observed, {sql_expected} AS expected FROM comparison)",
    )
    def _(w):
        return contracts.check(w.comparison, [expectation()])


# Values outside the domain, and values of the domain that are never seen.
DOMAIN_OBSERVED = """count(*) FILTER (metric_group NOT IN ('context', 'signal_candidate', 'price_dislocation'))
        + 3 - count(DISTINCT metric_group) FILTER (metric_group IN ('context', 'signal_candidate', 'price_dislocation'))"""
ALL_ROWS = sum(ROWS_PER_EVENT.values()) * FINE.max_events
checked("expect_count", "count", lambda: contracts.expect_count(ALL_ROWS), "count(*)", str(ALL_ROWS))
checked(
    "expect_no_null",
    "no_null:normal_stddev",
    lambda: contracts.expect_no_null("normal_stddev"),
    "count(*) FILTER (normal_stddev IS NULL)",
)
checked(
    "expect_abs_diff",
    "abs_diff:absolute_diff_vs_mean",
    lambda: contracts.expect_abs_diff("signed_diff_vs_mean", "absolute_diff_vs_mean"),
    "count(*) FILTER (absolute_diff_vs_mean < 0 OR abs(abs(signed_diff_vs_mean) - absolute_diff_vs_mean) > 1e-9)",
)
checked(
    "expect_sample_count",
    "sample_count:normal_sample_count",
    lambda: contracts.expect_sample_count("normal_sample_count", FINE.controls_per_event),
    f"count(*) FILTER (normal_sample_count IS DISTINCT FROM {FINE.controls_per_event})",
)
checked(
    "expect_single_row",
    "single:report_group,metric_group",
    lambda: contracts.expect_single_row(["report_group", "metric_group"]),
    "CASE WHEN count(DISTINCT row(report_group, metric_group)) = 1 THEN 1 ELSE 0 END",
    "1",
)
checked(
    "expect_domain",
    "domain:metric_group",
    lambda: contracts.expect_domain("metric_group", ["context", "signal_candidate", "price_dislocation"]),
    DOMAIN_OBSERVED,
)


@register(
    "expect_formula",
    kinds(s="event_id report_group metric_group", i="expected_count observed_count"),
    TOPPED,
    f"""(SELECT event_id, report_group, metric_group, e AS expected_count, o AS observed_count
        FROM (SELECT event_id, report_group, metric_group, 3 * least(count(*), {FINE.top_n + 1}) AS e FROM comparison GROUP BY 1, 2, 3)
        FULL OUTER JOIN (SELECT event_id, report_group, metric_group, count(*) AS o FROM tops GROUP BY 1, 2, 3)
        USING (event_id, report_group, metric_group) WHERE coalesce(e, -1) <> coalesce(o, -1))""",
)
def _(w):
    """Against one rank more than was kept, so that every larger group is reported."""
    return summaries.top_diff_reconcile(w.comparison, w.final["top_diffs"], FINE.top_n + 1)


METADATA = ("window_id", "event_id", "direction")
# Tables whose rows must stem from the same windows, or events, with the same direction.
SAME_METADATA = {
    "own_pair": ("o_entity", "o_pair", METADATA),
    "own_change": ("o_entity", "o_change", METADATA),
    "control_pair": ("c_entity", "c_pair", METADATA),
    "control_change": ("c_entity", "c_change", METADATA),
    "own_control": ("o_entity", "c_entity", METADATA[1:]),
}


def mismatch_sql(name: str, left: str, right: str, columns: tuple[str, ...]) -> str:
    listed = ", ".join(columns)
    sides = " UNION ALL ".join(
        f"SELECT '{name}' AS tables, concat_ws('|', {listed}) AS row_key, '{side}' AS only_in FROM (SELECT {listed} FROM {one} EXCEPT SELECT {listed} FROM {other})"
        for side, one, other in (("left", left, right), ("right", right, left))
    )
    return sides


@register(
    "expect_same_metadata",
    kinds(s="tables row_key only_in"),
    COMPARED,
    "(" + " UNION ALL ".join(mismatch_sql(name, *parts) for name, parts in SAME_METADATA.items()) + ")",
)
def _(w):
    tables = {f"{side}_{name}": table for side, held in (("o", w.own), ("c", w.other)) for name, table in held.items()}
    found = []
    for name, (left, right, columns) in SAME_METADATA.items():
        differing = contracts.metadata_mismatches(tables[left], tables[right], columns)
        found.append(differing.select(F.lit(name).alias("tables"), F.concat_ws("|", *columns).alias("row_key"), "only_in"))
    return compare.union_reports(found)


@register(
    "expect_dense",
    kinds(s="window_id exchange symbol", i="min_offset max_offset row_count"),
    FINE_DETECTION + "," + oracles.EVENT_WINDOWS,
    f"""(SELECT w.window_id, m.exchange, m.symbol, min(window_end_bucket - bucket) AS min_offset, max(window_end_bucket - bucket) AS max_offset,
        count(*) AS row_count FROM own_windows w JOIN market m ON bucket >= window_end_bucket - {LOOKBACK} AND bucket < window_end_bucket
        GROUP BY 1, 2, 3 HAVING count(*) <> {LOOKBACK})""",
)
def _(w):
    """On the sparse rows, so that there is something to report; the panel itself has no violations."""
    sparse = panel.window_buckets(w.market["market"], w.own_windows, LOOKBACK, span_buckets=FINE.span)
    return contracts.dense_violations(
        sparse.withColumn("second_before_event", F.col("window_end_bucket") - F.col("bucket")), LOOKBACK
    )


CURATED = ", ".join(f"('{name}', '{source}')" for name, source in profiles.CHANGE_SOURCES.items())


@register(
    "expect_curated",
    kinds(s="metric_name source", b="present", i="row_count"),
    EVENT_PROFILES,
    f"""(SELECT c.metric_name, c.source, count(t.metric_name) > 0 AS present, count(t.metric_name) AS row_count
        FROM (VALUES {CURATED}) c(metric_name, source) LEFT JOIN o_change t USING (metric_name) GROUP BY 1, 2)""",
)
def _(w):
    """Each curated change metric: whether its source is a column of the profile and rows of it exist."""
    missing = contracts.expect_curated(w.own["entity"], profiles.CHANGE_SOURCES.values())
    curated = w.spark.createDataFrame(list(profiles.CHANGE_SOURCES.items()), "metric_name string, source string")
    seen = w.own["change"].groupBy("metric_name").agg(F.count(F.lit(1)).alias("row_count"))
    rows = F.coalesce("row_count", F.lit(0))
    return curated.join(seen, "metric_name", "left").select(
        "metric_name", "source", (~F.col("source").isin(*missing, "") & (rows > 0)).alias("present"), rows.alias("row_count")
    )
