"""The SQL every registered query must agree with, built from shared common table expressions."""

from __future__ import annotations

from registry.settings import FINE, HOURLY, LOOKBACK, RAW_LOOKBACK

# Fixed values, written out here too, so that the SQL does not take them from what it checks.
ENTITY_METRICS = (
    "seconds_observed",
    "seconds_with_trades",
    "seconds_with_bbo_update",
    "seconds_forward_filled_bbo",
    "trade_count_sum",
    "trade_count_per_second_avg",
    "trade_count_per_second_max",
    "trade_volume_sum",
    "trade_notional_sum",
    "buy_qty_sum",
    "sell_qty_sum",
    "trade_imbalance_qty_sum",
    "trade_imbalance_qty_per_second",
    "trade_imbalance_qty_ratio",
    "last_trade_return_bps",
    "last_mid_return_bps",
    "avg_spread_bps_mean",
    "avg_spread_bps_max",
    "last_spread_bps_last",
    "avg_book_imbalance_mean",
    "last_book_imbalance_last",
    "bbo_quote_age_seconds_max",
)
PAIR_METRICS = (
    "avg_mid_diff_bps",
    "max_abs_mid_diff_bps",
    "last_mid_diff_bps",
    "last_abs_mid_diff_bps",
    "seconds_compared",
)
CHANGE_FIELDS = (
    "absolute_change",
    "relative_change",
)
SIGNAL_CANDIDATE = "signal_candidate"
PRICE_DISLOCATION = "price_dislocation"
METRICS_BY_GROUP = {
    "context": (
        "seconds_observed",
        "seconds_with_trades",
        "seconds_with_bbo_update",
        "seconds_forward_filled_bbo",
        "seconds_compared",
        "trade_count_sum",
        "trade_count_per_second_avg",
        "trade_count_per_second_max",
        "trade_volume_sum",
        "trade_notional_sum",
        "buy_qty_sum",
        "sell_qty_sum",
        "bbo_quote_age_seconds_max",
        "trade_count_per_second.absolute_change",
    ),
    "signal_candidate": (
        "buy_trade_count",
        "sell_trade_count",
        "trade_imbalance_qty_sum",
        "trade_imbalance_qty_per_second",
        "trade_imbalance_qty_ratio",
        "buy_notional",
        "sell_notional",
        "avg_spread_bps_mean",
        "avg_spread_bps_max",
        "last_spread_bps_last",
        "avg_book_imbalance_mean",
        "last_book_imbalance_last",
        "trade_imbalance_qty_per_second.absolute_change",
        "avg_spread_bps.absolute_change",
        "avg_book_imbalance.absolute_change",
    ),
    "price_dislocation": (
        "last_trade_return_bps",
        "last_mid_return_bps",
        "avg_mid_diff_bps",
        "max_abs_mid_diff_bps",
        "last_mid_diff_bps",
        "last_abs_mid_diff_bps",
    ),
}
CHANGE_SOURCES = {
    "trade_count_per_second": "trade_count_per_second_avg",
    "trade_imbalance_qty_per_second": "trade_imbalance_qty_per_second",
    "avg_spread_bps": "avg_spread_bps_mean",
    "avg_book_imbalance": "avg_book_imbalance_mean",
}

VENUES = FINE.exchanges
PAIRS = [(a, b) for i, a in enumerate(VENUES) for b in VENUES[i + 1 :]]
VENUE_LIST = ", ".join(f"'{name}'" for name in VENUES)
QUOTE_LAST = ("bid_price", "ask_price", "bid_qty", "ask_qty", "mid_price", "spread", "spread_bps", "book_imbalance")


def us(seconds: float) -> int:
    return int(seconds * 1_000_000)


def ntz(bucket: str, seconds: float) -> str:
    return f"make_timestamp(({bucket}) * {us(seconds)})"


def day(ts: str) -> str:
    return f"strftime({ts}, '%Y%m%d')"


# --- sources -----------------------------------------------------------------------------------

BASE = """
priced AS (
  SELECT *, 100.0::DOUBLE + floor(value * 2) / 128.0::DOUBLE AS price
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
),
raw_ticks AS (
  SELECT lower(event_type) AS exchange, 'IDX' AS symbol, ts AS ts_event, ts + to_milliseconds(k) AS ts_recv, price,
         (k + 1)::DOUBLE AS qty, event_id AS seq, event_id::VARCHAR AS trade_id,
         ['Buy', 'SELL ', 'b', 's', 'unknown'][(user_id % 5 + 1)::INT] AS side_raw,
         CASE WHEN user_id % 5 IN (0, 2) THEN 'buy' WHEN user_id % 5 IN (1, 3) THEN 'sell' END AS side
  FROM priced
),
raw_quotes AS (
  SELECT *, CASE WHEN mid_price <> 0 THEN spread / mid_price END * 10000.0::DOUBLE AS spread_bps,
         CASE WHEN bid_qty + ask_qty <> 0 THEN (bid_qty - ask_qty) / (bid_qty + ask_qty) END AS book_imbalance
  FROM (SELECT *, (bid_price + ask_price) / 2.0::DOUBLE AS mid_price, ask_price - bid_price AS spread
        FROM (SELECT CASE event_type WHEN 'click' THEN 'error' WHEN 'error' THEN 'purchase' WHEN 'purchase' THEN 'signup'
                       WHEN 'signup' THEN 'view' WHEN 'view' THEN 'click' END AS exchange, 'IDX' AS symbol,
                     ts AS ts_event, ts + to_milliseconds(k) AS ts_recv, event_id AS seq,
                     price - (k % 5 + 1) / 128.0::DOUBLE AS bid_price, (k % 7 + 1)::DOUBLE AS bid_qty,
                     price + (k % 5 + 1) / 128.0::DOUBLE AS ask_price, (user_id % 5 + 1)::DOUBLE AS ask_qty
              FROM priced))
),
li_ticks AS (
  SELECT lower(l_returnflag) AS exchange, 'LI' AS symbol, l_shipdate AS ts_event, l_shipdate AS ts_recv,
         l_extendedprice AS price, l_quantity AS qty, l_orderkey * 8 + l_linenumber AS seq,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trade_id, l_linestatus AS side
  FROM lineitem
),
catalog AS (
  SELECT date, exchange, stream, symbol, peak >= 60.0 AS available, root || '/data.parquet' AS data_key,
         root || '/meta.json' AS meta_key, root || '/quality_day.json' AS quality_day_key
  FROM (SELECT *, 'exchange=' || exchange || '/stream=' || stream || '/symbol=' || symbol || '/date=' || date AS root
        FROM (SELECT strftime(ts, '%Y%m%d') AS date, event_type AS exchange,
                     CASE WHEN value >= 150.0 THEN 'bbo' ELSE 'trade' END AS stream, 'IDXUSD' AS symbol, max(value) AS peak
              FROM events GROUP BY ALL))
)"""


UNITS = [2.0**power for power in (18, -18, -54, -90, -126)]


def digit_sums(x: str) -> list[str]:
    """Sums of the five digits to the base 2^36 that a double is cut into: exact, whatever the order of the rows."""
    whole = [f"round_even(({x}) * {1.0 / unit!r}::DOUBLE, 0)" for unit in UNITS]
    digits = [whole[0], *[f"{low} - {high} * {2.0**36!r}::DOUBLE" for high, low in zip(whole, whole[1:])]]
    return [f"sum(CAST({digit} AS BIGINT))" for digit in digits]


def together(digits: list[str]) -> str:
    return "(" + " + ".join(f"CAST({digit} AS DOUBLE) * {unit!r}::DOUBLE" for digit, unit in zip(digits, UNITS)) + ")"


def exact_sum(x: str) -> str:
    return together(digit_sums(x))


def exact_avg(x: str) -> str:
    n = f"nullif(count({x}), 0)"
    sums = digit_sums(x)
    parts = [f"CAST({s} % {n} AS DOUBLE) / CAST({n} AS DOUBLE)" for s in sums]
    return f"({together([f'({s} // {n})' for s in sums])} + {together(parts)})"


def buckets(seconds: float) -> str:
    return f"""
tb AS (
  SELECT epoch_us(ts_event) // {us(seconds)} AS bucket, exchange, symbol, count(*) AS trade_count, sum(qty) AS trade_volume,
         sum(price * qty) AS trade_notional, count(*) FILTER (side = 'buy') AS buy_trade_count,
         count(*) FILTER (side = 'sell') AS sell_trade_count,
         sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) AS buy_qty, sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) AS sell_qty,
         sum(CASE WHEN side = 'buy' THEN price * qty ELSE 0 END) AS buy_notional,
         sum(CASE WHEN side = 'sell' THEN price * qty ELSE 0 END) AS sell_notional,
         arg_min(price, row(ts_event, seq)) AS open_price, arg_max(price, row(ts_event, seq)) AS last_trade_price,
         min(price) AS min_trade_price, max(price) AS max_trade_price,
         sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) - sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) AS trade_imbalance_qty
  FROM raw_ticks GROUP BY 1, 2, 3
),
qb AS (
  SELECT epoch_us(ts_event) // {us(seconds)} AS bucket, exchange, symbol, count(*) AS bbo_update_count,
         max(ts_event) AS last_bbo_update_ts,
         {", ".join(f"arg_max({c}, row(ts_event, seq)) AS last_{c}" for c in QUOTE_LAST)},
         {exact_avg("spread_bps")} AS avg_spread_bps, max(spread_bps) AS max_spread_bps, {exact_avg("book_imbalance")} AS avg_book_imbalance
  FROM raw_quotes GROUP BY 1, 2, 3
),
market AS MATERIALIZED (
  SELECT * REPLACE (coalesce(trade_count, 0) AS trade_count, coalesce(bbo_update_count, 0) AS bbo_update_count)
  FROM tb FULL OUTER JOIN qb USING (bucket, exchange, symbol)
),
bars AS MATERIALIZED (
  SELECT bucket, exchange, symbol, open_price, max_trade_price AS high_price, min_trade_price AS low_price,
         last_trade_price AS close_price, trade_count, trade_volume AS volume FROM tb
)"""


def detection(seconds: float, horizon: int, threshold: float) -> str:
    up, down = 1.0 + threshold / 100.0, 1.0 - threshold / 100.0
    return f"""
ahead AS (
  SELECT b.exchange, b.symbol, b.bucket AS start_bucket, b.close_price AS base_price, f.bucket AS touch_bucket,
         f.high_price, f.low_price
  FROM bars b JOIN bars f ON b.exchange = f.exchange AND b.symbol = f.symbol
   AND f.bucket BETWEEN b.bucket + 1 AND b.bucket + {horizon}
),
touch AS (
  SELECT exchange, symbol, start_bucket, base_price,
         min(touch_bucket) FILTER (high_price >= base_price * {up!r}::DOUBLE) AS up_bucket,
         arg_min(high_price, touch_bucket) FILTER (high_price >= base_price * {up!r}::DOUBLE) AS up_price,
         min(touch_bucket) FILTER (low_price <= base_price * {down!r}::DOUBLE) AS down_bucket,
         arg_min(low_price, touch_bucket) FILTER (low_price <= base_price * {down!r}::DOUBLE) AS down_price
  FROM ahead GROUP BY ALL
  HAVING up_bucket IS NOT NULL OR down_bucket IS NOT NULL
),
resolved AS (
  SELECT *, CASE WHEN up_bucket = down_bucket THEN 'AMBIGUOUS' WHEN down_bucket IS NULL OR up_bucket < down_bucket THEN 'UP'
                 ELSE 'DOWN' END AS direction FROM touch
),
cands AS MATERIALIZED (
  SELECT exchange, symbol, direction, direction = 'AMBIGUOUS' AS is_ambiguous, start_bucket, end_bucket, base_price, touch_price,
         (end_bucket - start_bucket) * {int(seconds)} AS duration_seconds,
         (touch_price / base_price - 1.0::DOUBLE) * 100.0::DOUBLE AS move_pct
  FROM (SELECT *, CASE direction WHEN 'DOWN' THEN down_bucket ELSE up_bucket END AS end_bucket,
               CASE direction WHEN 'UP' THEN up_price WHEN 'DOWN' THEN down_price END AS touch_price FROM resolved)
)"""


def clustered(
    name: str, source: str, horizon: int, seconds: float, scope: str = "range", anchored: bool = False
) -> str:
    """Events of ``source`` candidates under ``name``."""
    key = "exchange, lower(symbol), direction, is_ambiguous"
    if anchored:
        # Walk the candidates of each key in order, opening a cluster past the horizon of the last.
        grouping = f"""
{name}_ordered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start_bucket) AS n FROM {source}
),
{name}_walk AS (
  SELECT exchange, symbol, direction, is_ambiguous, n, start_bucket, start_bucket AS opened FROM {name}_ordered WHERE n = 1
  UNION ALL
  SELECT o.exchange, o.symbol, o.direction, o.is_ambiguous, o.n, o.start_bucket,
         CASE WHEN o.start_bucket - w.opened > {horizon} THEN o.start_bucket ELSE w.opened END
  FROM {name}_walk w JOIN {name}_ordered o ON o.exchange = w.exchange AND o.symbol = w.symbol AND o.direction = w.direction
   AND o.is_ambiguous = w.is_ambiguous AND o.n = w.n + 1
),
{name}_islands AS (
  SELECT s.*, w.opened AS island FROM {source} s
  JOIN {name}_walk w USING (exchange, symbol, direction, is_ambiguous, start_bucket)
)"""
        values = """arg_min(end_bucket, start_bucket) AS event_end_bucket, arg_min(base_price, start_bucket) AS base_price,
         arg_min(touch_price, start_bucket) AS touch_price, arg_min(move_pct, start_bucket) AS move_pct"""
    else:
        grouping = f"""
{name}_islands AS (
  SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY start_bucket) AS island
  FROM (SELECT *, CASE WHEN start_bucket - lag(start_bucket) OVER (PARTITION BY {key} ORDER BY start_bucket) <= {horizon}
                       THEN 0 ELSE 1 END AS opens FROM {source})
)"""
        values = """max(end_bucket) AS event_end_bucket, arg_min(base_price, start_bucket) AS base_price,
         arg_max(touch_price, row(abs(move_pct), -start_bucket)) FILTER (move_pct IS NOT NULL) AS touch_price,
         arg_max(move_pct, row(abs(move_pct), -start_bucket)) FILTER (move_pct IS NOT NULL) AS move_pct"""
    number = "selected_date, " if scope == "date" else ""
    return f"""{grouping},
{name}_groups AS (
  SELECT exchange, arg_min(symbol, start_bucket) AS symbol, direction, is_ambiguous, island,
         min(start_bucket) AS event_start_bucket, {values}, count(*) AS raw_candidate_count,
         max(start_bucket) AS candidate_group_end_bucket
  FROM {name}_islands GROUP BY exchange, lower(symbol), direction, is_ambiguous, island
),
{name}_numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {number}{key} ORDER BY event_start_bucket) AS group_number
  FROM (SELECT *, {day(ntz("event_start_bucket", seconds))} AS selected_date FROM {name}_groups)
),
{name} AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY event_start_bucket, exchange, lower(symbol), direction, is_ambiguous, event_id) AS event_rank
  FROM (SELECT *, printf('%s_%s_%s_%s%s_%03d', exchange, lower(symbol), selected_date, lower(direction),
                         CASE WHEN is_ambiguous THEN '_ambiguous' ELSE '' END, group_number) AS event_id FROM {name}_numbered)
)"""


EVENT_COLUMNS = {
    "event_id": "s",
    "event_rank": "i",
    "exchange": "s",
    "symbol": "s",
    "direction": "s",
    "is_ambiguous": "b",
    "event_start_bucket": "i",
    "event_end_bucket": "i",
    "base_price": "d",
    "touch_price": "d",
    "move_pct": "d",
    "selected_date": "s",
    "group_number": "i",
    "raw_candidate_count": "i",
    "candidate_group_end_bucket": "i",
}

FINE_DETECTION = ",".join(
    [
        BASE,
        buckets(FINE.bucket_seconds),
        detection(FINE.bucket_seconds, FINE.horizon, FINE.threshold_pct),
        "\nclear AS (SELECT * FROM cands WHERE NOT is_ambiguous)",
        clustered("evt", "clear", FINE.horizon, FINE.bucket_seconds),
    ]
)
HOURLY_DETECTION = ",".join(
    [
        BASE,
        buckets(HOURLY.bucket_seconds),
        detection(HOURLY.bucket_seconds, HOURLY.horizon, HOURLY.threshold_pct),
        "\nclear AS (SELECT * FROM cands WHERE NOT is_ambiguous)",
    ]
)

# --- windows, panels and profiles ----------------------------------------------------------------

TRADE_SUMS = (
    "trade_count",
    "trade_volume",
    "trade_notional",
    "buy_trade_count",
    "sell_trade_count",
    "buy_qty",
    "sell_qty",
    "buy_notional",
    "sell_notional",
    "trade_imbalance_qty",
)
PANEL_PRICES = ("last_trade_price", "min_trade_price", "max_trade_price")
QUOTE_AVERAGES = ("avg_spread_bps", "max_spread_bps", "avg_book_imbalance")


def panel(prefix: str, windows: str) -> str:
    """Panel of ``windows`` (window_id, event_id, direction, window_end_bucket) as ``{prefix}panel``."""
    ffill = "OVER (PARTITION BY window_id, exchange, symbol ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
{prefix}present AS (
  SELECT DISTINCT w.window_id, w.event_id, w.direction, w.window_end_bucket, m.exchange, m.symbol
  FROM {windows} w JOIN market m ON m.bucket >= w.window_end_bucket - {LOOKBACK} AND m.bucket < w.window_end_bucket
),
{prefix}grid AS (
  SELECT p.*, p.window_end_bucket - o.second_before_event AS bucket, o.second_before_event
  FROM {prefix}present p CROSS JOIN (SELECT unnest(range(1, {LOOKBACK + 1})) AS second_before_event) o
),
{prefix}panel AS MATERIALIZED (
  SELECT g.window_id, g.event_id, g.direction, g.exchange, g.symbol, g.bucket, g.second_before_event,
         {", ".join(f"coalesce(m.{c}, 0) AS {c}" for c in (*TRADE_SUMS, "bbo_update_count"))},
         {", ".join(f"m.{c}" for c in (*PANEL_PRICES, *QUOTE_AVERAGES))},
         {", ".join(f"last_value(m.last_{c} IGNORE NULLS) {ffill.replace('window_id', 'g.window_id').replace('exchange', 'g.exchange').replace('symbol', 'g.symbol').replace('BY bucket', 'BY g.bucket')} AS last_{c}" for c in QUOTE_LAST)},
         last_value(m.last_bbo_update_ts IGNORE NULLS) OVER (PARTITION BY g.window_id, g.exchange, g.symbol ORDER BY g.bucket
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_bbo_update_ts,
         coalesce(m.bbo_update_count, 0) > 0 AS has_bbo_update
  FROM {prefix}grid g LEFT JOIN market m ON m.bucket = g.bucket AND m.exchange = g.exchange AND m.symbol = g.symbol
),
{prefix}full AS MATERIALIZED (
  SELECT *, NOT has_bbo_update AND last_bbo_update_ts IS NOT NULL AS is_bbo_forward_filled,
         (bucket - epoch_us(last_bbo_update_ts) // {us(FINE.bucket_seconds)}) * {int(FINE.bucket_seconds)} AS bbo_quote_age_seconds
  FROM {prefix}panel
)"""


WINDOW_VALUES = ", ".join(f"('{w.mode}', '{w.label}', {w.first}, {w.last})" for w in FINE.windows)


def profiles(prefix: str) -> str:
    tiles = sorted((w for w in FINE.windows if w.mode == "bucket"), key=lambda w: -w.last)
    steps = ", ".join(f"('{a.label}', '{b.label}')" for a, b in zip(tiles, tiles[1:], strict=False))
    unfolded = " UNION ALL ".join(
        f"SELECT window_id, event_id, direction, exchange, symbol, window_label, '{metric}' AS metric_name, "
        f"{source}::DOUBLE AS metric_value FROM {prefix}entity WHERE window_mode = 'bucket'"
        for metric, source in CHANGE_SOURCES.items()
    )
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
    return f"""
{prefix}placed AS (
  SELECT p.*, w.window_mode, w.window_label FROM {prefix}full p
  JOIN (VALUES {WINDOW_VALUES}) w(window_mode, window_label, lo, hi) ON p.second_before_event BETWEEN w.lo AND w.hi
),
{prefix}measured AS (
  SELECT window_id, event_id, direction, exchange, symbol, window_mode, window_label,
         count(*) AS seconds_observed, count(*) FILTER (trade_count > 0) AS seconds_with_trades,
         count(*) FILTER (bbo_update_count > 0) AS seconds_with_bbo_update,
         count(*) FILTER (is_bbo_forward_filled) AS seconds_forward_filled_bbo,
         sum(trade_count) AS trade_count_sum, avg(trade_count) AS trade_count_per_second_avg,
         max(trade_count) AS trade_count_per_second_max, sum(trade_volume) AS trade_volume_sum,
         sum(trade_notional) AS trade_notional_sum, {exact_sum("buy_qty")} AS buy_qty_sum, {exact_sum("sell_qty")} AS sell_qty_sum,
         {exact_sum("trade_imbalance_qty")} AS trade_imbalance_qty_sum, {exact_avg("trade_imbalance_qty")} AS trade_imbalance_qty_per_second,
         arg_max_null(last_trade_price, second_before_event) AS first_last_trade_price,
         arg_min_null(last_trade_price, second_before_event) AS last_last_trade_price,
         min(last_trade_price) AS min_last_trade_price, max(last_trade_price) AS max_last_trade_price,
         arg_max_null(last_mid_price, second_before_event) AS first_last_mid_price,
         arg_min_null(last_mid_price, second_before_event) AS last_last_mid_price,
         {exact_avg("avg_spread_bps")} AS avg_spread_bps_mean, max(avg_spread_bps) AS avg_spread_bps_max,
         arg_min_null(last_spread_bps, second_before_event) AS last_spread_bps_last,
         {exact_avg("avg_book_imbalance")} AS avg_book_imbalance_mean,
         arg_min_null(last_book_imbalance, second_before_event) AS last_book_imbalance_last,
         max(bbo_quote_age_seconds) AS bbo_quote_age_seconds_max
  FROM {prefix}placed GROUP BY 1, 2, 3, 4, 5, 6, 7
),
{prefix}entity AS MATERIALIZED (
  SELECT *, CASE WHEN buy_qty_sum + sell_qty_sum <> 0 THEN trade_imbalance_qty_sum / (buy_qty_sum + sell_qty_sum) END
           AS trade_imbalance_qty_ratio,
         CASE WHEN first_last_trade_price <> 0 THEN (last_last_trade_price / first_last_trade_price - 1.0::DOUBLE) * 1e4 END
           AS last_trade_return_bps,
         CASE WHEN first_last_mid_price <> 0 THEN (last_last_mid_price / first_last_mid_price - 1.0::DOUBLE) * 1e4 END
           AS last_mid_return_bps
  FROM {prefix}measured
),
{prefix}mids AS (
  SELECT a.window_id, a.event_id, a.direction, lower(a.symbol) AS symbol_key, a.second_before_event,
         p.a || '__' || p.b AS exchange_pair, p.a AS exchange_a, p.b AS exchange_b,
         a.last_mid_price AS mid_a, b.last_mid_price AS mid_b,
         CASE WHEN b.last_mid_price <> 0 THEN (a.last_mid_price - b.last_mid_price) / b.last_mid_price * 1e4 END AS mid_diff_bps
  FROM {prefix}full a JOIN (VALUES {pairs}) p(a, b) ON a.exchange = p.a
  JOIN {prefix}full b ON b.window_id = a.window_id AND lower(b.symbol) = lower(a.symbol)
   AND b.second_before_event = a.second_before_event AND b.exchange = p.b
  WHERE a.last_mid_price IS NOT NULL AND b.last_mid_price IS NOT NULL
),
{prefix}pair AS MATERIALIZED (
  SELECT window_id, event_id, direction, symbol_key, window_mode, window_label, exchange_pair, exchange_a, exchange_b,
         count(*) AS seconds_compared, {exact_avg("mid_diff_bps")} AS avg_mid_diff_bps, max(abs(mid_diff_bps)) AS max_abs_mid_diff_bps,
         arg_min_null(mid_diff_bps, second_before_event) AS last_mid_diff_bps,
         abs(arg_min_null(mid_diff_bps, second_before_event)) AS last_abs_mid_diff_bps
  FROM {prefix}mids JOIN (VALUES {WINDOW_VALUES}) w(window_mode, window_label, lo, hi) ON second_before_event BETWEEN lo AND hi
  GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9
),
{prefix}tiles AS MATERIALIZED ({unfolded}),
{prefix}change AS MATERIALIZED (
  SELECT a.window_id, a.event_id, a.direction, a.exchange, a.symbol, s.a AS from_bucket, s.b AS to_bucket, a.metric_name,
         a.metric_value AS from_bucket_value, b.metric_value AS to_bucket_value,
         b.metric_value - a.metric_value AS absolute_change,
         CASE WHEN a.metric_value <> 0 THEN (b.metric_value - a.metric_value) / abs(a.metric_value) END AS relative_change
  FROM {prefix}tiles a JOIN (VALUES {steps}) s(a, b) ON a.window_label = s.a
  JOIN {prefix}tiles b ON b.window_label = s.b AND b.window_id = a.window_id AND b.exchange = a.exchange
   AND b.symbol = a.symbol AND b.metric_name = a.metric_name
)"""


EVENT_WINDOWS = """
own_windows AS (SELECT event_id AS window_id, event_id, direction, event_start_bucket AS window_end_bucket FROM evt)"""
EVENT_PROFILES = ",".join([FINE_DETECTION, EVENT_WINDOWS, panel("o_", "own_windows"), profiles("o_")])

# --- controls --------------------------------------------------------------------------------------

SPAN = FINE.span
ANCHORS = f"""
ends AS (
  SELECT max(lo) AS common_start, min(hi) AS common_end
  FROM (SELECT exchange, min(bucket) AS lo, max(bucket) AS hi FROM bars GROUP BY 1)
),
spans AS (
  SELECT span, greatest(common_start, span * {SPAN}) + {FINE.lookback} AS first_anchor,
         least(common_end, (span + 1) * {SPAN}) - {FINE.horizon} AS last_anchor
  FROM (SELECT *, unnest(range(common_start // {SPAN}, common_end // {SPAN} + 1)) AS span FROM ends)
),
all_anchors AS (
  SELECT span, anchor_bucket, first_anchor FROM
    (SELECT span, first_anchor, unnest(range(first_anchor, last_anchor + 1, {FINE.anchor_step})) AS anchor_bucket FROM spans)
),
starts AS (SELECT DISTINCT start_bucket FROM cands),
near AS (
  SELECT a.span, a.anchor_bucket, max(start_bucket) FILTER (start_bucket <= anchor_bucket) AS previous_start,
         min(start_bucket) FILTER (start_bucket >= anchor_bucket) AS next_start,
         min(abs(start_bucket - anchor_bucket)) AS nearest_candidate_distance,
         bool_or(abs(start_bucket - anchor_bucket) <= {FINE.proximity}) AS close_by,
         bool_or(start_bucket > anchor_bucket AND start_bucket <= anchor_bucket + {FINE.horizon}) AS ahead_of,
         bool_or(start_bucket >= anchor_bucket - {FINE.lookback} AND start_bucket < anchor_bucket) AS inside
  FROM all_anchors a LEFT JOIN starts ON true GROUP BY 1, 2
),
excluded AS MATERIALIZED (
  SELECT span, anchor_bucket, previous_start, next_start, nearest_candidate_distance,
         CASE WHEN close_by THEN 'candidate_within_anchor_proximity' WHEN ahead_of THEN 'candidate_inside_post_anchor_horizon'
              WHEN inside THEN 'candidate_inside_normal_window' END AS exclusion_reason
  FROM near
),
act AS MATERIALIZED (
  SELECT a.span, a.anchor_bucket, m.exchange, m.symbol, sum(m.trade_count) AS trade_count_sum,
         coalesce(sum(m.trade_volume), 0) AS trade_volume_sum, coalesce(sum(m.trade_notional), 0) AS trade_notional_sum,
         sum(m.bbo_update_count) AS quote_count_sum
  FROM all_anchors a JOIN market m ON m.bucket >= a.anchor_bucket - {FINE.lookback} AND m.bucket < a.anchor_bucket
  GROUP BY 1, 2, 3, 4
),
sums AS (
  SELECT span, anchor_bucket, exchange, sum(trade_count_sum) AS trade_count_sum, sum(trade_volume_sum) AS trade_volume_sum,
         sum(trade_notional_sum) AS trade_notional_sum
  FROM act WHERE trade_count_sum > 0 GROUP BY 1, 2, 3
),
counted AS (
  SELECT anchor_bucket, sum(trade_count_sum) AS trade_count, sum(quote_count_sum) AS bbo_count,
         count(DISTINCT exchange) FILTER (trade_count_sum > 0) AS trade_exchange_count,
         count(DISTINCT exchange) FILTER (quote_count_sum > 0) AS bbo_exchange_count,
         count(DISTINCT row(exchange, symbol)) AS snapshot_exchange_symbol_count,
         count(DISTINCT exchange) AS snapshot_exchange_count
  FROM act GROUP BY 1
),
rated AS MATERIALIZED (
  SELECT *, CASE WHEN trade_count = 0 THEN 'trade_count_zero' WHEN bbo_count = 0 THEN 'bbo_count_zero'
                 WHEN trade_exchange_count < {len(VENUES)} THEN 'trade_exchange_coverage'
                 WHEN bbo_exchange_count < {len(VENUES)} THEN 'bbo_exchange_coverage'
                 WHEN snapshot_row_count <> {len(VENUES) * LOOKBACK} THEN 'snapshot_row_count'
                 WHEN snapshot_exchange_count < {len(VENUES)} THEN 'snapshot_exchange_coverage' END AS quality_failure
  FROM (SELECT e.*, coalesce(trade_count, 0) AS trade_count, coalesce(bbo_count, 0) AS bbo_count,
               coalesce(trade_exchange_count, 0) AS trade_exchange_count, coalesce(bbo_exchange_count, 0) AS bbo_exchange_count,
               coalesce(snapshot_exchange_symbol_count, 0) AS snapshot_exchange_symbol_count,
               coalesce(snapshot_exchange_count, 0) AS snapshot_exchange_count,
               coalesce(snapshot_exchange_symbol_count, 0) * {LOOKBACK} AS snapshot_row_count
        FROM excluded e LEFT JOIN counted USING (anchor_bucket))
)"""
CONTROLS = f"""
own_activity AS (
  SELECT event_id, exchange, sum(trade_count_sum) AS c, sum(trade_volume_sum) AS v, sum(trade_notional_sum) AS n
  FROM o_entity WHERE window_label = 'last_300s' GROUP BY 1, 2
),
terms AS (
  SELECT e.event_id, s.span, s.anchor_bucket, s.exchange,
         abs(ln(s.trade_count_sum + 1.0) - ln(o.c + 1.0)) + abs(ln(s.trade_volume_sum + 1.0) - ln(o.v + 1.0))
           + abs(ln(s.trade_notional_sum + 1.0) - ln(o.n + 1.0)) AS gap
  FROM evt e JOIN sums s ON s.span = e.event_start_bucket // {SPAN}
  JOIN own_activity o ON o.event_id = e.event_id AND o.exchange = s.exchange
),
dist AS MATERIALIZED (
  SELECT t.event_id, t.span, t.anchor_bucket, r.nearest_candidate_distance,
         sum(gap ORDER BY t.exchange) / {3 * len(VENUES)}.0::DOUBLE AS activity_distance
  FROM terms t JOIN rated r ON r.anchor_bucket = t.anchor_bucket
  WHERE r.exclusion_reason IS NULL AND r.quality_failure IS NULL
  GROUP BY 1, 2, 3, 4 HAVING count(*) = {len(VENUES)}
),
ordered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY activity_distance, nearest_candidate_distance DESC NULLS LAST,
                               anchor_bucket) AS n FROM dist
),
walk AS (
  SELECT event_id, 0::BIGINT AS n, []::BIGINT[] AS kept, false AS taken, NULL::BIGINT AS anchor_bucket
  FROM (SELECT DISTINCT event_id FROM ordered)
  UNION ALL
  SELECT o.event_id, o.n,
         CASE WHEN len(w.kept) < {FINE.controls_per_event} AND len(list_filter(w.kept, lambda a: abs(a - o.anchor_bucket) < {FINE.spacing})) = 0
              THEN list_append(w.kept, o.anchor_bucket) ELSE w.kept END,
         len(w.kept) < {FINE.controls_per_event} AND len(list_filter(w.kept, lambda a: abs(a - o.anchor_bucket) < {FINE.spacing})) = 0,
         o.anchor_bucket
  FROM walk w JOIN ordered o ON o.event_id = w.event_id AND o.n = w.n + 1
),
taken AS MATERIALIZED (
  SELECT o.*, row_number() OVER (PARTITION BY o.event_id ORDER BY o.n) AS sample_rank,
         count(*) OVER (PARTITION BY o.event_id) AS found
  FROM ordered o JOIN walk w ON w.event_id = o.event_id AND w.n = o.n WHERE w.taken
),
controls AS MATERIALIZED (
  SELECT *, printf('%s__normal_%03d', event_id, sample_rank) AS sample_id FROM taken WHERE found = {FINE.controls_per_event}
)"""


def balanced(source: str, n: int) -> str:
    """Direction-balanced members of ``source``: quota per direction in time order, then anyone in time order."""
    order = "event_start_bucket, exchange, lower(symbol), event_id"
    return f"""
quota AS (
  SELECT *, CASE direction WHEN 'UP' THEN place <= {n - n // 2} WHEN 'DOWN' THEN place <= {n // 2} ELSE false END AS first_choice
  FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY {order}) AS place FROM {source})
),
members AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY NOT first_choice, {order}) AS turn FROM quota) WHERE turn <= {n}
)"""


SELECTED = f"""{balanced("evt", FINE.max_events)},
chosen AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (ORDER BY event_id NOT IN (SELECT event_id FROM members), event_start_bucket, exchange,
                                 lower(symbol), event_id) AS selection_order
    FROM evt WHERE event_id IN (SELECT event_id FROM controls))
  WHERE selection_order <= {FINE.max_events}
),
kept_controls AS MATERIALIZED (SELECT * FROM controls WHERE event_id IN (SELECT event_id FROM chosen)),
control_windows AS (
  SELECT sample_id AS window_id, event_id, NULL::VARCHAR AS direction, anchor_bucket AS window_end_bucket FROM kept_controls
)"""
STUDY = ",".join([EVENT_PROFILES, ANCHORS, CONTROLS, SELECTED, panel("c_", "control_windows"), profiles("c_")])

# --- comparison --------------------------------------------------------------------------------------

GROUP_CASE = (
    "CASE WHEN metric_name LIKE '%.relative_change' THEN 'unstable' "
    + " ".join(
        f"WHEN metric_name IN ({', '.join(repr(m) for m in metrics)}) THEN '{group}'"
        for group, metrics in METRICS_BY_GROUP.items()
    )
    + " END"
)
DIMENSIONS = ("exchange", "symbol", "symbol_key", "exchange_pair", "window_mode", "window_label", "from_bucket", "to_bucket")


def long_form(prefix: str, value: str, source: str = "") -> str:
    """All three profile tables as (keys, metric, value)."""
    parts = []
    for metric in ENTITY_METRICS:
        parts.append(
            f"SELECT window_id, event_id, direction, 'exchange_profile' AS report_group, exchange, symbol, lower(symbol) AS symbol_key, "
            f"NULL::VARCHAR AS exchange_pair, window_mode, window_label, NULL::VARCHAR AS from_bucket, NULL::VARCHAR AS to_bucket, "
            f"'{metric}' AS metric_name, {metric}::DOUBLE AS {value}, NULL::DOUBLE AS from_value, NULL::DOUBLE AS to_value FROM {prefix}entity"
        )
    for metric in PAIR_METRICS:
        parts.append(
            f"SELECT window_id, event_id, direction, 'cross_exchange_mid_diff', NULL, NULL, symbol_key, exchange_pair, window_mode, "
            f"window_label, NULL, NULL, '{metric}', {metric}::DOUBLE, NULL, NULL FROM {prefix}pair"
        )
    for field in CHANGE_FIELDS:
        parts.append(
            f"SELECT window_id, event_id, direction, 'bucket_change_profile', exchange, symbol, lower(symbol), NULL, NULL, NULL, "
            f"from_bucket, to_bucket, metric_name || '.{field}', {field}::DOUBLE, from_bucket_value, to_bucket_value FROM {prefix}change"
        )
    return " UNION ALL ".join(parts)


SAMPLES = f"""
own_long AS MATERIALIZED ({long_form("o_", "event_value")}),
other_long AS MATERIALIZED ({long_form("c_", "normal_value")}),
samples AS MATERIALIZED (
  SELECT e.event_id, e.direction AS event_direction, e.report_group, {GROUP_CASE.replace("metric_name", "e.metric_name")} AS metric_group,
         e.metric_name, {", ".join(f"e.{d}" for d in DIMENSIONS)}, n.window_id AS sample_id, e.event_value, n.normal_value,
         e.from_value AS event_from_bucket_value, n.from_value AS normal_from_bucket_value,
         e.to_value AS event_to_bucket_value, n.to_value AS normal_to_bucket_value
  FROM own_long e JOIN other_long n ON n.event_id = e.event_id AND n.report_group = e.report_group AND n.metric_name = e.metric_name
   AND n.symbol_key = e.symbol_key AND {" AND ".join(f"n.{d} IS NOT DISTINCT FROM e.{d}" for d in DIMENSIONS if d not in ("symbol", "symbol_key"))}
)"""


def flags(normal: str) -> str:
    def weak(x: str) -> str:
        return f"({x} IS NULL OR abs({x}) <= 1e-9)"

    relative = (
        f"(metric_name LIKE '%.relative_change' AND ({weak('event_from_bucket_value')} OR {weak('normal_from_bucket_value')}))"
    )
    return (
        f"{weak(normal)} AS ratio_unstable, {relative} AS relative_change_unstable, "
        f"({weak(normal)} OR {relative}) AS small_denominator_flag"
    )


COMPARISON = f"""
spread_of AS (
  SELECT event_id, event_direction, report_group, metric_group, metric_name, {", ".join(DIMENSIONS)}, event_value,
         event_from_bucket_value, event_to_bucket_value, {exact_avg("normal_value")} AS normal_mean,
         quantile_disc(normal_value, 0.5) AS normal_median, min(normal_value) AS normal_min, max(normal_value) AS normal_max,
         quantile_disc(normal_value, 0.25) AS normal_p25, quantile_disc(normal_value, 0.75) AS normal_p75,
         list_sort(list(normal_value) FILTER (normal_value IS NOT NULL)) AS normal_values, count(*) AS normal_sample_count, count(normal_value) AS normal_non_null_count,
         count(*) FILTER (abs(normal_value) <= 1e-9) AS normal_zero_or_near_zero_count,
         count(*) FILTER (normal_value <= event_value) AS not_above,
         {exact_avg("normal_from_bucket_value")} AS normal_from_bucket_value, {exact_avg("normal_to_bucket_value")} AS normal_to_bucket_value
  FROM samples GROUP BY ALL
),
deviated AS (
  SELECT *, CASE WHEN len(normal_values) > 1 THEN
    sqrt(list_sum([(v - normal_mean) * (v - normal_mean) FOR v IN normal_values]) / (len(normal_values) - 1)) END AS normal_stddev
  FROM spread_of
),
compared AS (
  SELECT *, event_value - normal_mean AS signed_diff_vs_mean, abs(event_value - normal_mean) AS absolute_diff_vs_mean,
         CASE WHEN normal_mean <> 0 THEN event_value / normal_mean END AS ratio_vs_mean,
         CASE WHEN normal_stddev <> 0 THEN (event_value - normal_mean) / normal_stddev END AS z_score_vs_normal,
         CASE WHEN event_value IS NOT NULL AND normal_non_null_count > 0 THEN not_above / normal_non_null_count::DOUBLE END
           AS normal_percentile_rank, {flags("normal_mean")}
  FROM deviated
),
comparison AS MATERIALIZED (SELECT * FROM compared)"""
TIES = ("report_group", "metric_name", "exchange", "symbol_key", "exchange_pair", "window_mode", "window_label", "from_bucket", "to_bucket")
TIE_SQL = ", ".join(f"{c} ASC NULLS LAST" for c in TIES)


def top(order: str, rank_type: str | None, source: str = "comparison", n: int = FINE.top_n) -> str:
    label = f", '{rank_type}' AS rank_type" if rank_type else ""
    return (
        f"SELECT *{label} FROM (SELECT *, row_number() OVER (PARTITION BY event_id, report_group, metric_group "
        f"ORDER BY {order}, {TIE_SQL}) AS rank FROM {source}) WHERE rank <= {n}"
    )


TOPS = f"""
tops AS MATERIALIZED (
  {top("absolute_diff_vs_mean DESC NULLS LAST", "top_absolute_diff")} UNION ALL
  {top("signed_diff_vs_mean DESC NULLS LAST", "top_signed_positive")} UNION ALL
  {top("signed_diff_vs_mean ASC NULLS LAST", "top_signed_negative")}
)"""
FLAGGED = """
SELECT *, ratio_unstable OR relative_change_unstable OR small_denominator_flag AS denominator_risk_flag,
       metric_group = 'unstable' OR metric_name LIKE '%.relative_change' AS unstable_metric_flag,
       greatest(normal_percentile_rank, 1.0 - normal_percentile_rank) AS percentile_extremeness,
       coalesce(sign(signed_diff_vs_mean), 0) AS signed_value,
       coalesce(sign(signed_diff_vs_mean), 0) * CASE WHEN event_direction = 'DOWN' THEN -1 ELSE 1 END AS direction_normalized_sign"""
REVIEW = f"""
flagged_tops AS MATERIALIZED ({FLAGGED} FROM tops WHERE rank <= {FINE.top_k}),
flagged_all AS ({FLAGGED} FROM comparison)"""
COMPARED = ",".join([STUDY, SAMPLES, COMPARISON])
REVIEWED = ",".join([COMPARED, TOPS, REVIEW])
IDENTITY = "report_group, metric_group, metric_name, exchange, exchange_pair, symbol_key, window_label, from_bucket, to_bucket"
SIGN_LABEL = (
    "CASE WHEN aligned > 0 AND opposed > 0 THEN 'mixed' WHEN aligned > 0 THEN 'positive' WHEN opposed > 0 THEN 'negative' ELSE 'none' END"
)
POLICY = {
    "policy_bucket": ("'diagnostic'", "'exclude'", "'diagnostic'", "'context_filter'", "'core_feature'", "'diagnostic'"),
    "reason": (
        "'unstable_or_relative_change_metric'",
        "'denominator_risk_in_all_source_events'",
        "'denominator_risk_present'",
        "'context_metric_for_matching_regime_or_diagnostic'",
        "metric_group || '_candidate_seen_in_' || n_events_seen_in_top_k || '_events'",
        "'unknown_metric_group'",
    ),
    "denominator_risk_policy": (
        "'appendix_only'",
        "'exclude_primary'",
        "'exclude_primary'",
        "'none_observed'",
        "'none_observed'",
        "'review_required'",
    ),
}
POLICY_TESTS = (
    "metric_group = 'unstable' OR metric_name LIKE '%.relative_change'",
    "source_event_count > 0 AND denominator_risk_event_count >= source_event_count",
    "denominator_risk_event_count > 0",
    "metric_group = 'context'",
    f"metric_group IN ('{PRICE_DISLOCATION}', '{SIGNAL_CANDIDATE}')",
)


def policy(field: str) -> str:
    values = POLICY[field]
    tests = " ".join(f"WHEN {test} THEN {value}" for test, value in zip(POLICY_TESTS, values, strict=False))
    return f"CASE {tests} ELSE {values[-1]} END"


RECURRENCE = f"""
recurring AS MATERIALIZED (
  SELECT {IDENTITY}, count(DISTINCT event_id) AS n_events_seen_in_top_k,
         count(DISTINCT event_id) FILTER (event_direction = 'UP') AS n_up_events_seen,
         count(DISTINCT event_id) FILTER (event_direction = 'DOWN') AS n_down_events_seen,
         quantile_disc(rank::DOUBLE, 0.5) AS median_rank, quantile_disc(absolute_diff_vs_mean, 0.5) AS median_abs_diff_vs_mean,
         quantile_disc(abs(z_score_vs_normal), 0.5) AS median_abs_z_score,
         quantile_disc(percentile_extremeness, 0.5) AS median_percentile_extremeness,
         count(DISTINCT event_id) FILTER (denominator_risk_flag) AS denominator_risk_event_count,
         count(DISTINCT event_id) FILTER (unstable_metric_flag) AS unstable_event_count,
         count(*) FILTER (direction_normalized_sign > 0) AS aligned, count(*) FILTER (direction_normalized_sign < 0) AS opposed,
         (SELECT count(*) FROM chosen) AS source_event_count
  FROM flagged_tops GROUP BY ALL
)"""

# --- coverage ----------------------------------------------------------------------------------------

COVERAGE = f"""
family AS (
  SELECT * FROM catalog WHERE available AND lower(exchange) IN ({VENUE_LIST}) AND stream IN ('trade', 'bbo')
    AND lower(symbol) LIKE '%idx%'
),
requested AS (
  SELECT strftime(unnest(generate_series(lo, hi, INTERVAL 1 DAY)), '%Y%m%d') AS date
  FROM (SELECT strptime(min(date), '%Y%m%d') AS lo, strptime(max(date), '%Y%m%d') AS hi FROM family)
),
has AS (
  SELECT r.date, coalesce(bool_or(c.available), false) AS is_present_in_catalog,
         count(f.exchange) > 0 AS is_present_in_family,
         {", ".join(f"coalesce(bool_or(f.exchange = '{v}' AND f.stream = '{s}'), false) AS has_{v}_{s}" for s in ("trade", "bbo") for v in VENUES)}
  FROM requested r LEFT JOIN catalog c ON c.date = r.date
  LEFT JOIN family f ON f.date = c.date AND f.exchange = c.exchange AND f.stream = c.stream AND f.symbol = c.symbol
  GROUP BY 1
),
coverage AS MATERIALIZED (
  SELECT *, trade_coverage_count = {len(VENUES)} AS has_full_trade_coverage, bbo_coverage_count = {len(VENUES)} AS has_full_bbo_coverage,
         trade_coverage_count = {len(VENUES)} AND bbo_coverage_count = {len(VENUES)} AS has_full_trade_bbo_coverage,
         trade_coverage_count > 0 AS event_scan_possible,
         CASE WHEN NOT is_present_in_catalog THEN 'date_missing_all_streams'
              WHEN NOT is_present_in_family THEN 'date_missing_family_streams'
              ELSE concat_ws(';', {", ".join(f"CASE WHEN NOT has_{v}_{s} THEN 'missing_{v}_{s}' END" for v in VENUES for s in ("trade", "bbo"))})
         END AS missing_reasons
  FROM (SELECT *, {" + ".join(f"has_{v}_trade::INT" for v in VENUES)} AS trade_coverage_count,
               {" + ".join(f"has_{v}_bbo::INT" for v in VENUES)} AS bbo_coverage_count FROM has)
)"""
PROBE = ",".join(
    [
        BASE,
        buckets(HOURLY.bucket_seconds),
        detection(HOURLY.bucket_seconds, HOURLY.horizon, HOURLY.threshold_pct),
        clustered("probe_events", "cands", HOURLY.horizon, HOURLY.bucket_seconds, scope="date"),
        COVERAGE,
        f"""
touched AS (
  SELECT event_id, unnest(CASE WHEN a = b THEN [a] ELSE [a, b] END) AS partition_date
  FROM (SELECT event_id, {day(ntz(f"event_start_bucket - {RAW_LOOKBACK}", HOURLY.bucket_seconds))} AS a,
               {day(f"{ntz('event_start_bucket', HOURLY.bucket_seconds)} - INTERVAL 1 MICROSECOND")} AS b FROM probe_events)
),
before_event AS (
  SELECT event_id, string_agg(partition_date, ',' ORDER BY partition_date) AS pre_window_partition_dates,
         bool_and(coalesce(c.has_full_trade_bbo_coverage, false)) AS pre_window_partitions_available
  FROM touched t LEFT JOIN coverage c ON c.date = t.partition_date GROUP BY 1
),
quality AS MATERIALIZED (
  SELECT e.event_id, e.direction, e.selected_date, coalesce(c.has_full_trade_coverage, false) AS has_full_trade_coverage,
         coalesce(c.has_full_bbo_coverage, false) AS has_full_bbo_coverage, coalesce(c.trade_coverage_count, 0) AS trade_coverage_count,
         coalesce(c.bbo_coverage_count, 0) AS bbo_coverage_count, pre_window_partition_dates, pre_window_partitions_available,
         CASE WHEN e.is_ambiguous THEN 'ambiguous_event' WHEN c.date IS NULL THEN 'missing_date'
              WHEN NOT c.has_full_trade_coverage THEN 'missing_trade_coverage' WHEN NOT c.has_full_bbo_coverage THEN 'missing_bbo_coverage'
              WHEN NOT pre_window_partitions_available THEN 'pre_window_partition_missing' ELSE 'quality_pass_preview' END AS quality_reason
  FROM probe_events e LEFT JOIN coverage c ON c.date = e.selected_date LEFT JOIN before_event USING (event_id)
)""",
    ]
)


def select(chain: str, source: str, columns: dict[str, str]) -> str:
    """``source`` with columns typed: i = bigint, d = double rounded to 6, g = double in all its bits (minus zero is zero), s = text,
    b = boolean, t = timestamp."""
    shapes = {
        "i": 'CAST("{0}" AS BIGINT) AS "{0}"',
        "d": 'round(CAST("{0}" AS DOUBLE), 6) AS "{0}"',
        "g": 'CAST("{0}" AS DOUBLE) + 0.0 AS "{0}"',
        "s": 'CAST("{0}" AS VARCHAR) AS "{0}"',
        "b": 'CAST("{0}" AS BOOLEAN) AS "{0}"',
        "t": 'CAST("{0}" AS TIMESTAMP) AS "{0}"',
    }
    listed = ", ".join(shapes[kind].format(name) for name, kind in columns.items())
    return f"WITH RECURSIVE {chain.strip()}\nSELECT {listed} FROM {source}"
