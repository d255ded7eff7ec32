"""Sums that do not depend on the order of rows."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exact import exact_avg, exact_sum, sorted_deviation
from tidemark.operators import ranking


def totals(df):
    return {row.g: (row.s, row.m) for row in df.groupBy("g").agg(exact_sum("x").alias("s"), exact_avg("x").alias("m")).collect()}


def some_values(seed=1):
    rnd = random.Random(seed)
    rows = []
    for g in range(60):
        scale = 10.0 ** rnd.randint(-20, 14)
        for _ in range(rnd.randint(1, 30)):
            rows.append((g, rnd.choice([rnd.gauss(0, 1) * scale, rnd.gauss(0, 1), 0.1, 1e-11 * rnd.random(), None])))
    return rows


def test_any_order_and_any_partitions_give_the_same_bits(spark):
    rows = some_values()
    once = totals(spark.createDataFrame(rows, "g int, x double").coalesce(1))
    random.Random(2).shuffle(rows)
    assert totals(spark.createDataFrame(rows, "g int, x double").repartition(7)) == once
    for g, (s, m) in once.items():
        values = [Fraction(x) for h, x in rows if h == g and x is not None]
        if not values:
            assert s is None and m is None
            continue
        assert abs(s - float(sum(values))) <= 4 * math.ulp(float(sum(values)))
        assert abs(m - float(sum(values) / len(values))) <= 4 * math.ulp(float(sum(values) / len(values)))


@pytest.mark.parametrize("value", [3e-11, 1.23456789e-8, 0.1, 1e15 / 3, -7e-20])
def test_small_values_keep_all_their_digits(spark, value):
    df = spark.createDataFrame([(1, value)] * 7, "g int, x double")
    (s, m), = totals(df).values()
    assert m == value and s == float(7 * Fraction(value))


def test_what_cannot_be_cut_is_added_plainly(spark):
    rows = [(1, 1e300), (1, 1.0), (2, math.inf), (2, 1.0), (3, math.nan), (3, 1.0), (4, 2.0**54), (4, -(2.0**54)), (4, 3.0)]
    found = totals(spark.createDataFrame(rows, "g int, x double"))
    assert found[1] == (1e300, 5e299) and found[2] == (math.inf, math.inf) and math.isnan(found[3][0]) and found[4] == (3.0, 1.0)


def test_deviation_of_equal_values_is_nothing(spark):
    rows = [([0.1] * 9, 0.1), ([1e-11, 3e-11], 2e-11), ([5.0], 5.0), ([], None)]
    df = spark.createDataFrame(rows, "v array<double>, m double")
    found = [row[0] for row in df.select(sorted_deviation(F.col("v"), F.col("m"))).collect()]
    assert found[0] == 0.0 and found[1] == pytest.approx(math.sqrt(2) * 1e-11, rel=1e-12) and found[2:] == [None, None]


def test_rankings_tell_tiny_differences_apart(spark):
    names = ("report_group", "metric_group", "metric_name", "exchange", "symbol_key", "exchange_pair", "window_mode", "window_label", "from_bucket", "to_bucket")
    rows = [("e", *["g"] * 2, f"m{i}", *["x"] * 7, diff, abs(diff)) for i, diff in enumerate((1e-11, 3e-11, -2e-11))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ("event_id", *names)) + ", signed_diff_vs_mean double, absolute_diff_vs_mean double")
    top = {(r.rank_type, r["rank"]): r.metric_name for r in ranking.rank_top_diffs(df, 1).collect()}
    assert top == {("top_absolute_diff", 1): "m1", ("top_signed_positive", 1): "m1", ("top_signed_negative", 1): "m2"}
