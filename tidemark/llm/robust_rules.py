"""Quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics (``FEATURES``). For every language and source, every language and all rows
together the minimum covariance determinant estimate of centre and scatter is found by concentration steps over all rows: from coordinate-wise medians
and absolute deviations, the share ``core`` of rows with the least distances gives the next mean and covariance, for
``steps`` rounds or, without a number, until no group's border moves any more. Junk above the share 1 - ``core`` of a group
enters the estimate and passes: by default half the rows are taken, which holds against the most junk.

An estimate from few rows is drawn towards the wider one: that of a language and source of n usable rows counts
n / (n + ``prior``), the rest is its language's, which in turn is drawn towards that of all rows. So every row is judged for
its language and source, whatever their size, and a verdict changes gradually as a group grows. A row is rejected where
its squared Mahalanobis distance exceeds the ``quantile`` of chi-squared. ``FLOORS`` are added to the scatter's diagonal, so that a statistic that is constant in a group (no symbols at all) does not make every deviation
an outlier. The steps are aggregations; one row of parameters per group is all that is joined back. It is broadcast up
to ``BROADCAST_GROUPS`` groups, so that no row moves for its group; beyond, Spark joins by shuffling and splits large groups.

Null texts have no words. Null languages and sources are groups like others. Only where no row of the table passes the
base rules is there no estimate. Very long texts are counted whole. Repeated rows count each. Texts that fail a base rule do not shape the estimates. Columns of the input that
are named like a result are replaced, all others but the text are carried. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.text_stats import COUNTS, count_texts
from tidemark.sources.stages import write_stage

FEATURES = ("f_size", "f_word", "f_symbol", "f_line", "f_repeat")
FLOORS = (0.05, 0.002, 0.002, 0.05, 0.03)  # variances
BROADCAST_GROUPS = 20_000  # of about 300 bytes each
HALF = 0.5  # core
PRIOR = 50  # usable rows at which a group's own estimate and the wider one count alike
NEAR, BANDS = 1e-5, 16  # bands of distances: about a sixteenth of NEAR wide beside the last border, of their distance from it further away
LEAST_ANCHOR = 1e-6  # where half a group is one point, its border is zero
SETTLED = 1e-3  # relative change of a border that counts as none
MOST_STEPS = 100  # a guard: about 5 to 20 are taken
FEW_TASKS = 8
PAIRS = tuple(combinations_with_replacement(range(len(FEATURES)), 2))


def chi2_cdf(x: float, degrees: int) -> float:
    k, value = (1, math.erf(math.sqrt(x / 2))) if degrees % 2 else (2, 1 - math.exp(-x / 2))
    while k < degrees:
        value -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
        k += 2
    return value


def chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, degrees) < p else (low, middle)
    return high


def consistency(core: float, degrees: int) -> float:
    """Factor by which the covariance of the central share ``core`` of normal rows is too small."""
    return core / chi2_cdf(chi2_quantile(core, degrees), degrees + 2)


def with_counts(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but the text, and COUNTS of the text."""
    text = docs.select(*[c for c in docs.columns if c not in (*COUNTS, "text")], "text")
    wide = text.withColumns({name: F.lit(0).cast("long") for name in COUNTS}).drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_texts(batch.columns[-1])
            columns = [*batch.columns[:-1], *[pa.array(counts[name]) for name in COUNTS]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *COUNTS])

    return text.mapInArrow(run, wide.schema)


def features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "f_size": F.log(n),
        "f_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "f_symbol": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "f_line": F.sqrt(F.lit(10.0) * F.col("n_dup_lines") / n),
        "f_repeat": F.sqrt(F.col("n_repeat_words") / n),
    }


def flat(estimate: DataFrame, *more: str) -> DataFrame:
    """``centre`` and ``inverse`` as plain columns, so that no row of the other side takes arrays apart."""
    centre = [f"centre[{i}] AS _centre{i}" for i in range(len(FEATURES))]
    inverse = [f"inverse[{k}] AS _inverse{k}" for k in range(len(PAIRS))]
    return estimate.selectExpr("_group", *centre, *inverse, *more)


# Expressions of each round as SQL text: built of columns, they would take thousands of calls a round.
#: Squared Mahalanobis distance from the columns of ``flat``, whose inverse has off-diagonal entries doubled.
GAPS = [f"({name} - _centre{i})" for i, name in enumerate(FEATURES)]
DISTANCE = " + ".join(f"_inverse{k} * {GAPS[i]} * {GAPS[j]}" for k, (i, j) in enumerate(PAIRS))
#: Number of the band that a distance lies in, ascending; bands are narrow near the last border and widen away from it.
BAND = f"CAST(floor(asinh((_d / _anchor - 1) / {NEAR!r}D) * {BANDS}) AS int)"
SUMS = [f"sum({name}) AS _centre{i}" for i, name in enumerate(FEATURES)]
SUMS += [f"sum({FEATURES[i]} * {FEATURES[j]}) AS _product{k}" for k, (i, j) in enumerate(PAIRS)]
MEANS = "array(" + ", ".join(f"sum(_centre{i}) / sum(_n)" for i in range(len(FEATURES))) + ") AS centre"
PRODUCTS = "array(" + ", ".join(f"sum(_product{k}) / sum(_n)" for k in range(len(PAIRS))) + ") AS products"


def inverted(moments: DataFrame, scale: float) -> DataFrame:
    """(_group, centre, scatter, inverse, _border, _last) of rows (_group, centre, products, _border, _last), one per group.

    ``scatter`` is the whole matrix row by row, without FLOORS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(FEATURES)
        for batch in batches:
            centre = np.array(batch.column("centre").to_pylist(), float).reshape(-1, size)
            products = np.array(batch.column("products").to_pylist(), float).reshape(-1, len(PAIRS))
            scatter = np.zeros((len(centre), size, size))
            for k, (i, j) in enumerate(PAIRS):
                scatter[:, i, j] = scatter[:, j, i] = (products[:, k] - centre[:, i] * centre[:, j]) * scale
            columns = [lists(centre), lists(scatter.reshape(len(scatter), -1)), lists(upper_inverse(scatter))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_group"), *columns, batch.column("_border"), batch.column("_last")],
                names=["_group", "centre", "scatter", "inverse", "_border", "_last"],
            )

    return moments.select("_group", "centre", "products", "_border", "_last").mapInArrow(
        run, "_group string, centre array<double>, scatter array<double>, inverse array<double>, _border double, _last double"
    )


def lists(rows: np.ndarray) -> pa.Array:
    return pa.array(rows.tolist(), pa.list_(pa.float64()))


def upper_inverse(scatter: np.ndarray) -> np.ndarray:
    """Upper triangles of the inverses, off-diagonal entries doubled."""
    inverse = np.linalg.inv(scatter + np.diag(FLOORS))
    return np.stack([inverse[:, i, j] * (1 if i == j else 2) for i, j in PAIRS], 1)


def drawn_together(labels: DataFrame, estimate: DataFrame, sizes: DataFrame, prior: float) -> DataFrame:
    """(_group, centre, inverse) of each language and source: its own estimate, its language's and that of all rows weighed."""
    known = estimate.join(sizes, "_group")
    wide = labels.select("_group", "_language", F.lit(ALL).alias("_all"))
    for level, key in enumerate(("_group", "_language", "_all")):
        part = known.select(F.col("_group").alias("_key"), F.struct("centre", "scatter", "_rows").alias(f"level{level}"))
        if key == "_all":  # one row; a constant key would else become a product of all partitions with all
            part = F.broadcast(part.filter(F.col("_key") == ALL))
        wide = wide.join(part, wide[key] == part["_key"], "left").drop("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(FEATURES)
        for batch in batches:
            centres, scatters = np.zeros((batch.num_rows, size)), np.zeros((batch.num_rows, size, size))
            for level in (2, 1, 0):
                for i, found in enumerate(batch.column(f"level{level}").to_pylist()):
                    if found is not None:
                        own = 1.0 if level == 2 else found["_rows"] / (found["_rows"] + prior)
                        centres[i] += own * (np.array(found["centre"]) - centres[i])
                        scatters[i] += own * (np.array(found["scatter"]).reshape(size, size) - scatters[i])
            yield pa.RecordBatch.from_arrays([batch.column("_group"), lists(centres), lists(upper_inverse(scatters))], names=["_group", "centre", "inverse"])

    levels = wide.filter("level2 IS NOT NULL").select("_group", "level0", "level1", "level2")
    return levels.mapInArrow(run, "_group string, centre array<double>, inverse array<double>")


def sized(parameters: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(parameters) if small else parameters


def band() -> Column:
    """Number of the band that a distance lies in, ascending; bands are narrow near the last border and widen away from it."""
    return F.floor(F.asinh((F.col("_d") / F.col("_anchor") - 1) / NEAR) * BANDS).cast("int")


def moments(rows: DataFrame, estimate: DataFrame, core: float, small: bool) -> DataFrame:
    """Means of the share ``core`` of each group's rows with the least distances (ties at the border included), and that border.

    One pass counts bands of distances, the second sums whatever lies below the band of the border and, distance by distance, what
    lies in it: the border is an order statistic, and no task gets more of a group than its bands and the rows of one of them.
    """
    anchor = f"greatest(coalesce(_border, {chi2_quantile(core, len(FEATURES))!r}D), {LEAST_ANCHOR!r}D) AS _anchor"
    known = sized(flat(estimate, anchor, "_border AS _last"), small)
    measured = rows.join(known, "_group").selectExpr("_group", "_anchor", "_last", *FEATURES, f"{DISTANCE} AS _d")
    banded = measured.selectExpr("_group", "_last", *FEATURES, "_d", f"{BAND} AS _key")
    counts = banded.groupBy("_group", "_key").agg(F.expr("count(*) AS _n"))
    target = f"greatest(ceil({core!r}D * sum(_n) OVER (PARTITION BY _group)), 1) AS _target"
    reached = counts.selectExpr("*", target, "sum(_n) OVER (PARTITION BY _group ORDER BY _key) AS _sum")
    found = few(reached.filter("_sum >= _target AND _sum - _n < _target").selectExpr("_group", "_key AS _band", "_target"), small)
    near = banded.join(sized(found, small), "_group").filter("_key <= _band")
    keyed = near.selectExpr("_group", "_target", "_last", *FEATURES, "_d", "if(_key < _band, double('-Infinity'), _d) AS _key")
    parts = keyed.groupBy("_group", "_target", "_last", "_key").agg(*map(F.expr, ["count(*) AS _n", "max(_d) AS _most", *SUMS]))
    central = parts.selectExpr("*", "sum(_n) OVER (PARTITION BY _group ORDER BY _key) AS _sum").filter("_sum - _n < _target")
    return few(central.groupBy("_group").agg(*map(F.expr, [MEANS, PRODUCTS, "max(_most) AS _border", "first(_last) AS _last"])), small)


def start(rows: DataFrame, small: bool) -> DataFrame:
    """Medians, and scatters that are diagonal with squared (scaled) median absolute deviations."""
    medians = rows.groupBy("_group").agg(F.array(*[F.percentile_approx(c, 0.5, 1000) for c in FEATURES]).alias("centre"))
    gaps = [F.abs(F.col(c) - F.col("centre")[i]) for i, c in enumerate(FEATURES)]
    spread = rows.join(sized(medians, small), "_group").groupBy("_group").agg(
        F.first("centre").alias("centre"), F.array(*[F.percentile_approx(g, 0.5, 1000) for g in gaps]).alias("mad")
    )
    # Products about zero whose covariance is the diagonal.
    products = [
        F.col("centre")[i] * F.col("centre")[j] + (F.pow(F.col("mad")[i] * 1.4826, 2) if i == j else F.lit(0.0))
        for i, j in PAIRS
    ]
    return spread.select("_group", "centre", F.array(*products).alias("products"), *[F.lit(None).cast("double").alias(c) for c in ("_border", "_last")])


ALL = "all"


def labelled(docs: DataFrame) -> DataFrame:
    """``_group`` (language and source) and ``_language``, as JSON texts; null languages and sources are labels too."""
    name = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    return docs.withColumns({"_group": name, "_language": F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})})


def few(rows: DataFrame, small: bool) -> DataFrame:
    """Rows of few groups, in few tasks: rounds are many and most shuffle partitions would be empty."""
    return rows.coalesce(FEW_TASKS) if small else rows


def settled(estimate: DataFrame) -> bool:
    return estimate.filter(F.abs(F.col("_border") - F.col("_last")) > SETTLED * F.col("_last")).isEmpty()


def quality_rules(
    docs: DataFrame, core: float = HALF, quantile: float = 0.99999, steps: int | None = None, prior: float = PRIOR
) -> DataFrame:
    """The columns of ``docs`` but the text, and COUNTS, base_failed, distance2 (null without an estimate) and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = with_counts(docs.drop("base_failed", "distance2", "kept")).withColumn("base_failed", failed)
    named = write_stage(labelled(counted).withColumns(features()), "quality_vectors")
    usable = named.filter(~F.col("base_failed"))
    fit = usable.select(F.explode(F.array("_group", "_language", F.lit(ALL))).alias("_group"), *FEATURES)
    factor = consistency(core, len(FEATURES))
    small = named.select("_group").distinct().count() <= BROADCAST_GROUPS
    estimate = write_stage(inverted(few(start(fit, small), small), 1.0), "quality_start")
    for step in range(MOST_STEPS if steps is None else steps):
        estimate = write_stage(inverted(moments(fit, estimate, core, small), factor), f"quality_step{step}")
        if steps is None and step and settled(estimate):
            break
    else:
        if steps is None:
            warnings.warn(f"borders still move after {MOST_STEPS} steps", stacklevel=2)
    sizes = fit.groupBy("_group").agg(F.count("*").alias("_rows"))
    labels = usable.select("_group", "_language").distinct()
    final = write_stage(drawn_together(labels, estimate, sizes, prior), "quality_estimates")
    parameters = flat(final)
    judged = named.join(sized(parameters, small), "_group", "left")
    limit = chi2_quantile(quantile, len(FEATURES))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= limit, F.lit(True))
    out = judged.withColumn("distance2", F.expr(DISTANCE)).withColumn("kept", verdict)
    return out.drop(*parameters.columns, "_language", *FEATURES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    ruled = quality_rules(docs)
    return ruled.select("doc_id", *COUNTS, "base_failed", "kept", "distance2")
