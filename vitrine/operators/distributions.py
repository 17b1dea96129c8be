"""Histograms and box summaries.

Histograms take two passes: min/max (two scalars to the driver, where numpy
computes the bin edges exactly as the reference does), then one partial
aggregation of bin indexes.  Edges are literals, so every row is binned by
a couple of arithmetic ops and array lookups inside codegen; the zero bins
come from a ``range`` of at most ``bins`` rows.

Box summaries use exact quartiles with linear interpolation (the same as
``describe``), computed by the bounded-state selection of
``vitrine.operators.quantiles``; ``exact=False`` switches to the
``percentile_approx`` sketch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.parse import to_number_typed
from vitrine.operators.aggregates import top_categories
from vitrine.operators.predicates import drop_null_key, positive_only
from vitrine.operators.quantiles import column_quantiles, exact_quantiles
from vitrine.session import materialize, reliable_checkpoint

_QUARTILES = [0.25, 0.5, 0.75]
BOX_SCHEMA = ("n BIGINT, min DOUBLE, q1 DOUBLE, median DOUBLE, q3 DOUBLE, max DOUBLE, "
              "lower_whisker DOUBLE, upper_whisker DOUBLE, n_outliers BIGINT")
HIST_SCHEMA = "bin INT, bin_left DOUBLE, bin_right DOUBLE, bin_center DOUBLE, count BIGINT"


def bin_edges(vmin: float, vmax: float, bins: int, log_bins: bool = False) -> np.ndarray:
    """Edges as numpy makes them: ``linspace(min, max)`` or ``logspace(log10 min, log10 max)``."""
    if log_bins:
        return np.logspace(np.log10(vmin), np.log10(vmax), bins + 1)
    return np.linspace(vmin, vmax, bins + 1)


def _double_array(values: np.ndarray) -> Column:
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in values)})")


def _with_bin(data: DataFrame, edges: np.ndarray, log_bins: bool) -> DataFrame:
    """``data`` (v, within the outer edges) with ``bin``: i with edge[i] <= v < edge[i+1], the last bin closed.

    The estimate comes from the uniform bin width (in log10 space for log bins) and is
    corrected by steps either way against the exact edges.  Each step is a projection, so no
    step is computed more than once a row.
    """
    bins, e = len(edges) - 1, _double_array(edges)
    lo, hi = (float(np.log10(x)) if log_bins else float(x) for x in (edges[0], edges[-1]))
    v, i = F.col("v"), F.col("bin")
    if not hi > lo:
        return data.withColumn("bin", F.lit(bins - 1))
    estimate = F.floor(((F.log10(v) if log_bins else v) - F.lit(lo)) * F.lit(bins / (hi - lo)))
    data = data.withColumn("bin", F.least(F.greatest(estimate.cast("int"), F.lit(0)), F.lit(bins - 1)))
    data = data.withColumn("bin", F.greatest(F.when(v < F.element_at(e, i + 1), i - 1).otherwise(i), F.lit(0)))
    # Twice: a run of equal edges (constant column) belongs to the last bin with that edge.
    for _ in range(2):
        data = data.withColumn("bin", F.when((i < bins - 1) & (v >= F.element_at(e, i + 2)), i + 1).otherwise(i))
    return data


def histogram(df: DataFrame, col: str, bins: int = 50, log_bins: bool = False,
              log_x: bool = False) -> DataFrame:
    """Equal-width (or log-spaced) histogram of a numeric column.

    Values are coerced (bad text -> missing); for log bins only values > 0
    count, and so with ``log_x``, which keeps equal-width bins.  The edges span
    the finite values; -inf counts in the first bin and inf in the last, so no
    row is lost.  Without a finite value the result is empty.  Bins are left-closed, the last one closed; empty bins are kept;
    values outside the outer edges (possible with log edges) are not
    counted.  Output: bin, bin_left, bin_right, bin_center, count.
    """
    spark = df.sparkSession
    v = to_number_typed(df, col)
    data = df.select(v.alias("v")).where(F.col("v").isNotNull())
    data = positive_only(data, "v", log_bins or log_x)
    finite = F.when(F.abs(F.col("v")) != F.lit(float("inf")), F.col("v"))
    stats = data.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi")).first()
    if stats is None or stats["lo"] is None:
        return spark.createDataFrame([], HIST_SCHEMA)
    edges = bin_edges(float(stats["lo"]), float(stats["hi"]), bins, log_bins)
    lo_edge, hi_edge = float(edges[0]), float(edges[-1])
    # An infinite value counts in the outer bin, like the edge itself.
    v = F.col("v")
    v = (F.when(v == F.lit(float("inf")), F.lit(hi_edge)).when(v == F.lit(float("-inf")), F.lit(lo_edge))
         .otherwise(v))
    data = data.select(v.alias("v")).where((F.col("v") >= lo_edge) & (F.col("v") <= hi_edge))
    counted = _with_bin(data, edges, log_bins).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    e = _double_array(edges)
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    left = F.element_at(e, F.col("bin") + 1)
    right = F.element_at(e, F.col("bin") + 2)
    return (all_bins.join(counted, "bin", "left")
            .select("bin", left.alias("bin_left"), right.alias("bin_right"),
                    ((left + right) / 2.0).alias("bin_center"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def _approx_quartiles(v: Column, accuracy: int) -> Column:
    return F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).cast("array<double>")


def box_summary(df: DataFrame, value: str, by: list[str] | str | None = None,
                exact: bool = True, accuracy: int = 10000,
                whisker: float = 1.5, written: bool = False) -> DataFrame:
    """Quartiles, whiskers and outlier count, overall or per group.

    ``written``: ``df`` already is a written table of just the keys and the value, a
    number, without missing ones.

    Values are coerced and missing ones dropped; rows with a NULL group key
    are dropped.  Whiskers are the most extreme values within
    ``whisker`` x IQR of the box; outliers are the values beyond them.
    Output: [by...], n, min, q1, median, q3, max, lower_whisker,
    upper_whisker, n_outliers.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    if written:
        data = df.withColumnRenamed(value, "v")
    else:
        v = to_number_typed(df, value)
        data = drop_null_key(df.select(*keys, v.alias("v")), *keys).where(F.col("v").isNotNull())
        data = reliable_checkpoint(data, "box-input")  # keys and value, read by every pass below
    v = F.col("v")
    if exact and not keys:
        (q,) = column_quantiles(data, ["v"], _QUARTILES)
        if not q["n"]:
            return df.sparkSession.createDataFrame([], BOX_SCHEMA)
        q1, median, q3 = q["q"]
        ends = [F.lit(x).cast("double").alias(name) for name, x in
                (("min", q["min"]), ("q1", q1), ("median", median), ("q3", q3), ("max", q["max"]))]
        fenced = data.select("v", F.lit(q1).alias("q1"), F.lit(q3).alias("q3"))
        return _fences(fenced, [], whisker).select(F.lit(q["n"]).cast("long").alias("n"), *ends,
                                                   "lower_whisker", "upper_whisker", "n_outliers")
    # The overall summary is the one-group case of the grouped one.
    gkeys = keys or ["_all"]
    if not keys:
        data = data.withColumn("_all", F.lit(0))
    if exact:
        q = exact_quantiles(data, "v", _QUARTILES, by=gkeys, written=True)
        q = q.select(*gkeys, "n", "min", F.col("q0").alias("q1"), F.col("q1").alias("median"),
                     F.col("q2").alias("q3"), "max")
    else:
        q = data.groupBy(*gkeys).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
            _approx_quartiles(v, accuracy).alias("_q"))
        q = q.select(*gkeys, "n", "min", F.col("_q")[0].alias("q1"),
                     F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "max")
    # Written, so the planner knows its size and broadcasts it when small: the rows stay in place.
    q = reliable_checkpoint(q, "quartiles")
    out = q.join(_fences(data.join(q.select(*gkeys, "q1", "q3"), on=gkeys), gkeys, whisker), on=gkeys)
    return out.select(*keys, "n", "min", "q1", "median", "q3", "max",
                      "lower_whisker", "upper_whisker", "n_outliers")


def _fences(rows: DataFrame, keys: list[str], whisker: float) -> DataFrame:
    """keys, v, q1, q3 -> per group the whiskers and the number of values beyond them."""
    iqr = F.col("q3") - F.col("q1")
    v, lo, hi = F.col("v"), F.col("q1") - F.lit(whisker) * iqr, F.col("q3") + F.lit(whisker) * iqr
    return rows.groupBy(*keys).agg(
        F.min(F.when(v >= lo, v)).alias("lower_whisker"),
        F.max(F.when(v <= hi, v)).alias("upper_whisker"),
        F.count(F.when((v < lo) | (v > hi), F.lit(1))).alias("n_outliers"))


def grouped_histogram(df: DataFrame, col: str, by: str, bins: int = 50) -> DataFrame:
    """A12 per group: equal-width bins between each group's own min and max.

    Edges follow numpy's ``linspace`` arithmetic (``i * step + min``, the
    last edge is the max) but are computed per group in Spark, so nothing
    per group reaches the driver.  Left-closed bins, last bin closed, empty
    bins kept (groups x bins rows); infinite values count in the outer bins,
    a group without a finite value has none.  Output: by, bin, bin_left, bin_right,
    bin_center, count.
    """
    v = to_number_typed(df, col)
    data = drop_null_key(df.select(F.col(by), v.alias("v")), by).where(F.col("v").isNotNull())
    finite = F.when(F.abs(F.col("v")) != F.lit(float("inf")), F.col("v"))
    bounds = materialize(data.groupBy(by).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
                         .where(F.col("_lo").isNotNull()))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))

    def edge(i):
        return F.when(i >= bins, F.col("_hi")).otherwise(i.cast("double") * step + F.col("_lo"))

    # An infinite value counts in the outer bin, like the group's own least or greatest value.
    data = data.join(bounds, on=by, how="inner").withColumn(
        "v", F.least(F.greatest(F.col("v"), F.col("_lo")), F.col("_hi")))
    est = F.floor((F.col("v") - F.col("_lo")) / step)
    i = F.when(F.col("_hi") == F.col("_lo"), F.lit(bins - 1)).otherwise(
        F.least(F.greatest(est.cast("int"), F.lit(0)), F.lit(bins - 1)))
    i = F.when(F.col("v") < edge(i), i - 1).otherwise(i)
    i = F.least(F.greatest(i, F.lit(0)), F.lit(bins - 1))
    i = F.when((i < bins - 1) & (F.col("v") >= edge(i + 1)), i + 1).otherwise(i)
    i = F.when((i < bins - 1) & (F.col("v") >= edge(i + 1)), i + 1).otherwise(i)
    counted = (data.select(by, i.alias("bin"))
               .groupBy(by, "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = bounds.select(by, "_lo", "_hi",
                         F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    left, right = edge(F.col("bin")), edge(F.col("bin") + 1)
    return (grid.join(counted, on=[by, "bin"], how="left")
            .select(by, "bin", left.alias("bin_left"), right.alias("bin_right"),
                    ((left + right) / 2.0).alias("bin_center"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def distribution_by_category(df: DataFrame, category: str, value: str, top_n: int = 10,
                             exact: bool = True, bins: int | None = None) -> DataFrame:
    """Box summary of ``value`` for the top-N categories by row count
    (with ``bins``: their per-category histograms instead).

    Rows with a missing value or category are removed first, then the
    categories are ranked on the cleaned rows, which are written once and read with the at
    most N winners by every later pass.
    """
    v = to_number_typed(df, value)
    clean = (df.select(F.col(category), v.alias(value))
             .where(F.col(value).isNotNull() & F.col(category).isNotNull()))
    clean = reliable_checkpoint(clean, "category-values")
    top = reliable_checkpoint(top_categories(clean, category, top_n).select(category), "top")
    kept = clean.join(top, on=category, how="left_semi")
    if bins:
        # The density shape of each kept category (A12 per group).
        return grouped_histogram(kept, value, category, bins)
    return box_summary(kept, value, by=category, exact=exact, written=True)
