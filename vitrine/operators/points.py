"""Point queries behind the scatter charts (Q1-Q5).

Filters run before sampling, and every filter is a ``where`` Catalyst can
push down.  The row count that decides whether to sample is one action;
the sample itself is X1/X2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.parse import error_bounds, owner_range, range_label, release_year
from vitrine.functions.parse import to_number_typed, year_label
from vitrine.operators import distributions
from vitrine.operators.aggregates import OWNERS
from vitrine.operators.predicates import compare, drop_missing, in_categories, selection_list
from vitrine.operators.predicates import hide_zero as drop_zero
from vitrine.operators.sampling import stratified_sample, uniform_sample

MAX_POINTS = 20_000  # cap on points per scatter (fixed value)
PLAYTIME_COLUMNS = (  # columns whose per-category histogram is a distribution summary
    "average_playtime_forever",
    "average_playtime_2weeks",
    "median_playtime_forever",
    "median_playtime_2weeks",
)


def _with_year_label(df: DataFrame) -> DataFrame:
    """Text ``release_year`` for point details; the text of ``release_date`` where no date parses."""
    if "release_year" in df.columns:
        return df.withColumn("release_year", year_label(F.col("release_year")))
    if "release_date" in df.columns:
        yr = release_year(F.col("release_date"))
        if df.agg(F.max(yr)).first()[0] is None:
            return df.withColumn("release_year", F.coalesce(F.col("release_date").cast("string"), F.lit("")))
        return df.withColumn("release_year", F.coalesce(yr.cast("string"), F.lit("")))
    return df.withColumn("release_year", F.lit(""))


def _cap(df: DataFrame, max_points: int, category: str, keys: list[str], seed: int,
         stratify: bool = True) -> DataFrame:
    """Sample only when there are more than ``max_points`` rows; the NULL stratum counts as rows."""
    if stratify and category in df.columns:
        return stratified_sample(df, category, max_points, keys, seed, keep_small=True)
    return uniform_sample(df, max_points, keys, seed)


def scatter_points(df: DataFrame, x: str, y: str, keys: list[str], hide_zero: bool = False,
                   operator=None, threshold=None, selected=None,
                   max_points: int = MAX_POINTS, color_by_category: bool = True,
                   category: str = "main_genre", seed: int = 1) -> DataFrame:
    """Q1: filtered (x, y) points, at most ``max_points``, stratified by category.

    Y = ``estimated_owners`` is a text range and gives Q2.  Steps: drop missing x/y; year label; category filter; coerce x and y and
    drop missing; hide Y == 0; comparator on Y; sample when too many.
    Output: keys, x, y, detail columns (name, category if coloured,
    release_year).
    """
    if y == OWNERS:
        return owner_scatter(df, x, keys, y, hide_zero, operator, threshold, selected, max_points, category, seed)
    data = drop_missing(df, [x, y])
    data = _with_year_label(data)
    if selection_list(selected) and category in data.columns:
        data = in_categories(data, category, selected)
    data = (data.withColumn(y, to_number_typed(data, y))
            .withColumn(x, to_number_typed(data, x)))
    data = compare(drop_zero(drop_missing(data, [x, y]), y, hide_zero), y, operator, threshold)
    detail = [c for c in ("name", category) if c in data.columns and c not in keys]
    wide = [*keys, x, y, *detail, "release_year"]
    data = _cap(data.select(*wide), max_points, category, keys, seed)
    return data.select(*[c for c in wide if color_by_category or c != category or c in keys])


def owner_scatter(df: DataFrame, x: str, keys: list[str], owners: str = "estimated_owners",
                  hide_zero: bool = False, operator=None, threshold=None, selected=None,
                  max_points: int = MAX_POINTS, category: str = "main_genre",
                  seed: int = 1) -> DataFrame:
    """Q2: owner-range midpoint against X (X is not coerced).

    Rows without a midpoint are dropped; hide-zero and the comparator apply
    to the midpoint.  Output adds low, high, absolute error bars and the
    ``"low - high"`` label.
    """
    data = _with_year_label(drop_missing(df, [x, owners]))
    if selection_list(selected) and category in data.columns:
        data = in_categories(data, category, selected)
    r = owner_range(F.col(owners))
    data = (data.withColumn("y_mid", r["mid"]).withColumn("low", r["low"])
            .withColumn("high", r["high"]))
    data = compare(drop_zero(drop_missing(data, ["y_mid"]), "y_mid", hide_zero), "y_mid", operator, threshold)
    detail = [c for c in ("name", category) if c in data.columns and c not in keys]
    data = _cap(data.select(*keys, x, "y_mid", "low", "high", *detail, "release_year"), max_points, category, keys, seed)
    plus, minus = error_bounds("low", "y_mid", "high", mode="abs")
    return data.select(*keys, x, "y_mid", "low", "high", plus.alias("err_plus"),
                       minus.alias("err_minus"), range_label("low", "high").alias("owners_range"),
                       *detail, "release_year")


def positive_scatter(df: DataFrame, y: str, keys: list[str], hide_zero: bool = False,
                     operator=None, threshold=None, selected=None,
                     max_points: int = MAX_POINTS, x: str = "positive",
                     category: str = "main_genre", seed: int = 1) -> DataFrame:
    """Q3: older scatter with X fixed to ``positive``: category filter first,
    only Y coerced, uniform sample (no strata)."""
    data = df
    if selection_list(selected):
        data = in_categories(data, category, selected)
    data = drop_missing(data, [x, y])
    data = drop_missing(data.withColumn(y, to_number_typed(data, y)), [y])
    data = compare(drop_zero(data, y, hide_zero), y, operator, threshold)
    detail = [c for c in ("name", category) if c in data.columns and c not in keys]
    return _cap(data.select(*keys, x, y, *detail), max_points, category, keys, seed, stratify=False)


def pair_projection(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Q4: the raw (x, y) pairs of a fixed projection; rows missing either are not drawn."""
    return drop_missing(df.select(*(keys or []), x, y), [x, y])


def category_histogram(df: DataFrame, col: str, selected=None, category: str = "main_genre",
                       bins: int = 50, top_n: int = 8) -> DataFrame:
    """Q5: histogram of the chosen column for the selected categories.

    For the playtime columns the result is the per-category distribution
    summary of the top ``top_n`` categories (A16); otherwise an equal-width
    histogram (A12).  Text that never coerces (owner ranges) gives no rows.
    """
    data = in_categories(df, category, selected) if selection_list(selected) else df
    if col in PLAYTIME_COLUMNS:
        return distributions.distribution_by_category(data, category, col, top_n=top_n)
    return distributions.histogram(data, col, bins=bins)
