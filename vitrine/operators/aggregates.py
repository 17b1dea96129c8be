"""Group-by aggregates (A1-A9, A11, A17-A20, J1) and top-k (L1-L3).

All aggregates are decomposable (avg, sum, count, min, max), so Spark
aggregates partially before the shuffle: a hot category costs one partial
row per map task, never a gathered group.  Top-k is ``orderBy().limit()``,
which plans as TakeOrderedAndProject (a bounded heap per partition).
Ties are broken by the category ascending, so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.parse import error_bounds, owner_range, owner_range_prefix, to_number_typed
from vitrine.functions.parse import genre_list as genre_list_expr
from vitrine.operators.predicates import drop_null_key, in_categories, year_between
from vitrine.session import materialize


OWNERS = "estimated_owners"  # the column of owner ranges (fixed value)


def _numeric(df: DataFrame, y: str):
    return to_number_typed(df, y)


def summed_by_key(fact: DataFrame, key: str, *ys: str) -> DataFrame:
    """Sum and number of values of each Y per join key, for means over a joined dimension.

    A mean per category of a dimension needs only these, so a large fact table is
    reduced to its keys before the join instead of being shuffled row by row.
    """
    aggs = [a for y in ys for a in (F.sum(_numeric(fact, y)).alias(f"{y}__sum"),
                                    F.count(_numeric(fact, y)).alias(f"{y}__count"))]
    return fact.groupBy(key).agg(*aggs)


def _mean(df: DataFrame, y: str):
    """Mean of Y, from its sums if ``df`` carries those (see ``summed_by_key``)."""
    if f"{y}__sum" not in df.columns:
        return F.avg(_numeric(df, y))
    n = F.sum(f"{y}__count")
    return F.when(n > 0, F.sum(f"{y}__sum") / n)


# ---------------------------------------------------------------- L1, A11
def top_k(df: DataFrame, value: str, k: int, key: str, ascending: bool = False,
          nulls_last: bool = True) -> DataFrame:
    """L1: the k rows with the largest (or smallest) ``value``; ties by ``key`` asc."""
    v = F.col(value)
    order = (v.asc_nulls_last() if nulls_last else v.asc()) if ascending else (
        v.desc_nulls_last() if nulls_last else v.desc())
    return df.orderBy(order, F.col(key).asc()).limit(int(k))


def top_categories(df: DataFrame, category: str, k: int) -> DataFrame:
    """The k most frequent non-NULL categories with their row counts."""
    counts = drop_null_key(df, category).groupBy(category).agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, "count", k, category)


def selected_or_top(df: DataFrame, category: str, selected, k: int) -> DataFrame:
    """Rows of ``df`` in the selection, or in the top-k categories when none is given.

    The top-k list is computed first, so the planner knows its size.
    """
    if selected:
        return in_categories(df, category, selected)
    top = materialize(top_categories(df, category, k).select(category))
    return df.join(top, on=category, how="left_semi")


# ----------------------------------------------------------- A1, A5, A6
def mean_by_category(df: DataFrame, category: str, y: str, top_n: int = 15,
                     selected=None, drop_missing_means: bool = True) -> DataFrame:
    """A1 (and A5/A6 with ``drop_missing_means=False``): mean of Y per category, top N.

    Y is coerced to numbers (bad text -> missing) and missing values are
    skipped.  With ``drop_missing_means`` categories without any value are
    removed; otherwise they sort last and may appear.  Y = ``estimated_owners``
    is a text range and gives A2.
    """
    if y == OWNERS:
        return owner_means_by_category(df, category, y, top_n, selected)
    data = in_categories(df, category, selected)
    data = drop_null_key(data, category)
    g = data.groupBy(category).agg(_mean(data, y).alias(y))
    if drop_missing_means:
        g = g.where(F.col(y).isNotNull())
    return top_k(g, y, top_n, category)


# -------------------------------------------------------------------- A2
def owner_means_by_category(df: DataFrame, category: str, owners: str, top_n: int = 15,
                            selected=None) -> DataFrame:
    """A2: mean of the owner-range mid, low and high per category, top N by mid.

    A category is dropped if any of the three means is missing.  Error bars
    (plus = high - mid, minus = mid - low, NULL -> 0, floored at 0) are added.
    """
    data = drop_null_key(in_categories(df, category, selected), category)
    r = owner_range(F.col(owners))
    g = (
        data.select(F.col(category), r.alias("_r"))
        .groupBy(category)
        .agg(
            F.avg("_r.mid").alias("estimated_owners_mid_mean"),
            F.avg("_r.low").alias("estimated_owners_low_mean"),
            F.avg("_r.high").alias("estimated_owners_high_mean"),
        )
        .dropna(how="any")
    )
    plus, minus = error_bounds("estimated_owners_low_mean", "estimated_owners_mid_mean",
                               "estimated_owners_high_mean", mode="clip")
    g = g.withColumn("err_plus", plus).withColumn("err_minus", minus)
    return top_k(g, "estimated_owners_mid_mean", top_n, category)


# ---------------------------------------------------------------- A3, A4
def counts_per_year(df: DataFrame, year: str, category: str, selected=None,
                    year_min=None, year_max=None, default_k: int = 4,
                    date_col: str | None = None) -> DataFrame:
    """A3: rows per (year, category) for the selection (default: top-k categories).

    ``date_col``: the date/timestamp column ``year`` derives from; the year
    window is then also stated on it, so Parquet can skip row groups.
    """
    data = selected_or_top(df, category, selected, default_k)
    data = _year_window(data, year, year_min, year_max, date_col)
    return (drop_null_key(data, year, category)
            .groupBy(year, category).agg(F.count(F.lit(1)).alias("count")))


def sum_per_year(df: DataFrame, year: str, category: str, value: str, selected=None,
                 year_min=None, year_max=None, default_k: int = 4,
                 out: str = "sum", date_col: str | None = None) -> DataFrame:
    """A4: sum of ``value`` per (year, category); a group with no value sums to 0."""
    data = selected_or_top(df, category, selected, default_k)
    data = _year_window(data, year, year_min, year_max, date_col)
    return (drop_null_key(data, year, category)
            .groupBy(year, category)
            .agg(F.coalesce(F.sum(_numeric(data, value)), F.lit(0.0)).alias(out)))


def _year_window(df: DataFrame, year: str, year_min, year_max,
                 date_col: str | None = None) -> DataFrame:
    """F3 on the year; with ``date_col`` also as a pushable date range."""
    df = year_between(df, year, year_min, year_max)
    if date_col and year_min is not None:
        df = df.where(F.col(date_col) >= _year_start(df, date_col, int(year_min)))
    if date_col and year_max is not None:
        df = df.where(F.col(date_col) < _year_start(df, date_col, int(year_max) + 1))
    return df


def _year_start(df: DataFrame, date_col: str, y: int):
    """Literal for January 1st of ``y`` in the type of ``date_col``.

    Built from text, so no Python or session time zone shifts it (a
    TIMESTAMP column is compared in the session zone, like ``year()``).
    """
    dtype = dict(df.dtypes)[date_col]
    if dtype == "date":
        return F.lit(f"{y:04d}-01-01").cast("date")
    return F.lit(f"{y:04d}-01-01 00:00:00").cast(dtype)


# -------------------------------------------------------------------- A7
def mean_per_year(df: DataFrame, year: str, y: str, out: str | None = None) -> DataFrame:
    """Mean of Y per year, years without any value dropped, ordered by year."""
    out = out or y
    return (drop_null_key(df, year)
            .groupBy(year).agg(F.avg(_numeric(df, y)).alias(out))
            .where(F.col(out).isNotNull())
            .orderBy(year))


# -------------------------------------------------------------------- A8
def year_category_crosstab(df: DataFrame, year: str, category: str,
                           categories: list[str]) -> DataFrame:
    """Wide table year x category of row counts for a fixed category list.

    Empty cells are 0; a listed category without rows gets no column.  One
    pass over the data: the pivot over the given list (no value discovery)
    is cached (years x categories cells), then the
    categories that never occur are dropped from that small table.
    """
    cats = sorted(set(categories))
    data = drop_null_key(df.where(F.col(category).isin(cats)), year, category)
    wide = materialize(data.groupBy(year).pivot(category, cats).count())
    seen = wide.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cats]).first()
    present = [c for c in cats if seen is not None and seen[c] > 0]
    return (wide.select(year, *[F.col(f"`{c}`") for c in present])
            .na.fill(0, subset=present).orderBy(year))


# -------------------------------------------------------------------- A9
def owner_totals_by_category(df: DataFrame, genres: str, owners: str,
                             top_n: int = 15) -> DataFrame:
    """Per notebook genre value, sums of the owner-range mean, low and high.

    One row per value of the notebook ``genre_list`` (first element of a list
    literal, other literals whole), missing values skipped (an all-missing
    sum is 0), error bars raw, top N by the summed mean.
    """
    r = owner_range_prefix(F.col(owners))
    # explode_outer + NULL filter: no inferred size() filter copying the parser.
    exploded = (df.select(F.explode_outer(genre_list_expr(F.col(genres))).alias("genre_list"),
                          r.alias("_r"))
                .where(F.col("genre_list").isNotNull()))
    g = exploded.groupBy("genre_list").agg(
        F.coalesce(F.sum("_r.mid"), F.lit(0.0)).alias("est_mean_sum"),
        F.coalesce(F.sum("_r.low"), F.lit(0.0)).alias("est_low_sum"),
        F.coalesce(F.sum("_r.high"), F.lit(0.0)).alias("est_high_sum"),
    )
    plus, minus = error_bounds("est_low_sum", "est_mean_sum", "est_high_sum", mode="raw")
    g = g.withColumn("err_minus", minus).withColumn("err_plus", plus)
    return top_k(g, "est_mean_sum", top_n, "genre_list")


# ---------------------------------------------------------------- A17-A20
def distinct_categories(df: DataFrame, category: str) -> DataFrame:
    """Distinct non-NULL categories, ascending."""
    return drop_null_key(df.select(category), category).distinct().orderBy(category)


def year_bounds(df: DataFrame, year: str, span: int = 10,
                default=(1970, 2025, 2010, 2020)) -> DataFrame:
    """Min and max year and the default window ``[max(min, max-span), max]``.

    Without any year the defaults (1970, 2025, [2010, 2020]) are returned.
    """
    b = df.agg(F.min(year).alias("_lo"), F.max(year).alias("_hi"))
    has = F.col("_hi").isNotNull()
    return b.select(
        F.when(has, F.col("_lo")).otherwise(F.lit(default[0])).cast("int").alias("year_min"),
        F.when(has, F.col("_hi")).otherwise(F.lit(default[1])).cast("int").alias("year_max"),
        F.when(has, F.greatest(F.col("_lo"), F.col("_hi") - span))
        .otherwise(F.lit(default[2])).cast("int").alias("window_min"),
        F.when(has, F.col("_hi")).otherwise(F.lit(default[3])).cast("int").alias("window_max"),
    )


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def shape_and_distinct(df: DataFrame, key: str, exact: bool = True) -> DataFrame:
    """Rows, columns and the number of distinct non-NULL keys (``exact=False``: see :func:`key_sketch`)."""
    distinct = F.countDistinct(F.col(key)) if exact else F.hll_sketch_estimate(F.hll_sketch_agg(key, F.lit(_LG_K)))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        distinct.alias("n_distinct"),
    )


_LG_K = 14


def key_sketch(df: DataFrame, key: str) -> DataFrame:
    """One row: n_rows and an HLL sketch of the non-NULL keys, to keep beside a snapshot.

    The sketch has a fixed size (at most some 10 KB) whatever the table's.  An estimate from it is within 2 % of the
    exact number in all but very rare cases (standard error about 0.7 %).
    """
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(key, F.lit(_LG_K)).alias("sketch"))


def distinct_of_sketches(sketches: DataFrame) -> DataFrame:
    """A20 over several snapshots, from their sketches alone: all rows and the distinct keys of their union."""
    return sketches.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
                        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("n_distinct"))


# -------------------------------------------------------------------- J1
def aligned_means(df: DataFrame, category: str, a: str, b: str,
                  out_a: str | None = None, out_b: str | None = None) -> DataFrame:
    """Per category mean of ``a`` and mean of ``b``, only where both exist.

    Equivalent to joining the two per-category series on the category; done
    as one aggregation, so there is a single shuffle and no join.
    """
    out_a, out_b = out_a or f"mean_{a}", out_b or f"mean_{b}"
    data = drop_null_key(df, category)
    return (data.groupBy(category)
            .agg(_mean(data, a).alias(out_a), _mean(data, b).alias(out_b))
            .dropna(how="any", subset=[out_a, out_b]))
