"""Reshaping and the yearly series.

The yearly series is built in long form: a dense grid of years x present
categories (generated with ``sequence`` + ``explode`` on at most k rows),
left-joined with the aggregated values.  No pivot shuffle is needed; every
input here is an aggregate of at most (#years x #categories) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import materialize, reliable_checkpoint


def pivot_wide(df: DataFrame, index: str, category: str, value: str,
               categories: list[str]) -> DataFrame:
    """One column per category (given list), one row per index value."""
    return df.groupBy(index).pivot(category, list(categories)).agg(F.first(value))


def melt_long(df: DataFrame, index: str, category: str, value: str) -> DataFrame:
    """R2: wide -> long (index, category, value)."""
    cols = [c for c in df.columns if c != index]
    return df.unpivot([index], cols, category, value)


def explode_list(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """One row per non-NULL element; NULL and empty arrays produce no row.

    ``explode_outer`` plus a NULL filter: plain ``explode`` makes Catalyst
    infer a ``size(array) > 0`` filter that copies the array expression, so
    an array computed by a parser (and its Python UDF) would run twice.
    """
    out = out or col
    others = [c for c in df.columns if c != col]
    return (df.select(*others, F.explode_outer(F.col(col)).alias(out))
            .where(F.col(out).isNotNull()))


def densify_years(long_df: DataFrame, year: str, category: str, value: str,
                  year_min=None, year_max=None, requested=None,
                  if_none_requested_present: str = "all",
                  gap: str = "reference") -> DataFrame:
    """R3 + R4: every (year, category) cell of ``[year_min, year_max]``.

    * Categories: those present in ``long_df``; if ``requested`` is given,
      the present ones among it, in the requested order (R4).  When none of
      the requested is present, ``if_none_requested_present`` is ``"all"``
      (keep every present category) or ``"none"`` (empty result).
    * Years outside the bounds are cut; missing bounds come from the data.
    * ``gap="reference"``: a year absent from the data gets 0, a cell missing
      inside a year that has data stays NULL.  ``gap="zero"``: all gaps 0.

    Output columns: year, category, value, and ``category_order`` (the
    position of the category in the requested order, else alphabetical).
    """
    # The aggregate is small (years x categories): cache it, reuse below.
    long_df = materialize(long_df)
    if year_min is None or year_max is None:
        b = long_df.agg(F.min(year).alias("lo"), F.max(year).alias("hi")).first()
        year_min = b["lo"] if year_min is None else year_min
        year_max = b["hi"] if year_max is None else year_max
    present = long_df.select(category).distinct()
    if requested:
        req = [str(r) for r in requested]
        order = F.array_position(F.array(*[F.lit(r) for r in req]), F.col(category))
        kept = present.where(F.col(category).isin(req))
        if if_none_requested_present == "none" or not _is_empty(kept):
            present = kept
        cats = present.select(category, order.cast("int").alias("category_order"))
    else:
        cats = present.select(category, F.lit(0).alias("category_order"))
    if year_min is None or year_max is None or int(year_min) > int(year_max):
        return (long_df.select(F.col(year), F.col(category), F.col(value),
                               F.lit(0).alias("category_order")).limit(0))
    grid = cats.select(
        F.explode(F.sequence(F.lit(int(year_min)), F.lit(int(year_max)))).alias(year),
        category, "category_order")
    years_present = long_df.select(F.col(year).alias("_yp")).distinct()
    joined = (grid.join(long_df.select(year, category, value), on=[year, category], how="left")
              .join(years_present, F.col(year) == F.col("_yp"), how="left"))
    zero = F.lit(0).cast(dict(long_df.dtypes)[value])
    if gap == "zero":
        filled = F.coalesce(F.col(value), zero)
    elif gap == "reference":
        filled = F.coalesce(F.col(value), F.when(F.col("_yp").isNull(), zero))
    else:
        raise ValueError(f"unknown gap mode {gap!r}")
    return joined.select(F.col(year).cast("int").alias(year), category,
                         filled.alias(value), "category_order")


def _is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0


def yearly_series(counts_long: DataFrame, year: str, category: str, value: str,
                  year_min=None, year_max=None, requested=None,
                  variant: str = "count", gap: str = "reference") -> DataFrame:
    """R1-R4 composed: the per-year line series of the category pages.

    ``variant="count"`` keeps all categories when none of the requested is
    present; ``variant="sum"`` returns nothing in that case.
    """
    return densify_years(counts_long, year, category, value, year_min, year_max, requested,
                         if_none_requested_present="all" if variant == "count" else "none",
                         gap=gap)


def year_cells(df: DataFrame, year: str, category: str, value: str | None = None) -> DataFrame:
    """One pass over ``df``: count (and sum of ``value``, 0 without any) of every (year, category), NULLs included, written.

    Years x categories rows, from which the default selection, the year bounds and the
    series follow without reading ``df`` again.
    """
    aggs = [F.count(F.lit(1)).alias("count")]
    if value is not None:
        aggs.append(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("sum"))
    return reliable_checkpoint(df.groupBy(year, category).agg(*aggs), "year-cells")


def cell_categories(cells: DataFrame, category: str, k: int) -> list[str]:
    """A11 from cells: the k categories with most rows, ties by name."""
    totals = cells.where(F.col(category).isNotNull()).groupBy(category).agg(F.sum("count").alias("count"))
    return [r[0] for r in totals.orderBy(F.col("count").desc(), F.col(category).asc()).limit(int(k)).collect()]


def series_of_cells(cells: DataFrame, year: str, category: str, value: str = "count", year_min=None,
                    year_max=None, requested=None, default_k: int = 6, gap: str = "reference") -> DataFrame:
    """R1-R4 from cells: the dense series of ``requested`` (default: the k largest categories) within the years."""
    chosen = list(requested) if requested else cell_categories(cells, category, default_k)
    known = cells.where(F.col(year).isNotNull() & F.col(category).isin(chosen))
    if year_min is not None:
        known = known.where(F.col(year) >= int(year_min))
    if year_max is not None:
        known = known.where(F.col(year) <= int(year_max))
    return yearly_series(known.select(year, category, value), year, category, value, year_min, year_max,
                         requested=chosen, variant="count" if value == "count" else "sum", gap=gap)
