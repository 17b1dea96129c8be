"""Row filters (F1-F7).  Each returns a filtered DataFrame; all are plain
``where`` clauses so Catalyst pushes them into the Parquet scan."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Comparator names the controls offer (fixed values).
COMPARATORS = ("eq", "ge", "le", "gt", "lt")


def drop_missing(df: DataFrame, subset: Iterable[str]) -> DataFrame:
    """drop rows with a missing value in any of ``subset``."""
    return df.dropna(how="any", subset=list(subset))


def selection_list(selected) -> list[str]:
    """A lone string means a one-element selection; None/empty -> []."""
    if selected is None:
        return []
    if isinstance(selected, str):
        return [selected]
    return [str(s) for s in selected]


def in_categories(df: DataFrame, category: str, selected) -> DataFrame:
    """keep rows whose category is in the selection (a list the user gives); empty = no filter."""
    values = selection_list(selected)
    if not values:
        return df
    return df.where(F.col(category).cast("string").isin(values))


def year_between(df: DataFrame, year: str, year_min=None, year_max=None) -> DataFrame:
    """inclusive year bounds, each optional; a NULL year fails a given bound."""
    cond = F.lit(True)
    if year_min is not None:
        cond = cond & (F.col(year) >= int(year_min))
    if year_max is not None:
        cond = cond & (F.col(year) <= int(year_max))
    return df.where(cond)


def hide_zero(df: DataFrame, y: str, enabled: bool = True) -> DataFrame:
    """drop rows where the Y value is exactly 0 (Y only)."""
    return df.where(F.col(y) != 0) if enabled else df


def comparator_condition(value: Column, operator, threshold) -> Column | None:
    """F5 as a Column, or None when the comparator does not apply.

    No operator or threshold -> no filter; a threshold that is not a number
    -> no filter (logged); an unknown operator -> no filter.
    """
    if not operator or threshold is None:
        return None
    try:
        thr = float(threshold)
    except (TypeError, ValueError):
        log.warning("comparator threshold %r is not numeric; filter skipped", threshold)
        return None
    ops = {
        "eq": value == thr,
        "ge": value >= thr,
        "le": value <= thr,
        "gt": value > thr,
        "lt": value < thr,
    }
    return ops.get(operator)


def compare(df: DataFrame, y: str, operator=None, threshold=None) -> DataFrame:
    """``y <op> threshold`` with op in eq, ge, le, gt, lt."""
    cond = comparator_condition(F.col(y), operator, threshold)
    return df if cond is None else df.where(cond)


def positive_only(df: DataFrame, col: str, enabled: bool = True) -> DataFrame:
    """keep values > 0 (used before log-spaced bins)."""
    return df.where(F.col(col) > 0) if enabled else df


def drop_null_key(df: DataFrame, *keys: str) -> DataFrame:
    """drop rows whose group key is NULL (pandas groupby skips them)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)
