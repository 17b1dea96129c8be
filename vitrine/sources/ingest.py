"""Typed ingest of the catalogue table (S5): text columns -> derived columns.

A source column that is absent gives an all-NULL derived column.  The
result can be written once as Parquet (``session.reliable_checkpoint`` or a table of your own) so that later
queries read only the columns they touch; :func:`write_clustered` lays it out for the year and
category filters and measures the columns on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.parse import owner_range, primary_category, release_year, to_number_typed

# Columns coerced to numbers at load (fixed values).
NUMERIC_AT_LOAD = ("average_playtime_forever", "price", "peak_ccu")


def ingest_catalogue(raw: DataFrame, genres: str = "genres", release_date: str = "release_date",
                     owners: str | None = "estimated_owners",
                     numeric: tuple[str, ...] = NUMERIC_AT_LOAD,
                     date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Add ``main_genre``, ``release_year`` (and owner range parts); coerce numbers.

    * ``main_genre``: first element of the list literal in ``genres`` (D1).
    * ``release_year``: year of ``release_date`` in ``date_format`` (D2).
    * numeric columns: ``pd.to_numeric(errors="coerce")`` semantics (D3).
    * ``owners_low/high/mid``: the owner range (D5), when ``owners`` is present.
    """
    df = raw
    cols = set(df.columns)
    main = primary_category(F.col(genres)) if genres in cols else F.lit(None).cast("string")
    year = (release_year(F.col(release_date), date_format) if release_date in cols
            else F.lit(None).cast("int"))
    df = df.withColumn("main_genre", main).withColumn("release_year", year)
    for c in numeric:
        if c in cols:
            df = df.withColumn(c, to_number_typed(df, c))
    if owners and owners in cols:
        r = owner_range(F.col(owners))
        df = (df.withColumn("owners_low", r["low"]).withColumn("owners_high", r["high"])
              .withColumn("owners_mid", r["mid"]))
    return df


@dataclass(frozen=True)
class TableMetrics:
    """What one write saw of a table: A19, A21, A23 and the year bounds without a scan of their own."""

    rows: int
    non_null: dict[str, int]
    missing: dict[str, int]  # NULL or NaN
    least: dict[str, object]  # of numbers, dates and timestamps
    greatest: dict[str, object]


def write_clustered(df: DataFrame, path: str, year: str = "release_year", category: str = "main_genre",
                    categories: int = 10_000) -> TableMetrics:
    """Write a table partitioned by year, its files sorted by category, with a Bloom filter on it.

    A year filter then reads the years' folders alone, a category filter the row groups whose
    range and Bloom filter (sized for ``categories`` values) allow the value.  Rows are dealt by ranges of (year,
    category) and a spreading number, so neither a hot year nor a hot category fills one task.
    """
    compared = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    seen = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        missing = (c.isNull() | F.isnan(c)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.isNull()
        seen += [F.count(c).alias(f"n{i}"), F.count_if(missing).alias(f"m{i}")]
        if isinstance(f.dataType, compared):
            seen += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    observed = Observation("write_clustered")
    placed = df.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(year, category, "_spread")
    # Observed behind the exchange: its sampling job must not count the rows twice.
    placed = placed.sortWithinPartitions(year, category).drop("_spread").observe(observed, *seen)
    (placed.write.mode("overwrite").partitionBy(year)
     .option(f"parquet.bloom.filter.enabled#{category}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{category}", str(categories)).parquet(path))
    got, names = observed.get, df.columns
    return TableMetrics(
        got["rows"], {c: got[f"n{i}"] for i, c in enumerate(names)}, {c: got[f"m{i}"] for i, c in enumerate(names)},
        {c: got[f"lo{i}"] for i, c in enumerate(names) if f"lo{i}" in got},
        {c: got[f"hi{i}"] for i, c in enumerate(names) if f"hi{i}" in got})


def metrics_table(df: DataFrame, metrics: TableMetrics) -> DataFrame:
    """One row a column of ``df``: column_name, non_null, missing_share (none without rows)."""
    rows = [(c, metrics.non_null[c], metrics.missing[c] / metrics.rows if metrics.rows else None) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column_name string, non_null long, missing_share double")
