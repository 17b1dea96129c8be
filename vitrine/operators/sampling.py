"""Seeded uniform (X1) and exact proportional stratified (X2) sampling.

Row identity is a deterministic rank: ``md5(seed | key columns)``, ties
(keys that are not unique) broken by the row's own columns.  The same rows
are drawn however the data is partitioned, and any SQL engine with ``md5``
can reproduce the draw.  (Row identity cannot equal pandas'; the
contract is exact per-stratum counts and repeatability.)

Stratified plan:

1. one pass over keys and strata counts rows by stratum and size of rank, in eight
   bins for each halving (at most 417 rows per stratum): this gives the sizes;
2. quotas: floor of the proportional share, the remainder to the largest
   fractional parts (a top-r with r < n, ties by stratum), capped at size;
3. running sums over the same counts give each stratum the smallest bin bound that
   leaves its quota, so its window sees about 1.09 x quota rows however large the
   stratum is, and never too few;
4. ``row_number`` by rank within the stratum, kept while <= quota.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.session import materialize, reliable_checkpoint

_HEX_DIGITS = 13  # 52 bits of the md5 give the size of a rank
_BINS_PER_HALVING = 8


def rank_key(keys: list[str], seed: int = 1) -> Column:
    """Deterministic per-row rank text: md5 of the seed and key columns."""
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


_ORDERABLE = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType,
              T.TimestampNTZType, T.BinaryType)


def _order_columns(df: DataFrame) -> list[Column]:
    """Rank first, then every orderable column of the row: rows that tie on
    the key hash are ordered deterministically (rows equal in all these
    columns are interchangeable in the output)."""
    cols = [F.col("_rk")]
    cols += [F.col(f"`{f.name}`").asc_nulls_first() for f in df.schema.fields
             if isinstance(f.dataType, _ORDERABLE) and not f.name.startswith("_")]
    return cols


def _bin(rank: Column) -> Column:
    """How small the rank is: 0 for the largest, eight steps for each halving, at most 416."""
    head = F.conv(F.substring(rank, 1, _HEX_DIGITS), 16, 10).cast("double")
    steps = F.floor((F.lit(4.0 * _HEX_DIGITS) - F.log2(head)) * F.lit(float(_BINS_PER_HALVING)))
    return F.when(head > 0, steps).otherwise(F.lit(4 * _HEX_DIGITS * _BINS_PER_HALVING)).cast("int")


def _ranked(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    return df.withColumn("_rk", rank_key(keys, seed)).withColumn("_bin", _bin(F.col("_rk")))


def uniform_sample(df: DataFrame, n: int, keys: list[str], seed: int = 1,
                   total: int | None = None) -> DataFrame:
    """Exactly ``min(rows, n)`` rows: those with the n smallest ranks.

    A plain ``orderBy(rank).limit(n)`` would merge every partition's top n in
    one task (partitions x n rows).  Instead one pass over the keys counts rows by
    size of rank, which gives the smallest bin bound that leaves n rows (about
    1.09 n at most); the top n is taken from the rows within it.  ``total`` (the row
    count), if known, saves that pass for small tables.
    """
    if n <= 0 or (total is not None and total <= n):
        return df
    ranked = _ranked(df, keys, seed)
    got = 0
    for least, rows in sorted(map(tuple, ranked.groupBy("_bin").count().collect()), reverse=True):
        got += rows
        if got >= n:
            break
    if got <= n:
        return df if got < n else ranked.where(F.col("_bin") >= least).select(*df.columns)
    return (ranked.where(F.col("_bin") >= least).orderBy(*_order_columns(df)).limit(int(n))
            .select(*df.columns))


def stratum_sizes(df: DataFrame, by: str) -> DataFrame:
    """Rows per stratum including the NULL stratum (``by``, ``_size``),
    cached: one row per stratum."""
    return materialize(df.groupBy(by).agg(F.count(F.lit(1)).alias("_size")))


def stratum_quotas(df: DataFrame, by: str, n: int,
                   sizes: DataFrame | None = None) -> DataFrame | None:
    """Per-stratum quotas (``by``, ``_size``, ``_quota``) for a sample of n rows.

    quota = floor(size / total * n), plus one for the ``n - sum(floor)``
    strata with the largest fractional parts (ties: stratum ascending),
    capped at the stratum size; strata with quota 0 are dropped.  NULL is not
    a stratum.  Returns None when there is no non-NULL stratum.  ``sizes``
    may be passed in (see ``stratum_sizes``) to save a pass.
    """
    if sizes is None:
        sizes = stratum_sizes(df, by)
    sizes = sizes.where(F.col(by).isNotNull())
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    if total == 0:
        return None
    exact = (F.col("_size").cast("double") / F.lit(float(total))) * F.lit(float(n))
    shares = sizes.select(by, "_size", exact.alias("_exact"),
                          F.floor(exact).cast("bigint").alias("_base"))
    remainder = n - (shares.agg(F.sum("_base")).first()[0] or 0)
    if remainder > 0:
        plus = (shares.select(by, (F.col("_exact") - F.col("_base")).alias("_frac"))
                .orderBy(F.col("_frac").desc(), F.col(by).asc()).limit(int(remainder))
                .select(by, F.lit(1).alias("_plus")))
        shares = shares.join(plus, by, "left")
    else:
        shares = shares.withColumn("_plus", F.lit(0))
    quota = F.least(F.col("_base") + F.coalesce(F.col("_plus"), F.lit(0)), F.col("_size"))
    return shares.select(by, "_size", quota.alias("_quota")).where(F.col("_quota") > 0)


def stratified_sample(df: DataFrame, by: str, n: int, keys: list[str], seed: int = 1,
                      keep_small: bool = False) -> DataFrame:
    """Proportional stratified sample of n rows with exact quotas.

    n <= 0 -> input unchanged, so is an input of at most n rows with ``keep_small`` (else its
    NULL stratum goes); ``by`` missing or no non-NULL stratum -> X1.
    """
    if n <= 0:
        return df
    if by not in df.columns:
        return uniform_sample(df, n, keys, seed)
    # Rows by stratum and size of rank: sizes, quotas and bounds all come from this small table.
    ranked = _ranked(df, keys, seed)
    counts = reliable_checkpoint(ranked.groupBy(by, "_bin").agg(F.count(F.lit(1)).alias("_c")), "rank-sizes")
    if keep_small and (counts.agg(F.sum("_c")).first()[0] or 0) <= n:
        return df
    quotas = stratum_quotas(df, by, n, counts.groupBy(by).agg(F.sum("_c").alias("_size")))
    if quotas is None:
        return uniform_sample(df, n, keys, seed)
    smaller = (Window.partitionBy(by).orderBy(F.col("_bin").desc())
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bounds = (counts.withColumn("_upto", F.sum("_c").over(smaller)).join(quotas, by)
              .where(F.col("_upto") >= F.col("_quota"))
              .groupBy(by).agg(F.max("_bin").alias("_least"), F.max("_quota").alias("_quota")))
    # One row per stratum, written: AQE broadcasts it when small.
    bounds = reliable_checkpoint(bounds, "rank-bounds")
    w = Window.partitionBy(by).orderBy(*_order_columns(df))
    return (ranked.join(bounds, by).where(F.col("_bin") >= F.col("_least"))
            .withColumn("_n", F.row_number().over(w))
            .where(F.col("_n") <= F.col("_quota")).select(*df.columns))
