"""Column profile of a table (A21-A23): one aggregation pass over all
columns, then ``unpivot`` to one row per column; never a job per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.quantiles import column_quantiles
from vitrine.session import reliable_checkpoint

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def _missing(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_share(df: DataFrame, top: int = 10) -> DataFrame:
    """Fraction of missing values per column, the ``top`` worst first.

    NaN counts as missing.  Ties by column name.  Output: column_name, missing_share.
    """
    aggs = [F.avg(F.when(_missing(df, c), 1.0).otherwise(0.0)).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    long = wide.unpivot([], df.columns, "column_name", "missing_share")
    return long.orderBy(F.col("missing_share").desc(), F.col("column_name").asc()).limit(int(top))


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer and floating columns (booleans excluded)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def describe(df: DataFrame, columns: list[str] | None = None, exact: bool = True,
             accuracy: int = 10000) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear), max per numeric column.

    Missing values (and NaN) are skipped.  The values are written once; one pass over all
    columns gives the moments and a sketch of each, and the counts that prove the quartiles
    take two more (``exact=False``: ``percentile_approx``).  Output: one row per column.
    """
    cols = columns or numeric_columns(df)

    def val(c):
        v = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(v), v)

    schema = "column_name string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    probs = [0.25, 0.5, 0.75]
    wide = reliable_checkpoint(df.select(*[val(c).alias(c) for c in cols]), "describe")
    moments = ["avg({c})", "stddev_samp({c})"]
    if exact:
        rows = column_quantiles(wide, cols, probs, moments)
    else:
        pa = f"CAST(percentile_approx({{c}}, array(0.25, 0.5, 0.75), {int(accuracy)}) AS ARRAY<DOUBLE>)"
        each = [F.expr(f"struct(count({c}) AS n, min({c}) AS min, max({c}) AS max, {pa.format(c=c)} AS q, "
                       f"array({', '.join(m.format(c=c) for m in moments)}) AS more)").alias(f"c{i}")
                for i, c in enumerate(f"`{x}`" for x in cols)]
        rows = [r.asDict() for r in wide.agg(*each).first()]
    return df.sparkSession.createDataFrame(
        [(c, r["n"], r["more"][0], r["more"][1], r["min"], *(r["q"] or [None] * 3), r["max"])
         for c, r in zip(cols, rows, strict=True)], schema)


def column_info(df: DataFrame) -> DataFrame:
    """Name, Spark type and non-null count of every column, in column order."""
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = wide.unpivot([], df.columns, "column_name", "non_null")
    types = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position INT, column_name STRING, dtype STRING")
    return types.join(long, "column_name").select("position", "column_name", "dtype", "non_null")
