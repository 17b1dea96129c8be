"""CSV scan and sink (S1-S3) with pandas-compatible text conventions.

* Quoted cells may hold newlines and doubled quotes: ``multiLine`` and
  ``escape='"'``.  A multi-line CSV file cannot be split, so large inputs
  must come as many files (one task each); ``multiline=False`` makes files
  without embedded line breaks splittable.
* Every column is read as text and pandas' missing-value tokens become NULL;
  typing happens in the ingest (S5), never through a schema-inference pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.text import null_if_na_token

_READ_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
                 "mode": "PERMISSIVE"}
# Blanks at the edges of cells are part of the text.
_WRITE_OPTIONS = {"header": "true", "escape": '"', "quote": '"',
                  "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _header(spark: SparkSession, path: str, multiline: bool = True) -> list[str]:
    """Column names from the header line (reads one record)."""
    return (spark.read.options(**_READ_OPTIONS).option("multiLine", str(multiline).lower())
            .csv(path).columns)


def read_csv(spark: SparkSession, path: str, names: list[str] | None = None,
             na_tokens: bool = True, position: bool = False,
             multiline: bool = True) -> DataFrame:
    """Read CSV with a header row; all columns as STRING.

    ``names`` imposes column names by position (the header line is skipped,
    as ``read_csv(header=0, names=...)``).  With ``na_tokens`` the pandas
    missing-value tokens (``NA``, ``NaN``, ``null``, ``None``, ...) are NULL.
    With ``position`` the columns ``_file`` (source file) and ``_pos``
    (increasing within a file) are added straight after the scan; a
    multi-line CSV file is one split, so ``_pos`` follows the file order.
    """
    cols = list(names) if names else _header(spark, path, multiline)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
    df = (spark.read.options(**_READ_OPTIONS).option("enforceSchema", "true")
          .option("multiLine", str(multiline).lower()).schema(schema).csv(path))
    extra = []
    if position:
        extra = [F.col("_metadata.file_path").alias("_file"),
                 F.monotonically_increasing_id().alias("_pos")]
    if na_tokens or extra:
        df = df.select(*[(null_if_na_token(F.col(f"`{c}`")) if na_tokens else F.col(f"`{c}`"))
                         .alias(c) for c in cols], *extra)
    return df


# The text pandas reads as booleans by default.
_TRUE_TOKENS = ("True", "TRUE", "true")
_FALSE_TOKENS = ("False", "FALSE", "false")
_INT_RE = "^[ \\t]*[+-]?[0-9]+[ \\t]*\\z"
_FLOAT_RE = ("(?i)^[ \\t]*[+-]?(?:(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity)"
             "[ \\t]*\\z")


def infer_types(df: DataFrame) -> DataFrame:
    """Whole-column type inference as ``read_csv`` does it.

    One aggregation over all text columns counts, per column, the non-missing
    cells and those that look like integers, floats or booleans; then each
    column is cast: all integers and no missing value -> BIGINT; integers
    with missing values, or all floats -> DOUBLE; all True/False and no
    missing value -> BOOLEAN; no value at all -> DOUBLE; else STRING, also
    for whole numbers of which one is beyond BIGINT.
    Non-text columns are kept.
    """
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(text):
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count(F.when(v.rlike(_INT_RE), 1)).alias(f"i{i}"),
                 F.count(F.when(v.rlike(_INT_RE), F.trim(v).try_cast("bigint"))).alias(f"l{i}"),
                 F.count(F.when(v.rlike(_FLOAT_RE), 1)).alias(f"f{i}"),
                 F.count(F.when(v.isin(*_TRUE_TOKENS, *_FALSE_TOKENS), 1)).alias(f"b{i}")]
    st = df.agg(*aggs).first()
    rows = st["_rows"]
    kinds = {}
    for i, c in enumerate(text):
        n, ni, nf, nb = st[f"n{i}"], st[f"i{i}"], st[f"f{i}"], st[f"b{i}"]
        if n == 0:
            kinds[c] = "double"
        elif ni == n:
            if st[f"l{i}"] == n:  # a number beyond BIGINT leaves the column as text
                kinds[c] = "bigint" if n == rows else "double"
        elif nf == n:
            kinds[c] = "double"
        elif nb == n and n == rows:
            kinds[c] = "boolean"
    out = []
    for c in df.columns:
        col, kind = F.col(f"`{c}`"), kinds.get(c)
        if kind == "boolean":
            out.append(col.isin(*_TRUE_TOKENS).alias(c))
        elif kind:
            out.append(F.trim(col).try_cast(kind).alias(c))
        else:
            out.append(col)
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """S3: write with a header and no row index; a directory of part files."""
    df.write.mode(mode).options(**_WRITE_OPTIONS).csv(path)
    return path
