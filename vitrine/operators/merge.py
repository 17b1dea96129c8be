"""Union, keep-first de-duplication and the snapshot merge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import scratch_path


def union_all(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by column name, duplicates kept."""
    return first.unionByName(second)


def keep_first(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """One row per key, the one with the smallest ``order_by`` tuple.

    Spark rows have no order, so "first" needs explicit ordering columns
    (e.g. snapshot priority, then position in the file).  All NULL keys form
    one key.  ``min_by`` aggregates partially before the shuffle, so a key
    holding a third of all rows costs one partial row per task, never a
    sorted group.  The ordering columns are kept in the output.
    """
    payload = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in payload]),
                 F.struct(*[F.col(c) for c in order_by])).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in payload]).select(*df.columns)


def conform(df: DataFrame, columns: list[str], rename: dict[str, str] | None = None,
            constants: dict[str, object] | None = None) -> DataFrame:
    """Rename columns, add constant columns, select in a master order."""
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    for name, value in (constants or {}).items():
        df = df.withColumn(name, F.lit(value))
    return df.select(*columns)


def with_position(df: DataFrame, priority: int) -> DataFrame:
    """Attach ``_priority`` to rows that carry a file position (``_file``,
    ``_pos``; see ``sources.csv.read_csv(position=True)``) for ``keep_first``.
    """
    if "_file" not in df.columns:
        df = df.withColumn("_file", F.lit("")).withColumn("_pos", F.monotonically_increasing_id())
    return df.withColumn("_priority", F.lit(priority))


def merge_snapshots(newer: DataFrame, older: DataFrame, key: str, columns: list[str],
                    rename_older: dict[str, str] | None = None,
                    constants_older: dict[str, object] | None = None) -> DataFrame:
    """M1: conform the older snapshot, union after the newer one, keep first per key.

    Both inputs must carry ``_priority``, ``_file`` and ``_pos`` (see
    ``with_position``); they are dropped from the result.
    """
    helper = ["_priority", "_file", "_pos"]
    a = newer.select(*columns, *helper)
    b = conform(older, columns + helper, rename_older, constants_older)
    merged = keep_first(union_all(a, b), key, helper)
    return merged.drop(*helper)


def save_snapshot(rows: DataFrame, key: str, buckets: int = 64, path: str | None = None) -> str:
    """Write rows with one row per key as a table bucketed and sorted by the key; returns its name.

    The name is a temporary one of the session's catalogue; the files lie in ``path`` (default: the
    shared scratch folder).  Rows that already lie in a bucketed table go to their
    buckets without a shuffle.
    """
    name = f"snapshot_{uuid.uuid4().hex}"
    (rows.write.bucketBy(buckets, key).sortBy(key).option("path", path or scratch_path(rows.sparkSession, name))
     .saveAsTable(name))
    return name


def merge_into_snapshot(spark: SparkSession, newer: DataFrame, older: str, key: str,
                        order_by: list[str]) -> DataFrame:
    """M1 step by step: ``older`` (a table of :func:`save_snapshot`) with the keys that ``newer`` lacks, and
    ``newer`` with the first row per key.

    Only the newer rows are shuffled, into the older table's buckets; the older rows are
    read where they lie.  All NULL keys are one key, as in :func:`keep_first`.
    """
    old = spark.table(older)
    first = keep_first(newer, key, order_by).select(*old.columns)
    # The NULL key equals no other in a join; whether the newer rows have it is one bounded question.
    lost_null = bool(newer.where(F.col(key).isNull()).take(1))
    stay = old.where(F.col(key).isNotNull()).join(first.select(key), key, "left_anti")
    if not lost_null:
        stay = stay.unionByName(old.where(F.col(key).isNull()))
    return first.unionByName(stay)
