"""Shared pieces of the training-data operators: words, table access, Arrow batches."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as a plain character list, for ``translate``.
SPACES = " \t\n\x0b\x0c\r"
#: Columns of ``documents``.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fields(model: object) -> tuple:
    """A dataclass's values, to broadcast: plain data, which workers read without importing this package."""
    return tuple(getattr(model, f.name) for f in dataclasses.fields(model))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``; NULL ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text (at least one row).

    Every row is passed on; only the number of rows handled at once changes, so a task's
    working memory does not depend on how long the texts of a batch are.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text)))
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def bounded_sample(rows: DataFrame, limit: int, seed: int = 17) -> DataFrame:
    """The ``limit`` distinct rows of ``rows`` with the smallest hashes (all distinct rows if there are fewer).

    The same rows on every run and under any partitioning; rows that are equal in all columns
    count once.  Empty only if ``rows`` is.  Hashes are looked at from the small end, further
    up only where copies leave too few of them.
    """
    total = rows.count()
    share = min(1.0, 2 * limit / max(total, 1))
    h = F.xxhash64(*rows.columns, F.lit(seed))
    while True:
        low = h <= F.lit(min(2**63 - 1, int(share * 2.0**64) - 2**63))
        near = rows.select(h.alias("h")).where(low).distinct().orderBy("h").limit(limit)
        found, last = near.agg(F.count("h"), F.max("h")).first()
        if found >= limit or share >= 1.0:
            return rows.where(h <= F.lit(last)).distinct()
        share = min(1.0, 16 * share)
