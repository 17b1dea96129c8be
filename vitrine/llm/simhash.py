"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into eight byte blocks.  Two fingerprints that differ
in at most two bits agree on at least six of them, so they meet under one of the
28 keys that leave two blocks out.  Under a key only 16 bits are free: a key has
at most 65,536 distinct fingerprints, and partners within distance are found by looking up the 136
masks of one or two bits, never by pairing all members.  Fingerprints, not
rows, are linked; copies share one fingerprint from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import slices
from vitrine.llm.components import components
from vitrine.session import reliable_checkpoint

_BLOCKS = list(combinations(range(8), 2))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of ``text`` (A-Z lower-cased), as an unsigned 64-bit number.

    Fewer words than ``shingle`` hash as one sequence; no words give zero.
    """
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # a very long text in bounded memory
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep_rows: bool = False) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): fp is the fingerprint's bit pattern as a signed long.

    With ``keep_rows`` a struct ``row`` of all columns of ``docs`` is added.
    """
    row = F.struct(*docs.columns) if keep_rows else F.lit(None).cast("int")
    docs = docs.select("doc_id", "text", row.alias("row"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(2)], ["doc_id", "fp", "row"])

    kind = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType()), docs.schema["row"]])
    out = docs.mapInArrow(of, kind)
    return out if keep_rows else out.drop("row")


def _mask(left_out: tuple[int, int]) -> int:
    mask = (1 << 64) - 1
    for block in left_out:
        mask &= ~(0xFF << (8 * block))
    return mask - (1 << 64) if mask >> 63 else mask


def _close_in_buckets(bucket: np.ndarray, free: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (member, smallest linked member) for rows sorted by bucket, each with 16 free bits."""
    keys = bucket.astype(np.int64) << 16 | free
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for m in masks:
        want = keys ^ m
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = np.flatnonzero((keys[at] == want) & (at > np.arange(len(keys))))
        left.append(hit)
        right.append(at[hit])
    i, j = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(keys))
    while True:  # smallest label over links: a few passes over what this bucket links
        new = label.copy()
        np.minimum.at(new, j, label[i])
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(keys)))
    return order[member], order[label[member]]


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Distinct ``fp`` -> links (u, v) that connect all fingerprints within ``max_bits`` (0 to 2)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("eight pigeonhole blocks with two left out cover at most two differing bits")
    masks = np.array(
        [1 << a for a in range(16) if max_bits >= 1]
        + [1 << a | 1 << b for a, b in combinations(range(16), 2) if max_bits >= 2],
        np.int64,
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (p, key); the last key of a batch waits for the rest of its rows."""
        rest = np.empty((0, 3), np.int64)
        empty = np.empty(0, np.int64)

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            u = v = empty
            if len(rows) > 1:
                starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
                sizes = np.diff(np.r_[starts, len(rows)])
                bucket = np.repeat(np.arange(len(starts)), sizes)
                rows, bucket = rows[(many := sizes[bucket] > 1)], bucket[many]
                if len(rows):
                    blocks = np.array(_BLOCKS)[rows[:, 0]]
                    fp = rows[:, 2].view(np.uint64)
                    a = fp >> (8 * blocks[:, 0]).astype(np.uint64) & np.uint64(255)
                    b = fp >> (8 * blocks[:, 1]).astype(np.uint64) & np.uint64(255)
                    i, j = _close_in_buckets(bucket, (a << np.uint64(8) | b).astype(np.int64), masks)
                    u, v = rows[i, 2], rows[j, 2]
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.concatenate([rest, rows])
            if not len(rows):
                continue
            last = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            cut = len(rows) - int(last[::-1].argmin() if not last.all() else len(rows))
            rest = rows[cut:]
            yield solve(rows[:cut])
        yield solve(rest)

    keys = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("key")) for p, b in enumerate(_BLOCKS)]))
    return (
        fps.select(keys.alias("k"), "fp")
        .select("k.p", "k.key", "fp")
        .repartition("p", "key")
        .sortWithinPartitions("p", "key")
        .mapInArrow(joined, "u long, v long")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, keep_rows: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits; exactly one row of a component is kept, its first
    with that doc_id.  Texts without words (NULL, empty, blank) have fingerprint
    zero and link like any other.  A NULL doc_id names a component only if all its
    ids are NULL.  Repeated rows and an empty table are fine.  With ``keep_rows`` a
    struct ``row`` of all columns of ``docs`` is added.
    """
    rows = reliable_checkpoint(
        fingerprints(docs, shingle, keep_rows).withColumn("row_id", F.monotonically_increasing_id()), "fingerprints"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row_id").alias("r")))
    distinct = reliable_checkpoint(rows.groupBy("fp").agg(first.alias("first")), "distinct-fps")
    stars = reliable_checkpoint(components(links(distinct.select("fp"), max_bits)), "stars")
    rooted = reliable_checkpoint(
        distinct.join(stars, distinct.fp == stars.u, "left").select("fp", "first", F.coalesce("v", "fp").alias("root")),
        "rooted",
    )
    named = reliable_checkpoint(rooted.groupBy("root").agg(F.min("first").alias("best")), "named")
    by_fp = reliable_checkpoint(rooted.join(named, "root").select("fp", "best"), "by-fp")
    return rows.join(by_fp, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.d").alias("component_id"),
        (F.col("row_id") == F.col("best.r")).alias("kept"),
        *(["row"] if keep_rows else []),
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``docs`` for each component, with its columns."""
    return near_duplicates(docs, shingle, max_bits, keep_rows=True).where("kept").select("row.*")
