"""Substring de-duplication with one FM-index per shard.

A window is ``window`` consecutive words.  Its anchor is the smallest hash of the
``anchor`` words long sequences in it, so equal windows have equal anchors; runs of windows
with one anchor at one place form a segment, and segments are sharded by anchor.  An
anchor that occurs once proves its windows unrepeated; the others' segments, each
distinct one once (told apart by 128 bits of sha256 of their words), make up the shards.  In a shard the segments stream backwards
through the index of them all: matching statistics report the interval of every
window's occurrences, and the earliest place in it says whether the window starts
earlier elsewhere.  Later copies of a segment lose all its windows, its first
occurrence those that the index finds earlier.

Very common anchors, known from a sample, are avoided where a window has another,
and their runs are spread before counting, so neither a copied document nor a
common line fills a partition or a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_sample, slices
from vitrine.llm.fmindex import FMIndex
from vitrine.llm.wordhash import Words, sequences, sliding_min
from vitrine.session import reliable_checkpoint

#: Windows of a segment; their verdicts fit the bits of a long.
_RUN = 63


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) with unique keys in the order of doc_id; rows that repeat a doc_id, and NULL
    ones, count as documents of their own, by text."""
    docs = docs.select("doc_id", "text")
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1):
        return docs.select(F.coalesce("doc_id", F.lit(0)).alias("key"), "doc_id", "text")
    placed = docs.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    return reliable_checkpoint(placed.withColumn("key", F.monotonically_increasing_id()), "keyed").select(
        "key", "doc_id", "text"
    )


def common_sequences(docs: DataFrame, length: int, sample_docs: int = 5000, share: float = 0.005) -> np.ndarray:
    """Sorted hashes of word sequences in at least ``share`` of a sample of documents.

    They decide where windows are compared, never what is found.  At most the
    sample's sequences divided by ``share * sample_docs``.
    """
    least = max(3, int(share * sample_docs))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(b.column(1))
            seq, counts = sequences(words.hashes(), length), words.counts
            doc = np.repeat(np.arange(len(counts)), counts)
            seq = seq[doc[: len(seq)] == doc[length - 1 :]] if len(seq) else seq
            yield pa.RecordBatch.from_arrays([pa.array((seq >> np.uint64(1)).view(np.int64))], ["h"])

    sample = bounded_sample(docs.select(F.col("key").alias("doc_id"), "text"), sample_docs)
    found = sample.mapInArrow(of, "h long").groupBy("h").count().where(F.col("count") >= least).select("h")
    return np.sort(np.array([r[0] for r in found.collect()], np.int64))


def segment_runs(
    texts: pa.Array, common: np.ndarray, window: int, anchor: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(row, start, windows, anchor, segment) of the runs of windows with one anchor at one place; the
    segment is a digest of the run's words.

    A common anchor is negative and larger than any other while anchors are chosen.
    """
    words = Words(texts)
    hashes, counts = words.hashes(), words.counts
    n = len(hashes) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, none, []
    rank = sequences(hashes, anchor) >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, rank.view(np.int64)), len(common) - 1)
        rank = rank | ((common[at] == rank.view(np.int64)).astype(np.uint64) << np.uint64(63))
    least = sliding_min(rank, window - anchor + 1)[:n]
    row = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(whole):
        return none, none, none, none, []
    least, of = least[whole], row[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
    new[1:] |= rank[whole[:-1]] == least[:-1]  # the next window's anchor is another occurrence of it
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(whole)))
    parts = -(-size // _RUN)
    step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first, size = np.repeat(first, parts) + step * _RUN, np.repeat(size, parts)
    size = np.minimum(size - step * _RUN, _RUN)
    begin = whole[first]
    start = begin - (np.cumsum(counts) - counts)[of[first]]
    return of[first], start, size, least[first].view(np.int64), words.digests(begin, size + window - 1)


_RUNS = "key long, start int, n int, anchor long, seg binary"


def repeated_runs(docs: DataFrame, common: np.ndarray, window: int, anchor: int) -> DataFrame:
    """Runs whose anchor occurs more than once: key, start, n, anchor, seg."""
    sent = docs.sparkSession.sparkContext.broadcast(common)
    names = ["key", "start", "n", "anchor", "seg"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, start, n, chosen, seg = segment_runs(b.column(1), sent.value, window, anchor)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(chosen), pa.array(seg, pa.binary())],
                names,
            )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor -> those with a neighbour of the same anchor, and all common ones."""
        held, before = None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            a = t.column("anchor").to_numpy()
            near = np.zeros(len(a), bool)
            near[1:] = a[1:] == a[:-1]
            near[:-1] |= near[1:].copy()
            near[0] |= before is not None and a[0] == before
            near |= a < 0
            out = t.slice(0, len(a) - 1).filter(pa.array(near[:-1]))
            yield from out.to_batches()
            if len(a) > 1:
                before = a[-2]
            held = t.slice(len(a) - 1).combine_chunks().to_batches()[0]
        if held is not None and (held.column(3)[0].as_py() < 0 or held.column(3)[0].as_py() == before):
            yield held

    runs = docs.select("key", "text").mapInArrow(of, _RUNS)
    spread = F.when(F.col("anchor") < 0, F.xxhash64("key", "start")).otherwise(F.col("anchor"))
    return runs.repartition(spread).sortWithinPartitions("anchor").mapInArrow(shared, _RUNS)


def earlier_windows(segments: list[str], window: int) -> np.ndarray:
    """Distinct segments in the order of their first occurrence -> a bit for each window that starts
    earlier in the shard."""
    flat: list[str | None] = []
    starts = np.empty(len(segments), np.int64)
    for i, s in enumerate(segments):
        starts[i] = len(flat)
        flat += s.split(" ")
        flat.append(None)
    codes, names = pd.factorize(np.array(flat, object))
    text = codes.astype(np.int64) + 1  # the separator is 0
    index = FMIndex(text, len(names) + 1, window)
    ends = np.append(starts[1:], len(flat)) - 1
    found = index.matching_statistics([text[a:z] for a, z in zip(starts, ends, strict=True)])
    groups = np.flatnonzero(index.lcp[: index.n] < window)
    earliest = np.minimum.reduceat(index.places, groups)
    masks = np.zeros(len(segments), np.int64)
    for i, (length, lo, _) in enumerate(found):
        at = np.flatnonzero(length >= window)
        first = earliest[np.searchsorted(groups, lo[at], "right") - 1]
        late = at[first < starts[i] + at]
        masks[i] = int(np.bitwise_or.reduce(np.int64(1) << late)) if len(late) else 0
    return masks


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def remove_repeats(
    docs: DataFrame, window: int = 20, anchor: int = 6, shard_words: int = 200_000, keep_text: bool = False
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    A word goes if a window that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same document.  Windows are judged on the input.  NULL and short
    texts have no window.  Rows that repeat a doc_id count as later documents, in the
    order of their texts; NULL ids come first.  An empty table gives an empty result.
    """
    docs = _keyed(docs)
    common = common_sequences(docs, anchor)
    runs = reliable_checkpoint(repeated_runs(docs, common, window, anchor), "runs")
    distinct = reliable_checkpoint(
        runs.groupBy("anchor", "seg").agg(F.min(F.struct("key", "start")).alias("first"), F.max("n").alias("n")), "segments"
    )
    held = distinct.agg(F.sum(F.col("n") + (window - 1))).first()[0] or 0
    shards = max(1, -(-held // shard_words))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "anchor", "seg", "key", "start", "text"]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.string())
        for b in slices(batches):
            rows = []
            for key, text, segs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ws = _split(text)
                rows += [
                    (s["shard"], s["anchor"], s["seg"], key, s["start"], b" ".join(ws[s["start"] : s["start"] + s["n"] + window - 1]).decode())
                    for s in segs
                ]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def searched(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "start"], kind="stable")
        frame["mask"] = earlier_windows(frame["text"].tolist(), window)
        return frame.rename(columns={"key": "first_key", "start": "first_start"}).drop(columns=["shard", "text"])

    wanted = (
        distinct.select(
            F.col("first.key").alias("key"),
            F.struct(
                F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "seg", F.col("first.start").alias("start"), "n"
            ).alias("s"),
        )
        .groupBy("key")
        .agg(F.collect_list("s").alias("segs"))
    )
    found = (
        docs.join(wanted, "key")
        .select("key", "text", "segs")
        .mapInArrow(texts, "shard long, anchor long, seg binary, key long, start int, text string")
        .groupBy("shard")
        .applyInPandas(searched, "anchor long, seg binary, first_key long, first_start int, mask long")
    )
    found = reliable_checkpoint(found, "found")
    is_first = (F.col("key") == F.col("first_key")) & (F.col("start") == F.col("first_start"))
    every = F.expr("shiftrightunsigned(-1L, 64 - n)")
    gone = (
        runs.join(found, ["anchor", "seg"])
        .select("key", F.struct("start", F.when(is_first, F.col("mask")).otherwise(every).alias("mask")).alias("w"))
        .where("w.mask <> 0")
        .groupBy("key")
        .agg(F.collect_list("w").alias("gone"))
    )

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, windows in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ws = _split(text)
                if windows:
                    start = np.array([w["start"] for w in windows], np.int64)
                    mask = np.array([w["mask"] for w in windows], np.int64)
                    i, bit = np.nonzero(mask[:, None] >> np.arange(_RUN) & 1)
                    edge = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(edge, start[i] + bit, 1)
                    np.add.at(edge, start[i] + bit + window, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    left = [w for w, s in zip(ws, stay.tolist(), strict=True) if s]
                else:
                    left = ws
                out = b" ".join(left)
                rows.append((len(ws), len(ws) - len(left), hashlib.sha256(out).hexdigest(), out.decode() if keep_text else None))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    out = (
        docs.join(gone, "key", "left")
        .select("doc_id", "text", "gone")
        .mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )
    return out if keep_text else out.drop("kept_text")
