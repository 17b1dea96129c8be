"""Best-two-fit packing of tokenised documents into sequences.

Documents are tokenised where they lie; only (id, piece, length, checksum) rows
move.  Pieces are dealt by hash into groups of a few thousand and each group is
packed on its own: a group leaves at most about one part-filled sequence, so the
loss against one global packing is a fraction of a percent, and no task sees
more than a group whatever the input's size or skew.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import slices
from vitrine.session import reliable_checkpoint


def encoder(vocabulary: str, ranks: str) -> Callable[[str], bytes]:
    """text -> its token ids as little-endian unsigned 32-bit numbers.

    The ids are those of ``tokenizers`` on ``vocabulary``.  Byte-level pieces never
    span the place before a space that a visible character follows, so a text is
    split there and the parts' ids are remembered; parts not seen before are encoded
    with the same vocabulary given as ranks, which is several times as fast.  A text
    with other runs of white space or with a special token's string takes the
    tokenizer itself.  The memory is bounded and lives as long as the worker.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    odd = re.compile(r" (?=\s|\Z)" + "".join("|" + re.escape(s) for s in special))

    class Parts(dict):
        """Part without its leading space -> ids of the part with it."""

        def __missing__(self, part: str) -> bytes:
            ids = np.array(fast.encode_ordinary(" " + part), "<u4").tobytes()
            if len(part) <= 64:
                if len(self) >= 400_000:
                    self.clear()
                self[part] = ids
            return ids

    parts = Parts()

    def encode(text: str) -> bytes:
        if odd.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        head = np.array(fast.encode_ordinary(first), "<u4").tobytes()
        return head + b"".join(map(parts.__getitem__, rest))

    return encode


def _encoder_of_worker(vocabulary: str, ranks: str) -> Callable[[str], bytes]:
    import sys

    kept = sys.modules.setdefault("_vitrine_encoders", type(sys)("_vitrine_encoders")).__dict__
    key = f"{vocabulary}|{ranks}"
    if key not in kept:
        kept[key] = encoder(vocabulary, ranks)
    return kept[key]


def pieces(
    docs: DataFrame,
    capacity: int = 2048,
    end_id: int = 0,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32: each document's ids and ``end_id``,
    whole if they fit, else cut so that only the first piece is shorter than ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder_of_worker(vocabulary, ranks)
        for b in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total, capacity), total]
                rows += [
                    (doc_id, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z]))
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))
                ]
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(
        of, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; every length is from 1 to ``capacity``.

    A bin takes the largest unpacked length that fits until none does.  Then its
    smallest member gives way to two unpacked ones, if two of them fill the gap it
    leaves more tightly; the tightest such pair is taken.
    """
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        stock[lengths[i]].append(i)
    there = 0  # bit n: some unpacked length n
    for n, ids in enumerate(stock):
        if ids:
            there |= 1 << n

    def largest(limit: int) -> int:
        return (there & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 else -1

    def take(n: int) -> int:
        nonlocal there
        i = stock[n].pop()
        if not stock[n]:
            there ^= 1 << n
        return i

    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while there:
        members: list[int] = []
        gap = capacity
        while (n := largest(gap)) > 0:
            members.append(take(n))
            gap -= n
        if gap and len(members) > 1:
            small = int(lengths[members[-1]])
            room, best, pair = gap + small, small, None
            a = largest(room - 1)
            while a > 0 and 2 * a > best and best < room:
                b = largest(min(a, room - a))
                if b == a and len(stock[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = largest(a - 1)
            if pair:
                out = members.pop()
                members += [take(pair[0]), take(pair[1])]
                stock[small].append(out)
                there |= 1 << small
        at = 0
        for i in members:
            bins[i], offsets[i] = number, at
            at += int(lengths[i])
        number += 1
    return bins, offsets


def pack(
    docs: DataFrame, capacity: int = 2048, end_id: int = 0, group_pieces: int = 8192, **vocabulary: str
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    NULL and empty texts are one piece holding the end id.  Rows that repeat a
    doc_id are packed each on its own.  ``group_pieces`` is the mean number of
    pieces packed together; the number of groups follows the input.
    """
    cut = reliable_checkpoint(
        pieces(docs, capacity, end_id, **vocabulary).withColumn("uid", F.monotonically_increasing_id()), "pieces"
    )
    groups = max(1, -(-cut.count() // group_pieces))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid", kind="stable")
        bins, offsets = best_two_fit(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = (frame["grp"].to_numpy(np.int64) << 32) + bins
        frame["offset"] = offsets
        return frame.drop(columns=["uid", "grp"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return (
        cut.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)))
        .groupBy("grp")
        .applyInPandas(packed, schema)
    )
