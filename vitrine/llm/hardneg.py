"""Hard negatives by exact inner-product search over shared lists, one list a cluster of anchors.

Anchors are clustered by direction.  For a cluster with centre c whose members lie within an
angle t of it, no member u has an inner product with a row i above
``|u| * |i| * cos(max(0, angle(i, c) - t))``.  The rows of a shard are sorted by that bound
once a cluster, and every member walks the sorted list until the bound cannot reach its
worst kept score any more: what it has then is certified.

A block of anchors meets a shard of rows in one task, both of bounded size; a shard's best
rows are merged per anchor.  Two walks are made: for the positives only rows of the anchor's
label bucket take part, for the negatives all.  Rows are whole numbers, so scores and
ties are exact: sums that fit are computed in floating point, others in Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_sample
from vitrine.session import reliable_checkpoint

#: Steps of a walk start with so many rows and double up to so many.
_FIRST_STEP, _LAST_STEP = 64, 4096
#: Relative room for rounding in the bounds.
_ROOM = 1e-9
#: Scores are longs.
_LONG_LIMIT = 2**63 - 1


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers -> rows of ``width`` numbers; shorter lists end in zeros."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lists = lists.cast(pa.large_list(pa.int64()))
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


def exact_type(most_a: float, most_b: float) -> type:
    """A type in which every partial sum of an inner product of vectors so long is exact."""
    most = most_a * most_b * (1 + _ROOM)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def directions(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    return rows / np.where(size > 0, size, 1.0)[:, None]


def centres(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over the directions of a sample; at least one centre."""
    size = lengths(sample)
    unit = directions(sample, size)[size > 0]
    if not len(unit):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 0))
    centre = unit[:: max(1, len(unit) // clusters)][:clusters]
    for _ in range(rounds):
        of = (unit @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, of, unit)
        norm = np.linalg.norm(total, axis=1)
        centre = np.where(norm[:, None] > 0, total / np.where(norm > 0, norm, 1.0)[:, None], centre)
    return centre


class Members:
    """Anchors of one cluster, with one wish each (positives) or several (a wish for each positive).

    A wish asks for the ``k`` best rows whose score lies in [low, high] and whose label equals the
    anchor's, or differs from it.
    """

    def __init__(self, row: np.ndarray, label: np.ndarray, vectors: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.row, self.label, self.vectors, self.owner, self.low, self.high, self.k, self.same = row, label, vectors, owner, low, high, k, same
        self.size = lengths(vectors)

    def bounds(self, vectors: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For every row, the most that its inner product with a member of length one can be."""
        unit = directions(self.vectors, self.size)[self.size > 0]
        total = unit.sum(axis=0) if len(unit) else np.zeros(vectors.shape[1])
        norm = np.linalg.norm(total)
        if not norm:
            return size
        centre = total / norm
        apart = np.arccos(np.clip(unit @ centre, -1, 1)).max()
        angle = np.arccos(np.clip(directions(vectors, size) @ centre, -1, 1))
        return size * np.cos(np.maximum(0.0, angle - apart - 1e-7))

    def walk(self, rows: dict[str, np.ndarray], vectors: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(wish, place of the row, score) of every wish's best rows among ``rows``."""
        bound = self.bounds(vectors, size)
        order = np.argsort(-bound, kind="stable")
        bound = bound[order] + _ROOM * size[order]
        kind = exact_type(self.size.max(initial=0.0), size.max(initial=0.0))
        mine = self.vectors.astype(kind)
        worst = self.low.copy()  # a score below it is of no use to the wish
        wish, place, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object if kind is object else np.int64)
        at, step = 0, _FIRST_STEP
        active = np.arange(len(self.owner))
        while at < len(order):
            # Certified: no row from here on can reach the wish's worst useful score.
            least = worst[active].astype(np.float64)
            active = active[self.size[self.owner[active]] * bound[at] + 1e-6 >= least - np.abs(least) * _ROOM]
            if not len(active):
                break
            here = order[at : at + step]
            members, inverse = np.unique(self.owner[active], return_inverse=True)
            got = mine[members] @ vectors[here].astype(kind).T
            if kind is object and (np.abs(got) > _LONG_LIMIT).any():
                raise OverflowError("a score does not fit a long")
            match = self.label[members][:, None] == rows["label"][here][None, :]
            if not self.same:
                match = ~match
            else:
                match &= self.row[members][:, None] != rows["row"][here][None, :]
            least = np.full(len(members), np.inf)
            np.minimum.at(least, inverse, worst[active].astype(np.float64))
            least = (least - np.abs(least) * _ROOM).astype(np.float64 if kind is object else kind)  # at most the exact one
            i, j = np.nonzero(match & (got >= least[:, None]))
            value = got[i, j] if kind is object else got[i, j].astype(np.int64)
            # Each pair that may serve, once for every wish of its member.
            by_member = np.argsort(inverse, kind="stable")
            many = np.bincount(inverse, minlength=len(members))
            begin = np.cumsum(many) - many
            n = many[i]
            which = np.repeat(begin[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            w, v, p = active[by_member[which]], np.repeat(value, n), np.repeat(here[j], n)
            use = (v >= worst[w]) & (v <= self.high[w])
            wish, place, score = np.append(wish, w[use]), np.append(place, p[use]), np.append(score, v[use])
            # The k best of each wish: by score, then by id, NULL ids last.
            best = np.lexsort((rows["id"][place], rows["no_id"][place], -score, wish))
            wish, place, score = wish[best], place[best], score[best]
            first = np.searchsorted(wish, wish)
            rank = np.arange(len(wish)) - first
            keep = rank < self.k
            wish, place, score, rank = wish[keep], place[keep], score[keep], rank[keep]
            full = rank == self.k - 1
            worst[wish[full]] = score[full]
            at, step = at + len(here), min(2 * step, _LAST_STEP)
        return wish, place, score


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()


def _met(anchors: pa.Table, rows: pa.Table, width: int, k: int, same: bool) -> pa.Table:
    """Anchors of some clusters and a shard of rows -> what the shard offers each wish: anchor, wish, row, id, score."""
    ids, no_id = _ids(rows["vec_id"])
    table = {"row": rows["row"].to_numpy(), "label": rows["label"].to_numpy(), "id": ids, "no_id": no_id}
    vectors = matrix(rows["vector"], width)
    size = lengths(vectors)
    out: list[tuple] = []
    cluster = anchors["cluster"].to_numpy()
    order = np.argsort(cluster, kind="stable")
    edges = np.flatnonzero(np.diff(cluster[order], prepend=-1, append=-1))
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        part = anchors.take(pa.array(order[a:z]))
        wishes = part["wishes"].combine_chunks()
        owner = np.repeat(np.arange(len(part)), np.diff(wishes.offsets.to_numpy()))
        flat = wishes.flatten()
        low, high, number = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("low", "high", "wish"))
        m = Members(part["row"].to_numpy(), part["label"].to_numpy(), matrix(part["vector"], width), owner, low, high, k, same)
        wish, place, score = m.walk(table, vectors, size)
        out.append((m.row[owner[wish]], number[wish], table["row"][place], place, score))
    cols = [np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in range(5)]
    return pa.table(
        {
            "anchor": pa.array(cols[0], pa.int64()),
            "wish": pa.array(cols[1], pa.int64()),
            "found": pa.array(cols[2], pa.int64()),
            "found_id": rows["vec_id"].take(pa.array(cols[3], pa.int64())),
            "score": pa.array(cols[4].astype(np.int64), pa.int64()),
        }
    )


def _near(anchors: DataFrame, width: int, sample_anchors: int, clusters: int) -> DataFrame:
    """``anchors`` with ``near``, the centre of the nearest direction; centres are fitted on a bounded sample."""
    sample = bounded_sample(anchors.select("vector"), sample_anchors).toArrow()
    sent = matrix(sample["vector"], width)
    centre = centres(sent[np.lexsort(sent.T)] if len(sent) else sent, clusters)  # the same on every run

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = matrix(b.column(b.schema.get_field_index("vector")), width)
            near = (directions(rows, lengths(rows)) @ centre.T).argmax(axis=1)
            yield b.append_column("near", pa.array(near, pa.int64()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(of, f"{kinds}, near long")


def _search(anchors: DataFrame, rows: DataFrame, width: int, k: int, same: bool, members: int, block: int, shard: int) -> DataFrame:
    """anchors (bucket, row, label, vector, near, wishes), rows (bucket, row, vec_id, label, vector) ->
    anchor, wish, rank, found, found_id, score: the k best rows of each wish.

    In a bucket every block of anchors meets every shard of rows.  A bucket has as many clusters,
    blocks and shards as its counts ask for (one row a bucket and centre), so a hot label or
    direction has more of them, not larger ones.
    """
    count = F.count(F.lit(1))
    pieces = reliable_checkpoint(anchors.groupBy("bucket", "near").agg(F.ceil(count / members).alias("pieces"), count.alias("n")), "pieces")
    sizes = (
        rows.groupBy("bucket")
        .agg(F.ceil(count / shard).cast("int").alias("shards"))
        .join(pieces.groupBy("bucket").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")), "bucket")
    )
    sizes = reliable_checkpoint(sizes, "sizes")
    anchors = anchors.join(pieces.drop("n"), ["bucket", "near"])
    anchors = anchors.withColumn("cluster", F.xxhash64("near", F.pmod(F.xxhash64("row"), "pieces"))).drop("near", "pieces")

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        """Each row with the number of its block (shard), once for every shard (block) of the bucket."""
        met = df.join(sizes, "bucket").withColumn(own, F.pmod(F.xxhash64(by), F.col(f"{own}s")).cast("int"))
        met = met.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("shards", "blocks")
        return met.groupBy("bucket", "block", "shard")

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        return _met(a, b, width, k, same)

    pairs = dealt(anchors, "cluster", "block", "shard").cogroup(dealt(rows, "row", "shard", "block"))
    offers = pairs.applyInArrow(met, "anchor long, wish long, found long, found_id long, score long")
    best = Window.partitionBy("anchor", "wish").orderBy(F.col("score").desc(), F.col("found_id").asc_nulls_last(), "found")
    return offers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    least: tuple[int, int] = (30, 100),
    most: tuple[int, int] = (90, 100),
    sample_anchors: int = 4096,
    clusters: int = 64,
    members: int = 256,
    block_values: int = 1 << 19,
    shard_values: int = 1 << 17,
    buckets: int = 64,
) -> DataFrame:
    """(vec_id, label, vector: whole numbers) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its inner product with the anchor; higher scores come first, ties by
    smaller id (NULL ids last).  An anchor's positives are its ``positives`` best other rows of
    its label, its negatives for each of them the ``negatives`` best rows of other labels with
    ``least * positive_score <= negative_score <= most * positive_score`` (fractions).

    Rows with a NULL label, vector or component take no part, nor do they count as anchors.
    Shorter vectors end in zeros; empty and zero ones score 0.  Rows that repeat an id are
    rows, and anchors, of their own.  A score beyond a long raises OverflowError.  Anchors
    without a positive or a negative give no row, an empty table none.  Other columns are not read.

    Centres are fitted on at most ``sample_anchors`` anchors; a cluster has about ``members``;
    a block and a shard about ``block_values`` and ``shard_values`` numbers.  None of these
    changes the result.
    """
    rows = rows.select(
        "vec_id", F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")
    )
    whole = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", F.isnull)
    rows = reliable_checkpoint(rows.where(whole).withColumn("row", F.monotonically_increasing_id()), "vectors")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    block, shard = (max(64, v // max(width, 1)) for v in (block_values, shard_values))
    by_label = F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int").alias("bucket")
    everything = F.pmod("row", F.lit(1)).cast("int").alias("bucket")  # one bucket; not a constant, which would make a join without a key

    anchors = rows.where("is_anchor").select("row", "vec_id", "label", "vector")
    anchors = reliable_checkpoint(_near(anchors, width, sample_anchors, clusters), "anchors")
    wish = "array<struct<wish: long, low: long, high: long>>"
    any_score = F.array(F.struct(F.lit(0), F.lit(-_LONG_LIMIT), F.lit(_LONG_LIMIT))).cast(wish)
    found = _search(
        anchors.select(by_label, "row", "label", "vector", "near", any_score.alias("wishes")),
        rows.select(by_label, "row", "vec_id", "label", "vector"),
        width, positives, True, members, block, shard,
    )
    found = reliable_checkpoint(
        found.select("anchor", F.col("rank").cast("long").alias("wish"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives",
    )

    # Whole bounds: the least and greatest whole score within the fractions.
    p = F.col("positive_score")
    wide = "CAST(positive_score AS DECIMAL(28, 0))"  # products beyond a long
    low, high = F.expr(f"-((-{wide} * {least[0]}) div {least[1]})"), F.expr(f"({wide} * {most[0]}) div {most[1]}")
    wishes = (
        found.where(p >= 0)  # below zero no score lies within the fractions
        .groupBy("anchor")
        .agg(F.collect_list(F.struct("wish", low.alias("low"), high.alias("high"))).cast(wish).alias("wishes"))
    )
    wanted = anchors.join(wishes.withColumnRenamed("anchor", "row"), "row")
    negative = _search(
        wanted.select(everything, "row", "label", "vector", "near", "wishes"),
        rows.select(everything, "row", "vec_id", "label", "vector"),
        width, negatives, False, members, block, shard,
    )
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        negative.select("anchor", "wish", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(found, ["anchor", "wish"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
