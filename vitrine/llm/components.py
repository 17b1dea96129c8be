"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import discard, reliable_checkpoint


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v: long) -> (u, v): every node that is not its component's smallest, with the smallest.

    Large-star links each node's larger neighbours to its smallest neighbour,
    small-star its smaller ones; repeated until the edges are stars, which takes a
    number of rounds logarithmic in the size of a component.  Each round is two
    aggregations and joins on written tables, so no task holds a component and a
    hub's edges can be split; a round's tables go when the next edges are written.
    """
    edges = reliable_checkpoint(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = reliable_checkpoint(both.groupBy("u").agg(F.min("v").alias("m")), "large-min")
        large = both.join(near.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = reliable_checkpoint(large.where("u <> v").distinct(), "large")
        least = reliable_checkpoint(large.groupBy("u").agg(F.min("v").alias("m")), "small-min")
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        old = edges
        edges = reliable_checkpoint(
            small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
        )
        discard(old, near, large, least)
        after = _signature(edges)
        if after == before:
            return edges
        before = after
