"""Mixing sources to target weights.

Tokens (words) are summed per source, the sums give each source a target and a
repetition rate, and every document is emitted ``floor(rate)`` times plus one
hash-seeded Bernoulli copy with probability equal to the fraction.  Several seeds are
summed per source in one aggregation, and each source takes the one that comes
closest to its target.  Everything is a DataFrame expression.  The only shuffle of rows is the partial aggregation
per source; the per-source table is written and joined by whatever strategy its
true size allows, so a source holding a third of all rows is never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import WORD
from vitrine.session import reliable_checkpoint


def word_count(text: str = "text") -> Column:
    """Number of words; NULL text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_rate: float = 2.0
) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes`` has ``source`` and ``size``.  Sources ordered by code point (NULL
    last) get the weights in turn.  The targets split ``share`` of all words by
    weight; one that exceeds ``max_rate`` times its source stops there and the
    excess is shared again by weight.  With sources sorted by cap / weight the
    stopped ones are a prefix, so running sums give the level in one pass.
    """
    w_all = Window.partitionBy()
    by_level = Window.orderBy("level", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    pick = F.array(*[F.lit(float(w)) for w in weights])
    per_source = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(pick, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn(
            "water",
            (F.sum("source_size").over(w_all) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("weight").over(w_all) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        )
    )
    common = F.first(F.when(F.col("water") < F.col("level"), F.col("water")), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return per_source.withColumn("common", common).select(
        "source",
        "source_size",
        F.when(F.col("water") >= F.col("level"), F.col("cap"))
        .otherwise(F.col("common") * F.col("weight"))
        .alias("target"),
    )


def bernoulli_draw(doc_id: str, seed: str, attempt: Column) -> Column:
    """A number in [0, 1) from the md5 of seed, attempt and id: reruns and any partitioning agree."""
    digest = F.md5(F.concat(F.lit(seed + ":"), attempt.cast("string"), F.lit(":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_rate: float = 2.0,
    seed: str = "mix",
    attempts: int = 16,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, ...): doc_id, source, size, source_size, target, copies, and ``row``, the
    whole row as a struct, whatever its columns are called.

    Of ``attempts`` draws each source takes the one whose words come closest to its target.
    NULL text has size 0, a NULL source is a source of its own, a source without
    words has target 0 and rate 0.  Rows that repeat a doc_id draw alike.  An empty
    table stays empty.
    """
    sized = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.col("source").alias("source"), word_count().alias("size"))
    sizes = reliable_checkpoint(sized.select("doc_id", "source", "size"), "sizes")
    targets = reliable_checkpoint(source_targets(sizes, weights, share, max_rate), "targets").withColumnRenamed("source", "target_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    same = F.col("source").eqNullSafe(F.col("target_source"))
    targets = targets.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.col("whole"))

    def one_more(attempt: Column) -> Column:
        return F.when(bernoulli_draw("doc_id", seed, attempt) < F.col("part"), 1).otherwise(0)

    sums = [F.sum(F.col("size") * (F.col("whole") + one_more(F.lit(k)))).alias(f"taken_{k}") for k in range(attempts)]
    taken = sizes.join(targets, same).groupBy("target_source", "source_size", "target", "whole", "part").agg(*sums)
    off = F.array_min(F.array(*[F.struct(F.abs(F.col(f"taken_{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(attempts)]))
    best = taken.select("target_source", "source_size", "target", "whole", "part", off["k"].alias("attempt"))
    best = reliable_checkpoint(best, "attempts")  # one row a source
    return sized.join(best, same).select(
        "doc_id", "source", "row", "size", "source_size", "target", (F.col("whole") + one_more(F.col("attempt"))).alias("copies")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of :func:`mix`, each ``copies`` times, with the columns they came with; rows with none are left out of the mix."""
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
