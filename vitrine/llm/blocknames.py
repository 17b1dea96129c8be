"""Exact de-duplication by deterministic block naming.

The normalised text is cut into fixed-size blocks.  Distinct blocks are sorted
into integer names, adjacent pairs of names are named again, and so on until a
document has one name.  A name stands for a text and never for a hash of it, so
two documents share their final name exactly when their texts are equal.

The first block is named together with the length.  A document alone under that
name already has an identity no other row can share and needs no further naming;
only the others carry their text on.  Every grouping is aggregated before it is
shuffled and every join is between two shuffled sides, so Spark can split the
partition of a group that holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import SPACES
from vitrine.session import reliable_checkpoint


def normalised(text: str = "text"):
    """The text without white space; NULL counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def _named(keys: DataFrame, name: str) -> DataFrame:
    """Distinct rows of ``keys`` with an integer ``name``: sorted within each hash partition
    and numbered, then written, so every later read sees the same names."""
    cols = keys.columns
    sorted_keys = keys.distinct().sortWithinPartitions(*cols)
    return reliable_checkpoint(sorted_keys.withColumn("name", F.monotonically_increasing_id()), name)


def identities(rows: DataFrame, block_chars: int = 1024) -> DataFrame:
    """(row_id, norm) -> (row_id, size, name): equal texts have equal (size, name)."""
    size = F.length("norm")
    blocks = rows.select(
        "row_id",
        size.alias("size"),
        F.greatest(F.ceil(size / F.lit(block_chars)), F.lit(1)).alias("parts"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.ceil(size / F.lit(block_chars)), F.lit(1)) - 1),
                lambda i: F.substring(F.col("norm"), (i * block_chars + 1).cast("int"), F.lit(block_chars)),
            )
        ).alias("pos", "block"),
    )
    names = _named(blocks.select("block"), "blocks")
    level = reliable_checkpoint(blocks.join(names, "block").drop("block"), "level")
    longest = level.agg(F.max("parts")).first()[0] or 1
    done = [level.where("parts = 1").select("row_id", "size", "name")]
    while longest > 1:
        open_rows = level.where("parts > 1")
        side = F.col("pos") % 2
        pairs = reliable_checkpoint(
            open_rows.groupBy("row_id", "size", "parts", F.floor(F.col("pos") / 2).alias("pair")).agg(
                F.max(F.when(side == 0, F.col("name"))).alias("left_name"),
                F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("right_name"),
            ),
            "pairs",
        )
        names = _named(pairs.select("left_name", "right_name"), "pair-names")
        level = reliable_checkpoint(
            pairs.join(names, ["left_name", "right_name"]).select(
                "row_id",
                "size",
                F.ceil(F.col("parts") / 2).alias("parts"),
                F.col("pair").alias("pos"),
                "name",
            ),
            "level",
        )
        done.append(level.where("parts = 1").select("row_id", "size", "name"))
        longest = -(-longest // 2)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_duplicates(docs: DataFrame, block_chars: int = 1024, keep_rows: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised text the one with the most code points in its
    original text, then the smallest doc_id, then the first read stays; exactly
    one row of a group is kept, also when rows repeat a doc_id.  NULL text counts
    as empty; a NULL doc_id sorts first.  An empty table gives an empty result.
    With ``keep_rows`` a struct ``row`` of all columns of ``docs`` is added, whatever
    their names.
    """
    row = F.struct(*(docs.columns if keep_rows else ["doc_id", "text"])).alias("row")
    head = F.substring("norm", 1, block_chars)
    keyed = (
        docs.select(row)
        .withColumn("norm", normalised("row.text"))
        .select("row", F.length("norm").alias("size"), head.alias("head"))
    )
    heads = reliable_checkpoint(
        keyed.groupBy("size", "head").agg(F.count(F.lit(1)).alias("sharers")).where("sharers > 1"), "heads"
    )
    kept_row = ["row"] if keep_rows else []
    stored = reliable_checkpoint(
        keyed.join(heads, ["size", "head"], "left")
        .withColumn("norm", normalised("row.text"))
        .select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col("row.doc_id").alias("doc_id"),
            F.length(F.coalesce("row.text", F.lit(""))).alias("points"),
            F.sha2("norm", 256).alias("text_sha256"),
            F.when(F.col("sharers").isNotNull(), F.col("norm")).alias("norm"),
            *kept_row,
        ),
        "rows",
    )
    alone = stored.where("norm is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", *kept_row,
    )
    shared = stored.where("norm is not null")
    ident = reliable_checkpoint(
        shared.drop("norm").join(identities(shared.select("row_id", "norm"), block_chars), "row_id"), "identities"
    )
    groups = reliable_checkpoint(
        ident.groupBy("size", "name").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(
                F.struct((-F.col("points")).alias("p"), F.col("doc_id").alias("d"), F.col("row_id").alias("r"))
            ).alias("best"),
        ),
        "groups",
    )
    grouped = ident.join(groups, ["size", "name"]).select(
        "doc_id", F.col("best.d").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("best.r")).alias("kept"), "text_sha256", *kept_row,
    )
    return alone.unionByName(grouped)


def drop_exact_duplicates(docs: DataFrame, block_chars: int = 1024) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with their columns."""
    return exact_duplicates(docs, block_chars, keep_rows=True).where("kept").select("row.*")
