"""Tag frequencies (A10) and the dataset card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.tags import tag_array
from vitrine.session import reliable_checkpoint

TAG_SCHEMA = "tag STRING, count BIGINT"
# Name fragments that make a column a tag candidate (fixed values).
TAG_COLUMN_HINTS = ("tag", "tags", "genre", "category", "top")


def top_tags(df: DataFrame, top_n: int = 10, tags_col: str = "tags") -> DataFrame:
    """A10: the N most frequent cleaned tags, count desc then tag asc.

    Each cell is parsed into tags (see ``vitrine.functions.tags``) and
    exploded; counting aggregates partially per partition, so a tag that
    occurs in a third of all rows costs one partial row per task.
    """
    if tags_col not in df.columns:
        return df.sparkSession.createDataFrame([], TAG_SCHEMA)
    # explode_outer + NULL filter: no inferred size() filter copying the parser.
    tags = (df.where(F.col(tags_col).isNotNull())
            .select(F.explode_outer(tag_array(F.col(tags_col))).alias("tag"))
            .where(F.col("tag").isNotNull()))
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col("tag").asc()).limit(int(top_n))


def tag_candidate_columns(columns: list[str]) -> list[str]:
    """Columns tried for the card, in order: tags, genres, then name matches."""
    out = [c for c in ("tags", "genres") if c in columns]
    out += [c for c in columns
            if c not in ("tags", "genres") and any(h in c.lower() for h in TAG_COLUMN_HINTS)]
    return out


def dataset_card(df: DataFrame, top_n: int = 5) -> DataFrame:
    """Row count and the top tags, from the first candidate column with any.

    Output: one row ``n_rows, tags_column, top_tags`` where ``top_tags`` is
    ``"tag (count), ..."`` or ``"N/A"``.  All candidates are tagged in one scan and counted in one
    aggregation (rows are counted as the tag of column -1); the first column with a
    tag is chosen in the plan.
    """
    names = tag_candidate_columns(df.columns)
    tagged = [F.transform(tag_array(F.col(f"`{c}`")), _at(i)) for i, c in enumerate(names)]
    row = F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("tag")))
    # explode_outer: no inferred size() filter copying the parsers.
    tags = df.select(F.explode_outer(F.concat(row, *tagged)).alias("t")).select("t.i", "t.tag")
    tags = tags.where((F.col("i") < 0) | F.col("tag").isNotNull())
    counts = reliable_checkpoint(tags.groupBy("i", "tag").agg(F.count(F.lit(1)).alias("count")), "tag-counts")
    first = counts.where("i >= 0").agg(F.min("i").alias("i"))
    best = counts.join(first, "i").orderBy(F.col("count").desc(), F.col("tag").asc()).limit(int(top_n))
    best = best.unionByName(counts.where("i < 0"))
    top = F.array_sort(F.collect_list(F.when(F.col("i") >= 0, F.struct((-F.col("count")).alias("c"), "tag"))))
    shown = F.transform(top, lambda t: F.concat(t["tag"], F.lit(" ("), (-t["c"]).cast("string"), F.lit(")")))
    named = F.max(F.when(F.col("i") >= 0, F.col("i")))
    column = F.get(F.array(*[F.lit(c) for c in names]), named) if names else F.lit(None).cast("string")
    return best.agg(F.coalesce(F.sum(F.when(F.col("i") < 0, F.col("count"))), F.lit(0)).cast("bigint").alias("n_rows"),
                    column.alias("tags_column"),
                    F.when(named.isNotNull(), F.array_join(shown, ", ")).otherwise(F.lit("N/A")).alias("top_tags"))


def _at(i: int):
    """The tag with the number of its column."""
    return lambda tag: F.struct(F.lit(i).alias("i"), tag.alias("tag"))
