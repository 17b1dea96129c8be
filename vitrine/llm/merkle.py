"""Merkle manifest of a dataset, checked by a recursive query that climbs it.

Every row of a table is a leaf, the digest of its fields.  The leaves of a group, in the
order of their ids, are hashed in runs of ``arity``; the runs' digests again, until one
digest is left; the groups' digests likewise give the root.  Levels are built one after
another and stored as parent-linked rows: a family is a run of sibling digests with
the family of its own digest and the place there.

The check is a recursive query over those rows.  A run of leaves climbs together, each
leaf with its own folded digest: a step joins the parent family, appends the siblings
once for the run (they are common to its leaves), and folds every digest with them.
So the climb carries an eighth of the rows and no sibling is stored per leaf.

Texts are hashed where they lie; only digests are shuffled.  A group holding any share of
the rows is ranked by ranges, so nothing gathers it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vitrine.session import reliable_checkpoint

#: Bytes of a digest; stored so, and hashed as hex text.
_BYTES = 32


def field_text(name: str, kind: T.DataType) -> Column:
    """A field as it is hashed: ``-`` for NULL, else the UTF-8 byte count, ``:``, and the value."""
    value = F.col(name) if isinstance(kind, T.StringType) else F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    """sha256 of the concatenated texts, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` (written) with ``pos``, the 0-based place in the order of its group, and ``n``, the group's size.

    Rows are dealt by ranges of (group, order) and sorted there; a group's place in a partition
    follows from the counts of the partitions before it, one row a group and partition.  Rows
    that tie are dealt like others, by where they were read.
    """
    keys = [*group, *order]
    ranged = (
        rows.withColumn("dealt", F.monotonically_increasing_id())
        .repartitionByRange(*keys, "dealt")
        .sortWithinPartitions(*keys, "dealt")
        .drop("dealt")
        .withColumn("at", F.monotonically_increasing_id())
    )
    ranged = reliable_checkpoint(ranged, name).withColumn("part", F.shiftright("at", 33))
    counts = ranged.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    # One row a partition that holds rows of the group.
    w = Window.partitionBy(*[F.col(g) for g in group]).orderBy("part")
    before = F.coalesce(F.sum("here").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("here").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    counts = counts.select(
        *[F.col(g).alias(f"_{g}") for g in group], F.col("part").alias("_part"), (before - F.col("first")).alias("shift"), total.alias("n")
    )
    counts = reliable_checkpoint(counts, f"{name}-counts")  # its true size decides how it is joined
    same = F.col("part") == F.col("_part")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return ranged.join(counts, same).select(*rows.columns, (F.col("at") + F.col("shift")).cast("long").alias("pos"), F.col("n").cast("long").alias("n"))


def leaves(rows: DataFrame, fields: Sequence[str], id_col: str, group: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, grp, leaf, seen): the digest of each row's fields, and of the row as ``changed`` (field -> column of
    ``rows``) says it is now."""
    kinds = {f: rows.schema[f].dataType for f in fields}
    now = rows
    for f, c in (changed or {}).items():
        now = now.withColumn(f"now_{f}", c)
    own = digest(*[field_text(f, kinds[f]) for f in fields])
    seen = digest(*[field_text(f"now_{f}" if f in (changed or {}) else f, kinds[f]) for f in fields]) if changed else own
    return now.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), own.alias("leaf"), seen.alias("seen"))


def _joined(column: str, by: str) -> Column:
    """The digests of a run side by side, in the order of their places."""
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(by), F.col(column).alias("d"))))
    return F.aggregate(sorted_, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["d"]))


def _levels(nodes: DataFrame, most: int, arity: int, level: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (tree, pos, d, n) of one level -> the families of it and all above, and the last digest of each tree.

    ``most`` is the largest ``n``: it gives the number of levels.
    """
    families, tops = [], []
    while True:
        tops.append(nodes.where("n <= 1").select("tree", "d"))
        if most <= 1:
            break
        run = F.floor(F.col("pos") / arity).cast("long")
        fam = nodes.where("n > 1").groupBy("tree", run.alias("run"), "n").agg(_joined("d", "pos").alias("digests"))
        fam = reliable_checkpoint(fam.withColumn("level", F.lit(level).cast("long")), f"families-{level}")
        families.append(fam)
        nodes = fam.select(
            "tree", F.col("run").alias("pos"), digest(as_hex(F.col("digests"))).alias("d"), F.ceil(F.col("n") / arity).cast("long").alias("n")
        )
        most, level = -(-most // arity), level + 1
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return families, top


_CLIMB = """
WITH RECURSIVE climb(tree, run, up_tree, up_level, up_run, place, folded, proof) AS (
  SELECT tree, run, up_tree, up_level, up_run, place, folded, proof FROM {started}
  UNION ALL
  SELECT c.tree, c.run, f.up_tree, f.up_level, f.up_run, f.place,
    transform(c.folded, x -> unhex(sha2(lower(concat(
      hex(substring(f.digests, 1, CAST({size} * c.place AS INT))), hex(x),
      hex(substring(f.digests, CAST({size} * (c.place + 1) + 1 AS INT))))), 256))),
    concat(c.proof, substring(f.digests, 1, CAST({size} * c.place AS INT)), substring(f.digests, CAST({size} * (c.place + 1) + 1 AS INT)))
  FROM climb c JOIN {families} f ON c.up_tree = f.tree AND c.up_level = f.level AND c.up_run = f.run
)
SELECT tree, run, folded, proof FROM climb WHERE up_tree IS NULL LIMIT ALL
"""


def manifest(leaf_rows: DataFrame, arity: int = 8) -> DataFrame:
    """(id, grp, leaf, seen) -> id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` and ``seen`` are digests of a row as recorded and as it is now.  Groups come in
    the order of ``grp`` (NULL first, bytewise), leaves in that of ``id`` (NULL first; rows that
    repeat an id by their digest, so equal rows are interchangeable).  A lone leaf is its
    group's subroot, a lone subroot the root.  ``proof_sha256`` hashes the siblings from the
    leaf up to the root, ``folded_root`` is the root that ``seen`` and those siblings give.
    An empty table gives an empty result.
    """
    spark = leaf_rows.sparkSession
    rows = reliable_checkpoint(leaf_rows.select("id", "grp", "leaf", "seen"), "leaves")
    rows = placed(rows, ["grp"], ["id", "leaf"], "ranked")
    groups = reliable_checkpoint(rows.groupBy("grp").agg(F.max("n").alias("size")), "groups")
    groups = reliable_checkpoint(placed(groups, [], ["grp"], "ranked-groups").withColumnRenamed("pos", "tree"), "trees")
    most, trees = groups.agg(F.max("size"), F.max("n")).first()
    most, trees = most or 0, trees or 0

    member = F.array_sort(F.collect_list(F.struct("pos", "id", "leaf", "seen")))
    trees_of = groups.select(F.col("grp").alias("_grp"), "tree")
    runs = (
        rows.join(trees_of, F.col("grp").eqNullSafe(F.col("_grp")))
        .groupBy("tree", F.floor(F.col("pos") / arity).cast("long").alias("run"), "n")
        .agg(member.alias("members"))
    )
    side_by_side = F.aggregate("members", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["leaf"]))
    runs = reliable_checkpoint(runs, "runs").withColumn("digests", side_by_side)

    # Level 1 up to each group's subroot, then the tree of the subroots (-1).
    lone = F.col("n") <= 1
    first = runs.select(
        "tree",
        F.col("run").alias("pos"),
        F.when(lone, F.col("digests")).otherwise(digest(as_hex(F.col("digests")))).alias("d"),
        F.ceil(F.col("n") / arity).cast("long").alias("n"),
    )
    families, subroots = _levels(first, -(-most // arity), arity, 1)
    subroots = reliable_checkpoint(subroots, "subroots")
    last = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), "d", F.lit(trees).cast("long").alias("n"))
    above, top = _levels(last, trees, arity, 0)
    root = (top.select(as_hex(F.col("d"))).first() or [None])[0]

    def up(tree: Column, run: Column, level: Column, n: Column) -> list[Column]:
        """Where the digest of a run of ``n`` nodes belongs: the family above, that of the subroots, or none."""
        left = F.ceil(n / arity)
        inside = left > 1
        out = ~inside & (tree >= 0) & F.lit(trees > 1)
        return [
            F.when(inside, tree).when(out, F.lit(-1)).cast("long").alias("up_tree"),
            F.when(inside, level + 1).when(out, F.lit(0)).cast("long").alias("up_level"),
            F.floor(F.when(inside, run).when(out, tree) / arity).cast("long").alias("up_run"),
            F.pmod(F.when(inside, run).when(out, tree), F.lit(arity)).cast("long").alias("place"),
        ]

    tree, run, n = F.col("tree"), F.col("run"), F.col("n")
    linked = [f.select("tree", "level", "run", *up(tree, run, F.col("level"), n), "digests") for f in (*families, *above)]

    def folded(i: Column, m: Column) -> Column:
        left = F.substring(F.col("digests"), F.lit(1), (i * _BYTES).cast("int"))
        right = F.substring(F.col("digests"), (i * _BYTES + _BYTES + 1).cast("int"), F.lit(arity * _BYTES))
        return F.when(lone, m["seen"]).otherwise(digest(as_hex(left), as_hex(m["seen"]), as_hex(right)))

    started = runs.select(
        "tree", "run", *up(tree, run, F.lit(0), n), F.transform("members", lambda m, i: folded(i, m)).alias("folded"), F.lit(b"").cast("binary").alias("proof")
    )
    if linked:
        every = linked[0]
        for f in linked[1:]:
            every = every.unionByName(f)
        climbed = spark.sql(_CLIMB.replace("{size}", str(_BYTES)), started=started, families=reliable_checkpoint(every, "families"))
    else:  # no digest has a parent: the runs are the root
        climbed = started.select("tree", "run", "folded", "proof")
    climbed = reliable_checkpoint(climbed, "climbed")

    i = F.col("i")
    left = F.substring(F.col("digests"), F.lit(1), (i * _BYTES).cast("int"))
    right = F.substring(F.col("digests"), (i * _BYTES + _BYTES + 1).cast("int"), F.lit(arity * _BYTES))
    return (
        runs.join(climbed, ["tree", "run"])
        .join(subroots.withColumnRenamed("d", "subroot"), "tree")
        .select("digests", "subroot", "folded", "proof", F.posexplode("members").alias("i", "m"))
        .select(
            F.col("m.id").alias("id"),
            as_hex(F.col("m.leaf")).alias("leaf"),
            as_hex(F.col("subroot")).alias("subroot"),
            F.lit(root).cast("string").alias("root"),
            F.sha2(as_hex(F.concat(left, right, F.col("proof"))), 256).alias("proof_sha256"),
            as_hex(F.get("folded", i)).alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
