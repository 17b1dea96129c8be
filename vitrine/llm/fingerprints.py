"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs (lines, cut at sentence ends) are hashed to 64-bit digests.
A sketch is a number of blocks of 32 cells; a digest adds itself to one cell in
each of a block's three parts.  A cell holds a count, the xor of its digests and the
xor of their check values.  Two versions' sketches subtract cell by cell, which
leaves the differing digests, and peeling recovers them: a cell with one digest
names it, it is taken out of its other cells, and so on.  If a block doesn't
peel, both versions are sketched again with half as many blocks more.

All of it is column expressions; the only rows that move are a document's text
once, by its id, and the opening of the next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import reliable_checkpoint

#: Blocks of the attempts after the one-block fingerprint; an attempt ends at its first block that doesn't
#: peel.  Beyond them the digest sets are compared as they are.
LADDER = (2, 3, 5, 8, 12, 18, 27, 40, 60, 90, 135)
_PARTS = ((0, 11), (11, 11), (22, 10))  # first cell and cells of the parts of a block
_ROUNDS = 16


def digests(text: Column) -> Column:
    """Distinct paragraph digests: lines, cut after sentence ends, without blanks around."""
    cut = F.split(text, r"\n+|(?<=[.!?])[ \t]+")
    trimmed = F.transform(cut, lambda p: F.trim(p))
    return F.array_distinct(F.transform(F.filter(trimmed, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _entry(key: Column, sign: Column) -> Column:
    """What a digest adds: sign, digest, check value and its three cells in a block."""
    spread = F.xxhash64(key, F.lit(2))
    cells = [
        (F.pmod(F.shiftright(spread, 16 * i), F.lit(n)) + first).cast("int").alias(f"c{i}")
        for i, (first, n) in enumerate(_PARTS)
    ]
    return F.struct(sign.alias("n"), key.alias("key"), _check(key).alias("chk"), *cells)


def entries(keys: Column, sign: int = 1) -> Column:
    return F.transform(keys, lambda d: _entry(d, F.lit(sign)))


def _plus(x: Column, e: Column, times: int = 1) -> Column:
    return F.struct(
        (x["n"] + (e["n"] if times == 1 else -e["n"])).alias("n"),
        x["key"].bitwiseXOR(e["key"]).alias("key"),
        x["chk"].bitwiseXOR(e["chk"]).alias("chk"),
    )


def block(members: Column) -> Column:
    """The 32 cells of one block from its digests' entries."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("chk"))

    def part(i: int, first: int, n: int) -> Column:
        return F.transform(
            F.sequence(F.lit(first), F.lit(first + n - 1)),
            lambda c: F.aggregate(F.filter(members, lambda e: e[f"c{i}"] == c), zero, lambda x, e: _plus(x, e)),
        )

    return F.concat(*[part(i, first, n) for i, (first, n) in enumerate(_PARTS)])


def _alone(cells: Column) -> Column:
    """Entries of the digests that are by themselves in some cell."""

    def signed(sign: int) -> Column:
        pure = F.filter(cells, lambda x: (x["n"] == sign) & (x["chk"] == _check(x["key"])))
        keys = F.array_distinct(F.transform(pure, lambda x: x["key"]))
        return F.transform(keys, lambda d: _entry(d, F.lit(sign)))

    return F.concat(signed(1), signed(-1))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def peeled(cells: Column) -> Column:
    """Number of digests recovered from a block's difference, NULL if it doesn't peel."""

    def without(cells: Column, pure: Column) -> Column:
        def part(i: int, first: int, n: int) -> Column:
            return F.transform(
                F.slice(cells, first + 1, n),
                lambda x, j: F.aggregate(
                    F.filter(pure, lambda e: e[f"c{i}"] == j + first), x, lambda y, e: _plus(y, e, -1)
                ),
            )

        return F.concat(*[part(i, first, n) for i, (first, n) in enumerate(_PARTS)])

    def state(cells: Column, found: Column) -> Column:
        return _once(cells, lambda c: F.struct(c.alias("cells"), _alone(c).alias("pure"), found.alias("found")))

    def step(s: Column, _: Column) -> Column:
        more = state(without(s["cells"], s["pure"]), s["found"] + F.size(s["pure"]))
        return F.when(F.size(s["pure"]) == 0, s).otherwise(more)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_ROUNDS)),
        state(cells, F.lit(0)),
        step,
        lambda s: F.when(~F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["key"] != 0)), s["found"]),
    )


def _subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _plus(x, y, -1))


def differing(both: Column, first: Column, keys_a: Column, keys_b: Column) -> Column:
    """Digests in one of two versions only.

    ``first`` is the difference of their one-block sketches.  For the retries ``both``
    has the entries of one version and, negative, those of the other, so a larger
    sketch's cells come subtracted.  ``keys_a`` and ``keys_b`` are the digests.
    """

    def attempt(blocks: Column) -> Column:
        def one(total: Column, k: Column) -> Column:
            members = F.filter(both, lambda e: F.pmod(e["key"], blocks) == k)
            return F.when(total.isNotNull(), total + peeled(_once(members, block)))

        return F.aggregate(F.sequence(F.lit(0), blocks - 1), F.lit(0), one)

    # Every digest is in three cells, so at least this many differ; 20 in a block never peel.
    least = F.aggregate(first, F.lit(0), lambda s, x: s + F.abs(x["n"])) / F.lit(3)
    sizes = _once(least, lambda d: F.filter(F.array(*map(F.lit, LADDER)), lambda n: n * 20 >= d))
    larger = F.aggregate(sizes, F.lit(None).cast("int"), lambda done, n: F.coalesce(done, attempt(n)))
    exact = F.size(F.array_except(keys_a, keys_b)) + F.size(F.array_except(keys_b, keys_a))
    return F.coalesce(peeled(first), larger, exact)


def likeness(keys_a: Column, keys_b: Column, differ: Column) -> Column:
    """Shared digests over those of the larger version; 1 for two empty ones."""
    most = F.greatest(F.size(keys_a), F.size(keys_b))
    shared = (F.size(keys_a) + F.size(keys_b) - differ) / F.lit(2)
    return F.when(most == 0, F.lit(1.0)).otherwise(shared / most)


def written(text: Column, keys: Column, cells: Column) -> Column:
    """The sketch as text: digest of the whole text, number of paragraphs, then 32 cells of count, xor and check."""
    shown = F.transform(
        cells,
        lambda x: F.concat(
            x["n"].cast("string"), F.lit(":"), F.lower(F.hex(x["key"])), F.lit(":"), F.lower(F.hex(x["chk"]))
        ),
    )
    return F.concat(
        F.lower(F.hex(F.xxhash64(text))), F.lit(";"), F.size(keys).cast("string"), F.lit(";"), F.array_join(shown, ",")
    )


def following(keys: DataFrame) -> DataFrame:
    """Distinct ``k`` (with other columns) -> the same with ``next_k``, the next larger k; the first after the last.

    Keys are dealt by range and numbered, and only the first key of each range meets
    the others' firsts, so no task sees all keys.
    """
    placed = reliable_checkpoint(
        keys.repartitionByRange("k").sortWithinPartitions("k").withColumn("pos", F.monotonically_increasing_id()), "ranges"
    ).withColumn("range_id", F.shiftright("pos", 33))
    firsts = placed.groupBy("range_id").agg(F.min("k").alias("first_k"))
    order = Window.orderBy("range_id")
    firsts = firsts.select(
        "range_id",
        F.coalesce(F.lead("first_k").over(order), F.min("first_k").over(Window.partitionBy())).alias("after_k"),
    )
    within = F.lead("k").over(Window.partitionBy("range_id").orderBy("pos"))
    return (
        placed.withColumn("in_range", within)
        .join(reliable_checkpoint(firsts, "firsts"), "range_id")
        .withColumn("next_k", F.coalesce("in_range", "after_k"))
        .drop("in_range", "after_k", "range_id", "pos")
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of the code points (rounded down) replaced by
    the first as many of the next document by doc_id, the first's after the last.
    NULL text counts as empty, a NULL doc_id as the smallest (the smallest long itself
    is shown as NULL).  Rows that repeat a
    doc_id share the next document; of rows that repeat the next doc_id the smallest
    opening counts.  An only document is its own next.
    """
    # Both joins below shuffle exactly these columns by k, so Spark shuffles the texts once.
    no_id = F.lit(-(2**63))
    base = docs.select(F.coalesce("doc_id", no_id).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    ids = base.groupBy("k").agg(F.max(quarter).alias("quarter"))
    wanted = reliable_checkpoint(following(ids), "wanted").select(
        F.col("k").alias("prev_k"), F.col("next_k"), "quarter"
    )
    opening = F.struct(
        F.expr("left(text, quarter)").alias("text"), digests(F.col("text")).alias("keys")
    )
    heads = (
        base.join(wanted, F.col("k") == F.col("next_k"))
        .select("prev_k", opening.alias("head"))
        .groupBy("prev_k")
        .agg(F.min("head").alias("head"))
    )
    both = base.join(heads, F.col("k") == F.col("prev_k")).select(
        F.when(F.col("k") != no_id, F.col("k")).alias("doc_id"),
        "text",
        F.length("text").cast("long").alias("n_chars"),
        F.expr("concat(left(text, length(text) - cast(floor(length(text) / 4) as int)), left(head.text, cast(floor(length(text) / 4) as int)))").alias("edited"),
        F.col("head.keys").alias("keys_n"),
    )
    keyed = both.withColumn("keys", digests(F.col("text"))).withColumn("keys_e", digests(F.col("edited")))
    entered = keyed.select("*", *[entries(F.col(k)).alias(f"in_{k}") for k in ("keys", "keys_e", "keys_n")])
    sketched = entered.select(
        "*",
        *[block(F.col(f"in_{k}")).alias(f"of_{k}") for k in ("keys", "keys_e", "keys_n")],
        *[F.concat("in_keys", entries(F.col(k), -1)).alias(f"both_{k}") for k in ("keys_e", "keys_n")],
    )

    def near(other: str) -> Column:
        first = _subtracted(F.col("of_keys"), F.col(f"of_{other}"))
        return likeness(F.col("keys"), F.col(other), differing(F.col(f"both_{other}"), first, F.col("keys"), F.col(other)))

    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("text"), F.col("keys"), F.col("of_keys")).alias("fingerprint"),
        written(F.col("edited"), F.col("keys_e"), F.col("of_keys_e")).alias("edited_fingerprint"),
        near("keys_e").alias("near_edited"),
        near("keys_n").alias("near_next"),
    )
