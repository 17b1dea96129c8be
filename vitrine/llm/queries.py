"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import blocknames, chat, fingerprints, hardneg, langid, merkle, mixing, packing, quality, simhash, substrings, toxicity, urlfilter
from vitrine.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("quality_score").alias("score"), F.col("quality_kept").alias("predicted")
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), window=20)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2).drop("kept")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    clash = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", clash), (-7, 1, "assistant", clash)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(finite).select(
        "vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector")
    )
    return hardneg.mine(rows, F.col("vec_id") % 100 == 0)


#: The query's rules.
_RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), _RULES, urlfilter.train(urlfilter.labelled_urls(spark)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaf_rows = merkle.leaves(
        docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"text": F.when(hit, lowered).otherwise(F.col("text"))}
    )
    return merkle.manifest(leaf_rows).withColumnRenamed("id", "doc_id")


_OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((rk - 1) % 3) + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM r
), l AS (
  SELECT *, cap / weight AS level FROM w
), f AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
       - coalesce(sum(cap) OVER (ORDER BY level, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS water
  FROM l
), t AS (
  SELECT source, source_size,
    CASE WHEN water >= level THEN cap
         ELSE first_value(CASE WHEN water < level THEN water END IGNORE NULLS) OVER
              (ORDER BY level, rk ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight END AS target
  FROM f
), u AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END) AS whole,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END - whole AS part FROM t
), x AS (
  SELECT d.doc_id, d.size, u.*, k, whole + CASE WHEN
      (('0x' || substr(md5('mix:' || k || ':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 < part
    THEN 1 ELSE 0 END AS copies
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source, range(16) r(k)
), b AS (
  SELECT source, k FROM x GROUP BY source, k, target
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies)::BIGINT - target), k) = 1
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken
FROM x JOIN b ON x.source IS NOT DISTINCT FROM b.source AND x.k = b.k
"""

_OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

_OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(length('### ' || role || ': ') + length(text) + len(regexp_extract_all(text, '###|</turn>')) + length(chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_OP11_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::DOUBLE) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS found, b.vec_id AS found_id, a.label = b.label AS same,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, found_id, found) AS wish FROM s WHERE same AND found <> anchor
  QUALIFY wish <= 5
)
SELECT p.anchor_id, p.found_id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor, p.wish ORDER BY n.score DESC, n.found_id, n.found)::INTEGER AS rank,
  n.found_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

# crc32 by its polynomial, a bit at a time; runs as lists, climbed leaf by leaf.
_OP13_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang,
    list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [1::UBIGINT, 2, 3, 4, 5, 6, 7, 8]),
        lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))) AS rest,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(rest, 4294967295::UBIGINT) % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS seen
  FROM f
), leafs AS (
  SELECT doc_id, leaf, coalesce(seen, leaf) AS seen, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM l
), runs(tree, level, nodes) AS (
  SELECT tree, 0, list(leaf ORDER BY pos) FROM leafs GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(nodes)::BIGINT, 8), lambda i: sha256(array_to_string(nodes[i + 1 : i + 8], '')))
  FROM runs WHERE len(nodes) > 1
), above(level, nodes) AS (
  SELECT 0, list(nodes[1] ORDER BY tree) FROM runs WHERE len(nodes) = 1
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes)::BIGINT, 8), lambda i: sha256(array_to_string(nodes[i + 1 : i + 8], '')))
  FROM above WHERE len(nodes) > 1
), climb(doc_id, leaf, tree, up, level, pos, subroot, folded, proof) AS (
  SELECT doc_id, leaf, tree, false, 0, pos, NULL::VARCHAR, seen, '' FROM leafs
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree,
    c.up OR len(n.nodes) = 1,
    CASE WHEN len(n.nodes) = 1 THEN 0 ELSE c.level + 1 END,
    CASE WHEN len(n.nodes) = 1 THEN c.tree ELSE c.pos // 8 END,
    CASE WHEN len(n.nodes) = 1 AND NOT c.up THEN n.nodes[1] ELSE c.subroot END,
    CASE WHEN len(n.nodes) = 1 THEN c.folded ELSE
      sha256(array_to_string(n.nodes[c.pos // 8 * 8 + 1 : c.pos], '') || c.folded || array_to_string(n.nodes[c.pos + 2 : c.pos // 8 * 8 + 8], '')) END,
    CASE WHEN len(n.nodes) = 1 THEN c.proof ELSE
      c.proof || array_to_string(n.nodes[c.pos // 8 * 8 + 1 : c.pos], '') || array_to_string(n.nodes[c.pos + 2 : c.pos // 8 * 8 + 8], '') END
  FROM climb c JOIN (SELECT false AS up, tree, level, nodes FROM runs UNION ALL SELECT true, NULL, level, nodes FROM above) n
    ON n.up = c.up AND n.level = c.level AND (c.up OR n.tree = c.tree)
  WHERE NOT (c.up AND len(n.nodes) = 1)
)
SELECT c.doc_id, c.leaf, c.subroot, r.root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.root AS verified
FROM climb c JOIN (SELECT level, nodes[1] AS root FROM above WHERE len(nodes) = 1) r ON c.up AND c.level = r.level
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filter": op12_url_filter,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": _OP4_SQL, "op7_exact_dedup": _OP7_SQL, "op9_chat_format": _OP9_SQL, "op11_hard_negatives": _OP11_SQL, "op13_merkle_manifest": _OP13_SQL}
