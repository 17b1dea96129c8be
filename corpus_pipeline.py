"""Training-data pipeline over ``documents``: each stage applies one operator of ``vitrine.llm``.

Every stage works on all rows its predecessor kept.  All but the last return the
columns of ``documents``; the last returns the packing plan.  A stage's result is
written as Parquet in the shared scratch folder and read again as the next one's
input, so a lost executor repeats part of one stage at most; what a stage leaves
besides its result, and its input, are deleted when its result is written.

Every stage takes NULLs in any column, repeated rows and ids, texts of any length, extra
columns of any name (kept by all but the last) and an empty table (which stays empty).
NULL, empty and blank texts are no good documents, so the first stage drops them; given
to a later stage they are equal (exact dedup), have fingerprint zero (near-dedup), no
words (mixing) and one piece that holds the end id (packing).  Rows without a source are
a source of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import blocknames, mixing, packing, quality, simhash
from vitrine.llm.common import table
from vitrine.session import clear_scratch, reliable_checkpoint, scratch_mark


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps; it is trained on ``docs`` itself."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal normalised text."""
    return blocknames.drop_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints within two bits."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for."""
    return mixing.emit(mixing.mix(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every copy in sequences of at most 2048 tokens."""
    return packing.pack(docs, capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: The trained classifier, fingerprints and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mark = scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = reliable_checkpoint(stage(spark, docs, sf_dir), name)
        clear_scratch(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
