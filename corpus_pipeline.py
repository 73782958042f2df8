"""From raw documents to packed training sequences, by five stages.

Each stage works on all that the one before kept.  ``run`` writes every stage's
result to the shared folder and reads it again, as a job that may lose executors
would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import vellum
from vellum.llm import decontaminate, packing, quality_rules, simhash, substrings
from vellum.llm.store import remove, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    vellum.ship(spark)
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of near-duplicates stays."""
    vellum.ship(spark)
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller doc_id has go from the texts; n_chars follows, all documents stay."""
    vellum.ship(spark)
    own = {c: f"__own_{c}" for c in docs.columns if c in ("n_words", "n_removed", "kept_sha256")}
    left = substrings.without_repeats(docs.withColumnsRenamed(own))
    n_chars = "if(n_removed > 0, cast(length(text) as bigint), n_chars) as n_chars"
    return left.selectExpr(*(n_chars if c == "n_chars" else f"`{own.get(c, c)}` as `{c}`" for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    vellum.ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    vellum.ship(spark)
    return packing.packed(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", pack),
]

#: Fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            remove(before)  # what a stage was made of isn't read again
    return docs
