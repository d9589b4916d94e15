"""From raw documents to encoded training data: five stages, each written and reread.

Stages take (spark, docs, sf_dir). All but the last return the columns of
documents; extra columns of the input pass through. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm import decontaminate, jaccard, pieces, quality, secrets
from finloom.llm.shared import small_batches, table
from finloom.session import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3; the machine learns from the labelled documents."""
    small_batches(spark)
    machine = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, machine, into="_score").where("_score >= 0.3").drop("_score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest id stays; rows without an id stay; equal rows by id and text stay once."""
    small_batches(spark)
    classes = jaccard.jaccard_classes(docs, k=5, percent=80)
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    some = docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    return some.unionByName(docs.where("doc_id IS NULL")).dropDuplicates(["doc_id", "text"])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    small_batches(spark)
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaked_items") == 0).drop("leaked_items")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become ``[kind]``; ``n_chars`` follows the text."""
    small_batches(spark)
    masked = secrets.mask(secrets.find_secrets(docs, into="_spans"), spans="_spans")
    changed = F.when(F.size("_spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed).drop("_spans")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its best segmentation and the scores of its n best ones."""
    small_batches(spark)
    coded = pieces.encode(docs)
    return coded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip", "scores")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]
#: SQL expresses neither the trained machine nor the lattice search; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
