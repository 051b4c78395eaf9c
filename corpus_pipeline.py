"""A training corpus from documents: rules, classifier, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the
shared folder and reads it again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm import classifier, near_dup, packing, pii, quality_rules
from quadrel.llm.common import materialise, table
from quadrel.llm.queries import PATTERN, TOKENIZER, digest, held_out, trusted


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality_rules.passing(docs, trusted(table(spark, sf_dir, "labels")))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good, at 0.5.

    It learns from the labelled rows of documents itself: the stage before leaves few bad ones.
    """
    model = classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))
    return classifier.passing(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group by five-word shingles: the smallest id, and one row of it if several are the same."""
    return near_dup.kept_rows(docs, near_dup.near_duplicates(docs, near_dup.Settings(shingle=5)))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; n_chars follows the text."""
    cleaned = pii.sanitise(docs, pii.find(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences in windows of 2048."""
    pieces = materialise(digest(packing.cut(docs, TOKENIZER, PATTERN)), "pieces")
    return packing.assign(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The ratio, the classifier and the packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
