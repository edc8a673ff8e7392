"""The corpus pipeline: five stages over ``documents``, each of which reads what its predecessor kept.

Quality rules drop what they reject; of each near-duplicate group (documents that share 80 percent of their 5-word
shingles) the smallest doc_id stays; documents with benchmark passages go; personal data is replaced by its kind in
brackets; the rest is encoded, and decoded to prove it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowmill.llm import decontaminate, near, pieces, pii, quality
from knowmill.llm.common import delete, new_folder, owned, table

Docs = DataFrame


def quality_rules(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    return near.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    return pii.redact(docs)


def sentencepiece(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """doc_id, lang, source, the ids, their number, and whether decoding them gives the text."""
    ids = pieces.encode(docs, check="round_trip")  # in one pass
    return ids.select("doc_id", "lang", "source", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: Similarity joins and random fields have no SQL twin; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's own tables go when its result is written, and that when the next one has read it;
    the last result stays for the caller."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        with owned(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
