"""The corpus pipeline: quality classifier, quality rules, near-duplicate groups, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents. ORACLE_SQL is None: neither the classifier nor packing can be put in SQL; tests run every stage
on odd rows and compare the operators with plain versions.

In every stage a null text counts as empty: the classifier scores it, the rules reject it. Repeated rows and ids are each judged; of rows
with one id and text the near-duplicate stage keeps one, null ids can't be told apart there and stay. Very long texts are taken whole.
Other columns travel along untouched, whatever their names; only the secret scan changes text and n_chars. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracequarry.llm import op1_quality_crf, op3_secret_scan, op5_jaccard_join, op6_packing, op10_quality_rules
from tracequarry.llm.common import read, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by the line field reaches the cut."""
    return op1_quality_crf.accepted(docs, op1_quality_crf.train(docs, read(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return op10_quality_rules.kept_only(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return op5_jaccard_join.one_of_each(docs, 5, 80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced."""
    return op3_secret_scan.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    import public_tokenizers

    return op6_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
