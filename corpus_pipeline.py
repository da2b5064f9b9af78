"""Corpus preparation in five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents. The toxicity model is trained, so SQL cannot express the whole;
tests hold the result against the stages' brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anvilgrid.llm import bpe, decontaminate, jaccard, pii, toxicity
from anvilgrid.llm.common import documents
from anvilgrid.session import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; it is fitted on the labels of the training folds."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, documents(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity connects, the one with the least id stays."""
    return jaccard.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; others lose the words of benchmark windows."""
    return decontaminate.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask_pii(docs, pii.fit_pii(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of ids and decoded text."""
    return bpe.encode_documents(docs, bpe.default_vocabulary(), decoded=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", keep_one_of_each_group),
    ("decontamination", remove_benchmark),
    ("pii", mask_personal_data),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; between them a written table."""
    work, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
