"""A training corpus from ``documents``: each stage is one of the operators in ``modloom.llm``.

Toxic documents go, one document of every group of near copies stays, secrets are masked, sources
are mixed to their target weights, and the mix is packed into sequences. Each stage works on all
rows that the one before it kept; its result is a table in the shared folder.

Defined results: null and empty texts are clean, are copies of each other, hold no secret and are
packed as the end token; of rows without an id that form a group one stays; repeated rows are
copies; other columns pass through to the last stage's input; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modloom.llm import credentials, mixing, packing, simhash, tables, toxicity
from modloom.sources import storage


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` that the classifier, trained on the labels, does not call toxic."""
    model = toxicity.fit(docs, tables.read(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link: four-word shingles, 4 bits at most."""
    return simhash.keep_one(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return credentials.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1,024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secret_masking),
    ("source mix", source_mix),
    ("best-fit packing", sequence_packing),
]

#: A trained model, fingerprints and tokens are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. Tables on the way go as soon as the next stage is written."""
    docs, before = tables.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = storage.scratch_path(spark, name.replace(" ", "-"))
        with storage.own_scratch(spark):
            result = stage(spark, docs, sf_dir)
            storage.write_table(result, path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before is not None:
            storage.drop_table(spark, before)
        before = path
    return docs
