"""A training corpus from raw documents: STAGES one after the other, each on all that the one before kept.

Toxic documents go, one document of each group of near copies stays, secrets are replaced by a mark, sources are mixed to
their target weights (a document taken k times comes k times), and texts are encoded. An empty table of documents stays empty
in every stage; other columns pass through all of them, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparrowmill.llm import jaccard_join, runtime, secret_scan, sentencepiece_codec, source_mix, toxicity_chain


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the chain, fitted on the labels of sf_dir, doesn't reject. Null and empty texts have the models'
    base rates, so they stay while toxic labels are the fewer ones; repeated rows stay or go alike; without labels all stay."""
    return toxicity_chain.reject(docs, runtime.read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents, that of the smallest doc_id. Null and empty texts link with nothing and
    stay; of repeated rows one stays; of rows of one doc_id with unlike texts, the one whose text comes first by hash."""
    return jaccard_join.first_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret of the whole text replaced by a mark and n_chars counted anew; null texts stay null."""
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to 3 times; texts without words never. Rows of one doc_id, source and size
    are taken alike."""
    return source_mix.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their texts' piece ids in `ids`, which replaces a column of that name; null texts have no ids."""
    return sentencepiece_codec.encode(docs)


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", near_copies), ("secret scans", secrets), ("mixing sources", mixing), ("SentencePiece", pieces)]

#: Trained models, recursive decoding and the vocabulary are beyond SQL. tests/llm hold each stage of a fixture against plain
#: Python: which documents stay, how often, with which texts and ids, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.documents(spark, sf_dir)
    folder = f"{runtime.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            runtime.remove(spark, f"{folder}/{i - 1}")
    return docs
