"""Corpus pipeline: toxicity, near-duplicates, personal data, source mix, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import shared_folder
from chronoweave.llm.mixing import mix_documents
from chronoweave.llm.pii import redact_documents
from chronoweave.llm.simhash import drop_near_duplicates
from chronoweave.llm.sp_lattice import encode_documents, model_path
from chronoweave.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from sf_dir's labels, calls toxic go; all others stay as they are."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates, by SimHash and by similarity of 0.8 over shingles of five words, the document with the smallest id stays."""
    return drop_near_duplicates(docs, words=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets, and n_chars follows the text; no document goes."""
    out = redact_documents(docs)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that the sources' words come to their targets, in shuffled shards."""
    return mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, exact (the ids decode to the text) for every row."""
    encoded = encode_documents(docs, model_path())
    return encoded.select(F.col("id").alias("doc_id"), "ids", F.size("ids").cast("bigint").alias("n_pieces"), "exact")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Learned scores, checksums and lattices are beyond SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
