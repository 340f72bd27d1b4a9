"""A corpus pipeline of five stages over the documents.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's input.
All but the last keep the columns of ``documents``; the last gives the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltbed.llm import containment, language_id, ngram_jaccard, piece_sampling, private_data
from siltbed.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return language_id.keep_identified(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8 or more, that with the smallest id stays."""
    return ngram_jaccard.keep_one(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return containment.decontaminate(docs, table(spark, sf_dir, "benchmark"), 5, 80)


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text."""
    return private_data.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts as piece ids: the tokenizer's encoding and two sampled segmentations."""
    return piece_sampling.encode(docs, choices=2_000_000)  # earlier stages have grown the executors' JVMs: workers keep less


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", decontaminate),
    ("PII", mask_private_data),
    ("SentencePiece encoding and decoding", encode_pieces),
]

ORACLE_SQL = None  # SQL can't state trained, perturbed or iterative stages; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
