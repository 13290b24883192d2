"""A training-corpus pipeline over ``documents``: quality, near duplicates, secrets, mixture, tokens.

Each stage maps (spark, docs, sf_dir) to a DataFrame that is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, near_dedup, quality, queries, secrets
from quarry.llm import sentencepiece_lattice as lattice
from quarry.plans.sizing import bounded_broadcast
from quarry.session import scratch_path, written
from quarry.sources.corpus import read_table

#: Near copies are gone by then, so no row is taken twice; what a leaf lacks its siblings give.
MIXTURE = dataclasses.replace(mixing.DEFAULT, share=0.8, epochs=1)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from the labels that op1 learns from."""
    return quality.keep_good(docs, queries.quality_labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the document of smallest id (rows without id, and all rows of that id, stay)."""
    gone = written(near_dedup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(bounded_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; no document is dropped."""
    return secrets.mask_secrets(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents by domain, language and source weights."""
    leaf = mixing.leaf_columns(mixing.source_domain(F.col("source")))
    rows = docs.select("doc_id", *leaf, mixing.tokens(F.col("text")).alias("n_tokens"))
    leaves = mixing.plan(written(rows, "tokens"), MIXTURE)
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", *leaf)
    return mixing.chosen(whole, leaves, MIXTURE).select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the texts."""
    return lattice.encode(docs, lattice.load_pieces(queries.tokenizer_path()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mixture", source_mixture),
    ("sentencepiece", sentencepiece),
]

#: A network's decisions can't be stated in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
