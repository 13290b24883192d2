"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import collocations, licenses, mixing, near_dedup, order_minhash, prefix_trie, quality, repetition, secrets, simhash_index, toxicity, warc
from quarry.llm import sentencepiece_lattice as lattice
from quarry.llm.oracle import ORACLE_SQL  # noqa: F401
from quarry.sources.corpus import read_table


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of whole ``documents`` texts."""
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def _held_out(column, parts: int, rest: int):
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts)) == rest


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").filter(~_held_out(F.col("doc_id"), 3, 1)).select("doc_id", "quality")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of whole ``documents`` texts, learned from labels of rows that are not held out."""
    scored = quality.classify(read_table(spark, sf_dir, "documents"), quality_labels(spark, sf_dir))
    return scored.select("doc_id", _held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` mixed to domain, language and source weights."""
    return mixing.mixture(read_table(spark, sf_dir, "documents"), mixing.source_domain(F.col("source")), mixing.DEFAULT)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of whole ``documents`` texts and of their edited texts."""
    return order_minhash.edit_sensitivity(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole ``documents`` texts, learned from labels of rows that are not held out."""
    held = _held_out(F.col("doc_id"), 4, 2)
    labels = read_table(spark, sf_dir, "labels").filter(~held).select("doc_id", "toxic")
    scored = toxicity.classify(read_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_restored")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per ``pages`` row, read back."""
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages")).drop("target_uri")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in whole ``documents`` texts."""
    return licenses.license_scan(read_table(spark, sf_dir, "documents")).drop("matches")


def tokenizer_path() -> str:
    """The model file on the driver: QUARRY_PIECES, else the public 32k-piece model of this box."""
    return os.environ.get("QUARRY_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of whole ``documents`` texts."""
    return lattice.encode(read_table(spark, sf_dir, "documents"), lattice.load_pieces(tokenizer_path()))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality counts and suffix-array repetition of whole ``documents`` texts."""
    return repetition.quality_rules(read_table(spark, sf_dir, "documents")).drop("spans")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in whole ``documents`` texts."""
    return secrets.secret_scan(read_table(spark, sf_dir, "documents")).drop("places")


def rebuilt_trie(turns: DataFrame, cfg: prefix_trie.PrefixTrie = prefix_trie.PrefixTrie()) -> DataFrame:
    """The trie by op11's rule: which conversation lends its head to conv_id, and how many turns."""
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(5))
    keep = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefix_trie.prefix_trie(turns, base, keep, cfg)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of rebuilt ``conversations``."""
    return rebuilt_trie(read_table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase collocations of whole ``documents`` texts by language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near duplicates of whole ``documents`` texts."""
    return simhash_index.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_mixture": op2_mixture,
    "op3_order_minhash": op3_order_minhash,
    "op4_near_dedup": op4_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_license_scan": op7_license_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}
