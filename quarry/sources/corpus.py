"""Readers for the corpus, query and vector tables.

Column mapping happens once at ingestion; optional columns get defaults so
that every operator downstream sees a fixed schema:

* corpus  -> ``doc_id BIGINT, text STRING, source STRING, label STRING``
* queries -> ``query_id BIGINT, text STRING``
* vectors -> ``vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT``
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def map_columns(df: DataFrame, mapping: Mapping[str, str | None], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Select ``target <- source`` columns; absent optional sources become defaults."""
    defaults = dict(defaults or {})
    cols = []
    for target, source in mapping.items():
        if source is not None and source in df.columns:
            cols.append(F.col(source).alias(target))
        elif target in defaults:
            cols.append(F.lit(defaults[target]).alias(target))
        else:
            raise KeyError(f"required column {source!r} (for {target!r}) not found in {df.columns}")
    return df.select(*cols)


def corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source",
           label_col: str | None = "lang") -> DataFrame:
    """Normalise a passage table. A missing source column shows the default source
    (nulls inside a present column are kept); a missing label column is NULL."""
    out = map_columns(
        df,
        {"doc_id": id_col, "text": text_col, "source": source_col, "label": label_col},
        {"source": config.DEFAULT_SOURCE_FIXED, "label": None},
    )
    return out.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"),
        F.col("source").cast("string"), F.col("label").cast("string"),
    )


def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(read_table(spark, sf_dir, "documents"))


def queries(df: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("query_id"), F.col(text_col).cast("string").alias("text"))


def read_benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(read_table(spark, sf_dir, "benchmark"))


def turn_id(conv: str, turn: str):
    """One id for a conversation's turn: unique for turns of 0 to 2^31 - 1 and conversations below 2^32."""
    return F.shiftleft(F.col(conv).cast("long"), 31) + F.col(turn).cast("long")


def read_user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations as a query table; see ``turn_id``."""
    conv = read_table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "user").select(
        turn_id("conv_id", "turn").alias("query_id"),
        F.col("text").cast("string").alias("text"),
    )


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    out = df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("embedding"),
        (F.col(label_col).cast("int") if label_col and label_col in df.columns else F.lit(None).cast("int")).alias("label"),
    )
    return out


def read_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(read_table(spark, sf_dir, "embeddings"))
