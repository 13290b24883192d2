"""Persisted index tables (Parquet) and their manifest.

Layout under one folder (a new folder per build; never overwritten in place):

    docs/      doc_id, text, source, label           the corpus as read (never shuffled for the index)
    doc_ord/   doc_id, ord                           ord = dense rank of doc_id (ranks of zero-score ties)
    terms/     block, docs, words, sizes, at, tfs    forward index by document ranges, every token of >= 2 chars
    vocab/     term, df, idf, term_index
    blocks/    terms, sizes, peaks, docs, at, tfs, weights, words  postings by document blocks (``operators.block_postings``)
    postings/  term, term_index, doc_id, tf, weight  the blocks as rows, in their order
    doc_vec/   doc_id, embedding                     hash-encoder unit vectors
    _manifest.json                                   config + row counts
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.session import path_exists
from quarry.config import IndexConfig

TABLES = ("docs", "doc_ord", "terms", "vocab", "postings", "blocks", "doc_vec")


class IndexNotFoundError(FileNotFoundError):
    """The index folder or one of its tables is missing: build the index first."""


@dataclass
class Index:
    path: str
    docs: DataFrame
    doc_ord: DataFrame
    terms: DataFrame
    vocab: DataFrame
    postings: DataFrame
    blocks: DataFrame
    doc_vec: DataFrame
    n_docs: int
    vocab_size: int
    cfg: IndexConfig

    def n_docs_frame(self) -> DataFrame:
        return self.docs.sparkSession.createDataFrame([(self.n_docs,)], "n long")


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    body = json.dumps(manifest, ensure_ascii=False, indent=1)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    if not path_exists(spark, f"{path}/_manifest"):
        raise IndexNotFoundError(f"no index at {path}; build it first (quarry.plans.index_build.build_index)")
    try:
        rows = spark.read.text(f"{path}/_manifest").collect()   # one small file
    except Exception as exc:  # noqa: BLE001 - remote stores raise their own types
        raise IndexNotFoundError(f"no index at {path}; build it first") from exc
    return json.loads("\n".join(r.value for r in rows))


def index_exists(spark: SparkSession, path: str) -> bool:
    try:
        read_manifest(spark, path)
        return True
    except IndexNotFoundError:
        return False


def load_index(spark: SparkSession, path: str) -> Index:
    man = read_manifest(spark, path)
    cfg = IndexConfig(
        min_df=man["min_df"], max_df=man["max_df"], remove_stopwords=man["remove_stopwords"],
        hash_dims=man["hash_dims"], stopwords=tuple(man["stopwords"]), dictionary=tuple(man["dictionary"]),
    )
    tables = {}
    for t in TABLES:
        if not path_exists(spark, f"{path}/{t}"):
            raise IndexNotFoundError(f"index table {t} missing under {path}")
        tables[t] = spark.read.parquet(f"{path}/{t}")
    tables["blocks"] = tables["blocks"].drop("words")   # searches go by number
    return Index(path=path, n_docs=man["n_docs"], vocab_size=man["vocab_size"], cfg=cfg, **tables)


def save_kmeans(model, path: str) -> None:
    """Write a fitted K-means model; an earlier one at ``path`` is replaced."""
    model.save(path)


def load_kmeans(spark: SparkSession, path: str):
    """The model that ``save_kmeans`` wrote; it assigns like the one that was saved."""
    from quarry.operators.kmeans import KMeansCentres

    if not path_exists(spark, f"{path}/metadata"):
        raise IndexNotFoundError(f"no K-means model at {path}; fit and save it first")
    return KMeansCentres.load(spark, path)
