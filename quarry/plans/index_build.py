"""Index build (offline "training"): corpus -> written index tables.

One tokenisation pass feeds everything: the forward table ``terms`` (every
token of >= 2 characters with its count per document, packed by document ranges)
is written first and read back by both the TF-IDF branch and the hash-encoder
branch, so the text is scanned once and each branch starts from a written table
(lineage cut).

Shuffles: the texts by ranges of doc_id, the forward rows' distinct words for
document frequency (combined before it) and to look up idf and number, and the
packed rows to meet what was found. No posting is shuffled or joined as a row of
its own, so a vocabulary too large to broadcast costs no more. Term counts and
norms are taken where a document's terms stand together.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import IndexConfig
from quarry.functions import text as T
from quarry.functions import vector as V
from quarry.operators.block_postings import blocks_of_forward, forward_blocks, unpack_blocks
from quarry.plans.sizing import bounded_broadcast, dense_ordinal, partitions_for, spread
from quarry.session import checkpoint_dir, files_fingerprint, grouped, small_batches
from quarry.sources import index_io
from quarry.sources.corpus import read_corpus, table_path

INDEX_FORMAT = 9   # bump when the layout or any formula changes
TEXT_PARTITION_CHARS = 16_000_000
# Spark's vectorized reader holds up to 4096 rows of a row group at once, here of megabytes each
TERMS_GROUP_ROWS, BLOCKS_GROUP_ROWS = 1, 4


def vocab_of(forward: DataFrame, n_docs: int, cfg: IndexConfig) -> DataFrame:
    """vocab(term, df, idf) after pruning, from the words of forward rows and their numbers of postings."""
    words = forward.select(F.explode(F.arrays_zip(F.col("words").alias("term"), F.col("sizes").alias("n"))).alias("e")).select("e.term", "e.n")
    if cfg.remove_stopwords and cfg.stopwords:
        words = words.filter(~F.col("term").isin(list(cfg.stopwords)))
    return (
        words.groupBy("term").agg(F.sum("n").cast("long").alias("df"))
        .filter((F.col("df") >= cfg.min_df) & (F.col("df") <= F.lit(float(cfg.max_df)) * F.lit(n_docs)))
        .withColumn("idf", F.log(F.lit(n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0)
    )


def build_index(
    docs: DataFrame,
    path: str,
    cfg: IndexConfig = IndexConfig(),
    max_broadcast_rows: int = 2_000_000,
    postings_partitions: int | None = None,
) -> index_io.Index:
    """Write all index tables under ``path`` and return them loaded from Parquet."""
    spark = docs.sparkSession
    shuffle_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = spread(docs.select("doc_id", "text", "source", "label"))

    base.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/docs")
    docs_w = spark.read.parquet(f"{path}/docs")
    size = docs_w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c")).first()
    n_docs = size["n"]
    # dense ordinal of doc_id (ranks of zero-score ties need #docs before an id): keys only, no text moves
    dense_ordinal(docs_w.select("doc_id"), "doc_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/doc_ord")

    # the one shuffle of the texts: ranges of doc_id, counted where they then lie
    parts = postings_partitions or partitions_for(size["c"] or 0, 1, shuffle_parts, TEXT_PARTITION_CHARS)
    ranged = docs_w.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    toks = ranged.select(F.col("doc_id").cast("long").alias("doc_id"), T.feature_tokens(T.tokens("text", cfg.dictionary)).alias("toks"))
    grouped(forward_blocks(toks), TERMS_GROUP_ROWS).mode("overwrite").option("compression", "zstd").parquet(f"{path}/terms")
    forward = spark.read.parquet(f"{path}/terms")

    dense_ordinal(vocab_of(forward, n_docs, cfg), "term", "term_index", carry=True).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vocab")
    vocab_w = spark.read.parquet(f"{path}/vocab")
    vocab_size = vocab_w.count()

    # each forward row's distinct words look up idf and number, whatever the vocabulary's size; its postings wait for them by row
    known = bounded_broadcast(vocab_w.select("term", "idf", "term_index"), max_broadcast_rows, vocab_size)
    words = forward.select("block", F.posexplode("words").alias("pos", "term"))
    found = words.join(known, "term").select("block", F.struct("pos", F.col("term_index").cast("int").alias("term_index"), "idf").alias("e"))
    found = found.repartition(parts, "block").groupBy("block").agg(F.collect_list("e").alias("found"))
    packed = blocks_of_forward(forward.repartition(parts, "block").join(found, "block"))
    with small_batches(spark):
        grouped(packed, BLOCKS_GROUP_ROWS).mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
        # the same as rows, with term strings for the reports, in the blocks' order
        (unpack_blocks(spark.read.parquet(f"{path}/blocks"))
         .select("term", "term_index", "doc_id", "tf", "weight").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings"))

        hash_vectors(forward, cfg.hash_dims).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/doc_vec")

    index_io.write_manifest(spark, path, {
        "n_docs": n_docs, "vocab_size": vocab_size, "min_df": cfg.min_df, "max_df": cfg.max_df,
        "remove_stopwords": cfg.remove_stopwords, "hash_dims": cfg.hash_dims,
        "stopwords": list(cfg.stopwords), "dictionary": list(cfg.dictionary),
    })
    return index_io.load_index(spark, path)


def hash_vectors(forward: DataFrame, dims: int) -> DataFrame:
    """Signed-hash unit vectors from the forward rows (same values as ``dense.hash_encoder``).

    A row holds all words of its documents: the signed counts, whole numbers, are summed there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for r in range(batch.num_rows):
                get = lambda n: cols[n][r].values.to_numpy(zero_copy_only=False)
                h = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in cols["words"][r].values.to_pylist()], np.int64)
                sign = np.where(h // dims % 2 == 0, 1.0, -1.0)
                word, docs = np.repeat(np.arange(len(h)), get("sizes")), get("docs")
                sums = np.bincount(get("at").astype(np.int64) * dims + (h % dims)[word], sign[word] * get("tfs"), len(docs) * dims)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(docs) * dims + 1, dims), pa.int32()), pa.array(sums, pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists], names=["doc_id", "embedding"])

    sums = forward.select("docs", "words", "sizes", "at", "tfs").mapInArrow(run, "doc_id long, embedding array<double>")
    return sums.select("doc_id", V.normalize("embedding").alias("embedding"))


def index_for(spark: SparkSession, sf_dir: str, cfg: IndexConfig = IndexConfig(), docs: DataFrame | None = None,
              tag: str = "documents") -> index_io.Index:
    """The index of a table folder's documents, built once for the files as they are; other ``docs`` are indexed anew."""
    source = files_fingerprint(spark, table_path(sf_dir, "documents")) if docs is None else uuid.uuid4().hex
    key = json.dumps([INDEX_FORMAT, sf_dir, source, tag, cfg.min_df, cfg.max_df, cfg.remove_stopwords, cfg.hash_dims,
                      list(cfg.stopwords), list(cfg.dictionary)], ensure_ascii=False)
    digest = hashlib.sha1(key.encode()).hexdigest()[:16]
    path = f"{checkpoint_dir(spark)}/index-{digest}"
    if index_io.index_exists(spark, path):
        return index_io.load_index(spark, path)
    return build_index(docs if docs is not None else read_corpus(spark, sf_dir), path, cfg)
