import os
import warnings

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.sources import index_io, wordlists


def test_missing_index_raises(spark, tmp_path):
    with pytest.raises(index_io.IndexNotFoundError):
        index_io.load_index(spark, str(tmp_path / "nothing"))


def test_index_roundtrip_counts(spark, index001):
    from conftest import SF001
    from quarry.sources import corpus as C

    assert index001.n_docs == C.read_corpus(spark, SF001).count()
    assert index001.vocab_size == index001.vocab.count() > 0
    again = index_io.load_index(spark, index001.path)
    assert again.postings.count() == index001.postings.count()
    # every row is unit length
    from pyspark.sql import functions as F
    norms = index001.postings.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-9 for r in norms)


def test_vocab_df_bounds(index001):
    from pyspark.sql import functions as F
    row = index001.vocab.agg(F.min("df").alias("lo"), F.max("df").alias("hi")).collect()[0]
    assert row.lo >= 2 and row.hi <= 0.9 * index001.n_docs


def test_wordlist_missing_policy(spark, tmp_path):
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert wordlists.load_stopwords(spark, str(tmp_path / "none.txt")) == []
        assert wordlists.load_dictionary(spark, str(tmp_path / "none.txt")) == []
    assert len(w) == 2


def test_wordlist_loader_strips_and_dedupes(spark, tmp_path):
    p = tmp_path / "words.txt"
    p.write_text("的\n 了 \n\n的\n- \n", encoding="utf-8")
    assert wordlists.load_stopwords(spark, str(p)) == sorted(["的", "了", "-"])


def test_ordinals_are_dense_and_unique(index001):
    """doc_ord.ord and vocab.term_index are exactly 0..n-1 in key order (their input comes out of shuffles)."""
    from pyspark.sql import functions as F

    for df, key, ordc in ((index001.doc_ord, "doc_id", "ord"), (index001.vocab, "term", "term_index")):
        st = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(ordc).alias("d"),
                    F.min(ordc).alias("lo"), F.max(ordc).alias("hi")).first()
        assert (st["d"], st["lo"], st["hi"]) == (st["n"], 0, st["n"] - 1), (ordc, st)
        keys = [r[0] for r in df.orderBy(ordc).select(key).collect()]
        assert keys == sorted(keys)


def test_doc_ord_covers_docs(index001):
    assert index001.doc_ord.count() == index001.docs.count() == index001.n_docs
    assert index001.docs.join(index001.doc_ord, "doc_id", "left_anti").count() == 0


def test_sizing_helpers(spark):
    from quarry.plans.sizing import bounded_broadcast, partitions_for, row_count_at_most

    assert partitions_for(0, 48, 8) == 8                                   # never below the floor
    assert partitions_for(10_000_000, 48, 8) == 8                          # 480 MB -> 4 partitions < floor
    assert partitions_for(100_000_000, 48, 8) == 36                        # 4.8 GB / 128 MB, rounded up
    df = spark.range(0, 100)
    assert row_count_at_most(df, 100) and not row_count_at_most(df, 99)
    small = bounded_broadcast(df, 100)
    big = bounded_broadcast(df, 99)
    plan_small = _plan_text(small.join(spark.range(0, 1000), "id"))
    plan_big = _plan_text(big.join(spark.range(0, 1000), "id"))
    assert "broadcast" in plan_small.lower() and "broadcast" not in plan_big.lower()


def _plan_text(df) -> str:
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(extended=True)
    return buf.getvalue().split("== Physical Plan ==")[0]   # logical plans: the hint, not the runtime choice


def test_large_rows_stand_in_small_row_groups(spark, tmp_path):
    """A reader of the forward rows and blocks holds a row group at once, so it has few of their large rows."""
    import glob

    import pyarrow.parquet as pq

    from quarry.plans import index_build as IB

    words = F.transform(F.sequence(F.lit(0), F.lit(1599)), lambda j: F.concat(F.lit("w"), ((F.col("id") * 7 + j) % 3000).cast("string")))
    docs = spark.range(1300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"), F.lit("s").alias("source"), F.lit("l").alias("label"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        IB.build_index(docs, str(tmp_path / "idx"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")

    def groups(table):
        files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/idx/{table}/*.parquet")]
        return [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]

    assert len(groups("terms")) > 3 and max(groups("terms")) == 1
    assert sum(groups("blocks")) > 4 and max(groups("blocks")) <= 4


def test_small_batches_give_the_bound_back(spark):
    from quarry.session import small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)

    def sizes():
        rows = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
        counted = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long")
        return [r.n for r in counted.collect()]

    whole = sizes()
    with small_batches(spark):
        assert spark.conf.get(key) == "16m" and max(sizes()) < max(whole)
        with small_batches(spark, "32m"):
            assert spark.conf.get(key) == "16m"
    assert spark.conf.get(key) == was and sizes() == whole
