from quarry.operators import relevance as RL
from quarry.plans import catalog
from quarry.sources import wordlists as WL


def test_word_list_by_path_and_uri(spark, tmp_path):
    f = tmp_path / "words.txt"
    f.write_text("beta\nalpha\n\nalpha\n")
    assert WL.load_stopwords(spark, str(f)) == WL.load_stopwords(spark, f"file://{f}") == ["alpha", "beta"]


def test_column_order_keeps_null_language(spark, tmp_path):
    rows = [(1, "a b", None, "s", 3), (2, "c", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.column_order(spark, str(tmp_path)).count() == 2


def test_relevance_in_blocks_equals_one(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"x passage {i % 7} y") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"passage {i}") for i in range(7)], "item_id long, text string")
    one = sorted(map(tuple, RL.planted_relevance(docs, items).collect()))
    monkeypatch.setattr(RL, "MAX_PATTERNS", 2)
    assert sorted(map(tuple, RL.planted_relevance(docs, items).collect())) == one == sorted((i % 7, i) for i in range(40))


def test_index_follows_its_files(spark, tmp_path):
    from quarry.plans.index_build import index_for

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, "aa bb", "en", "s", 5), (2, "aa cc", "en", "s", 5)], schema).write.parquet(path)
    assert index_for(spark, str(tmp_path)).n_docs == 2
    spark.createDataFrame([(3, "aa dd", "en", "s", 5)], schema).write.mode("append").parquet(path)
    assert index_for(spark, str(tmp_path)).n_docs == 3
