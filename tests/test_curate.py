from pyspark.sql import functions as F

from quarry.operators import curate as CU

DOCS = [(1, "alpha beta", "s", "x"), (2, "gamma key one", "s", "x"), (3, "alpha beta", "s", "y"),
        (4, "key one and more", "s", "x"), (5, None, "s", "x"), (6, None, "s", "z"), (7, "alpha beta", "s", "x")]
SCHEMA = "doc_id long, text string, source string, label string"
EDITS = [CU.Edit(1, "key one", " FIRST."), CU.Edit(2, "FIRST.", " SECOND."), CU.Edit(3, "absent", " NEVER.")]


def test_duplicates_and_keep_first(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    groups = {r.doc_id: (r.first_doc_id, r.group_size) for r in CU.duplicate_groups(df).collect()}
    assert groups == {1: (1, 3), 3: (1, 3), 7: (1, 3), 5: (5, 2), 6: (5, 2)}
    kept = sorted(r.doc_id for r in CU.dedup_exact(df).collect())
    assert kept == [1, 2, 4, 5]
    again = CU.dedup_exact(CU.dedup_exact(df))
    assert sorted(r.doc_id for r in again.collect()) == kept


def test_duplicate_listing_is_sorted_by_text(spark):
    df = spark.createDataFrame([(9, "b", "s", "x"), (8, "a", "s", None), (3, "b", "s", "y"), (4, "c", "s", "x"), (2, None, "s", "z"), (5, "a", "s", "x"),
                                (1, None, "s", "x"), (6, "", "s", "x")], SCHEMA)
    rows = [(r.text, r.doc_id, r.label, r.first_doc_id, r.group_size) for r in CU.duplicate_listing(df).collect()]
    assert rows == [("a", 5, "x", 5, 2), ("a", 8, None, 5, 2), ("b", 3, "y", 3, 2), ("b", 9, "x", 3, 2), (None, 1, "x", 1, 2), (None, 2, "z", 1, 2)]
    assert CU.duplicate_listing(df.limit(0)).count() == 0


def test_patches_sequential_and_idempotent(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    out = {r.doc_id: r.text for r in CU.patched_corpus(df, EDITS).collect()}
    assert out[2] == "gamma key one FIRST. SECOND."          # edit 2 sees edit 1's text
    assert out[4] == "key one and more FIRST. SECOND."
    rep = {r.seq: (r.matched, r.patched, r.status) for r in CU.patch_report(df, EDITS).collect()}
    assert rep == {1: (2, 2, "multi"), 2: (2, 2, "multi"), 3: (0, 0, "missing")}
    once = CU.patched_corpus(df, EDITS)
    assert CU.patch_rows(once, EDITS).count() == 0           # a second run changes nothing


def test_rstrip_before_append_includes_ideographic_space(spark):
    df = spark.createDataFrame([(1, "句子。　 ", "s", "x")], SCHEMA)
    out = CU.patched_corpus(df, [CU.Edit(1, "句子", "補充。")]).collect()[0].text
    assert out == "句子。補充。"


def test_append_if_absent_idempotent(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    rows = [CU.NewRow("brand new", "brand new passage", "curated", "x"), CU.NewRow("alpha", "alpha again", "c", "x")]
    once = CU.append_if_absent(df, rows)
    added = once.filter(F.col("doc_id") > 7).collect()
    assert [(r.doc_id, r.text) for r in added] == [(8, "brand new passage")]
    assert CU.append_if_absent(once, rows).count() == once.count()


def test_many_edits_plan_and_run(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    edits = [CU.Edit(i, "key one", f" S{i}.") for i in range(200)]
    (row,) = [r for r in CU.patch_rows(df, edits).collect() if r.doc_id == 2]
    assert row.n_edits == 200 and row.text == "gamma key one" + "".join(f" S{i}." for i in range(200))
    table = spark.createDataFrame([(e.seq, e.key, e.sentence) for e in edits], "seq long, key string, sentence string")
    assert {(r.matched, r.patched) for r in CU.patch_report(df, table).collect()} == {(2, 2)}


def test_null_and_empty_texts_are_apart(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.first_doc_id for r in CU.duplicate_groups(df).collect()} == {1: 1, 3: 1, 2: 2, 4: 2}


def test_append_sees_rows_added_before(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    twice = [CU.NewRow("brand new", "brand new passage", "c", "x"), CU.NewRow("brand new", "another brand new one", "c", "x")]
    assert CU.append_if_absent(df, twice).count() == len(DOCS) + 1
