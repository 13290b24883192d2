import pytest
from pyspark.sql import functions as F

from quarry.operators import curate as CU
from quarry.plans import curation
from quarry.sources import versioned as VT

DOCS = [(1, "alpha beta", "s", "x"), (2, "gamma key one", "s", "x"), (3, "alpha beta", "s", "y"), (4, "key one and more", "s", "x"),
        (5, None, "s", "x"), (6, None, "s", "z")]
SCHEMA = "doc_id long, text string, source string, label string"
EDITS = [CU.Edit(1, "key one", " FIRST."), CU.Edit(2, "FIRST.", " SECOND.")]


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_versions_are_kept_and_pinned(spark, tmp_path):
    root, df = str(tmp_path / "t"), spark.createDataFrame(DOCS, SCHEMA)
    assert VT.versions(spark, root) == []
    with pytest.raises(VT.VersionNotFoundError):
        VT.read_version(spark, root)
    assert VT.write_version(df, root).number == 1
    pinned = VT.read_version(spark, root)
    assert VT.write_version(pinned.filter("doc_id > 3"), root, "cut").rows == 3   # reads the table it writes
    assert ids(pinned) == [1, 2, 3, 4, 5, 6] and ids(VT.read_version(spark, root)) == [4, 5, 6] and ids(VT.read_version(spark, root, 1)) == ids(pinned)
    assert [(v.number, v.parent, v.operation, v.rows) for v in VT.versions(spark, root)] == [(1, 0, "write", 6), (2, 1, "cut", 3)]
    with pytest.raises(VT.VersionNotFoundError):
        VT.read_version(spark, root, 7)
    VT.write_version(df.limit(0), root, "empty")
    assert VT.read_version(spark, root).count() == 0 and VT.read_version(spark, root).columns == df.columns
    assert VT.expire(spark, root, 2) == [1] and [v.number for v in VT.versions(spark, root)] == [2, 3]
    assert VT.expire(spark, root, 0) == [2] and VT.write_version(df, root).number == 4


def test_failed_write_leaves_the_version_before(spark, tmp_path):
    root, df = str(tmp_path / "t"), spark.createDataFrame(DOCS, SCHEMA)
    VT.write_version(df, root)
    broken = df.withColumn("label", F.when(F.col("doc_id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("label")))
    with pytest.raises(Exception, match="lost"):
        VT.write_version(broken, root)
    assert [v.number for v in VT.versions(spark, root)] == [1] and ids(VT.read_version(spark, root)) == [1, 2, 3, 4, 5, 6]
    assert VT.write_version(df.filter("doc_id = 1"), root).number == 2 and ids(VT.read_version(spark, root)) == [1]


def test_of_two_writers_one_gets_the_number(spark, tmp_path):
    root, df = str(tmp_path / "t"), spark.createDataFrame(DOCS, SCHEMA)
    first = VT.write_version(df, root)
    VT.write_version(df.filter("doc_id < 3"), root, "one", first.number)
    with pytest.raises(VT.VersionConflictError):
        VT.write_version(df.filter("doc_id > 3"), root, "late", first.number)
    with pytest.raises(VT.VersionConflictError):   # overtaken between the data and the manifest
        VT._commit(spark, root, VT.Version(2, "data/other", 1, "late", 3))
    assert ids(VT.read_version(spark, root)) == [1, 2] and VT.latest(spark, root).operation == "one"


def test_curation_jobs(spark, tmp_path):
    root = str(tmp_path / "t")
    VT.write_version(spark.createDataFrame(DOCS, SCHEMA), root)
    assert curation.dedup_table(spark, root).rows == 4
    patched = curation.patch_table(spark, root, EDITS)
    texts = {r.doc_id: r.text for r in VT.read_version(spark, root).collect()}
    assert patched.number == 3 and texts == {1: "alpha beta", 2: "gamma key one FIRST. SECOND.", 4: "key one and more FIRST. SECOND.", 5: None}
    assert curation.patch_table(spark, root, EDITS) == patched   # nothing left to change
    assert curation.append_table(spark, root, [CU.NewRow("alpha", "alpha again", "s", "x"), CU.NewRow("delta", "delta new", "s", "x")]).rows == 5
    assert [v.operation for v in VT.versions(spark, root)] == ["write", "dedup", "patch", "append"]
    assert ids(VT.read_version(spark, root, 1)) == [1, 2, 3, 4, 5, 6] and ids(VT.read_version(spark, root)) == [1, 2, 4, 5, 6]
