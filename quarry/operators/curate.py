"""Corpus curation: duplicate report, exact dedup, ordered idempotent patches, append-if-absent.

Duplicates are found by a strong hash first (sha2-256 of the text, plus its
length) so the first shuffle moves 40-byte keys, not texts; only rows whose
hash collides with another row are re-checked by full text equality, so the
result is exact.

Patches are a fold over an ordered edit list that stands as one array beside
each row: all edits run in one pass and a later edit sees earlier changes. An edit is skipped for rows that already contain its sentence, so a
second run changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.sizing import bounded_broadcast


def _key_cols(text_col: str = "text"):
    t = F.coalesce(F.col(text_col), F.lit(""))
    return F.sha2(t, 256).alias("_h"), F.when(F.col(text_col).isNull(), -1).otherwise(F.length(t)).alias("_len")


def duplicate_groups(docs: DataFrame, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, first_doc_id, group_size) for every row whose text occurs more than once.

    1. (sha2-256, length) per row; groups with more than one row, aggregated
       map-side (a hot group costs one partial row per partition);
    2. every candidate row is compared with its group's first text (a join on
       the first doc id; AQE splits a hot group across tasks);
    3. rows that fail the comparison (a hash collision, never expected) are
       grouped by full text equality instead, so the result is exact.
    NULL texts are equal to each other and not to ''.
    """
    h, ln = _key_cols()
    keyed = docs.select("doc_id", h, ln)
    groups = (
        keyed.groupBy("_h", "_len").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1).select("_h", "_len", "first_doc_id")
    )
    groups_b = bounded_broadcast(groups, max_broadcast_rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    cand = docs.select("doc_id", text.alias("text"), h, ln).join(groups_b, ["_h", "_len"])
    reps = docs.select(F.col("doc_id").alias("first_doc_id"), text.alias("rep_text")).join(
        groups_b.select("first_doc_id"), "first_doc_id")
    checked = cand.join(reps, "first_doc_id").withColumn("same", F.col("text") == F.col("rep_text"))
    ok = checked.filter("same").select("doc_id", "first_doc_id")
    # exact fallback for rows whose hash matched but text did not
    odd = checked.filter(~F.col("same")).select("doc_id", "text")
    w = Window.partitionBy("text")
    odd_g = odd.select("doc_id", F.min("doc_id").over(w).alias("first_doc_id"),
                       F.count(F.lit(1)).over(w).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    members = ok.unionByName(odd_g)
    sizes = members.groupBy("first_doc_id").agg(F.count(F.lit(1)).cast("long").alias("group_size"))
    return members.join(sizes, "first_doc_id").filter(F.col("group_size") > 1).select(
        "doc_id", "first_doc_id", "group_size")


def duplicate_listing(docs: DataFrame, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """(text, doc_id, label, first_doc_id, group_size) of every duplicate, in the order of text (NULL last), then doc_id.

    ``doc_id`` is the key of ``docs``. The sort is a range partitioning on both columns, so that a
    text that stands in many rows is split by doc_id.
    """
    groups = duplicate_groups(docs, max_broadcast_rows)
    rows = docs.select("doc_id", "text", "label").join(groups, "doc_id")
    return rows.select("text", "doc_id", "label", "first_doc_id", "group_size").orderBy(F.col("text").asc_nulls_last(), "doc_id")


def dedup_exact(docs: DataFrame, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """Keep the first row (smallest doc_id) of every text; other columns unchanged."""
    drop = duplicate_groups(docs, max_broadcast_rows).filter(F.col("doc_id") != F.col("first_doc_id"))
    return docs.join(drop.select("doc_id"), "doc_id", "left_anti")


@dataclass(frozen=True)
class Edit:
    seq: int
    key: str
    sentence: str


_EDITS = "array<struct<seq:bigint,key:string,sentence:string>>"


def _edit_list(spark, edits: Sequence[Edit] | DataFrame) -> DataFrame:
    """The edits in order as one row with one array."""
    if isinstance(edits, DataFrame):
        parts = F.struct(F.col("seq").cast("long").alias("seq"), F.col("key").cast("string").alias("key"), F.col("sentence").cast("string").alias("sentence"))
        return edits.agg(F.sort_array(F.collect_list(parts)).alias("edits"))
    return spark.createDataFrame([([(e.seq, e.key, e.sentence) for e in sorted(edits, key=lambda e: e.seq)],)], f"edits {_EDITS}")


def patch_fold(docs: DataFrame, edits: Sequence[Edit] | DataFrame) -> DataFrame:
    """(doc_id, text, hits): the text after all edits and, per edit whose key the text had at its turn, (seq, patched).

    One fold over the edit list per row, so the plan has the same size for any number of edits.
    """
    none = F.array().cast("array<struct<seq:bigint,patched:boolean>>")

    def step(acc, e):
        hit = F.coalesce(acc["text"].contains(e["key"]), F.lit(False))
        todo = hit & ~F.coalesce(acc["text"].contains(e["sentence"]), F.lit(False))
        return F.struct(F.when(todo, F.concat(T.rstrip(acc["text"]), e["sentence"])).otherwise(acc["text"]).alias("text"),
                        F.when(hit, F.concat(acc["hits"], F.array(F.struct(e["seq"].alias("seq"), todo.alias("patched"))))).otherwise(acc["hits"]).alias("hits"))

    start = F.struct(F.col("text").cast("string").alias("text"), none.alias("hits"))
    listed = docs.select("doc_id", "text").crossJoin(F.broadcast(_edit_list(docs.sparkSession, edits)))   # one row: the configuration
    return listed.select("doc_id", F.aggregate("edits", start, step).alias("r")).select("doc_id", "r.text", "r.hits")


def patch_rows(docs: DataFrame, edits: Sequence[Edit] | DataFrame) -> DataFrame:
    """(doc_id, text, n_edits) for the rows whose text changed."""
    n = F.size(F.filter("hits", lambda h: h["patched"])).cast("long")
    return patch_fold(docs, edits).select("doc_id", "text", n.alias("n_edits")).filter("n_edits > 0")


def patched_corpus(docs: DataFrame, edits: Sequence[Edit] | DataFrame) -> DataFrame:
    return docs.drop("text").join(patch_fold(docs, edits).select("doc_id", "text"), "doc_id")


def patch_report(docs: DataFrame, edits: Sequence[Edit] | DataFrame) -> DataFrame:
    """(seq, key, matched, patched, status) -- status missing / ok / multi (several rows matched)."""
    listed = _edit_list(docs.sparkSession, edits).select(F.explode("edits").alias("e")).select("e.seq", "e.key")
    hits = patch_fold(docs, edits).select(F.explode("hits").alias("h")).select("h.*")
    counted = hits.groupBy("seq").agg(F.count(F.lit(1)).alias("matched"), F.count_if("patched").alias("patched"))
    rep = listed.join(counted, "seq", "left").fillna(0, subset=["matched", "patched"])
    status = F.when(F.col("matched") == 0, "missing").when(F.col("matched") > 1, "multi").otherwise("ok")
    return rep.select("seq", "key", F.col("matched").cast("long").alias("matched"), F.col("patched").cast("long").alias("patched"), status.alias("status"))


@dataclass(frozen=True)
class NewRow:
    marker: str
    text: str
    source: str | None
    label: str | None


def append_if_absent(docs: DataFrame, rows: Sequence[NewRow], max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """Append each new row unless some existing text contains its marker.

    New doc ids continue after the current maximum in list order. The
    existence test is one pass: every document is checked against the (few)
    markers at once. Rows are then added one after the other, so a marker in an
    added row's text keeps later rows out.
    """
    spark = docs.sparkSession
    if not rows:
        return docs
    new = spark.createDataFrame(
        [(i, r.marker, r.text, r.source, r.label) for i, r in enumerate(rows)],
        "pos int, marker string, text string, source string, label string",
    )
    found = docs.select("text").crossJoin(F.broadcast(new.select("pos", "marker"))).filter(
        F.col("text").contains(F.col("marker"))).select("pos").distinct()
    have = {r["pos"] for r in found.collect()}   # at most one row per new row
    taken: list[tuple] = []
    for pos, r in enumerate(rows):   # one after the other: an added row counts for those after it
        if pos not in have and not any(r.marker in (t[1] or "") for t in taken):
            taken.append((len(taken) + 1, r.text, r.source, r.label))
    base = docs.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("_max"))
    added = spark.createDataFrame(taken, "n long, text string, source string, label string").crossJoin(F.broadcast(base)).select(
        (F.col("_max") + F.col("n")).alias("doc_id"), "text", "source", "label")
    return docs.unionByName(added, allowMissingColumns=True)
