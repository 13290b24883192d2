"""Evaluation: judgements of a ranked result table against a relevance table, recall@k.

A query is judged when it has at least one relevant document (the "skipped"
verdict otherwise); it is a hit when a relevant document is within the top k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import text as T


def judgements(results: DataFrame, relevance: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, judge) with judge 1 (hit), 0 (miss) or NULL (no relevant document)."""
    rel = relevance.select(F.col("item_id").alias("query_id"), "doc_id").distinct()
    judged = rel.select("query_id").distinct().withColumn("_j", F.lit(True))
    hits = (
        results.filter(F.col("rank") <= k).select("query_id", "doc_id")
        .join(rel, ["query_id", "doc_id"]).select("query_id").distinct().withColumn("_h", F.lit(True))
    )
    return (
        queries.select("query_id").join(judged, "query_id", "left").join(hits, "query_id", "left")
        .select("query_id", F.when(F.col("_j").isNull(), F.lit(None).cast("int"))
                .when(F.col("_h").isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("judge"))
    )


def recall(judged: DataFrame) -> DataFrame:
    """(judged, hits, skipped, recall, recall_pct); recall NULL when nothing was judged."""
    agg = judged.agg(
        F.count("judge").cast("long").alias("judged"),
        F.coalesce(F.sum("judge"), F.lit(0)).cast("long").alias("hits"),
        F.count_if(F.col("judge").isNull()).cast("long").alias("skipped"),
    )
    r = F.when(F.col("judged") > 0, F.col("hits") / F.col("judged"))
    return agg.select("judged", "hits", "skipped", r.alias("recall"),
                      F.when(r.isNotNull(), F.format_string("%.1f%%", r * 100.0)).alias("recall_pct"))


def recall_table(stages: dict[str, DataFrame], relevance: DataFrame, queries: DataFrame,
                 ks: Sequence[int] = (1, 3, 10)) -> DataFrame:
    """(stage, k, judged, hits, skipped, recall, recall_pct) for every stage and k."""
    out = None
    for name, res in stages.items():
        for k in ks:
            part = recall(judgements(res, relevance, queries, k)).select(
                F.lit(name).alias("stage"), F.lit(k).cast("long").alias("k"), "*")
            out = part if out is None else out.unionByName(part)
    return out


def judge_word(col: str = "judge"):
    """1 / 0 / NULL -> hit / miss / skipped words of the reference's export."""
    w = config.JUDGE_WORDS_FIXED
    return F.when(F.col(col) == 1, F.lit(w[1])).when(F.col(col) == 0, F.lit(w[0])).otherwise(F.lit(w[None]))


def answer_code(col: str):
    """Typed verdict -> code: 'y' hit, 's' skipped, anything else a miss; NULL (no verdict) counts as skipped."""
    a = F.lower(T.strip(col))
    return F.when(a == "y", F.lit(1)).when(a.isNull() | (a == "s"), F.lit(None).cast("int")).otherwise(F.lit(0))


def verdict_judgements(evalset: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(query_id, judge) from a table of typed verdicts (query_id, answer, optionally seq).

    Every question of ``evalset`` is kept; one without a verdict is skipped. Of several verdicts
    on a question the one of largest ``seq`` counts, without that column the largest answer.
    """
    order = F.col("seq") if "seq" in verdicts.columns else F.col("answer")
    last = verdicts.groupBy("query_id").agg(F.max_by("answer", order).alias("answer"))
    return evalset.select("query_id").join(last, "query_id", "left").select("query_id", answer_code("answer").alias("judge"))


def export_judged(evalset: DataFrame, judged: DataFrame) -> DataFrame:
    """All columns of ``evalset``, whichever are there, and ``judge`` as a word (an old ``judge`` column is replaced)."""
    kept = [c for c in evalset.columns if c != "judge"]
    return evalset.select(*kept).join(judged.select("query_id", "judge"), "query_id", "left").select(*kept, judge_word("judge").alias("judge"))


def references(evalset: DataFrame, names: Sequence[str] = config.EVAL_OPTIONAL_FIXED):
    """What helps to judge a question: "name: value" of each optional column that is there and not NULL, one per line."""
    shown = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in names if c in evalset.columns]
    return F.concat_ws("\n", *shown) if shown else F.lit("")


def judging_sheet(evalset: DataFrame, results: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, text, reference, rank, label, confidence, content): a row per question and answer to judge.

    evalset (query_id, text, optional columns), results (query_id, doc_id, score, rank), docs
    (doc_id, text, label). A question without results has one row with NULLs.
    """
    asked = evalset.select("query_id", "text", references(evalset).alias("reference"))
    found = results.filter(F.col("rank") <= k).select("query_id", "doc_id", "rank", F.round("score", 3).alias("confidence")).join(
        docs.select("doc_id", F.col("text").alias("content"), "label"), "doc_id")
    return asked.join(found, "query_id", "left").select("query_id", "text", "reference", "rank", "label", "confidence", "content")
