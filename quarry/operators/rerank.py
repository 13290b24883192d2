"""Second-stage reranking of first-stage candidates with a pluggable pair scorer.

Only the candidate pairs (top ``candidate_k`` per query) reach this stage, so
texts are joined late and the scorer never sees the whole corpus.

Default scorer: a logit linear in pair features computed natively --
query-token coverage, query-bigram coverage, the tf-idf cosine and the dense
similarity -- squashed by the sigmoid. A learned variant fits the same
features with MLlib logistic regression on labelled pairs. Output order is
``score DESC`` with first-stage rank as the tie-break (a stable sort of the
candidate list).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.topk import top_k
from quarry.plans.sizing import bounded_broadcast

FEATURES = ("f_cov", "f_bi", "tfidf", "emb")


@dataclass(frozen=True)
class LinearPairScorer:
    """logit = bias + sum(w_i * feature_i)."""
    bias: float = -4.0
    weights: tuple[float, ...] = (3.0, 4.0, 2.0, 1.0)

    def logit(self) -> Column:
        z = F.lit(self.bias)
        for w, f in zip(self.weights, FEATURES):
            z = z + F.lit(w) * F.col(f)
        return z


def sigmoid(col: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col))


def _features_tokens(text_col: str, cfg) -> Column:
    return T.feature_tokens(T.clean_tokens(text_col, cfg.dictionary, cfg.stopwords, cfg.remove_stopwords))


def bigrams(tok: Column) -> Column:
    n = F.size(tok)
    return F.zip_with(F.slice(tok, 1, F.greatest(n - 1, F.lit(0))), F.slice(tok, 2, F.greatest(n - 1, F.lit(0))),
                      lambda a, b: F.concat_ws(" ", a, b))


def _coverage(q: Column, d: Column) -> Column:
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, d)) / F.size(q))


def pair_features(cands: DataFrame, queries: DataFrame, docs: DataFrame, cfg, max_broadcast_rows: int) -> DataFrame:
    """cands (query_id, doc_id, tfidf, emb, rank1) -> + f_cov, f_bi.

    Document token arrays are built once per distinct candidate document
    (late materialisation of the text), query arrays once per query.
    """
    q = queries.select("query_id", _features_tokens("text", cfg).alias("_t")).select(
        "query_id", F.array_distinct("_t").alias("qt"), F.array_distinct(bigrams(F.col("_t"))).alias("qb"))
    ids = cands.select("doc_id").distinct()
    d = docs.select("doc_id", "text").join(bounded_broadcast(ids, max_broadcast_rows), "doc_id").select(
        "doc_id", _features_tokens("text", cfg).alias("_t")).select(
        "doc_id", F.array_distinct("_t").alias("dt"), F.array_distinct(bigrams(F.col("_t"))).alias("db"))
    return (
        cands.join(q, "query_id").join(d, "doc_id")
        .select("query_id", "doc_id", "tfidf", "emb", "rank1",
                _coverage(F.col("qt"), F.col("dt")).alias("f_cov"), _coverage(F.col("qb"), F.col("db")).alias("f_bi"))
    )


def rerank(feats: DataFrame, k: int, scorer: LinearPairScorer = LinearPairScorer(), digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank1, rank): sigmoid(logit) top-k, ties keep first-stage order."""
    scored = feats.withColumn("score", F.round(sigmoid(scorer.logit()), digits))
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("rank1").asc()], k).select(
        "query_id", "doc_id", "score", "rank1", "rank")


def fit_scorer(feats: DataFrame, labels: DataFrame, features: Sequence[str] = FEATURES,
               reg: float = 0.01) -> LinearPairScorer:
    """Fit the pair scorer by MLlib logistic regression on (query_id, doc_id, label) pairs."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = feats.join(labels, ["query_id", "doc_id"], "left").fillna(0, subset=["label"])
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        data.withColumn("label", F.col("label").cast("double")))
    model = LogisticRegression(regParam=reg, maxIter=50).fit(data)
    return LinearPairScorer(bias=float(model.intercept), weights=tuple(float(w) for w in model.coefficients))
