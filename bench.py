"""Benchmark: index build and the headline retrieval queries at one scale factor.

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ..., ...}

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is timed end to end (plan + jobs + collecting the small result);
the index build is timed on its own and every query reads the written index.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    os.environ.setdefault("QUARRY_MASTER", f"local[{cpus}]")

    from pyspark.sql import functions as F

    from quarry.config import SearchConfig
    from quarry.operators import evaluate as EV
    from quarry.operators import relevance as RL
    from quarry.plans import hybrid as H
    from quarry.plans.index_build import build_index
    from quarry.plans.search import tfidf_search
    from quarry.session import get_spark, scratch_path
    from quarry.sources import corpus as C

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    cfg = SearchConfig()
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    docs = C.read_corpus(spark, sf_dir)
    qs = C.read_benchmark_queries(spark, sf_dir)
    n_q = qs.count()
    idx = timed("index_build", lambda: build_index(docs, scratch_path(spark, "bench-index")))

    res = {}
    res["tfidf"] = timed("tfidf_topk", lambda: tfidf_search(idx, qs, cfg, k=10).collect())
    res["dense"] = timed("dense_topk", lambda: H.dense_search(idx, qs, cfg, k=10).collect())
    rrf10 = timed("hybrid_rrf", lambda: H.materialize(H.rrf_search(idx, qs, cfg, k=10)))
    rrf10.count()
    timed("hybrid_weighted", lambda: H.weighted_search(idx, qs, cfg, k=3).collect())
    timed("rerank_search", lambda: H.two_stage_search(idx, qs, cfg, k=3, candidate_k=20).collect())

    # recall against planted-passage relevance (easier than human-judged questions)
    rel = timed("relevance", lambda: H.materialize(RL.planted_relevance(idx.docs, C.read_table(spark, sf_dir, "benchmark"))))
    stages = {
        "tfidf": spark.createDataFrame(res["tfidf"]),
        "dense": spark.createDataFrame(res["dense"]),
        "hybrid_rrf": rrf10,
    }
    recall_rows = EV.recall_table(stages, rel, qs, (1, 3, 10)).collect()
    recall = {f"{r['stage']}@{r['k']}": (None if r["recall"] is None else round(r["recall"], 4)) for r in recall_rows}

    query_keys = ["tfidf_topk", "dense_topk", "hybrid_rrf", "hybrid_weighted", "rerank_search"]
    total = round(sum(times.values()), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "n_queries": n_q,
        "queries_per_sec": {k: round(n_q / times[k], 2) for k in query_keys if times.get(k)},
        "recall": recall,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
