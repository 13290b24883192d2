"""Verdict tables and optional question columns; the weighted loop's active set."""

from conftest import SF001
from quarry import config
from quarry.operators import evaluate as EV
from quarry.plans import hybrid as H
from quarry.sources.corpus import read_benchmark_queries

HIT, MISS, SKIPPED = (config.JUDGE_WORDS_FIXED[x] for x in (1, 0, None))


def test_verdict_table(spark):
    evalset = spark.createDataFrame([(i, f"q{i}", "old", None if i % 2 else f"n{i}") for i in range(8)], "query_id long, text string, judge string, note string")
    answers = [(0, "y", 1), (1, " Y　", 1), (2, "n", 1), (3, "", 1), (4, "s", 1), (5, None, 1), (6, "n", 1), (6, "y", 2), (99, "y", 1)]
    verdicts = spark.createDataFrame(answers, "query_id long, answer string, seq int")
    judged = EV.verdict_judgements(evalset, verdicts)
    got = {r.query_id: r.judge for r in judged.collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: None, 5: None, 6: 1, 7: None}
    r = EV.recall(judged).first()
    assert (r.judged, r.hits, r.skipped, r.recall_pct) == (5, 3, 3, "60.0%")
    out = EV.export_judged(evalset, judged)
    assert out.columns == ["query_id", "text", "note", "judge"]
    assert {r.query_id: r.judge for r in out.collect()} == {0: HIT, 1: HIT, 2: MISS, 3: MISS, 4: SKIPPED, 5: SKIPPED, 6: HIT, 7: SKIPPED}
    assert EV.recall(EV.verdict_judgements(evalset, verdicts.limit(0))).first().recall is None


def test_judging_sheet_shows_only_columns_that_are_there(spark):
    docs = spark.createDataFrame([(1, "one", "a"), (2, "two", None)], "doc_id long, text string, label string")
    res = spark.createDataFrame([(0, 1, 0.12345, 1), (0, 2, 0.1, 2), (0, 1, 0.05, 3)], "query_id long, doc_id long, score double, rank long")
    full = spark.createDataFrame([(0, "q", "ans", None, 7), (1, "r", None, None, None)], "query_id long, text string, reference_answer string, note string, category int")
    rows = sorted(map(tuple, EV.judging_sheet(full, res, docs, 2).collect()), key=str)
    assert rows == [(0, "q", "reference_answer: ans\ncategory: 7", 1, "a", 0.123, "one"), (0, "q", "reference_answer: ans\ncategory: 7", 2, None, 0.1, "two"),
                    (1, "r", "", None, None, None, None)]
    assert {r.reference for r in EV.judging_sheet(full.select("query_id", "text"), res, docs, 2).collect()} == {""}


def test_resolved_queries_leave_the_loop(spark, index001, monkeypatch):
    qs = read_benchmark_queries(spark, SF001)
    seen, candidates = [], H.candidates

    def spy(e, depth, with_lists=False):
        seen.append((depth, {r.query_id for r in e.queries.select("query_id").collect()}))
        return candidates(e, depth, with_lists)

    monkeypatch.setattr(H, "candidates", spy)
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain, alone = rows(H.weighted_search(index001, qs, k=3, start_depth=8)), seen[:]
    seen.clear()
    odd = spark.createDataFrame([(-1, "?!"), (-2, "．")], "query_id long, text string")
    both = rows(H.weighted_search(index001, qs.unionByName(odd), k=3, start_depth=8))
    assert [r for r in both if r[0] >= 0] == plain
    assert seen == alone   # queries without tokens change no other query's depth
    first = [r.doc_id for r in index001.doc_ord.orderBy("ord").limit(3).collect()]
    for i in (-1, -2):
        assert [(r[1], r[2]) for r in sorted((r for r in both if r[0] == i), key=lambda r: r[-1])] == [(d, 0.0) for d in first]
    assert all(later <= earlier for (_, earlier), (_, later) in zip(seen, seen[1:]))
