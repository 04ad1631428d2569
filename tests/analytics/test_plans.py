import pytest

from parley.operators import retrieval, scoring
from parley.plans import datasets


def test_low_signal_capped_reads_whole_replies(spark, monkeypatch):
    rows = [(1, k, k, "yes please, " + "we should meet at the station " * 3) for k in range(8)] + [(1, k, k, "ok") for k in range(8, 16)]
    table = spark.createDataFrame(rows, "chat_id long, msg_no long, sec long, text string")
    monkeypatch.setattr(datasets.c, "conversation_turns", lambda spark, sf: table)
    assert {r.msg_no for r in datasets.low_signal_capped(spark, "").collect()} == {*range(8), 14, 15}


@pytest.mark.parametrize("query, operator", [("bootstrap_ci", "bootstrap"), ("paired_win_rate", "paired_win_rate")])
def test_resampling_queries_run_the_operators_rounds(spark, monkeypatch, query, operator):
    table = spark.createDataFrame([(1, "a", "b")], "id long, gold string, pred string")
    monkeypatch.setattr(datasets, "_predictions", lambda spark, sf: table)
    seen = {}
    monkeypatch.setattr(scoring, operator, lambda *a, rounds=scoring.BOOTSTRAP, **k: seen.setdefault("rounds", rounds))
    datasets.QUERIES[query](spark, "")
    assert seen == {"rounds": 1000}


def test_retrieval_leaves_out_barred_replies(spark):
    index = retrieval.index_rows(spark.createDataFrame([(k, f"are you coming {k}", r, "", 100) for k, r in enumerate(["yes", "yes ", "no", "later"])], "id long, query string, reply string, peer string, sec long"))
    q = spark.createDataFrame([(7, "are you coming", "", [" yes"]), (8, "are you coming", "", None)], "qid long, query string, peer string, exclude_replies array<string>")
    got = [(r.qid, r.id) for r in retrieval.retrieve(q, index).orderBy("qid", "place").collect()]
    assert got == [(7, 2), (7, 3), (8, 0), (8, 1)]
