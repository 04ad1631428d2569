import random
import zlib

import numpy as np

from parley.llm.quality import LEXICAL, estimate_prior, features, fit_pu, keep_good, lexical, score_quality

from .conftest import sentence


def corpus(n=700):
    rng = random.Random(11)
    rows = []
    for k in range(n):
        bad = rng.random() < 0.25
        text = sentence(rng, rng.randint(20, 120))
        rows.append((k, text.upper().replace(" ", "!! ") if bad else text.capitalize() + ".", int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == rows[r.doc_id][2] for r in held]) > 0.97
    kept = {r.doc_id for r in keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}


def test_held_out_labels_change_nothing(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flip = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q, 0) for k, _, q in rows]
    a, b = (score_quality(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect() for x in ([(k, q, 0) for k, _, q in rows], flip))
    assert [r.score for r in a] == [r.score for r in b]


def test_edges(odd_docs, odd_texts, empty_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 0), (4, None, 0), (None, 1, 0), (6, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_quality(odd_docs, none).collect()} == {0.5}
    rows = score_quality(odd_docs, some).collect()
    assert len(rows) == len(odd_texts) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(empty_docs, some).collect() == []
    assert np.isfinite(features("")).all()


def test_risk_stays_unbiased():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (400, 3)), rng.normal(-1.5, 1, (200, 3))
    model = fit_pu(good[:200], np.vstack([good[200:], bad]), 0.5)
    assert model.score(good).mean() > 0.85 and model.score(bad).mean() < 0.15


def test_prior_needs_no_negatives():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85):
        n = int(4000 * share)
        unlabelled = np.vstack([rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (4000 - n, 3))])
        assert abs(estimate_prior(rng.normal(1.5, 1, (2000, 3)), rng.permutation(unlabelled)) - share) < 0.06


def test_only_good_labels_are_read(spark):
    """Rows labelled bad are unlabelled to the model: leaving their labels out changes nothing."""
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    every = [(k, q, 0) for k, _, q in rows]
    a, b = (score_quality(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect() for x in (every, [r for r in every if r[1]]))
    assert [r.score for r in a] == [r.score for r in b]


def test_rows_that_share_an_id(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(k % 50, t, "x") for k, t, _ in rows] * 3, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 600 and all(0 <= r.score <= 1 for r in got)
    assert keep_good(docs, labels).columns == docs.columns


def test_lexical_features_see_words_and_their_order():
    assert (lexical("one two three") != lexical("three two one")).any() and (lexical("one two")[:LEXICAL] == lexical("two one")[:LEXICAL]).all()
    assert (lexical("A b") == lexical("a\tB")).all() and lexical("").sum() == 0
