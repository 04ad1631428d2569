import random
from collections import defaultdict

from corpus_pipeline import STAGES, run
from parley.llm.decontamination import needed, normalise
from parley.llm.quality import THRESHOLD, score_quality

from .conftest import sentence
from .test_decontamination import brute_best
from .test_near_dedup import brute_components


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    items = [(k, sentence(rng, 20)) for k in range(3)]
    docs, labels = [], []
    for k in range(160):
        bad = rng.random() < 0.2
        text = sentence(rng, rng.randint(30, 60))
        if bad:
            text = text.upper().replace(" ", "!! ")
        elif k % 10 == 0 and docs:
            text = docs[rng.randrange(len(docs))][1]
        elif k % 10 == 1 and docs:
            text = docs[rng.randrange(len(docs))][1] + "\n"
        elif k % 10 == 2:
            text += " " + items[k % 3][1]
        docs.append((k, text, "en", "src", len(text)))
        labels.append((k, int("!!" not in text), 0))
    docs.append((500, None, None, None, None))
    sf = f"{tmp_path}/sf"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")

    scores = {r.doc_id: r.score for r in score_quality(table, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    kept = {d[0]: d[1] or "" for d in docs if scores[d[0]] >= THRESHOLD}
    assert sum("!!" in t for t in kept.values()) <= 3
    best = defaultdict(int)
    for k, t in kept.items():
        best[t.lower()] = max(best[t.lower()], k)
    kept = {k: t for k, t in kept.items() if best[t.lower()] == k}
    root = brute_components(list(kept.items()))
    kept = {k: t for k, t in kept.items() if root[k] == k}
    kept = {k: t for k, t in kept.items() if not any(brute_best(normalise(i), normalise(t)) <= needed(len(normalise(i)))[0] for _, i in items)}
    assert {r.doc_id for r in run(spark, sf).collect()} == set(kept) and len(kept) < 130
    for _, stage in STAGES[:-1]:
        assert stage(spark, table, sf).columns == table.columns


def test_stages_on_odd_rows(spark, odd_docs, empty_docs, tmp_path):
    """Null ids and texts, repeated ids and rows, clashing columns, long texts, and empty tables: no stage fails, and columns stay."""
    sf = f"{tmp_path}/sf"
    spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, sentence(random.Random(1), 20))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = {r.doc_id for r in odd_docs.collect()}
    for docs in (odd_docs, empty_docs):
        for name, stage in STAGES:
            out = stage(spark, docs, sf)
            assert name == "bpe" or out.columns == docs.columns
            left = out.collect()
            assert {r.doc_id for r in left} <= rows and (docs is odd_docs or not left)
            # a row without an id is never taken for a copy
            assert docs is empty_docs or name == "quality" or None in {r.doc_id for r in left}
