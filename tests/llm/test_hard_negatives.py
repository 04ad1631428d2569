import math
import random
from collections import defaultdict

import numpy as np
import pytest

from parley.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, v string, g long"


def plain(rows, positives=5, negatives=3, every=50):
    kept = {
        (i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for aid, alab, a in kept:
        if aid % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, v, strict=True)), i, lab) for i, lab, v in kept if i != aid)
        for s, i, _ in [x for x in scored if x[2] == alab][:positives]:
            fit = [(t, j) for t, j, lab in scored if lab != alab and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(aid, i, r, j, -s, -t) for r, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, **kw).collect())


def clustered(n, seed, d=6, labels=4):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.5) for _ in range(d)] for _ in range(12)]
    return [(k, [c + rng.gauss(0, 0.08) for c in centers[rng.randrange(12)]], rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("size", [40, 4096])
def test_equals_the_definition(spark, monkeypatch, size):
    """Small blocks make many cells, parts and groups, so that bounds and both passes are at work."""
    monkeypatch.setattr(hard_negatives, "BLOCK", size)
    monkeypatch.setattr(hard_negatives, "GROUP", max(3, size // 10))
    rows = clustered(900, 4)
    rows += [(1000, None, 1), (1050, [], 1), (1100, [None] * 6, 1), (1150, [float("nan")] * 6, 2), (1200, [0.1] * 6, None), (None, [0.1] * 6, 1)]
    rows += [rows[50], rows[50], rows[51], (1250, rows[3][1], 2), (1251, rows[3][1], 2), (1252, rows[3][1], 3), (50, rows[7][1], 1)]
    want = plain(rows)
    assert want and run(spark, rows) == want


def test_a_vector_of_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    rows = clustered(400, 9)
    rows = [(i, [0.5, 0.4, 0.3, 0.2, 0.1, 0.0] if i % 3 == 0 else v, 1 if i % 3 == 0 else lab) for i, v, lab in rows]
    assert run(spark, rows) == plain(rows)


def test_bounds_leave_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    monkeypatch.setattr(hard_negatives, "GROUP", 20)
    rows = [(i, [x / math.hypot(*v) for x in v], 1) for i, v, _ in clustered(1000, 2)]
    docs = spark.createDataFrame(rows, "id long, e array<float>, label int")
    index = hard_negatives.Index(hard_negatives.integer_rows(docs, 256, "id", "label", "e"), 10)
    targets = index.anchors.selectExpr("akey", "0L AS target", "60000L AS lo", "100000L AS hi")
    all_pairs = index._reach(index._groups(targets))
    kept = all_pairs.where("most >= floor").select("g", "block").distinct().count()
    assert 0 < kept < all_pairs.select("g", "block").distinct().count()


def test_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [0.1, 0.2], 1)]) == []
    assert run(spark, [(1, [0.1, 0.2], 1), (2, [0.1, 0.2], 1)]) == []
    two = [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.4], 2), (3, [1.0], 2)]
    assert run(spark, two) == plain(two[:3])
