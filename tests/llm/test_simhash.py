import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm.components import components
from parley.llm.simhash import distances, drop_near_copies, fingerprint, group_links, links, near_groups, pivots


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(fps[i] ^ fps[j]).count("1") <= 2:
                    root[i] = min(root[i], root[j])
    return {i: min(x for x, r in zip(ids, root) if r == root[k]) for k, i in enumerate(ids)}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBc É\n\x1c ", max_size=40))
def test_fingerprint(text):
    assert fingerprint(text.encode()) == brute_fingerprint(text)


def test_pivots_tell_regions_apart():
    assert len(pivots()) == 65
    for r in range(8):
        table = distances(np.arange(256, dtype=np.uint64) << np.uint64(8 * r)).astype(int)
        assert len({tuple(row) for row in table[:, 1 + 8 * r : 9 + 8 * r] - table[:, :1]}) == 256


def near_set(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    return list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(4)})


def test_links_connect_what_brute_force_connects(spark):
    fps = near_set(random.Random(5), 240)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in found.collect())
    roots = {r.node: r.root for r in components(found).collect()}
    want = brute_components(signed, fps)
    assert {f: roots.get(f, f) for f in signed} == want


def test_links_of_a_group_over_several_batches(spark):
    fps = spark.range(1500).select(F.col("id").alias("fp"))  # all share the upper six regions; a batch has 512 rows
    roots = {r.node: r.root for r in components(links(fps)).collect()}
    assert roots == {k: 0 for k in range(1500)}


def test_links_of_nothing(spark):
    assert links(spark.range(0).select(F.col("id").alias("fp"))).collect() == []


def test_group_links_is_a_forest():
    fps = np.unique(np.random.default_rng(1).integers(0, 1 << 7, 60).astype(np.uint64))
    assert len(group_links(fps, 2)) < len(fps)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def test_documents(odd_docs, odd_texts, empty_docs):
    rows = near_groups(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 2
    ids = list(range(len(odd_texts)))
    fps = [brute_fingerprint(t or "") for t in odd_texts]
    want = brute_components(ids, fps)
    for r in rows:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert near_groups(empty_docs).collect() == []
    left = {r.doc_id for r in drop_near_copies(odd_docs).collect()}
    assert left == {v for v in want.values()} | {None}
