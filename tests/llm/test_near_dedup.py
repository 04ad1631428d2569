import random

import pytest

from corpus_pipeline import STAGES
from parley.llm import jaccard_join, near_dedup
from parley.llm.near_dedup import SIMILARITY, drop_near_copies, near_groups

from .conftest import sentence

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def brute_components(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= SIMILARITY:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[k][0]: rows[find(k)][0] for k in range(len(rows))}


def chains(rng, bases, steps):
    """Chains of copies of copies, so that ends of a chain are linked only through its middle, and texts on their own."""
    texts = []
    for _ in range(bases):
        text = sentence(rng, rng.randint(60, 160))
        for _ in range(steps):
            texts.append(text)
            text = edited(rng, text, rng.randint(1, 3))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups_are_those_of_brute_force(spark):
    rows = chains(random.Random(4), 30, 6)
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    assert 30 <= len(set(want.values())) < 90


def test_a_template_with_many_fillings(spark):
    """Many pairs below the threshold that share bands: they stay apart, and those above it meet."""
    rng = random.Random(9)
    base = sentence(rng, 120)
    texts = [edited(rng, base, rng.randint(0, 9)) for _ in range(150)]
    rows = list(enumerate(texts + [edited(rng, texts[k], 1) for k in range(0, 150, 15)]))
    assert {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_components(rows)


def fillings(n, seed=3):
    """Texts of one frame of 120 words with two words changed in each: about 0.7 alike, below the threshold, unless both changes fall together."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    return [(k, edited(rng, base, 2)) for k in range(n)]


def test_fillings_of_a_template(spark):
    rows = fillings(300)
    assert {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_components(rows)


def test_rows_that_meet_grow_with_the_fillings(spark, monkeypatch):
    """Ten times as many fillings make about ten times as many rows of pairs, of names, groups and tiles together."""
    made = []
    monkeypatch.setattr(near_dedup, "alike", _counting(near_dedup.alike, made))
    monkeypatch.setattr(jaccard_join, "_open", _counting(jaccard_join._open, made))
    sizes = []
    for n in (200, 2000):
        made.clear()
        near_groups(spark.createDataFrame(fillings(n), SCHEMA)).count()
        sizes.append(sum(made))
    assert sizes[1] < 15 * sizes[0]


def _counting(f, made):
    def run(pairs, *args):
        made.append(pairs.count())
        return f(pairs, *args)

    return run


@pytest.mark.parametrize("stage", [dict(STAGES)["near_dedup"]])
def test_stage_drops_copies_with_several_edited_words(spark, stage):
    rng = random.Random(6)
    bases = [sentence(rng, 200) for _ in range(20)]
    rows = list(enumerate(bases + [edited(rng, t, 4) for t in bases]))
    assert set(brute_components(rows).values()) == set(range(20))
    assert {r.doc_id for r in stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()} == set(range(20))


def test_rows_that_share_an_id(spark):
    rng = random.Random(7)
    base, other = sentence(rng, 80), sentence(rng, 80)
    rows = [(1, base), (2, base + "\n"), (2, other), (None, base)]
    assert sorted(r.text for r in drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted([base, other, base])


def test_documents(odd_docs, odd_texts, empty_docs):
    want = brute_components(list(enumerate(odd_texts)))
    assert near_groups(empty_docs).collect() == []
    rows = near_groups(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 2
    assert all(r.component_id == want[r.doc_id] for r in rows if r.doc_id is not None)
    left = drop_near_copies(odd_docs)
    assert left.columns == odd_docs.columns and {r.doc_id for r in left.collect()} == {*want.values(), None}
