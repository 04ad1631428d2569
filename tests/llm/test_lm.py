import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import lm
from parley.llm.lm import BucketModel, Tree, bands, digits_for, leaves, score_corpus, word_hashes

from .conftest import sentence


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), None]


def held_out(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0


def brute_base(rows):
    held = [held_out(k) for k, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return [(k, h, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for (k, t), h in zip(rows, held)]


def check(rows, got):
    assert len(got) == len(rows)
    order = lambda x: (x[0] is None, x[0], x[2])
    for want, r in zip(sorted(brute_base(rows), key=order), sorted(got, key=order), strict=True):
        assert tuple(r)[:5] == want[:5] and r.base_score == pytest.approx(want[5], rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_odd(odd_docs, odd_texts, empty_docs):
    rows = [*enumerate(odd_texts), (None, "no id"), (3, odd_texts[3])]
    check(rows, score_corpus(odd_docs).collect())
    assert score_corpus(empty_docs).collect() == []


LANGS = [[f"{a}{b}{s}" for a in "bcdfg" for b in "aeiou"] for s in ("n", "tz", "que")]


def corpus(seed, n):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(LANGS[k % 3]) for _ in range(60))) for k in range(n)] + [(5000, sentence(rng, 40)), (5001, None)]


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = corpus(8, 400)
    got = score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_learns_which_words_follow(spark):
    """Each word has two that may follow: of about log10(45) a token, all but log10(2) can be gained."""
    rng, words = random.Random(1), LANGS[0] + LANGS[1]
    after = {w: rng.sample(words, 2) for w in words}
    rows = []
    for k in range(300):
        text = [rng.choice(words)]
        while len(text) < 80:
            text.append(rng.choice(after[text[-1]]))
        rows.append((k, " ".join(text)))
    held = [r for r in score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert 0.8 < gain < 1.4


def test_only_held_out_rows(spark):
    rows = [(k, "a b c") for k in range(60) if held_out(k)]
    check(rows, score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_hot_words_and_many_buckets(spark, monkeypatch):
    """A word whose histories go to several buckets, and documents in several blocks."""
    monkeypatch.setattr(lm, "BUCKET_ENTRIES", 20)
    monkeypatch.setattr(lm, "BLOCK_ROWS", 9)
    rows = [(k, f"x x {t} x x x") for k, t in corpus(2, 60)[:-1]]
    check(rows, score_corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert lm._salts(np.array([0, 249_999, 250_000, 10**9])).tolist() == [1, 1, 2, 4001]


def brute_scores(rows):
    """Scores by one loop over tokens, with the weights that one bucket of all histories learns."""
    count = Counter(w or "" for k, t in rows if not held_out(k) for w in tokens(t))
    words = sorted({w or "" for _, t in rows for w in tokens(t)})
    hashes, counts = word_hashes([w.encode() for w in words]), np.array([count[w] for w in words])
    leaf = leaves(hashes, counts)
    seen = counts > 0
    own = np.unique(leaf[seen])
    tree = Tree(int(counts.sum()), int(seen.sum()), own, np.array([counts[leaf == x].sum() for x in own]), np.array([(seen & (leaf == x)).sum() for x in own]))
    code = dict(zip(words, leaves(hashes, counts, tree.digits).tolist()))
    h = dict(zip(words, hashes.tolist())) | {"^": int(lm._START)}
    events = []
    for d, (k, t) in enumerate(rows):
        before = ["^", "^"]
        for w in tokens(t):
            events.append((h[before[1]], int(lm.mix(np.array([h[before[0]]], np.uint32))[0]) >> 49, code[w or ""], w or "", d))
            before = [before[1], w or ""]
    events.sort(key=lambda e: e[0])
    one, two, codes = (np.array(c, t) for c, t in zip(list(zip(*events))[:3], (np.uint32, np.uint16, np.uint32)))
    learn = np.array([not held_out(rows[e[4]][0]) for e in events])
    order = lm.content_order(one, np.where(learn, two | lm._TRAINED, two), codes)
    model = BucketModel(tree, len(events))
    model.learn_and_score(one[order], two[order], codes[order], learn[order], 0)
    out = [0.0] * len(rows)
    for a, b, c, w, d in events:
        p = 1.0
        for level in range(model.levels):
            shift = 4 * (model.levels - level)
            node = c >> shift
            if tree.single[level][node]:
                continue
            z = tree.logs[level][node].astype(float).copy()
            for weights, r in zip(model.weights[level], model.rows(np.array([a], np.uint32), np.array([b], np.uint16), np.array([node]), level)):
                z += weights[r[0]]
            e = np.exp(z - z.max())
            p *= e[(c >> (shift - 4)) & 15] / e.sum()
        n = [x for x in words if code[x] == c and count[x]]
        if c >> (4 * tree.digits):
            share = count[w] / sum(count[x] for x in n)
        else:
            share = 1.0 if not n else 0.5 / len(n) if count[w] else 0.5
        out[d] += math.log10(p * share)
    return out, tree, model


def test_scores_against_a_loop(spark):
    rows = corpus(4, 120)
    want, _, _ = brute_scores(rows)
    got = {r.doc_id: r.score for r in score_corpus(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {k: pytest.approx(w, rel=1e-4) for (k, _), w in zip(rows, want)}


def test_probabilities_sum_to_one():
    """Over all known words and the unknown word of each class, after any history."""
    rows = corpus(4, 120)
    _, tree, model = brute_scores(rows)
    every = np.arange(16 ** (tree.digits + 1))
    for one, two in ((int(lm._START), 5), (zlib.crc32(b"ban"), 77), (1, 2)):
        p = 10 ** model.log_chances(np.full(len(every), one, np.uint32), np.full(len(every), two, np.uint16), every.astype(np.uint32))
        possible = (tree.n > 0) | (every < len(every) // 16)
        assert p[possible].sum() == pytest.approx(1, abs=1e-3)
    for leaf in np.flatnonzero(tree.v)[:50]:
        n, v = int(tree.n[leaf]), int(tree.v[leaf])
        if leaf < len(every) // 16:
            shares = [*(10 ** tree.log_share(np.full(v, leaf), np.ones(v, int))), *(10 ** tree.log_share(np.array([leaf]), np.array([0])))]
        else:
            shares = 10 ** tree.log_share(np.full(v, leaf), np.full(v, n / v))
        assert sum(shares) == pytest.approx(1)


def test_gradient_is_that_of_the_log_probability():
    rng = np.random.default_rng(3)
    tree = Tree(1000, 40, np.arange(40) * 1500, rng.integers(2, 50, 40), np.ones(40, int))
    model = BucketModel(tree, 200)
    one, two = rng.integers(0, 5, 200).astype(np.uint32), rng.integers(0, 5, 200).astype(np.uint16)
    model.weights[0] = [rng.normal(0, 1, (1024, 16)).astype(np.float32) for _ in range(3)]
    node, outcome = np.zeros(200, np.int64), rng.integers(0, 16, 200)
    rows = model.rows(one, two, node, 0)
    grad = model.gradient(0, node, rows, outcome)
    total = lambda: np.log(model.chances(0, node, rows)[np.arange(200), outcome].astype(float)).sum()
    for f in range(3):
        r, k = int(rows[f][0]), int(outcome[0])
        model.weights[0][f][r, k] += 0.01
        up = total()
        model.weights[0][f][r, k] -= 0.02
        assert (up - total()) / 0.02 == pytest.approx(grad[f][r, k], abs=0.05)
        model.weights[0][f][r, k] += 0.01


def test_several_models_in_a_bucket(monkeypatch):
    """Each history's distribution is that of its own model."""
    rng = np.random.default_rng(6)
    tree = Tree(1000, 40, np.arange(40) * 1500, rng.integers(2, 50, 40), np.ones(40, int))
    every = np.flatnonzero(tree.n).astype(np.uint32)
    one, two, code = rng.integers(0, 9, 3000).astype(np.uint32), rng.integers(0, 5, 3000).astype(np.uint16), rng.choice(every, 3000)
    learn = rng.random(3000) < 0.9
    monkeypatch.setattr(lm, "MODEL_TOKENS", 500)
    got = lm.score_events(tree, one, two, code, learn, 4)
    which = (lm.mix(one) >> np.uint64(13)).astype(np.int64) % 6
    for k in np.unique(which):
        own = which == k
        want = BucketModel(tree, int(own.sum())).learn_and_score(one[own], two[own], code[own], learn[own], 4000 + int(k))
        assert np.allclose(got[own], want)


def test_classes_follow_the_vocabulary():
    assert bands(np.array([0, 1, 2, 3, 4, 1023, 1024, 10**9])).tolist() == [0, 0, 1, 1, 2, 9, 10, 15]
    assert [digits_for(v) for v in (0, 24_000, 24_001, 400_000, 10**7, 10**12)] == [1, 1, 2, 3, 4, 4]
    fine = leaves(np.arange(99, dtype=np.uint32), np.arange(99))
    assert (leaves(np.arange(99, dtype=np.uint32), np.arange(99), 2) == fine >> 8).all()


def test_scores_do_not_depend_on_files(spark, monkeypatch):
    """The same rows in two and in seven parts, in another order, with hot words dealt to several models."""
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 4000)
    monkeypatch.setattr(lm, "MODEL_TOKENS", 1500)
    rng = random.Random(12)
    rows = [(k, sentence(rng, rng.randint(0, 120))) for k in range(300)] + [(None, "no id"), (5, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({(r.doc_id, r.n_tokens): r.score for r in lm.score_corpus(d).collect()} for d in (df.repartition(2), df.orderBy("text").repartition(7)))
    assert one.keys() == two.keys()
    assert max(abs(one[k] - two[k]) for k in one) < 1e-6


def plain_pass(model, level, node, rows, outcome):
    """The same pass of AdaGrad as it stood before: rows by fancy indexing, sums from single precision, whole tables at once."""
    weights = [np.zeros((1 << model.bits, 16), np.float32) for _ in rows]
    squares = [np.full(w.shape, lm.DAMPING, np.float32) for w in weights]
    rows, size = [r.astype(np.uint16) for r in rows], -(-len(node) // lm.STEPS)
    for s in range(0, len(node), size):
        cut = slice(s, s + size)
        z = model.tree.logs[level][node[cut]]
        for w, r in zip(weights, rows):
            z += w[r[cut]]
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        np.negative(z, out=z)
        z[np.arange(len(z)), outcome[cut]] += 1
        delta = np.ascontiguousarray(z.T)
        for w, q, r in zip(weights, squares, rows):
            g = np.stack([np.bincount(r[cut], d, len(w)) for d in delta], 1).astype(np.float32)
            q += g * g
            g *= lm.RATE
            g /= np.sqrt(q)
            w += g
    return weights


def test_training_gives_what_plain_steps_give_in_less_time():
    rng = np.random.default_rng(9)
    tree = Tree(10**6, 40_000, np.arange(0, 65_536, 9), rng.integers(2, 50, 7282), np.ones(7282, int))
    n = 60_000
    one, two = (rng.zipf(1.3, n) % 9000).astype(np.uint32), rng.integers(0, 200, n).astype(np.uint16)
    code = (rng.choice(np.flatnonzero(tree.n), n)).astype(np.uint32)
    spent = {"plain": [], "own": []}
    for _ in range(3):
        model = BucketModel(tree, n)
        level, use, node, rows, outcome = list(model._parts(one, two, code))[1]
        for name, run in (("plain", lambda: plain_pass(model, level, node, rows, outcome)), ("own", lambda: model._train(level, node, rows, outcome))):
            began = time.process_time()
            found = run()
            spent[name].append(time.process_time() - began)
            want = found or want
        assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(model.weights[level], want, strict=True))
    assert min(spent["own"]) < 0.8 * min(spent["plain"])  # about two thirds


def test_squares_of_the_least_gradients_are_normal_numbers():
    tree = Tree(1000, 40, np.arange(40) * 1500, np.full(40, 9), np.ones(40, int))
    least = min(np.exp(x.min()) for x in tree.logs)
    assert np.finfo(np.float32).tiny < least**2 < 1e-30


def test_dictionary_of_a_block(odd_texts):
    texts = [t or "" for t in odd_texts] + [" \t\n A\x0bb\x0c\x1c c\x85d\u00a0  e ", "\x00 \x00a", ""]
    words, entries, lengths = lm.dictionary(pa.array(texts))
    words, ends = words.to_pylist(), np.cumsum(lengths)
    assert words[0] == b"" and len(set(words)) == len(words)
    for text, e, n in zip(texts, ends, lengths, strict=True):
        assert [words[x] for x in entries[e - n : e]] == [*text.encode().lower().split(), b""]
    assert lm.dictionary(pa.array([], pa.string()))[1].tolist() == []


def test_tokens_are_dealt_alike_by_either_sort(monkeypatch):
    """Long blocks of many words for many buckets have keys of more than 64 bits."""
    rng = np.random.default_rng(2)
    block = lm._Block.__new__(lm._Block)
    block.hashes, block.lengths = rng.integers(0, 1 << 32, 50).astype(np.uint32), np.array([1, 400, 1, 298])
    block.tokens, block.ids = rng.integers(0, 50, 700).astype(np.uint32), np.arange(4, dtype=np.uint64)
    block.salts = np.where(np.arange(50) % 7, 1, 3).astype(np.uint32)
    order, bucket, one, two = block.dealt(4, 13)
    assert sorted(order.tolist()) == list(range(700)) and (np.diff(bucket.astype(int)) >= 0).all()
    before = lambda at, k: block.hashes[block.tokens[at - k]] if at - k >= starts[np.searchsorted(ends, at, "right")] else lm._START
    ends, starts = np.cumsum(block.lengths), np.cumsum(block.lengths) - block.lengths
    assert one.tolist() == [int(before(at, 1)) for at in order]
    assert two.tolist() == [int(lm.mix(np.array([before(at, 2)]))[0]) >> 49 for at in order]
    monkeypatch.setattr(lm, "KEY_BITS", 20)
    assert all((a == b).all() for a, b in zip(block.dealt(4, 13), (order, bucket, one, two), strict=True))
