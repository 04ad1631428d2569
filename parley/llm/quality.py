"""A quality classifier by positive-unlabelled learning.

Trusted positives are labelled good; everything else is unlabelled, and no label but good is ever read. A model
minimises the non-negative unbiased risk with logistic loss, so its output estimates the
probability of a good text: a small network on shares of characters, marks, repeats and lengths, and a linear part on hashed
words and pairs of words. The class prior is estimated from positives and unlabelled rows alone (``estimate_prior``).
Fitting uses bounded samples (``POSITIVES``, ``UNLABELLED``); scoring covers every row and shuffles nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import id_crc, id_text, map_batches, named, prepare

#: Rows that fitting takes at most: labelled positives, and unlabelled rows. Chosen by a hash of id and text.
POSITIVES, UNLABELLED = 4096, 8192
HELD_OUT_OF, THRESHOLD, HIDDEN, STEPS = 5, 0.3, 16, 400
_MARKS = "!#$%&*|.,\"'=@/:;<>()[]{}-_+~^`?\\"
_MARK_CODES = np.array([ord(c) for c in _MARKS])
_SCALE = 1e-3
DENSE = 12 + len(_MARKS)
#: Buckets of hashed words, and of pairs of words.
LEXICAL = 128
N_FEATURES = DENSE + 2 * LEXICAL
#: Weight of the squared weights in the risk: of the network, and of the linear part.
DECAY, LEXICAL_DECAY = 1e-4, 1e-2


def features(text: str) -> np.ndarray:
    """Shares of character classes, marks, repeats and lengths, on a logarithmic scale; defined for empty texts too."""
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    words = text.split()
    lines = text.split("\n")
    n, chars = max(1, len(words)), max(1, int(counts.sum()))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    high, digits = int(counts[128:].sum()), int(counts[48:58].sum())
    letters = max(1, upper + lower + high)
    shares = [
        upper / letters,
        digits / chars,
        high / chars,
        (chars - upper - lower - high - digits) / chars,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        len(lines) / n,
        int(counts[:32].sum()) / chars,
        letters / n / 20,
        1 / n,
        math.log1p(n) / 10,
    ]
    return np.concatenate([np.log(_SCALE + np.concatenate([shares, counts[_MARK_CODES] / n])), lexical(text)])


def lexical(text: str) -> np.ndarray:
    """Square roots of the shares of hashed words, and of hashed pairs of neighbouring words."""
    h = np.array([zlib.crc32(w) for w in text.encode().lower().split()], np.uint32)
    pairs = h[:-1] * np.uint32(0x9E3779B1) ^ h[1:]
    parts = [np.bincount((x * np.uint32(0x85EBCA6B)) >> np.uint32(25), minlength=LEXICAL) / max(1, len(x)) for x in (h, pairs)]
    return np.sqrt(np.concatenate(parts))


class PuModel:
    """Standardised features; one hidden layer on the first ``dense`` of them, a linear part on the others; a logistic output."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, dense: int, seed: int) -> None:
        self.mean, self.scale, self.dense = mean, scale, dense
        rng = np.random.default_rng(seed)
        self.weights = [rng.normal(0, 1 / np.sqrt(dense), (dense, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(()), np.zeros(len(mean) - dense)]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def _outputs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2, linear = self.weights
        h = np.tanh(x[:, : self.dense] @ w1 + b1)
        return h, h @ w2 + b2 + x[:, self.dense :] @ linear

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self._outputs(self.standard(x))[1])

    def descend(self, x: np.ndarray, slope: Callable[[np.ndarray], np.ndarray], steps: int) -> None:
        """Adam on all of standardised ``x``; ``slope`` gives the risk's derivative by each row's output."""
        w = [np.asarray(a, np.float32) for a in self.weights]
        x = x.astype(np.float32)
        first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        wide = np.ascontiguousarray(x[:, self.dense :])
        deep = np.ascontiguousarray(x[:, : self.dense])
        for step in range(1, steps + 1):
            h = np.tanh(deep @ w[0] + w[1])
            g = slope(h @ w[2] + w[3] + wide @ w[4]).astype(np.float32)
            back = np.outer(g, w[2]) * (1 - h * h)
            grads = [deep.T @ back + DECAY * w[0], back.sum(0), h.T @ g + DECAY * w[2], g.sum(), wide.T @ g + LEXICAL_DECAY * w[4]]
            rate = 0.02 * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for a, d in enumerate(grads):
                first[a], second[a] = 0.9 * first[a] + 0.1 * d, 0.999 * second[a] + 0.001 * d * d
                w[a] = (w[a] - rate * first[a] / (np.sqrt(second[a]) + 1e-8)).astype(np.float32)
        self.weights = [a.astype(np.float64) for a in w]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _new_model(positive: np.ndarray, unlabelled: np.ndarray, seed: int) -> tuple[PuModel, np.ndarray]:
    model = PuModel(unlabelled.mean(0), unlabelled.std(0) + 1e-2, min(DENSE, unlabelled.shape[1]), seed)
    return model, model.standard(np.vstack([positive, unlabelled]))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7, steps: int = STEPS) -> PuModel:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) on the full sample."""
    model, x = _new_model(positive, unlabelled, seed)
    k, n = len(positive), len(unlabelled)

    def slope(z: np.ndarray) -> np.ndarray:
        s, g = _logistic(z), np.empty(len(z))
        if np.logaddexp(0, z[k:]).mean() >= prior * np.logaddexp(0, z[:k]).mean():
            g[:k] = prior / k * (s[:k] - 1) - prior / k * s[:k]
            g[k:] = s[k:] / n
        else:  # step back up the negative part, as the non-negative estimator prescribes
            g[:k] = prior / k * s[:k]
            g[k:] = -s[k:] / n
        return g

    model.descend(x, slope, steps)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7, steps: int = STEPS // 4) -> float:
    """The share of good texts among the unlabelled, from these two samples alone.

    Each half of both trains a classifier of positive against unlabelled, which scores the other half by the
    share of positives below. Above any cut of that score, the share of the unlabelled is at least the prior times the share of
    positives; the cut with the least upper confidence bound of their ratio gives the estimate.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    p, u = np.empty(len(positive)), np.empty(len(unlabelled))
    for half in (0, 1):
        model, x = _new_model(positive[half::2], unlabelled[half::2], seed)
        k, n = len(positive[half::2]), len(unlabelled[half::2])

        def slope(z: np.ndarray, k: int = k, n: int = n) -> np.ndarray:
            s = _logistic(z)
            return np.concatenate([(s[:k] - 1) / k, s[k:] / n])

        model.descend(x, slope, steps)
        own = np.sort(model.score(positive[1 - half :: 2]))
        for to, rows in ((p, positive), (u, unlabelled)):
            to[1 - half :: 2] = np.searchsorted(own, model.score(rows[1 - half :: 2])) / len(own)
    cuts = np.linspace(0.002, 0.9, 250)
    above_p, above_u = (1 - np.searchsorted(np.sort(v), cuts) / len(v) for v in (p, u))
    slack = math.sqrt(math.log(40) / 2 / len(u)) + math.sqrt(math.log(40) / 2 / len(p))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Features of ``most`` rows (doc_id, text) at most, those with the least hashes."""

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        return {"first": b.column("first"), "second": b.column("second"), "f": [features(t).astype(np.float32) for t in b.column("text").to_pylist()]}

    keyed = rows.select(F.xxhash64(F.lit(3), "doc_id").alias("first"), F.xxhash64("text").alias("second"), "text")
    found = map_batches(keyed, batch, "first long, second long, f array<float>").orderBy("first", "second").limit(most).toArrow().column("f").combine_chunks()
    return np.asarray(found.values).astype(np.float64).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> PuModel | None:
    """Fit on rows whose crc32(id) mod 5 is not 0; None without a trusted positive there."""
    fold = F.col("doc_id").isNotNull() & (id_crc(F.col("doc_id")) % HELD_OUT_OF != 0)
    rows = id_text(docs, id_col, text_col).where(fold)
    good = (
        labels.select(named(id_col).cast("long").alias("doc_id"), (named(label_col).cast("int") == 1).alias("good"))
        .where(fold & F.col("good").isNotNull()).groupBy("doc_id").agg(F.every("good").alias("good")).where("good").select("doc_id")
    )
    pick = lambda ids, salt, most: ids.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(most).distinct()
    # at most POSITIVES and UNLABELLED ids to join, and as many rows to collect
    p, u = (
        _sample(rows.join(F.broadcast(pick(ids, salt, most)), "doc_id"), most)
        for ids, salt, most in ((good, 1, POSITIVES), (rows.select("doc_id"), 2, UNLABELLED))
    )
    # hashed words let small samples be told apart by chance, so that the prior is estimated without them
    return fit_pu(p, u, estimate_prior(p[:, :DENSE], u[:, :DENSE])) if len(p) and len(u) else None


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row; see ``train`` for what is learnt from.

    Scores read the text only. A null text counts as empty and gets a score; a null id counts as held out;
    labels that are null, or other than 1 in one of several rows of an id, are not positive. Without any positive
    every score is 0.5. Repeated rows score alike; texts of any length count whole; empty tables give empty results.
    Other columns, whatever their names, are not read.
    """
    model = train(docs, labels, id_col, text_col, label_col)

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        texts = b.column("text").to_pylist()
        score = model.score(np.array([features(t) for t in texts])) if model else np.full(len(texts), 0.5)
        return {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    rows = id_text(docs, id_col, text_col).select("doc_id", (id_crc(F.col("doc_id")) % HELD_OUT_OF == 0).alias("held_out"), "text")
    return map_batches(rows, batch, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows that score under the threshold; all columns are kept and nothing is shuffled.

    Null texts are scored as empty ones; of repeated rows all stay or all go; without any positive label every row stays.
    """
    prepare(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    if model is None:
        return docs

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([features(t) for t in texts.to_pylist()])) >= THRESHOLD, pa.bool_())

    return docs.where(good(F.coalesce(named(text_col), F.lit(""))))
