"""Scores of a reply against the true one. Those that need dynamic programming or compression are Arrow UDFs."""

from __future__ import annotations

import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from parley.plans.scratch import arrow_batches

NGRAMS, LENGTH_WEIGHT, ROUGE_WEIGHT = 6, 0.5, 0.3
SPAM_CHARS, SPAM_RATIO = 25, 0.35


def chrf_score(pred: str | None, gold: str | None, most: int = NGRAMS, beta: float = 1.0) -> float:
    """F-score of character n-grams of one to six; a text shorter than n counts as one n-gram."""
    pred, gold = (pred or "").lower(), (gold or "").lower()
    if not pred or not gold:
        return 0.0
    precision = recall = 0.0
    for n in range(1, most + 1):
        a, b = (Counter(t[i : i + n] for i in range(max(1, len(t) - n + 1))) for t in (pred, gold))
        both = (a & b).total()
        precision += both / a.total() / most
        recall += both / b.total() / most
    return (1 + beta**2) * precision * recall / (beta**2 * precision + recall) if precision and recall else 0.0


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one row of the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_score(pred: str | None, gold: str | None) -> float:
    a, b = (pred or "").split(), (gold or "").split()
    n = common_length(a, b) if a and b else 0
    return 2 * n / (len(a) + len(b)) if n else 0.0


def is_spam(text: str | None) -> bool:
    """Long enough, and compressible to almost nothing."""
    data = (text or "").encode()
    return len(text or "") >= SPAM_CHARS and len(zlib.compress(data, 9)) < SPAM_RATIO * len(data)


def trim_spam(text: str | None, keep: int = 2) -> str:
    """Repeated blocks of one to four words, then a text that is one repeated unit of one to four characters, cut to two copies."""
    words = (text or "").split()
    for size in range(1, 5):
        out, i = [], 0
        while i < len(words):
            unit, run = words[i : i + size], 1
            if len(unit) == size:
                while words[i + run * size : i + (run + 1) * size] == unit:
                    run += 1
            out += unit * min(run, keep)
            i += run * len(unit)
        words = out
    text = " ".join(words)
    for size in range(1, 5):
        unit = text[:size]
        if unit and len(text) >= 6 * size and text[: len(text) // size * size] == unit * (len(text) // size):
            return unit * keep
    return text


def _udf(fn, kind: str, *columns: Column | str) -> Column:
    arrow_batches(SparkSession.active())
    if len(columns) == 1:

        @F.pandas_udf(kind)
        def one(a: pd.Series) -> pd.Series:
            return a.map(fn)

        return one(*columns)

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) for x, y in zip(a, b, strict=True)])

    return two(*columns)


def chrf(pred: Column | str, gold: Column | str) -> Column:
    return _udf(chrf_score, "double", pred, gold)


def rouge_l(pred: Column | str, gold: Column | str) -> Column:
    return _udf(rouge_score, "double", pred, gold)


def degenerate(text: Column | str) -> Column:
    return _udf(is_spam, "boolean", text)


def trimmed(text: Column | str) -> Column:
    return _udf(trim_spam, "string", text)


def ranking(chrf_: Column, rouge: Column, length_ratio: Column, copied: Column) -> Column:
    """One number for a reply; higher is better."""
    penalty = F.abs(F.log(F.greatest(F.lit(0.05), F.least(F.lit(20.0), length_ratio))))
    return chrf_ + ROUGE_WEIGHT * rouge - LENGTH_WEIGHT * penalty - copied.cast("double")
