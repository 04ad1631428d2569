"""Word statistics of sent messages as one build: totals, words, phrases, and what sets people and years apart; kept until a newer message comes."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import STOP_WORDS
from parley.operators import phrases
from parley.plans.scratch import save
from parley.sources.publish import publish

PERSON_MESSAGES, YEAR_MESSAGES, PEOPLE = 80, 200, 12


def person_words(messages: DataFrame, stop: Sequence[str] = (), least: int = PERSON_MESSAGES, people: int = PEOPLE) -> DataFrame:
    """(handle, messages, word, n, lift, place) for the people with most messages, of those with enough."""
    busy = messages.where(F.col("handle").isNotNull()).groupBy("handle").agg(F.count("*").alias("messages")).where(F.col("messages") >= least).orderBy(F.desc("messages"), "handle").limit(people)
    return phrases.distinctive(messages.where(F.col("handle").isNotNull()), "handle", stop=stop).join(F.broadcast(busy), "handle")  # ``people`` rows


def year_words(messages: DataFrame, stop: Sequence[str] = (), least: int = YEAR_MESSAGES) -> DataFrame:
    """(year, messages, word, n, lift, place) for years with enough messages."""
    rows = messages.withColumn("year", F.year("ts"))
    enough = rows.groupBy("year").agg(F.count("*").alias("messages")).where(F.col("messages") >= least)
    found = phrases.distinctive(rows, "year", stop=stop, min_n=phrases.YEAR_MIN, min_lift=phrases.YEAR_LIFT, limit=phrases.YEAR_WORDS)
    return found.join(F.broadcast(enough), "year")  # a row for each year


def build(messages: DataFrame, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(section, key, word, n, lift, place, messages) of sent messages (id, ts, handle, body): sections totals, words, phrases, people and years."""
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda df, section, **c: df.select(
        F.lit(section).alias("section"), *(c.get(n, none(t)).cast(t).alias(n) for n, t in (("key", "string"), ("word", "string"), ("n", "long"), ("lift", "double"), ("place", "int"), ("messages", "long")))
    )
    col = F.col
    words = phrases.word_counts(messages, stop=stop).where(F.length("word") >= 2).orderBy(F.desc("n"), "word").limit(phrases.TOP_WORDS)
    counts = save(phrases.phrase_counts(messages, min_count=phrases.MIN_COUNT), "voice-phrases")
    totals = messages.agg(F.count("*").alias("messages"), F.round(F.avg(F.char_length("body"))).alias("avg_len"))
    out = shape(totals, "totals", n=col("avg_len"), messages=col("messages"))
    out = out.unionByName(shape(words, "words", word=col("word"), n=col("n")))
    out = out.unionByName(shape(phrases.frequent_phrases(counts, stop), "phrases", word=col("phrase"), n=col("n")))
    for df, key in ((person_words(messages, stop), "handle"), (year_words(messages, stop), "year")):
        section = "people" if key == "handle" else "years"
        out = out.unionByName(shape(df, section, key=col(key), word=col("word"), n=col("n"), lift=col("lift"), place=col("place"), messages=col("messages")))
    return out


def current(messages: DataFrame, root: str, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The build for the newest message and these stop words, made once under ``root`` and read from then on; a newer message makes a new one."""
    newest = messages.agg(F.max("id")).first()[0]
    words = hashlib.sha256("\n".join(sorted(stop)).encode()).hexdigest()[:16]
    return publish(messages.sparkSession, root, f"{newest}-{words}", lambda: build(messages, stop))
