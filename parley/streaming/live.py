"""Sessions and tapbacks over unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators.tapbacks import REMOVE_KIND, is_tapback, target_of


def live_sessions(events: DataFrame, key: str = "handle", gap: str = "4 hours", lateness: str = "1 hour") -> DataFrame:
    """(key, start, end, n): sessions, each emitted when the watermark has passed it."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    found = rows.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def live_volumes(events: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return rows.groupBy(F.window("at", width).alias("w"), "is_from_me").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "is_from_me", "n")


def live_tapbacks(events: DataFrame) -> DataFrame:
    """(target, reactor, kind): a row whenever the state of a (target, reactor) changes; kind is null once it is taken away.

    State holds the newest event of a pair, so late events change nothing.
    """
    rows = events.where(is_tapback(F.col("kind"))).select(target_of(F.col("assoc_guid")).alias("target"), "reactor", "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "id")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        was = best
        for b in batches:
            for kind, at, i in b[["kind", "at", "id"]].itertuples(index=False):
                if best is None or (at, i) > best[:2]:
                    best = (int(at), int(i), int(kind))
        if best != was:
            state.update(best)
            yield pd.DataFrame({"target": [key[0]], "reactor": [key[1]], "kind": pd.array([best[2] if best[2] < REMOVE_KIND else None], "Int64")})

    return rows.groupBy("target", "reactor").applyInPandasWithState(step, "target string, reactor long, kind long", "at long, id long, kind long", "update", GroupStateTimeout.NoTimeout)
