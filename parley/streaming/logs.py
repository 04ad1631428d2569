"""Training logs as a stream: an early stop is announced while the run is still going on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators.runs import MIN_DROP, MIN_EVALS, PATIENCE, parse_log

_STATE = "best double, best_iter long, stale long, n long, stop long"
_EVENT = "run string, event string, best double, best_iter long, at_iter long"
State = tuple[float | None, int | None, int, int, int | None]


def log_pieces(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """(run, n, line): lines of new files ``root/<run>/<piece>`` as a stream.

    A piece is read whole, so that its lines keep their order; pieces of a run follow one another by name.
    """
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(f"{root}/*")
    path = F.col("_metadata.file_path")
    lines = rows.select(F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract(path, "[^/]+$", 0).alias("piece"), F.posexplode(F.split("value", "\r\n|\r|\n")).alias("k", "line"))
    return lines.select("run", F.struct("piece", "k").alias("n"), "line")


def note(state: State, at: int, loss: float, min_drop: float, patience: int, min_evals: int) -> State:
    """The state after one more evaluation, as ``runs.early_stop`` folds it."""
    best, best_iter, stale, n, stop = state
    if stop is not None:
        return state
    if best is None or best - loss >= min_drop:
        return loss, at, 0, n + 1, None
    return best, best_iter, stale + 1, n + 1, at if stale + 1 >= patience and n + 1 >= min_evals else None


def early_stops(
    lines: DataFrame, min_drop: float = MIN_DROP, patience: int = PATIENCE, min_evals: int = MIN_EVALS, idle_seconds: int | None = None
) -> DataFrame:
    """(run, event, best, best_iter, at_iter) from a stream of lines (run, n, line): one row when a run should stop.

    State holds the best loss, its iteration and the stale evaluations of each run, so a stop is found across batches and restarts. Lines of a
    batch are taken in the order of ``n``; a run's later lines must come in later batches, as appended logs do. Lines without
    an evaluation only show that the run is alive: with ``idle_seconds``, a run without lines for so long is announced as ``stalled``, once for each pause.
    """
    evals = parse_log(lines).select(F.col("run").cast("string").alias("run"), "n", "iter", F.col("val_loss").alias("loss"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now: State = state.get if state.exists else (None, None, 0, 0, None)
        row = lambda event, at: pd.DataFrame({"run": [key[0]], "event": [event], "best": [now[0]], "best_iter": pd.array([now[1]], "Int64"), "at_iter": pd.array([at], "Int64")})
        if state.hasTimedOut:
            state.update(now)
            if now[4] is None:
                yield row("stalled", None)
            return
        was = now[4]
        found = [x for b in batches for x in b[["n", "iter", "loss"]].itertuples(index=False, name=None)]
        for _, at, loss in sorted(found, key=lambda x: tuple(x[0].values()) if isinstance(x[0], dict) else x[0]):
            if loss == loss and loss is not None:
                now = note(now, int(at), float(loss), min_drop, patience, min_evals)
        state.update(now)
        if idle_seconds is not None and now[4] is None:
            state.setTimeoutDuration(idle_seconds * 1000)
        if was is None and now[4] is not None:
            yield row("stop", now[4])

    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return evals.groupBy("run").applyInPandasWithState(step, _EVENT, _STATE, "append", timeout)


def follow(lines: DataFrame, target: str, checkpoint: str, **options: float) -> StreamingQuery:
    """Write the events of what has come so far to ``target``, each once; the next call with the same checkpoint goes on from there."""
    found = early_stops(lines, **options)
    return found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
