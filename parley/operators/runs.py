"""Training runs: log lines to metrics, early stopping, phases, registry and stalled runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_DROP, PATIENCE, MIN_EVALS = 0.01, 6, 3
# How a trainer writes its numbers.
FIELDS = {
    "iter": r"Iter (\d+)", "train_loss": r"Train loss ([\d.]+)", "val_loss": r"Val loss ([\d.]+)", "learning_rate": r"Learning Rate ([\d.eE+-]+)",
    "tokens_per_sec": r"Tokens/sec ([\d.]+)", "peak_mem_gb": r"Peak mem ([\d.]+)",
}


def plain(line: Column) -> Column:
    """Without terminal colours."""
    return F.regexp_replace(line, r"\x1b\[[0-9;]*[A-Za-z]", "")


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add a column for each metric; null where a line does not have it. Lines without an iteration are dropped."""
    text = plain(F.col(line))
    found = {k: F.expr(f"try_cast(nullif(regexp_extract(_text, r'{p}', 1), '') AS {'bigint' if k == 'iter' else 'double'})") for k, p in FIELDS.items()}
    return lines.withColumn("_text", text).withColumns(found).drop("_text").where(F.col("iter").isNotNull())


def merge_metrics(metrics: DataFrame, run: str = "run") -> DataFrame:
    """One row for each iteration of a run, from lines that each carry some of its metrics."""
    return metrics.groupBy(run, "iter").agg(*(F.max(k).alias(k) for k in FIELDS if k != "iter"))


def last_errors(lines: DataFrame, line: str = "line", run: str = "run", order: str = "n") -> DataFrame:
    """(run, error): the last line of each run that names an error."""
    rows = lines.where(plain(F.col(line)).rlike(r"(?i)(error|exception|killed|out of memory)"))
    return rows.groupBy(run).agg(F.max_by(plain(F.col(line)), order).alias("error"))


def early_stop(evals: DataFrame, run: str = "run", min_drop: float = MIN_DROP, patience: int = PATIENCE, min_evals: int = MIN_EVALS) -> DataFrame:
    """(run, best, best_iter, stop_iter): the best loss only moves on a drop of ``min_drop``; enough stale evaluations stop a run.

    An ordered fold, as the best is sticky; each run has few evaluations.
    """
    rows = F.array_sort(F.collect_list(F.struct("iter", "loss")))
    start = F.named_struct(F.lit("best"), F.lit(None).cast("double"), F.lit("best_iter"), F.lit(None).cast("bigint"), F.lit("stale"), F.lit(0), F.lit("n"), F.lit(0), F.lit("stop"), F.lit(None).cast("bigint"))

    def step(s: Column, x: Column) -> Column:
        better = s["best"].isNull() | (s["best"] - x["loss"] >= min_drop)
        stale = F.when(better, 0).otherwise(s["stale"] + 1)
        now = F.struct(
            F.when(better, x["loss"]).otherwise(s["best"]).alias("best"), F.when(better, x["iter"]).otherwise(s["best_iter"]).alias("best_iter"), stale.alias("stale"), (s["n"] + 1).alias("n"),
            F.when((stale >= patience) & (s["n"] + 1 >= min_evals), x["iter"]).alias("stop"),
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(now)

    return evals.select(run, F.col("iter").cast("bigint").alias("iter"), F.col("loss").cast("double").alias("loss")).groupBy(run).agg(F.aggregate(rows, start, step).alias("s")).select(
        run, "s.best", "s.best_iter", F.col("s.stop").alias("stop_iter")
    )


def phase_times(events: DataFrame, run: str = "run", ts: str = "ts", phase: str = "phase") -> DataFrame:
    """(run, phase, seconds): time from each event to the next, by phase."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    took = F.lead(us).over(Window.partitionBy(run).orderBy(ts)) - us
    return events.withColumn("_took", took).groupBy(run, phase).agg((F.sum(F.coalesce("_took", F.lit(0))) / 1e6).alias("seconds"))


def sweep_stale(runs: DataFrame, as_of: Column, idle_seconds: int = 3600) -> DataFrame:
    """Runs that claim to be running but have been idle are cancelled."""
    idle = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("updated").cast("timestamp")) > idle_seconds * 1_000_000
    return runs.withColumn("status", F.when((F.col("status") == "running") & idle, "cancelled").otherwise(F.col("status")))


def stalled(before: DataFrame, after: DataFrame, key: str = "run", counter: str = "n") -> DataFrame:
    """Keys whose counter has not grown between two snapshots."""
    return after.join(before.select(key, F.col(counter).alias("_was")), key).where(F.col(counter) <= F.col("_was")).select(key)


def parse_checkpoint(c: Column) -> dict[str, Column]:
    """model/run/step."""
    parts = F.split(c, "/")
    return {"model": F.get(parts, F.lit(0)), "run": F.get(parts, F.lit(1)), "step": F.get(parts, F.lit(2)).try_cast("int")}


def newest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created"), "run").limit(1)


def registry(spark: SparkSession, root: str, name: str = "run.json") -> DataFrame:
    """(run, created, and what the file holds): one row for each run folder under ``root``, newest first."""
    schema = "created timestamp, model string, status string"
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{name}")
    return rows.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)).orderBy(F.desc("created"), "run")


def checkpoint_steps(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, step) of files whose name begins with the number of a step."""
    return paths.withColumn("step", F.regexp_extract(path, r"/0*(\d+)_[^/]*$", 1).try_cast("int")).where("step IS NOT NULL")
