"""Neighbouring rows of a key in time, without one task for a whole key.

A key's history is cut into slices of time. Neighbours inside a slice come from a
window over (key, slice); those across a boundary come from a table of one row for
each slice. A key that holds a third of all rows is thus spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.plans.scratch import save

SLICE_SECONDS = 7 * 86400


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (the session zone is UTC)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def _beside(df: DataFrame, key: str, at: Column, tie: str, columns: list[str], slice_seconds: int, back: bool) -> DataFrame:
    value = F.struct(*columns)
    order = [at, F.col(tie)] if back else [at.desc(), F.col(tie).desc()]
    rows = df.withColumn("_slice", F.floor(at / (slice_seconds * 1_000_000)))
    inner = rows.withColumn("_near", F.lag(value).over(Window.partitionBy(key, "_slice").orderBy(*order)))
    pick = F.max_by if back else F.min_by
    edges = rows.groupBy(key, "_slice").agg(pick(value, F.struct(at, F.col(tie))).alias("_edge"))
    across = Window.partitionBy(key).orderBy(F.col("_slice") if back else F.col("_slice").desc())
    edges = edges.select(key, "_slice", F.lag("_edge").over(across).alias("_far"))
    prefix = "prev" if back else "next"
    joined = inner.join(edges, [key, "_slice"], "left").withColumn("_near", F.coalesce("_near", "_far"))
    return joined.withColumns({f"{prefix}_{c}": F.col(f"_near.{c}") for c in columns}).drop("_near", "_far", "_slice")


def with_previous(df: DataFrame, key: str, columns: list[str], ts: str = "ts", tie: str = "id", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add prev_<column>: values of the row before, in (ts, tie) order within ``key``; null at the start. Keys must not be null."""
    return _beside(df, key, micros(ts), tie, columns, slice_seconds, True)


def with_next(df: DataFrame, key: str, columns: list[str], ts: str = "ts", tie: str = "id", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add next_<column>: values of the row after; null at the end."""
    return _beside(df, key, micros(ts), tie, columns, slice_seconds, False)


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_slice``, for keys whose order has no time to cut by: rows in order of (keys, order), cut into ranges of about equal size.

    The table is written, as the ranges of a plan that runs twice need not be the same. A key with a third of all rows spans a third of the slices.
    """
    return save(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")


def previous(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add prev_<column> of the row before within ``keys``, to rows with a ``_slice`` that grows with the order."""
    value = F.struct(*columns)
    near = F.lag(value).over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    edges = rows.groupBy(*keys, "_slice").agg(F.max_by(value, F.struct(*order)).alias("_edge"))
    edges = edges.select(*keys, "_slice", F.lag("_edge").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_far"))
    joined = rows.withColumn("_near", near).join(edges, [*keys, "_slice"]).withColumn("_near", F.coalesce("_near", "_far"))
    return joined.withColumns({f"prev_{c}": F.col(f"_near.{c}") for c in columns}).drop("_near", "_far")


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``, the sum of ``value`` up to and with each row: sums within a slice plus the totals of the slices before."""
    valued = rows.withColumn("_value", value)
    inner = F.sum("_value").over(Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = valued.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*keys, "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    return valued.withColumn(name, inner).join(totals, [*keys, "_slice"]).withColumn(name, F.col(name) + F.col("_before")).drop("_value", "_before")
