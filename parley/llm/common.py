"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans.scratch import new_path, save, ship_package

#: Rows and bytes in one Arrow batch. Long texts make row counts a poor bound on memory.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20

#: Ids up to this many are broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 100_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BATCH = "spark.sql.execution.arrow."


def prepare(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound Arrow batches for whole-text operators and make the package importable on executors."""
    spark.conf.set(_BATCH + "maxRecordsPerBatch", str(rows))
    spark.conf.set(_BATCH + "maxBytesPerBatch", str(ARROW_BYTES))
    ship_package(spark)


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): null texts become empty, all other columns are pruned from the scan."""
    return docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))


def id_crc(id_col: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to columns in the order of ``schema``."""
    spark = df.sparkSession
    prepare(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without rows whose id is in ``gone`` (column gone); rows without an id stay."""
    gone = save(gone, "gone-ids")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone.withColumnRenamed("gone", "_parley_gone"), named(id_col).cast("long") == F.col("_parley_gone"), "left_anti")


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``docs`` without rows whose id and ``key``, a digest of the text, are in ``gone`` (columns gone, gone_key); rows without an id stay."""
    gone = save(gone.distinct(), "gone-rows")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    gone = gone.select(F.col("gone").alias("_parley_gone"), F.col("gone_key").alias("_parley_key"))
    return docs.join(gone, (named(id_col).cast("long") == F.col("_parley_gone")) & (key == F.col("_parley_key")), "left_anti")


#: Parts that the blocks of one task are dealt to, so that later passes over them have more tasks than the first.
SPREAD = 16


def part_of(task: int, batch: int) -> int:
    """The part of a task's block; ``part // SPREAD`` is the task again."""
    return task * SPREAD + batch % SPREAD


def blocks_by_part(blocks: DataFrame, name: str) -> DataFrame:
    """``blocks`` (with a column part, see ``part_of``) written once and bucketed by part, so that joins on it leave them in place."""
    spark = blocks.sparkSession
    # no fewer buckets than shuffle partitions: Spark would deal both sides of a join anew
    buckets = max(2 * blocks.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"parley_{name}_{uuid.uuid4().hex}"
    blocks.write.bucketBy(min(buckets, 100_000), "part").option("path", new_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # only its name: the files and their buckets stay with ``found``
    return found


def with_answers(blocks: DataFrame, answers: DataFrame, name: str, *columns: str) -> DataFrame:
    """Blocks, unmoved, with the answers (part, batch, columns) to each as an array of structs; empty where there are none."""
    own = answers.groupBy("part").agg(F.collect_list(F.struct("batch", *columns)).alias("_found"))
    joined = blocks.join(own.hint("shuffle_hash"), "part", "left")
    mine = F.filter("_found", lambda x: x["batch"] == F.col("batch"))
    return joined.withColumn(name, F.coalesce(F.transform(mine, lambda x: F.struct(*(x[c].alias(c) for c in columns))), F.array())).drop("_found")


def by_bucket(bucket_of: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """Entries ordered by bucket, and where each bucket that has any begins and ends."""
    order = np.argsort(bucket_of, kind="stable")
    b = bucket_of[order]
    edges = np.r_[np.flatnonzero(np.r_[True, b[1:] != b[:-1]][: len(b)]), len(b)].tolist()
    return order, {int(b[s]): (s, e) for s, e in zip(edges, edges[1:], strict=False)}
