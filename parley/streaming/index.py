"""Keeping the search index up to date, as a stream of new files or by a high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.search import tokens
from parley.operators.tapbacks import not_tapback

VERSION = "1"


def indexable(messages: DataFrame) -> DataFrame:
    """Messages with a body that are no tapbacks (columns msg_id, chat_id, body, kind)."""
    return messages.where(not_tapback(F.col("kind")) & (F.trim(F.coalesce("body", F.lit(""))) != ""))


def new_rows(messages: DataFrame, high_water: int, rebuilt: bool = False) -> DataFrame:
    """Rows past the mark, each (msg_id, chat_id) once."""
    rows = indexable(messages)
    return (rows if rebuilt else rows.where(F.col("msg_id") > high_water)).dropDuplicates(["msg_id", "chat_id"])


def plan_increment(messages: DataFrame, state: dict) -> str:
    """none, append or rebuild: a source that shrank, or another version of the index, asks for a new one."""
    newest = messages.agg(F.max("msg_id")).first()[0] or 0
    if state.get("version") != VERSION or newest < state.get("last_msg_id", 0):
        return "rebuild"
    return "append" if newest > state.get("last_msg_id", 0) else "none"


def stream_postings(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 10) -> StreamingQuery:
    """Read new Parquet files and append their postings, partitioned by batch.

    A batch that is run again after a failure overwrites its own partition, so nothing is indexed twice.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def index(batch: DataFrame, number: int) -> None:
        fresh = indexable(batch).dropDuplicates(["msg_id", "chat_id"])
        words = tokens(fresh.withColumn("doc_id", F.struct("msg_id", "chat_id")))
        found = words.groupBy("doc_id", F.col("raw").alias("term")).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        found.select("doc_id.*", "term", "positions").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
