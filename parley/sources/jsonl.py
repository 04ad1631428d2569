"""JSON lines: examples, predictions, result logs and dataset folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = "query string, reply string, peer string, date long"
EXAMPLE = "messages array<struct<role:string,content:string>>"
PREDICTIONS = (
    "label string, adapter string, step int, split string, data_hash string, temp double, repetition_penalty double, retrieve_k int, "
    "predictions array<struct<gold:string,pred:string,peer:string,incoming:string>>"
)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with a declared schema; blank lines and lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, PAIR).where("trim(query) <> '' AND trim(reply) <> ''")


def write_splits(examples: DataFrame, path: str, split: str = "split", seed: int = 0, key: str = "id") -> None:
    """One folder of JSON lines for each split; train rows in an order drawn by a hash."""
    for name in ("train", "valid", "test"):
        rows = examples.where(F.col(split) == name)
        rows = rows.orderBy(F.xxhash64(F.lit(seed), key)) if name == "train" else rows
        rows.select("messages").write.mode("overwrite").json(f"{path}/{name}")


def write_report(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def latest_label(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("runs"), F.max_by("label", "ts").alias("label"))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, hash): the same for the same rows in any order."""
    names: list[str | Column] = list(columns or df.columns)
    return df.agg(F.count("*").alias("rows"), F.left(F.sha1(F.sum(F.xxhash64(*names).cast("decimal(38,0)")).cast("string")), F.lit(12)).alias("hash"))
