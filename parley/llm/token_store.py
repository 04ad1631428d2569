"""Token ids in ORC files in document order.

Ids are 32-bit integers in an array column: ORC stores them with its integer run-length
encoding, in stripes that readers split, with row indexes and Bloom
filters on the document id, so that a lookup reads few row groups. A small manifest
holds the first global position of each file; positions inside a file are stored with its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from parley.llm.bpe import BpeTable, default_path
from parley.llm.common import id_text, prepare
from parley.plans.scratch import new_path

END_ID = 1
STRIPE_BYTES, INDEX_ROWS, FILES_A_SPLIT = 16 << 20, 1000, 2
_SCHEMA = "part int, seq long, doc_id long, local_start long, n_tokens int, ids array<int>"


class LibraryTable(BpeTable):
    """Texts are split as ``BpeTable`` does; the library's model merges each word that is not remembered."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.model = Tokenizer.from_file(path).model

    def word_ids(self, word: str) -> list[int]:
        shown = word if word.isascii() and word.isprintable() else "".join([self.letters[c] for c in word.encode()])
        return [t.id for t in self.model.tokenize(shown)]


@cache
def encoder(path: str) -> LibraryTable:
    return LibraryTable(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write ``path/data`` (ORC) and ``path/manifest`` in ascending order of id.

    Each document ends with ``END_ID``. Null texts count as empty (just the end id). Null ids come first;
    rows that share an id are ordered by a 64-bit hash of their texts, then as read. Texts of any length are encoded whole. An empty table gives empty files.
    Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    tokenizer = tokenizer or default_path()
    struct = StructType.fromDDL(_SCHEMA)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, at = TaskContext.get().partitionId(), 0, 0
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            table = encoder(tokenizer)
            ids = [np.frombuffer(table.encode(x) + end, "<i4") for x in b.column("text").to_pylist()]
            n = len(ids)
            if not n:
                continue
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
            cols = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), b.column("doc_id"), pa.array(starts), pa.array(sizes.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            seq, at = seq + n, at + int(sizes.sum())

    # as many files as the input has splits, which follow its bytes; the last key divides rows that are equal otherwise
    ordered = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).withColumn("as_read", F.monotonically_increasing_id())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), FILES_A_SPLIT * ordered.rdd.getNumPartitions())
    keys = ["doc_id", "tie", "as_read"]
    rows = ordered.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(run, struct)
    (
        rows.write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .orc(f"{path}/data")
    )
    # one row for each file, whatever the number of documents
    totals = spark.read.schema(struct).orc(f"{path}/data").groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); bounds on the id prune files, stripes and row groups by their least and largest ids.

    Given ``ids`` only those documents are read: row groups whose Bloom filter knows none of them are skipped. Ids that are not stored give no row.
    """
    rows = spark.read.schema(_SCHEMA).orc(f"{path}/data")
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    if ids is not None:
        rows = rows.where(F.col("doc_id").isin(ids))
    manifest = spark.read.schema("part int, tokens long, documents long, first long").parquet(f"{path}/manifest").select("part", "first")
    # one manifest row for each file of the store: far smaller than any broadcast limit
    return rows.join(F.broadcast(manifest), "part").select(
        "doc_id", (F.col("first") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids"
    )


def stored_digest(docs: DataFrame) -> DataFrame:
    """The report of ``op8``, made from the files as read back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path)
    struct = StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long")
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            values, offsets = np.asarray(ids.values).astype("<u4", copy=False), np.asarray(ids.offsets)
            crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            cols = [b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return read_tokens(spark, path).mapInArrow(run, struct)
