"""Exact deduplication by content-defined chunk recipes.

Each text is normalised and cut where a rolling hash of its content says so.
A chunk is named by two independent digests and its length. The table of
chunks keeps each name once and verifies that a 128-bit identifier stands for one name; a
document is then only its ordered list of identifiers, and texts are equal when their lists
are. The texts themselves are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import ascii_lower, id_text, map_batches, named, without_rows
from parley.plans.scratch import save

#: Bytes: no cut before MIN_CHUNK, one is forced at MAX_CHUNK, about MEAN_CHUNK apart between.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 2048, 8192, 65536
#: Bytes of a chunk's identifier.
ID_BYTES = 16
_SPAN = 32


@cache
def _gear() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; they depend on content only. Empty data has none."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _gear()[np.frombuffer(data, np.uint8)]
    width = 1
    while width < _SPAN:  # h[i] becomes the sum of gear(byte i-j) << j over the last 32 bytes
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    marks = np.flatnonzero(h % np.uint32(MEAN_CHUNK) == 0) + 1
    ends, start, k = [], 0, 0
    while n - start > MIN_CHUNK:
        k = int(np.searchsorted(marks, start + MIN_CHUNK))
        end = min(int(marks[k]) if k < len(marks) else n, start + MAX_CHUNK, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_names(data: bytes) -> list[bytes]:
    names, start = [], 0
    for end in cut_points(data):
        chunk = data[start:end]
        names.append(hashlib.sha256(chunk).digest() + hashlib.blake2b(chunk, digest_size=8).digest() + len(chunk).to_bytes(4, "big"))
        start = end
    return names


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, recipe array<binary>): the normalised text's digest and its ordered chunk names."""

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        sha, lists = [], []
        for text in b.column("text").cast(pa.binary()).to_pylist():
            data = text.lower()  # bytes: A-Z only
            sha.append(hashlib.sha256(data).hexdigest())
            lists.append(chunk_names(data))
        return {"doc_id": b.column("doc_id"), "text_sha256": sha, "recipe": lists}

    return map_batches(id_text(docs, id_col, text_col), batch, "doc_id long, text_sha256 string, recipe array<binary>")


def chunk_table(found: DataFrame) -> DataFrame:
    """(chunk, uses, id, verified): each chunk once, and its identifier, ID_BYTES of its name.

    ``verified`` is false where an identifier stands for two names.
    """
    each = found.select(F.explode("recipe").alias("chunk")).groupBy("chunk").agg(F.count("*").alias("uses"))
    by_id = each.groupBy(identifier(F.col("chunk")).alias("id")).agg(F.collect_list(F.struct("chunk", "uses")).alias("same"), (F.count("*") == 1).alias("verified"))
    return by_id.select(F.explode("same").alias("s"), "id", "verified").select("s.chunk", "s.uses", "id", "verified")


def identifier(chunk: Column) -> Column:
    return F.substring(chunk, 1, ID_BYTES)


def with_identifiers(found: DataFrame) -> DataFrame:
    """``found`` with ``ids``, the ordered identifiers of each recipe's chunks.

    Names are gathered in the table of chunks, which verifies identifiers: one that stands for two names is
    not used, and those chunks go by their whole names. Of 10^10 chunks, any two share one with a probability of 10^-19.
    """
    chunks = found.select(F.explode("recipe").alias("chunk")).distinct()
    shared = chunks.groupBy(identifier(F.col("chunk")).alias("id")).agg(F.count("*").alias("names")).where("names > 1")
    # one row: the identifiers that are not unique, as good as always none
    bad = shared.agg(F.collect_list("id").alias("bad"))
    ids = F.transform("recipe", lambda c: F.when(F.array_contains("bad", identifier(c)), c).otherwise(identifier(c)))
    return found.crossJoin(F.broadcast(bad)).withColumn("ids", ids).drop("bad")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts are equal to one another. Of equal
    texts the row with the largest id stays; if rows repeat an id, all rows with that id
    are marked kept. A null id is smaller than any other: it stays only where its
    group has no other id (keep_id is then null). Texts of any length are cut whole; an empty table gives an empty
    result. Other columns, whatever their names, are not read.
    """
    found = save(recipes(docs, id_col, text_col), "recipes")
    each = save(with_identifiers(found).select("doc_id", "text_sha256", "ids"), "identifier-lists")
    keep = save(each.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "keepers")
    return each.join(keep, "ids").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows whose text equals that of a row with a larger id; all columns kept.

    Rows without an id are kept, and so are equal rows that repeat the id of the row that stays. Of rows that share an id,
    only those whose text has a copy with a larger id go.
    """
    groups = exact_groups(docs, id_col, text_col)
    gone = groups.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("gone"), F.col("text_sha256").alias("gone_key"))
    return without_rows(docs, gone, id_col, F.sha2(ascii_lower(F.coalesce(named(text_col), F.lit(""))).cast("binary"), 256))
