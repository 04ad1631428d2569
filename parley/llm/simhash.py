"""SimHash near-duplicates through tables of distances to pivot fingerprints.

A fingerprint's Hamming distances to fixed fingerprints (pivots) are precomputed: the
zero pivot, and for each of eight 8-bit regions eight pivots with a Walsh pattern of bits
there. A pivot's distance less the zero pivot's is a coordinate that only its region can
change. Two fingerprints at most two bits apart differ in two regions at most, so
they share the coordinates of six: distinct fingerprints are grouped by the
coordinates of each six regions. Inside a group, pairs whose distances to any pivot
differ by more than the limit are discarded, and survivors are verified. A Walsh table can be
inverted, so members of a group differ in two regions' 16 bits only and no group
can exceed 2^16 fingerprints, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parley.llm.common import id_text, map_batches, prepare, without_ids
from parley.llm.components import components
from parley.plans.scratch import save

SEED, SHINGLE, MOST_BITS = 42, 3, 2
_SPACE = b" \t\n\x0b\x0c\r"
_REGIONS = list(combinations(range(8), 6))


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text in UTF-8; 0 without words."""
    words = data.lower().split()  # bytes: exactly A-Z and the six white space characters
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return fingerprint_of(np.array([digest(g, SEED) for g in grams], np.uint64))


def fingerprint_of(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if over half of them have it."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one row per input row; bits as in a signed 64-bit integer."""

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        fps = np.array([fingerprint(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
        return {"doc_id": b.column("doc_id"), "fp": fps.view(np.int64)}

    return map_batches(id_text(docs, id_col, text_col), batch, "doc_id long, fp long")


@cache
def pivots() -> np.ndarray:
    """The zero fingerprint, then eight Walsh patterns in each region from the lowest byte up."""
    walsh = [0xFF, 0x55, 0x33, 0x66, 0x0F, 0x5A, 0x3C, 0x69]
    return np.array([0, *(w << (8 * r) for r in range(8) for w in walsh)], np.uint64)


def distances(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot, as bytes."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)


def _group_keys(fps: np.ndarray) -> np.ndarray:
    """A 64-bit key for each choice of six regions, from their coordinates in the table of distances."""
    table = distances(fps).astype(np.int64)
    coordinates = (table[:, 1:] - table[:, :1]).reshape(-1, 8, 8)
    weights = np.random.default_rng(5).integers(1, 2**63, (8, 8), dtype=np.uint64)
    with np.errstate(over="ignore"):
        region = (coordinates.astype(np.uint64) * weights).sum(2, dtype=np.uint64)
        return np.stack([region[:, list(c)].sum(1, dtype=np.uint64) * np.uint64(28) + np.uint64(k) for k, c in enumerate(_REGIONS)], 1)


def group_links(fps: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one group: fewer links than members."""
    n = len(fps)
    table = distances(fps)
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for k in range(n - 1):
        near = np.flatnonzero(np.abs(table[k + 1 :, 0] - table[k, 0]) <= most_bits) + k + 1
        if len(near):
            near = near[np.abs(table[near] - table[k]).max(1) <= most_bits]
        for j in near[np.bitwise_count(fps[near] ^ fps[k]) <= most_bits].tolist():
            a, b = find(k), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((k, j))
    return out


def links(distinct: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) at most ``most_bits`` (up to 2) apart, enough to connect them."""
    if not 0 <= most_bits <= 2:
        raise ValueError("six of eight regions are shared only up to two bits")
    spark = distinct.sparkSession
    prepare(spark)

    def keyed(b: pa.RecordBatch) -> dict[str, list]:
        fps = np.asarray(b.column("fp")).view(np.uint64)
        keys = _group_keys(fps)
        return {"key": keys.reshape(-1).view(np.int64), "fp": np.repeat(fps.view(np.int64), keys.shape[1])}

    struct = StructType.fromDDL("a long, b long")
    arrow = to_arrow_schema(struct)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a group may span batches."""
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in _and_last(batches):
            if b is not None:
                keys = np.concatenate([keys, np.asarray(b.column("key"))])
                fps = np.concatenate([fps, np.asarray(b.column("fp"))])
            cut = len(keys) if b is None else int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if not cut:  # no rows, or a group that goes on in the next batch
                continue
            done, values = keys[:cut], fps[:cut]
            keys, fps = keys[cut:], fps[cut:]
            out = []
            starts = np.flatnonzero(np.r_[True, done[1:] != done[:-1]])
            for s, e in zip(starts, [*starts[1:], len(done)], strict=True):
                if e - s > 1:
                    group = np.unique(values[s:e])
                    out += [(group[i], group[j]) for i, j in group_links(group.view(np.uint64), most_bits)]
            if out:
                a, b2 = (np.array(x, np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b2)], schema=arrow)

    pairs = map_batches(distinct.select("fp"), keyed, "key long, fp long")
    return pairs.repartition("key").sortWithinPartitions("key").mapInArrow(linked, struct)


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_groups(
    docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Documents whose fingerprints differ in ``most_bits`` bits or fewer are linked; a
    component's id is its smallest document id. Null texts count as empty; texts without words have
    fingerprint 0 and are linked like any other. A null id is carried along, and a
    component of null ids only has a null id. Repeated rows share their component. Texts of any length are hashed whole;
    an empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    found = save(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = save(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(save(links(distinct, most_bits), "links"))
    with_root = save(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "roots")
    least = save(with_root.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    labels = save(with_root.join(least, "root").select("fp", "component_id"), "labels")
    return found.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns kept.

    Rows without an id are kept, as no other row can stand for them.
    """
    groups = near_groups(docs, shingle, most_bits, id_col, text_col)
    return without_ids(docs, groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")), id_col)
