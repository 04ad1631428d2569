"""Near copies by the exact Jaccard similarity of five-word shingles: the pipeline's use of operator 3.

A text is its set of shingle hashes, known by a 128-bit hash of the set: texts with equal sets
share a name and are near copies of one another. Pairs of names are proposed and each is verified on the sets themselves:

1. by operator 3: SimHash fingerprints of the sets, at most two bits apart by its tables of pivot distances. Two bits
   alone find few of the pairs at a similarity of 0.8, so that
2. MinHash bands propose more. Every name meets the least name of each of its bands, so a
   dense group is connected by about as many pairs as it has members.
3. Names of bands that are still in different components meet by operator 11's matrix of tokens and groups: packed by 64, so that
   the many fillings of one template, which share bands but stay under the threshold, are neither listed nor compared pair by pair.

Only the texts of names in proposed pairs are read again for their sets.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import jaccard_join, simhash
from parley.llm.common import id_text, map_batches, named, without_rows
from parley.llm.components import components
from parley.llm.jaccard_join import lists, set_name, shingle_set
from parley.plans.scratch import save

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: A pair at the similarity 0.8 shares one band at least with probability 1 - (1 - 0.8^6)^32 = 0.99994.
BANDS, BAND_ROWS = 32, 6
_SLICE = 1 << 12


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    n = BANDS * BAND_ROWS
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def band_keys(grams: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: a hash of the band's number and its least permuted shingles."""
    a, b = _multipliers()
    least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(grams), _SLICE):
        x = grams[k : k + _SLICE, None] * a
        x += b
        x >>= np.uint64(32)
        np.minimum(least, x.min(0).astype(np.uint32), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def names(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, n1, n2, size, fp, bands), one row per input row: ``place`` is a hash of the text as it is, n1 and n2 are the set's hash; an empty set has no bands."""

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        sets = _shingle_sets(b, shingle)
        n1, n2 = _set_names(sets)
        return {
            "doc_id": b.column("doc_id"), "place": b.column("place"), "n1": n1, "n2": n2, "size": [len(s) for s in sets],
            "fp": np.array([simhash.fingerprint_of(s) for s in sets], np.uint64).view(np.int64),
            "bands": [band_keys(s).view(np.int64) if len(s) else [] for s in sets],
        }

    rows = id_text(docs, id_col, text_col).withColumn("place", F.xxhash64("text"))
    return map_batches(rows, batch, "doc_id long, place long, n1 long, n2 long, size int, fp long, bands array<long>")


def _shingle_sets(b: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    return [shingle_set(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]


def _set_names(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    found = [set_name(s) for s in sets]
    return [n[0] for n in found], [n[1] for n in found]


def _sets(docs: DataFrame, places: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """(name, grams array<long>) of the sets of the texts at ``places`` (place, name, n1, n2)."""

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        sets = _shingle_sets(b, shingle)
        n1, n2 = _set_names(sets)
        return {"n1": n1, "n2": n2, "grams": lists(sets)}

    texts = docs.select(F.coalesce(named(text_col), F.lit("")).alias("text")).withColumn("place", F.xxhash64("text"))
    found = map_batches(texts.join(places.select("place").distinct(), "place", "left_semi").select("text"), batch, "n1 long, n2 long, grams array<long>")
    return found.join(places.select("name", "n1", "n2"), ["n1", "n2"]).select("name", "grams").dropDuplicates(["name"])


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (name, grams) are similar enough."""

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        x, y = ([b.column(c)[k].values.to_numpy().view(np.uint64) for k in range(b.num_rows)] for c in ("x", "y"))
        keep = pa.array([jaccard(p, q) >= similarity for p, q in zip(x, y, strict=True)], pa.bool_())
        return {"a": b.column("a").filter(keep), "b": b.column("b").filter(keep)}

    left = sets.select(F.col("name").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("name").alias("b"), F.col("grams").alias("y"))
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), batch, "a long, b long")


def _fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b): names whose fingerprints are within operator 3's two bits, enough to connect them: each with the least of its fingerprint, and those of linked fingerprints."""
    least = save(distinct.groupBy("fp").agg(F.min("name").alias("a"), F.max("name").alias("last")), "near-fingerprints")
    same = distinct.join(least.where("a < last"), "fp").where("name <> a").select("a", F.col("name").alias("b"))
    links = save(simhash.links(least.select("fp")), "near-fingerprint-links").withColumnsRenamed({"a": "x", "b": "y"})
    ends = [least.select(F.col("fp").alias(x), F.col("a").alias(name)) for x, name in (("x", "a"), ("y", "b"))]
    return same.unionAll(links.join(ends[0], "x").join(ends[1], "y").select("a", "b"))


def _connect_open(sets: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """(node, root) with all links among ``sets`` (name, grams) beside those known."""
    rows = save(sets.select(F.col("name").alias("node"), "grams"), "near-open")
    tokens = rows.select("node", F.size("grams").alias("size"), F.col("grams").alias("ranked"), F.array().cast("array<bigint>").alias("rest"))
    keys = jaccard_join.prefix_keys(tokens, percent)
    wanted = rows.join(keys.select("node").distinct(), "node", "left_semi")
    return jaccard_join.connected(keys, jaccard_join.least_hashes(wanted), percent, linked)


def near_groups(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, place, component_id), one row per input row.

    Texts whose shingle sets have a Jaccard similarity of ``similarity`` or more are linked; a component's id is its
    smallest document id. Null texts count as empty; texts without words are equal to one another. A null id is carried along; repeated rows
    share their component. Texts of any length count whole; an empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    found = save(names(docs, shingle, id_col, text_col), "near-names")
    distinct = save(found.select("n1", "n2", "fp", "bands").dropDuplicates(["n1", "n2"]).withColumn("name", F.monotonically_increasing_id()), "near-distinct")
    found = save(found.drop("fp", "bands").join(distinct.select("n1", "n2", "name"), ["n1", "n2"]), "near-named")
    bands = distinct.select("name", F.explode("bands").alias("band"))
    stars = save(bands.groupBy("band").agg(F.min("name").alias("star"), F.max("name").alias("last")).where("star < last").select("band", "star"), "near-stars")
    members = save(bands.join(stars, "band").distinct(), "near-members")
    banded = members.where("name <> star").select(F.col("star").alias("a"), F.col("name").alias("b"))
    pairs = save(_fingerprint_pairs(distinct.select("name", "fp")).unionAll(banded).distinct(), "near-pairs")
    wanted = pairs.select(F.col("a").alias("name")).unionAll(pairs.select("b")).distinct()
    places = save(found.join(wanted, "name", "left_semi").groupBy("name", "n1", "n2").agg(F.min("place").alias("place")), "near-places")
    sets = save(_sets(docs, places, shingle, text_col), "near-sets")
    linked = save(alike(pairs, sets, similarity), "near-links")
    roots = save(components(linked), "near-roots")
    of_name = roots.select(F.col("node").alias("name"), "root")
    rooted = members.join(of_name, "name", "left").select("band", "name", F.coalesce("root", "name").alias("root"))
    left = save(rooted, "near-rooted")
    split = left.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("band")
    unsettled = save(left.join(split, "band", "left_semi").select("name").distinct(), "near-unsettled")
    if not unsettled.isEmpty():
        roots = _connect_open(sets.join(unsettled, "name", "left_semi"), linked, round(100 * similarity))
    firsts = found.groupBy("name").agg(F.min("doc_id").alias("first_id"))
    with_root = save(firsts.join(roots, F.col("name") == F.col("node"), "left").select("name", "first_id", F.coalesce("root", "name").alias("root")), "near-roots")
    least = save(with_root.groupBy("root").agg(F.min("first_id").alias("component_id")), "near-ids")
    labels = save(with_root.join(least, "root").select("name", "component_id"), "near-labels")
    return found.select("doc_id", "place", "name").join(labels, "name").select("doc_id", "place", "component_id")


def drop_near_copies(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns kept.

    Rows without an id are kept, as no other row can stand for them. Of rows that share an id, only those whose text is a copy go.
    """
    groups = near_groups(docs, shingle, similarity, id_col, text_col)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"), F.col("place").alias("gone_key"))
    return without_rows(docs, gone, id_col, F.xxhash64(F.coalesce(named(text_col), F.lit(""))))
