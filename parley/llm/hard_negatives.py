"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

Vectors are whole numbers and scores are inner products. With one more component, sqrt(M - |x|^2), all rows are
as long as the longest, sqrt(M). Anchors, stretched to the same length, then have their largest product where the distance is least, so that
both can be assigned to the cells of pivots. Rows of a cell are packed into blocks and anchors of neighbouring cells into groups. A group searches for the
best rows of each of its anchors' targets (a label rule and a range of scores):

1. in a block of each of its own cells, which gives every target the score of its k-th best so far;
2. in each other block that a bound from the distances to pivots does not exclude: the triangle inequality gives the
   greatest score that a row of the block can have with an anchor of the group.

Both are exact joins of one group and one block in a task, and only the best k of each target leave it. Anchors are a stated
query set (ids divisible by 50) and the smaller side: their groups are broadcast while they are at most ``BROADCAST_ANCHORS``, so
that blocks stay where they are; beyond, blocks are sent to the groups they might serve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import map_batches
from parley.llm.vectors import MOST, integer_rows, matrix
from parley.plans.scratch import save

SCALE, ANCHOR_EVERY, MOVED_EVERY, LABELS, POSITIVES, NEGATIVES = 256, 50, 7, 10, 5, 3
#: Percent of a positive's score that a negative's lies between.
LOW, HIGH = 50, 95
#: Rows of a block, anchors of a group (about), and pivots at most.
BLOCK, GROUP, PIVOTS = 4096, 2048, 512
#: Groups of so many anchors in all are broadcast: 100 MB at 64 components.
BROADCAST_ANCHORS = 200_000
_OPEN = 1 << 62
#: Anchors of a group that are compared at a time.
_SLAB = 256


def _augment(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1, keepdims=True), 0.0))], 1)


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0.0))


def _pivots(rows: DataFrame, n: int, longest: float) -> np.ndarray:
    """Different rows, spread by a hash of their ids: one for each block's worth of rows, ``PIVOTS`` at most."""
    wanted = int(min(PIVOTS, max(1, n // BLOCK)))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "v").limit(4 * wanted).select("v").collect()
    return _augment(np.unique(np.array([r.v for r in drawn], np.float64), axis=0)[:: max(1, len({tuple(r.v) for r in drawn}) // wanted)][:wanted], longest)


def _cells(rows: DataFrame, pivots: np.ndarray, longest: float, anchor_every: int) -> DataFrame:
    """Rows with their cell and distance to its pivot, and those of the row as an anchor (null for other rows)."""
    width = pivots.shape[1] - 1

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        x = matrix(b.column("v"), width)
        gaps = _gaps(_augment(x, longest), pivots)
        cell = gaps.argmin(1)
        anchor = b.column("vec_id").to_numpy() % anchor_every == 0
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        own = _gaps(np.concatenate([x * (np.sqrt(longest) / np.maximum(norm, 1)), np.zeros((len(x), 1))], 1), pivots)
        home = own.argmin(1)
        at = np.arange(len(x))
        return {c: b.column(c) for c in ("vec_id", "label", "v")} | {
            "cell": cell, "gap": gaps[at, cell], "home": pa.array(home, pa.int32(), mask=~anchor), "reach": pa.array(own[at, home], pa.float64(), mask=~anchor),
        }

    return save(map_batches(rows, batch, "vec_id long, label long, v array<int>, cell int, gap double, home int, reach double"), "cells")


def _chain(pivots: np.ndarray) -> list[int]:
    """Pivots in an order in which each is followed by its nearest one left."""
    gaps, at, order = _gaps(pivots, pivots), 0, [0]
    left = set(range(1, len(pivots)))
    while left:
        at = min(left, key=lambda k: gaps[at, k])
        left.remove(at)
        order.append(at)
    return order


def _split(counts: dict[int, int], most: int) -> dict[int, int]:
    """In how many parts each cell is dealt, by a hash of the id."""
    return {c: -(-n // most) for c, n in counts.items()}


def _lookup(table: dict[int, int], column: str) -> Column:
    """A value for each cell (``PIVOTS`` entries at most)."""
    return F.create_map(*(F.lit(x) for item in table.items() for x in item))[F.col(column)]


class Index:
    """Blocks of rows and groups of anchors, ready for searches."""

    def __init__(self, rows: DataFrame, anchor_every: int) -> None:
        self.spark = rows.sparkSession
        n, longest = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x))).first()
        self.longest = float(max(longest, 1))  # squared
        self.pivots = _pivots(rows, n, self.longest)
        cells = _cells(rows, self.pivots, self.longest, anchor_every)
        sizes = {r.cell: r.n for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
        part = F.pmod(F.xxhash64("vec_id"), _lookup(_split(sizes, BLOCK), "cell")).cast("int")
        each = F.struct("vec_id", "label", "v")
        packed = cells.withColumn("part", part).groupBy("cell", "part").agg(F.sort_array(F.collect_set(each)).alias("rows"), F.min("gap").alias("lo"), F.max("gap").alias("hi"))
        self.blocks = save(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")
        anchors = cells.where(F.col("home").isNotNull()).dropDuplicates(["vec_id", "label", "v"])
        self.anchors = save(anchors.withColumn("g", self._group(anchors)).withColumn("akey", F.monotonically_increasing_id()).select("akey", "g", "vec_id", "label", "v", "home", "reach"), "anchors")
        self.broadcast = self.anchors.count() <= BROADCAST_ANCHORS

    def _group(self, anchors: DataFrame) -> Column:
        """Cells along the chain of pivots make up a group; a cell with more anchors than a group is dealt to several by a hash of the id."""
        counts = {r.home: r.n for r in anchors.groupBy("home").agg(F.count("*").alias("n")).collect()}
        first, parts, at, room = {}, _split(counts, GROUP), -1, 0
        for c in (c for c in _chain(self.pivots) if c in counts):
            if parts[c] > 1 or counts[c] > room:
                at, room = at + 1, GROUP
            first[c] = at
            at, room = at + parts[c] - 1, room - counts[c] if parts[c] == 1 else 0
        if not first:
            return F.lit(0).cast("long")
        return _lookup(first, "home") + F.pmod(F.xxhash64("vec_id"), _lookup(parts, "home"))

    def search(self, targets: DataFrame, k: int, same: bool) -> DataFrame:
        """(akey, target, vec_id, score, place): the first ``k`` rows for each target (akey, target, lo, hi long).

        They have the anchor's label (``same``) or another, another id than the anchor, and a score from lo to hi; higher scores come first, equal ones by id.
        """
        targets = save(targets, "targets")
        home = self._groups(targets)
        own = self._reach(home).where((F.col("i") == F.col("cell")) & (F.col("part") == 0)).select("g", "block").distinct()
        own = save(own, "home-pairs")
        found = save(self._best(self._join(own, home, k, same), k), "home-found")
        kth = found.where(F.col("place") == k).select("akey", "target", F.col("score").alias("kth"))
        groups = self._groups(targets.join(kth, ["akey", "target"], "left").select("akey", "target", F.greatest("lo", "kth").alias("lo"), "hi"))
        rest = self._reach(groups).where(F.col("most") >= F.col("floor")).select("g", "block").distinct().join(own, ["g", "block"], "left_anti")
        more = save(self._join(save(rest, "pairs"), groups, k, same), "found")
        return self._best(found.drop("place").unionByName(more), k)

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("akey", "target").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def _groups(self, targets: DataFrame) -> DataFrame:
        """Anchors with targets, packed by group: a row for each, with what its bounds need."""
        wanted = targets.groupBy("akey").agg(F.collect_list(F.struct("target", "lo", "hi")).alias("targets"), F.min("lo").alias("floor"))
        rows = self.anchors.join(wanted, "akey")
        norm = F.sqrt(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x))
        cells = rows.groupBy("g", "home").agg(F.collect_list(F.struct("akey", "vec_id", "label", "v", "targets")).alias("members"), F.max("reach").alias("reach"), F.max(norm).alias("top"), F.min(norm).alias("bottom"), F.min("floor").alias("floor"))
        packed = cells.groupBy("g").agg(F.flatten(F.collect_list("members")).alias("members"), F.collect_list(F.struct("home", "reach")).alias("homes"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.min("floor").alias("floor"))
        return save(packed, "anchor-groups")

    def _reach(self, groups: DataFrame) -> DataFrame:
        """(g, block, i, cell, part, most, floor): for each cell i of a group and each block, the greatest score that the pivots' distances allow."""
        p = len(self.pivots)
        gaps = _gaps(self.pivots, self.pivots)
        table = self.spark.createDataFrame([(i, j, float(gaps[i, j])) for i in range(p) for j in range(p)], "i int, cell int, between double")
        homes = groups.select("g", "top", "bottom", "floor", F.explode("homes").alias("h")).select("g", "top", "bottom", "floor", F.col("h.home").alias("i"), F.col("h.reach").alias("reach"))
        # distance of an anchor and a row at least; less a little for the rounding of square roots
        away = F.greatest(F.lit(0.0), F.col("between") - F.col("reach") - F.col("hi"), F.col("lo") - F.col("between") - F.col("reach")) * (1 - 1e-9)
        bounds = self.blocks.select("block", "cell", "part", "lo", "hi")
        found = homes.join(F.broadcast(table), "i").join(bounds, "cell")
        # a product is the anchor's norm times the row's length along it
        along = (2 * self.longest - away * away) / (2 * self.longest**0.5) + 1e-6 * self.longest**0.5
        return found.select("g", "block", "i", "cell", "part", "floor", F.greatest(along * F.col("top"), along * F.col("bottom")).alias("most"))

    def _join(self, pairs: DataFrame, groups: DataFrame, k: int, same: bool) -> DataFrame:
        """(akey, target, vec_id, score): the best of each pair of a group and a block."""
        width = self.pivots.shape[1] - 1
        groups = groups.select("g", "members")
        if self.broadcast:
            groups = F.broadcast(groups)
        joined = self.blocks.select("block", "rows").join(pairs, "block").join(groups, "g").select("rows", "members")

        def batch(b: pa.RecordBatch) -> dict[str, list]:
            out = [_pair(b.column("members")[k0].values, b.column("rows")[k0].values, width, k, same) for k0 in range(b.num_rows)]
            return dict(zip(("akey", "target", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True))

        return map_batches(joined, batch, "akey long, target long, vec_id long, score long")


def _pair(members: pa.StructArray, rows: pa.StructArray, width: int, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """The best ``k`` rows of a block for each target of a group's anchors."""
    akey, aid, alabel = (members.field(c).to_numpy() for c in ("akey", "vec_id", "label"))
    bid, blabel = (rows.field(c).to_numpy() for c in ("vec_id", "label"))
    a, x = (matrix(s.field("v"), width) for s in (members, rows))
    # by Cauchy and Schwarz no partial sum is larger, so that whole numbers stay exact in the type chosen
    largest = np.sqrt((a * a).sum(1).max() * (x * x).sum(1).max())
    kind = np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else np.int64
    a, x = a.astype(kind), x.astype(kind)
    lists = members.field("targets")
    of = np.repeat(np.arange(len(members)), np.diff(lists.offsets.to_numpy()))
    target, lo, hi = (lists.flatten().field(c).to_numpy() for c in ("target", "lo", "hi"))
    out = []
    for s in range(0, len(a), _SLAB):
        score = a[s : s + _SLAB] @ x.T
        label = alabel[s : s + _SLAB, None] == blabel[None, :]
        fits = (label if same else ~label) & (aid[s : s + _SLAB, None] != bid[None, :])
        mine = np.flatnonzero((of >= s) & (of < s + _SLAB))
        floor = np.full(len(score), np.inf)
        np.minimum.at(floor, of[mine] - s, lo[mine])
        fits &= score >= floor[:, None]
        i, j = np.nonzero(fits)
        v = score[i, j].astype(np.int64)
        order = np.lexsort((bid[j], -v, i))
        i, j, v = i[order], j[order], v[order]
        starts, ends = np.searchsorted(i, np.arange(len(score))), np.searchsorted(i, np.arange(len(score)), "right")
        for t in mine.tolist():
            b, e = starts[of[t] - s], ends[of[t] - s]
            down = -v[b:e]  # ascending
            first, last = np.searchsorted(down, -hi[t]), np.searchsorted(down, -lo[t], "right")
            take = slice(b + first, b + min(last, first + k))
            n = max(0, take.stop - take.start)
            if n:
                out.append((np.full(n, akey[of[t]]), np.full(n, target[t]), bid[j[take]], v[take]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4


def hard_negatives(
    rows: DataFrame, scale: int = SCALE, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, moved_every: int = MOVED_EVERY, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hardest rows of other labels for each anchor and positive.

    Anchors are the rows whose id is divisible by ``anchor_every``, their positives the first ``positives`` other rows of their label, and
    negatives the first ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive. Scores are inner products of
    floor(scale * x), higher first, ties by smaller id. Labels of ids divisible by ``moved_every`` become (label + 1) mod 10. Rows
    with a null id, label or vector, an empty vector or a null or non-finite component take no part, and vectors of another length than that of the
    row with the smallest id neither. Repeated rows count once; rows that share an id but differ are rows of their own, and none of them
    is a positive or negative of the others. Anchors without positives, and positives without negatives, give no rows; an empty table gives none.
    Other columns, whatever their names, are not read.
    """
    clean = integer_rows(rows, scale, id_col, label_col, vector_col).where("vec_id IS NOT NULL AND label IS NOT NULL")
    label = F.col("label").cast("long")
    clean = clean.withColumn("label", F.when(F.col("vec_id") % moved_every == 0, (label + 1) % LABELS).otherwise(label))
    first = clean.orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    clean = save(clean.where(F.size("v") == first.n), "vectors")
    if first.n * MOST**2 >= 1 << 63:
        raise ValueError("inner products of vectors this long may exceed 64 bits")
    index = Index(clean, anchor_every)
    whole = index.anchors.select("akey", F.lit(0).cast("long").alias("target"), F.lit(-_OPEN).alias("lo"), F.lit(_OPEN).alias("hi"))
    found = save(index.search(whole, positives, True).select("akey", F.col("place").cast("long").alias("target"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    lo, hi = F.ceil(p * low / F.lit(100).cast("decimal(20,0)")).cast("long"), F.floor(p * high / F.lit(100).cast("decimal(20,0)")).cast("long")
    ranges = found.select("akey", "target", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    worst = save(index.search(ranges, negatives, False), "negatives")
    out = worst.select("akey", "target", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(found, ["akey", "target"]).join(index.anchors.select("akey", F.col("vec_id").alias("anchor_id")), "akey")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
