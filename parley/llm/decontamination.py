"""Benchmark decontamination by the q-gram lemma in diagonal bands.

A region of a document that matches an item of n characters within e edits
shares at least n + 1 - q(e + 1) of its q-grams, and all of them lie on
diagonals at most e apart. Shared q-grams are counted in overlapping
bands of diagonals; bands that reach the bound are verified by a banded
alignment. The length of q-grams is chosen for each item so that the bound is at least one:
no item is too short to be found.

Documents are read once for all items together, up to SCAN_CHARS of item text. What a task
holds is bounded: positions are taken in segments, and the q-grams that segment and items share in slices.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import id_text, map_batches, named, prepare

#: Characters of the longest q-grams; edits allowed for each character of an item.
Q, EDIT_RATE = 8, 0.08
#: Characters of item text searched in one pass over the documents; a task indexes them in about 25 bytes each.
SCAN_CHARS = 12_000_000
#: Positions of joined texts in a segment, shared q-grams in a slice, and characters aligned at a time.
SEGMENT, SLICE, ALIGNED = 1 << 18, 1 << 20, 1 << 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_FILTER_BITS = 22
_OUTSIDE = np.uint32(0xFFFFFFFF)
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalise(text: str) -> str:
    """A-Z in lower case, runs of ASCII white space as one space, none at the ends."""
    data = text.encode().lower().translate(_BLANKS).strip(b" ")
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.decode()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def qgram_codes(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q-gram (q a power of two up to 8) at each position: equal q-grams have equal hashes."""
    h, width, k = points.astype(np.uint64) * _MIX[3], 1, 0
    while width < q:
        h = h[: max(0, len(h) - width)] * _MIX[k] + h[width:]
        width, k = width * 2, k + 1
    return h


def needed(length: int) -> tuple[int, int, int]:
    """(edit budget, length of q-grams, q-grams that must be shared) for an item of so many characters."""
    edits = int(length * EDIT_RATE)
    q = Q
    while q * (edits + 1) > length:
        q //= 2
    return edits, q, length + 1 - q * (edits + 1)


def banded_distance(item: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of all of ``item`` inside ``region`` (code points), or None beyond the budget.

    Sellers' alignment over the region's diagonals only, a row for each character of the item;
    ties go to the smaller end.
    """
    edge = np.full(budget, _OUTSIDE)
    r = np.concatenate([edge, region, edge])
    width = len(r) - len(item) + 1
    if width <= 0:
        return None
    cost, origin, steps = np.zeros(width, np.int32), np.arange(width), np.arange(width, dtype=np.int32)
    for k, c in enumerate(item):
        best, start = cost + (r[k : k + width] != c), origin
        up = cost[1:] + 1
        shorter = up < best[:-1]
        if shorter.any():
            start = origin.copy()
            start[:-1][shorter] = origin[1:][shorter]
            best[:-1][shorter] = up[shorter]
        # insertions: the running minimum of best[d] - d
        low = np.minimum.accumulate(best - steps)
        at = np.maximum.accumulate(np.where(best - steps == low, steps, 0))
        cost, origin = low + steps, start[at]
        if cost.min() > budget:
            return None
    d = int(cost.argmin())
    if cost[d] > budget:
        return None
    inside = lambda x: min(max(x - budget, 0), len(region))
    return int(cost[d]), inside(int(origin[d])), inside(d + len(item))


class _QGrams:
    """The q-grams of items with one q, sorted, with where each occurs."""

    def __init__(self, q: int, owners: list[int], points: list[np.ndarray]) -> None:
        self.q = q
        codes = [qgram_codes(p, q) for p in points]
        every = np.concatenate(codes)
        owner = np.repeat(np.array(owners, np.int32), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes])
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, self.first, self.counts = np.unique(every[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * _MIX[0]) >> np.uint64(64 - _FILTER_BITS)

    def shared(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, item, place in the item) of each q-gram shared, in slices of bounded size."""
        codes = qgram_codes(points, self.q)
        at = np.flatnonzero(self.filter[self._slot(codes)])
        found = np.searchsorted(self.codes, codes[at])
        found[found == len(self.codes)] = 0
        real = self.codes[found] == codes[at]
        at, found = at[real], found[real]
        n = self.counts[found]
        upto = np.cumsum(n)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, "right")))
            m = n[lo:hi]
            entry = np.repeat(self.first[found[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            yield np.repeat(at[lo:hi], m), self.owner[entry], self.place[entry]
            lo = hi


class Items:
    """Items to search for, indexed by their q-grams."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        self.texts = [t for _, t in items]
        self.points = [code_points(t) for t in self.texts]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.edits, self.q, self.least = (np.array(x, np.int64) for x in zip(*(needed(n) for n in self.lengths.tolist()), strict=True))
        self.width = np.maximum(self.edits, 1)
        self.classes = []
        for q in sorted(set(self.q.tolist())):
            own = np.flatnonzero(self.q == q).tolist()
            self.classes.append(_QGrams(q, own, [self.points[k] for k in own]))
        self.reach = int((2 * self.width + self.lengths).max())

    def _windows(self, points: np.ndarray, first: int, low: int, high: int, starts: np.ndarray, grams: _QGrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first diagonal) of the bands that begin in [low, high) and share enough q-grams.

        ``points`` are those from position ``first`` on. Diagonals count from ``reach`` before the first position.
        """
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        items, spans = len(self.texts), (high - low + 2 * self.reach) // int(self.width.min()) + 8
        # a key is (text, item, band), bands counted from just before the first that these points can touch
        base = np.arange(items) * spans - (low - self.reach) // self.width + 2
        one = int(np.searchsorted(starts, first, "right")) - 1
        alone = one == int(np.searchsorted(starts, first + len(points), "right")) - 1
        for at, item, place in grams.shared(points):
            text = one if alone else np.searchsorted(starts, at + first, "right") - 1
            band = (at + (first + self.reach) - place) // self.width[item]
            key = base[item] + text * (items * spans)
            for half in (0, 1):  # bands of twice the width, each overlapping the next by half
                sums.append(_tally(key + ((band + half >> 1 << 1) - half)))
        if not sums:
            none = np.empty(0, np.int64)
            return none, none, none
        key, back = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
        count = np.bincount(back, np.concatenate([s[1] for s in sums]), len(key))
        key = key[count >= self.least[key // spans % items]]
        item = key // spans % items
        diagonal = (key - key // (items * spans) * (items * spans) - base[item]) * self.width[item]
        own = (diagonal >= low) & (diagonal < high)
        return key[own] // (items * spans), item[own], diagonal[own]

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end): the best match of each item in each text, within its budget; of equals the first to end."""
        joined = ("\0" * Q).join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes + Q) - sizes - Q
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        step = max(SEGMENT, self.reach)
        for low in range(0, len(joined) + self.reach, step):
            high = low + step
            first = max(0, low - self.reach)
            points = code_points(joined[first:high])
            for grams in self.classes:
                text, item, diagonal = self._windows(points, first, low, high, starts, grams)
                a = diagonal - self.reach - starts[text] - self.edits[item]
                z = a + 2 * self.width[item] + self.lengths[item] + 2 * self.edits[item]
                for t, i, x, y in _merged(text, item, np.maximum(a, 0), np.minimum(z, sizes[text])):
                    self._verify(texts[t], t, i, x, y, best)
        return [(t, i, edits, start, end) for (t, i), (edits, end, start) in sorted(best.items())]

    def _verify(self, text: str, t: int, i: int, a: int, z: int, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Put the best match in text[a:z] into ``best`` as (edits, end, start), if it is better than what is there."""
        n, budget = len(self.texts[i]), int(self.edits[i])
        known = best.get((t, i))
        if known and not known[0]:
            return
        exact = text.find(self.texts[i], a, z)
        if not budget:  # so short that it counts as whole words only
            while exact >= 0 and not _whole(text, exact, exact + n):
                exact = text.find(self.texts[i], exact + 1, z)
        if exact >= 0:
            best[t, i] = (0, exact + n, exact)
        elif budget:
            for x in range(a, z, ALIGNED):  # parts overlap by the longest match
                if got := banded_distance(self.points[i], code_points(text[x : min(z, x + ALIGNED + n + budget)]), budget):
                    new = (got[0], got[2] + x, got[1] + x)
                    best[t, i] = min(best.get((t, i), new), new)


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs."""
    if not len(keys) or int(keys.max()) - int(keys.min()) > 4 * len(keys):
        return np.unique(keys, return_counts=True)
    least = keys.min()
    counts = np.bincount(keys - least)
    full = np.flatnonzero(counts)
    return full + least, counts[full]


def _whole(text: str, a: int, z: int) -> bool:
    joins = lambda x, y: x.isalnum() and y.isalnum()
    return not (a and joins(text[a - 1], text[a])) and not (z < len(text) and joins(text[z - 1], text[z]))


def _merged(text: np.ndarray, item: np.ndarray, a: np.ndarray, z: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Windows of a pair that overlap as one, in ascending order."""
    now: tuple[int, int, int, int] | None = None
    order = np.lexsort((a, item, text))
    for t, i, x, y in zip(*(c[order].tolist() for c in (text, item, a, z)), strict=True):
        if now and now[:2] == (t, i) and x <= now[3]:
            now = (t, i, now[2], max(now[3], y))
        else:
            if now:
                yield now
            now = (t, i, x, y)
    if now:
        yield now


def item_scans(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items as lists of SCAN_CHARS characters; the driver holds one list at a time."""
    held, chars = [], 0
    known = benchmark.select(named(id_col).cast("long"), named(text_col)).where(named(text_col).isNotNull() & named(id_col).isNotNull())
    for item, text in known.toLocalIterator():
        text = normalise(text)
        if not text:
            continue
        if held and chars + len(text) > SCAN_CHARS:
            yield held
            held, chars = [], 0
        held.append((item, text))
        chars += len(text)
    if held:
        yield held


_INDEXED: dict[str, Items] = {}


class _Shared:
    """Items of one scan, broadcast as text (bounded by SCAN_CHARS) and indexed once in each worker process."""

    def __init__(self, docs: DataFrame, items: list[tuple[int, str]]) -> None:
        self.name, self.items = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)

    def get(self) -> Items:
        if self.name not in _INDEXED:
            _INDEXED.clear()  # one index in a worker at a time
            _INDEXED[self.name] = Items(self.items.value)
        return _INDEXED[self.name]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, end): documents that hold an item, with where, in characters of the normalised text.

    One row for each document row and item found in it: its match with the fewest edits, of equals the first to end. Items under
    13 characters have no edits to spare and must stand as whole words. Null or empty texts hold
    nothing; null and empty items, and items without an id, are no evidence; repeated rows and repeated items are each
    reported; a null document id is reported as null. Texts of any length are searched whole, in bounded memory. Empty
    tables give no rows. Other columns, whatever their names, are not read.
    """
    schema = "doc_id long, item_id long, edits int, start long, end long"
    rows = id_text(docs, id_col, text_col)
    out = None
    for items in item_scans(benchmark):
        shared = _Shared(docs, items)

        def batch(b: pa.RecordBatch, shared: _Shared = shared) -> dict[str, list]:
            index = shared.get()
            found = index.matches([normalise(t) for t in b.column("text").to_pylist()])
            ids = b.column("doc_id").to_pylist()
            return {
                "doc_id": [ids[f[0]] for f in found],
                "item_id": [int(index.ids[f[1]]) for f in found],
                **{name: [f[k] for f in found] for k, name in enumerate(("edits", "start", "end"), 2)},
            }

        part = map_batches(rows, batch, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without rows whose text holds an item, as ``contaminated`` defines it; all columns are kept and nothing is shuffled.

    Null and empty texts stay; of repeated rows all stay or all go; an empty benchmark drops nothing.
    """
    prepare(docs.sparkSession)
    for items in item_scans(benchmark):
        docs = docs.where(~_holds(_Shared(docs, items))(F.coalesce(named(text_col), F.lit(""))))
    return docs


def _holds(shared: _Shared):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        found = {f[0] for f in shared.get().matches([normalise(t) for t in texts.to_pylist()])}
        return pa.array([k in found for k in range(len(texts))], pa.bool_())

    return holds
