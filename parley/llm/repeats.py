"""Removal of repeated 100-byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only as far as the threshold, by most-significant-digit passes over groups
that get smaller; what is alone in its group after a digit leaves the sort. A group
that is equal to the end, and verified on its bytes, is exactly a repeated window. Three distributed passes:

1. the first digit of a window is its anchor: of the 37-byte strings in it, the one with the least hash.
   Consecutive windows with one anchor form a unit, so this digit is sorted once for about 30 suffixes.
   Blocks of documents send their distinct anchors; what is alone in the corpus leaves.
2. the units of anchors left travel with their bytes. Units, then windows of units that differ, are sorted by
   successive ranges of bytes. A unit is answered by a mask: one bit for each window that also starts earlier.
3. an anchor with more than HOT_UNITS units, such as the edge of a line that many documents share, would fill one group.
   Its windows go on by a further digit of their own, 128 bits of content, so that no group is larger than the blocks that hold one window.

A block sends what is first in it, so that a string repeated everywhere arrives once for each block.
Blocks are written once, bucketed by the task that made them, and joined with
the answers without moving the texts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parley.llm.common import SPREAD, blocks_by_part, by_bucket, id_text, part_of, prepare, with_answers
from parley.plans.scratch import save

LENGTH, ANCHOR = 100, 37
#: Documents in a block at most (bytes are bounded too), units for each bucket on average, and units of one anchor sorted in one group.
BLOCK_ROWS, BUCKET_ENTRIES, HOT_UNITS = 1024, 100_000, 1000
#: Window starts hashed at a time, and units sorted at a time.
SEGMENT, SORTED = 1 << 21, 1 << 14
_SIDE = LENGTH - ANCHOR  # bytes of a unit on either side of its anchor, at most
_WIDTH = 168  # a unit's bytes with its anchor at a fixed place, in whole words
_NO_ID = -(2**63)
_ODD = np.random.default_rng(17).integers(0, 2**63, (2, 32), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a place in a key that orders anchors.
_PLACE_BITS = 36


def _mixed(words: np.ndarray) -> np.ndarray:
    out = words * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out


def _all_words(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, mixed one to one."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    for k in range(min(8, max(n, 0))):
        part = np.frombuffer(data, "<u8", (len(data) - k) // 8, k)
        out[k::8] = part[: len(out[k::8])]
    return _mixed(out)


def _words_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each of these places on."""
    sliding = np.lib.stride_tricks.as_strided(data, (max(len(data) - 7, 0), 8), (1, 1))
    return np.ascontiguousarray(sliding[places]).view(np.uint64)[:, 0]


def _steps(length: int) -> list[int]:
    return [*range(0, length - 8, 8), length - 8]


def find_units(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, bytes before the anchor) of each unit of texts that stand one after another."""
    starts = np.cumsum(sizes) - sizes
    n_windows = max(0, len(data) - LENGTH + 1)
    whole = sizes >= LENGTH
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[whole]] = 1
    inside[(starts + sizes - LENGTH + 1)[whole]] = -1
    inside = np.cumsum(inside, dtype=np.int8)
    low, found = np.uint64(_PLACE_BITS), []
    for x in range(0, n_windows, SEGMENT):
        y = min(x + SEGMENT, n_windows)
        words = _all_words(data[x : y + LENGTH - 1])
        n = y - x + _SIDE
        h = np.zeros(n, np.uint64)
        for k, o in enumerate(_steps(ANCHOR)):
            h += words[o : o + n] * _ODD[0, k]
        h ^= h >> np.uint64(32)
        h *= _PRIME
        least = (h >> low << low) | np.arange(x, x + n, dtype=np.uint64)
        width, target = 1, _SIDE + 1
        while width * 2 <= target:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < target:
            least = np.minimum(least[: len(least) - (target - width)], least[target - width :])
        s = np.flatnonzero(inside[x:y])
        if len(s):
            place = (least[s] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
            s += x
            edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (s[1:] != s[:-1] + 1)])
            found.append(np.stack([s[edge], np.r_[s[edge[1:] - 1], s[-1]], place[edge]]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    first, last, place = np.concatenate(found, axis=1)
    fresh = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1)])  # units that a segment cut are joined
    first, last, place = first[fresh], np.r_[last[fresh[1:] - 1], last[-1]], place[fresh]
    return first, last - first + 1, place - first


class Block:
    """A block of documents in order of id, with its units; places are bytes of the joined texts."""

    def __init__(self, data: bytes, sizes: np.ndarray, units: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.data, self.sizes = np.frombuffer(data, np.uint8), sizes
        self.starts = np.cumsum(sizes) - sizes
        self.first, self.count, self.left = units
        self.doc = np.searchsorted(self.starts, self.first, "right") - 1
        self.anchor = np.zeros(len(self.first), np.uint64)
        for k, o in enumerate(_steps(ANCHOR)):
            self.anchor += _mixed(_words_at(self.data, self.first + self.left + o)) * _ODD[0, k]
        self.anchor ^= self.anchor >> np.uint64(32)
        self.anchor *= _PRIME
        self.own = self._kinds()

    def window(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the 100 bytes from each place on."""
        one, two = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
        for k, o in enumerate(_steps(LENGTH)):
            x = _mixed(_words_at(self.data, places + o))
            one += x * _ODD[0, k]
            two += (x ^ (x >> np.uint64(32))) * _ODD[1, k]
        return one ^ (one >> np.uint64(31)), two * _PRIME

    def _kinds(self) -> np.ndarray:
        """For each unit the number of the first unit in the block with the same bytes."""
        n = len(self.first)
        if not n:
            return np.empty(0, np.int64)
        # two windows cover a unit's bytes
        unit = self.window(self.first)[0] * _PRIME + self.window(self.first + self.count - 1)[1] + (self.count * 128 + self.left).astype(np.uint64) * _ODD[1, 15]
        order = np.lexsort((np.arange(n), unit, self.anchor))
        fresh = np.r_[True, (unit[order][1:] != unit[order][:-1]) | (self.anchor[order][1:] != self.anchor[order][:-1])]
        own = np.empty(n, np.int64)
        own[order] = order[fresh][np.cumsum(fresh) - 1]
        later = np.flatnonzero(own != np.arange(n))
        same = (self.count[later] == self.count[own[later]]) & (self.left[later] == self.left[own[later]])
        for o in range(0, LENGTH + _SIDE, 8):  # bytes decide
            at = np.minimum(o, self.count[later] + LENGTH - 9)
            same &= _words_at(self.data, self.first[later] + at) == _words_at(self.data, self.first[own[later]] + at)
        own[later[~same]] = later[~same]
        return own

    def firsts(self) -> np.ndarray:
        return np.flatnonzero(self.own == np.arange(len(self.own)))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of units that are first in the block, their distinct anchors, which of these each has, and how many units each anchor has."""
        f = self.firsts()
        return f, *np.unique(self.anchor[f], return_inverse=True, return_counts=True)

    def bodies(self, units: np.ndarray) -> np.ndarray:
        """The bytes of units, one after another."""
        n = self.count[units] + LENGTH - 1
        return self.data[np.repeat(self.first[units] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def windows(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows of these units: the place, the two hashes, and the numbers of those that are first in the block."""
        n = self.count[units]
        places = np.repeat(self.first[units] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        one, two = self.window(places)
        order = np.lexsort((np.arange(len(one)), two, one))
        a, b = one[order], two[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)]
        return places, one, two, np.sort(order[fresh])


def radix_groups(digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(items, group of each), ordered by group: groups of two or more items that agree in all digits, one digit after another.

    Items that are alone after a digit leave before the next. Items of a group are in ascending order.
    """
    items = np.arange(len(digits[0]))
    group = np.zeros(len(items), np.int64)
    for digit in digits:
        d = digit[items]
        order = np.lexsort((d, group))
        items, group, d = items[order], group[order], d[order]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (d[1:] != d[:-1])][: len(items)]
        number = np.cumsum(fresh) - 1
        many = (np.bincount(number) > 1)[number] if len(number) else np.empty(0, bool)
        items, group = items[many], number[many]
    return items, group


def _verified(items: np.ndarray, group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The groups again, by the bytes of each item (``rows``, as ``items``): those that differ from their group's first get groups of their own."""
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    lead = begin[np.cumsum(np.r_[True, group[1:] != group[:-1]][: len(group)]) - 1]
    if (rows == rows[lead]).all():
        return group
    names: dict[tuple[int, bytes], int] = {}
    return np.array([names.setdefault((g, r.tobytes()), len(names)) for g, r in zip(group.tolist(), rows, strict=True)])


def _later(items: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Items that are not the first of their group by rank."""
    order = np.lexsort((rank[items], group))
    g = group[order]
    return items[order[np.r_[False, g[1:] == g[:-1]][: len(g)]]]


def repeated_windows(anchor: np.ndarray, left: np.ndarray, count: np.ndarray, rank: np.ndarray, body: np.ndarray) -> np.ndarray:
    """A mask for each unit: bit w is set if window w also occurs in a unit of lower rank (``body``: the units' bytes, one after another)."""
    n = count + LENGTH - 1
    ends = np.cumsum(n)
    mask = np.zeros(len(n), np.uint64)
    order = np.argsort(anchor, kind="stable")
    a = anchor[order]
    edges = np.r_[np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)]), len(a)]
    k = 0
    while k < len(edges) - 1:
        m = max(k + 1, int(np.searchsorted(edges, edges[k] + SORTED, "right")) - 1)
        own = order[edges[k] : edges[m]]
        mask[own] = _sorted_units(anchor[own], left[own], count[own], rank[own], body, (ends - n)[own])
        k = m
    return mask


def _sorted_units(anchor: np.ndarray, left: np.ndarray, count: np.ndarray, rank: np.ndarray, body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = count + LENGTH - 1
    table = np.zeros((len(n), _WIDTH), np.uint8)  # every anchor stands at column _SIDE
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    table.reshape(-1)[np.repeat(np.arange(len(n)) * _WIDTH + _SIDE - left, n) + inner] = body[np.repeat(starts, n) + inner]
    words = _mixed(table.view(np.uint64))
    third = words.shape[1] // 3
    digits = [(words[:, k : k + third] * _ODD[0, k : k + third]).sum(1, dtype=np.uint64) for k in range(0, words.shape[1], third)]
    whole = np.uint64(2**64 - 1) >> (64 - count).astype(np.uint64)
    items, group = radix_groups([anchor, count * 64 + left, *digits])
    gone = _later(items, _verified(items, group, table[items]), rank)
    mask = np.zeros(len(n), np.uint64)
    mask[gone] = whole[gone]
    # windows of the units left, where an anchor has two or more
    rest = np.flatnonzero(mask == 0)
    _, kind, kinds = np.unique(anchor[rest], return_inverse=True, return_counts=True)
    kind, rest = kind[kinds[kind] > 1], rest[kinds[kind] > 1]
    m = count[rest]
    unit = np.repeat(np.arange(len(rest)), m)
    within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    column = _SIDE - left[rest][unit] + within
    flat, at = table.reshape(-1), rest[unit] * _WIDTH + column
    halves = []
    for steps in (_steps(LENGTH)[:6], _steps(LENGTH)[6:]):
        halves.append(np.zeros(len(at), np.uint64))
        for k, o in enumerate(steps):
            halves[-1] += _mixed(_words_at(flat, at + o)) * _ODD[1, k]
    items, group = radix_groups([kind[unit] * 64 + column, *halves])
    rows = np.concatenate([_words_at(flat, at[items] + o)[:, None] for o in _steps(LENGTH)], axis=1) if len(items) else np.empty((0, 1), np.uint64)
    later = _later(items, _verified(items, group, rows), rank[rest][unit])
    np.bitwise_or.at(mask, rest[unit[later]], np.uint64(1) << within[later].astype(np.uint64))
    return mask


_BLOCK_SCHEMA = "part int, batch int, n_units long, ids array<long>, sizes array<long>, data binary, units binary"
_ENTRY_SCHEMA = "bucket int, part int, batch int, one binary, two binary, ids binary, shape binary, body binary"
_STATUS_SCHEMA = "part int, batch int, bucket int, status binary"


def _write_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark, BLOCK_ROWS)
    struct = StructType.fromDDL(_BLOCK_SCHEMA)
    arrow = to_arrow_schema(struct)
    rows = id_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            if b.num_rows:
                ids = np.asarray(b.column("doc_id"))
                texts = b.column("text").cast(pa.binary()).to_pylist()
                order = np.argsort(ids, kind="stable")
                data, sizes = b"".join([texts[i] for i in order]), np.array([len(texts[i]) for i in order], np.int64)
                first, count, left = find_units(data, sizes)
                units = first.astype("<u4").tobytes() + (count - 1).astype(np.uint8).tobytes() + left.astype(np.uint8).tobytes()
                row = [[part_of(task, k)], [k], [len(first)], [ids[order]], [sizes], [data], [units]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, arrow, strict=True)], schema=arrow)

    return blocks_by_part(rows.mapInArrow(run, struct), "repeat_blocks")


def _block(b: pa.RecordBatch, k: int) -> Block:
    raw, n = b.column("units")[k].as_py(), b.column("n_units")[k].as_py()
    units = np.frombuffer(raw, "<u4", n).astype(np.int64), np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.int64) + 1, np.frombuffer(raw, np.uint8, n, 5 * n).astype(np.int64)
    return Block(b.column("data")[k].as_py(), np.asarray(b.column("sizes")[k].values), units)


def _bucket_of(digit: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((digit * _PRIME >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)


def _packed(bucket_of: np.ndarray, head: tuple[int, int], columns: dict[str, Callable[[np.ndarray], bytes]], arrow: pa.Schema) -> pa.RecordBatch:
    """One row for each bucket: each column is made from the numbers of the entries that go there."""
    order, places = by_bucket(bucket_of)
    rows: dict[str, list] = {"bucket": list(places), "part": [head[0]] * len(places), "batch": [head[1]] * len(places)}
    for name in ("one", "two", "ids", "shape", "body"):
        rows[name] = [columns[name](order[s:e]) if name in columns else None for s, e in places.values()]
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in arrow], schema=arrow)


def _unpacked(bucket_of: np.ndarray, found: list[dict], dtype: type) -> np.ndarray:
    """Answers of the buckets, in the order of the entries that were sent."""
    order, places = by_bucket(bucket_of)
    out = np.zeros(len(bucket_of), dtype)
    for x in found:
        s, e = places[x["bucket"]]
        out[order[s:e]] = np.frombuffer(x["status"], dtype)
    return out


def _joined(group: pd.DataFrame, column: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(group[column]), dtype)


def _answers(group: pd.DataFrame, status: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum(sizes)
    return pd.DataFrame({"part": group["part"], "batch": group["batch"], "bucket": group["bucket"], "status": [status[e - n : e].tobytes() for n, e in zip(sizes, ends, strict=True)]})


def _anchor_counts(hot_units: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """0 for an anchor with one unit in the corpus, 1 for others, 2 for those with more than ``hot_units``."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        anchor, n = _joined(group, "one", np.uint64), _joined(group, "shape", np.int32)
        _, which = np.unique(anchor, return_inverse=True)
        total = np.bincount(which, n)[which]
        state = np.where(total > hot_units, 2, total > 1).astype(np.uint8)
        return _answers(group, state, group["one"].map(len).to_numpy() // 8)

    return count


def _ranked(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The messages in order of reading, and the rank of each entry: by id, then as read."""
    group = group.assign(task=group["part"] // SPREAD).sort_values(["task", "batch"])
    ids = _joined(group, "ids", np.int64)
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return group, rank


def _sort_units(group: pd.DataFrame) -> pd.DataFrame:
    group, rank = _ranked(group)
    sizes = group["one"].map(len).to_numpy() // 8
    shape = _joined(group, "shape", np.uint8).reshape(-1, 2).astype(np.int64)
    return _answers(group, repeated_windows(_joined(group, "one", np.uint64), shape[:, 0], shape[:, 1] + 1, rank, _joined(group, "body", np.uint8)), sizes)


def _sort_windows(group: pd.DataFrame) -> pd.DataFrame:
    group, rank = _ranked(group)
    status = np.zeros(len(rank), np.uint8)
    status[_later(*radix_groups([_joined(group, "one", np.uint64), _joined(group, "two", np.uint64)]), rank)] = 1
    return _answers(group, status, group["one"].map(len).to_numpy() // 8)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary): one row per input row, texts as UTF-8 bytes.

    A byte goes when a 100-byte string that covers it also starts earlier: in a
    document with a smaller id, or earlier in the same one. A null text is empty; a null id is
    smaller than any other. Of rows that share an id, the one read first is earlier. Texts under 100 bytes
    stay whole; very long texts are hashed in segments, and need about 30 bytes for each of their own at most; an empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    blocks = _write_blocks(docs, id_col, text_col)
    prepare(spark, 1)
    total = blocks.agg(F.sum("n_units")).first()[0] or 0
    n_buckets = max(1, -(-total // BUCKET_ENTRIES))
    entry, status = StructType.fromDDL(_ENTRY_SCHEMA), StructType.fromDDL(_STATUS_SCHEMA)
    entry_arrow = to_arrow_schema(entry)
    answer = lambda b, found, name: with_answers(b, found, name, "bucket", "status")
    pick = lambda values: lambda own: values[own].tobytes()

    def each(fn: Callable[[Block, pa.RecordBatch, int], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    out = fn(_block(b, k), b, k)
                    if out is not None:
                        yield out

        return run

    def head(b: pa.RecordBatch, k: int) -> tuple[int, int]:
        return b.column("part")[k].as_py(), b.column("batch")[k].as_py()

    def send_anchors(x: Block, b: pa.RecordBatch, k: int) -> pa.RecordBatch:
        _, anchor, _, n = x.anchors()
        return _packed(_bucket_of(anchor, n_buckets), head(b, k), {"one": pick(anchor), "shape": pick(n.astype(np.int32))}, entry_arrow)

    base = ["part", "batch", "n_units", "ids", "sizes", "data", "units"]
    sent = blocks.select(*base).mapInArrow(each(send_anchors), entry)
    counted = save(sent.groupBy("bucket").applyInPandas(_anchor_counts(HOT_UNITS), status), "anchor-status")

    def left(x: Block, b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First units of anchors that are sorted further, and of hot ones."""
        f, anchor, which, _ = x.anchors()
        state = _unpacked(_bucket_of(anchor, n_buckets), b.column("status0")[k].as_py(), np.uint8)[which]
        return f[state == 1], f[state == 2]

    def send_units(x: Block, b: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
        u, _ = left(x, b, k)
        if not len(u):
            return None
        ids = np.asarray(b.column("ids")[k].values)[x.doc[u]]
        shape = np.stack([x.left[u], x.count[u] - 1], 1).astype(np.uint8)
        columns = {"one": pick(x.anchor[u]), "ids": pick(ids), "shape": pick(shape), "body": lambda own: x.bodies(u[own]).tobytes()}
        return _packed(_bucket_of(x.anchor[u], n_buckets), head(b, k), columns, entry_arrow)

    with_counts = answer(blocks, counted, "status0").select(*base, "status0")
    units = save(with_counts.mapInArrow(each(send_units), entry).groupBy("bucket").applyInPandas(_sort_units, status), "unit-status")

    def send_windows(x: Block, b: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
        _, hot = left(x, b, k)
        if not len(hot):
            return None
        places, one, two, f = x.windows(hot)
        ids = np.asarray(b.column("ids")[k].values)[np.searchsorted(x.starts, places[f], "right") - 1]
        return _packed(_bucket_of(one[f], n_buckets), head(b, k), {"one": pick(one[f]), "two": pick(two[f]), "ids": pick(ids)}, entry_arrow)

    windows = save(with_counts.mapInArrow(each(send_windows), entry).groupBy("bucket").applyInPandas(_sort_windows, status), "window-status")

    out = StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    out_arrow = to_arrow_schema(out)

    def cut(x: Block, b: pa.RecordBatch, k: int) -> pa.RecordBatch:
        gone = np.zeros(len(x.data) + 1, np.int32)
        whole = np.flatnonzero(x.own != np.arange(len(x.own)))
        np.add.at(gone, x.first[whole], 1)
        np.add.at(gone, x.first[whole] + x.count[whole] - 1 + LENGTH, -1)
        u, hot = left(x, b, k)
        mask = _unpacked(_bucket_of(x.anchor[u], n_buckets), b.column("status1")[k].as_py(), np.uint64)
        u, mask = u[mask != 0], mask[mask != 0]
        unit, bit = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        places = [x.first[u[unit]] + bit]
        if len(hot):
            every, one, _, f = x.windows(hot)
            again = np.ones(len(every), bool)
            again[f] = _unpacked(_bucket_of(one[f], n_buckets), b.column("status2")[k].as_py(), np.uint8) == 1
            places.append(every[again])
        for p in places:
            np.add.at(gone, p, 1)
            np.add.at(gone, p + LENGTH, -1)
        covered = np.cumsum(gone[:-1]) > 0
        ids = np.asarray(b.column("ids")[k].values)
        rows = [_spans(covered[s : s + n], x.data[s : s + n]) for s, n in zip(x.starts, x.sizes, strict=True)]
        cols = [[None if i == _NO_ID else i for i in ids.tolist()], x.sizes, [[{"start": s, "end": e} for s, e in r[0]] for r in rows], [r[1] for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_arrow, strict=True)], schema=out_arrow)

    answered = answer(answer(answer(blocks, counted, "status0"), units, "status1"), windows, "status2").select(*base[2:], "status0", "status1", "status2")
    return answered.mapInArrow(each(cut), out)


def _spans(covered: np.ndarray, text: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Runs that go, and the bytes that stay."""
    if not covered.any():
        return [], text.tobytes()
    edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), text[~covered].tobytes()


def repeats_digest(docs: DataFrame) -> DataFrame:
    """The report of ``op4``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = remove_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    out = save(found, "repeats-digest")  # under the batch size of whole blocks
    prepare(docs.sparkSession)
    return out
