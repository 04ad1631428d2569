"""Product codes of vectors, their codebooks learnt by Yinyang Lloyd rounds in whole numbers.

A vector is cut into equal parts, and each part is coded by its nearest codebook entry. The
entries of a codebook are clustered into groups once. A row carries, for each part, its entry, an upper
bound of the distance to it and, for each group, a lower bound of the distance to any other entry of
the group. After a round entries have moved: the bounds are widened by how far, and only groups whose bound no
longer excludes them are scanned. Bounds are rounded outwards and a group is scanned where they touch, and what is scanned is compared by
exact squared distances, so that ties go to the lower index and codes equal those of a full scan.

Each round is one pass over the rows, whose bounds travel in a table of the shared folder, and one
aggregation of sums, made in each task first: parts x entries rows, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parley.llm.common import BROADCAST_IDS, map_batches, prepare
from parley.llm.vectors import bytes_rows, integer_rows, matrix, rows_bytes
from parley.plans.scratch import save

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Groups of a codebook's entries, each with one lower bound a row.
GROUPS = 16
#: By how much stored bounds are rounded outwards: more than 32-bit floats and square roots lose.
_SLACK = 1e-5


def entry_groups(entries: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each entry: a few Lloyd steps from entries far apart."""
    x = entries.astype(np.float64)
    centers, gap = [0], ((x - x[0]) ** 2).sum(1)
    while len(centers) < min(groups, len(x)) and gap.max() > 0:
        centers.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[centers[-1]]) ** 2).sum(1))
    mean = x[centers]
    for _ in range(5):
        near = squares(x, mean).argmin(1)
        mean = np.stack([x[near == g].mean(0) if (near == g).any() else mean[g] for g in range(len(mean))])
    return squares(x, mean).argmin(1)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries: exact for whole numbers while they stay under 2^53, else by 64-bit integers."""
    if x.dtype == np.float64 and len(x) and len(c) and 4 * x.shape[1] * max(np.abs(x).max(), np.abs(c).max()) ** 2 >= 2**53:
        x, c = x.astype(np.int64), c.astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def own_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one entry each."""
    return ((x - c).astype(np.int64) ** 2).sum(1)


def full_scan(x: np.ndarray, entries: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bound of each group) of each row."""
    d = squares(x, entries).astype(np.float64)
    code = d.argmin(1)  # the first of equals
    upper = np.sqrt(d[np.arange(len(x)), code])
    d[np.arange(len(x)), code] = np.inf
    return code, upper * (1 + _SLACK), np.stack([np.sqrt(d[:, group == g].min(1)) for g in range(group.max() + 1)], 1) * (1 - _SLACK)


def rescan(
    x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, old: np.ndarray, group: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``full_scan``'s result after the entries moved from ``old``, and how many distances it took."""
    moved = np.sqrt(((entries - old).astype(np.float64) ** 2).sum(1)) * (1 + _SLACK)
    far = np.array([moved[group == g].max() for g in range(group.max() + 1)])
    code, upper, lower = code.copy(), upper + moved[code], lower - far[None, :]
    rows = np.flatnonzero((lower <= upper[:, None]).any(1))
    if not len(rows):
        return code, upper, lower, 0
    exact = own_squares(x[rows], entries[code[rows]])  # a tight bound may already settle a row
    upper[rows] = np.sqrt(exact) * (1 + _SLACK)
    open_groups = lower[rows] <= upper[rows][:, None]
    best, best_code, old_code, work = exact.copy(), code[rows].copy(), code[rows].copy(), len(rows)
    least = np.full(open_groups.shape, np.inf)
    second = np.full(open_groups.shape, np.inf)
    least_code = np.full(open_groups.shape, -1)
    for g in range(open_groups.shape[1]):
        mine, members = np.flatnonzero(open_groups[:, g]), np.flatnonzero(group == g)
        if not len(mine):
            continue
        d = squares(x[rows[mine]], entries[members])
        work += d.size
        at = d.argmin(1)
        value, index = d[np.arange(len(mine)), at], members[at]
        least[mine, g], least_code[mine, g] = value, index
        if len(members) > 1:
            second[mine, g] = np.partition(d, 1, axis=1)[:, 1]
        better = (value < best[mine]) | ((value == best[mine]) & (index < best_code[mine]))
        best[mine[better]], best_code[mine[better]] = value[better], index[better]
    low = lower[rows]
    fresh = np.sqrt(np.where(least_code == best_code[:, None], second, least)) * (1 - _SLACK)
    low[open_groups] = fresh[open_groups]
    left = np.flatnonzero((best_code != old_code) & ~open_groups[np.arange(len(rows)), group[old_code]])
    if len(left):  # the entry that a row leaves now counts for its group
        at = (left, group[old_code[left]])
        low[at] = np.minimum(low[at], np.sqrt(exact[left]) * (1 - _SLACK))
    code[rows], upper[rows], lower[rows] = best_code, np.sqrt(best.astype(np.float64)) * (1 + _SLACK), low
    return code, upper, lower, work


def _first_rows(rows: DataFrame, n: int) -> list[list[int]]:
    return [r.v for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(n).select("v").collect()]


def _assign(state: DataFrame, books: np.ndarray, old: np.ndarray | None, groups: list[np.ndarray]) -> DataFrame:
    """``state`` with the codes and bounds for ``books`` (parts x entries x width); ``old`` are those of its own codes, None if it has none."""
    parts, _, width = books.shape
    kinds = max(g.max() for g in groups) + 1

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        x = matrix(b.column("v"), parts * width).reshape(-1, parts, width)
        codes = np.empty((len(x), parts), np.uint8)
        upper, lower = np.empty((len(x), parts), np.float32), np.full((len(x), parts, kinds), np.inf, np.float32)
        if old is not None:
            codes_0 = rows_bytes(b.column("codes"), np.uint8, parts).astype(np.int64)
            upper_0, lower_0 = (rows_bytes(b.column(c), np.float32, parts, *s).astype(np.float64) for c, s in (("upper", ()), ("lower", (kinds,))))
        for p in range(parts):
            k = groups[p].max() + 1
            if old is None:
                found = full_scan(x[:, p], books[p], groups[p])
            else:
                found = rescan(x[:, p], codes_0[:, p], upper_0[:, p], lower_0[:, p, :k], books[p], old[p], groups[p])
            codes[:, p], upper[:, p], lower[:, p, :k] = found[:3]
        return {c: b.column(c) for c in ("vec_id", "label", "v")} | {"codes": bytes_rows(codes), "upper": bytes_rows(upper), "lower": bytes_rows(lower)}

    return save(map_batches(state, batch, f"vec_id long, {_label(state)}, v array<int>, codes binary, upper binary, lower binary"), "codes")


def _label(rows: DataFrame) -> str:
    return f"label {rows.schema['label'].dataType.simpleString()}"


def _sums(state: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum of components) of each entry; each task adds up its own rows first."""
    prepare(state.sparkSession)
    struct = StructType.fromDDL("entry int, n long, s array<long>")
    arrow = to_arrow_schema(struct)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            if b.num_rows:
                at = (rows_bytes(b.column("codes"), np.uint8, parts).astype(np.int64) + np.arange(parts) * entries).reshape(-1)
                x = matrix(b.column("v"), parts * width).astype(np.int64).reshape(-1, width)
                n += np.bincount(at, minlength=len(n))
                np.add.at(s, at, x)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(s[used]), arrow.field("s").type)], schema=arrow)

    each = state.select("codes", "v").mapInArrow(add, struct)
    total = each.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)))
    n, s = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
    for r in total.collect():  # parts x entries rows at most
        n[r.entry], s[r.entry] = r.n, r[2:]
    return n.reshape(parts, entries), s.reshape(parts, entries, width)


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(state, codebooks): integer vectors (vec_id, label, v) with their final codes, and the codebooks, parts x entries x width."""
    first = _first_rows(rows, entries)
    if not first:
        return rows.limit(0).select("vec_id", "label", "v", *(F.lit(None).cast("binary").alias(c) for c in ("codes", "upper", "lower"))), np.empty((parts, 0, 0), np.int64)
    size = len(first[0])
    if size % parts:
        raise ValueError(f"vectors of {size} components have no {parts} equal parts")
    rows = rows.where(F.size("v") == size)
    if any(len(v) != size for v in first):
        first = _first_rows(rows, entries)
    books = np.array(first, np.float64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    groups = [entry_groups(b) for b in books]
    state, old = rows, None
    for _ in range(rounds):
        state = _assign(state, books, old, groups)
        n, s = _sums(state, *books.shape)
        old = books
        books = np.where(n[:, :, None] > 0, s // np.maximum(n, 1)[:, :, None], books).astype(np.float64)
    return _assign(state, books, old, groups), books.astype(np.int64)


def vector_codes(
    rows: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row for each row with a usable vector.

    Components are floor(scale * x). Codebooks start as the parts of the ``entries`` rows with the smallest ids (rows without an id come
    last, rows with one id by their components), or of all rows if they are fewer. ``error`` is the squared distance to the coded entries,
    ``label_error`` its sum over the rows of the same label, null labels together. Rows whose vector is null, empty or has a null or non-finite
    component are left out, and so are vectors of another length than the first row's. Repeated rows count each time and share
    their code. A component that scales beyond 2^26, or a length that has no equal parts, is an error. An empty table gives an
    empty result. Other columns, whatever their names, are not read.
    """
    kept = save(integer_rows(rows, scale, id_col, label_col, vector_col), "vectors")
    state, books = learn(kept, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    width = books.shape[2]

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        codes = rows_bytes(b.column("codes"), np.uint8, parts)
        x = matrix(b.column("v"), parts * width).reshape(-1, parts, width)
        error = sum(own_squares(x[:, p], books[p][codes[:, p]]) for p in range(parts))
        return {"vec_id": b.column("vec_id"), "label": b.column("label"), "code": [bytes(c).hex() for c in codes], "error": error}

    coded = save(map_batches(state, batch, f"vec_id long, {_label(state)}, code string, error long"), "coded")
    by_label = save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    if by_label.count() <= BROADCAST_IDS:
        by_label = F.broadcast(by_label)
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
