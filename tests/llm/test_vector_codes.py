import hashlib
import random

import numpy as np
import pytest

from parley.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code int"


def plain(rows, scale=1024, parts=4, entries=256, rounds=4):
    """The definition, with Python's own integers."""
    kept = sorted(((i, [int(np.floor(scale * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(nearest(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])]
    out, sums = [], {}
    for i, v, lab in kept:
        best = [nearest(part(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
        sums[lab] = sums.get(lab, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[lab], sha) for i, c, e, lab in out), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vector_codes.vector_codes(df, **kw).collect()), key=str)


def some_rows(n, seed, d=8, step=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice([-0.5, 0.0, 0.25])) if step else (lambda: rng.gauss(0, 0.3))
    return [(rng.randrange(10 * n), [value() for _ in range(d)], rng.choice([None, 1, 2])) for _ in range(n)]


@pytest.mark.parametrize("step", [None, 1])
def test_equals_the_definition(spark, step):
    rows = some_rows(300, 5, step=step)
    rows += [(7, None, 1), (8, [], 1), (9, [None] * 8, 1), (10, [float("nan")] * 8, 2), (11, [float("inf")] * 8, None), (None, rows[0][1], 1), rows[5], rows[5]]
    assert run(spark, rows, entries=32) == plain(rows, entries=32)


def test_fewer_rows_than_entries_and_none(spark):
    rows = some_rows(5, 1)
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []


def test_other_lengths(spark):
    rows = some_rows(20, 2)
    first = min(rows)
    assert run(spark, [*rows, (10**6, [0.1] * 4, 1)]) == plain(rows)
    assert run(spark, [*rows, (first[0] + 1, [0.1] * 4, 1)], entries=8) == plain(rows, entries=8)
    with pytest.raises(ValueError):
        run(spark, [(1, [0.1] * 6, 1)])


def test_bounds_spare_scans_and_keep_results():
    """Clustered rows: after the first round most groups stay closed, and codes are those of a full scan."""
    rng = np.random.default_rng(3)
    centers = rng.integers(-2000, 2000, (40, 16))
    x = (centers[rng.integers(0, 40, 4000)] + rng.integers(-30, 30, (4000, 16))).astype(np.float64)
    books = x[:256].copy()
    group = vector_codes.entry_groups(books)
    code, upper, lower = vector_codes.full_scan(x, books, group)
    work = 0
    for _ in range(4):
        old = books
        books = np.stack([x[code == k].sum(0) // (code == k).sum() if (code == k).any() else old[k] for k in range(256)])
        code, upper, lower, took = vector_codes.rescan(x, code, upper, lower, books, old, group)
        work += took
        d = vector_codes.squares(x, books)
        assert (code == d.argmin(1)).all()
        rest = d.copy()
        rest[np.arange(len(x)), code] = np.inf
        assert all((lower[:, g] <= np.sqrt(rest[:, group == g].min(1))).all() for g in range(group.max() + 1))
        assert (upper >= np.sqrt(d.min(1))).all()
    assert work < 4 * len(x) * 256 / 4


def test_large_components_are_exact():
    x = np.array([[1 << 26, -(1 << 26)]], np.float64)
    c = np.array([[-(1 << 26), 1 << 26], [1 << 26, 1 - (1 << 26)]], np.float64)
    assert vector_codes.squares(x, c).tolist() == [[2 * (1 << 27) ** 2, 1]]
