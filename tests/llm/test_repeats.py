import hashlib
import random

import numpy as np
import pytest

from parley.llm import repeats

from .conftest import sentence


def brute(rows):
    """rows: (id, bytes) in order of reading."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        data = rows[k][1]
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[k] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(rng, n):
    passages = [sentence(rng, rng.randint(14, 60)) for _ in range(6)]
    base = [sentence(rng, rng.randint(1, 90)) for _ in range(n // 3)]
    out = []
    for k in range(n):
        text = rng.choice(base) if k % 3 else sentence(rng, rng.randint(0, 80))
        words = text.split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice([[rng.choice(passages)], ["é漢"], []])
            if words and rng.random() < 0.5:
                words.pop(rng.randrange(len(words)))
        out.append((k, " ".join(words)))
    out += [(n, "ab" * 400), (n + 1, "x" * 99), (n + 2, "x" * 100), (n + 3, "x" * 201)]
    return out


@pytest.mark.parametrize(("rows", "entries", "hot"), [(1024, 400_000, 1000), (7, 300, 3), (20, 50, 0)])
def test_against_brute_force(spark, monkeypatch, rows, entries, hot):
    """Whatever the sizes of blocks and buckets, and with anchors that are hot."""
    for name, value in (("BLOCK_ROWS", rows), ("BUCKET_ENTRIES", entries), ("HOT_UNITS", hot)):
        monkeypatch.setattr(repeats, name, value)
    docs = corpus(random.Random(rows), 90)
    random.Random(1).shuffle(docs)
    want = brute([(k, t.encode()) for k, t in docs])
    got = repeats.repeats_digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {docs[k][0]: v for k, v in want.items()}
    assert sum(v[1] for v in want.values()) > 2000


def test_a_line_in_every_document(spark, monkeypatch):
    """The units at its ends differ in every document, under the same anchors."""
    monkeypatch.setattr(repeats, "HOT_UNITS", 20)
    monkeypatch.setattr(repeats, "BLOCK_ROWS", 8)
    rng = random.Random(12)
    line = sentence(rng, 40)
    docs = [(k, f"{sentence(rng, rng.randint(0, 30))} {line} {sentence(rng, rng.randint(0, 30))}") for k in range(80)]
    got = repeats.repeats_digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute([(k, t.encode()) for k, t in docs])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("parley_blocks")]


def test_segments_and_slices_change_nothing(monkeypatch):
    texts = [t.encode() for _, t in corpus(random.Random(5), 60)]
    data, sizes = b"".join(texts), np.array([len(t) for t in texts])

    def found():
        units = repeats.find_units(data, sizes)
        x = repeats.Block(data, sizes, units)
        f = x.firsts()
        return units, repeats.repeated_windows(x.anchor[f], x.left[f], x.count[f], np.arange(len(f))[::-1], x.bodies(f))

    units, mask = found()
    assert units[1].max() <= 64 and units[1].sum() == sum(max(0, len(t) - 99) for t in texts) and mask.any()
    for segment, slice_ in ((100, 1), (333, 7)):
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        monkeypatch.setattr(repeats, "SORTED", slice_)
        again = found()
        assert all((a == b).all() for a, b in zip(units, again[0])) and (mask == again[1]).all()


def test_radix_groups_and_bytes():
    rng = np.random.default_rng(3)
    digits = [rng.integers(0, 4, 200, dtype=np.uint64) for _ in range(4)]
    items, group = repeats.radix_groups(digits)
    want = {}
    for k, key in enumerate(zip(*(d.tolist() for d in digits))):
        want.setdefault(key, []).append(k)
    got = {}
    for i, g in zip(items.tolist(), group.tolist()):
        got.setdefault(g, []).append(i)
    assert sorted(got.values()) == sorted(v for v in want.values() if len(v) > 1)
    rows = np.array([[1], [2], [1], [7], [7]])
    again = repeats._verified(np.arange(5), np.array([0, 0, 0, 1, 1]), rows)
    assert again[0] == again[2] != again[1] and again[3] == again[4] not in (again[0], again[1])


def test_odd(odd_docs, odd_texts, empty_docs):
    docs = odd_docs.dropDuplicates(["doc_id"])
    want = brute([*((k, (t or "").encode()) for k, t in enumerate(odd_texts)), (None, b"no id")])
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeats_digest(docs).collect()}
    assert got == {k: want[k] for k in range(len(odd_texts))} | {None: want[len(odd_texts)]}
    assert repeats.repeats_digest(empty_docs).collect() == []


def test_rows_that_share_an_id(spark):
    text = sentence(random.Random(2), 40)
    got = repeats.repeats_digest(spark.createDataFrame([(5, text), (5, text)], "doc_id long, text string").repartition(2)).collect()
    assert sorted(r.n_removed for r in got) == [0, len(text.encode())]
