import hashlib
import random
from collections import defaultdict

from parley.llm import exact_dedup
from parley.llm.exact_dedup import MAX_CHUNK, chunk_names, chunk_table, cut_points, drop_copies, exact_groups, recipes


def test_cuts_follow_content():
    data = random.Random(1).randbytes(300_000)
    ends = cut_points(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends)) and max(b - a for a, b in zip([0, *ends], ends)) <= MAX_CHUNK
    shared = set(chunk_names(data)) & set(chunk_names(b"inserted" + data))
    assert len(shared) > len(ends) / 2
    assert cut_points(b"") == [] and cut_points(b"abc") == [3]


def test_groups(odd_docs, odd_texts, empty_docs):
    pairs = [*enumerate(odd_texts), (None, "no id"), (3, odd_texts[3])]
    groups = defaultdict(list)
    for k, t in pairs:
        groups[(t or "").encode().lower()].append(k)
    rows = exact_groups(odd_docs).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        data = b"no id" if r.doc_id is None else (odd_texts[r.doc_id] or "").encode().lower()
        ids = groups[data]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(ids), r.doc_id == keep, hashlib.sha256(data).hexdigest())
    assert exact_groups(empty_docs).collect() == []


def test_drop_and_chunks(odd_docs):
    left = {r.doc_id for r in drop_copies(odd_docs).collect()}
    assert left == {1, 2, 5, 6, 7, 8, 9, 10, 11, None}
    chunks = chunk_table(recipes(odd_docs)).collect()
    assert all(c.verified and len(c.id) == 16 for c in chunks) and max(c.uses for c in chunks) == 4


def test_identifiers_that_collide(spark, monkeypatch):
    """With one byte most identifiers stand for several names; groups stay those of equal texts."""
    docs = spark.createDataFrame([(k, f"text {k % 400}") for k in range(900)], "doc_id long, text string")
    want = sorted(map(tuple, exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "ID_BYTES", 1)
    assert not all(c.verified for c in chunk_table(recipes(docs)).collect())
    assert sorted(map(tuple, exact_groups(docs).collect())) == want and len({r[1] for r in want}) == 400


def test_rows_that_share_an_id(spark):
    rows = [(1, "Same é text"), (2, "same é TEXT"), (1, "another text"), (1, None)]
    left = drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in left} == {(2, "same é TEXT"), (1, "another text"), (1, None)}
