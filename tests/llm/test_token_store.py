import json
import zlib

import numpy as np
import pyarrow.orc as orc
from tokenizers import Tokenizer

from parley.llm.bpe import default_path
from parley.llm.token_store import END_ID, read_tokens, stored_digest, write_tokens


def library_ids(texts):
    t = Tokenizer.from_file(default_path())
    t.no_truncation()
    t.no_padding()
    return [t.encode(x or "", add_special_tokens=False).ids + [END_ID] for x in texts]


def test_digest(odd_docs, odd_texts, empty_docs):
    """Against the library's own encoding of whole texts, in the order of ids."""
    pairs = sorted([*enumerate(odd_texts), (None, "no id"), (3, odd_texts[3])], key=lambda p: (p[0] is not None, p[0] or 0))
    want, at = [], 0
    for (k, _), ids in zip(pairs, library_ids([t for _, t in pairs])):
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, stored_digest(odd_docs).collect()), key=lambda r: r[1]) == want
    assert stored_digest(empty_docs).collect() == []


def test_rows_that_share_an_id(spark):
    """Their order does not depend on how they are read."""
    docs = spark.createDataFrame([(5, f"text {k % 7}") for k in range(40)] + [(4, "before")], "doc_id long, text string")
    a, b = (sorted(tuple(r)[1:] for r in stored_digest(d).collect()) for d in (docs, docs.repartition(7)))
    assert a == b and [r[0] for r in a] == np.cumsum([0, *(r[1] for r in a[:-1])]).tolist()


def scanned(df):
    """Rows that the scan of a collected frame gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()) if "orc" in leaves.apply(k).toString())


def test_lookup_skips_by_bloom_filter(spark, tmp_path):
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "'some words here' AS text")
    path = f"file://{tmp_path}/store"
    write_tokens(docs, path)
    got = read_tokens(spark, path, ids=[2000, 30_002, 30_003]).collect()
    assert {(r.doc_id, r.start, r.n_tokens) for r in got} == {(k, k // 2 * 4, 4) for k in (2000, 30_002)} and all(len(r.ids) == 4 for r in got)
    rows = spark.read.orc(f"{path}/data")
    # odd ids lie between the least and the largest of their row group: only the Bloom filter can tell
    assert scanned(rows.where("doc_id = 2000")) <= 1000 and scanned(rows.where("doc_id IN (30003, 777)")) == 0
    assert read_tokens(spark, path, 100, 110).count() == 6
    files = sorted((tmp_path / "store" / "data").glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == 20_000 and json.dumps(orc.ORCFile(files[0]).schema.names)
