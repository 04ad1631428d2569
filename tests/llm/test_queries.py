import os

import pytest

from parley.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("PARLEY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op6_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9_quality": ["doc_id", "held_out", "score", "predicted"],
    "op11_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op10_decontamination": ["doc_id", "item_id", "edits", "start", "end"],
}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if COLUMNS[n][0] == "doc_id"))
def test_each_document_once(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES[name](spark, SF)
    assert rows.columns == COLUMNS[name]
    ids = sorted(r.doc_id for r in rows.select("doc_id").collect())
    want = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert ids == want or (name == "op10_decontamination" and ids and set(ids) < set(want))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    assert want and sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*names).collect()) == want


def test_sql_names_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
