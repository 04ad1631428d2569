"""The thin queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm import bpe, decontamination, exact_dedup, hard_negatives, jaccard_join, lm, pii, quality, repeats, sharding, simhash, token_store, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_digest(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pii, op2_lm_score, op3_simhash, op4_repeats, op5_exact_dedup, op6_bpe, op7_sharding, op8_token_store, op9_quality, op10_decontamination,
        op11_jaccard_join, op12_hard_negatives, op13_vector_codes,
    )
}

def _codes_sql(rounds: int = 4) -> str:
    """Product codes by full scans: nearest is the least of 256 * squared distance + index."""
    steps = ["""WITH k AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM k, range(4) t(p)),
        b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 256)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x,
            min(256 * (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT + e) AS best FROM parts JOIN b{r} USING (p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT p, best % 256 AS e, i, floor(sum(x[i]) / count(*)) AS m FROM a{r}, generate_series(1, len(x)) g(i) GROUP BY p, best % 256, i),
        b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM b{r} LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS m FROM s{r} GROUP BY p, e) USING (p, e))""")
    return ",\n".join(steps) + f""",
        f AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(m::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS sha FROM (SELECT p, e, unnest(c) AS m, generate_subscripts(c, 1) AS i FROM b{rounds}))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM f JOIN k USING (vec_id), h"""


ORACLE_SQL: dict[str, str] = {
    "op11_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        d AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
        k AS MATERIALIZED (SELECT min(doc_id) AS node, s, len(s) AS n FROM d WHERE len(s) > 0 GROUP BY s),
        t AS MATERIALIZED (SELECT node, n, unnest(s) AS g FROM k),
        e AS MATERIALIZED (
            SELECT x.node AS a, y.node AS b FROM t x JOIN t y ON x.g = y.g AND x.node <> y.node AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
            GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
        r AS (SELECT node AS a, node AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a, min(b) AS root FROM r GROUP BY a)
        SELECT doc_id, len(d.s) AS n_shingles, coalesce(root, doc_id) AS component_id FROM d LEFT JOIN k ON d.s = k.s LEFT JOIN c ON c.a = k.node
    """,
    "op12_hard_negatives": """
        WITH k AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
            FROM k a JOIN k r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id,
            positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
    """,
    "op13_vector_codes": _codes_sql(),
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
}
