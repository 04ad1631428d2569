"""Queries about building training sets from an archive, evaluation summaries and word statistics by person, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import curation, dataset, scoring, voice
from parley.plans import datasets
from parley.plans.register import Registry
from parley.plans.texts import _STOP, _VOICE, _quoted
from parley.sources import catalog as c

registered = Registry()
query = registered.query
QUERIES, ORACLE = registered.queries, registered.oracle

_ADMITTED = """CTE adm AS (SELECT id, chat_id, is_from_me, ts, CASE WHEN is_from_me = 1 THEN 'assistant' ELSE 'user' END AS role, CASE WHEN coalesce(text, '') = '' THEN '[attachment]' ELSE text END AS text
    FROM fx_arc WHERE kind IS NULL AND is_unsent = 0 AND coalesce(text, '') <> 'Loved “that”' AND (coalesce(text, '') <> '' OR has_attachment = 1))"""
_DIRECT = "dir AS (SELECT chat_id, min(handle) AS handle FROM fx_arc_member GROUP BY chat_id HAVING count(*) = 1)"
_ONCE = f"""{_ADMITTED}, {_DIRECT}, ord AS (SELECT chat_id, min(ts) AS first_ts FROM fx_arc WHERE kind IS NULL GROUP BY chat_id),
    rk AS (SELECT adm.*, row_number() OVER (PARTITION BY id ORDER BY first_ts, chat_id) AS k FROM adm JOIN ord USING (chat_id) WHERE chat_id IN (SELECT chat_id FROM dir)),
    once AS (SELECT chat_id, id AS msg_no, role, text, epoch(ts)::BIGINT AS sec FROM rk WHERE k = 1)"""
_SESSIONS = f"{_ONCE}, {datasets._TURNS.removeprefix('CTE ').replace('fx_turn', 'once')}, voiced AS (SELECT DISTINCT chat_id FROM t WHERE role = 'assistant')"
_VIEWS = ("fx_arc", "fx_arc_member")


def _people(spark):
    return spark.range(100).select(F.col("id").alias("handle"), F.concat(F.lit("p"), F.col("id") % 10).alias("person"))


@query(f"{_ADMITTED} SELECT id, chat_id, role, text FROM adm", "fx_arc")
def admitted_messages(spark, sf):
    return dataset.admitted(c.archive_messages(spark, sf)).select("id", "chat_id", "role", "text")


@query("SELECT chat_id, epoch(min(ts))::BIGINT AS first_sec, epoch(max(ts))::BIGINT AS last_sec FROM fx_arc WHERE kind IS NULL GROUP BY chat_id", "fx_arc")
def chat_order(spark, sf):
    return dataset.chat_order(c.archive_messages(spark, sf)).select("chat_id", F.unix_seconds("first_ts").alias("first_sec"), F.unix_seconds("last_ts").alias("last_sec"))


@query(f"""{_SESSIONS} SELECT (SELECT count(*) FROM voiced) AS chats, (SELECT count(DISTINCT (chat_id, session_no)) FROM s WHERE chat_id IN (FROM voiced)) AS sessions,
    (SELECT count(*) FROM t WHERE role = 'assistant') AS sent_turns, (SELECT count(*) FROM once WHERE role = 'assistant' AND text <> '[attachment]' AND chat_id IN (FROM voiced)) AS sent_texts,
    (SELECT count(*) FROM a WHERE role = 'assistant' AND (pr IS NULL OR pr <> 'user')) AS opener_turns, (SELECT count(*) FROM (SELECT chat_id FROM fx_arc_member GROUP BY chat_id HAVING count(*) > 1)) AS skipped_groups""", *_VIEWS)
def example_counters(spark, sf):
    counters = dataset.collect_examples(c.archive_messages(spark, sf), c.archive_members(spark, sf))[1]
    return counters.select("chats", "sessions", "sent_turns", "sent_texts", "opener_turns", "skipped_groups")


@query()
def collected_examples(spark, sf):
    return dataset.collect_examples(c.archive_messages(spark, sf), c.archive_members(spark, sf))[0].select("chat_id", "session_no", "turn_no", "query", "reply")


@query()
def export_report(spark, sf):
    return dataset.export_dataset(c.archive_messages(spark, sf), c.archive_members(spark, sf), low_signal_share=0.5)[1]


@query(f"""CTE {_DIRECT}, m AS (SELECT 'p' || (dir.handle % 10) AS person, dir.handle AS handle, is_from_me FROM fx_arc JOIN dir USING (chat_id) WHERE kind IS NULL),
    e AS (SELECT person, handle, sum(is_from_me) AS s, count(*) AS n FROM m GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, handle) AS k FROM e)
    SELECT person, sum(s)::BIGINT AS sent, (sum(n) - sum(s))::BIGINT AS received, arg_min(handle, k) AS handle FROM k GROUP BY person""", *_VIEWS)
def direct_stream_totals(spark, sf):
    streams = dataset.direct_streams(c.archive_messages(spark, sf), c.archive_members(spark, sf), _people(spark))
    return dataset.stream_totals(streams).select("person", "sent", "received", "handle")


@query("""CTE e AS (SELECT 'p' || (handle % 10) AS person, handle, count(*) AS n FROM fx_arc WHERE kind IS NULL AND is_from_me = 0 GROUP BY ALL)
    SELECT 'me' AS person, NULL::BIGINT AS handle, 0::BIGINT AS handles, count(*) AS texts FROM fx_arc WHERE kind IS NULL AND is_from_me = 1
    UNION ALL SELECT person, arg_max(handle, n * 1000 - handle), count(*), sum(n)::BIGINT FROM e GROUP BY person""", "fx_arc")
def subjects(spark, sf):
    return dataset.subjects(c.archive_messages(spark, sf), _people(spark))


@query("""WITH t AS (SELECT user_id AS run, event_id AS pos, event_id % 4 AS token FROM events), f AS (SELECT *, CASE WHEN token = 2 AND lag(token) OVER w = 1 THEN 1 WHEN token = 0 THEN 0 END AS turn FROM t WINDOW w AS (PARTITION BY run ORDER BY pos))
    SELECT run, pos, token, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS supervised FROM f""")
def supervised_mask(spark, sf):
    tokens = c.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), (F.col("event_id") % 4).alias("token"))
    return dataset.supervised_mask(tokens, "run", (1, 2), 0)


@query(rf"""{datasets._TURNS}, r AS (SELECT pc AS pred, length(pc) / greatest(length(content), 1)::DOUBLE AS ratio FROM x), g AS (SELECT pred, count(*) AS n FROM r GROUP BY pred),
    tk AS (SELECT list_filter(regexp_split_to_array(lower(pred), '\s+'), lambda y: y <> '') AS w FROM r), bg AS (SELECT unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS b FROM tk WHERE len(w) > 1)
    SELECT avg((contains(pred, '[') AND contains(pred, ']'))::INT) AS placeholder_rate, avg((pred = '')::INT) AS blank_rate, (SELECT list_sort(list(ratio))[count(*) // 2 + 1] FROM r) AS len_ratio_median,
    avg((ratio < 0.5)::INT) AS too_short_rate, avg((ratio > 2.0)::INT) AS too_long_rate, (SELECT count(*) / sum(n)::DOUBLE FROM g) AS unique_share, (SELECT max(n) / sum(n)::DOUBLE FROM g) AS top1_share,
    (SELECT count(DISTINCT b) / count(*)::DOUBLE FROM bg) AS distinct_2 FROM r""", "fx_turn")
def bench_rates(spark, sf):
    rows = datasets._predictions(spark, sf).withColumn("len_ratio", F.char_length("pred") / F.greatest(F.char_length("gold"), F.lit(1)))
    return scoring.bench_rates(rows)


@query()
def relevance(spark, sf):
    return scoring.relevance(datasets._predictions(spark, sf).withColumn("prompt", F.col("gold")))


@query(f"""{datasets._TURNS}, k AS (SELECT length(content) AS g, row_number() OVER (ORDER BY chat_id * 1000 + turn_no) - 1 AS k, count(*) OVER () AS n FROM x), p AS (SELECT a.g, b.g AS sw FROM k a JOIN k b ON b.k = (a.k + a.n // 2) % a.n),
    w AS (SELECT 'swapped' AS kind, avg((g > sw)::INT) AS wins FROM p UNION ALL SELECT 'spam', avg((g > 8 * (g + 1))::INT) FROM p UNION ALL SELECT 'generic', avg((g > 2)::INT) FROM p) SELECT kind, wins, (SELECT avg(wins) FROM w) AS mean FROM w""", "fx_turn")
def metric_accuracy(spark, sf):
    probes = scoring.probes(datasets._predictions(spark, sf).select("id", "gold"))
    return scoring.metric_accuracy(probes.withColumn("chars", F.char_length("text")), "chars")


@query("""WITH l AS (SELECT p_brand AS adapter, (p_size % 3) / 10.0::DOUBLE AS temp, p_size % 2 AS k, p_size % 5 AS step, p_retailprice AS distance, p_partkey AS ts FROM part WHERE p_type = 'PROMO' AND p_partkey % 2 = 0)
    SELECT adapter, temp || ':-:' || k AS setting, (CASE WHEN step = 0 THEN 100 ELSE step END)::INT AS step, arg_max(distance, ts) AS distance FROM l GROUP BY ALL""")
def comparable_runs(spark, sf):
    p = c.table(spark, sf, "part")
    log = p.select(
        F.col("p_brand").alias("adapter"), ((F.col("p_size") % 3) / 10.0).alias("temp"), F.lit(None).cast("double").alias("repetition_penalty"), (F.col("p_size") % 2).alias("retrieve_k"),
        (F.col("p_size") % 5).cast("int").alias("step"), F.col("p_type").alias("data_hash"), F.when(F.col("p_partkey") % 2 == 0, "valid").otherwise("test").alias("split"), F.col("p_retailprice").alias("distance"), F.col("p_partkey").alias("ts"),
    )
    return scoring.comparable_runs(log, p.select(F.col("p_brand").alias("adapter"), F.lit(100).alias("iters")).distinct(), "PROMO")


@query(f"""{_VOICE}, o AS (SELECT sender, word, count(*) AS n FROM v WHERE word NOT IN ({_quoted(_STOP)}) GROUP BY ALL), g AS (SELECT word, sum(n) AS g FROM o GROUP BY word), b AS (SELECT sender, count(*) AS messages FROM fx_doc GROUP BY sender HAVING count(*) >= 5 ORDER BY messages DESC, sender LIMIT 12),
    z AS (SELECT sender, sum(n) AS total FROM o GROUP BY sender), x AS (SELECT sender, word, n, (n / total::DOUBLE) / (g / (SELECT sum(n) FROM o)::DOUBLE) AS x FROM o JOIN g USING (word) JOIN z USING (sender) WHERE n >= 6),
    r AS (SELECT sender, word, n, round_even(x, 1) AS lift, row_number() OVER (PARTITION BY sender ORDER BY n * ln(x) DESC, x DESC, n DESC, word DESC)::INT AS place FROM x WHERE x >= 2.0) SELECT sender AS handle, word, n, lift, place, messages FROM r JOIN b USING (sender) WHERE place <= 12""", "fx_doc")
def voice_people(spark, sf):
    return voice.person_words(c.document_messages(spark, sf).withColumnRenamed("sender", "handle"), _STOP, least=5)


@query("""CTE m AS (SELECT DISTINCT id, ts, is_from_me, coalesce(text, '') AS text FROM fx_arc WHERE kind IS NULL OR kind NOT BETWEEN 2000 AND 3007), n AS (SELECT chat_id, count(*) AS n FROM fx_arc_member GROUP BY chat_id)
    SELECT count(*) FILTER (is_from_me = 1) AS sent, count(*) FILTER (is_from_me = 1 AND trim(text) <> '') AS sent_text, count(*) FILTER (is_from_me = 0 AND trim(text) <> '') AS received_text,
      count(*) FILTER (is_from_me = 1 AND trim(text) = '') AS attachment_only, (SELECT count(*) FROM n WHERE n = 1) AS direct_chats, (SELECT count(*) FROM n WHERE n > 1) AS group_chats,
      epoch(min(ts))::BIGINT AS first_sec, epoch(max(ts))::BIGINT AS last_sec FROM m""", "fx_arc", "fx_arc_member")
def dataset_profile(spark, sf):
    p = curation.profile(c.archive_messages(spark, sf), c.archive_members(spark, sf))
    return p.withColumns({"first_sec": F.unix_seconds("first_ts"), "last_sec": F.unix_seconds("last_ts")}).drop("first_ts", "last_ts")


@query("""CTE mine AS (SELECT DISTINCT chat_id FROM fx_arc_member WHERE handle IN (7, 8)), m AS (SELECT DISTINCT id, ts, is_from_me = 0 AND handle = 7 AS voice, coalesce(text, '') AS text FROM fx_arc WHERE kind IS NULL OR kind NOT BETWEEN 2000 AND 3007),
    n AS (SELECT chat_id, count(*) AS n FROM fx_arc_member WHERE chat_id IN (SELECT chat_id FROM mine) GROUP BY chat_id)
    SELECT count(*) FILTER (voice) AS sent, count(*) FILTER (voice AND trim(text) <> '') AS sent_text, count(*) FILTER (NOT voice AND trim(text) <> '') AS received_text,
      count(*) FILTER (voice AND trim(text) = '') AS attachment_only, (SELECT count(*) FROM n WHERE n = 1) AS direct_chats, (SELECT count(*) FROM n WHERE n > 1) AS group_chats FROM m""", "fx_arc", "fx_arc_member")
def person_profile(spark, sf):
    """The audit for the voice of one person, whose handles are 7 and 8."""
    voice = (F.col("is_from_me") == 0) & (F.col("handle") == 7)
    return curation.profile(c.archive_messages(spark, sf), c.archive_members(spark, sf), voice, [7, 8]).drop("first_ts", "last_ts")
