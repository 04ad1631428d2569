"""Queries about turns, training sets, retrieval and scores, with the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import scores as S
from parley.functions import text as T
from parley.operators import curation, retrieval, scoring, turns
from parley.plans.register import Registry
from parley.plans.scratch import save
from parley.sources import catalog as c

registered = Registry()
query = registered.query
QUERIES, ORACLE = registered.queries, registered.oracle

def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_TURNS = """CTE b AS (SELECT * FROM fx_turn WHERE trim(text) <> ''), f AS (SELECT *, CASE WHEN lag(role) OVER w = role AND sec - lag(sec) OVER w <= 1800 THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY chat_id ORDER BY msg_no)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY chat_id ORDER BY msg_no)::BIGINT AS turn_no FROM f),
    t AS (SELECT chat_id, turn_no, min(role) AS role, string_agg(text, '※' ORDER BY msg_no) AS content, arg_max(sec, msg_no) AS sec, max(msg_no) AS msg_no FROM n GROUP BY chat_id, turn_no),
    s AS (SELECT *, (1 + sum(CASE WHEN sec - ls > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY turn_no))::BIGINT AS session_no FROM (SELECT *, lag(sec) OVER (PARTITION BY chat_id ORDER BY turn_no) AS ls FROM t)),
    a AS (SELECT *, lag(role) OVER v AS pr, lag(content) OVER v AS pc, lag(turn_no) OVER v AS pt, count(*) FILTER (role = 'user') OVER (PARTITION BY chat_id, session_no ORDER BY turn_no ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS users FROM s WINDOW v AS (PARTITION BY chat_id, session_no ORDER BY turn_no)),
    x AS (SELECT * FROM a WHERE role = 'assistant' AND pr = 'user')"""


def _turns(spark, sf):
    return turns.collapse_turns(c.conversation_turns(spark, sf))


def _sessions(spark, sf):
    return turns.sessionize(_turns(spark, sf))


def _examples(spark, sf):
    return turns.context_windows(_sessions(spark, sf))


@query(f"{_TURNS} SELECT * FROM t", "fx_turn")
def turns_collapsed(spark, sf):
    return _turns(spark, sf)


@query(f"{_TURNS} SELECT chat_id, turn_no, role, content, sec, msg_no, session_no FROM s", "fx_turn")
def turn_sessions(spark, sf):
    return _sessions(spark, sf)


@query(f"{_TURNS} SELECT chat_id, session_no, turn_no, sec, msg_no, pc AS query, content AS reply FROM x", "fx_turn")
def context_windows(spark, sf):
    return _examples(spark, sf).drop("messages")


@query()
def context_messages(spark, sf):
    return turns.laddered_windows(_sessions(spark, sf)).select("chat_id", "turn_no", F.to_json("messages").alias("messages"))


@query(f"{_TURNS} SELECT chat_id, session_no, turn_no, sec, msg_no, content AS reply FROM a WHERE role = 'assistant' AND (pr IS NULL OR pr <> 'user')", "fx_turn")
def openers(spark, sf):
    return turns.openers(_sessions(spark, sf)).drop("messages")


@query("""CTE g AS (SELECT chat_id, list(role ORDER BY msg_no) AS r FROM fx_turn GROUP BY chat_id)
    SELECT chat_id, r[1] = 'user' AND r[-1] = 'assistant' AND len(list_filter(list_zip(r[1:-2], r[2:]), lambda z: z[1] = z[2])) = 0 AS ok FROM g""", "fx_turn")
def alternating(spark, sf):
    msgs = F.transform(F.array_sort(F.collect_list(F.struct("msg_no", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return c.conversation_turns(spark, sf).groupBy("chat_id").agg(msgs.alias("m")).select("chat_id", turns.is_alternating(F.col("m")).alias("ok"))


@query(f"""{_TURNS}, u AS (SELECT chat_id, session_no, min(sec) AS ats FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY ats, chat_id, session_no) AS rn, count(*) OVER () AS n FROM u)
    SELECT x.chat_id, x.session_no, turn_no, CASE WHEN rn <= n - greatest(1, round_even(n * 0.1::DOUBLE, 0)) - greatest(1, round_even(n * (1 - 0.8::DOUBLE - 0.1::DOUBLE), 0)) THEN 'train' WHEN rn <= n - greatest(1, round_even(n * (1 - 0.8::DOUBLE - 0.1::DOUBLE), 0)) THEN 'valid' ELSE 'test' END AS split FROM x JOIN r USING (chat_id, session_no)""", "fx_turn")
def split_chrono(spark, sf):
    return curation.split_chrono(_examples(spark, sf), ["chat_id", "session_no"]).select("chat_id", "session_no", "turn_no", "split")


@query()
def split_stratified(spark, sf):
    return curation.split_stratified(_examples(spark, sf)).select("chat_id", "session_no", "turn_no", "split")


@query("""CTE r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id DESC) AS k FROM fx_doc), l AS (SELECT *, length(trim(body)) <= 12 AND len(regexp_split_to_array(trim(body), '\\s+')) <= 2 AS low FROM r)
    SELECT doc_id FROM l WHERE k <= CASE WHEN low THEN 2 ELSE 4 END""", "fx_doc")
def cap_duplicates(spark, sf):
    docs = c.document_messages(spark, sf).select(F.col("body").alias("reply"), F.col("doc_id").alias("sec"), F.col("doc_id").alias("msg_no"), "doc_id")
    return curation.cap_duplicates(docs).select("doc_id")


@query("CTE g AS (SELECT body, count(*) AS n FROM fx_doc GROUP BY body), t AS (SELECT n FROM g ORDER BY n DESC, body LIMIT 20) SELECT count(*) AS \"unique\", (SELECT sum(n) FROM t) / sum(n)::DOUBLE AS top_share FROM g", "fx_doc")
def target_concentration(spark, sf):
    return curation.target_concentration(c.document_messages(spark, sf), "body")


@query("SELECT count(*) AS n, count(*) FILTER (length(trim(text)) <= 12 AND len(regexp_split_to_array(trim(text), '\\s+')) <= 2) AS low FROM fx_turn", "fx_turn")
def low_signal_share(spark, sf):
    return curation.low_signal_share(c.conversation_turns(spark, sf), "text")


_LOW = rf"""trim(text) = '' OR lower(trim(text)) IN ({_quoted(a for a in T.ACKS if a.isascii())}) OR trim(regexp_replace(lower(trim(text)), '[^\w\s]+', '', 'g')) IN ({_quoted(a for a in T.ACKS if a.isascii())})
    OR (len(regexp_split_to_array(trim(text), '\s+')) <= 2 AND length(trim(text)) <= 12)"""


@query(f"""CTE l AS (SELECT *, {_LOW} AS low FROM fx_turn), r AS (SELECT count(*) FILTER (NOT low) AS room FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY sec DESC, msg_no DESC) AS rn FROM l)
    SELECT chat_id, msg_no FROM k, r WHERE NOT low OR rn <= floor(0.2::DOUBLE * room / (1 - 0.2::DOUBLE))""", "fx_turn")
def low_signal_capped(spark, sf):
    t = c.conversation_turns(spark, sf).withColumn("reply", F.col("text"))
    return curation.cap_low_signal_share(t, 0.2).select("chat_id", "msg_no")


@query()
def reject_reasons(spark, sf):
    return curation.reject_counts(_examples(spark, sf))


@query()
def recency_sample(spark, sf):
    return curation.downsample_recency(_examples(spark, sf), ["chat_id", "msg_no"], half_life=30.0).select("chat_id", "msg_no")


@query()
def multiturn_sample(spark, sf):
    ex = save(_examples(spark, sf), "examples")
    return curation.depth_sample(ex, ["chat_id", "turn_no"], F.size("messages")).select("chat_id", "turn_no", "bucket", "depth")


@query("""CTE o AS (SELECT o_orderkey AS msg_id, o_custkey % 7 AS a, o_custkey % 5 AS b FROM orders), u AS (SELECT msg_id, a AS chat_id FROM o UNION ALL SELECT msg_id, b FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY -chat_id, chat_id) AS k FROM u) SELECT msg_id, chat_id FROM r WHERE k = 1""".replace("CTE o", "WITH o"))
def first_chat(spark, sf):
    o = c.table(spark, sf, "orders")
    m = o.select(F.col("o_orderkey").alias("msg_id"), (F.col("o_custkey") % 7).alias("chat_id")).unionByName(o.select(F.col("o_orderkey").alias("msg_id"), (F.col("o_custkey") % 5).alias("chat_id")))
    rank = m.select("chat_id").distinct().withColumn("rank", -F.col("chat_id"))
    return curation.first_chat(m, rank).select("msg_id", "chat_id")


def _pairs(ex):
    return ex.select((F.col("chat_id") * 1000 + F.col("turn_no")).alias("id"), "query", "reply", F.lit("").alias("peer"), "sec")


@query(f"""{_TURNS}, i AS (SELECT chat_id * 1000 + turn_no AS id, pc AS query, sec, list_distinct(regexp_extract_all(lower(pc), '[a-z0-9'']+')) AS w FROM x), tk AS (SELECT id, len(w) AS n, unnest(w) AS tok FROM i),
    m AS (SELECT a.id AS qid, b.id, a.n AS qn, b.n AS rn, count(*) AS inter FROM tk a JOIN tk b USING (tok) GROUP BY ALL),
    z AS (SELECT m.qid, m.id, inter / (sqrt(qn) * sqrt(rn)) * (0.5::DOUBLE + 0.5::DOUBLE * pow(0.5::DOUBLE, ((SELECT max(sec) FROM i) - r.sec) / 86400.0::DOUBLE / 365.0::DOUBLE)) AS score, r.query FROM m JOIN i q ON q.id = m.qid JOIN i r ON r.id = m.id WHERE q.query <> r.query),
    k AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, query, id)::INT AS place FROM z) SELECT * FROM k WHERE place <= 2""", "fx_turn")
def retrieve_topk(spark, sf):
    index = save(retrieval.index_rows(_pairs(_examples(spark, sf))), "retrieval-index")
    return retrieval.retrieve(index.select(F.col("id").alias("qid"), "query", "peer"), index)


@query()
def retrieved_shots(spark, sf):
    ex = save(_examples(spark, sf).withColumn("qid", F.col("chat_id") * 1000 + F.col("turn_no")), "examples")
    index = save(retrieval.index_rows(_pairs(ex)), "retrieval-index")
    found = retrieval.retrieve(index.select(F.col("id").alias("qid"), "query", "peer", F.array("reply").alias("exclude_replies")), index)
    return retrieval.with_shots(ex, found, index).select("qid", F.size("messages").alias("messages"))


def _predictions(spark, sf):
    """Each reply, predicted by the message before it."""
    return _examples(spark, sf).select(
        (F.col("chat_id") * 1000 + F.col("turn_no")).alias("id"), F.col("query").alias("pred"), F.col("reply").alias("gold"), F.col("query").alias("prompt"),
        (F.col("chat_id") % 10).cast("string").alias("peer"), F.col("turn_no").alias("turn"), F.size("messages").alias("depth"),
    )


@query(f"""{_TURNS}, p AS (SELECT chat_id * 1000 + turn_no AS id, lower(pc) AS pred, lower(content) AS gold FROM x), r AS (SELECT unnest(range(1, 7)) AS n),
    u AS (SELECT id, n, 0 AS side, unnest(list_transform(range(1, greatest(1, length(pred) - n + 1) + 1), lambda i: substr(pred, i, n))) AS g FROM p, r UNION ALL SELECT id, n, 1, unnest(list_transform(range(1, greatest(1, length(gold) - n + 1) + 1), lambda i: substr(gold, i, n))) FROM p, r),
    k AS (SELECT id, n, g, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM u GROUP BY ALL), sc AS (SELECT id, n, sum(least(a, b)) / sum(a)::DOUBLE AS p, sum(least(a, b)) / sum(b)::DOUBLE AS r FROM k GROUP BY ALL),
    sf AS (SELECT id, sum(p) / 6 AS p, sum(r) / 6 AS r FROM sc GROUP BY id) SELECT id, CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS chrf FROM sf""", "fx_turn")
def chrf(spark, sf):
    return _predictions(spark, sf).select("id", S.chrf("pred", "gold").alias("chrf"))


@query()
def rouge_l(spark, sf):
    return _predictions(spark, sf).select("id", S.rouge_l("pred", "gold").alias("rouge_l"))


@query()
def ranking_score(spark, sf):
    return scoring.scored(_predictions(spark, sf)).select("id", "chrf", "rouge_l", "len_ratio", "copied", "exact", "score")


@query(f"""{_TURNS} SELECT chat_id * 1000 + turn_no AS id, length(pc) / greatest(length(content), 1)::DOUBLE AS len_ratio, pc = content AS exact FROM x""", "fx_turn")
def length_ratio(spark, sf):
    p = _predictions(spark, sf)
    return p.select("id", (F.char_length("pred") / F.greatest(F.char_length("gold"), F.lit(1))).alias("len_ratio"), (F.col("pred") == F.col("gold")).alias("exact"))


@query(r"""SELECT chat_id, msg_no, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS words, regexp_matches(text, '[.!?]$') AS ends_punct,
    len(regexp_extract_all(text, '[\x{1f300}-\x{1faff}\x{2700}-\x{27bf}\x{1f1e0}-\x{1f1ff}]+'))::INT AS emoji FROM fx_turn""", "fx_turn")
def text_stats(spark, sf):
    stats = scoring.text_stats(F.col("text"))
    return c.conversation_turns(spark, sf).select("chat_id", "msg_no", *(stats[k].alias(k) for k in ("chars", "words", "ends_punct", "emoji")))


@query()
def style_features(spark, sf):
    return scoring.style_features(c.conversation_turns(spark, sf).where("role = 'assistant'"), "text")


@query()
def style_distance(spark, sf):
    return scoring.style_distance(_predictions(spark, sf), incoming="prompt")


@query()
def degenerate(spark, sf):
    t = c.conversation_turns(spark, sf)
    return t.select("chat_id", "msg_no", S.degenerate("text").alias("spam"), S.trimmed(F.repeat("text", F.lit(4))).alias("trimmed"))


@query(f"""{_TURNS}, j AS (SELECT x.chat_id, x.turn_no AS t, s.turn_no, s.role FROM x JOIN s ON s.chat_id = x.chat_id AND s.session_no = x.session_no AND s.turn_no BETWEEN x.turn_no - 9 AND x.turn_no - 1),
    u AS (SELECT *, min(CASE WHEN role = 'user' THEN turn_no END) OVER (PARTITION BY chat_id, t) AS lead FROM j), d AS (SELECT *, lag(role) OVER (PARTITION BY chat_id, t ORDER BY turn_no) AS before FROM u WHERE turn_no >= lead),
    e AS (SELECT chat_id, t, (1 + count(*) FILTER (before IS NULL OR before <> role))::INT AS depth FROM d GROUP BY ALL), y AS (SELECT least(turn_no, 5) AS turn, depth, length(content) AS v FROM x JOIN e ON e.chat_id = x.chat_id AND e.t = x.turn_no)
    SELECT coalesce(turn, -1) AS turn, coalesce(depth, -1) AS depth, count(*) AS n, avg(v) AS mean FROM y GROUP BY GROUPING SETS ((turn), (depth), ())""", "fx_turn")
def summarize_by_turn_depth(spark, sf):
    rows = _predictions(spark, sf).withColumn("v", F.char_length("gold"))
    return scoring.by_turn_and_depth(rows, "v").withColumns({k: F.coalesce(k, F.lit(-1)) for k in ("turn", "depth")})


@query(f"""{_TURNS}, y AS (SELECT CAST(chat_id % 10 AS VARCHAR) AS peer, length(content) AS v FROM x) SELECT peer, count(*) AS n, avg(v) AS mean FROM y GROUP BY peer HAVING count(*) >= 2""", "fx_turn")
def by_recipient(spark, sf):
    return scoring.by_recipient(_predictions(spark, sf).withColumn("score", F.char_length("gold")))


@query("""CTE r AS (SELECT CASE WHEN chat_id % 6 > 0 THEN CAST(chat_id % 6 AS VARCHAR) END AS peer, text AS t, length(text) AS v FROM fx_turn), m AS (SELECT peer, avg(v) AS m FROM r WHERE peer IS NOT NULL GROUP BY peer HAVING count(*) >= 2),
    n AS (SELECT peer, t, count(*) AS n FROM r WHERE peer IS NOT NULL GROUP BY ALL), e AS (SELECT peer, arg_min(t, ROW(-n, t)) AS t FROM n GROUP BY peer), g AS (SELECT arg_min(t, ROW(-n, t)) AS t FROM (SELECT t, count(*) AS n FROM r GROUP BY t))
    SELECT (SELECT count(*) FROM e) AS peers, (SELECT max(m) - min(m) FROM m) AS peer_score_range, (SELECT avg(CASE WHEN e.t = g.t THEN 1.0::DOUBLE ELSE 0 END) FROM e, g) AS peer_mode_collapse""", "fx_turn")
def recipient_summary(spark, sf):
    rows = c.conversation_turns(spark, sf).select(F.when(F.col("chat_id") % 6 > 0, (F.col("chat_id") % 6).cast("string")).alias("peer"), F.col("text").alias("pred"), F.char_length("text").alias("score"))
    return scoring.recipient_summary(rows)


@query("""CTE l AS (SELECT chat_id, coalesce(list(text ORDER BY msg_no) FILTER (role = 'user'), []) AS asked, coalesce(list(text ORDER BY msg_no) FILTER (role = 'assistant'), []) AS said FROM fx_turn GROUP BY chat_id)
    SELECT chat_id, (i - 1)::INT AS place, asked[i] AS asked, said[i] AS said, NULL AS error FROM l, generate_series(1, len(asked)) g(i) WHERE len(asked) = len(said)
    UNION ALL SELECT chat_id, NULL, NULL, NULL, 'lengths differ: asked ' || len(asked) || ', said ' || len(said) FROM l WHERE len(asked) <> len(said)""", "fx_turn")
def zipped_lists(spark, sf):
    """Questions and answers of each chat side by side."""
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("msg_no", "text")))), lambda x: x["text"])
    rows = c.conversation_turns(spark, sf).groupBy("chat_id").agg(of("user").alias("asked"), of("assistant").alias("said"))
    return scoring.zip_lists(rows, "chat_id", ["asked", "said"])


@query("CTE g AS (SELECT text AS t, count(*) AS n FROM fx_turn GROUP BY 1) SELECT arg_min(t, ROW(-n, t)) AS text, max(n) / sum(n)::DOUBLE AS share FROM g", "fx_turn")
def modal_share(spark, sf):
    return scoring.modal_share(c.conversation_turns(spark, sf).withColumn("pred", F.col("text")))


@query(r"""CTE w AS (SELECT chat_id, msg_no, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM fx_turn), t AS (SELECT chat_id, msg_no, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM w),
    g AS (SELECT a, lead(a) OVER (PARTITION BY chat_id, msg_no ORDER BY p) AS b FROM t) SELECT count(DISTINCT a || ' ' || b) / count(*)::DOUBLE AS "distinct" FROM g WHERE b IS NOT NULL""", "fx_turn")
def distinct_bigrams(spark, sf):
    return scoring.distinct_ngrams(c.conversation_turns(spark, sf), "text")


@query()
def bootstrap_ci(spark, sf):
    return scoring.bootstrap(_predictions(spark, sf).withColumn("v", F.char_length("gold")), "v", "id")


@query()
def paired_win_rate(spark, sf):
    rows = _predictions(spark, sf).withColumns({"a": F.char_length("gold"), "b": F.char_length("pred")})
    return scoring.paired_win_rate(rows, "a", "b", "id")


@query()
def metric_probes(spark, sf):
    probes = scoring.probes(_predictions(spark, sf).select("id", "gold"))
    gold = _predictions(spark, sf).select("id", F.col("gold").alias("truth"))
    return probes.join(gold, "id").select("id", "kind", S.chrf("text", "truth").alias("chrf"))


@query("""WITH r AS (SELECT p_brand AS setting, p_size AS step, min(p_retailprice) AS distance FROM part GROUP BY ALL), b AS (SELECT setting, count(DISTINCT step) AS steps, arg_min(step, ROW(distance, step)) AS step, min(distance) AS distance FROM r GROUP BY setting)
    SELECT setting, step, distance FROM b ORDER BY CASE WHEN steps < 2 THEN 1 ELSE 0 END, distance, setting LIMIT 1""")
def promote_best(spark, sf):
    runs = c.table(spark, sf, "part").groupBy(F.col("p_brand").alias("setting"), F.col("p_size").alias("step")).agg(F.min("p_retailprice").alias("distance"))
    return scoring.promote(runs)




@query(r"""CTE r AS (SELECT chat_id, msg_no, '<think>' || role || '</think> ' || text || ' ※' || role || '※ ※ [phone]※' || text || '※x<|im_end|>' AS t FROM fx_turn),
    s AS (SELECT *, regexp_replace(regexp_replace(t, '<think>.*?</think>|<\|im_end\|>', '', 'gs'), '^\s+|\s+$', '', 'g') AS plain FROM r),
    b AS (SELECT *, list_filter(list_transform(string_split(plain, '※'), lambda x: trim(x, E' \n\t\r')), lambda x: x <> '') AS parts FROM s)
    SELECT chat_id, msg_no, array_to_string(parts[1:4], '※') AS clipped, len(parts) AS bubbles, contains(plain, '[phone]') AS masked, false AS only_masks FROM b""", "fx_turn")
def clean_replies(spark, sf):
    """Replies as a model writes them: scaffold taken away, four bubbles at most, masks noticed."""
    raw = F.concat(F.lit("<think>"), "role", F.lit("</think> "), "text", F.lit(" ※"), "role", F.lit("※ ※ [phone]※"), "text", F.lit("※x<|im_end|>"))
    rows = c.conversation_turns(spark, sf).withColumn("plain", T.strip_scaffold(raw))
    return rows.select(
        "chat_id", "msg_no", T.clip_bubbles(F.col("plain")).alias("clipped"), F.size(T.split_bubbles(F.col("plain"))).cast("long").alias("bubbles"),
        T.contains_redaction(F.col("plain")).alias("masked"), T.is_redaction_only(F.col("plain")).alias("only_masks"),
    )
