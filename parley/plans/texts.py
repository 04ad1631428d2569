"""Queries about words, phrases, search and masking, with the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import phrases, search
from parley.plans.register import Registry
from parley.plans.scratch import new_path, shared_dir
from parley.sources import catalog as c
from parley.streaming import segments

registered = Registry()
query = registered.query
QUERIES, ORACLE = registered.queries, registered.oracle

# words of a text as the voice statistics take them, numbered
_VOICE = rf"""CTE lw AS (SELECT doc_id, sender, regexp_replace(regexp_replace(replace(lower(body), '’', ''''), '{T.VOICE_LINK}', ' ', 'g'), '{T.VOICE_MAIL}', ' ', 'g') AS t FROM fx_doc),
    ls AS (SELECT doc_id, sender, list_filter(list_transform(regexp_extract_all(t, '[a-z][a-z'']+'), lambda w: replace(w, '''', '')), lambda w: w <> '') AS ws FROM lw),
    v AS (SELECT doc_id, sender, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM ls)"""
_STOP = ["the", "and", "der", "die", "und", "que"]


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@query(f"{_VOICE} SELECT word, count(*) AS n FROM v GROUP BY word HAVING count(*) >= 3", "fx_doc")
def word_counts(spark, sf):
    return phrases.word_counts(c.document_messages(spark, sf)).where("n >= 3")


@query(f"{_VOICE} SELECT sender, count(*) AS messages, avg(length(body)) AS avg_len, sum(coalesce(len(ws), 0))::BIGINT AS tokens FROM fx_doc JOIN ls USING (doc_id, sender) GROUP BY sender", "fx_doc")
def voice_totals(spark, sf):
    return phrases.voice_totals(c.document_messages(spark, sf), ["sender"])


@query(f"""{_VOICE}, w AS (SELECT word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e, lead(word, 5) OVER o AS f FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    g AS (SELECT unnest([[a, b], [a, b, c], [a, b, c, d], [a, b, c, d, e], [a, b, c, d, e, f]]) AS s FROM w),
    k AS (SELECT s FROM g WHERE list_count(s) = len(s) AND s[1] NOT IN ({_quoted(T.PHRASE_EDGES)}) AND s[-1] NOT IN ({_quoted(T.PHRASE_EDGES)}) AND len(list_filter(s, lambda x: length(x) < 2)) = 0)
    SELECT array_to_string(s, ' ') AS phrase, count(*) AS n FROM k GROUP BY s HAVING count(*) >= 3""", "fx_doc")
def ngram_counts(spark, sf):
    return phrases.phrase_counts(c.document_messages(spark, sf), min_count=3)


@query()
def frequent_phrases(spark, sf):
    counts = phrases.phrase_counts(c.document_messages(spark, sf), min_count=phrases.MIN_COUNT)
    return phrases.frequent_phrases(counts, _STOP)


@query(f"""{_VOICE}, o AS (SELECT sender, word, count(*) AS n FROM v WHERE word NOT IN ({_quoted(_STOP)}) GROUP BY ALL), g AS (SELECT word, sum(n) AS g FROM o GROUP BY word),
    z AS (SELECT sender, sum(n) AS total FROM o GROUP BY sender), x AS (SELECT sender, word, n, (n / total::DOUBLE) / (g / (SELECT sum(n) FROM o)::DOUBLE) AS x FROM o JOIN g USING (word) JOIN z USING (sender) WHERE n >= 6),
    r AS (SELECT sender, word, n, round_even(x, 1) AS lift, row_number() OVER (PARTITION BY sender ORDER BY n * ln(x) DESC, x DESC, n DESC, word DESC)::INT AS place FROM x WHERE x >= 2.0) SELECT * FROM r WHERE place <= 12""", "fx_doc")
def distinctive_by_source(spark, sf):
    return phrases.distinctive(c.document_messages(spark, sf), "sender", stop=_STOP)


@query("""CTE w AS (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM fx_turn), n AS (SELECT role, word, count(*) AS n FROM w GROUP BY ALL),
    g AS (SELECT word, n, sum(n) OVER () AS gt FROM n WHERE role = 'user'), t AS (SELECT * FROM g ORDER BY n DESC, word LIMIT 300), p AS (SELECT word, n, sum(n) OVER () AS pt FROM n WHERE role = 'assistant'),
    j AS (SELECT coalesce(p.n, 0) / (SELECT max(pt) FROM p)::DOUBLE AS p, t.n / t.gt::DOUBLE AS g FROM t LEFT JOIN p USING (word)) SELECT sum(least(p, g)) / sum(g) AS overlap FROM j""", "fx_turn")
def vocab_overlap(spark, sf):
    t = c.conversation_turns(spark, sf)
    return phrases.vocab_overlap(phrases.vocabulary(t.where("role = 'assistant'"), "text"), phrases.vocabulary(t.where("role = 'user'"), "text"))


_POST = r"CTE tl AS (SELECT doc_id, regexp_extract_all(lower(coalesce(body, '')), '[\p{L}\p{N}]+') AS ws FROM fx_doc), tk AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM tl), dl AS (SELECT doc_id, len(ws) AS dl FROM tl)"


def _score(hits: str, every: bool, parts: int, limit: int) -> str:
    """BM25 over (part, doc_id, tf)."""
    return f"""{_POST}, {hits}, df AS (SELECT part, count(*) AS df FROM h GROUP BY part), nn AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
    s AS (SELECT h.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score, count(*) AS k FROM h JOIN df USING (part) JOIN dl USING (doc_id), nn GROUP BY h.doc_id)
    SELECT doc_id, score FROM s WHERE k >= {parts if every else 1} ORDER BY score DESC, doc_id LIMIT {limit}"""


def _index(spark, sf, columns, stemming):
    """One index for each version of the documents, which all searches share."""
    version = c.version(c.table(spark, sf, "documents"))
    return search.stored_index(c.document_messages(spark, sf), f"{shared_dir(spark)}/parley/index", version, columns=columns, stemming=stemming)


def _plain(spark, sf):
    return _index(spark, sf, ("body",), False)


_WORDS = "h AS (SELECT 0 AS part, doc_id, count(*) AS tf FROM tk WHERE term LIKE 'inonth%' GROUP BY doc_id UNION ALL SELECT 1, doc_id, count(*) FROM tk WHERE term LIKE 'with%' GROUP BY doc_id)"


@query(f"{_POST} SELECT term, count(*) AS uses, count(DISTINCT doc_id) AS docs, min(pos) - 1 AS first_pos FROM tk GROUP BY term HAVING count(*) >= 5", "fx_doc")
def postings(spark, sf):
    p = _plain(spark, sf).postings
    return p.groupBy("term").agg(F.sum("tf").alias("uses"), F.count("*").alias("docs"), F.min(F.array_min("positions")).alias("first_pos")).where("uses >= 5")


@query(_score(_WORDS, True, 2, 301), "fx_doc")
def search_and(spark, sf):
    return search.search(_plain(spark, sf), "inonth with")[0]


@query(_score(_WORDS, True, 2, 301), "fx_doc")
def search_incremental(spark, sf):
    """``search_and`` on an index that a stream fed in three increments, with a restart after each."""
    docs = c.document_messages(spark, sf).select("doc_id", "body", F.lit(None).cast("int").alias("kind"))
    source, root = new_path(spark, "search-in"), new_path(spark, "search-segments")
    store = segments.Store(spark, root, stemming=False)
    third = docs.agg(F.max("doc_id")).first()[0] // 3 + 1
    for k in range(3):
        docs.where(F.floor(F.col("doc_id") / third) == k).write.mode("append").parquet(source)
        segments.stream_index(spark.readStream.schema(docs.schema).parquet(source), store, f"{root}-checkpoint").awaitTermination()
    return search.search(store.index(), "inonth with")[0]


@query(_score(_WORDS.replace("'with%'", "'zzzz%'"), False, 2, 301), "fx_doc")
def search_or(spark, sf):
    return search.search(_plain(spark, sf), "inonth zzzz")[0]


@query(_score("h AS (SELECT 0 AS part, a.doc_id, count(*) AS tf FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id)", True, 1, 301), "fx_doc")
def search_phrase(spark, sf):
    return search.search(_plain(spark, sf), '"of the"')[0]


@query(_score("h AS (SELECT 0 AS part, doc_id, count(*) AS tf FROM tk WHERE term LIKE 'tion%' GROUP BY doc_id)", True, 1, 301), "fx_doc")
def search_prefix(spark, sf):
    return search.search(_plain(spark, sf), "tion")[0]


@query(_score("h AS (SELECT 0 AS part, doc_id, count(*) AS tf FROM tk WHERE term LIKE 'inonth%' GROUP BY doc_id UNION ALL SELECT 1, a.doc_id, count(*) FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'by' AND b.term = 'the' GROUP BY a.doc_id)", False, 2, 21), "fx_doc")
def bm25_topk(spark, sf):
    index = _plain(spark, sf)
    return search.match(index, search.parts_of('"by the" inonth', False), every=False).orderBy(F.desc("score"), "doc_id").limit(21)


@query()
def search_stemmed(spark, sf):
    return search.search(_index(spark, sf, ("body", "sender"), True), "ratings éch")[0]


@query("""CTE f AS (SELECT doc_id, body, instr(lower(body), 'with') AS place FROM fx_doc WHERE contains(lower(body), 'with')), s AS (SELECT doc_id, body, greatest(place - 50, 1) AS st FROM f)
    SELECT doc_id, concat(CASE WHEN st > 1 THEN '…' ELSE '' END, replace(replace(replace(replace(replace(substr(body, st, 220), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), CASE WHEN st + 220 <= length(body) THEN '…' ELSE '' END) AS snippet FROM s""", "fx_doc")
def snippet(spark, sf):
    docs = c.document_messages(spark, sf).where(F.contains(F.lower("body"), F.lit("with")))
    return docs.select("doc_id", search.snippet(F.col("body"), ["with"], mark=False).alias("snippet"))


@query(r"SELECT doc_id, len(regexp_extract_all(body, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS emails FROM fx_doc", "fx_doc")
def redact_counts(spark, sf):
    docs = c.document_messages(spark, sf)
    masks = F.regexp_count(T.redact(F.col("body")), F.lit(r"\[email\]")) - F.regexp_count("body", F.lit(r"\[email\]"))
    return docs.select("doc_id", masks.alias("emails"))


@query()
def redact_all(spark, sf):
    docs = c.document_messages(spark, sf).select("doc_id", T.redact(F.col("body")).alias("masked"))
    count = {m: F.regexp_count("masked", F.lit(rf"\[{m}\]")).alias(m) for m in ("email", "password", "card", "phone", "address", "code")}
    return docs.select("doc_id", F.sha2(F.col("masked").cast("binary"), 256).alias("sha256"), *count.values())


@query(rf"""SELECT chat_id, msg_no, trim(text) = '' OR lower(trim(text)) IN ({_quoted(a for a in T.ACKS if a.isascii())}) OR trim(regexp_replace(lower(trim(text)), '[^\w\s]+', '', 'g')) IN ({_quoted(a for a in T.ACKS if a.isascii())})
    OR (len(regexp_split_to_array(trim(text), '\s+')) <= 2 AND length(trim(text)) <= 12) AS low_signal, regexp_matches(trim(text), '(?i)^https?://\S+$') AS link_only FROM fx_turn""", "fx_turn")
def low_signal(spark, sf):
    return c.conversation_turns(spark, sf).select("chat_id", "msg_no", T.is_low_signal(F.col("text")).alias("low_signal"), T.is_link_only(F.col("text")).alias("link_only"))


@query(r"""CTE p AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'Loved “' || p_name || '”' WHEN p_size % 4 = 1 THEN 'loved that set' WHEN p_size % 4 = 2 THEN 'You unsent a message' ELSE p_name END AS t, p_size FROM part) SELECT id, p_size % 4 IN (0, 2) AS artifact FROM p""".replace("CTE p", "WITH p"))
def artifact_flags(spark, sf):
    k, name = F.col("p_size") % 4, F.col("p_name")
    t = F.when(k == 0, F.concat(F.lit("Loved “"), name, F.lit("”"))).when(k == 1, "loved that set").when(k == 2, "You unsent a message").otherwise(name)
    return c.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.is_artifact(t).alias("artifact"))


@query("""SELECT c_custkey AS id, 'phone:' || right(regexp_replace('+1 (555) ' || CAST(c_custkey + 1000000 AS VARCHAR), '[^0-9]', '', 'g'), 10) AS phone, 'email:' || lower(c_name || '@X.com') AS email, left(sha1('email:' || lower(c_name || '@X.com')), 16) AS person FROM customer""")
def handle_keys(spark, sf):
    phone = F.concat(F.lit("+1 (555) "), (F.col("c_custkey") + 1000000).cast("string"))
    mail = F.concat(F.lit(" "), F.col("c_name"), F.lit("@X.com "))
    return c.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.handle_key(phone).alias("phone"), T.handle_key(mail).alias("email"), T.person_id(T.handle_key(mail)).alias("person"))
