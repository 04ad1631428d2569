"""Queries about volumes, sessions, tapbacks, threads, media and circles, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import timing
from parley.operators import circles, media, paging, people, sessions, tapbacks, threads
from parley.plans.register import Registry
from parley.sources import catalog as c

registered = Registry()
query = registered.query
QUERIES, ORACLE = registered.queries, registered.oracle

_MONTH = "strftime(ts, '%Y-%m')"
_INBOUND = f"CTE m AS (SELECT person, {_MONTH} AS month, count(*) AS n FROM fx_msg_ord WHERE is_from_me = 0 GROUP BY ALL)"
_SESSION = """CTE l AS (SELECT *, lag(ts) OVER (PARTITION BY handle ORDER BY ts, id) AS p FROM fx_msg_ev),
    s AS (SELECT handle, ts, id, is_from_me AS opener FROM l WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > 14400000000)"""
_GAPS = """CTE l AS (SELECT *, lag(is_from_me) OVER (PARTITION BY handle ORDER BY ts, id) AS pm FROM fx_msg_ev),
    r AS (SELECT handle, ts, id, is_from_me, lag(ts) OVER (PARTITION BY handle ORDER BY ts, id) AS p FROM l WHERE pm IS NULL OR pm <> is_from_me),
    g AS (SELECT handle, ts, id, (epoch_us(ts) - epoch_us(p)) / 1000000.0::DOUBLE AS seconds, is_from_me FROM r WHERE p IS NOT NULL AND epoch_us(ts) - epoch_us(p) <= 86400000000)"""
_CONTACT = """CTE i AS (SELECT handle, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_msg_ord WHERE is_from_me = 0 GROUP BY handle),
    s AS (SELECT *, (epoch_us(last_ts) - epoch_us(first_ts)) // 86400000000 AS span_days,
          ((SELECT epoch_us(max(ts)) FROM fx_msg_ord) - epoch_us(last_ts)) // 86400000000 AS gap_days FROM i)"""


@query("SELECT count(*) AS messages, count(DISTINCT chat_id) AS chats, min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / (365.0::DOUBLE * 86400000000) AS years FROM fx_msg_ev", "fx_msg_ev")
def archive_totals(spark, sf):
    return people.archive_totals(c.event_messages(spark, sf))


@query(f"{_CONTACT} SELECT * FROM s", "fx_msg_ord")
def contact_stats(spark, sf):
    return people.contact_stats(c.order_messages(spark, sf))


@query(f"""{_CONTACT}, ct AS (SELECT handle, count(DISTINCT chat_id) AS chat_count FROM fx_member GROUP BY handle), mk AS (SELECT chat_id, count(*) AS members FROM fx_member GROUP BY chat_id),
    mo AS (SELECT m.handle, m.chat_id, row_number() OVER (PARTITION BY m.handle ORDER BY (members = 1) DESC, n DESC, m.chat_id) AS rn FROM fx_member m JOIN mk USING (chat_id) JOIN fx_chat_n USING (chat_id))
    SELECT s.*, coalesce(chat_count, 1) AS chat_count, mo.chat_id FROM s LEFT JOIN ct USING (handle) LEFT JOIN mo ON mo.handle = s.handle AND rn = 1""", "fx_msg_ord", "fx_member", "fx_chat_n")
def contact_cards(spark, sf):
    return people.contact_cards(people.contact_stats(c.order_messages(spark, sf)), c.order_members(spark, sf), c.order_chat_sizes(spark, sf))


@query(f"{_CONTACT} SELECT * FROM s WHERE span_days >= 365 AND gap_days <= 90 ORDER BY n DESC, handle LIMIT 10", "fx_msg_ord")
def long_term(spark, sf):
    return people.long_term(people.contact_stats(c.order_messages(spark, sf)))


@query(f"{_CONTACT} SELECT * FROM s WHERE n >= 5 AND gap_days >= 180 ORDER BY n DESC, handle LIMIT 10", "fx_msg_ord")
def fell_off(spark, sf):
    return people.fell_off(people.contact_stats(c.order_messages(spark, sf)), count=5)


@query("""CTE i AS (SELECT handle, count(*) AS n FROM fx_msg_ev WHERE is_from_me = 0 GROUP BY handle ORDER BY n DESC, handle LIMIT 15)
    SELECT handle, n, round_even(n * 100.0::DOUBLE / (SELECT max(n) FROM i), 1) AS pct FROM i""", "fx_msg_ev")
def leaderboard(spark, sf):
    return people.leaderboard(people.contact_stats(c.event_messages(spark, sf)))


@query("""CTE k AS (SELECT chat_id, count(*) AS members FROM fx_member GROUP BY chat_id),
    r AS (SELECT m.handle, m.chat_id, CAST(k.members = 1 AS INT) AS is_dm, n.n FROM fx_member m JOIN k USING (chat_id) JOIN fx_chat_n n USING (chat_id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY is_dm DESC, n DESC, chat_id) AS rn FROM r)
    SELECT handle, chat_id, is_dm, n FROM o WHERE rn = 1""", "fx_member", "fx_chat_n")
def best_chat(spark, sf):
    return people.best_chats(c.order_members(spark, sf), c.order_chat_sizes(spark, sf))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS "all", count(*) FILTER (is_from_me = 0) AS recv, count(*) FILTER (is_from_me = 1) AS sent FROM fx_msg_ev GROUP BY 1""", "fx_msg_ev")
def heatmap_day(spark, sf):
    return people.heatmap(c.event_messages(spark, sf)).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).pivot("mode", ["all", "recv", "sent"]).agg(F.sum("n"))


@query("""CTE d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS "all", count(*) FILTER (is_from_me = 0) AS recv, count(*) FILTER (is_from_me = 1) AS sent FROM fx_msg_ev GROUP BY 1),
    u AS (UNPIVOT d ON "all", recv, sent INTO NAME mode VALUE n), x AS (SELECT *, max(n) OVER (PARTITION BY mode)::DOUBLE AS most FROM u)
    SELECT strftime(day, '%Y-%m-%d') AS day, mode, n, CASE WHEN n = 0 THEN 0 WHEN n <= most * 0.25 THEN 1 WHEN n <= most * 0.5 THEN 2 WHEN n <= most * 0.75 THEN 3 ELSE 4 END AS level,
    strftime(day - CAST(dayofweek(day) AS INT), '%Y-%m-%d') AS week_start FROM x""", "fx_msg_ev")
def heatmap_levels(spark, sf):
    return people.heatmap(c.event_messages(spark, sf)).withColumns({k: F.date_format(k, "yyyy-MM-dd") for k in ("day", "week_start")})


@query(f"SELECT {_MONTH} AS month, count(*) FILTER (is_from_me = 0) AS received, count(*) FILTER (is_from_me = 1) AS sent FROM fx_msg_ord GROUP BY 1", "fx_msg_ord")
def monthly_counts(spark, sf):
    return people.monthly_counts(c.order_messages(spark, sf))


@query(f"""{_INBOUND}, b AS (SELECT date_trunc('month', min(ts)) AS a, date_trunc('month', max(ts)) AS z FROM fx_msg_ord WHERE is_from_me = 0),
    sp AS (SELECT strftime(unnest(generate_series(a, z, INTERVAL 1 month)), '%Y-%m') AS month FROM b), p AS (SELECT DISTINCT person FROM m)
    SELECT p.person, sp.month, coalesce(m.n, 0) AS n FROM p CROSS JOIN sp LEFT JOIN m ON m.person = p.person AND m.month = sp.month""", "fx_msg_ord")
def monthly_by_person(spark, sf):
    return people.monthly_by_person(c.order_messages(spark, sf))


@query("""CTE b AS (SELECT date_trunc('month', min(ts)) AS a, date_trunc('month', max(ts)) AS z FROM fx_msg_ord) SELECT strftime(unnest(generate_series(a, z, INTERVAL 1 month)), '%Y-%m') AS month FROM b""", "fx_msg_ord")
def month_spine(spark, sf):
    return people.month_spine(c.order_messages(spark, sf))


@query("""CTE h AS (SELECT person, handle, count(*) AS n FROM fx_msg_ord WHERE is_from_me = 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, handle) AS rn, sum(n) OVER (PARTITION BY person) AS total FROM h) SELECT person, handle, total::BIGINT AS total FROM r WHERE rn = 1""", "fx_msg_ord")
def dominant_handles(spark, sf):
    return people.dominant_handles(c.order_messages(spark, sf))


@query(f"""{_INBOUND}, r AS (SELECT *, sum(n) OVER (PARTITION BY person) AS total, row_number() OVER (PARTITION BY person ORDER BY n DESC, month) AS rn FROM m)
    SELECT person, total::BIGINT AS total, month AS peak_month, n AS peak_n FROM r WHERE rn = 1 ORDER BY total DESC, person LIMIT 8""", "fx_msg_ord")
def people_peak(spark, sf):
    return people.people_peaks(c.order_messages(spark, sf))


@query(f"""{_INBOUND}, s AS (SELECT *, n / sum(n) OVER (PARTITION BY month)::DOUBLE AS share, sum(n) OVER (PARTITION BY person) AS total FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY share DESC, month) AS rn FROM s) SELECT person, total::BIGINT AS total, month AS peak_month, share AS peak_share FROM r WHERE rn = 1 AND total >= 250""", "fx_msg_ord")
def people_eras(spark, sf):
    return people.people_eras(c.order_messages(spark, sf))


_DRIFT = f"""{_INBOUND}, b AS (SELECT date_trunc('month', min(ts)) AS a, date_trunc('month', max(ts)) AS z FROM fx_msg_ord WHERE is_from_me = 0),
    sp AS (SELECT strftime(unnest(generate_series(a, z, INTERVAL 1 month)), '%Y-%m') AS month FROM b), k AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS back FROM sp),
    e AS (SELECT person, sum(CASE WHEN back > 12 THEN n ELSE 0 END) AS prev, sum(CASE WHEN back <= 12 THEN n ELSE 0 END) AS recent FROM m JOIN k USING (month) WHERE back <= 24 GROUP BY person),
    d AS (SELECT person, prev::BIGINT AS prev, recent::BIGINT AS recent, prev / (SELECT sum(prev) FROM e)::DOUBLE AS share_prev, recent / (SELECT sum(recent) FROM e)::DOUBLE AS share_now FROM e WHERE prev + recent >= 100),
    f AS (SELECT *, share_now - share_prev AS drift FROM d)"""


@query(f"{_DRIFT} SELECT * FROM f WHERE drift > 0 ORDER BY drift DESC, person LIMIT 5", "fx_msg_ord")
def drift_rising(spark, sf):
    return people.rising(people.people_drift(c.order_messages(spark, sf), min_messages=100))


@query(f"{_DRIFT} SELECT * FROM f WHERE drift < 0 ORDER BY drift, person DESC LIMIT 5", "fx_msg_ord")
def drift_faded(spark, sf):
    return people.faded(people.people_drift(c.order_messages(spark, sf), min_messages=100))


@query(f"""{_INBOUND}, y AS (SELECT substr(month, 1, 4) AS year, person, sum(n) AS n FROM m GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY year)::DOUBLE AS alln, row_number() OVER (PARTITION BY year ORDER BY n DESC, person) AS rn FROM y) SELECT year, person, n::BIGINT AS n, n / alln AS share FROM r WHERE rn = 1""", "fx_msg_ord")
def year_owners(spark, sf):
    return people.year_owners(c.order_messages(spark, sf))


@query(f"{_INBOUND}, s AS (SELECT month, n / sum(n) OVER (PARTITION BY month)::DOUBLE AS p FROM m) SELECT month, 1 / sum(p * p) AS people FROM s GROUP BY month", "fx_msg_ord")
def effective_people(spark, sf):
    return people.effective_people(c.order_messages(spark, sf))


@query(f"{_SESSION} SELECT * FROM s", "fx_msg_ev")
def session_starts(spark, sf):
    return sessions.sessions(c.event_messages(spark, sf))


@query(f"""{_SESSION}, n AS (SELECT handle, count(*) AS n FROM s GROUP BY handle), t AS (SELECT l.*, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY handle ORDER BY ts, id) AS k FROM l)
    SELECT handle, min(ts) AS ts, count(*) AS n, arg_min(is_from_me, id) FILTER (p IS NULL OR epoch_us(ts) - epoch_us(p) > 14400000000) AS opener FROM t GROUP BY handle, k""", "fx_msg_ev")
def session_windows(spark, sf):
    return sessions.session_windows(c.event_messages(spark, sf))


@query(f"""{_SESSION}, t AS (SELECT handle, sum(opener)::BIGINT AS mine, count(*) AS total FROM s GROUP BY handle HAVING count(*) >= 25 ORDER BY total DESC, handle LIMIT 14)
    SELECT *, mine / total::DOUBLE AS share FROM t""", "fx_msg_ev")
def initiation(spark, sf):
    return sessions.initiation(c.event_messages(spark, sf))


@query(f"""{_SESSION}, k AS (SELECT handle FROM s GROUP BY handle HAVING count(*) >= 25)
    SELECT handle, year(ts)::INT AS year, sum(opener)::BIGINT AS mine, count(*) AS total FROM s JOIN k USING (handle) GROUP BY ALL""", "fx_msg_ev")
def initiation_by_year(spark, sf):
    return sessions.initiation_by_year(c.event_messages(spark, sf))


@query(f"{_GAPS} SELECT * FROM g", "fx_msg_ev")
def reply_gaps(spark, sf):
    return sessions.reply_gaps(c.event_messages(spark, sf))


@query(f"""{_GAPS}, s AS (SELECT handle, median(seconds) FILTER (is_from_me = 1) AS my_median, median(seconds) FILTER (is_from_me = 0) AS their_median,
      count(*) FILTER (is_from_me = 1) AS my_replies, count(*) FILTER (is_from_me = 0) AS their_replies FROM g GROUP BY handle),
    n AS (SELECT handle, count(*) AS total FROM fx_msg_ev GROUP BY handle)
    SELECT * FROM s JOIN n USING (handle) WHERE least(my_replies, their_replies) >= 3 ORDER BY total DESC, handle LIMIT 10""", "fx_msg_ev")
def reply_latency(spark, sf):
    return sessions.reply_latency(c.event_messages(spark, sf), min_replies=3)


@query(f"{_GAPS} SELECT handle, is_from_me, {_MONTH} AS month, median(seconds) AS median_seconds, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 5", "fx_msg_ev")
def monthly_medians(spark, sf):
    return sessions.monthly_medians(sessions.reply_gaps(c.event_messages(spark, sf)))


@query(f"""{_GAPS}, md AS (SELECT handle, is_from_me, {_MONTH} AS month, median(seconds) AS median_seconds, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 2)
    SELECT *, (sum(CASE WHEN k THEN 1 ELSE 0 END) OVER (PARTITION BY handle, is_from_me ORDER BY month))::BIGINT AS segment FROM (SELECT *, coalesce(date_diff('month', lag(strptime(month, '%Y-%m')) OVER w, strptime(month, '%Y-%m')) > 2, false) AS k FROM md WINDOW w AS (PARTITION BY handle, is_from_me ORDER BY month)) z""".replace("SELECT *, (sum", "SELECT handle, is_from_me, month, median_seconds, n, (sum"), "fx_msg_ev")
def latency_segments(spark, sf):
    return sessions.latency_segments(sessions.monthly_medians(sessions.reply_gaps(c.event_messages(spark, sf)), min_replies=2))


_GROUPS = """CTE x AS (SELECT *, lag(ts) OVER w AS pt, lag(is_from_me) OVER w AS pm, lead(ts) OVER w AS nt, lead(is_from_me) OVER w AS nm FROM fx_msg_ev WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id)),
    y AS (SELECT id, ts, handle, chat_id, is_from_me, pm, pt IS NULL OR CAST(pt AS DATE) <> CAST(ts AS DATE) AS new_day, coalesce(epoch_us(ts) - epoch_us(pt) >= 3600000000, false) AS time_break,
      nt IS NULL OR CAST(nt AS DATE) <> CAST(ts AS DATE) OR epoch_us(nt) - epoch_us(ts) >= 3600000000 OR nm <> is_from_me AS group_end FROM x),
    z AS (SELECT id, ts, handle, chat_id, is_from_me, new_day, time_break, new_day OR time_break OR pm <> is_from_me AS group_start, group_end FROM y)"""


@query(f"{_GROUPS} SELECT * FROM z", "fx_msg_ev")
def message_groups(spark, sf):
    return sessions.message_groups(c.event_messages(spark, sf))


@query(f"{_GROUPS} SELECT chat_id, count(*) FILTER (time_break) AS breaks, count(*) FILTER (group_start) AS groups, count(*) FILTER (new_day) AS days FROM z GROUP BY chat_id", "fx_msg_ev")
def time_breaks(spark, sf):
    return sessions.time_breaks(c.event_messages(spark, sf))


_LIVE = """CTE o AS (SELECT *, regexp_extract(assoc_guid, '[^/]*$') AS target, row_number() OVER (PARTITION BY regexp_extract(assoc_guid, '[^/]*$'), reactor ORDER BY ts DESC, id DESC) AS rn FROM fx_tap),
    live AS (SELECT target, reactor, kind, emoji, ts, id FROM o WHERE rn = 1 AND kind < 3000)"""


@query(f"{_LIVE} SELECT * FROM live", "fx_tap")
def tapback_state(spark, sf):
    return tapbacks.live_tapbacks(c.event_tapbacks(spark, sf))


def _direct_reactions(spark, sf) -> DataFrame:
    """Live tapbacks on messages of one-to-one threads; a reactor with an even number is me."""
    targets = c.event_messages(spark, sf).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("target"), F.col("handle").alias("person"), F.col("is_from_me").alias("target_me"))
    live = tapbacks.live_tapbacks(c.event_tapbacks(spark, sf))
    return live.join(targets, "target").withColumn("reactor_me", ((F.col("reactor") % 2) == 0).cast("int"))


_REACT = _LIVE + """, j AS (SELECT m.handle AS person, l.kind, m.is_from_me AS target_me, CAST(l.reactor % 2 = 0 AS INT) AS reactor_me FROM live l JOIN fx_msg_ev m ON l.target = 'g' || m.id)"""


@query(f"""{_REACT}, g AS (SELECT person, count(*) FILTER (reactor_me = 0 AND target_me = 1) AS "count", count(*) FILTER (reactor_me = 0 AND target_me = 1 AND kind = 2003) AS laughs, count(*) FILTER (reactor_me = 1 AND target_me = 0) AS gave_count FROM j GROUP BY person),
    v AS (SELECT handle AS person, count(*) FILTER (is_from_me = 1) AS my_msgs, count(*) FILTER (is_from_me = 0) AS their_msgs FROM fx_msg_ev GROUP BY handle)
    SELECT v.*, g."count", laughs, gave_count, "count" / my_msgs::DOUBLE AS rate, laughs / my_msgs::DOUBLE AS laugh_rate, gave_count / greatest(their_msgs, 1)::DOUBLE AS gave_rate
    FROM v JOIN g USING (person) WHERE my_msgs >= 12 AND "count" > 0 ORDER BY rate DESC, person LIMIT 12""", "fx_tap", "fx_msg_ev")
def reaction_stats(spark, sf):
    messages = c.event_messages(spark, sf).withColumnRenamed("handle", "person")
    return tapbacks.reaction_stats(_direct_reactions(spark, sf), messages, min_messages=12)


@query(f"""{_REACT}, n AS (SELECT person, kind, count(*) AS n FROM j GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, kind)::INT AS rank FROM n) SELECT * FROM r WHERE rank <= 4""", "fx_tap", "fx_msg_ev")
def top_tapbacks(spark, sf):
    return tapbacks.top_tokens(_direct_reactions(spark, sf))


@query(f"""{_LIVE}, e AS (SELECT target, CASE WHEN kind = 2006 THEN emoji ELSE CASE kind WHEN 2000 THEN '❤️' WHEN 2001 THEN '👍' WHEN 2002 THEN '👎' WHEN 2003 THEN '😂' WHEN 2004 THEN '‼️' WHEN 2005 THEN '❓' ELSE '👍' END END AS sign, ts, id FROM live),
    f AS (SELECT target, sign, min(ROW(ts, id)) AS att, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY att) AS rn, sum(n) OVER (PARTITION BY target) AS total FROM f)
    SELECT target, string_agg(sign, '' ORDER BY rn) FILTER (rn <= 3) AS emojis, max(total)::BIGINT AS n FROM r GROUP BY target""", "fx_tap")
def tapback_chips(spark, sf):
    return tapbacks.tapback_chips(tapbacks.live_tapbacks(c.event_tapbacks(spark, sf))).withColumn("emojis", F.array_join("emojis", ""))


@query(f"""{_LIVE}, w AS (SELECT target, ts, id, CASE WHEN kind = 2006 THEN emoji ELSE ['❤️', '👍', '👎', '😂', '‼️', '❓'][kind - 1999] END || CASE WHEN kind = 2006 THEN 'Reacted' ELSE ['Loved', 'Liked', 'Disliked', 'Laughed at', 'Emphasized', 'Questioned'][kind - 1999] END
    || CASE WHEN reactor % 2 = 0 THEN 'You' ELSE coalesce(s_name, CAST(reactor AS VARCHAR)) END AS x FROM live LEFT JOIN supplier ON s_suppkey = reactor) SELECT target, string_agg(x, '|' ORDER BY ts, id) AS tapbacks FROM w GROUP BY target""", "fx_tap")
def tapback_list(spark, sf):
    people = c.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("reactor"), F.col("s_name").alias("name"))
    found = tapbacks.tapback_list(tapbacks.live_tapbacks(c.event_tapbacks(spark, sf)), people, F.col("reactor") % 2 == 0)
    return found.select("target", F.array_join(F.transform("tapbacks", lambda x: F.concat(x["emoji"], x["verb"], x["who"])), "|").alias("tapbacks"))


@query("SELECT id, CASE WHEN instr(g, '/') > 0 THEN substr(g, instr(g, '/') + 1) ELSE g END AS target FROM (SELECT id, CASE WHEN id % 3 = 0 THEN replace(assoc_guid, '/', '') ELSE assoc_guid || '/x' END AS g FROM fx_tap)", "fx_tap")
def tapback_targets(spark, sf):
    t = c.event_tapbacks(spark, sf)
    guid = F.when(F.col("id") % 3 == 0, F.replace("assoc_guid", F.lit("/"), F.lit(""))).otherwise(F.concat("assoc_guid", F.lit("/x")))
    return t.select("id", tapbacks.target_after_first(guid).alias("target"))


@query("SELECT chat_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_msg_ev GROUP BY chat_id", "fx_msg_ev")
def thread_list(spark, sf):
    return threads.thread_list(c.event_messages(spark, sf))


@query("SELECT chat_id, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_msg_ev GROUP BY chat_id", "fx_msg_ev")
def thread_bounds(spark, sf):
    return threads.thread_list(c.event_messages(spark, sf)).drop("n")


def _order_threads(spark, sf):
    """Customers are chats with one participant; those of a nation are one person."""
    m = c.order_messages(spark, sf).withColumn("chat_id", F.col("handle"))
    ids = threads.thread_ids(m.select("chat_id", "handle", "person").distinct())
    return threads.merge_threads(threads.thread_list(m), ids)


@query("""CTE l AS (SELECT handle AS chat_id, person, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_msg_ord GROUP BY ALL),
    r AS (SELECT *, min(chat_id) OVER (PARTITION BY person) AS thread_id, row_number() OVER (PARTITION BY person ORDER BY n DESC, chat_id) AS rn FROM l)
    SELECT thread_id, min(chat_id) FILTER (rn = 1) AS lead_chat, sum(n)::BIGINT AS n, min(first_ts) AS first_ts, max(last_ts) AS last_ts, false AS known FROM r GROUP BY thread_id""", "fx_msg_ord")
def thread_lead_merge(spark, sf):
    return _order_threads(spark, sf)


@query("""CTE l AS (SELECT chat_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_msg_ev GROUP BY chat_id), s AS (SELECT * FROM l ORDER BY last_ts DESC, chat_id LIMIT 20) SELECT * FROM s""", "fx_msg_ev")
def thread_sort_recent(spark, sf):
    return threads.sort_threads(threads.thread_list(c.event_messages(spark, sf)), "recent").limit(20)


@query("""WITH n AS (SELECT n_nationkey AS chat_id, n_name AS name, n_regionkey AS thread_id FROM nation), h AS (SELECT thread_id, chat_id, name, row_number() OVER (PARTITION BY thread_id ORDER BY chat_id) AS rn FROM n WHERE contains(lower(name), 'on_1'))
    SELECT thread_id, chat_id, name FROM h WHERE rn = 1 ORDER BY lower(name), chat_id LIMIT 8""")
def matching_threads(spark, sf):
    chats = c.table(spark, sf, "nation").select(F.col("n_regionkey").alias("thread_id"), F.col("n_nationkey").alias("chat_id"), F.col("n_name").alias("name"))
    return threads.matching_threads(chats, '"ON_1"')


def _thread(spark, sf):
    """The thread with the smallest id, and its 40th message as a cursor."""
    rows = c.event_messages(spark, sf)
    first = rows.agg(F.min("chat_id")).first()[0]
    rows = rows.where(F.col("chat_id") == first)
    at = rows.orderBy("ts", "id").limit(20).orderBy(F.desc("ts"), F.desc("id")).first()
    return rows, (at.ts, at.id)


_THREAD = """CTE t AS (SELECT * FROM fx_msg_ev WHERE chat_id = (SELECT min(chat_id) FROM fx_msg_ev)), o AS (SELECT *, row_number() OVER (ORDER BY ts, id) AS rn FROM t), c AS (SELECT max(rn) AS k FROM o WHERE rn <= 20)"""
_COLS = "id, ts, handle, chat_id, is_from_me"


@query(f"{_THREAD} SELECT {_COLS} FROM o WHERE rn <= 15", "fx_msg_ev")
def page_first(spark, sf):
    return paging.page(_thread(spark, sf)[0], limit=15)


@query(f"{_THREAD} SELECT {_COLS} FROM o, c WHERE rn > k AND rn <= k + 15", "fx_msg_ev")
def page_after(spark, sf):
    rows, at = _thread(spark, sf)
    return paging.page(rows, after_=at, limit=15)


@query(f"{_THREAD} SELECT {_COLS} FROM o, c WHERE rn < k AND rn >= k - 15", "fx_msg_ev")
def page_before(spark, sf):
    rows, at = _thread(spark, sf)
    return paging.page(rows, before_=at, limit=15)


@query(f"{_THREAD} SELECT {_COLS} FROM o WHERE rn > (SELECT count(*) - 15 FROM o)", "fx_msg_ev")
def page_last(spark, sf):
    return paging.page(_thread(spark, sf)[0], from_end=True, limit=15)


@query(f"{_THREAD} SELECT {_COLS} FROM o, c WHERE rn > k - 5 AND rn <= k + 5", "fx_msg_ev")
def page_around(spark, sf):
    rows, at = _thread(spark, sf)
    return paging.around(rows, at, 5)


_FLAGS = f"""{_GROUPS}, {_THREAD.removeprefix('CTE ').replace('fx_msg_ev WHERE', 'z WHERE')} SELECT {_COLS}, new_day, time_break, group_start, group_end FROM o, c WHERE"""


@query(f"{_FLAGS} rn > k AND rn <= k + 15", "fx_msg_ev")
def page_context_after(spark, sf):
    """A page with its display flags, which are those of the whole thread."""
    rows, at = _thread(spark, sf)
    return paging.page_with_context(rows, after_=at, limit=15)


@query(f"{_FLAGS} rn < k AND rn >= k - 15", "fx_msg_ev")
def page_context_before(spark, sf):
    rows, at = _thread(spark, sf)
    return paging.page_with_context(rows, before_=at, limit=15)


@query(f"{_THREAD} SELECT k > 1 AS earlier, (SELECT count(*) FROM o) > k AS later FROM c", "fx_msg_ev")
def has_neighbor(spark, sf):
    rows, at = _thread(spark, sf)
    return spark.createDataFrame([(paging.has_neighbour(rows, at, False), paging.has_neighbour(rows, at, True))], "earlier boolean, later boolean")


_MEDIA = "CTE d AS (SELECT DISTINCT * FROM fx_att WHERE filename IS NULL OR filename NOT ILIKE '%.pluginPayloadAttachment'), v AS (SELECT * FROM d WHERE mime ILIKE 'image/%' OR mime ILIKE 'video/%' OR regexp_matches(filename, '(?i)\\.(heic|heif|mov|mp4)$'))"


@query(f"{_MEDIA}, o AS (SELECT *, row_number() OVER (ORDER BY ts DESC, att_id DESC, msg_id DESC) AS rn FROM v), c AS (SELECT ts, att_id FROM (SELECT DISTINCT ts, att_id FROM v) ORDER BY ts DESC, att_id DESC LIMIT 80) SELECT DISTINCT v.ts, v.att_id FROM v JOIN c USING (ts, att_id)", "fx_att")
def media_page(spark, sf):
    places = c.part_attachments(spark, sf).select("ts", "att_id", "mime", "filename")
    return media.media_page(places, visual_only=True, from_end=True).select("ts", "att_id")


@query("SELECT count(DISTINCT att_id) AS n FROM fx_att WHERE filename IS NULL OR filename NOT ILIKE '%.pluginPayloadAttachment'", "fx_att")
def media_count_distinct(spark, sf):
    return media.media_count(c.part_attachments(spark, sf))


@query("SELECT count(*) AS n FROM fx_att WHERE filename NOT ILIKE '%.pluginPayloadAttachment'", "fx_att")
def media_count_plain(spark, sf):
    return media.named_count(c.part_attachments(spark, sf))


@query(f"SELECT {_MONTH} AS month, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_att WHERE filename IS NULL OR filename NOT ILIKE '%.pluginPayloadAttachment' GROUP BY 1", "fx_att")
def media_months(spark, sf):
    return media.month_sections(c.part_attachments(spark, sf))


@query(f"{_MEDIA} SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM v", "fx_att")
def media_bounds(spark, sf):
    return media.media_bounds(c.part_attachments(spark, sf), visual_only=True)


@query("""CTE p AS (SELECT id FROM fx_msg_ord ORDER BY ts, id LIMIT 150), u AS (SELECT DISTINCT msg_id, att_id FROM fx_att WHERE msg_id IN (SELECT id FROM p)) SELECT msg_id, count(*)::INT AS n, min(att_id) AS first_att, max(att_id) AS last_att FROM u GROUP BY msg_id""", "fx_att", "fx_msg_ord")
def message_attachments(spark, sf):
    page = paging.page(c.order_messages(spark, sf)).select(F.col("id").alias("msg_id"))
    return media.message_attachments(page, c.part_attachments(spark, sf)).select("msg_id", F.size("files").alias("n"), F.array_min("files.att_id").alias("first_att"), F.array_max("files.att_id").alias("last_att"))


@query("""CTE f AS (SELECT *, row_number() OVER (PARTITION BY att_id ORDER BY ts, msg_id) AS rn FROM fx_att) SELECT att_id, ts, msg_id, mime, filename FROM f WHERE rn = 1""", "fx_att")
def first_places(spark, sf):
    return media.first_places(c.part_attachments(spark, sf))


@query("CTE k AS (SELECT chat_id, count(*) AS n FROM fx_member GROUP BY chat_id) SELECT count(*) FILTER (n = 1) AS direct, count(*) FILTER (n > 1) AS groups FROM k", "fx_member")
def dm_groups_count(spark, sf):
    size = c.order_members(spark, sf).groupBy("chat_id").agg(F.count("*").alias("n"))
    return size.agg(F.count_if(F.col("n") == 1).alias("direct"), F.count_if(F.col("n") > 1).alias("groups"))


@query("""WITH m AS (SELECT s_nationkey * 100 + floor(s_acctbal / 1000)::BIGINT AS chat_id, s_suppkey AS handle FROM supplier), k AS (SELECT chat_id, count(*) AS n FROM m GROUP BY chat_id)
    SELECT DISTINCT handle AS person FROM m JOIN k USING (chat_id) WHERE n = 1 EXCEPT SELECT handle FROM m JOIN k USING (chat_id) WHERE n > 1""")
def solo_people(spark, sf):
    chat = (F.col("s_nationkey") * 100 + F.floor(F.col("s_acctbal") / 1000)).alias("chat_id")
    return circles.solo_people(c.table(spark, sf, "supplier").select(chat, F.col("s_suppkey").alias("handle")))


_CIRCLES = """CTE s AS (SELECT chat_id, list_sort(list(handle)) AS people FROM fx_member GROUP BY chat_id HAVING count(*) BETWEEN 2 AND 24),
    j AS (SELECT s.*, n.n FROM s JOIN fx_chat_n n USING (chat_id) WHERE n.n >= 4),
    g AS (SELECT people, arg_min(chat_id, ROW(-n, chat_id)) AS chat_id, sum(n)::BIGINT AS messages FROM j GROUP BY people ORDER BY messages DESC, chat_id LIMIT 48),
    e AS (SELECT chat_id, messages, unnest(people) AS person FROM g),
    p AS (SELECT person, count(*) AS groups, sum(messages)::BIGINT AS messages FROM e GROUP BY person),
    k AS (SELECT *, row_number() OVER (ORDER BY groups DESC, messages DESC, person)::INT - 1 AS rank FROM p),
    q AS (SELECT * FROM k WHERE rank < 90), ed AS (SELECT e.chat_id, e.person, count(*) OVER (PARTITION BY e.chat_id) AS c FROM e JOIN q USING (person))"""


def _circles(spark, sf):
    return circles.groups(c.order_members(spark, sf), c.order_chat_sizes(spark, sf), min_messages=4)


@query(f"{_CIRCLES} SELECT array_to_string(people, ',') AS people, chat_id, messages FROM g", "fx_member", "fx_chat_n")
def circle_groups(spark, sf):
    return _circles(spark, sf).select(F.array_join("people", ",").alias("people"), "chat_id", "messages")


@query(f"{_CIRCLES} SELECT * FROM q", "fx_member", "fx_chat_n")
def circle_people_rank(spark, sf):
    return circles.ranked_people(_circles(spark, sf))


@query(f"{_CIRCLES} SELECT chat_id, person FROM ed WHERE c >= 2", "fx_member", "fx_chat_n")
def circle_edges(spark, sf):
    found = _circles(spark, sf)
    return circles.circle_edges(found, circles.ranked_people(found))


@query(f"""{_CIRCLES}, x AS (SELECT chat_id, person FROM ed WHERE c >= 2) SELECT a.person, count(DISTINCT a.chat_id) AS shared_groups, count(DISTINCT b.person) AS people FROM x a JOIN x b USING (chat_id) WHERE a.person <> b.person GROUP BY a.person""", "fx_member", "fx_chat_n")
def two_hop(spark, sf):
    found = _circles(spark, sf)
    return circles.neighbourhood(circles.circle_edges(found, circles.ranked_people(found)))


@query("""CTE k AS (SELECT chat_id, min(handle) AS person FROM fx_member GROUP BY chat_id HAVING count(*) = 1), r AS (SELECT k.*, n.n, row_number() OVER (PARTITION BY person ORDER BY n.n DESC, chat_id) AS rn FROM k JOIN fx_chat_n n USING (chat_id)) SELECT person, chat_id, n FROM r WHERE rn = 1""", "fx_member", "fx_chat_n")
def direct_threads(spark, sf):
    return circles.direct_threads(c.order_members(spark, sf), c.order_chat_sizes(spark, sf))


@query("SELECT * FROM fx_msg_ev m WHERE EXISTS (SELECT 1 FROM fx_tap t WHERE regexp_extract(t.assoc_guid, '[^/]*$') = 'g' || m.id)", "fx_msg_ev", "fx_tap")
def semi_join_exists(spark, sf):
    targets = c.event_tapbacks(spark, sf).select(tapbacks.target_of(F.col("assoc_guid")).alias("target"))
    m = c.event_messages(spark, sf)
    return m.join(targets, F.concat(F.lit("g"), m.id.cast("string")) == targets.target, "left_semi")


@query("SELECT DISTINCT handle FROM fx_msg_ev WHERE handle NOT IN (SELECT reactor FROM fx_tap WHERE kind = 2003)", "fx_msg_ev", "fx_tap")
def anti_join(spark, sf):
    return c.event_messages(spark, sf).select("handle").distinct().join(c.event_tapbacks(spark, sf).where("kind = 2003").select(F.col("reactor").alias("handle")), "handle", "left_anti")


@query("SELECT m.handle, count(*) AS n, count(s.s_suppkey) AS known FROM fx_msg_ev m LEFT JOIN supplier s ON s.s_suppkey = m.handle GROUP BY m.handle", "fx_msg_ev")
def left_outer(spark, sf):
    s = c.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("handle"), "s_suppkey")
    return c.event_messages(spark, sf).join(s, "handle", "left").groupBy("handle").agg(F.count("*").alias("n"), F.count("s_suppkey").alias("known"))


@query("SELECT chat_id, handle FROM fx_member WHERE chat_id IN (SELECT chat_id FROM fx_member WHERE handle IN (1, 2, 3))", "fx_member")
def in_subquery(spark, sf):
    m = c.order_members(spark, sf)
    return m.join(m.where(F.col("handle").isin(1, 2, 3)).select("chat_id"), "chat_id", "left_semi")


@query("SELECT chat_id, n, (SELECT count(*) FROM fx_member m WHERE m.chat_id = x.chat_id) AS members FROM fx_chat_n x", "fx_chat_n", "fx_member")
def scalar_subquery(spark, sf):
    size = c.order_members(spark, sf).groupBy("chat_id").agg(F.count("*").alias("members"))
    return c.order_chat_sizes(spark, sf).join(size, "chat_id", "left").withColumn("members", F.coalesce("members", F.lit(0)))


@query("""CTE d AS (SELECT id, CAST(ts AS DATE) AS d, (SELECT CAST(max(ts) AS DATE) FROM fx_msg_ord) AS now FROM fx_msg_ord)
    SELECT id, (epoch_us(d::TIMESTAMP) - 978307200000000) * 1000 AS ns, d::TIMESTAMP AS midnight,
      CASE WHEN now - d = 0 THEN 'Today' WHEN now - d = 1 THEN 'Yesterday' WHEN now - d BETWEEN 2 AND 6 THEN strftime(d, '%A') WHEN year(d) = year(now) THEN strftime(d, '%B %-d') ELSE strftime(d, '%B %-d, %Y') END AS label,
      strftime(d, '%B %Y') AS month, strftime(d, '%b %y') AS short, d - dayofweek(d)::INT AS week FROM d""", "fx_msg_ord")
def time_labels(spark, sf):
    """The archive's clock there and back, and how a day is called on the newest one."""
    rows = c.order_messages(spark, sf).select("id", F.to_date("ts").alias("d"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("d").alias("now"))))  # one row
    ns, key = timing.to_archive_ns(F.col("d")), F.date_format("d", "yyyy-MM")
    return rows.select(
        "id", ns.alias("ns"), timing.from_archive_ns(ns).alias("midnight"), timing.day_label(F.col("d"), F.col("now")).alias("label"),
        timing.month_label(key).alias("month"), timing.short_month(key).alias("short"), timing.week_start(F.col("d")).alias("week"),
    )


@query(f"""{_GAPS} SELECT CASE WHEN seconds < 60 THEN round_even(seconds, 0)::BIGINT || ' s' WHEN seconds < 3600 THEN round_even(seconds / 60, 0)::BIGINT || ' min' WHEN seconds < 86400 THEN round_even(seconds / 3600, 0)::BIGINT || ' h'
      ELSE round_even(seconds / 86400, 0)::BIGINT || ' d' END AS gap, count(*) AS n FROM g GROUP BY 1""", "fx_msg_ev")
def gap_labels(spark, sf):
    """How often each pause before a reply comes, as it is shown."""
    gaps = sessions.reply_gaps(c.event_messages(spark, sf))
    return gaps.groupBy(timing.gap_label(F.col("seconds")).alias("gap")).agg(F.count("*").alias("n"))
