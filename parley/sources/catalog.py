"""Columnar tables, and views that give the benchmark tables the shape of a message archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.publish import publish


class SourceUnavailable(Exception):
    """A table cannot be read; the message says why."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unavailable_reason(spark: SparkSession, path: str) -> str | None:
    """Why ``path`` cannot be read as Parquet, or None if it can."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except Exception as e:  # any reader error is the answer
        return str(e).splitlines()[0]
    return None


def load(spark: SparkSession, path: str) -> DataFrame:
    if reason := unavailable_reason(spark, path):
        raise SourceUnavailable(reason)
    return spark.read.parquet(path)


def snapshot(df: DataFrame, root: str, version: str) -> DataFrame:
    """Write a version of a table once and read it from then on; a version that was never committed does not count."""
    return publish(df.sparkSession, root, version, lambda: df)


def version(df: DataFrame) -> str:
    """A name for the files that ``df`` reads: it changes with their names, sizes and times of change. No data is read."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, total = files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", F.unix_micros("file_modification_time")).cast("decimal(38,0)"))).first()
    return f"{n}-{abs(int(total or 0)):x}"


def optional(df: DataFrame, name: str, kind: str, default: object) -> DataFrame:
    """Add a column that older stores lack; fill its nulls otherwise."""
    value = F.coalesce(F.col(name), F.lit(default).cast(kind)) if name in df.columns else F.lit(default).cast(kind)
    return df.withColumn(name, value)


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, handle, chat_id, is_from_me: dense one-to-one threads, one for each user."""
    return (
        table(spark, sf_dir, "events").where("event_type <> 'error'")
        .select(
            F.col("event_id").alias("id"), "ts", F.col("user_id").alias("handle"), F.col("user_id").alias("chat_id"),
            F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("is_from_me"),
        )
    )


def event_tapbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, reactor, kind, emoji, assoc_guid: one in four takes a tapback away again; some show an emoji of their own."""
    i = F.col("event_id")
    return (
        table(spark, sf_dir, "events").where("event_type = 'error'")
        .select(
            i.alias("id"), "ts", F.col("user_id").alias("reactor"),
            F.when(i % 4 == 0, 3000 + i % 7).otherwise(2000 + i % 7).alias("kind"),
            F.when(i % 7 == 6, F.when(i % 2 == 0, "🎉").otherwise("🙏")).alias("emoji"),
            F.concat(F.lit("p:"), (i % 3).cast("string"), F.lit("/g"), (i - i % 500).cast("string")).alias("assoc_guid"),
        )
    )


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, handle, person, is_from_me: a long history; handles (customers) of a nation are one person."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("person"))
    return (
        table(spark, sf_dir, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("handle"), "person",
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_from_me"),
        )
    )


def order_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_id, handle: who is in which chat (orders and their suppliers)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chat_id"), F.col("l_suppkey").alias("handle")).distinct()


def order_chat_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chat_id")).agg(F.count("*").alias("n"))


def part_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, ts, att_id, mime, filename."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    key, kind, name = F.col("p_partkey"), F.col("p_type"), F.col("p_name")
    return (
        table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == key)
        .select(
            F.col("l_orderkey").alias("msg_id"), F.col("l_shipdate").alias("ts"), key.alias("att_id"),
            F.when(kind.isin("ECONOMY", "PROMO"), "image/jpeg").when(kind == "STANDARD", "video/mp4").when(kind == "LARGE", None).otherwise("application/pdf").alias("mime"),
            F.when((kind == "LARGE") & (key % 2 == 0), F.concat(name, F.lit(".HEIC"))).when(key % 17 == 0, F.concat(name, F.lit(".pluginPayloadAttachment"))).when(key % 19 == 0, None).otherwise(name).alias("filename"),
        )
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_id, msg_no, role, text, sec: bubbles on a synthetic clock with a 13 h hole before turn 4."""
    c, t = F.col("conv_id"), F.col("turn")
    return (
        table(spark, sf_dir, "conversations").where("role <> 'system'")
        .select(c.alias("chat_id"), t.alias("msg_no"), "role", "text", (c * 86400 + t * 600 + F.when(t >= 4, 46800).otherwise(0)).alias("sec"))
    )


def archive_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, chat_id, handle, is_from_me, text, kind, is_unsent, has_attachment: conversations as an archive keeps them.

    Some messages are unsent, artifacts, tapbacks or attachments without text, and each twentieth is in two chats.
    """
    t = conversation_turns(spark, sf_dir)
    i, n = F.col("chat_id") * 1000 + F.col("msg_no"), F.col("chat_id") * 7 + F.col("msg_no")
    text = F.when(n % 41 == 3, None).when(n % 53 == 5, "Loved “that”").otherwise(F.col("text"))
    rows = t.select(
        i.alias("id"), F.timestamp_seconds("sec").alias("ts"), "chat_id", (F.col("chat_id") % 50).alias("handle"), (F.col("role") == "assistant").cast("int").alias("is_from_me"),
        text.alias("text"), F.when(n % 61 == 7, 2001).alias("kind"), (n % 67 == 9).cast("int").alias("is_unsent"), (n % 2 == 1).cast("int").alias("has_attachment"),
    )
    return rows.unionByName(rows.where("id % 20 = 0").withColumn("chat_id", F.col("chat_id") + 1))


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_id, handle: one other person, but two in each seventh chat."""
    chats = conversation_turns(spark, sf_dir).select("chat_id").distinct()
    return chats.select("chat_id", F.explode(F.when(F.col("chat_id") % 7 == 0, F.array(F.col("chat_id") % 50, F.lit(99).cast("long"))).otherwise(F.array(F.col("chat_id") % 50))).alias("handle"))


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, body, sender, chat."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), F.col("source").alias("sender"), F.col("lang").alias("chat"))


#: The same views in SQL, for checks on another engine.
VIEWS = {
    "fx_msg_ev": """SELECT event_id AS id, ts, user_id AS handle, user_id AS chat_id,
        CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS is_from_me FROM events WHERE event_type <> 'error'""",
    "fx_tap": """SELECT event_id AS id, ts, user_id AS reactor,
        CASE WHEN event_id % 4 = 0 THEN 3000 + event_id % 7 ELSE 2000 + event_id % 7 END AS kind,
        CASE WHEN event_id % 7 = 6 THEN CASE WHEN event_id % 2 = 0 THEN '🎉' ELSE '🙏' END END AS emoji,
        concat('p:', CAST(event_id % 3 AS VARCHAR), '/g', CAST(event_id - event_id % 500 AS VARCHAR)) AS assoc_guid
        FROM events WHERE event_type = 'error'""",
    "fx_msg_ord": """SELECT o_orderkey AS id, o_orderdate AS ts, o_custkey AS handle, c_nationkey AS person,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_from_me FROM orders JOIN customer ON c_custkey = o_custkey""",
    "fx_member": "SELECT DISTINCT l_orderkey AS chat_id, l_suppkey AS handle FROM lineitem",
    "fx_chat_n": "SELECT l_orderkey AS chat_id, count(*) AS n FROM lineitem GROUP BY l_orderkey",
    "fx_att": """SELECT l_orderkey AS msg_id, l_shipdate AS ts, p_partkey AS att_id,
        CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'image/jpeg' WHEN p_type = 'STANDARD' THEN 'video/mp4'
             WHEN p_type = 'LARGE' THEN NULL ELSE 'application/pdf' END AS mime,
        CASE WHEN p_type = 'LARGE' AND p_partkey % 2 = 0 THEN concat(p_name, '.HEIC')
             WHEN p_partkey % 17 = 0 THEN concat(p_name, '.pluginPayloadAttachment')
             WHEN p_partkey % 19 = 0 THEN NULL ELSE p_name END AS filename
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "fx_turn": """SELECT conv_id AS chat_id, turn AS msg_no, role, text,
        conv_id * 86400 + turn * 600 + CASE WHEN turn >= 4 THEN 46800 ELSE 0 END AS sec FROM conversations WHERE role <> 'system'""",
    "fx_arc": """SELECT id, ts, unnest(CASE WHEN id % 20 = 0 THEN [chat_id, chat_id + 1] ELSE [chat_id] END) AS chat_id, handle, is_from_me, text, kind, is_unsent, has_attachment FROM (SELECT conv_id * 1000 + turn AS id,
        make_timestamp((conv_id * 86400 + turn * 600 + CASE WHEN turn >= 4 THEN 46800 ELSE 0 END) * 1000000) AS ts, conv_id AS chat_id, conv_id % 50 AS handle, CAST(role = 'assistant' AS INT) AS is_from_me,
        CASE WHEN (conv_id * 7 + turn) % 41 = 3 THEN NULL WHEN (conv_id * 7 + turn) % 53 = 5 THEN 'Loved “that”' ELSE text END AS text,
        CASE WHEN (conv_id * 7 + turn) % 61 = 7 THEN 2001 END AS kind, CAST((conv_id * 7 + turn) % 67 = 9 AS INT) AS is_unsent, CAST((conv_id * 7 + turn) % 2 = 1 AS INT) AS has_attachment FROM conversations WHERE role <> 'system')""",
    "fx_arc_member": "SELECT chat_id, unnest(CASE WHEN chat_id % 7 = 0 THEN [chat_id % 50, 99] ELSE [chat_id % 50] END) AS handle FROM (SELECT DISTINCT conv_id AS chat_id FROM conversations WHERE role <> 'system')",
    "fx_doc": "SELECT doc_id, text AS body, source AS sender, lang AS chat FROM documents",
}


def with_views(*names: str) -> str:
    """``WITH`` and the named views, ready for more common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
