"""Threads: chats of one person merged, chat lists, labels and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTS = ("recent", "count", "name", "oldest")


def thread_ids(members: DataFrame, person: str = "person") -> DataFrame:
    """(chat_id, thread_id): one-participant chats of the same person are one thread, named by its smallest chat; groups never merge."""
    each = members.groupBy("chat_id").agg(F.countDistinct("handle").alias("n"), F.min(person).alias("one"))
    single = each.where("n = 1 AND one IS NOT NULL")
    lead = single.groupBy("one").agg(F.min("chat_id").alias("thread_id"))
    rest = each.where("n <> 1 OR one IS NULL").select("chat_id", F.col("chat_id").alias("thread_id"))
    return single.join(lead, "one").select("chat_id", "thread_id").unionByName(rest)


def thread_list(messages: DataFrame, chat: str = "chat_id") -> DataFrame:
    """(chat_id, n, first_ts, last_ts)."""
    return messages.groupBy(chat).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merge_threads(chats: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread_id, lead_chat, n, first_ts, last_ts, known): the largest chat leads, ties to the smaller id."""
    rows = chats.join(threads, "chat_id")
    known = F.bool_or("known") if "known" in chats.columns else F.lit(False)
    return rows.groupBy("thread_id").agg(
        F.max_by("chat_id", F.struct("n", -F.col("chat_id"))).alias("lead_chat"), F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), known.alias("known")
    )


def sort_threads(chats: DataFrame, sort: str = "recent", name: str = "name", chat: str = "chat_id") -> DataFrame:
    order = {"recent": F.desc("last_ts"), "count": F.desc("n"), "name": F.lower(F.col(name)) if name in chats.columns else F.col(chat), "oldest": F.asc("first_ts")}[sort]
    return chats.orderBy(order, chat)


def filter_threads(chats: DataFrame, query: str = "", known_only: bool = False, name: str = "name") -> DataFrame:
    rows = chats.where(F.contains(F.lower(name), F.lit(query.lower()))) if query else chats
    return rows.where("known") if known_only else rows


def is_known(display_name: Column, identifier_name: Column, participant_names: Column) -> Column:
    """A thread is known if it has a title, a resolved identifier or any resolved participant."""
    return (F.coalesce(display_name, F.lit("")) != "") | identifier_name.isNotNull() | F.coalesce(F.exists(participant_names, lambda n: n.isNotNull()), F.lit(False))


def chat_label(display_name: Column, contact: Column, participants: Column, identifier: Column) -> Column:
    """Title, else contact, else distinct participants, else identifier, else Unknown."""
    some = lambda c: F.nullif(c, F.lit(""))
    people = some(F.array_join(F.array_distinct(F.filter(participants, lambda p: p.isNotNull() & (p != ""))), ", "))
    return F.coalesce(some(display_name), some(contact), people, some(identifier), F.lit("Unknown"))


def participants(members: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(chat_id, participants): members of each chat in order of handle."""
    return members.groupBy("chat_id").agg(F.array_sort(F.collect_list("handle")).alias("participants"))


def matching_threads(chats: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """(thread_id, chat_id, name): threads whose label contains the query (two characters at least), by name."""
    needle = query.replace('"', "").strip().lower()
    if len(needle) < 2:
        return chats.where("1 = 0").select("thread_id", "chat_id", "name")
    hits = chats.where(F.contains(F.lower("name"), F.lit(needle)))
    one = hits.groupBy("thread_id").agg(F.min_by(F.struct("chat_id", "name"), "chat_id").alias("c")).select("thread_id", "c.*")
    return one.orderBy(F.lower("name"), "chat_id").limit(limit)
