"""Who shares a group chat with whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_MESSAGES, MAX_MEMBERS, MAX_GROUPS, MAX_PEOPLE = 8, 24, 48, 90


def one_per_person(members: DataFrame) -> DataFrame:
    """One row for each (chat_id, person): a handle with a picture, else with a name, else the smallest.

    Columns: chat_id, handle, and optionally person, name and avatar.
    """
    rows = members if "person" in members.columns else members.withColumn("person", F.col("handle"))
    have = lambda c: (F.col(c).isNotNull() if c in rows.columns else F.lit(False)).cast("int")
    extra = [c for c in ("handle", "name", "avatar") if c in rows.columns]
    best = F.min_by(F.struct(*extra), F.struct(-have("avatar"), -have("name"), "handle"))
    return rows.where("person IS NOT NULL").groupBy("chat_id", "person").agg(best.alias("m")).select("chat_id", "person", "m.*")


def groups(members: DataFrame, chats: DataFrame, min_messages: int = MIN_MESSAGES, max_members: int = MAX_MEMBERS, max_groups: int = MAX_GROUPS) -> DataFrame:
    """(people array, chat_id, title, messages): group chats with the same people are one group.

    ``chats`` has chat_id, n and optionally title. The chat that stands for a group is
    its first with a title, else the one with most messages. The busiest groups stay.
    """
    sets = one_per_person(members).groupBy("chat_id").agg(F.array_sort(F.collect_list("person")).alias("people"))
    sets = sets.where(F.size("people").between(2, max_members))
    title = F.nullif(F.trim(F.col("title")), F.lit("")) if "title" in chats.columns else F.lit(None).cast("string")
    rows = sets.join(chats.where(F.col("n") >= min_messages).withColumn("title", title), "chat_id")
    lead = F.min_by(F.struct("chat_id", "title"), F.struct(F.col("title").isNull(), F.when(F.col("title").isNull(), -F.col("n")).otherwise(0), "chat_id"))
    merged = rows.groupBy("people").agg(lead.alias("lead"), F.sum("n").alias("messages")).select("people", "lead.*", "messages")
    return merged.orderBy(F.desc("messages"), "chat_id").limit(max_groups)


def ranked_people(found: DataFrame, direct: DataFrame | None = None, max_people: int = MAX_PEOPLE) -> DataFrame:
    """(person, groups, messages, rank): by groups, then messages (those of a direct thread added), then key."""
    each = found.select(F.explode("people").alias("person"), "messages").groupBy("person").agg(F.count("*").alias("groups"), F.sum("messages").alias("messages"))
    if direct is not None:
        each = each.join(direct.select("person", F.col("n").alias("dm")), "person", "left").withColumn("messages", F.col("messages") + F.coalesce("dm", F.lit(0))).drop("dm")
    top = each.orderBy(F.desc("groups"), F.desc("messages"), "person").limit(max_people)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("groups"), F.desc("messages"), "person")) - 1)


def circle_edges(found: DataFrame, people: DataFrame) -> DataFrame:
    """(chat_id, person): the graph that is left when people beyond the ranking, and groups of fewer than two ranked people, go."""
    edges = found.select("chat_id", F.explode("people").alias("person")).join(people.select("person"), "person", "left_semi")
    enough = edges.groupBy("chat_id").agg(F.count("*").alias("n")).where("n >= 2").select("chat_id")
    return edges.join(enough, "chat_id", "left_semi").select("chat_id", "person")


def direct_threads(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(person, chat_id, n): the busiest one-person chat of each person."""
    each = one_per_person(members)
    alone = each.groupBy("chat_id").agg(F.count("*").alias("k"), F.min("person").alias("person")).where("k = 1")
    rows = alone.join(sizes, "chat_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy("person").agg(F.max_by(F.struct("chat_id", "n"), F.struct("n", -F.col("chat_id"))).alias("c")).select("person", "c.*")


def solo_people(members: DataFrame) -> DataFrame:
    """People who appear in one-to-one chats and in no group."""
    each = one_per_person(members)
    size = each.groupBy("chat_id").agg(F.count("*").alias("k"))
    sized = each.join(size, "chat_id")
    return sized.where("k = 1").select("person").distinct().join(sized.where("k > 1").select("person").distinct(), "person", "left_anti")


def neighbourhood(edges: DataFrame) -> DataFrame:
    """(person, shared_groups, people): how many groups a person is in and how many others they meet there.

    Groups have at most MAX_MEMBERS people, which bounds the pairs.
    """
    other = edges.select("chat_id", F.col("person").alias("other"))
    pairs = edges.join(other, "chat_id").where("person <> other")
    return pairs.groupBy("person").agg(F.countDistinct("chat_id").alias("shared_groups"), F.countDistinct("other").alias("people"))


def short_label(title: Column, names: Column) -> Column:
    """The title, else up to three first names, else two and how many more."""
    firsts = F.transform(names, lambda n: F.split(F.coalesce(F.nullif(F.trim(n), F.lit("")), F.lit("?")), r"\s+")[0])
    more = F.concat(F.array_join(F.slice(firsts, 1, 2), ", "), F.lit(" +"), (F.size(firsts) - 2).cast("string"))
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.when(F.size(firsts) <= 3, F.array_join(firsts, ", ")).otherwise(more))
