"""Tapbacks: adds and removals replayed to what is still there, and who reacts to whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST_KIND, REMOVE_KIND, LAST_KIND = 2000, 3000, 3999
LAUGH, CUSTOM = 2003, 2006
MIN_MESSAGES, PEOPLE, CHIPS = 150, 12, 4
# What each tapback code shows and says; 2006 shows its own emoji, others default to a thumb.
KINDS = [
    (2000, "❤️", "Loved"),
    (2001, "👍", "Liked"),
    (2002, "👎", "Disliked"),
    (2003, "😂", "Laughed at"),
    (2004, "‼️", "Emphasized"),
    (2005, "❓", "Questioned"),
    (2007, "🏷️", "Reacted with a sticker to"),
]


def is_tapback(kind: Column) -> Column:
    return kind.between(FIRST_KIND, LAST_KIND)


def not_tapback(kind: Column) -> Column:
    return kind.isNull() | ~is_tapback(kind)


def target_of(guid: Column) -> Column:
    """The message a tapback points at: what follows the last slash."""
    return F.substring_index(guid, "/", -1)


def target_after_first(guid: Column) -> Column:
    """What follows the first slash, which is how counts over all tapbacks name a target; all of it without a slash."""
    return F.regexp_replace(guid, "^[^/]*/", "")


def verb(kind: Column, emoji: Column) -> Column:
    """What a tapback does, in words."""
    out = F.when((kind == CUSTOM) & emoji.isNotNull() & (emoji != ""), "Reacted")
    for code, _, says in KINDS:
        out = out.when(kind == code, F.lit(says))
    return out.otherwise("Reacted")


def shown(kind: Column, emoji: Column) -> Column:
    """The emoji of a tapback, removal codes included."""
    out = F.when((kind % 1000 == CUSTOM % 1000) & emoji.isNotNull() & (emoji != ""), emoji)
    for code, sign, _ in KINDS:
        out = out.when(kind % 1000 == code % 1000, F.lit(sign))
    return out.otherwise(F.lit("👍"))


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KINDS, "kind int, emoji string, verb string")


def live_tapbacks(tapbacks: DataFrame, reactor: str = "reactor") -> DataFrame:
    """(target, reactor, kind, emoji, ts, id): the last event of each (target, reactor), unless it takes the tapback away."""
    emoji = F.col("emoji") if "emoji" in tapbacks.columns else F.lit(None).cast("string").alias("emoji")
    last = F.max_by(F.struct("kind", emoji, "ts", "id"), F.struct("ts", "id"))
    rows = tapbacks.where(is_tapback(F.col("kind"))).groupBy(target_of(F.col("assoc_guid")).alias("target"), reactor).agg(last.alias("x"))
    return rows.select("target", reactor, "x.*").where(F.col("kind") < REMOVE_KIND)


def tapback_chips(live: DataFrame, most: int = 3) -> DataFrame:
    """(target, emojis, n): the first different emojis on each message in order of time, and how many tapbacks it has."""
    each = live.withColumn("sign", shown(F.col("kind"), F.col("emoji")))
    first = each.groupBy("target", "sign").agg(F.min(F.struct("ts", "id")).alias("at"), F.count("*").alias("n"))
    got = first.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("at", "sign"))).alias("s"), F.sum("n").alias("n"))
    return got.select("target", F.slice(F.transform("s", lambda x: x["sign"]), 1, most).alias("emojis"), "n")


def tapback_list(live: DataFrame, people: DataFrame | None = None, me: Column | None = None) -> DataFrame:
    """(target, tapbacks array<struct<emoji, verb, who>>) in order of time. ``people`` has reactor and name; ``me`` tells which reactors are me."""
    rows = live.join(people, "reactor", "left") if people is not None else live.withColumn("name", F.lit(None).cast("string"))
    who = F.coalesce("name", F.col("reactor").cast("string"), F.lit("Unknown"))
    who = who if me is None else F.when(me, "You").otherwise(who)
    each = F.struct("ts", "id", F.struct(shown(F.col("kind"), F.col("emoji")).alias("emoji"), verb(F.col("kind"), F.col("emoji")).alias("verb"), who.alias("who")).alias("x"))
    return rows.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(each)), lambda e: e["x"]).alias("tapbacks"))


def reaction_stats(live: DataFrame, messages: DataFrame, person: str = "person", min_messages: int = MIN_MESSAGES, people: int = PEOPLE) -> DataFrame:
    """Per person of one-to-one threads: tapbacks got on my messages and given on theirs, and their rates.

    ``live`` has person, reactor_me, target_me and kind; ``messages`` has person and is_from_me.
    """
    from_them = (F.col("reactor_me") == 0) & (F.col("target_me") == 1)
    from_me = (F.col("reactor_me") == 1) & (F.col("target_me") == 0)
    got = live.groupBy(person).agg(F.count_if(from_them).alias("count"), F.count_if(from_them & (F.col("kind") == LAUGH)).alias("laughs"), F.count_if(from_me).alias("gave_count"))
    volume = messages.groupBy(person).agg(F.count_if(F.col("is_from_me") == 1).alias("my_msgs"), F.count_if(F.col("is_from_me") == 0).alias("their_msgs"))
    rows = volume.where(F.col("my_msgs") >= min_messages).join(got.where(F.col("count") > 0), person)
    return rows.withColumns({
        "rate": F.col("count") / F.col("my_msgs"), "laugh_rate": F.col("laughs") / F.col("my_msgs"), "gave_rate": F.col("gave_count") / F.greatest("their_msgs", F.lit(1)),
    }).orderBy(F.desc("rate"), person).limit(people)


def top_tokens(live: DataFrame, person: str = "person", most: int = CHIPS) -> DataFrame:
    """(person, kind, n): each person's most common tapbacks; ties to the smaller code."""
    n = live.groupBy(person, "kind").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(person).orderBy(F.desc("n"), "kind"))).where(F.col("rank") <= most)
