"""Sessions, openers, turn-taking and reply times of one-to-one threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.ordered import micros, with_next, with_previous

SESSION_GAP_SECONDS = 4 * 3600
REPLY_CAP_SECONDS = 24 * 3600
MIN_REPLIES, MIN_MONTH_REPLIES, LATENCY_PEOPLE = 40, 5, 10
MIN_SESSIONS, INITIATION_PEOPLE = 25, 14
BREAK_SECONDS = 3600
_US = 1_000_000


def sessions(events: DataFrame, key: str = "handle", gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """(key, ts, id, opener): the first event of each session; a pause of exactly the gap does not end one."""
    near = with_previous(events, key, ["ts"])
    fresh = F.col("prev_ts").isNull() | (micros("ts") - micros("prev_ts") > gap_seconds * _US)
    return near.where(fresh).select(key, "ts", "id", F.col("is_from_me").alias("opener"))


def session_windows(events: DataFrame, key: str = "handle", gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """The same sessions by the engine's session window, with sizes; works on streams too."""
    # a session window closes at last + gap exclusively; one microsecond more keeps an exact gap inside
    width = f"{gap_seconds * _US + 1} microseconds"
    found = events.withColumn("at", F.col("ts").cast("timestamp")).groupBy(key, F.session_window("at", width).alias("w"))
    return found.agg(F.count("*").alias("n"), F.min_by("is_from_me", F.struct("at", "id")).alias("opener")).select(
        key, F.col("w.start").cast("timestamp_ntz").alias("ts"), "n", "opener"
    )


def initiation_by_year(events: DataFrame, key: str = "handle", gap_seconds: int = SESSION_GAP_SECONDS, min_sessions: int = MIN_SESSIONS) -> DataFrame:
    """(key, year, mine, total) for every key with enough sessions, the ones that a top list cuts included."""
    by_year = sessions(events, key, gap_seconds).groupBy(key, F.year("ts").alias("year")).agg(F.sum("opener").alias("mine"), F.count("*").alias("total"))
    enough = by_year.groupBy(key).agg(F.sum("total").alias("all")).where(F.col("all") >= min_sessions).select(key)
    return by_year.join(enough, key, "left_semi")


def initiation(events: DataFrame, key: str = "handle", gap_seconds: int = SESSION_GAP_SECONDS, min_sessions: int = MIN_SESSIONS, people: int = INITIATION_PEOPLE) -> DataFrame:
    """(key, mine, total, share): who speaks first; the busiest by sessions, largest share first."""
    total = sessions(events, key, gap_seconds).groupBy(key).agg(F.sum("opener").alias("mine"), F.count("*").alias("total"))
    top = total.where(F.col("total") >= min_sessions).orderBy(F.desc("total"), key).limit(people)
    return top.withColumn("share", F.col("mine") / F.col("total")).orderBy(F.desc("share"), key)


def reply_gaps(events: DataFrame, key: str = "handle", cap_seconds: int = REPLY_CAP_SECONDS) -> DataFrame:
    """(key, ts, id, seconds, is_from_me): from the first message of one side's run to the first of the other's.

    A reply later than the cap is no reply, but the clock starts again with it.
    """
    runs = with_previous(events, key, ["is_from_me"]).where(F.col("prev_is_from_me").isNull() | (F.col("prev_is_from_me") != F.col("is_from_me")))
    runs = with_previous(runs.select(key, "ts", "id", "is_from_me"), key, ["ts"])
    seconds = (micros("ts") - micros("prev_ts")) / F.lit(float(_US))
    return runs.where(F.col("prev_ts").isNotNull()).select(key, "ts", "id", seconds.alias("seconds"), "is_from_me").where(F.col("seconds") <= cap_seconds)


def monthly_medians(gaps: DataFrame, key: str = "handle", min_replies: int = MIN_MONTH_REPLIES) -> DataFrame:
    """(key, is_from_me, month, median_seconds, n) of months with enough replies."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    return gaps.groupBy(key, "is_from_me", month).agg(F.median("seconds").alias("median_seconds"), F.count("*").alias("n")).where(F.col("n") >= min_replies)


def reply_latency(events: DataFrame, key: str = "handle", cap_seconds: int = REPLY_CAP_SECONDS, min_replies: int = MIN_REPLIES, people: int = LATENCY_PEOPLE) -> DataFrame:
    """(key, total, my_median, their_median, my_replies, their_replies): the busiest people with replies on both sides, fastest of mine first."""
    mine, theirs = F.col("is_from_me") == 1, F.col("is_from_me") == 0
    sides = reply_gaps(events, key, cap_seconds).groupBy(key).agg(
        F.median(F.when(mine, F.col("seconds"))).alias("my_median"), F.median(F.when(theirs, F.col("seconds"))).alias("their_median"),
        F.count_if(mine).alias("my_replies"), F.count_if(theirs).alias("their_replies"),
    )
    enough = sides.where(F.least("my_replies", "their_replies") >= min_replies)
    total = events.groupBy(key).agg(F.count("*").alias("total"))
    return enough.join(total, key).orderBy(F.desc("total"), key).limit(people).orderBy("my_median", key)


def latency_segments(medians: DataFrame, key: str = "handle") -> DataFrame:
    """Number the line segments of a median series: a pause of over two months starts a new one."""
    n = F.year(F.to_date("month", "yyyy-MM")) * 12 + F.month(F.to_date("month", "yyyy-MM"))
    w = Window.partitionBy(key, "is_from_me").orderBy("month")
    jump = F.coalesce((n - F.lag(n).over(w) > 2).cast("int"), F.lit(0))
    return medians.withColumn("segment", F.sum(jump).over(w))


def group_flags(rows: DataFrame, sender: str = "is_from_me", break_seconds: int = BREAK_SECONDS) -> DataFrame:
    """Display flags from prev_ and next_ columns of ts and sender, which are dropped."""
    day = lambda c: F.to_date(c)
    new_day = F.col("prev_ts").isNull() | (day("prev_ts") != day("ts"))
    pause = F.coalesce(micros("ts") - micros("prev_ts") >= break_seconds * _US, F.lit(False))
    after = F.coalesce(micros("next_ts") - micros("ts") >= break_seconds * _US, F.lit(False))
    ends = F.col("next_ts").isNull() | (day("next_ts") != day("ts")) | after | (F.col(f"next_{sender}") != F.col(sender))
    return rows.withColumns({"new_day": new_day, "time_break": pause}).withColumns(
        {"group_start": F.col("new_day") | F.col("time_break") | (F.col(f"prev_{sender}") != F.col(sender)), "group_end": ends}
    ).drop("prev_ts", "next_ts", f"prev_{sender}", f"next_{sender}")


def message_groups(events: DataFrame, key: str = "chat_id", sender: str = "is_from_me", break_seconds: int = BREAK_SECONDS) -> DataFrame:
    """Display flags: new_day, time_break (a pause of the break or more), group_start and group_end (a change of day, pause or sender)."""
    return group_flags(with_next(with_previous(events, key, ["ts", sender]), key, ["ts", sender]), sender, break_seconds)


def time_breaks(events: DataFrame, key: str = "chat_id", break_seconds: int = BREAK_SECONDS) -> DataFrame:
    return message_groups(events, key, break_seconds=break_seconds).groupBy(key).agg(
        F.count_if("time_break").alias("breaks"), F.count_if("group_start").alias("groups"), F.count_if("new_day").alias("days")
    )
