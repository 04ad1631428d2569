"""Month-by-month attention: volumes, shares, eras, drift and owners of years."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG_TERM_SPAN_DAYS, LONG_TERM_GAP_DAYS = 365, 90
FELL_OFF_COUNT, FELL_OFF_GAP_DAYS = 30, 180
PEAK_PEOPLE, DRIFT_MONTHS, DRIFT_PEOPLE, DRIFT_MIN, ERA_MIN = 8, 12, 5, 150, 250
_DAY_US = 86_400_000_000


def month_of(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM")


def archive_totals(messages: DataFrame, chat: str = "chat_id") -> DataFrame:
    """One row: messages, chats, first, last and years spanned."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return messages.agg(F.count("*").alias("messages"), F.countDistinct(chat).alias("chats"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn(
        "years", (us(F.col("last_ts")) - us(F.col("first_ts"))) / F.lit(365.0 * _DAY_US)
    )


def contact_stats(messages: DataFrame, handle: str = "handle", as_of: datetime.datetime | None = None) -> DataFrame:
    """Inbound per handle: count, first, last, span_days, gap_days (to ``as_of``, by default the newest message)."""
    found = messages.where("is_from_me = 0").groupBy(handle).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    now = F.lit(as_of).cast("timestamp") if as_of else F.col("as_of").cast("timestamp")
    if not as_of:
        newest = messages.agg(F.max("ts").alias("as_of"))
        found = found.crossJoin(F.broadcast(newest))  # one row
    days = lambda a, b: F.floor((F.unix_micros(a) - F.unix_micros(b)) / _DAY_US)
    first, last = F.col("first_ts").cast("timestamp"), F.col("last_ts").cast("timestamp")
    return found.withColumns({"span_days": days(last, first), "gap_days": days(now, last)}).drop("as_of")


def contact_cards(stats: DataFrame, members: DataFrame, sizes: DataFrame, handle: str = "handle") -> DataFrame:
    """``contact_stats`` with chat_count, the chats that a handle is in (1 where none is known), and chat_id, the one to open (``best_chats``)."""
    chats = members.groupBy("handle").agg(F.countDistinct("chat_id").alias("chat_count")).withColumnRenamed("handle", handle)
    best = best_chats(members, sizes).select(F.col("handle").alias(handle), "chat_id")
    return stats.join(chats, handle, "left").join(best, handle, "left").withColumn("chat_count", F.coalesce("chat_count", F.lit(1)))


def best_chats(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(handle, chat_id, is_dm, n): the chat to open for a handle: a one-to-one chat if there is one, then the largest, then the smallest id."""
    people = members.groupBy("chat_id").agg(F.count("*").alias("members"))
    rows = members.join(people, "chat_id").join(sizes, "chat_id").withColumn("is_dm", (F.col("members") == 1).cast("int"))
    best = F.max_by(F.struct("chat_id", "is_dm", "n"), F.struct("is_dm", "n", -F.col("chat_id")))
    return rows.groupBy("handle").agg(best.alias("b")).select("handle", "b.*")


def long_term(stats: DataFrame, people: int = 10, span_days: int = LONG_TERM_SPAN_DAYS, gap_days: int = LONG_TERM_GAP_DAYS) -> DataFrame:
    return stats.where((F.col("span_days") >= span_days) & (F.col("gap_days") <= gap_days)).orderBy(F.desc("n"), "handle").limit(people)


def fell_off(stats: DataFrame, people: int = 10, count: int = FELL_OFF_COUNT, gap_days: int = FELL_OFF_GAP_DAYS) -> DataFrame:
    return stats.where((F.col("n") >= count) & (F.col("gap_days") >= gap_days)).orderBy(F.desc("n"), "handle").limit(people)


def leaderboard(stats: DataFrame, people: int = 15) -> DataFrame:
    """The busiest handles with their count as a percentage of the largest, rounded half to even."""
    top = stats.orderBy(F.desc("n"), "handle").limit(people)
    most = top.agg(F.max("n").alias("most"))
    return top.crossJoin(F.broadcast(most)).select("handle", "n", F.bround(F.col("n") * F.lit(100.0) / F.col("most"), 1).alias("pct"))


def monthly_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(month_of().alias("month")).agg(F.count_if(F.col("is_from_me") == 0).alias("received"), F.count_if(F.col("is_from_me") == 1).alias("sent"))


def month_spine(messages: DataFrame) -> DataFrame:
    """Every month from the first message's to the last's."""
    ends = messages.agg(F.date_trunc("month", F.min("ts")).cast("date").alias("a"), F.date_trunc("month", F.max("ts")).cast("date").alias("b"))
    months = F.when(F.col("a").isNotNull(), F.sequence("a", "b", F.expr("interval 1 month")))
    return ends.select(F.explode(months).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


def inbound_months(messages: DataFrame, person: str = "person") -> DataFrame:
    """(person, month, n) where n > 0: the sparse form that the other views start from."""
    return messages.where("is_from_me = 0").groupBy(person, month_of().alias("month")).agg(F.count("*").alias("n"))


def monthly_by_person(messages: DataFrame, person: str = "person") -> DataFrame:
    """(person, month, n) on the whole spine of inbound messages, zeros included."""
    inbound = messages.where("is_from_me = 0")
    spine = month_spine(inbound)  # a row for each month: hundreds at most
    grid = inbound.select(person).distinct().crossJoin(F.broadcast(spine))
    return grid.join(inbound_months(messages, person), [person, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dominant_handles(messages: DataFrame, person: str = "person") -> DataFrame:
    """(person, handle, total): the handle most inbound messages came from; ties to the smaller."""
    each = messages.where("is_from_me = 0").groupBy(person, "handle").agg(F.count("*").alias("n"))
    return each.groupBy(person).agg(F.max_by("handle", F.struct("n", -F.col("handle"))).alias("handle"), F.sum("n").alias("total"))


def trim_partial_month(months: DataFrame, as_of: str | None = None) -> DataFrame:
    """Drop the month of ``as_of`` (yyyy-MM): its counts are incomplete."""
    return months if as_of is None else months.where(F.col("month") != as_of)


def people_peaks(messages: DataFrame, person: str = "person", people: int = PEAK_PEOPLE) -> DataFrame:
    """(person, total, peak_month, peak_n): the most-texted people and the first of their busiest months."""
    each = inbound_months(messages, person)
    found = each.groupBy(person).agg(F.sum("n").alias("total"), F.min_by(F.struct("month", "n"), F.struct(-F.col("n"), "month")).alias("p"))
    return found.orderBy(F.desc("total"), person).limit(people).select(person, "total", F.col("p.month").alias("peak_month"), F.col("p.n").alias("peak_n"))


def month_shares(messages: DataFrame, person: str = "person", as_of: str | None = None) -> DataFrame:
    """(person, month, n, share of the month's inbound)."""
    each = trim_partial_month(inbound_months(messages, person), as_of)
    total = each.groupBy("month").agg(F.sum("n").alias("all"))
    return each.join(F.broadcast(total), "month").select(person, "month", "n", (F.col("n") / F.col("all")).alias("share"))


def people_eras(messages: DataFrame, person: str = "person", min_total: int = ERA_MIN, as_of: str | None = None) -> DataFrame:
    """(person, total, peak_month, peak_share) of people with enough messages, oldest peak first."""
    found = month_shares(messages, person, as_of).groupBy(person).agg(F.sum("n").alias("total"), F.min_by(F.struct("month", "share"), F.struct(-F.col("share"), "month")).alias("p"))
    rows = found.where(F.col("total") >= min_total).select(person, "total", F.col("p.month").alias("peak_month"), F.col("p.share").alias("peak_share"))
    return rows.orderBy("peak_month", F.desc("total"), person)


def people_drift(messages: DataFrame, person: str = "person", window: int = DRIFT_MONTHS, min_messages: int = DRIFT_MIN, as_of: str | None = None) -> DataFrame:
    """(person, prev, recent, share_prev, share_now, drift): the last ``window`` months against the ones before.

    Empty where the spine has fewer than two windows.
    """
    spine = trim_partial_month(month_spine(messages.where("is_from_me = 0")), as_of)
    w = Window.orderBy(F.desc("month"))  # over months only
    recent = spine.withColumn("back", F.row_number().over(w)).where(F.col("back") <= 2 * window)
    whole = recent.agg(F.count("*").alias("months")).where(F.col("months") == 2 * window)
    recent = recent.crossJoin(F.broadcast(whole)).select("month", (F.col("back") <= window).alias("now"))
    rows = inbound_months(messages, person).join(F.broadcast(recent), "month")
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    each = rows.groupBy(person).agg(n(~F.col("now")).alias("prev"), n(F.col("now")).alias("recent"))
    total = each.agg(F.greatest(F.sum("prev"), F.lit(1)).alias("all_prev"), F.greatest(F.sum("recent"), F.lit(1)).alias("all_now"))
    kept = each.where(F.col("prev") + F.col("recent") >= min_messages).crossJoin(F.broadcast(total))
    return kept.select(person, "prev", "recent", (F.col("prev") / F.col("all_prev")).alias("share_prev"), (F.col("recent") / F.col("all_now")).alias("share_now")).withColumn(
        "drift", F.col("share_now") - F.col("share_prev")
    )


def rising(drift: DataFrame, person: str = "person", people: int = DRIFT_PEOPLE) -> DataFrame:
    return drift.where("drift > 0").orderBy(F.desc("drift"), person).limit(people)


def faded(drift: DataFrame, person: str = "person", people: int = DRIFT_PEOPLE) -> DataFrame:
    """The largest losses, listed from the smallest of them to the largest."""
    return drift.where("drift < 0").orderBy("drift", F.desc(person)).limit(people).orderBy(F.desc("drift"), person)


def year_owners(messages: DataFrame, person: str = "person", as_of: str | None = None) -> DataFrame:
    """(year, person, n, share): who held most of each year's inbound; ties to the smaller person."""
    each = trim_partial_month(inbound_months(messages, person), as_of).groupBy(F.substring("month", 1, 4).alias("year"), person).agg(F.sum("n").alias("n"))
    best = each.groupBy("year").agg(F.sum("n").alias("all"), F.min_by(F.struct(person, "n"), F.struct(-F.col("n"), person)).alias("b"))
    return best.select("year", f"b.{person}", "b.n", (F.col("b.n") / F.col("all")).alias("share"))


def effective_people(messages: DataFrame, person: str = "person", as_of: str | None = None) -> DataFrame:
    """(month, people): the inverse Simpson index of shares."""
    return month_shares(messages, person, as_of).groupBy("month").agg((1 / F.sum(F.col("share") * F.col("share"))).alias("people"))


def heatmap(messages: DataFrame) -> DataFrame:
    """(day, mode, n, level 0-4, week_start): counts of all, received and sent messages by day; levels are quarters of each mode's largest day."""
    day = messages.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("all"), F.count_if(F.col("is_from_me") == 0).alias("recv"), F.count_if(F.col("is_from_me") == 1).alias("sent"))
    rows = day.unpivot("day", ["all", "recv", "sent"], "mode", "n")
    most = rows.groupBy("mode").agg(F.max("n").alias("most"))
    share = F.col("n") / F.col("most")
    level = F.when(F.col("n") == 0, 0).when(share <= 0.25, 1).when(share <= 0.5, 2).when(share <= 0.75, 3).otherwise(4)
    return rows.join(F.broadcast(most), "mode").select("day", "mode", "n", level.alias("level"), F.date_sub("day", F.dayofweek("day") - 1).alias("week_start"))
