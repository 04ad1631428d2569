"""Times on columns: the archive's nanosecond clock, day and month labels, gaps and estimates. All in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: seconds from 1970-01-01 to the archive's epoch, 2001-01-01.
ARCHIVE_EPOCH = 978_307_200


def from_archive_ns(ns: Column) -> Column:
    """A timestamp from nanoseconds since 2001, cut to microseconds."""
    return F.timestamp_micros(((ns - F.pmod(ns, F.lit(1000))) / 1000).cast("long") + F.lit(ARCHIVE_EPOCH * 1_000_000)).cast("timestamp_ntz")


def to_archive_ns(day: Column) -> Column:
    """Nanoseconds since 2001 of the midnight that begins a day."""
    return (F.unix_micros(F.to_date(day).cast("timestamp")) - F.lit(ARCHIVE_EPOCH * 1_000_000)) * 1000


def day_label(day: Column, as_of: Column) -> Column:
    """Today, Yesterday, a weekday within the week, else the date, with the year once it differs."""
    d, now = F.to_date(day), F.to_date(as_of)
    back = F.datediff(now, d)
    return (
        F.when(back == 0, "Today").when(back == 1, "Yesterday").when(back.between(2, 6), F.date_format(d, "EEEE"))
        .when(F.year(d) == F.year(now), F.date_format(d, "MMMM d")).otherwise(F.date_format(d, "MMMM d, yyyy"))
    )


def month_label(month: Column) -> Column:
    return F.date_format(F.to_date(month, "yyyy-MM"), "MMMM yyyy")


def short_month(month: Column) -> Column:
    return F.date_format(F.to_date(month, "yyyy-MM"), "MMM yy")


def gap_label(seconds: Column) -> Column:
    """Seconds, minutes, hours or days, whichever fits."""
    whole = lambda by, unit: F.concat(F.bround(seconds / by).cast("long").cast("string"), F.lit(unit))
    return F.when(seconds < 60, whole(1, " s")).when(seconds < 3600, whole(60, " min")).when(seconds < 86400, whole(3600, " h")).otherwise(whole(86400, " d"))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Time left at the rate so far; null before anything is done."""
    return F.when(done > 0, elapsed / done * F.greatest(total - done, F.lit(0)))


def week_start(day: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def cloud_size(n: Column, most: Column) -> Column:
    """The relative size of a word in a cloud."""
    return F.pow(n / most, F.lit(0.45))
