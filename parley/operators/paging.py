"""Keyset pages of a thread or of media: no offsets, so any page costs as much as the first."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import sessions

PAGE, HALF = 150, 75
Cursor = tuple[datetime.datetime, int]


def after(ts: str, tie: str, cursor: Cursor, inclusive: bool = False) -> Column:
    """(ts, tie) > cursor, written so that the bound on ts reaches the scan."""
    at, tie_at = F.lit(cursor[0]), cursor[1]
    same = F.col(tie) >= tie_at if inclusive else F.col(tie) > tie_at
    return (F.col(ts) > at) | ((F.col(ts) == at) & same)


def before(ts: str, tie: str, cursor: Cursor, inclusive: bool = False) -> Column:
    at, tie_at = F.lit(cursor[0]), cursor[1]
    same = F.col(tie) <= tie_at if inclusive else F.col(tie) < tie_at
    return (F.col(ts) < at) | ((F.col(ts) == at) & same)


def page(rows: DataFrame, ts: str = "ts", tie: str = "id", after_: Cursor | None = None, before_: Cursor | None = None,
         start: datetime.datetime | None = None, from_end: bool = False, limit: int = PAGE) -> DataFrame:
    """One page in ascending order. ``after_`` wins over ``before_``, which wins over ``start``, then ``from_end``."""
    up, down = [F.col(ts), F.col(tie)], [F.col(ts).desc(), F.col(tie).desc()]
    if after_ is not None:
        return rows.where(after(ts, tie, after_)).orderBy(*up).limit(limit)
    if before_ is not None:
        return rows.where(before(ts, tie, before_)).orderBy(*down).limit(limit).orderBy(*up)
    if start is not None:
        return rows.where(F.col(ts) >= F.lit(start)).orderBy(*up).limit(limit)
    if from_end:
        return rows.orderBy(*down).limit(limit).orderBy(*up)
    return rows.orderBy(*up).limit(limit)


def page_with_context(
    rows: DataFrame, ts: str = "ts", tie: str = "id", sender: str = "is_from_me", after_: Cursor | None = None, before_: Cursor | None = None,
    start: datetime.datetime | None = None, from_end: bool = False, limit: int = PAGE, break_seconds: int = sessions.BREAK_SECONDS,
) -> DataFrame:
    """``page`` of one thread with the display flags of ``sessions.message_groups``, as they are in the whole thread.

    A page knows one row on each side: the row across its cursor, found by a seek from the cursor, and the row that one more than
    ``limit`` brings at the other end. So the first row of a page opens no new day or group that the page before has begun, and its last
    row closes none that goes on. No window runs over the thread, only over these ``limit + 2`` rows at most.
    """
    up, down = [F.col(ts), F.col(tie)], [F.col(ts).desc(), F.col(tie).desc()]
    back = after_ is None and (before_ is not None or (start is None and from_end))
    if after_ is not None:
        own, across = rows.where(after(ts, tie, after_)), rows.where(before(ts, tie, after_, inclusive=True))
    elif before_ is not None:
        own, across = rows.where(before(ts, tie, before_)), rows.where(after(ts, tie, before_, inclusive=True))
    elif start is not None:
        own, across = rows.where(F.col(ts) >= F.lit(start)), rows.where(F.col(ts) < F.lit(start))
    else:
        own, across = rows, None
    place = Window.orderBy(*(down if back else up))  # over limit + 1 rows
    near = own.orderBy(*(down if back else up)).limit(limit + 1).withColumn("_own", F.row_number().over(place) <= limit)
    if across is not None:
        near = near.unionByName(across.orderBy(*(up if back else down)).limit(1).withColumn("_own", F.lit(False)))
    order = Window.orderBy(*up)
    beside = {f"{side}_{name}": f(c).over(order) for side, f in (("prev", F.lag), ("next", F.lead)) for name, c in (("ts", ts), (sender, sender))}
    return sessions.group_flags(near.withColumns(beside), sender, break_seconds).where("_own").drop("_own").orderBy(*up)


def around(rows: DataFrame, cursor: Cursor, half: int = HALF, ts: str = "ts", tie: str = "id") -> DataFrame:
    """``half`` rows up to and including the cursor, and as many after it."""
    left = rows.where(before(ts, tie, cursor, inclusive=True)).orderBy(F.desc(ts), F.desc(tie)).limit(half)
    right = rows.where(after(ts, tie, cursor)).orderBy(ts, tie).limit(half)
    return left.unionByName(right).orderBy(ts, tie)


def has_neighbour(rows: DataFrame, cursor: Cursor, forward: bool, ts: str = "ts", tie: str = "id") -> bool:
    side = after if forward else before
    return not rows.where(side(ts, tie, cursor)).limit(1).isEmpty()
