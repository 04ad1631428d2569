import datetime as dt

import pytest

from parley.operators import people, sessions, tapbacks
from parley.operators.ordered import with_next, with_previous

EPOCH = dt.datetime(2024, 1, 1)


def events(spark, rows, key=1):
    data = [(key, EPOCH + dt.timedelta(seconds=s), k, me) for k, (s, me) in enumerate(rows)]
    return spark.createDataFrame(data, "handle long, ts timestamp_ntz, id long, is_from_me int")


def test_sessions_split_on_long_pauses(spark):
    got = sessions.sessions(events(spark, [(0, 0), (300, 1), (300 + 5 * 3600, 1)])).orderBy("ts").collect()
    assert [((r.ts - EPOCH).total_seconds(), r.opener) for r in got] == [(0, 0), (300 + 5 * 3600, 1)]


def test_exact_gap_stays_in_session(spark):
    rows = events(spark, [(0, 0), (4 * 3600, 1), (8 * 3600 + 1, 1)])
    assert sessions.sessions(rows).count() == 2
    assert sorted(r.n for r in sessions.session_windows(rows).collect()) == [1, 2]


def test_both_session_forms_agree(spark):
    import random

    rng, at, rows = random.Random(4), 0, []
    for _ in range(400):
        at += rng.choice([60, 3600, 4 * 3600, 4 * 3600 + 1, 9 * 86400])
        rows.append((at, rng.randint(0, 1)))
    e = events(spark, rows)
    a = {(r.ts, r.opener) for r in sessions.sessions(e).collect()}
    assert a == {(r.ts, r.opener) for r in sessions.session_windows(e).collect()}


def test_neighbours_across_slices(spark):
    e = events(spark, [(0, 0), (10, 1), (90 * 86400, 0), (90 * 86400 + 5, 1)])
    back = with_previous(e, "handle", ["id"]).orderBy("id").collect()
    assert [r.prev_id for r in back] == [None, 0, 1, 2]
    ahead = with_next(e, "handle", ["id"]).orderBy("id").collect()
    assert [r.next_id for r in ahead] == [1, 2, 3, None]


def test_reply_gap_runs_from_first_message(spark):
    got = sessions.reply_gaps(events(spark, [(0, 0), (60, 0), (300, 1)])).collect()
    assert [(r.seconds, r.is_from_me) for r in got] == [(300.0, 1)]


def test_late_reply_is_none(spark):
    assert sessions.reply_gaps(events(spark, [(0, 0), (25 * 3600, 1)])).count() == 0


def test_monthly_medians(spark):
    rows = [(1, EPOCH, k, float(s), 1) for k, s in enumerate((10, 20, 30, 40, 500))]
    gaps = spark.createDataFrame(rows, "handle long, ts timestamp_ntz, id long, seconds double, is_from_me int")
    assert [r.median_seconds for r in sessions.monthly_medians(gaps).collect()] == [30.0]
    assert sessions.monthly_medians(gaps.limit(2)).count() == 0


@pytest.mark.parametrize(("months", "want"), [([{1: 10}, {1: 10}], [1.0, 1.0]), ([{1: 5, 2: 5, 3: 5, 4: 5}], [4.0]), ([{}, {1: 2}], [1.0])])
def test_effective_people(spark, months, want):
    rows = [(p, dt.datetime(2024, m + 1, 3), 0) for m, counts in enumerate(months) for p, n in counts.items() for _ in range(n)]
    m = spark.createDataFrame(rows, "person long, ts timestamp_ntz, is_from_me int")
    assert [round(r.people, 9) for r in people.effective_people(m).orderBy("month").collect()] == want


def test_hour_break_is_inclusive(spark):
    rows = sessions.message_groups(events(spark, [(0, 0), (3600, 0), (3600 + 3599, 0)]).withColumnRenamed("handle", "chat_id")).orderBy("id").collect()
    assert [r.time_break for r in rows] == [False, True, False]


def test_removed_tapback(spark):
    t = EPOCH
    rows = [(1, t, 7, 2000, "p:0/target-a"), (2, t, 7, 2001, "target-b"), (3, t, 7, 2002, "p:3/target-c"), (4, t + dt.timedelta(1), 7, 3000, "p:0/target-a")]
    live = tapbacks.live_tapbacks(spark.createDataFrame(rows, "id long, ts timestamp_ntz, reactor long, kind int, assoc_guid string"))
    assert {(r.target, r.kind) for r in live.collect()} == {("target-b", 2001), ("target-c", 2002)}


def test_drift_needs_two_windows(spark):
    rows = [(p, dt.datetime(2022 + k // 12, k % 12 + 1, 1), 0) for k in range(24) for p, n in ((1, 10 if k < 12 else 2), (2, 3)) for _ in range(n)]
    m = spark.createDataFrame(rows, "person long, ts timestamp_ntz, is_from_me int")
    drift = people.people_drift(m, min_messages=10)
    assert [r.person for r in people.rising(drift).collect()] == [2] and [r.person for r in people.faded(drift).collect()] == [1]
    assert people.people_drift(m.where("ts > '2022-02-01'"), min_messages=1).count() == 0
