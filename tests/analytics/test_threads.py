import datetime as dt

from pyspark.sql import functions as F

from parley.operators import circles, media, paging, threads

EPOCH = dt.datetime(2024, 1, 1)


def messages(spark, n=20):
    return spark.createDataFrame([(k, EPOCH + dt.timedelta(seconds=k)) for k in range(1, n + 1)], "id long, ts timestamp_ntz")


def at(k):
    return EPOCH + dt.timedelta(seconds=k), k


def test_pages(spark):
    m = messages(spark)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(paging.around(m, at(10), 2)) == [9, 10, 11, 12]
    assert ids(paging.page(m, after_=at(5), before_=at(3), limit=3)) == [6, 7, 8]
    assert ids(paging.page(m, before_=at(5), limit=3)) == [2, 3, 4]
    assert ids(paging.page(m, from_end=True, limit=2)) == [19, 20]
    assert ids(paging.page(m, start=at(18)[0])) == [18, 19, 20]
    assert paging.has_neighbour(m, at(19), True) and not paging.has_neighbour(m, at(20), True) and not paging.has_neighbour(m, at(1), False)


def test_pages_cover_everything_once(spark):
    m, seen, cursor = messages(spark, 23), [], None
    while rows := paging.page(m, after_=cursor, limit=5).collect():
        seen += [r.id for r in rows]
        cursor = (rows[-1].ts, rows[-1].id)
    assert seen == list(range(1, 24))


def test_cursor_reaches_the_scan(spark, tmp_path):
    messages(spark).write.parquet(f"{tmp_path}/m")
    plan = spark.read.parquet(f"{tmp_path}/m").where(paging.after("ts", "id", at(5)))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or" in plan


def test_media_filters(spark):
    rows = [(1, EPOCH, 1, "image/jpeg", "a.jpg"), (1, EPOCH, 2, "application/pdf", "b.pdf"), (2, EPOCH, 3, None, "C.HEIC"), (2, EPOCH, 4, None, None), (3, EPOCH, 5, "image/png", "x.pluginPayloadAttachment")]
    a = spark.createDataFrame(rows, "msg_id long, ts timestamp_ntz, att_id long, mime string, filename string")
    assert {r.att_id for r in media.media(a).collect()} == {1, 2, 3, 4}
    assert {r.att_id for r in media.media(a, True).collect()} == {1, 3}
    assert media.media_count(a).first().n == 4 and media.named_count(a).first().n == 3


def test_circles_merge_same_people(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "chat_id long, handle string")
    chats = spark.createDataFrame([(1, 10, ""), (2, 15, "Ski"), (3, 50, "")], "chat_id long, n long, title string")
    got = circles.groups(members, chats).collect()
    assert [(r.people, r.chat_id, r.title, r.messages) for r in got] == [(["a", "b"], 2, "Ski", 25)]


def test_busiest_groups_stay(spark):
    n = circles.MAX_GROUPS + 5
    members = spark.createDataFrame([(k, p) for k in range(n) for p in (f"x{k}", f"y{k}")], "chat_id long, handle string")
    chats = spark.createDataFrame([(k, 10 + k) for k in range(n)], "chat_id long, n long")
    assert {r.chat_id for r in circles.groups(members, chats).collect()} == set(range(5, n))


def test_labels(spark):
    row = spark.range(1)
    names = F.array(*(F.lit(x) for x in ("Ada X", "Bob", "Cara", "Dan")))
    assert row.select(circles.short_label(F.lit(""), names)).first()[0] == "Ada, Bob +2"
    assert row.select(circles.short_label(F.lit(" Ski "), names)).first()[0] == "Ski"
    none = F.lit(None).cast("string")
    assert row.select(threads.chat_label(none, none, F.array(F.lit("A"), F.lit("A"), none), F.lit("id"))).first()[0] == "A"
    assert row.select(threads.chat_label(none, none, F.array().cast("array<string>"), none)).first()[0] == "Unknown"


def test_threads_of_one_person_merge(spark):
    members = spark.createDataFrame([(1, "p1", "ann"), (2, "mail", "ann"), (3, "p1", "ann"), (3, "q", "bob"), (4, "z", None)], "chat_id long, handle string, person string")
    assert {r.chat_id: r.thread_id for r in threads.thread_ids(members).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
