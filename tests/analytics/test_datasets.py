import datetime as dt

from pyspark.sql import functions as F

from parley.operators import curation, retrieval, runs, scoring, turns
from parley.sources import contacts, jsonl

HOUR = 3600


def bubbles(spark, rows, chat=1):
    return spark.createDataFrame([(chat, k, role, text, sec) for k, (role, text, sec) in enumerate(rows)], "chat_id long, msg_no long, role string, text string, sec long")


def test_turns_and_sessions(spark):
    b = bubbles(spark, [("user", "a", 0), ("user", "b", 60), ("user", " ", 70), ("user", "c", 60 + 31 * 60), ("assistant", "d", 7200), ("user", "e", 7200 + 24 * HOUR), ("assistant", "f", 7300 + 24 * HOUR)])
    t = turns.sessionize(turns.collapse_turns(b)).orderBy("turn_no").collect()
    assert [(r.content, r.session_no) for r in t] == [("a※b", 1), ("c", 1), ("d", 1), ("e", 2), ("f", 2)]


def test_windows_do_not_cross_sessions(spark):
    b = bubbles(spark, [("assistant", "x", 0), ("user", "a", 10), ("assistant", "d", 20), ("user", "e", 24 * HOUR), ("assistant", "f", 24 * HOUR + 9)])
    s = turns.sessionize(turns.collapse_turns(b))
    got = turns.context_windows(s).orderBy("turn_no").collect()
    assert [[(m.role, m.content) for m in r.messages] for r in got] == [[("user", "a"), ("assistant", "d")], [("user", "e"), ("assistant", "f")]]
    assert [r.reply for r in turns.openers(s).collect()] == ["x"]


def messages(*pairs):
    return F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in pairs))


def test_chat_shapes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    m = messages(("assistant", "z"), ("user", "a"), ("user", "b"), ("assistant", "c"))
    assert [tuple(x) for x in one(turns.merge_roles(m))] == [("user", "a※b"), ("assistant", "c")]
    assert one(turns.is_alternating(messages(("user", "a"), ("assistant", "b")))) and not one(turns.is_alternating(messages(("user", "a"), ("user", "b"), ("assistant", "c"))))
    long = messages(("user", "x" * 100), ("assistant", "y" * 100), ("user", "hi"), ("assistant", "yo"))
    assert [x.content for x in one(turns.fit_messages(long, 10))] == ["hi", "yo"]
    assert one(turns.fit_messages(long, 0)) is None
    assert one(turns.last_of(long, "user")) == "hi"


def test_caps(spark):
    rows = [(k, "lol", k, k) for k in range(10)] + [(k, "on my way home", k, k) for k in range(10, 19)]
    kept = curation.cap_duplicates(spark.createDataFrame(rows, "id long, reply string, sec long, msg_no long")).collect()
    assert sorted(r.id for r in kept) == [8, 9, 15, 16, 17, 18]
    left = curation.cap_low_signal_share(spark.createDataFrame(rows, "id long, reply string, sec long, msg_no long"), 0.25).collect()
    assert sorted(r.id for r in left) == [7, 8, 9, *range(10, 19)]


def examples(spark, n=300):
    return spark.createDataFrame([(k % 20, 1 + k % 3, k, k * 86400, k, f"reply {k}") for k in range(n)], "chat_id long, session_no long, turn_no long, sec long, msg_no long, reply string")


def test_splits_keep_sessions_whole(spark):
    e = examples(spark)
    got = curation.split_chrono(e, ["chat_id", "session_no"]).collect()
    assert len(got) == 300
    where = {}
    for r in got:
        where.setdefault((r.chat_id, r.session_no), set()).add(r.split)
    assert all(len(s) == 1 for s in where.values())
    firsts = sorted((min(r.sec for r in got if (r.chat_id, r.session_no) == u), next(iter(s))) for u, s in where.items())
    order = ["train", "valid", "test"]
    assert [order.index(s) for _, s in firsts] == sorted(order.index(s) for _, s in firsts)
    few = curation.split_chrono(e.where("chat_id = 0"), ["chat_id", "session_no"])
    assert {r.split for r in few.collect()} == {"train", "valid", "test"}


def test_stratified_split(spark):
    got = curation.split_stratified(examples(spark, 3000)).groupBy("split").count().collect()
    n = {r.split: r["count"] for r in got}
    assert set(n) == {"train", "valid", "test"} and n["train"] > 4 * n["valid"] and sum(n.values()) <= 3000


def test_samples(spark):
    e = examples(spark)
    small, large = ({r.msg_no for r in curation.sample(e, ["msg_no"], k).collect()} for k in (10, 30))
    assert small < large
    kept = curation.downsample_recency(e, ["msg_no"], half_life=20.0).collect()
    assert 60 <= len(kept) < 200 and sum(r.msg_no > 150 for r in kept) > len(kept) / 2 and e.columns == curation.downsample_recency(e, ["msg_no"]).columns
    assert curation.downsample_recency(e.limit(6), ["msg_no"], floor=0.0, half_life=0.001).count() == 6
    picks = curation.depth_sample(e, ["msg_no"], F.col("msg_no") % 8, most=20).collect()
    assert len({r.msg_no for r in picks}) == len(picks) and all(r.depth >= r.bucket for r in picks)


def test_retrieval(spark):
    index = retrieval.index_rows(spark.createDataFrame([(1, "are you coming", "yes", "a", 100), (2, "are we going", "no", "b", 100), (3, "xyz", "q", "", 0), (4, "", "q", "", 0)], "id long, query string, reply string, peer string, sec long"))
    q = spark.createDataFrame([(1, "are you there", "b"), (2, "are you coming", "")], "qid long, query string, peer string")
    got = [(r.qid, r.id) for r in retrieval.retrieve(q, index).orderBy("qid", "place").collect()]
    assert got == [(1, 1), (1, 2), (2, 2)]
    assert index.count() == 3


def test_scoring(spark):
    rows = spark.createDataFrame([(k, float(k % 7), float(k % 5) - 10, k % 9 + 1, k % 3) for k in range(200)], "id long, a double, b double, turn int, depth int")
    ci = scoring.bootstrap(rows, "a", "id", rounds=200).first()
    assert ci.low < ci.mean < ci.high and ci.high - ci.low < 1.5
    assert scoring.paired_win_rate(rows, "a", "b", "id", rounds=50).first().p == 1.0
    assert scoring.by_turn_and_depth(rows, "a").count() == 5 + 3 + 1
    c = spark.createDataFrame([("x", 0.002, 0.99), ("y", 0.3, 0.5)], "checkpoint string, delta double, p double")
    assert scoring.pick_checkpoint(c, "base").first()[0] == "base"
    c = spark.createDataFrame([("x", 0.6, 0.99), ("y", 0.3, 0.97)], "checkpoint string, delta double, p double")
    assert scoring.pick_checkpoint(c, "base").first()[0] == "x"
    same = spark.createDataFrame([(1, "see you at 7?", "see you at 7?", "hm")], "id long, pred string, gold string, prompt string")
    d = scoring.style_distance(same, incoming="prompt").first()
    assert d.style_distance == 0 and d.vocab_overlap == 1
    swapped = {r.id: r.text for r in scoring.probes(rows.select("id", F.col("id").cast("string").alias("gold"))).where("kind = 'swapped'").collect()}
    assert all(int(t) == (k + 100) % 200 for k, t in swapped.items())


def test_runs(spark):
    lines = [("r", 1, "\x1b[1mIter 20: Train loss 1.231, Learning Rate 1e-4, Tokens/sec 245.5, Peak mem 4.321 GB"), ("r", 2, "Iter 20: Val loss 1.5"), ("r", 3, "RuntimeError: out of memory")]
    df = spark.createDataFrame(lines, "run string, n int, line string")
    m = runs.merge_metrics(runs.parse_log(df)).first()
    assert (m.iter, m.train_loss, m.val_loss, m.learning_rate, m.tokens_per_sec, m.peak_mem_gb) == (20, 1.231, 1.5, 1e-4, 245.5, 4.321)
    assert runs.last_errors(df).first().error.startswith("RuntimeError")
    losses = [2.0, 1.5, 1.495, 1.6, 1.6, 1.6, 1.6, 1.6, 0.1]
    stop = runs.early_stop(spark.createDataFrame([("r", k, x) for k, x in enumerate(losses)], "run string, iter long, loss double")).first()
    assert (stop.best, stop.best_iter, stop.stop_iter) == (1.5, 1, 7)


def test_contacts(spark):
    cards = spark.createDataFrame([(1, 0, "Ann", "Lee", "", ""), (2, 1, "", None, "", "Org")], "card long, file_order int, first string, last string, nick string, org string")
    book = contacts.directory(cards, spark.createDataFrame([(1, 0, "+1 555 010 9999"), (2, 1, "(555) 010-9999"), (1, 0, "a@x.com")], "card long, file_order int, value string"))
    got = {r.handle: (r.name, r.person) for r in contacts.resolve(spark.createDataFrame([("5550109999",), ("A@X.com",), ("new@y.com",)], "handle string"), book).collect()}
    assert got == {"5550109999": ("Org", "card:2"), "A@X.com": ("Ann Lee", "card:1"), "new@y.com": (None, "email:new@y.com")}
    png = b"\x01\x89PNG" + b"x" * 200
    pics = spark.createDataFrame([(1, "A", "", "", "", bytearray(png)), (2, "B", "", "", "", bytearray(png)), (3, "C", "", "", "", bytearray(png + b"1")), (4, "D", "", "", "", bytearray(b"tiny"))], "card long, first string, last string, nick string, org string, image binary")
    assert [(r.card, r.kind) for r in contacts.photos(pics).collect()] == [(3, "png")]


def test_json_lines(spark, tmp_path):
    rows = [(k, [("user", "a"), ("assistant", str(k))], "train" if k < 8 else "valid") for k in range(10)]
    df = spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>, split string")
    jsonl.write_splits(df, f"{tmp_path}/d")
    back = jsonl.read(spark, f"{tmp_path}/d/train", jsonl.EXAMPLE)
    assert {r.messages[1].content for r in back.collect()} == {str(k) for k in range(8)}
    assert jsonl.fingerprint(df.select("id")).first() == jsonl.fingerprint(df.select("id").orderBy(F.desc("id"))).first()


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    from parley.plans.scratch import ship_package
    from parley.sources.sqlite import SqliteSource

    with sqlite3.connect(f"{tmp_path}/x.db") as conn:
        conn.execute("CREATE TABLE message (guid TEXT, date INTEGER, body BLOB)")
        conn.executemany("INSERT INTO message VALUES (?, ?, ?)", [(f"g{k}", k * 10, b"x") for k in range(25)])
    ship_package(spark)
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("path", f"{tmp_path}/x.db").option("table", "message").option("rows", "10").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 25 and df.agg(F.sum("date")).first()[0] == 3000


def test_streams(spark, tmp_path):
    from parley.operators import tapbacks
    from parley.streaming import index, live

    t = dt.datetime(2024, 1, 1)
    rows = [(k, t + dt.timedelta(minutes=k), k % 2, 2000 + k % 3 if k % 4 else 3000, f"p:0/g{k % 3}") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, reactor long, kind int, assoc_guid string")
    df.write.parquet(f"{tmp_path}/in")
    q = live.live_tapbacks(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("live_taps").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.target, r.reactor, r.kind) for r in spark.table("live_taps").collect() if r.kind is not None}
    assert got == {(r.target, r.reactor, r.kind) for r in tapbacks.live_tapbacks(df).collect()}
    state = {"version": index.VERSION, "last_msg_id": 5}
    m = spark.createDataFrame([(k, 1, "hi", None) for k in range(8)], "msg_id long, chat_id long, body string, kind int")
    assert index.plan_increment(m, state) == "append" and index.plan_increment(m.limit(3), state) == "rebuild" and index.new_rows(m, 5).count() == 2
