"""Hot chats, sequential deals, and sources: the same rows as the plain forms, without one task for all."""

import math
import random
import re
import sqlite3

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.operators import curation, dataset, ordered, retrieval, scoring, turns
from parley.plans.scratch import save
from parley.sources import contacts, sqlite


@pytest.fixture(autouse=True)
def many_slices(spark):
    """Small tables would make one slice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_turns(rows, gap=1800):
    """(turn_no, role, content, sec, msg_no) of one chat's (msg_no, role, text, sec)."""
    out = []
    for no, role, text, sec in sorted(rows):
        if not text.strip():
            continue
        near = out and (sec is None or last is None or sec - last <= gap)
        if out and out[-1][0] == role and near:
            out[-1][1].append(text)
        else:
            out.append([role, [text], None, None])
        out[-1][2], out[-1][3] = sec, no
        last = sec
    return [(k, r, "※".join(t), s, n) for k, (r, t, s, n) in enumerate(out, 1)]


def chats(seed=2):
    """One chat with most of the rows, and some of a few."""
    rng, rows = random.Random(seed), {}
    for chat, n in [(1, 900), *((c, rng.randint(0, 6)) for c in range(2, 40))]:
        at, no = 0, 0
        rows[chat] = []
        for k in range(n):
            at += rng.choice([1, 60, 1800, 1801, 43_200, 43_201, 90_000])
            no += rng.choice([1, 3, 1000])
            rows[chat].append((no, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", " "]) + str(k % 3), None if rng.random() < 0.05 else at))
    return rows


@pytest.fixture(scope="module")
def hot(spark):
    rows = chats()
    df = spark.createDataFrame([(c, *r) for c, rs in rows.items() for r in rs], "chat_id long, msg_no long, role string, text string, sec long")
    return rows, df


def test_turns_of_a_hot_chat(hot):
    rows, df = hot
    got = {}
    for r in turns.collapse_turns(df).collect():
        got.setdefault(r.chat_id, []).append((r.turn_no, r.role, r.content, r.sec, r.msg_no))
    assert {c: sorted(v) for c, v in got.items()} == {c: plain_turns(v) for c, v in rows.items() if v}


def test_sessions_and_windows_over_slices(hot, monkeypatch):
    monkeypatch.setattr(turns, "SLICE_TURNS", 16)
    _, df = hot
    found = turns.collapse_turns(df)
    w = Window.partitionBy("chat_id").orderBy("turn_no")
    fresh = F.coalesce((F.col("sec") - F.lag("sec").over(w) > turns.SESSION_GAP_SECONDS).cast("int"), F.lit(0))
    want = found.withColumn("session_no", F.sum(fresh).over(w) + 1)
    got = turns.sessionize(found)
    key = lambda d: sorted((r.chat_id, r.turn_no, r.session_no) for r in d.collect())
    assert key(got) == key(want)
    whole = Window.partitionBy("chat_id", "session_no").orderBy("turn_no").rowsBetween(-9, 0)
    plain = want.withColumn("window", F.collect_list("content").over(whole))
    assert sorted((r.chat_id, r.turn_no, [x.content for x in r.window]) for r in turns._windows(got, 10).collect()) == sorted((r.chat_id, r.turn_no, r.window) for r in plain.collect())
    count = F.count("*").over(Window.partitionBy("chat_id", "session_no").orderBy("turn_no"))
    ladder = {r.k for r in turns.running(got.withColumn("_slice", turns._slice()), ["chat_id", "session_no"], ["turn_no"], F.lit(1), "k").withColumn("k", F.col("k") - count).collect()}
    assert ladder == {0}


def test_no_window_spans_a_chat(hot):
    """Every window with a row for each message is cut by slice; the others have a row for each slice."""
    _, df = hot
    plan = turns.sessionize(turns.collapse_turns(df))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line or line.startswith("Window [")]
    assert windows
    for line in windows:
        assert "_slice" in line


def test_slices_split_a_hot_key(spark):
    df = spark.range(10_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS o")
    sizes = ordered.sliced(df, ["k"], ["o"]).groupBy("_slice").count().collect()
    assert max(r["count"] for r in sizes) < 5000 and len(sizes) > 1


def test_ranks_of_sparse_ids(spark):
    rng = random.Random(1)
    ids = list({rng.randint(-(2**62), 2**62) for _ in range(500)})
    got = [r.rank for r in curation.ranked_rows(spark.createDataFrame([(i,) for i in ids], "id long"), ["id"]).orderBy("id").collect()]
    assert got == list(range(1, len(ids) + 1))


def plain_split(rows, train=0.8, valid=0.1, size=80, skipped=10):
    """(row, split): chunks of sessions, oldest first, to the split that lacks the largest part of its quota."""
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[1]), []).append(r)
    order = sorted(groups, key=lambda s: (min(r[2] for r in groups[s]), s))
    quota = {"train": train * len(rows), "valid": valid * len(rows), "test": max(0.0, 1 - train - valid) * len(rows)}
    got, out = dict.fromkeys(quota, 0), []
    for s in order:
        mine, before = sorted(groups[s], key=lambda r: (r[2], r[3])), None
        for k in range(0, len(mine), size):
            part = mine[k : k + size]
            name = max(quota, key=lambda q: (quota[q] - got[q]) / max(1.0, quota[q]))
            got[name] += len(part)
            out += [(r, name) for r in (part[skipped:] if before not in (None, name) else part)]
            before = name
    return sorted(out)


@pytest.mark.parametrize(("seed", "at_once"), [(1, 1_000_000), (2, 7), (3, 1)])
def test_stratified_split_equals_the_sequential_fold(spark, seed, at_once):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 79, 80, 81, 160, 400, rng.randint(1, 900)]) for _ in range(25)]
    rows = [(k % 7, k, rng.randint(0, 10**6), m) for k, n in enumerate(sizes) for m in range(n)]
    df = spark.createDataFrame(rows, "chat_id long, session_no long, sec long, msg_no long").repartition(5)
    if at_once == 1:
        df, rows = df.where("session_no < 11"), [r for r in rows if r[1] < 11]
    got = sorted(((r.chat_id, r.session_no, r.sec, r.msg_no), r.split) for r in curation.split_stratified(df, at_once=at_once).collect())
    assert got == plain_split(rows)


def test_few_sessions_are_split_by_time(spark):
    rows = [(1, s, s * 100 + k, k) for s in range(9) for k in range(5)]
    df = spark.createDataFrame(rows, "chat_id long, session_no long, sec long, msg_no long")
    got = {(r.session_no, r.split) for r in curation.split_stratified(df).collect()}
    assert got == {*((s, "train") for s in range(7)), (7, "valid"), (8, "test")}


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 15, 25, 45])
def test_sizes_of_the_split_by_time(spark, n):
    df = spark.range(n).selectExpr("id AS chat_id", "0L AS session_no", "id AS sec")
    got = {r.split: r["count"] for r in curation.split_chrono(df, ["chat_id", "session_no"]).groupBy("split").count().collect()}
    if n < 10:
        test, valid = int(n >= 3), int(n >= 2)
    else:
        test, valid = max(1, round(n * (1 - 0.8 - 0.1))), max(1, round(n * 0.1))
    assert got == {k: v for k, v in {"train": n - test - valid, "valid": valid, "test": test}.items() if v}


def test_profile(spark):
    rows = [
        (1, None, 1, "hi"), (1, None, 1, "hi"), (2, None, 1, None), (3, None, 0, "yo"), (4, None, 0, None), (5, 2001, 1, "Loved"), (6, None, 0, " "), (7, 3001, 0, "x"),
    ]
    m = spark.createDataFrame(rows, "id long, kind int, is_from_me int, text string").withColumn("ts", F.timestamp_seconds("id"))
    members = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "c"), (4, "b"), (4, "c")], "chat_id long, handle string")
    r = curation.profile(m, members).first()
    assert (r.sent, r.sent_text, r.received_text, r.attachment_only, r.direct_chats, r.group_chats) == (2, 1, 1, 1, 2, 2)
    assert (r.first_ts.second, r.last_ts.second) == (1, 6)
    r = curation.profile(m, members, F.col("is_from_me") == 0, ["a"]).first()
    assert (r.sent, r.sent_text, r.received_text, r.attachment_only, r.direct_chats, r.group_chats) == (3, 1, 1, 2, 1, 1)
    r = curation.profile(m.limit(0), members.limit(0)).first()
    assert (r.sent, r.direct_chats) == (0, 0)


# --- sources ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "m.db")
    with sqlite3.connect(path) as conn:
        conn.execute("CREATE TABLE message (ROWID INTEGER PRIMARY KEY, text TEXT, date INTEGER, score REAL, body BLOB)")
        conn.executemany("INSERT INTO message VALUES (?, ?, ?, ?, ?)", [(k, None if k % 10 == 3 else f"t{k % 7}", k * 10, k / 4, b"x" * k) for k in range(1, 301)])
    return path


@pytest.mark.parametrize(
    ("where", "left"),
    [
        ("date > 500 AND date <= 900", []), ("text = 't3'", []), ("text IS NULL OR date < 50", None), ("text IS NOT NULL AND score >= 3.5", []), ("date IN (10, 20, 99)", []),
        ("NOT (text = 't1')", []), ("rowid > 290", []), ("text LIKE 't%'", ["StartsWith"]), ("date + 1 > 2000", None), ("text <=> NULL", None),
    ],
)
def test_comparisons_go_to_the_store(spark, store, where, left):
    rows = sqlite.scan(spark, store, "message", rows=40)
    want = sorted((r.rowid for r in spark.createDataFrame(rows.collect(), rows.schema).where(where).collect()))
    got = rows.where(where)
    assert sorted(r.rowid for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert left is None or ("Filter " not in plan.replace("PushedFilters", "")) == (not left)


def test_filters_and_columns_reach_the_statement(store):
    from pyspark.sql import datasource as D
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("rowid", LongType()), StructField("text", StringType())])
    reader = sqlite.PushingReader(schema, {"path": store, "table": "message", "rows": "50"})
    assert list(reader.pushFilters([D.EqualTo(("text",), "t3"), D.GreaterThan(("rowid",), 200), D.StringContains(("text",), "x")])) == [D.StringContains(("text",), "x")]
    assert [(p.low, p.high) for p in reader.partitions()] == [(201, 251), (251, 301)]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert rows and all(len(r) == 2 and r[1] == "t3" and r[0] > 200 for r in rows)


def test_only_asked_columns_are_read(spark, store):
    df = sqlite.scan(spark, store, "message", ["text", "date"], rows=1000)
    assert df.columns == ["text", "date"] and df.where("date = 10").first().text == "t1"


def book(path, cards, phones=(), mails=(), broken=False):
    with sqlite3.connect(path) as conn:
        conn.execute("CREATE TABLE ZABCDRECORD (Z_PK INTEGER, ZFIRSTNAME TEXT, ZLASTNAME TEXT, ZNICKNAME TEXT, ZORGANIZATION TEXT, ZTHUMBNAILIMAGEDATA BLOB, ZIMAGEDATA BLOB)")
        conn.execute("CREATE TABLE ZABCDPHONENUMBER (ZOWNER INTEGER, ZFULLNUMBER TEXT)")
        conn.executemany("INSERT INTO ZABCDRECORD VALUES (?, ?, ?, ?, ?, ?, NULL)", cards)
        conn.executemany("INSERT INTO ZABCDPHONENUMBER VALUES (?, ?)", phones)
        if not broken:
            conn.execute("CREATE TABLE ZABCDEMAILADDRESS (ZOWNER INTEGER, ZADDRESS TEXT)")
            conn.executemany("INSERT INTO ZABCDEMAILADDRESS VALUES (?, ?)", mails)


def test_many_address_books(spark, tmp_path):
    """Five files: the last wins, a corrupt one is reported, one that lacks a table counts up to there."""
    for d in ("main", "more"):
        (tmp_path / d).mkdir()
    card = lambda k, first, last=None, nick=None: (k, first, last, nick, None, None)
    book(tmp_path / "main" / "1.db", [card(1, "Ada", "L"), card(2, None, None, "Bo")], [(1, "+1 (555) 010-0001"), (2, "5550100002")], [(1, "Ada@Example.com")])
    book(tmp_path / "main" / "2.db", [card(1, "Cy")], [(1, "555-010-0003")])
    (tmp_path / "main" / "3.db").write_bytes(b"not a database" * 100)
    book(tmp_path / "main" / "4.db", [card(7, "Di")], [(7, "555 010 0004")], broken=True)
    book(tmp_path / "more" / "0.db", [card(1, "Zed")], [(1, "15550100003")], [(9, "nobody@x.org")])
    cards, addresses, errors = contacts.read_books(spark, [f"{tmp_path}/main/*.db", f"{tmp_path}/more/*.db"])
    got = {r.handle_key: r.name for r in contacts.directory(cards, addresses).collect()}
    assert got == {"phone:5550100001": "Ada L", "email:ada@example.com": "Ada L", "phone:5550100002": "Bo", "phone:5550100003": "Zed", "phone:5550100004": "Di"}
    assert sorted(r.file.rsplit("/", 1)[1] for r in errors.collect()) == ["3.db", "4.db"]


# --- retrieval --------------------------------------------------------------------------------------------------------


def plain_retrieval(queries, index, k=2):
    """All pairs: (qid, place, id, score)."""
    tokens = lambda t: set(re.findall(r"[a-z0-9']+", t.lower()))
    newest, out = max(r[4] for r in index), []
    for qid, text, peer, barred in queries:
        scored = []
        for i, query, reply, other, sec in index:
            if query == text.strip() or reply in [b.strip() for b in barred]:
                continue
            q, r = tokens(text), tokens(query)
            if q & r:
                f = 0.5 + 0.5 * 0.5 ** ((newest - sec) / 86400.0 / 365.0)
                scored.append((-(len(q & r) / (math.sqrt(len(q)) * math.sqrt(len(r))) * f * (1.2 if peer and peer == other else 1.0)), query, i))
        out += [(qid, place, i, round(-s, 9)) for place, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def archive(seed, n=260):
    """Natural texts, one template with many fillings, one text that is a third of all, few or equal times."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        text = rng.choice(["ok", f"your code is {rng.randrange(30)}", " ".join(rng.choice(words[: rng.choice([5, 60])]) for _ in range(rng.randint(1, 9)))])
        rows.append((i, text, rng.choice(["yes", "no", f"r{i}"]), rng.choice(["", "a", "b"]), rng.choice([0, 10**7, rng.randrange(10**8)])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_retrieval_equals_all_pairs(spark, seed):
    rng, rows = random.Random(seed), archive(seed)
    queries = [(k, r[1], rng.choice(["", "a", r[3]]), rng.choice([[], [r[2]], ["yes", "no"]])) for k, r in enumerate(rows)]
    queries += [(1000, "nothing alike zz", "a", []), (1001, " OK ", "b", []), (1002, "!?", "", [])]
    index = retrieval.index_rows(spark.createDataFrame(rows, "id long, query string, reply string, peer string, sec long"))
    asked = spark.createDataFrame(queries, "qid long, query string, peer string, exclude_replies array<string>")
    got = sorted((r.qid, r.place, r.id, round(r.score, 9)) for r in retrieval.retrieve(asked, index).collect())
    assert got == plain_retrieval(queries, rows)


def test_a_template_brings_few_candidates(spark, monkeypatch):
    """Fillings of one template all share three tokens: rows that meet grow with the messages, not with their pairs."""
    sizes, met = [], []
    monkeypatch.setattr(retrieval, "save", lambda df, name: met.append(save(df, name)) or met[-1] if name == "retrieval-met" else save(df, name))
    for n in (200, 2000):
        met.clear()
        rows = [(k, f"your code is {k * 7919 % n}", f"r{k}", "", 10**6 + k) for k in range(n)]
        index = retrieval.index_rows(spark.createDataFrame(rows, "id long, query string, reply string, peer string, sec long"))
        assert retrieval.retrieve(index.selectExpr("id AS qid", "query", "peer"), index).count() == 2 * n
        sizes.append(sum(m.count() for m in met))
    assert sizes[1] < 15 * sizes[0]


def test_texts_of_common_words_leave_no_pairs(spark, monkeypatch):
    """Where all texts share most of their words, what is written grows with the messages; small blocks give what one block gives."""
    rng, met, n = random.Random(5), [], 300
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.sample(words, 25)), f"r{k % 7}", rng.choice(["", "a"]), rng.randrange(10**8)) for k in range(n)]
    monkeypatch.setattr(retrieval, "save", lambda df, name: met.append(save(df, name)) or met[-1])
    monkeypatch.setattr(retrieval, "ROWS", 40, raising=False)
    monkeypatch.setattr(retrieval, "QUERIES", 50, raising=False)
    monkeypatch.setattr(retrieval, "NEWEST", 20, raising=False)
    index = retrieval.index_rows(spark.createDataFrame(rows, "id long, query string, reply string, peer string, sec long"))
    asked = index.selectExpr("id AS qid", "query", "peer", "array(reply) AS exclude_replies")
    got = sorted((r.qid, r.place, r.id, round(r.score, 9)) for r in retrieval.retrieve(asked, index).collect())
    assert got == plain_retrieval([(k, q, p, [r]) for k, q, r, p, _ in rows], rows)
    assert max(m.count() for m in met) <= 2 * n * 4


def test_saved_tables_leave_no_shuffle_files(spark):
    """What a table was made from goes when it is written, not when the driver happens to collect its garbage."""
    import time

    def shuffled():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {n for n in (blocks.apply(k).name() for k in range(blocks.size())) if n.startswith("shuffle_")}

    before = shuffled()
    df = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count("*").alias("n")).repartition(3)
    assert save(df, "groups").count() == 5000
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not {n for n in left if int(n.split("_")[1]) < max(int(x.split("_")[1]) for x in left)}, left  # the count has one of its own


def test_shots_are_put_together_once(spark):
    """The plan names what a chat is made of a few times, however often its parts are read."""
    examples = spark.createDataFrame([], "qid long, messages array<struct<role:string,content:string>>")
    found = spark.createDataFrame([], "qid long, id long, place int")
    index = spark.createDataFrame([], "id long, query string, reply string")
    plan = retrieval.with_shots(examples, found, index)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("messages#") < 60


@pytest.mark.parametrize("split", ["chrono", "stratified"])
def test_chats_of_examples_are_written_twice(spark, monkeypatch, split):
    """As examples and as what is exported; the steps that choose rows carry none, and every row comes back whole."""
    rows = [(10 * c + k, c * 10**6 + 60 * k, c, c, k % 2, f"text {c} {k}" + " more" * (k % 3), None, 0, 0) for c in range(40) for k in range(6)]
    messages = spark.createDataFrame(rows, "id long, sec long, chat_id long, handle long, is_from_me int, text string, kind int, is_unsent int, has_attachment int").withColumn("ts", F.timestamp_seconds("sec"))
    wide = []
    for module in (dataset, curation, retrieval):
        monkeypatch.setattr(module, "save", lambda df, name: (wide.append(name) if {"messages", "qid"} <= set(df.columns) else None, save(df, name))[1])
    out, report = dataset.export_dataset(messages, spark.createDataFrame([(c, c) for c in range(40)], "chat_id long, handle long"), split=split, floor=1.0)
    assert sorted(wide) == ["dataset", "examples"]
    got, told = out.collect(), report.first()
    assert len(got) == len({r.qid for r in got}) == told.train + told.valid + told.test and told.train > 60
    assert all(r.messages[-1].content == r.reply and r.messages[-2].content == r.query for r in got)
    assert told.train_with_shots == sum(len(r.messages) > 2 * ((r.turn_no + 1) // 2) + 1 for r in got if r.split == "train")


# --- summaries --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", "ok", 1.0), ("a", "ok", 3.0), ("b", "no", 4.0), ("b", "ok", 8.0), ("b", "no", 0.0), ("", "ok", 9.0)], (2, 2.0, 0.5)),
        ([("a", "ok", 1.0), ("a", "no", 3.0), ("b", "no", 4.0)], (2, None, None)),  # only one peer has two rows
        ([("a", "ok", 1.0), ("a", "no", 3.0), (None, "no", 4.0)], (None, None, None)),
        ([], (None, None, None)),
    ],
)
def test_recipient_summary(spark, rows, want):
    df = spark.createDataFrame(rows, "peer string, pred string, score double")
    assert tuple(scoring.recipient_summary(df).first()) == want


def test_zipped_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [1, None]), (2, ["a"], [1, 2]), (3, [], []), (4, None, [])], "id long, x array<string>, y array<long>")
    got = sorted((tuple(r) for r in scoring.zip_lists(df, "id", ["x", "y"]).collect()), key=str)
    assert got == [(1, 0, "a", 1, None), (1, 1, "b", None, None), (2, None, None, None, "lengths differ: x 1, y 2")]
