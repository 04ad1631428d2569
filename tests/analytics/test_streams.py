import datetime as dt
import random

import pytest

from parley.operators import paging, runs, search, sessions, voice
from parley.sources import catalog, publish
from parley.streaming import logs, segments

# --- logs -------------------------------------------------------------------------------------------------------------


def losses(seed, n=40):
    """Falling, then flat; some noise below the least drop that counts."""
    rng = random.Random(seed)
    return [round(max(1.0, 3.0 - 0.1 * k) + rng.choice([0, 0.004, -0.004, 0.2]), 3) for k in range(n)]


def piece(values, first):
    out = []
    for k, v in enumerate(values, first):
        out += [f"\x1b[32mIter {k}: Train loss {v + 1:.3f}, Tokens/sec 200.0\x1b[0m", f"Iter {k}: Val loss {v:.3f}, Val took 3s", "checkpoint written"]
    return "\n".join(out)


def test_stops_are_found_across_pieces_and_restarts(spark, tmp_path):
    source, target = tmp_path / "logs", str(tmp_path / "events")
    all_of = {f"run{r}": losses(r) for r in range(4)} | {"falling": [5.0 - 0.1 * k for k in range(40)]}
    for k in range(4):  # each piece ends in the middle of a run of stale evaluations
        for run, values in all_of.items():
            (source / run).mkdir(parents=True, exist_ok=True)
            (source / run / f"{k:03d}.log").write_text(piece(values[k * 10 : k * 10 + 10], k * 10))
        logs.follow(logs.log_pieces(spark, str(source)), target, str(tmp_path / "cp")).awaitTermination()
    evals = spark.createDataFrame([(r, k, v) for r, values in all_of.items() for k, v in enumerate(values)], "run string, iter long, loss double")
    want = {(r.run, r.best, r.best_iter, r.stop_iter) for r in runs.early_stop(evals).where("stop_iter IS NOT NULL").collect()}
    got = [(r.run, r.best, r.best_iter, r.at_iter) for r in spark.read.parquet(target).where("event = 'stop'").collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_note_is_sticky():
    state = (None, None, 0, 0, None)
    for at, loss in enumerate([2.0, 1.995, 1.99, 1.98, 1.979]):
        state = logs.note(state, at, loss, 0.01, 6, 3)
    assert state[:3] == (1.98, 3, 1)
    for at in range(5, 12):
        state = logs.note(state, at, 5.0 if at < 10 else 0.0, 0.01, 6, 3)
    assert state[4] is not None and state[0] == 1.98


# --- search -----------------------------------------------------------------------------------------------------------


def texts(n, seed=1):
    rng = random.Random(seed)
    words = "alpha beta gamma delta omega running runs letter letters note".split()
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), 2001 if k % 17 == 5 else None) for k in range(n)]


SCHEMA = "doc_id long, body string, kind int"


def found(index, query):
    return [(r.doc_id, round(r.score, 9)) for r in search.search(index, query)[0].collect()]


def whole(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).where("(kind IS NULL) AND trim(body) <> ''")
    return search.build_index(docs)


def test_increments_equal_one_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 3)
    monkeypatch.setattr(segments, "MERGED_TO", 2)
    store, rows = segments.Store(spark, str(tmp_path / "index")), texts(200)
    cuts = [0, 40, 41, 90, 150, 200]
    source = str(tmp_path / "in")
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = rows[max(0, a - 5) : b]  # each brings some again
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        segments.stream_index(spark.readStream.schema(SCHEMA).parquet(source), store, str(tmp_path / "cp")).awaitTermination()
    state = store.state()[1]
    assert len(state["segments"]) <= 3 and state["last_msg_id"] == 199
    want = whole(spark, rows)
    assert store.index().totals[0] == want.totals[0] and abs(store.index().totals[1] - want.totals[1]) < 1e-9
    for query in ("alpha letter", "run", '"beta gamma" omega', "zzz delta"):
        assert found(store.index(), query) == found(want, query)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame(texts(30), SCHEMA)
    store.append(docs, "s", 0)
    before = store.state()
    store.append(docs, "s", 0)
    assert store.state() == before


def test_refresh_by_high_water_mark(spark, tmp_path):
    store, rows = segments.Store(spark, str(tmp_path / "i")), texts(120)
    df = lambda n: spark.createDataFrame(rows[:n], SCHEMA)
    assert [store.refresh(df(60)), store.refresh(df(60)), store.refresh(df(120))] == ["append", "none", "append"]
    assert found(store.index(), "alpha") == found(whole(spark, rows), "alpha")
    assert store.refresh(df(50)) == "rebuild"  # the source shrank
    assert found(store.index(), "alpha") == found(whole(spark, rows[:50]), "alpha")


def test_a_dead_writer_leaves_nothing_to_read(spark, tmp_path):
    """Data without a manifest is no segment, no version and no snapshot."""
    root = str(tmp_path / "i")
    store = segments.Store(spark, root)
    store.append(spark.createDataFrame(texts(30), SCHEMA))
    want = found(store.index(), "alpha")
    search.build_index(spark.createDataFrame(texts(30, 2), SCHEMA), root=publish.new_folder(root))
    (tmp_path / "i" / "manifests" / ".x.staged").write_text('{"segm')
    assert found(store.index(), "alpha") == want


def test_snapshot_ignores_half_written_folders(spark, tmp_path):
    root = str(tmp_path / "s")
    (tmp_path / "s" / "version=1").mkdir(parents=True)  # as a writer that died left it
    df = spark.range(5)
    assert catalog.snapshot(df, root, "1").count() == 5
    assert catalog.snapshot(spark.range(9), root, "1").count() == 5 and catalog.snapshot(spark.range(9), root, "2").count() == 9
    with pytest.raises(publish.Conflict):
        publish.commit(spark, root, 1, {})


def test_word_statistics_of_other_stop_words_are_others(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1), "a", "the quick note the quick note") for k in range(30)]
    m = spark.createDataFrame(rows, "id long, ts timestamp, handle string, body string")
    words = lambda stop: {r.word for r in voice.current(m, str(tmp_path / "v"), stop).where("section = 'words'").collect()}
    assert "the" in words(()) and "the" not in words(("the",))


# --- pages ------------------------------------------------------------------------------------------------------------


def thread(spark, n=60, seed=4):
    rng, at, rows = random.Random(seed), dt.datetime(2024, 1, 1, 20), []
    for k in range(n):
        at += dt.timedelta(minutes=rng.choice([0, 1, 5, 59, 60, 61, 300]))
        rows.append((k, at, 1, rng.randint(0, 1)))
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, chat_id long, is_from_me int")


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_flags_of_a_page_are_those_of_the_thread(spark, limit):
    rows = thread(spark)
    flags = {r.id: tuple(r) for r in sessions.message_groups(rows).select(*rows.columns, "new_day", "time_break", "group_start", "group_end").collect()}
    order = [r.id for r in rows.orderBy("ts", "id").collect()]
    ts = {r.id: r.ts for r in rows.collect()}
    for kw in ({}, {"from_end": True}, {"start": ts[order[20]]}, {"after_": (ts[order[11]], order[11])}, {"before_": (ts[order[30]], order[30])}, {"after_": (ts[order[-1]], order[-1])}):
        got = [tuple(r) for r in paging.page_with_context(rows, limit=limit, **kw).collect()]
        assert [r[0] for r in got] == [r.id for r in paging.page(rows, limit=limit, **kw).collect()]
        assert got == [flags[r[0]] for r in got]


def test_a_page_reads_by_its_cursor(spark, tmp_path):
    """No window runs over the thread: bounds on the time reach the scan, and only a page's rows are sorted by place."""
    thread(spark).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = paging.page_with_context(rows, after_=(dt.datetime(2024, 1, 3), 5), limit=10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [Or(") == 2 and "TakeOrderedAndProject" in plan


def test_two_writers_of_versions(spark, tmp_path, monkeypatch):
    """A writer that finds its number taken adds its version to what the other committed; of one version the first counts."""
    root = str(tmp_path / "v")
    publish.add(spark, root, "a", "folder-a")
    plain, raced = publish.newest, []

    def late(session, place):
        if not raced:
            raced.append(plain(session, place))
            publish.commit(session, place, 2, {"a": "folder-a", "b": "folder-b"})
            return raced[0]
        return plain(session, place)

    monkeypatch.setattr(publish, "newest", late)
    assert publish.add(spark, root, "c", "folder-c") == "folder-c"
    assert plain(spark, root) == (3, {"a": "folder-a", "b": "folder-b", "c": "folder-c"})
    assert publish.add(spark, root, "b", "other") == "folder-b"
