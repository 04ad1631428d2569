import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import curation, dataset, scoring, tapbacks, voice

BASE = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
MESSAGE = "id long, ts timestamp, chat_id long, handle string, is_from_me int, text string, kind int, is_unsent int, has_attachment int"


def message(k, minutes, chat, me, text, kind=None, unsent=0, attachment=0, handle="a"):
    return (k, BASE + datetime.timedelta(minutes=minutes), chat, handle, me, text, kind, unsent, attachment)


def archive(spark, rows, groups=()):
    members = [(c, "a") for c in sorted({r[2] for r in rows})] + [(c, "b") for c in groups]
    return spark.createDataFrame(rows, MESSAGE), spark.createDataFrame(members, "chat_id long, handle string")


def test_admitted(spark):
    rows = [
        message(1, 0, 1, 0, "hello"), message(2, 1, 1, 1, None, attachment=1), message(3, 2, 1, 1, ""), message(4, 3, 1, 0, "Loved “hello”"),
        message(5, 4, 1, 0, "liked", kind=2001), message(6, 5, 1, 1, "gone", unsent=1), message(7, 6, 1, 1, "yes"),
    ]
    got = {r.id: (r.role, r.text) for r in dataset.admitted(archive(spark, rows)[0]).collect()}
    assert got == {1: ("user", "hello"), 2: ("assistant", T.MEDIA_MARK), 7: ("assistant", "yes")}
    theirs = dataset.admitted(archive(spark, rows)[0].withColumn("person", F.lit("p1")), "p1")
    assert {r.id: r.role for r in theirs.collect()} == {1: "assistant", 2: "user", 7: "user"}


def test_examples_and_counters(spark):
    rows = [
        message(1, 0, 1, 0, "are you coming"), message(2, 1, 1, 1, "on my way"), message(3, 2, 1, 0, "see this"), message(4, 3, 1, 1, "https://a.example.com/x"),
        message(5, 4, 1, 0, "call?"), message(6, 5, 1, 1, "write to me@example.com"), message(7, 6, 1, 0, None, attachment=1), message(8, 7, 1, 1, "nice one"),
        message(9, 2000, 1, 1, "morning all"), message(10, 0, 2, 0, "nobody answers"), message(11, 5, 3, 0, "in a group"), message(12, 6, 3, 1, "yes in a group"),
        message(2, 1, 4, 1, "on my way"), message(13, 9000, 4, 0, "late"),
    ]
    kept, counters = dataset.collect_examples(*archive(spark, rows, groups=[3]))
    assert {(r.query, r.reply) for r in kept.collect()} == {("are you coming", "on my way")}
    c = counters.first()
    assert (c.chats, c.sessions, c.sent_turns, c.sent_texts, c.opener_turns, c.skipped_groups) == (1, 2, 5, 5, 1, 1)
    assert (c.skipped_media, c.skipped_link, c.skipped_masked, c.skipped_overflow, c.skipped_order, c.examples) == (1, 1, 1, 0, 0, 1)
    # in the group too, and with openers
    kept, counters = dataset.collect_examples(*archive(spark, rows, groups=[3]), groups=True, openers=True)
    assert counters.first().skipped_groups == 0 and "yes in a group" in {r.reply for r in kept.collect()} and "morning all" in {r.reply for r in kept.collect()}


def test_export(spark, tmp_path):
    rng, rows = random.Random(5), []
    for k in range(60):
        for j in range(4):
            text = "ok" if j % 2 and rng.random() < 0.4 else " ".join(rng.choice("see you later much so pull up".split()) + str(rng.randint(0, 99)) for _ in range(6))
            rows.append(message(k * 10 + j, k * 1440 + j, k, j % 2, text))
    out, report = dataset.export_dataset(*archive(spark, rows), path=f"file://{tmp_path}/set", low_signal_share=0.1, floor=1.0)
    r = report.first()
    sizes = {s: n for s, n in out.groupBy("split").count().collect()}
    assert sizes == {"train": r.train, "valid": r.valid, "test": r.test} and r.valid == r.test == 12
    assert r.train == 96 - r.capped_targets - r.recency_dropped - r.low_signal_dropped and r.capped_targets > 0 and r.low_signal_dropped >= 0
    low = out.where("split = 'train'").select(F.avg(T.is_low_signal(F.col("reply")).cast("double"))).first()[0]
    assert low <= 0.1
    lines = [json.loads(x) for f in (tmp_path / "set" / "train").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == r.train and all(set(x) == {"messages"} and x["messages"][-1]["role"] == "assistant" for x in lines)
    assert next((tmp_path / "set" / "split.json").glob("*.json")).read_text()


def brute_mask(ids, header, end):
    mask, inside = [0] * len(ids), False
    for k, t in enumerate(ids):
        mask[k] = int(inside)
        if inside and t == end:
            inside = False
        elif not inside and tuple(ids[max(0, k - len(header) + 1) : k + 1]) == header:
            inside = True
    return mask


def test_supervised_mask(spark):
    rng = random.Random(2)
    seqs = {k: [rng.randint(0, 4) for _ in range(60)] for k in range(8)}
    df = spark.createDataFrame([(k, p, t) for k, ids in seqs.items() for p, t in enumerate(ids)], "run long, pos long, token long")
    got = dataset.supervised_mask(df, "run", (1, 2), 0).orderBy("run", "pos").collect()
    for k, ids in seqs.items():
        assert [r.supervised for r in got if r.run == k] == brute_mask(ids, (1, 2), 0)


def test_tapbacks_with_their_own_emoji(spark):
    rows = [(1, 1, "ann", 2006, "🎉", "p:0/g1"), (2, 2, "me", 2000, None, "p:0/g1"), (3, 3, "bob", 2007, None, "g1"), (4, 4, "ann", 2006, None, "g2")]
    live = tapbacks.live_tapbacks(spark.createDataFrame(rows, "id long, ts long, reactor string, kind int, emoji string, assoc_guid string"))
    names = spark.createDataFrame([("ann", "Ann Lee")], "reactor string, name string")
    got = {r.target: [tuple(x) for x in r.tapbacks] for r in tapbacks.tapback_list(live, names, F.col("reactor") == "me").collect()}
    assert got == {"g1": [("🎉", "Reacted", "Ann Lee"), ("❤️", "Loved", "You"), ("🏷️", "Reacted with a sticker to", "bob")], "g2": [("👍", "Reacted", "Ann Lee")]}
    assert {r.target: r.emojis for r in tapbacks.tapback_chips(live).collect()}["g1"] == ["🎉", "❤️", "🏷️"]


def test_medians_and_draws(spark):
    for values, want in (([3, 1, 2], 2), ([4, 1, 3, 2], 3), ([5], 5)):
        df = spark.createDataFrame([(v,) for v in values], "v int")
        assert df.agg(scoring.upper_median("v").alias("m")).first().m == want
    assert len(scoring._POISSON) == 10 and scoring._POISSON[0] == pytest.approx(0.36787944117144233) and scoring._POISSON[4] == pytest.approx(0.9963401531726563)


def test_low_signal_cap_keeps_the_newest(spark):
    rows = [(k, "ok" if k % 2 else f"a long enough reply number {k}", k) for k in range(40)]
    left = curation.cap_low_signal_share(spark.createDataFrame(rows, "sec long, reply string, msg_no long"), 0.2).collect()
    assert sorted(r.sec for r in left if r.reply == "ok") == [31, 33, 35, 37, 39] and len(left) == 25


def test_voice_is_built_once_for_a_newest_message(spark, tmp_path):
    rows = [(k, BASE, f"h{k % 2}", "see later much pull" if k % 2 else "quick brown foxes jump") for k in range(200)]
    schema, root = "id long, ts timestamp, handle string, body string", f"file://{tmp_path}/voice"
    first = voice.current(spark.createDataFrame(rows, schema), root).collect()
    assert {r.section for r in first} == {"totals", "words", "phrases", "people"}
    assert next(r.messages for r in first if r.section == "totals") == 200
    assert {(r.key, r.word) for r in first if r.section == "people"} >= {("h0", "foxes"), ("h1", "pull")}
    again = voice.current(spark.createDataFrame([(k, BASE, "h0", "other words") for k in range(200)], schema), root).collect()
    assert sorted(map(str, again)) == sorted(map(str, first))
    newer = voice.current(spark.createDataFrame([*rows, (200, BASE, "h0", "other words")], schema), root).collect()
    assert next(r.messages for r in newer if r.section == "totals") == 201
