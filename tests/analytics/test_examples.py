"""Training examples against a plain version that walks chats one by one."""

import datetime as dt
import random

import pytest

from parley.functions.chat import opener_prompt
from parley.operators import dataset

NAMES = {"h1": "Ada Lovelace", "h2": "  ", "h3": "Cy", "h4": "Dorothea-Maximiliana-Wilhelmine Q"}
STYLE, TEXTING = "Continue the conversation in my own style.", " You are texting "


def archive(seed):
    """(id, chat, handle, me, text, sec, kind, unsent) over direct and group chats; some messages are in two of them."""
    rng, rows, k = random.Random(seed), [], 0
    members = {1: ["h1"], 2: ["h2"], 3: ["h3"], 4: ["h1", "h3"], 5: ["h2", "h4", "h3"], 6: ["h4"]}
    for chat, people in members.items():
        at = chat * 1000
        for _ in range(rng.randint(15, 40)):
            at += rng.choice([30, 30, 600, 2000, 50_000])
            me = rng.random() < 0.4
            text = rng.choice(["hello there", "ok", "see you", "Ada: quoted", "", None, "https://x.org", "note " + str(k)])
            row = (k, chat, None if me else rng.choice(people), int(me), text, at, 2001 if rng.random() < 0.05 else None, int(rng.random() < 0.05))
            rows.append(row)
            if rng.random() < 0.1 and chat < 6:
                rows.append((k, chat + 1, *row[2:]))
            k += 1
    return rows, [(c, h) for c, hs in members.items() for h in hs]


def tables(spark, rows, members):
    m = [(i, c, h, me, t, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), k, u, 0) for i, c, h, me, t, s, k, u in rows]
    schema = "id long, chat_id long, handle string, is_from_me int, text string, ts timestamp_ntz, kind int, is_unsent int, has_attachment int"
    return spark.createDataFrame(m, schema), spark.createDataFrame(members, "chat_id long, handle string"), spark.createDataFrame(list(NAMES.items()), "handle string, name string")


def plain(rows, members, groups=False, limit=0, per_chat=0, openers=False, labels=True):
    of = {}
    for c, h in members:
        of.setdefault(c, []).append(h)
    real = [r for r in rows if r[6] is None]
    stamps = {}
    for r in real:
        stamps.setdefault(r[1], []).append(r[5])
    chats = [c for c in stamps if groups or len(of[c]) == 1]
    chats.sort(key=(lambda c: (-max(stamps[c]), c)) if limit else (lambda c: (min(stamps[c]), c)))
    seen, out, counts = set(), [], {"chats": 0, "sessions": 0, "sent_turns": 0, "opener_turns": 0}
    name = lambda h: (NAMES.get(h) or "").strip()
    for c in chats:
        mine = sorted((r for r in real if r[1] == c), key=lambda r: (r[5], r[0]))
        mine = mine[-per_chat:] if per_chat else mine
        mine = [r for r in mine if not r[7] and r[4] and r[0] not in seen]
        seen |= {r[0] for r in mine}
        turns = []
        for r in mine:
            role, sender = ("assistant", "me") if r[3] else ("user", r[2])
            if turns and turns[-1][0] == role and turns[-1][4] == sender and r[5] - turns[-1][2] <= 1800:
                turns[-1] = [role, turns[-1][1] + "※" + r[4], r[5], r[0], sender]
            else:
                turns.append([role, r[4], r[5], r[0], sender])
        if not any(t[0] == "assistant" for t in turns):
            continue
        counts["chats"] += 1
        counts["sent_turns"] += sum(t[0] == "assistant" for t in turns)
        if groups and labels and len(of[c]) > 1:
            for t in turns:
                if t[0] == "user" and not (":" in t[1][:25] and ": " in t[1][:26] and t[1].index(":") <= 24 and t[1][t[1].index(":") + 1] == " " and t[1].index(":") > 0):
                    t[1] = f"{(name(t[4]) or t[4]).split()[0][:24]}: {t[1]}"
        sessions = []
        for t in turns:
            if sessions and t[2] - sessions[-1][-1][2] <= 43_200:
                sessions[-1].append(t)
            else:
                sessions.append([t])
        counts["sessions"] += len(sessions)
        system = STYLE if groups else f"{STYLE}{TEXTING}{name(of[c][0]) or 'this contact'}."
        for s in sessions:
            first = []
            for k, t in enumerate(s):
                if t[0] != "assistant":
                    continue
                context = []
                for u in s[max(0, k - 9) : k]:
                    if not context and u[0] != "user":
                        continue
                    if context and context[-1][0] == u[0]:
                        context[-1] = (u[0], context[-1][1] + "※" + u[1])
                    else:
                        context.append((u[0], u[1]))
                if not context or context[-1][0] != "user":
                    counts["opener_turns"] += 1
                    if openers and not t[1].startswith("https://x.org"):
                        first.append((c, t[3], [("system", system), ("user", opener_prompt()), ("assistant", t[1])]))
                elif t[1] not in ("https://x.org",):
                    out.append((c, t[3], [("system", system), *context, ("assistant", t[1])]))
            out += first
        if limit and len(out) >= limit:
            out = out[:limit]
            break
    return sorted(out), counts


@pytest.mark.parametrize(
    ("seed", "options"), [(1, {}), (2, {"groups": True}), (3, {"groups": True, "labels": False}), (4, {"limit": 20}), (5, {"per_chat": 9, "openers": True}), (6, {"limit": 11, "groups": True, "per_chat": 30}), (7, {"limit": 9, "openers": True})]
)
def test_examples_equal_a_walk_over_chats(spark, seed, options):
    rows, members = archive(seed)
    m, mem, names = tables(spark, rows, members)
    found, counters = dataset.collect_examples(m, mem, names=names, **options)
    got = sorted((r.chat_id, r.msg_no, [(x.role, x.content) for x in r.messages]) for r in found.collect())
    want, counts = plain(rows, members, **options)
    links = [w for w in want if set(w[2][-1][1].split("※")) == {"https://x.org"}]
    assert got == [w for w in want if w not in links] and len(got) > 5
    c = counters.first()
    assert {k: c[k] for k in counts} == counts and c.examples == len(got)


def test_peers_of_another_voice_and_the_report(spark):
    rows, members = archive(8)
    m, mem, names = tables(spark, rows, members)
    other = m.withColumn("person", m.handle)
    found, _ = dataset.collect_examples(other, mem, person="h1", name="Ada", names=names)
    assert {r.messages[0].content for r in found.collect()} == {"Continue the conversation in the style of Ada. You are texting You."}
    out, report = dataset.export_dataset(m, mem, names=names)
    r, examples = report.first(), out.collect()
    assert r.train + r.valid + r.test == len(examples) and r.contextual_turns == r.examples
    assert {e.peer for e in examples} <= {"Ada Lovelace", "this contact", "Cy", NAMES["h4"]}
    for e in examples:
        roles = [x.role for x in e.messages]
        assert roles[0] == "system" and roles[1] == "user" and roles[-1] == "assistant" and "system" not in roles[1:]
        assert e.messages[0].content.endswith(f"{TEXTING}{e.peer}.")
    assert r.train_with_shots > 0


def test_prompts_and_public_examples(spark):
    rows = [(1, [("system", "s"), ("user", "a"), ("assistant", "b")]), (2, [("user", "a"), ("assistant", "b"), ("user", "c")]), (3, [("assistant", "b")]), (4, [])]
    df = spark.createDataFrame(rows, "qid long, messages array<struct<role:string,content:string>>")
    asked = {r.qid: [m.content for m in r.p] for r in df.select("qid", dataset.prompt_messages(df.messages).alias("p")).collect()}
    assert asked == {1: ["s", "a"], 2: ["a", "b", "c"], 3: [], 4: []}
    assert dataset.public_example(df.withColumn("peer", df.qid)).columns == ["messages"]
