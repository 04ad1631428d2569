import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import scores as S
from parley.functions import text as T
from parley.functions.stem import stem
from parley.operators import phrases, search
from parley.plans.scratch import save


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [("90210", "[code]"), ("90210 apples", "90210 apples"), ("ask kim@site.org※7788", "ask [email]※[code]"), ("ring 415-555-0182 tonight", "ring [phone] tonight"),
                                            ("the PIN is9 x", "the [password] x"), ("5500 0000 0000 0004", "[card]"), ("park by 7 Maple Lane please", "park by [address] please")])
def test_redact(spark, text, want):
    assert one(spark, T.redact(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("Questioned “when?”", True), ("questioned his plan", False), ("This message was deleted", True), ("Emphasized your photo", True), (" ", False)])
def test_artifacts(spark, text, want):
    assert one(spark, T.is_artifact(F.lit(text))) is want


@pytest.mark.parametrize(("text", "want"), [("ok", True), ("Sounds good!!", True), ("", True), ("see you", True), ("on my way home", False), ("👍", True)])
def test_low_signal(spark, text, want):
    assert one(spark, T.is_low_signal(F.lit(text))) is want


def test_bubbles_and_keys(spark):
    assert one(spark, T.clip_bubbles(F.lit("a※ b ※※c※d※e"))) == "a※b※c※d"
    assert one(spark, T.split_bubbles(F.lit("x<|bubble|>y"))) == ["x", "y"]
    assert one(spark, T.handle_key(F.lit("+1 (555) 010-9999"))) == "phone:5550109999"
    assert one(spark, T.handle_key(F.lit(" Ann@X.com "))) == "email:ann@x.com"
    assert one(spark, T.strip_scaffold(F.lit("<think>\n</think>\nhi<|im_end|>"))) == "hi"
    assert one(spark, T.is_media_only(F.lit("[attachment]※[attachment]"))) is True


@pytest.mark.parametrize("text", ["hello", "é" * 100, "x" * 300])
def test_attributed_body(spark, text):
    data = text.encode()
    size = bytes([len(data)]) if len(data) < 128 else b"\x81" + len(data).to_bytes(2, "little")
    body = b"\x04\x0bstreamtyped NSString\x01\x94\x84\x01+" + size + data + b"\x86rest"
    df = spark.createDataFrame([(None, bytearray(body)), ("plain ￼ ", None), (" ", bytearray(b"junk"))], "text string, body binary")
    assert [r[0] for r in df.select(T.message_text(F.col("text"), F.col("body"))).collect()] == [text, "plain", None]


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit",
             "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adjustment": "adjust", "probate": "probat", "rate": "rate", "controll": "control", "sky": "sky"}
    assert {w: stem(w) for w in pairs} == pairs


def counts_df(spark, counts):
    return spark.createDataFrame(list(counts.items()), "phrase string, n long")


@pytest.mark.parametrize(("counts", "limit", "want"), [
    # all but two uses of the shorter ones lie in the longest
    ({"see so much later": 7, "so much later": 9, "much later": 9}, 20, [("see so much later", 7)]),
    # three uses of its own are enough to stay, beside the longer one
    ({"see so much later": 7, "so much later": 10}, 20, [("so much later", 10), ("see so much later", 7)]),
    # a light word around a phrase that stays adds nothing; any other word does
    ({"pull up": 20, "get pull up": 6, "see pull up": 4}, 20, [("pull up", 20), ("see pull up", 4)]),
    # below the least count nothing is a phrase
    ({"see you": 2, "so much": 3}, 20, [("so much", 3)]),
    # two places for pairs and two for longer phrases, by uses times length
    ({"see you": 9, "so much": 8, "pull later": 7, "see later so": 6, "you pull so": 5, "much later you": 4}, 4, [("see you", 9), ("see later so", 6), ("so much", 8), ("you pull so", 5)]),
    # what one kind leaves the other may fill
    ({"see you": 9, "so much": 8, "pull later": 7, "see later so": 6}, 4, [("see you", 9), ("see later so", 6), ("so much", 8), ("pull later", 7)]),
])
def test_frequent_phrases_by_hand(spark, counts, limit, want):
    got = [(r.phrase, r.n) for r in phrases.frequent_phrases(counts_df(spark, counts), ("up",), limit=limit).collect()]
    assert got == want


def test_phrases_counted_by_hash_and_by_text(spark):
    rng = random.Random(3)
    words = ["see", "you", "the", "later", "x", "so", "much", "pull"]
    docs = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))),) for _ in range(120)], "body string")
    every = {(r.phrase, r.n) for r in phrases.phrase_counts(docs).collect() if r.n >= 3}
    assert {(r.phrase, r.n) for r in phrases.phrase_counts(docs, min_count=3).collect()} == every and len(every) > 20


@pytest.mark.parametrize(("bits", "parts", "k"), [(1, 1, 2), (17, 8, 6), (21, 4, 3), (21, 4, 4), (25, 2, 6), (31, 1, 6)])
def test_forms_of_phrases(bits, parts, k):
    """Numbers of any width come back, packed and unpacked, and a phrase's bit is in its part."""
    rng = np.random.default_rng(bits)
    ids = rng.integers(1, 1 << bits, 500, endpoint=False).astype(np.int32)
    ids[:6] = (1 << bits) - 1
    form, at = phrases.Form(bits, parts, 64), np.arange(500 - k)
    columns = form.columns(ids, at, k)
    assert [w.tolist() for w in form.words(columns, k)] == [ids[at + j].tolist() for j in range(k)]
    assert 0 <= form.place(columns).min() and form.place(columns).max() < parts * 64
    columns, n = phrases._tally(columns)
    assert n.sum() == len(at)
    assert all((x == y).all() for x, y in zip(phrases.unpack(phrases.pack(columns, n), len(columns)), [*columns, n], strict=True))


def test_phrases_move_as_few_bytes(spark, monkeypatch):
    """No table holds a row for each word, whatever the number of parts and batches, and the counts are those of plain counting."""
    rng, seen = random.Random(9), {}
    texts = [" ".join(rng.choice(["alpha", "beta", "the", "x", "gamma", f"w{rng.randrange(30)}w"]) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "body string")
    every = {(r.phrase, r.n) for r in phrases.phrase_counts(docs).collect() if r.n >= 3}
    monkeypatch.setattr(phrases, "save", lambda df, name: seen.setdefault(name, []).append(save(df, name)) or seen[name][-1])
    monkeypatch.setattr(phrases, "BATCH_WORDS", 500, raising=False)
    monkeypatch.setattr(phrases, "PART_PLACES", 400, raising=False)
    got = phrases.phrase_counts(docs, min_count=3).collect()
    assert {(r.phrase, r.n) for r in got} == every and len(got) == len(every) > 50
    assert max(t.count() for tables in seen.values() for t in tables) < sum(len(t.split()) for t in texts) / 2


def test_postings_travel_by_term(spark, monkeypatch):
    """No table but the postings has a row for each posting, and rows that repeat an id are one document."""
    rng, seen = random.Random(4), {}
    rows = [(k, " ".join(rng.choice(["run", "running", "Été", "the", f"w{rng.randrange(9)}"]) for _ in range(rng.randrange(0, 40)))) for k in range(120)]
    rows += [(7, "late running words"), (200, None), (201, "")]
    monkeypatch.setattr(search, "save", lambda df, name: seen.setdefault(name, save(df, name)))
    index = search.build_index(spark.createDataFrame(rows, "doc_id long, body string").coalesce(2))
    want = {}
    for d, text in rows:
        for at, w in enumerate((text or "").lower().split()):
            want.setdefault((d, search.analyse(w)), []).append(at)
    got = [(r.doc_id, r.term, r.positions, r.tf) for r in index.postings.collect()]
    assert sorted(got) == sorted((d, t, sorted(p), len(p)) for (d, t), p in want.items())
    assert sorted((r.doc_id, r.dl) for r in index.lengths.collect()) == sorted((d, len((t or "").split())) for d, t in rows)
    assert all(t.count() < len(got) / 2 for name, t in seen.items() if name != "postings")


def test_spans_are_not_grouped_with_their_phrases(spark, monkeypatch):
    """What only adds light words to a shorter phrase goes, and no plan moves the words of a phrase for each of its spans."""
    plans = []
    monkeypatch.setattr(phrases, "save", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(df, name))
    counts = spark.createDataFrame([("garden gate", 90), ("the garden gate", 5), ("garden gate garden gate", 4), ("green garden gate", 4), ("go get the garden gate", 3)], "phrase string, n long")
    got = {r.phrase for r in phrases.frequent_phrases(counts, ["the"], min_count=1).collect()}
    assert {"garden gate", "green garden gate"} <= got and not got & {"the garden gate", "go get the garden gate"}
    assert not any("Aggregate" in line and "toks" in line for plan in plans for line in plan.splitlines())


def test_phrase_counts(spark):
    got = {r.phrase for r in phrases.phrase_counts(spark.createDataFrame([("buy bread at noon x today",)], "body string"), high=4).collect()}
    assert got == {"buy bread", "buy bread at noon", "bread at noon", "bread at noon today", "noon today"}  # a single letter is no word


def test_search(spark):
    docs = [(1, "Running late, see you at the café", "Ann"), (2, "I ran to the cafe", "Bob"), (3, "nothing here", "Ann Lee")]
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, body string, sender string"), columns=("body", "sender"))
    ids = lambda q: ([r.doc_id for r in search.search(index, q)[0].collect()], search.search(index, q)[1])
    assert ids("cafe run") == ([1], False)
    assert sorted(ids("cafe nothing")[0]) == [1, 2, 3] and ids("cafe nothing")[1]
    assert ids('"the cafe"') == ([2, 1], False) or sorted(ids('"the cafe"')[0]) == [1, 2]
    assert ids('"here ann"') == ([], False) and ids("") == ([], False)
    assert search.parse_query('a "b c" d') == (["b c"], ["a", "d"])


def test_snippet(spark):
    text = "x" * 80 + " Hello <b>"
    assert one(spark, search.snippet(F.lit(text), ["hello"])) == "…" + "x" * 49 + " <mark>Hello</mark> &lt;b&gt;"
    assert one(spark, search.snippet(F.lit("short"), ["zzz"])) == "short"


def brute_chrf(p, g):
    grams = lambda t, n: Counter([t[i : i + n] for i in range(len(t) - n + 1)] or [t])
    ps, rs = [], []
    for n in range(1, 7):
        a, b = grams(p.lower(), n), grams(g.lower(), n)
        both = sum(min(a[k], b[k]) for k in a)
        ps.append(both / sum(a.values()))
        rs.append(both / sum(b.values()))
    p, r = sum(ps) / 6, sum(rs) / 6
    return 2 * p * r / (p + r) if p and r else 0.0


def test_scores(spark):
    for p, g in (("see you soon", "see you later"), ("kk", "kk"), ("abc", "xyz"), ("a", "abcdefgh")):
        assert S.chrf_score(p, g) == pytest.approx(brute_chrf(p, g))
    assert S.rouge_score("a b c d", "a c d e") == pytest.approx(0.75)
    assert S.is_spam("okay " * 60) and not S.is_spam("a normal reply that says something new") and not S.is_spam("ha ha")
    assert S.trim_spam("thank you " * 90) == "thank you thank you" and S.trim_spam("hehehehehehe") == "hehe"
    assert one(spark, S.ranking(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(False))) == pytest.approx(1.3)
