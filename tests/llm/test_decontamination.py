import random
import re
import resource

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import decontamination
from parley.llm.decontamination import Items, banded_distance, code_points, contaminated, drop_contaminated, needed, normalise, qgram_codes

from .conftest import sentence


def brute_best(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30), st.integers(0, 12))
def test_distance(item, text, budget):
    want, got = brute_best(item, text), banded_distance(code_points(item), code_points(text), budget)
    assert (got is None) == (want > budget)
    if got:
        assert got[0] == want == brute_best(item, text[got[1] : got[2]])


def test_normalise():
    assert normalise("  A\t\n b\x0b\x0c\r   Éé　x ") == "a b Éé　x"


def test_qgrams_and_bound():
    text = "abcdefgh漢字abcdefgh"
    for q in (1, 2, 4, 8):
        codes = qgram_codes(code_points(text), q)
        same = {}
        for k, c in enumerate(codes.tolist()):
            same.setdefault(c, set()).add(text[k : k + q])
        assert len(codes) == len(text) - q + 1 and all(len(s) == 1 for s in same.values())
    for n in range(1, 500):
        edits, q, least = needed(n)
        assert edits == int(n * 0.08) and 1 <= least == n + 1 - q * (edits + 1)


def brute_matches(items, texts):
    want = {}
    for t, text in enumerate(texts):
        for i, (_, item) in enumerate(items):
            d = brute_best(item, text)
            if d <= needed(len(item))[0] and (d or len(item) > 12 or re.search(rf"(?<![^\W_]){item}(?![^\W_])", text)):
                want[t, i] = d
    return want


@pytest.mark.parametrize(("segment", "slice_", "aligned"), [(1 << 18, 1 << 20, 1 << 16), (64, 50, 40)])
def test_small_alphabet(monkeypatch, segment, slice_, aligned):
    """Texts and items that repeat themselves, whatever the sizes of segments, slices and parts."""
    monkeypatch.setattr(decontamination, "SEGMENT", segment)
    monkeypatch.setattr(decontamination, "SLICE", slice_)
    monkeypatch.setattr(decontamination, "ALIGNED", aligned)
    rng = random.Random(segment)
    word = lambda n: "".join(rng.choice("ab漢") for _ in range(n))
    items = [(k, word(rng.choice([1, 3, 7, 13, 14, 15, 20, 30, 60]))) for k in range(25)] + [(90, "-" * 100), (91, "-" * 48 + "x" + "-" * 51)]
    texts = [" ".join(word(rng.randint(0, 30)) for _ in range(6)) for _ in range(25)] + ["-" * 150, "a" * 97 + "-" * 98, ""]
    for _ in range(15):
        item = list(rng.choice(items)[1])
        for _ in range(int(len(item) * 0.08) + rng.randint(0, 1)):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice(["", "q", item[at] + "漢"])
        texts.append(rng.choice(["", word(9) + " "]) + "".join(item) + rng.choice(["", " " + word(5)]))
    got = {(t, i): d for t, i, d, _, _ in Items(items).matches(texts)}
    assert got == brute_matches(items, texts) and len(got) > 12


def test_short_items_and_characters():
    items = [(1, "what is two plus two?"), (2, "yes no"), (3, "漢字仮名交文書読解問題集" * 2)]
    changed = items[2][1][:5] + "一" + items[2][1][6:]
    found = Items(items).matches(["so: what is two plus two? four", "yes nothing", "a yes no b", f"x{changed}y"])
    assert [(t, i, e) for t, i, e, _, _ in found] == [(0, 0, 0), (2, 1, 0), (3, 2, 1)]
    assert found[0][3:] == (4, 25)


def test_repetitive_text_is_bounded():
    items = Items([(1, "-" * 100), (2, "-" * 40 + "abc" + "-" * 57)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = items.matches(["-" * 1_000_000])
    assert [f[:3] for f in found] == [(0, 0, 0), (0, 1, 3)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB


def test_leaks(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, sentence(rng, 30)) for k in range(12)] + [(90, None), (91, " \n"), (None, "x" * 60), (5, "four little words here")]
    docs, want = [], {}
    for k in range(60):
        text = sentence(rng, 80)
        if k % 3 == 0:
            item = items[k % 12][1]
            chars = list(item)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(chars))
                chars[at] = rng.choice(["", "q", chars[at] + "z"])
            leaked = "".join(chars)
            text = f"{sentence(rng, 20)}\n {leaked.upper()}\n{text}"
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, "z" * 50_000), (None, items[0][1]), (103, "the Four  little words\nhere.")]
    docs += docs[:1]
    for k, text in docs:
        for i, item in [*items[:12], items[15]]:
            d = brute_best(normalise(item), normalise(text or "")) if text and len(text) < 5000 else 10**6
            if d <= needed(len(normalise(item)))[0]:
                want[k, i] = d if (k, i) not in want else min(d, want[k, i])
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in docs], "doc_id long, text string, item_id string, edits int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    for chars in (10**6, 500):  # in one pass over the documents, and in several
        monkeypatch.setattr(decontamination, "SCAN_CHARS", chars)
        got = contaminated(df, bench).collect()
        assert {(r.doc_id, r.item_id): r.edits for r in got} == want and len(want) >= 20
        assert len(got) == len(want) + sum(k == 0 for k, _ in want)
        left = drop_contaminated(df, bench)
        assert left.columns == df.columns
        assert {r.doc_id for r in left.collect()} == {k for k, _ in docs} - {k for k, _ in want}
    assert contaminated(df.where("1 = 0"), bench).collect() == [] and contaminated(df, bench.where("1 = 0")).collect() == []
    assert drop_contaminated(df, bench.where("1 = 0")).count() == len(docs)
