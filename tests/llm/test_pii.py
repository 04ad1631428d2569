import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm.pii import BASE_KINDS, find_spans, iban_ok, luhn, pii_digest, redact

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"\D", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1b2.@+-()% 0456é😀\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in find_spans(text) if s[0] in BASE_KINDS] == brute(text)


def test_time_is_linear():
    """A megabyte of each kind of anchor, none of which may make the parsers read the rest again."""
    pieces = ["http://a.bc/", "https://http://", "+1 (2", "a@b.", "a@@", "1.2.3.4.", "1 2-", "token=token:", "token=abcdefghijklmnopq_", "iban GB82 ", "account 1", "12 North Road ", "0", "street "]
    for piece in pieces:
        begun = time.process_time()
        find_spans(piece * (1_000_000 // len(piece)))
        assert time.process_time() - begun < 6, piece


def test_long_runs_of_digits():
    assert [s[0] for s in find_spans("0" * 5000 + "1.2.3.4 and 1.2.3.0000000256 and 4.3.2.1")] == ["ip", "ip"]


def test_luhn_and_iban():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert iban_ok("GB82 WEST 1234 5698 7654 32") and not iban_ok("GB83 WEST 1234 5698 7654 32")


def test_cues():
    text = 'see https://a.example.com/x, token = "7702344ead31d5951ffa625c69a7546f3a470a7f", 12 North Hill Road, account 12345678'
    assert [k for k, *_ in find_spans(text)] == ["url", "secret", "address", "account"]


def test_digest(odd_docs, odd_texts, empty_docs):
    rows = pii_digest(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else odd_texts[r.doc_id] or ""
        want = ",".join(":".join(map(str, s)) for s in brute(text))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    r = next(r for r in rows if r.doc_id == 11)
    assert (r.n_email, r.n_phone, r.n_card, r.n_ip) == (1, 1, 1, 1)
    assert pii_digest(empty_docs).collect() == []


def test_redact(odd_docs):
    r = redact(odd_docs).where("doc_id = 11").first()
    assert r.text == "mail me: [email], or [phone] / [card] / [ip]."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("at 12 Hill Road.", "12 Hill Road"), ("12345 A" + "b" * 70 + " Street", "12345 A" + "b" * 70 + " Street"), ("9 Old Mill Pond Lane", "9 Old Mill Pond Lane"), ("12b Hill Avenue", "12b Hill Avenue"),
        ("123456 Main Street", None), ("x12 Main Street", None), ("9 One Two Three Four Road", None), ("12 hill Road", None), ("12  Hill Road", None), ("Hill Road", None), ("12 Road", None), (" Road", None),
        ("7 A" + "b" * 500_000 + " Road", "7 A" + "b" * 500_000 + " Road"),
    ],
)
def test_addresses(text, want):
    """Names of any length; a house number of five digits at most, not the end of a longer one."""
    assert [text[s:e] for k, s, e in find_spans(text) if k == "address"] == ([want] if want else [])
