"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus-signs, digits,
URL schemes and identifier cues such as ``token`` or ``iban``. Deterministic
parsers then expand each anchor to the left and right and validate what they
found. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import id_text, map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "account", "address")
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"(?:https?|ftp)://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_SECRET = re.compile(r"\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_/+-]{16,})")
_IBAN = re.compile(r"\W{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?: number| no\.?)?\W{0,3}([0-9]{6,17})(?![0-9])")
#: Words of a street's name, and digits of a house number.
_STREET_WORDS, _HOUSE_DIGITS = 3, 5

_SCHEMES = ("http://", "https://", "ftp://")
_CUES = {
    "secret": ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key"),
    "iban": ("iban",),
    "account": ("account", "acct"),
    "address": ("street", "avenue", "road", "boulevard", "lane", "drive"),
}


@cache
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    for c, kind in (("@", "at"), ("+", "plus")):
        found.add_word(c, (kind, 1))
    for scheme in _SCHEMES:
        found.add_word(scheme, ("url", len(scheme)))
    for kind, words in _CUES.items():
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _octet(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) < 4 and int(short or "0") <= 255


def _word_bounds(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalpha())


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; leftmost and non-overlapping within a kind.

    Each parser reads a stretch of text that no other anchor of its kind reads again, so time is linear in the text;
    memory is what the spans take.
    """
    spans: list[tuple[str, int, int]] = []
    last = dict.fromkeys(KINDS, 0)

    def add(kind: str, start: int, end: int) -> None:
        if start >= last[kind]:
            spans.append((kind, start, end))
            last[kind] = end

    dotted, chain = _Dotted(text, add), _Chain(text, add)
    run_end = 0
    for stop, (kind, width) in _anchors().iter(text):
        at = stop + 1 - width
        if kind == "digit":
            if at >= run_end:
                run_end = _DIGITS.match(text, at).end()
                dotted.take(at, run_end)
                chain.take(at, run_end)
        elif kind == "at":
            start = at
            while start > last["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
        elif kind == "plus":
            if m := _PHONE.match(text, at):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    add("phone", at, m.end())
        elif kind == "url":
            if at >= last["url"] and (m := _URL.match(text, at)):
                add("url", at, m.end())
        elif _word_bounds(text, at, stop + 1):
            if kind == "secret" and at >= last["secret"] and (m := _SECRET.match(text, stop + 1)):
                add("secret", *m.span(1))
            elif kind == "iban" and (m := _IBAN.match(text, stop + 1)):
                if iban_ok(m.group(1)):
                    add("account", *m.span(1))
            elif kind == "account" and (m := _ACCOUNT.match(text, stop + 1)):
                add("account", *m.span(1))
            elif kind == "address" and (start := _street_start(text, at)) is not None:
                add("address", start, stop + 1)
    chain.close()
    spans.sort(key=lambda s: (s[1], _RANK[s[0]]))
    return spans


def _street_start(text: str, at: int) -> int | None:
    """Where the house number begins that, with one to three capitalised words of any length, stands before the cue at ``at``; None without one."""
    end = at - 1
    if end < 0 or text[end] != " ":
        return None
    for _ in range(_STREET_WORDS):
        k = end
        while k and "a" <= text[k - 1] <= "z":
            k -= 1
        if k == end or k < 2 or not "A" <= text[k - 1] <= "Z" or text[k - 2] != " ":
            return None
        end = n = k - 2
        if n and text[n - 1].isascii() and text[n - 1].isalpha():  # as in 12b
            n -= 1
        d = n
        while d and n - d <= _HOUSE_DIGITS and "0" <= text[d - 1] <= "9":
            d -= 1
        if 1 <= n - d <= _HOUSE_DIGITS and not (d and text[d - 1].isalnum()):
            return d
    return None


class _Dotted:
    """Four runs of digits with a dot between each make an address, if all are octets; a failing four is passed over."""

    def __init__(self, text: str, add: Callable[[str, int, int], None]) -> None:
        self.text, self.add, self.runs = text, add, []

    def take(self, start: int, end: int) -> None:
        if self.runs and not (start == self.runs[-1][1] + 1 and self.text[start - 1] == "."):
            self.runs.clear()
        self.runs.append((start, end))
        if len(self.runs) == 4:
            if all(b - a < 4 or not self.text[a : b - 3].strip("0") for a, b in self.runs) and all(_octet(self.text[max(a, b - 4) : b]) for a, b in self.runs):
                self.add("ip", self.runs[0][0], end)
            self.runs.clear()


class _Chain:
    """Runs of digits with one space or hyphen between them make a card, by their number and check digit."""

    def __init__(self, text: str, add: Callable[[str, int, int], None]) -> None:
        self.text, self.add, self.start, self.end, self.digits = text, add, 0, -2, 0

    def take(self, start: int, end: int) -> None:
        if not (start == self.end + 1 and self.text[start - 1] in " -"):
            self.close()
            self.start, self.digits = start, 0
        self.end, self.digits = end, self.digits + end - start

    def close(self) -> None:
        if 14 <= self.digits <= 19 and luhn("".join(c for c in self.text[self.start : self.end] if c not in " -")):
            self.add("card", self.start, self.end)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), one row per input row, whole texts.

    A null text counts as empty and has no spans; a null id stays null; repeated
    rows are reported once each; other columns, whatever their names, are not read.
    Texts of any length are read whole, in time linear in them. An empty table gives an empty result.
    """

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in b.column("text").to_pylist()]
        return {"doc_id": b.column("doc_id"), "spans": spans}

    return map_batches(id_text(docs, id_col, text_col), batch, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with each span replaced by ``[kind]``; overlapping spans become one placeholder."""

    def one(text: str) -> str:
        out, at = [], 0
        for kind, start, end in find_spans(text):
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": b.column("doc_id"), "text": [one(t) for t in b.column("text").to_pylist()]}

    return map_batches(id_text(docs, id_col, text_col), batch, "doc_id long, text string")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The report of ``op1``: counts by base kind, a digest of the base spans, and all spans as text."""
    found = find_pii(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
