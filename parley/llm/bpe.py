"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding by a state machine.

How far to the right a merge decision can depend on unread input follows from
the merge list alone; ``BpeTable.lookahead`` computes a sufficient bound. The
transducer merges what it has buffered, emits each token that ends more than that far
before the buffer's end, and keeps only the rest. Ordinary words fit in
one buffer, so their tokens are remembered in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from parley.llm.common import id_text, map_batches

#: Words longer than this (in bytes) are streamed; shorter ones are remembered, in two generations of so many.
STREAM_FROM, REMEMBERED = 64, 400_000

# Letters and numbers of later Unicode versions, which the tokenizer takes for signs.
_LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
_SIGNS = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in _LATER.split())
_SPLIT = regex.compile(
    r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[@]]+|[\p{N}--[@]]|[[^\s\p{L}\p{N}]||[@]]+".replace("@", _SIGNS)
)
#: Characters of words of more than one, by the kind that a word keeps to; a quote may begin a short form and so is none.
_KINDS = tuple(regex.compile(x.replace("@", _SIGNS)) for x in (r"(?V1)[\p{L}--[@]]+", r"(?V1)[[^\s\p{L}\p{N}]||[@]]+"))
#: Normalised characters after a word that must be known for it to be sure: a short form is read by up to three.
_WORD_AHEAD = 3
#: Characters of a text that are encoded at a time.
TEXT_PIECE = 1 << 16
#: The same pattern for lower-case texts of these characters only, by the faster engine and with letters first.
_PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ſ‘’“”–—]*")
_PLAIN_SPLIT = re.compile(r"[a-zÀ-ÖØ-öø-ſ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9À-ÖØ-öø-ſ]+")


@cache
def byte_letters() -> list[str]:
    """The visible character that stands for each byte: itself where printable, else the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    rest = {b: 256 + k for k, b in enumerate(hidden)}
    return [chr(b if b in shown else rest[b]) for b in range(256)]


class Memory(dict):
    """Ids of words; a word that is missing is looked up in the older generation, or encoded."""

    def __init__(self, encode: Callable[[str], list[int]], older: dict[str, bytes]) -> None:
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, word: str) -> bytes:
        known = self.older.get(word) or np.array(self.encode(word), "<u4").tobytes()
        if len(word) <= STREAM_FROM:
            self[word] = known
        return known


class BpeTable:
    """Vocabulary and merges of a tokenizer file, with what the transducer needs of them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.normaliser = Tokenizer.from_file(path).normalizer
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        ids = self.vocab
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.strings = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.lookahead = self._lookahead(ids, model["merges"])
        self.memory = Memory(self.word_ids, {})

    def _lookahead(self, ids: dict[str, int], merges: list) -> int:
        """Characters right of a token's end that can still change whether it forms.

        A rule (u, v) is blocked when a rule of higher rank takes v, or a suffix of v while v is
        still in parts, together with something further right; that rule can be blocked in turn, only by
        rules of still higher rank. Ranks fall along such a chain, so one pass over
        the merges in order of rank finds the longest reach.
        """
        width = {i: len(s.removesuffix(self.end)) for s, i in ids.items()}
        right: dict[int, int] = {}
        reach: dict[int, int] = {}
        most = max(width.values())
        for pair in merges:
            a, b = (ids[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            far, part = 0, b
            while part is not None:
                far = max(far, reach.get(part, 0))
                part = right.get(part)
            reach[a] = max(reach.get(a, 0), width[b] + far)
            right.setdefault(self.merges[a, b][1], b)
        return most + max(reach.values(), default=0)

    def symbols(self, word: bytes, last: bool) -> list[int]:
        letters, ids = self.letters, self.vocab
        out = [ids[letters[c]] for c in word[:-1]]
        tail = letters[word[-1]]
        return [*out, ids[tail + self.end] if last else ids[tail]]

    def merge(self, ids: list[int]) -> list[int]:
        """All merges applied, best rank first and leftmost among equals, in n log n time."""
        n = len(ids)
        if n < 2:
            return ids
        merges, ids = self.merges, list(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], k, m[1], ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, made, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = made, -1
            after[k] = nxt = after[j]
            if nxt >= 0:
                before[nxt] = k
                if m := merges.get((made, ids[nxt])):
                    heapq.heappush(heap, (m[0], k, m[1], made, ids[nxt]))
            prev = before[k]
            if prev >= 0 and (m := merges.get((ids[prev], made))):
                heapq.heappush(heap, (m[0], prev, m[1], ids[prev], made))
        return [i for i in ids if i >= 0]

    def stream(self, word: bytes, block: int | None = None) -> Iterator[int]:
        """Tokens of one word of any length; the buffer never holds more than a block and the lookahead."""
        width, sure = self.width, self.lookahead
        block = block or 4 * sure
        start = 0
        while True:
            stop = min(len(word), start + block + sure)
            last = stop == len(word)
            tokens = self.merge(self.symbols(word[start:stop], last))
            if last:
                yield from tokens
                return
            at = 0
            for t in tokens:
                if at + width(t) > stop - start - sure:
                    break
                at += width(t)
                yield t
            if not at:  # no token is sure yet: read more
                block *= 2
            start += at

    def width(self, token: int) -> int:
        return len(self.strings[token].removesuffix(self.end))

    def word_ids(self, word: str) -> list[int]:
        data = word.encode()
        return list(self.stream(data)) if len(data) > STREAM_FROM else self.merge(self.symbols(data, True))

    def words(self, text: str) -> list[str]:
        """The words that are merged on their own: canonical composition, lower case by character, split.

        Plain texts are composed already. Others go through the tokenizer's own normaliser, whose Unicode tables are not Python's.
        """
        low = text.lower()
        return _PLAIN_SPLIT.findall(low) if _PLAIN.fullmatch(low) else _SPLIT.findall(self.normaliser.normalize_str(text))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if not self.specials or "<|" not in text:
            return self._plain(text)
        return b"".join(
            np.array([self.special[x]], "<u4").tobytes() if k % 2 else self._plain(x) for k, x in enumerate(self.specials.split(text))
        )

    def _plain(self, text: str) -> bytes:
        return self.ids_of(self.words(text))

    def ids_of(self, words: list[str]) -> bytes:
        if len(self.memory) >= REMEMBERED:
            older = dict(self.memory)
            self.memory = Memory(self.word_ids, older)
        return b"".join(map(self.memory.__getitem__, words))

    def pieces(self, text: str, size: int | None = None) -> Iterator[bytes]:
        """Ids of a text, piece by piece where it is longer than ``size`` characters."""
        size = size or TEXT_PIECE
        if len(text) <= size:
            yield self.encode(text)
            return
        encoder = Encoder(self)
        for k in range(0, len(text), size):
            yield encoder.feed(text[k : k + size])
        yield encoder.close()


@cache
def _joins_left() -> frozenset[str]:
    """Characters that canonical composition can join to the one before or move past it."""
    marks = {chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))}
    seconds = set()
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(marks | seconds | {chr(c) for c in range(0x1161, 0x11C3)})  # and the later parts of Hangul syllables


class WordStream:
    """Tokens of one word that comes in pieces: ``BpeTable.stream`` with a buffer of its own."""

    def __init__(self, table: BpeTable) -> None:
        self.table, self.held = table, b""

    def feed(self, data: bytes) -> list[int]:
        """Tokens that no later byte can change; at least one byte is always held back."""
        self.held += data
        sure = self.table.lookahead
        if len(self.held) < 4 * sure:
            return []
        out, at = [], 0
        for t in self.table.merge(self.table.symbols(self.held, False)):
            if at + self.table.width(t) > len(self.held) - sure:
                break
            at += self.table.width(t)
            out.append(t)
        self.held = self.held[at:]
        return out

    def close(self) -> list[int]:
        return self.table.merge(self.table.symbols(self.held, True))


class Encoder:
    """Incremental encoding: feed a text in pieces of any size, get ids as soon as they are sure.

    Held back are: characters that a next one may join (``_joins_left``) or that may begin a special token; of what is normalised, the last word and
    three characters, as a word may go on; and of a word longer than STREAM_FROM, the lookahead of the merge list. So memory does not
    grow with the text, nor with a word.
    """

    def __init__(self, table: BpeTable) -> None:
        self.table, self.raw, self.low, self.word = table, "", "", None
        self.longest = max(map(len, table.special), default=0)

    def feed(self, text: str) -> bytes:
        self.raw += text
        out = []
        if self.table.specials:
            *whole, self.raw = self.table.specials.split(self.raw)
            for k, x in enumerate(whole):
                out.append(np.array([self.table.special[x]], "<u4").tobytes() if k % 2 else self._low(x) + self._flush())
        cut = len(self.raw) - 1
        begun = self.raw.find("<", max(0, len(self.raw) - self.longest + 1))
        if 0 <= begun < cut:
            cut = begun
        while cut > 0 and self.raw[cut] in _joins_left():
            cut -= 1
        if cut > 0:
            out.append(self._low(self.raw[:cut]))
            self.raw = self.raw[cut:]
        return b"".join(out)

    def close(self) -> bytes:
        out = self._low(self.raw) + self._flush()
        self.raw = ""
        return out

    def _low(self, text: str) -> bytes:
        """Ids of the words that are sure, with this text after what is held."""
        self.low += self.table.normaliser.normalize_str(text) if text else ""
        sure, at, out = len(self.low) - _WORD_AHEAD, 0, []
        if self.word is not None:  # the held text goes on a long word
            m = _SPLIT.match(self.low) if self.word[1].fullmatch(self.low[:1]) else None
            end = self._run(self.low, self.word[1]) if m else 0
            if end >= sure:
                return self._long(max(0, sure))
            out.append(self._long(end) + self._end_word())
            sure = len(self.low) - _WORD_AHEAD
        words = []
        for m in _SPLIT.finditer(self.low):
            if m.end() >= sure:
                break
            at = m.end()
            words.append(m.group())
        out.append(self.table.ids_of(words))
        self.low = self.low[at:].lstrip(" ")
        if len(self.low) > STREAM_FROM + _WORD_AHEAD:  # one long word, whose kind its first character tells
            kind = next((k for k in _KINDS if k.fullmatch(self.low[:1])), None)
            if kind is not None and self._run(self.low, kind) > len(self.low) - _WORD_AHEAD - 1:
                self.word = (WordStream(self.table), kind)
                out.append(self._long(len(self.low) - _WORD_AHEAD))
        return b"".join(out)

    def _run(self, text: str, kind: regex.Pattern) -> int:
        m = kind.match(text)
        return m.end() if m else 0

    def _long(self, n: int) -> bytes:
        """The next ``n`` characters belong to the long word."""
        ids = self.word[0].feed(self.low[:n].encode())
        self.low = self.low[n:]
        return np.array(ids, "<u4").tobytes()

    def _end_word(self) -> bytes:
        ids, self.word = self.word[0].close(), None
        return np.array(ids, "<u4").tobytes()

    def _flush(self) -> bytes:
        """What is held ends here."""
        out = b""
        if self.word is not None:
            out = self._long(self._run(self.low, self.word[1])) + self._end_word()
        out += self.table.ids_of(_SPLIT.findall(self.low))
        self.low = ""
        return out


class Decoder:
    """Incremental decoding: feed ids in pieces of any size, get text as soon as its bytes are complete.

    ``spaced`` joins token strings with a space, which is what a tokenizer file without a decoder
    asks for. Otherwise letters become bytes again, ends of words become spaces, and bytes pass through a UTF-8
    automaton that holds back at most three.
    """

    def __init__(self, table: BpeTable, spaced: bool = True) -> None:
        self.table, self.spaced, self.begun, self.held = table, spaced, False, b""
        self.bytes = {c: b for b, c in enumerate(table.letters)}

    def feed(self, ids: bytes) -> str:
        strings = self.table.strings
        parts = [strings[i] for i in np.frombuffer(ids, "<u4").tolist()]
        if self.spaced:
            lead = " " if self.begun and parts else ""
            self.begun = self.begun or bool(parts)
            return lead + " ".join(parts)
        out = bytearray(self.held)
        for s in parts:
            body = s.removesuffix(self.table.end)
            out += body.encode() if s in self.table.special else bytes(self.bytes[c] for c in body)
            if body != s:
                out += b" "
        keep = next((k for k in range(1, min(4, len(out) + 1)) if out[-k] >= 0xC0 and _utf8_len(out[-k]) > k), 0)
        self.held = bytes(out[len(out) - keep :])
        return out[: len(out) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def _utf8_len(lead: int) -> int:
    return 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


@cache
def table(path: str) -> BpeTable:
    return BpeTable(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of whole texts, null as empty. The file at ``path`` must exist on every executor."""
    path = path or default_path()

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        t = table(path)
        return {"doc_id": b.column("doc_id"), "ids": [np.frombuffer(t.encode(x), "<i4") for x in b.column("text").to_pylist()]}

    return map_batches(id_text(docs, id_col, text_col), batch, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from ``encode_documents``' rows."""
    path = path or default_path()

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        texts = []
        for ids in b.column("ids"):
            d = Decoder(table(path))
            texts.append(d.feed(np.asarray(ids.values, "<u4").tobytes()) + d.close() if ids.is_valid else None)
        return {"doc_id": b.column("doc_id"), "text": texts}

    return map_batches(encoded, batch, "doc_id long, text string")


def round_trip_digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    Null and empty texts have no tokens; repeated rows and null ids are encoded like any other; texts longer than TEXT_PIECE characters are encoded and decoded
    piece by piece, and words of any length are streamed; other columns are not read.
    """
    path = path or default_path()

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        t = table(path)
        n, sha, decoded = [], [], []
        for text in b.column("text").to_pylist():
            count, seen, d, digest = 0, hashlib.sha256(), Decoder(t), hashlib.sha256()
            for ids in t.pieces(text):
                count += len(ids) // 4
                seen.update(ids)
                digest.update(d.feed(ids).encode())
            digest.update(d.close().encode())
            n.append(count)
            sha.append(seen.hexdigest())
            decoded.append(digest.hexdigest())
        return {"doc_id": b.column("doc_id"), "n_tokens": n, "ids_sha256": sha, "decoded_sha256": decoded}

    return map_batches(id_text(docs, id_col, text_col), batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
