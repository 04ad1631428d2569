import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm.bpe import BpeTable, Decoder, Encoder, decode_documents, default_path, encode_documents, round_trip_digest
from parley.llm.token_store import encoder, read_tokens, stored_digest, write_tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def table():
    return BpeTable(default_path())


ODD = st.one_of(st.text(max_size=80), st.text(alphabet="abeinrst'é ", max_size=300), st.sampled_from(["a<|endoftext|>b", "<|startoftext|> x", "ΑΣ Σ", "the" * 3000, "\x1c-\x1d!"]))


@settings(max_examples=200, deadline=None)
@given(text=ODD)
def test_same_as_library(library, table, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(table.encode(text), "<u4").tolist() == want
    assert np.frombuffer(encoder(default_path()).encode(text), "<u4").tolist() == want


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(ODD, st.text(alphabet="ab'stlre\u0301\u1100\u1161\u11a8< |endoftx>1!", max_size=400)), step=st.integers(1, 90))
def test_text_in_pieces(table, text, step):
    """Any cut: through letters and their accents, short forms, special tokens, words of any length."""
    assert b"".join(table.pieces(text, step)) == table.encode(text)


@pytest.mark.parametrize("text", ["x" * 1_000_000, "ab'll " * 30_000 + "!" * 300_000 + "é" * 9, "漢字" * 100_000, "a<|endoftext|>" * 20_000, "e\u0301" * 100_000])
def test_long_texts_hold_little(table, text):
    encoder, out, held = Encoder(table), [], 0
    for k in range(0, len(text), 4096):
        out.append(encoder.feed(text[k : k + 4096]))
        held = max(held, len(encoder.raw) + len(encoder.low) + (len(encoder.word[0].held) if encoder.word else 0))
    assert b"".join([*out, encoder.close()]) == table.encode(text)
    assert held < 4096 + 8 * table.lookahead


@settings(max_examples=60, deadline=None)
@given(word=st.text(alphabet="abcdeinrsthgou", min_size=1, max_size=4000), block=st.integers(1, 700))
def test_streaming_changes_nothing(table, word, block):
    data = word.encode()
    assert list(table.stream(data, block)) == table.merge(table.symbols(data, True))


def test_decoder_in_pieces(library, table):
    text = "naïve 漢字 😀 déjà vu's"
    ids = table.encode(text)
    want = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    for step in (4, 8, 400):
        spaced, plain = Decoder(table), Decoder(table, spaced=False)
        pieces = [ids[k : k + step] for k in range(0, len(ids), step)]
        assert "".join(spaced.feed(p) for p in pieces) + spaced.close() == want
        assert "".join(plain.feed(p) for p in pieces) + plain.close() == "naïve 漢字 😀 déjà vu 's "


def test_digests(odd_docs, odd_texts, library, empty_docs):
    rows = round_trip_digest(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else odd_texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert round_trip_digest(empty_docs).collect() == []
    texts = {r.doc_id: r.text for r in decode_documents(encode_documents(odd_docs)).collect()}
    assert texts[10] == "a</w> b</w>" and texts[1] == ""


def test_token_store(spark, odd_docs, odd_texts, library, empty_docs, tmp_path):
    import zlib

    docs = odd_docs.dropDuplicates(["doc_id"])
    rows = sorted(stored_digest(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    at = 0
    for r, text in zip(rows, ["no id", *odd_texts], strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert stored_digest(empty_docs).collect() == []
    write_tokens(odd_docs, f"file://{tmp_path}/t")
    assert read_tokens(spark, f"file://{tmp_path}/t").count() == len(odd_texts) + 2
    assert {r.doc_id for r in read_tokens(spark, f"file://{tmp_path}/t", 3, 5).collect()} == {3, 4, 5}
