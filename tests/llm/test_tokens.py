import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm import op1_token_counts as op1
from llm import op8_bpe as op8
from llm import op9_token_files as op9

WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", "  ", "AAAAAAAAaaaaaaa", "İstanbul ΣΑΣ Σ", "<|startoftext|>hi<|endoftext|>", "a<|endoftext|", "don't I'LL 's'S it’s",
       "日本語テキスト😀", "\x00\x01\x7f\x85 \x1c", "aaaa" * 3000, "ǅ ﬁ ẞ ½ ² 123", "q₞ἠ", "क्षि ก็", "!!!???..."]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_word_ids_equal_the_library(text):
    path = public_tokenizers.path(op8.MODEL)
    code = op8.coder(path)
    want = WORDS.encode(text, add_special_tokens=False).ids
    words = code.vocab.words(text)
    plain = [w for w in words if w not in code.vocab.specials]
    ids, at = code.encode(plain)
    parts = iter([ids[a:b].tolist() for a, b in zip(at, at[1:])])
    got = [i for w in words for i in ([code.vocab.specials[w]] if w in code.vocab.specials else next(parts))]
    assert got == want
    assert op1.merge_counts(code.vocab, plain).tolist() == np.diff(at).tolist()


def test_counts_and_ids_of_odd_texts(make_docs):
    docs = make_docs([*enumerate(ODD), (90, None), (91, "x"), (91, "x")])
    want = {i: WORDS.encode(t, add_special_tokens=False).ids for i, t in [*enumerate(ODD), (90, ""), (91, "x")]}
    counted = op1.count_tokens(docs).collect()
    assert len(counted) == len(ODD) + 3
    for r in counted:
        assert r.n_tokens == len(want[r.doc_id]) and r.over_limit == (r.n_tokens > 2048)
        assert r.n_bytes == len((ODD[r.doc_id] if r.doc_id < 90 else "" if r.doc_id == 90 else "x").encode())
    coded = op8.encode_texts(docs)
    for r in op8.decode_ids(coded, keep=("doc_id", "n_tokens", "ids")).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] and r.n_tokens == len(want[r.doc_id])
        assert r.text == WORDS.decode(want[r.doc_id], skip_special_tokens=False)


def test_empty_tables(make_docs, tmp_path):
    none = make_docs([])
    assert op1.count_tokens(none).collect() == [] and op8.encode_texts(none).collect() == []
    op9.write_token_files(none, str(tmp_path / "f"), parts=2)
    assert op9.read_token_files(none.sparkSession, str(tmp_path / "f")).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535) | st.integers(0, 3), max_size=200), min_size=1, max_size=6))
def test_blocks_round_trip(blocks):
    blocks = [np.array(b, np.int64) for b in blocks]
    bodies = op9.encode_blocks(blocks)
    got = op9.unpack([op9.pack(b, x) for b, x in zip(blocks, bodies)])
    assert all(np.array_equal(a, b) for a, b in zip(got, blocks))


def test_damage_is_found():
    ids = np.arange(500)
    record = op9.pack(ids, op9.encode_blocks([ids])[0])
    for at in (0, 9, 40):
        with pytest.raises(ValueError, match="block 0"):
            op9.unpack([record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :]])


def test_files_hold_all_ids_in_order(messy, tmp_path):
    op9.write_token_files(messy, str(tmp_path / "f"), parts=3)
    got = op9.read_token_files(messy.sparkSession, str(tmp_path / "f")).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in messy.collect()), key=lambda r: r[:2])
    place = 0
    for r, (known, doc_id, text) in zip(got, rows, strict=True):
        want = [*BYTES.encode(text or "", add_special_tokens=False).ids, op9.END]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id if known else None, place, len(want))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(want, "<u4").tobytes())
        place += len(want)


def test_digest_of_an_empty_text(make_docs):
    r = op8.encode_texts(make_docs([(1, None)])).first()
    assert hashlib.sha256(r.ids).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_contexts_and_weights_are_learned():
    rng = np.random.default_rng(5)
    same, cycle = np.full(4096, 65535), np.tile(rng.integers(0, 65536, 64), 64)
    # Order 1 alone cannot tell what follows an id here: the pair before it does.
    pairs = np.tile(rng.permutation(np.repeat(rng.integers(0, 65536, 24), 6)), 28)
    noise = rng.integers(0, 65536, 4096)
    bodies = op9.encode_blocks([same, noise, cycle, pairs, noise[:1], noise[:0]])
    assert len(bodies[0]) < 60 and len(bodies[2]) < 4096 // 4 and len(bodies[3]) < len(pairs) // 3
    assert len(bodies[1]) < 4096 * 2 * 1.15 and len(bodies[5]) <= 4
    got = op9.decode_blocks(bodies, [4096, 4096, 4096, len(pairs), 1, 0])
    for a, b in zip(got, [same, noise, cycle, pairs, noise[:1], noise[:0]], strict=True):
        assert np.array_equal(a, b)


def test_blocks_do_not_depend_on_their_neighbours():
    rng = np.random.default_rng(6)
    blocks = [rng.integers(0, 300, n) for n in (900, 20, 4096, 1)]
    assert op9.encode_blocks(blocks) == [op9.encode_blocks([b])[0] for b in blocks]


def test_parts_are_ranges_of_ids(make_docs, tmp_path):
    docs = make_docs([(i * i, "some words " * (i % 7)) for i in range(400)] + [(None, "x"), (None, None)])
    op9.write_token_files(docs, str(tmp_path / "f"), parts=9)
    rows = docs.sparkSession.read.parquet(str(tmp_path / "f")).where("kind = 'docs'").groupBy("part").agg(
        {"doc_id": "min", "*": "count"}).orderBy("part").collect()
    assert 6 <= len(rows) <= 9 and max(r["count(1)"] for r in rows) < 120
    least = [r["min(doc_id)"] for r in rows]
    assert least == sorted(least)
    got = op9.read_token_files(docs.sparkSession, str(tmp_path / "f")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, *(i * i for i in range(400))]


def test_an_id_is_one_step_of_the_coder(monkeypatch):
    steps, narrow = [], op9._Range.narrow
    monkeypatch.setattr(op9._Range, "narrow", lambda self, m, *odds: (steps.append(m), narrow(self, m, *odds))[1])
    blocks = [np.arange(40) % 7, np.arange(25)]
    bodies = op9.encode_blocks(blocks)
    assert sum(steps) == 65
    op9.decode_blocks(bodies, [40, 25])
    assert sum(steps) == 130


def test_frequent_ids_take_few_bits():
    rng = np.random.default_rng(7)
    odds = 1 / np.arange(1, 400)
    odds /= odds.sum()
    ids = rng.permutation(50000)[:399][rng.choice(399, 4096, p=odds)]
    body = op9.encode_blocks([ids])[0]
    # What the ids hold in themselves, and two bytes for each of 399 that are new.
    assert len(body) < 1.15 * (-(odds * np.log2(odds)).sum() * 4096 / 8 + 399 * 2)
    assert np.array_equal(op9.decode_blocks([body], [4096])[0], ids)


def test_words_spell_every_code_point_as_the_library_does():
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x20000, 999)]]
    texts = ["".join(f"a{c}b {c}{c}1{c}2 {c}!{c}?  {c} \n{c}\n {c}'s{c}  " for c in points[a : a + 50]) for a in range(0, len(points), 50)]
    texts += [*ODD, "x<|endoftext|>y", "", " " * 500]
    got = op9._Encoder(public_tokenizers.path(op9.MODEL)).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == BYTES.encode(text, add_special_tokens=False).ids


def test_the_library_is_asked_once_for_a_word(monkeypatch):
    encoder = op9._Encoder(public_tokenizers.path(op9.MODEL))
    asked, ask = [], encoder.ask
    monkeypatch.setattr(encoder, "ask", lambda texts: asked.extend(texts) or ask(texts))
    texts = ["one two three two", "two three", "one"] * 30
    first = encoder.encode(texts)
    assert sorted(asked) == [" three", " two", "one", "two"]
    assert encoder.encode(texts) == first and len(asked) == 4
    monkeypatch.setattr(op9, "KNOWN", 40)
    encoder.room = 0
    assert encoder.encode(["four", *texts])[1:] == first
