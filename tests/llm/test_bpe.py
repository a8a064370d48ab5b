"""Byte-pair coding against the tokenizers library."""

import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rateweave.llm import bpe, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "  ", "<|endoftext|>hi<|startoftext|> <|endoftext|>", "<|endoftext|", "İstanbul ΑΣ Σ ς", "é É Ÿ", "a\x1cb\x1f c\x85d\xa0e",
    "'S it's I'LL 'll x''s I'm!!'s", "日本語 テスト 123", "½ ² ٣", "\x00a \ufeff x", "👍🏽 ok", "ǅ ß ẞ ĲŒ ŉ Ɓ", "a" * 3000, "the" * 300, "x1y2 a-b_c",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Bpe(file.read())


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_odd_texts_like_the_library(own, library):
    wanted = [library.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [ids(p) for p in own.encode_all(ODD)] == wanted
    assert [own.decode(own.encode(t)) for t in ODD] == [library.decode(w, skip_special_tokens=False) for w in wanted]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_like_the_library(own, library, text):
    assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text("thehinganoé's.!1 ", max_size=400))
def test_word_like_text_and_small_memory(own, library, text):
    own.words.clear(), own.pieces.clear()
    assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_heap_and_side_by_side_merge_alike(own, monkeypatch):
    words = [bytes(np.random.default_rng(k).choice(list(b"thinganore"), 50)) for k in range(40)]
    beside = own.encode_words(words)
    monkeypatch.setattr(bpe, "HEAP_FROM", 2)
    assert own.encode_words(words) == beside


def test_no_token_spans_a_certain_cut(own):
    cuts = ~own.joined
    assert cuts.any()
    for i, token in own.tokens.items():
        if token in own.special:
            continue
        units = [own.characters[c] for c in token.removesuffix("</w>")]
        if token.endswith("</w>") and units:
            units[-1] += 256
        assert not any(cuts[a, b] for a, b in zip(units, units[1:])), i


def test_rows_nulls_clashing_columns(spark, library):
    rows = [(1, "It's the end", b"old", "x"), (2, None, None, "y"), (3, "", b"", None), (1, "It's the end", b"old", "x"), (None, "a", b"", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids binary, decoded string")
    v = bpe.vocabulary(spark, PATH)
    out = bpe.decode(bpe.encode(docs, v), v)
    assert sorted(out.columns) == ["decoded", "doc_id", "text", "token_ids"]
    got = sorted((r.doc_id or 0, r.text or "", ids(r.token_ids), r.decoded) for r in out.collect())
    wanted = []
    for i, text, *_ in rows:
        w = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((i or 0, text or "", w, library.decode(w, skip_special_tokens=False)))
    assert got == sorted(wanted)
    assert bpe.encode(docs.limit(0), v).count() == 0


def test_unknown_ids_are_skipped(own, library):
    packed = struct.pack("<3I", 320, 999_999, 49407)
    assert own.decode(packed) == library.decode([320, 999_999, 49407], skip_special_tokens=False)


def test_files_round_trip_and_partial_reads(spark, library, monkeypatch):
    v = bpe.vocabulary(spark, PATH)
    rows = [(k * 7 % 50, f"text number {k} of the file" * (k % 5)) for k in range(50)] + [(None, "no id"), (3, None), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = token_files.write(docs, lambda texts: v().encode_all(texts), 1, v.size)
    got = token_files.read(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *sorted(i for i, _ in rows if i is not None)]
    start = 0
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    for r in got:
        assert r.start == start and r.n_tokens == len(ids(r.token_ids)) and ids(r.token_ids) in texts[r.doc_id]
        start += r.n_tokens
    some = token_files.read(manifest, [3, 8]).collect()
    assert sorted(r.doc_id for r in some) == [3, 3, 3, 8]
    assert {(r.doc_id, r.start) for r in some} <= {(r.doc_id, r.start) for r in got}
    assert token_files.read(manifest, []).count() == 0
    assert token_files.read(token_files.write(docs.limit(0), lambda texts: v().encode_all(texts), 1, v.size)).count() == 0


def test_only_requested_frames_are_read_and_damage_is_found(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    path = tmp_path / "x.tokens"
    out = open(path, "wb")
    writer = token_files.ShardWriter(out, 2)
    for i in range(30):
        writer.add(i, np.full(20, i))
    writer.close()
    reader = token_files.open_reader(None, str(path))
    assert len(reader.frames) > 5
    read, frame = [], reader.frame
    reader.frame = lambda k: read.append(k) or frame(k)
    assert [(i, list(x)) for i, x in reader.documents({4, 29})] == [(4, [4] * 20), (29, [29] * 20)]
    assert len(read) == 2
    data = bytearray(path.read_bytes())
    data[int(reader.starts[1]) + 8] ^= 0xFF
    path.write_bytes(data)
    with pytest.raises(Exception):
        list(token_files.open_reader(None, str(path)).documents())
    assert [i for i, _ in token_files.open_reader(None, str(path)).documents({0})] == [0]
    path.write_bytes(b"x" * 40)
    with pytest.raises(token_files.Damaged):
        token_files.open_reader(None, str(path))


def test_many_long_fragments(own, library):
    text = "\n".join("acgt" * 17 + f"{'ac' * (k % 7)}" for k in range(300))
    assert ids(own.encode_all([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_the_cycle_collector_rests_while_texts_are_encoded(own, monkeypatch):
    import gc

    seen = []
    parts = own.parts
    monkeypatch.setattr(own, "parts", lambda text: seen.append(gc.isenabled()) or parts(text))
    assert gc.isenabled()
    own.encode_all(["one text", None])
    assert seen == [False, False] and gc.isenabled()
    with pytest.raises(TypeError):
        own.encode_all([3])
    assert gc.isenabled()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("'stmdrevlİ日́ \n\x1c.1é", max_size=40), max_size=8))
def test_word_ends_of_many_texts_like_the_library(own, library, texts):
    assert [ids(p) for p in own.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_each_different_word_of_a_run_is_encoded_once(own, library, monkeypatch):
    encoded, encode = [], own.encode_bytes
    monkeypatch.setattr(own, "encode_bytes", lambda text, ends: encoded.append(len(ends)) or encode(text, ends))
    texts = ["Alpha beta, alpha it's 1", None, "beta ALPHA!"] * 50
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids(p) for p in own.encode_all(texts)] == wanted
    assert encoded == [7]  # alpha beta , it 's 1 !
    monkeypatch.setattr(bpe, "RUN_CHARACTERS", 30)
    assert [ids(p) for p in own.encode_all(texts)] == wanted
    assert len(encoded) > 50
