import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sketchloom.llm import bpe, token_files, wavelet
from sketchloom.llm.queries import queries, tokenizer_path
from sketchloom.llm.wavelet import TokenFile, encode_file

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.WordEncoder(PATH)


def ids_of(encoder, texts):
    flat, counts = encoder.encode(pa.array(texts, pa.string()))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_documents(encoder, library, small):
    texts = [r.text for r in small.collect()]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(encoder, texts) == want
    assert [encoder.decode(np.array(i)) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


TRICKY = st.text(alphabet="aAbéÉßÀ×÷ \t\n.,!?$'sSrRe<|>/endoftxØœŒ̱́  \x1c1²🙂ÿǄ中", max_size=40)


@given(st.lists(st.one_of(TRICKY, st.text(max_size=30), st.sampled_from(["<|endoftext|>", "x<|startoftext|>.", "<|ENDOFTEXT|>"])), max_size=6))
@settings(max_examples=200, deadline=None)
def test_any_text(encoder, library, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert ids_of(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(library, small, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 50)
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    fresh = bpe.WordEncoder(PATH)
    for r in small.limit(30).collect():
        assert ids_of(fresh, [r.text]) == [library.encode(r.text, add_special_tokens=False).ids]


def test_frequent_pieces_are_found_by_hash(library, small, monkeypatch):
    texts = [r.text for r in small.limit(60).collect()] * 2
    fresh, asked = bpe.WordEncoder(PATH), []
    packed = bpe.WordEncoder._packed
    monkeypatch.setattr(bpe.WordEncoder, "_packed", lambda self, buf, starts, ends: asked.append(len(starts)) or packed(self, buf, starts, ends))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(fresh, texts) == ids_of(fresh, texts) == want
    assert asked[0] > 100 and sum(asked[1:]) < asked[0] / 10  # but for pieces that share a place of the table


@pytest.mark.parametrize(("bits", "most"), [(1, 1 << 21), (18, 20), (3, 20)])
def test_small_tables_change_nothing(library, small, monkeypatch, bits, most):
    monkeypatch.setattr(bpe, "TABLE_BITS", bits)
    monkeypatch.setattr(bpe, "TABLE_IDS", most)
    fresh = bpe.WordEncoder(PATH)
    for r in small.limit(30).collect():
        assert ids_of(fresh, [r.text, "x x", r.text]) == [e.ids for e in library.encode_batch([r.text, "x x", r.text], add_special_tokens=False)]


def test_tree_concatenation(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_BYTES", 16)
    random.seed(4)
    parts = ["the", "ing", "an", "str", "é", "ß", "q", "tion", "ou", "a", "e", "xx", "!", "?", "1"]
    for _ in range(400):
        text = "".join(random.choice(parts[: random.randint(2, 15)]) for _ in range(random.randint(1, 150)))
        assert encoder.encode_long(text) == library.encode(text, add_special_tokens=False).ids


def by_tree(encoder, texts):
    flat, counts = encoder.encode_by_tree(pa.array(texts, pa.string()))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_tree_of_documents(library, small):
    encoder = bpe.WordEncoder(PATH)
    texts = [r.text for r in small.collect()]
    assert by_tree(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    leaves = sum(1 << max(0, (len(t.encode()) // bpe.LEAF_BYTES).bit_length()) for t in texts)
    assert encoder.joins > len(texts) / 4 and encoder.joins <= leaves and encoder.grown > 0


@given(st.lists(st.one_of(TRICKY, st.text(max_size=60), st.sampled_from(["ab" * 40, "x<|endoftext|>. " * 5])), max_size=6), st.integers(2, 40))
@settings(max_examples=200, deadline=None)
def test_tree_of_any_text(encoder, library, texts, leaf):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "LEAF_BYTES", leaf)
        patch.setattr(bpe, "LONG_BYTES", 3 * leaf)
        patch.setattr(bpe, "SLICE_BYTES", 5 * leaf)
        assert by_tree(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_tree_of_a_huge_text(encoder, library):
    piece = "the Quick brown fox's 12 jumps, " * 1000
    text = piece * 60 + "z" * 300_000 + piece
    assert by_tree(encoder, [text, None, "a b"]) == [library.encode(t, add_special_tokens=False).ids for t in (text, "", "a b")]


def test_registered_round_trip(spark, small, library):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want = []
    for r in small.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    rows = queries()["op7_bpe_round_trip"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)


def test_registered_token_files(spark, small, library):
    rows = queries()["op6_token_files"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=str) == expected(small.collect(), library)


def test_tokenizers_that_keep_white_space_are_refused():
    with pytest.raises(ValueError, match="white space"):
        bpe.WordEncoder(PATH.replace("word_bpe_49k", "byte_bpe_50k"))


def test_round_trip_query(spark, odd_docs, no_docs, library):
    rows = bpe.bpe_round_trip(odd_docs, PATH).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in rows)
    assert got == sorted((str(d.doc_id), i, library.decode(i, skip_special_tokens=False)) for d, i in zip(odd_docs.collect(), want))
    assert bpe.bpe_round_trip(no_docs, PATH).count() == 0


def test_tokenizer_is_whole():
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert bpe.WordEncoder(PATH).plain and spec["model"]["type"] == "BPE"


@given(st.lists(st.integers(0, 49407), max_size=300), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix(ids, spread):
    x = np.array([i >> (4 * spread) for i in ids], np.int64)
    file = TokenFile(encode_file(x, np.array([7]), np.array([True]), np.array([len(x)])))
    assert file.ids().tolist() == x.tolist()
    for i in range(0, len(x), 7):
        t = int(x[i])
        assert file.access(i) == t
        assert file.count(t, i) == int((x[:i] == t).sum())
        assert file.occurrence(t, file.count(t, i)) == i
    assert file.count(60_000) == 0
    with pytest.raises(IndexError):
        file.occurrence(60_000, 0)


def test_parts_of_any_size(monkeypatch):
    ids = np.random.default_rng(5).integers(0, 300, 1000).astype(np.uint16)
    whole = encode_file(ids, np.arange(1), np.ones(1, bool), np.array([1000]))
    for part in (1, 7, 999, 1000):
        monkeypatch.setattr(wavelet, "PART", part)
        assert encode_file(ids, np.arange(1), np.ones(1, bool), np.array([1000])) == whole
        assert (TokenFile(whole).ids() == ids).all()


def test_many_blocks():
    x = np.random.default_rng(0).zipf(1.3, 200_000) % 49_408
    file = TokenFile(encode_file(x, np.array([1]), np.array([True]), np.array([len(x)])))
    assert (file.ids() == x).all()
    assert file.access(150_000) == x[150_000] and file.count(1) == int((x == 1).sum())


def expected(rows, library):
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    out, at = [], 0
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        out.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("tokens", [1 << 22, 50])
def test_token_files(spark, odd_docs, small, no_docs, library, monkeypatch, tokens):
    monkeypatch.setattr(token_files, "FILE_TOKENS", tokens)
    for docs in (odd_docs, small):
        manifest = token_files.write_token_files(docs, token_files.new_folder(spark), PATH)
        got = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=str)
        assert got == expected(docs.collect(), library)
    assert token_files.read_token_files(token_files.write_token_files(no_docs, token_files.new_folder(spark), PATH)).count() == 0
