"""Byte-level BPE and token files against the libraries on whole texts."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kwhlens.llm import byte_bpe, queries, token_files
from kwhlens.llm.words import text_buffers
from tests.llm.conftest import ODD, SMOKE, rows

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def test_byte_bpe_query(spark, docs, enc):
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert rows(queries.op9_byte_bpe(spark, SMOKE)) == sorted(want, key=lambda r: str(r[0]))


def test_byte_bpe_odd_rows(odd, empty, enc):
    got = rows(byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN, long=64), RANKS, P.PATTERN))
    want = sorted(((d, enc.encode_ordinary(t or ""), bytearray((t or "").encode())) for d, t, *_ in ODD),
                  key=lambda r: tuple((x is None, str(x)) for x in r))
    assert got == want
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 '\n\t.,!é字  \x1cs", max_size=120), st.integers(1, 8))
def test_pieces_are_safe(text, long):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    test_pieces_are_safe.enc = e = getattr(test_pieces_are_safe, "enc", None) or tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = list(byte_bpe.pieces(text, long))
    assert "".join(parts) == text
    assert [i for p in parts for i in e.encode_ordinary(p)] == e.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 '\n\t.,!é\x85\u2003 \x1cs", max_size=60), st.integers(2, 5))
def test_space_runs_beside_the_pattern(text, least):
    me = test_space_runs_beside_the_pattern
    if not hasattr(me, "enc"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        me.enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [i for x in byte_bpe.encode_text(me.enc, text, 8, least) for i in x] == me.enc.encode_ordinary(text)


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\u2003", " \n"])
def test_long_runs_of_space(enc, space):
    """2 million in a row, at the start, in the middle and at the end: no crash, and the ids follow those of runs that the library takes."""
    def ids(text):
        return [i for x in byte_bpe.encode_text(enc, text) for i in x]

    def one(piece):
        return enc._encode_single_piece(piece.encode())

    for n in (3000, 2_000_000):
        run = (space * n)[:n]
        cases = {
            run + "word": one(run[:-1]) + enc.encode_ordinary(run[-1] + "word"),
            "a b" + run + "word": enc.encode_ordinary("a b") + one(run[:-1]) + enc.encode_ordinary(run[-1] + "word"),
            "a b" + run: enc.encode_ordinary("a b") + one(run), run: one(run)}
        for text, want in cases.items():
            assert ids(text) == want
            assert b"".join(enc.decode_bytes(x) for x in byte_bpe.encode_text(enc, text)) == text.encode()
            if n == 3000:
                assert want == enc.encode_ordinary(text)


def test_long_runs_of_space_in_spark(spark, enc):
    docs = spark.createDataFrame([(1, " " * 1_500_000 + "x"), (2, "\n" * 1_500_000)], "doc_id long, text string")
    got = byte_bpe.encode(docs, RANKS, P.PATTERN, decoded=True).selectExpr("doc_id", "length(decoded) n").collect()
    assert sorted(map(tuple, got)) == [(1, 1_500_001), (2, 1_500_000)]


def _want(texts, tok):
    start, out = 0, []
    for d, t in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_query(spark, docs, tok):
    texts = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, queries.op4_token_files(spark, SMOKE).collect())) == _want(texts, tok)


def test_token_files_odd_rows(spark, odd, empty, tok, folder):
    manifest = token_files.write_tokens(odd, folder, queries.WORD_BPE, end_id=2, partitions=3)
    got = token_files.read_tokens(spark, folder, manifest).orderBy("start").select(
        "doc_id", "start", "n_tokens", F.crc32("tokens")).collect()
    texts = sorted(((d, t) for d, t, *_ in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [tuple(r) for r in got] == _want(texts, tok)
    none = token_files.write_tokens(empty, folder + "2", queries.WORD_BPE)
    assert token_files.read_tokens(spark, folder + "2", none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abAÉéΣσİ1' \n\t.,!<|>endoftext́  \x1c\x00字", max_size=60), max_size=6))
def test_word_encoder_equals_whole_texts(texts):
    import pyarrow as pa

    me = test_word_encoder_equals_whole_texts
    if not hasattr(me, "enc"):
        me.enc = token_files.WordEncoder(open(queries.WORD_BPE, encoding="utf-8").read())
    raw, off = text_buffers(pa.array(texts, pa.string()))
    if not texts:
        return
    ids, count = me.enc.encode(raw, off)
    want = [me.enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert count.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_case_sensitive_tokenizers(spark, tmp_path, folder):
    """A tokenizer without lower-casing keeps The and THE apart; one with another splitting rule is used on whole texts."""
    import json

    plain = json.load(open(queries.WORD_BPE, encoding="utf-8"))
    plain["normalizer"] = {"type": "NFC"}
    spaced = json.loads(json.dumps(plain))
    spaced["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    texts = [(-1, "The the THE Cat cat"), (None, "no id"), (-2, "a.b C.D  e"), (3, None), (None, "A")]
    for k, spec in enumerate((plain, spaced)):
        file = tmp_path / f"{k}.json"
        file.write_text(json.dumps(spec), encoding="utf-8")
        lib = Tokenizer.from_str(json.dumps(spec))
        lib.encode_special_tokens = True
        df = spark.createDataFrame(texts, "doc_id long, text string")
        manifest = token_files.write_tokens(df, f"{folder}-{k}", str(file), partitions=2)
        got = token_files.read_tokens(spark, f"{folder}-{k}", manifest).orderBy("start", "n_tokens").collect()
        order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        assert [(r.doc_id, np.frombuffer(r.tokens, "<u4").tolist()) for r in got if r.n_tokens] == [
            (d, lib.encode(t, add_special_tokens=False).ids) for d, t in order if t]
        assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in texts)
