"""Token counts against the tokenizers library on whole texts."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kwhlens.llm import queries, token_counts
from tests.llm.conftest import ODD, SMOKE, rows

SPEC = open(queries.WORD_BPE, encoding="utf-8").read()


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(SPEC)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_str(SPEC)


def want(tok, texts):
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_query_equals_library(spark, docs, tok):
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    counts = want(tok, list(texts.values()))
    assert rows(queries.op13_token_counts(spark, SMOKE)) == sorted(
        ((d, len(t.encode()), n, n > 2048) for (d, t), n in zip(texts.items(), counts)), key=lambda r: str(r[0]))


def test_odd_rows(odd, empty, tok):
    texts = [t or "" for _, t, *_ in ODD]
    expected = [(d, len(t.encode()), n) for (d, *_), t, n in zip(ODD, texts, want(tok, texts))]
    assert rows(token_counts.token_counts(odd, queries.WORD_BPE)) == sorted(
        expected, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert token_counts.token_counts(empty, queries.WORD_BPE).count() == 0


ALPHABET = ["'s", "'t", "'re", "'r", "'", "''", "!", "'l", "ll", "e", "v", "d", "m", " ", "\n", "a", "b", "É", "é", "Σ", "İ",
            "<|endoftext|>", "<|startoftext|>", "<|start", "1", "½", "字", "́", "😀", "\x00", "\x1c", "​", "ﬁ", "ß", "া"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), max_size=5), st.integers(2, 40))
def test_parts_do_not_change_counts(counter, tok, texts, part):
    before, token_counts.PART = token_counts.PART, part
    try:
        assert counter.count(texts).tolist() == want(tok, texts)
    finally:
        token_counts.PART = before


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(counter, tok, text):
    assert counter.count([text]).tolist() == want(tok, [text])


@pytest.mark.parametrize("unit, n", [("a", 1_000_000), (" ", 2_000_000), ("\n", 2_000_000), ("'", 500_000), ("字", 300_000),
                                     ("lorem", 100_000), ("é", 600_000), ("1", 300_000), ("'re", 200_000), ("<|endoftext|>", 9)])
def test_long_runs(counter, tok, unit, n):
    for text in (unit * n, "hi " + unit * n + " don't", unit * n + "x"):
        assert counter.count([text]).tolist() == want(tok, [text])


def test_bounded_tables_begin_anew(tok):
    small = token_counts.TokenCounter(SPEC)
    small.counter.most = 50
    texts = [f"words number {i} and their endings {i * 7919}" for i in range(200)]
    for i in range(0, 200, 20):
        assert small.count(texts[i:i + 20]).tolist() == want(tok, texts[i:i + 20])


def test_scan_equals_single_steps():
    import numpy as np

    classes = np.random.default_rng(1).integers(0, 10, 1000).astype(np.uint8)
    states = token_counts.scan_states(classes, 2, run=16)
    assert states[0] == 2
    assert (token_counts._STEP[states[:-1], classes] == states[1:]).all()


def test_other_files_are_refused():
    d = json.loads(SPEC)
    d["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\S+"}
    with pytest.raises(ValueError):
        token_counts.TokenCounter(json.dumps(d))
