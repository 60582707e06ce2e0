"""The pipeline's rows against a plain Python version, stage after stage."""

import base64
import collections
import re

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from kwhlens.llm import language_id
from tests.llm.conftest import SMOKE
from tests.llm.test_documents import brute_components


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def grams(text):
    w = [x for x in re.split(r"[\x09-\x0D\x20-/:-@\[-`{-~]+", lower(text)) if x]
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)], w


def similar(window, item):
    weight = lambda g: sum(len(x.encode()) for x in g)
    a, b = collections.Counter(window), collections.Counter(item)
    both = sum(min(a[g], b[g]) * weight(g) for g in a)
    return both / (sum(map(weight, window)) + sum(map(weight, item)) - both)


def holds(text, items):
    g, w = grams(text)
    for item, size in items:
        width = min(size, len(w))
        for s in range(len(w) - width + 1):
            part = g[s:s + width - 4]
            if set(part) & set(item) and similar(part, item) >= 0.8:
                return True
    return False


def test_pipeline_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    filters = language_id.train(docs)
    kept = {}
    for d, r in rows.items():
        g, ends = language_id.letter_grams([r.text or ""])
        if len(g) and filters.shares(g, ends).max() >= 0.3:
            kept[d] = r.text
    pages, count = collections.Counter(), collections.Counter()
    for d, t in kept.items():
        pages[rows[d].source] += 1
        count.update({(rows[d].source, x.strip(" ")) for x in t.split("\n") if x.strip(" ")})
    bad = {k for k, n in count.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    kept = {d: "\n".join(x for x in t.split("\n") if (rows[d].source, x.strip(" ")) not in bad) for d, t in kept.items()}
    kept = {d: kept[d] for d, _, c in brute_components(kept) if c == d}
    items = [grams(r.text) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
    items = [(g, len(w)) for g, w in items if g]
    kept = {d: t for d, t in kept.items() if not holds(t, items)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SMOKE).collect()}
    assert got == {d: enc.encode_ordinary(t) for d, t in kept.items()}
    assert 0.5 * len(rows) < len(got) < len(rows)


def test_stages_keep_columns_and_odd_rows(spark, odd, empty):
    odd = odd.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"), "key", "score", "gone")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SMOKE)
        assert out.columns == odd.columns, name
        assert out.count() <= odd.count()
        assert stage(spark, odd.where("doc_id < 0"), SMOKE).count() == 0
    last = corpus_pipeline.token_ids(spark, odd, SMOKE)
    assert last.count() == odd.count()
    assert np.all([r.n_tokens == len(r.ids) for r in last.collect()])


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
