"""Decontamination, line dedup, fingerprints, Jaccard join, language ID and LM scores: brute force, SQL, odd rows."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from kwhlens.llm import decontaminate, fingerprint, jaccard_join, language_id, line_dedup, lm_score, queries
from kwhlens.llm.components import connected_components
from kwhlens.llm.words import shingle_sets
from kwhlens.session import Scratch
from tests.llm.conftest import ODD, SMOKE, rows


def norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 9) if isinstance(v, (float, np.floating)) else v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    want = con.execute(queries.SQL[name]).fetchdf()
    got = queries.QUERIES[name](spark, SMOKE)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(norm(r[c]) for c in cols) for r in got.collect()], key=key) == sorted(
        [tuple(norm(x) for x in r) for r in want[cols].itertuples(index=False)], key=key)


# ------------------------------------------------------------------ Jaccard join
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(d, len(sets[d]), find(d)) for d in ids}


def near_copies(seed, bases=12, copies=14):
    """Groups of copies with one to many changed words, at the edge of the threshold."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out, n = {}, 0
    for b in range(bases):
        base = list(rng.choice(vocabulary, int(rng.integers(4, 90))))
        for _ in range(copies):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
                words[at] = str(rng.choice(vocabulary))
            if rng.random() < 0.3:
                words += list(rng.choice(vocabulary, int(rng.integers(0, 12))))
            out[n] = " ".join(words)
            n += 1
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_brute_force(spark, seed):
    texts = near_copies(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {tuple(r) for r in jaccard_join.jaccard_components(df).select(
        "doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_components(texts)


def test_components_odd_rows(odd, empty):
    got = rows(jaccard_join.jaccard_components(odd))
    sets = [(d, len(shingles(t))) for d, t, *_ in ODD]
    comp = {2: 1, 7: 6}
    assert got == sorted([(d, n, comp.get(d, d)) for d, n in sets], key=lambda r: tuple((x is None, str(x)) for x in r))
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 8, 9, 10]


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard_join, "CHUNK", 500)
    texts = near_copies(7, bases=6)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in jaccard_join.jaccard_components(df).collect()} == brute_components(texts)


def test_word_sets_equal_brute_force(docs):
    t = docs.select("text").toArrow()["text"].combine_chunks()
    for r, s in shingle_sets(t):
        assert len(s) == len(shingles(t[r].as_py()))


def test_connected_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    with Scratch(spark) as scratch:
        got = {r.node: r.root for r in connected_components(
            spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


# ------------------------------------------------------------------ decontamination
def test_simhash_blocks_find_all_within_radius():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"], 12)) for _ in range(60)]
    index = decontaminate.ItemIndex(list(range(60)), texts, 5, 15)
    prints = rng.integers(0, 2**63, 500).astype(np.uint64)
    own = index.index[12][0]
    prints[:60] = own ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    found = set(zip(*(x.tolist() for x in index.candidates(12, prints))))
    assert found == {(i, j) for i in range(500) for j in range(60) if int(prints[i] ^ own[j]).bit_count() <= 15}


def test_edited_passages_are_found(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [" ".join(rng.choice(vocabulary, 50)) for _ in range(20)]
    texts = []
    for i, item in enumerate(items):
        words = item.split()
        words[i % 3] = "changed"  # at most three 5-grams of 46 differ
        around = rng.choice(vocabulary, 200)
        texts.append((i, " ".join([*around[:90], *words, *around[90:]]).replace(" v", ", V", 3)))
        texts.append((100 + i, " ".join(around)))
    found = decontaminate.benchmark_matches(
        spark.createDataFrame(texts, "doc_id long, text string"),
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), block_bytes=2000).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(20)}
    assert all(0.8 <= r.similarity < 1 for r in found)


def test_edits_at_the_threshold_are_found(spark):
    """Whatever the fingerprints' distance: a long word changed in a long passage, and random edits near 0.8."""
    rng = np.random.default_rng(11)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(n)]
    items, docs = [], []
    for i in range(400):
        own = words(59) if i else words(600)
        if not i:
            own[300] = "q" * 140
        items.append((i, " ".join(own)))
        edited = list(own)
        for at in rng.choice(59, rng.integers(1, 3), replace=False) if i else [300]:
            edited[at] = "".join(rng.choice(list("xyz"), len(edited[at])))
        docs.append((i, " ".join([*words(20), *edited, *words(20)])))

    def grams(text):
        w = text.split()
        return collections.Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))

    def best(item, doc):
        a, w, n = grams(item), doc.split(), len(item.split())
        out = 0
        for s in range(len(w) - n + 1) if n < 100 else [20]:
            b = grams(" ".join(w[s:s + n]))
            mass = lambda c: sum(sum(map(len, g)) * k for g, k in c.items())
            out = max(out, mass(a & b) / mass(a | b))
        return out

    want = {i: x for i, (_, t) in enumerate(items) if (x := best(t, docs[i][1])) >= 0.8}
    assert 0 in want and sum(x < 0.83 for x in want.values()) > 20
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.similarity) for r in decontaminate.benchmark_matches(df, bench).collect()}
    assert got == {i: (i, pytest.approx(x)) for i, x in want.items()}
    # the index decides: without a radius it finds only what has the very same fingerprint
    least = {r.doc_id for r in decontaminate.benchmark_matches(df, bench, radius=0).collect()}
    assert least <= set(want) and len(least) < 0.5 * len(want)


def test_recall_of_the_index_at_the_threshold():
    """Edits of weighted similarity 0.80 to 0.83, a third of them by one long word: at least 0.99 are within the radius."""
    rng = np.random.default_rng(5)
    near = []
    while len(near) < 2000:
        n = int(rng.integers(30, 120))
        grams, weights = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(10, 40, n)
        if len(near) % 3 == 0:
            weights[0] = rng.integers(50, 400)
        other, v = grams.copy(), weights.copy()
        for at in range(n):  # change shingles until the similarity is within the band
            both = int(weights[other == grams].sum())
            sim = both / (2 * int(weights.sum()) - both)
            if sim < 0.83:
                break
            other[at] = rng.integers(0, 2**63)
        if 0.8 <= sim < 0.83:
            a, b = (decontaminate.simhash(g, w, np.array([0]), n)[0] for g, w in ((grams, weights), (other, v)))
            near.append(int(np.bitwise_count(a ^ b)) <= decontaminate.RADIUS)
    assert np.mean(near) >= 0.99


def test_decontaminate_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame(
        [(1, "One, two three four five six seven eight nine ten!"), (2, None), (3, ""), (4, "too short"),
         (5, "word word word word word word")], "item_id long, text string")
    got = decontaminate.benchmark_matches(odd, bench)
    assert rows(got.select("doc_id", "item_id", "word_start")) == [
        (1, 1, 0), (2, 1, 0), (2, 1, 0), (9, 5, 0)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(odd, bench).where("doc_id is not null").collect()) == [
        3, 4, 5, 6, 7, 8, 10]
    mixed = spark.createDataFrame([(1, "clean text of its own"), (1, "one two three four five six seven eight nine ten"),
                                   (None, "one two three four five six seven eight nine ten"), (None, None)],
                                  "doc_id long, text string")
    assert rows(decontaminate.decontaminate(mixed, bench)) == [(1, "clean text of its own"), (None, None)]
    assert decontaminate.benchmark_matches(empty, bench).count() == 0
    assert decontaminate.benchmark_matches(odd, bench.where("item_id < 0")).count() == 0


# ------------------------------------------------------------------ line dedup
def test_line_dedup(spark, odd, empty, monkeypatch):
    pages = [(i, f"menu\nbody {i}\n\n menu ", "h" if i < 8 else None) for i in range(10)]
    df = spark.createDataFrame(pages, "doc_id long, text string, source string")
    for limit in (200_000, 0):  # broadcast, and joined by host
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_site_lines(df, ratio=0.5).collect()}
        assert got == {i: (f"body {i}\n" if s else t, 4, 2 if s else 0) for i, t, s in pages}
    got = line_dedup.drop_site_lines(odd)
    assert got.count() == len(ODD)
    assert {(r.doc_id, r.text) for r in got.where("source = 'b' or text is null").collect()} == {
        (d, t) for d, t, _, s in ODD if s == "b" or t is None}
    assert got.where("doc_id in (1, 2)").select("text").distinct().collect()[0][0] == ""  # three equal pages of six
    assert line_dedup.drop_site_lines(empty).count() == 0


# ------------------------------------------------------------------ fingerprints
def test_fingerprint_odd_rows(odd, empty):
    got = {r.doc_id: r for r in fingerprint.edit_comparison(odd).collect()}
    texts = {d: t or "" for d, t, *_ in ODD if d is not None}
    assert set(got) == set(texts)
    order = sorted(texts, reverse=True)
    for d, after in zip(order, order[1:] + order[:1]):
        n = len(texts[d])
        want = texts[d][:n - n // 3] + texts[after][:n // 3]
        assert (got[d].n_chars, got[d].edited) == (n, want)
    assert got[1].sketch == got[2].sketch and got[3].sketch == []
    assert fingerprint.edit_comparison(empty).count() == 0
    assert fingerprint.fingerprints(odd).count() == len(ODD)


def test_sketches_merge_and_estimate(spark):
    rng = np.random.default_rng(1)
    words = [f"t{i}" for i in rng.integers(0, 10**6, 6000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:1500]))], "a string, b string").select(
        fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprint.containment(F.col("b"), F.col("a")), fingerprint.likeness(F.col("a"), F.col("b")),
                  fingerprint.merged(F.col("a"), F.col("b")) == F.col("a")).first()
    assert r[0] == 1.0 and abs(r[1] - 0.25) < 0.05 and r[2]


def test_short_and_long_sketches(spark):
    """The sketch of two texts is that of both together, however short one is; a mark is not retained."""
    rng = np.random.default_rng(2)
    rows_ = []
    for i in range(100):
        words = [f"t{x}" for x in rng.integers(0, 10**6, 200)]
        rows_.append((" ".join(words[:7]) if i else "", " ".join(words)))
    f = fingerprint
    df = spark.createDataFrame(rows_, "a string, b string").select(
        f.sketch(F.col("a")).alias("a"), f.sketch(F.col("b")).alias("b"))
    for r in df.select("a", "b", f.merged(F.col("a"), F.col("b")).alias("m"), f.merged(F.col("a"), F.col("a")).alias("s"),
                       f.containment(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.m == r.b and r.s == r.a  # the short text is part of the long one
        low = [x for x in r.a if x < "200000000000"]
        assert r.c == (1.0 if low or not r.a else None)


# ------------------------------------------------------------------ language ID
def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op8_language_id(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id")
    n, right = held.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right / n > 0.97
    assert got.count() == 1000


def test_language_equals_plain_sets(spark):
    """Sets of trigrams instead of Bloom filters: the same language for nearly all, and scores that differ by the filters' error only."""
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()

    def trigrams(text):
        c = [x if x.isalpha() else " " for x in f" {text.lower()} "]
        return ["".join(c[i - 1:i + 2]) for i in range(1, len(c) - 1) if c[i] != " "]

    counts = collections.defaultdict(collections.Counter)
    for r in table:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(trigrams(r.text))
    kept = {x: {g for g, n in c.items() if n >= language_id.LEAST_SHARE * sum(c.values())} for x, c in counts.items()}
    want = {}
    for r in table:
        g = trigrams(r.text or "")
        shares = {x: sum(t in s for t in g) / len(g) for x, s in kept.items()} if g else {}
        best = max(sorted(shares), key=shares.get, default="und")
        want[r.doc_id] = (zlib.crc32(str(r.doc_id).encode()) % 4 == 2, best, shares)
    got = {r.doc_id: r for r in queries.op8_language_id(spark, d).collect()}
    assert got.keys() == want.keys() and all(got[k].held_out == w[0] for k, w in want.items())
    same = sum(got[k].lang_pred == w[1] for k, w in want.items())
    assert same >= 0.995 * len(want)
    for k, (_, best, shares) in want.items():
        assert (got[k].lang_pred == "und") == (best == "und")
        if shares:  # a language that isn't the best by sets must be as good as it but for the filters' error
            assert abs(got[k].score - shares[got[k].lang_pred]) < 0.05
            assert shares[got[k].lang_pred] > shares[best] - 0.05


def test_language_odd_rows(odd, empty, docs):
    filters = language_id.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, filters).collect()}
    assert got[3] == got[4] == got[5] == (language_id.UNKNOWN, 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predict(empty, filters).count() == 0
    none = language_id.train(empty)
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {language_id.UNKNOWN}
    kept = language_id.keep_known(odd, filters)
    assert kept.columns == odd.columns and kept.where("doc_id in (3, 4, 5)").count() == 0


def test_filters_have_no_false_negatives_and_correct_false_positives():
    rng = np.random.default_rng(0)
    grams = {f"l{i}": rng.integers(0, 2**62, 3000) for i in range(70)}  # two mask words
    f = language_id.MaskFilters(grams)
    for i, lang in enumerate(f.languages):
        g = grams[lang].astype(np.uint64)
        assert f.shares(g, np.array([len(g)]))[0, i] == pytest.approx(1.0)
    other = rng.integers(0, 2**62, 20000).astype(np.uint64)
    assert np.abs(f.shares(other, np.array([20000]))).max() < 0.02


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(50).select("id", language_id.held_out(F.col("id"))).collect()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got)


# ------------------------------------------------------------------ LM scores
def brute_scores(texts, targets, least, mix=0.7):
    words = {d: [w for w in re.split(r"[\x09-\x0D\x20-/:-@\[-`{-~]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] for d, t in texts.items()}
    n = sum(map(len, words.values()))
    count = collections.Counter(w for ws in words.values() for w in ws)
    voc = {w for w, c in count.items() if c >= least * n}
    models = []
    for chosen in (set(words), set(targets)):
        uni, ctx, big = collections.Counter(), collections.Counter(), collections.Counter()
        for d in chosen & set(words):
            ids = ["<s>"] + [w if w in voc else "<unk>" for w in words[d]]
            for v, w in zip(ids, ids[1:]):
                uni[w] += 1
                ctx[v] += 1
                big[v, w] += 1
        models.append((uni, ctx, big, sum(uni.values())))

    def p(model, v, w):
        uni, ctx, big, total = model
        low = (uni[w] + 1) / (total + len(voc) + 1)
        return mix * big[v, w] / ctx[v] + (1 - mix) * low if ctx[v] else low

    out = {}
    for d, ws in words.items():
        ids = ["<s>"] + [w if w in voc else "<unk>" for w in ws]
        loss = [math.log(p(models[0], v, w)) - math.log(p(models[1], v, w)) for v, w in zip(ids, ids[1:])]
        out[d] = (len(ws), sum(loss) / len(loss) if loss else None)
    return out


@pytest.mark.parametrize("common", [1e-6, 1e-3, 1.0])
@pytest.mark.parametrize("slot, chunk", [(4_000_000, 1_000_000), (5_000, 10_000)])
def test_scores_equal_brute_force(spark, docs, common, slot, chunk, monkeypatch):
    """With words and bigrams broadcast or dealt, in one slot and chunk or in many."""
    monkeypatch.setattr(lm_score, "SLOT_WORDS", slot)
    monkeypatch.setattr(lm_score, "CHUNK", chunk)
    df = docs.where("doc_id < 60")
    texts = {r.doc_id: r.text for r in df.collect()}
    targets = np.arange(0, 60, 4)
    want = brute_scores(texts, targets.tolist(), 2e-4)
    got = {r.doc_id: (r.n_words, r.score) for r in lm_score.cross_entropy_difference(
        df, targets, least_share=2e-4, common_share=common).collect()}
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d][0] == n and got[d][1] == pytest.approx(s, abs=1e-9)


@pytest.mark.parametrize("limit", [5_000_000, 3])
def test_all_target_documents_are_counted(spark, docs, monkeypatch, limit):
    """Broadcast or joined, every labelled document counts, once, also if labelled twice or without doc_id."""
    df = docs.where("doc_id < 60")
    texts = {r.doc_id: r.text for r in df.collect()}
    labels = spark.createDataFrame(
        [(i, int(i is None or i % 4 == 0)) for i in [*range(60), 8, None]], "doc_id long, quality int")
    want = brute_scores(texts, list(range(0, 60, 4)), 0)
    monkeypatch.setattr(lm_score, "BROADCAST_TARGETS", limit)
    targets = lm_score.target_ids(labels)
    assert targets.count() == 15
    got = {r.doc_id: (r.n_words, r.score) for r in lm_score.cross_entropy_difference(df, targets, least_share=0).collect()}
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d][0] == n and got[d][1] == pytest.approx(s, abs=1e-9)


@pytest.mark.parametrize("common", [1e-6, 1e-3, 1.0])
def test_rare_words_keep_their_own_loss(spark, common):
    """Over 1e6 words, a word seen once is no unknown word, whether counts are broadcast or joined."""
    texts = {0: "the rare gem", 1: "the odd gem", 2: "the " * 1_100_000, 3: "the the gem a rare odd"}
    want = brute_scores(texts, [0], 0)
    got = {r.doc_id: (r.n_words, r.score) for r in lm_score.cross_entropy_difference(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"), np.array([0]),
        common_share=common).collect()}
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d][0] == n and got[d][1] == pytest.approx(s, abs=1e-9)
    assert got[0][1] < got[1][1]


def test_packed_blocks_and_keys():
    rng = np.random.default_rng(5)
    x, y = rng.integers(-(1 << 63), (1 << 63) - 1, 1000), rng.random(1000)
    a, b = lm_score._unpack(lm_score._pack(x, y), 2)
    assert (a == x).all() and (b.view(np.float64) == y).all()
    for size in (2, 3, 70_000, 1_000_002):
        keys = lm_score._Keys(size, 4)
        v, w = rng.integers(0, size, (2, 1000))
        key = np.sort(keys.of(v, w))
        slots = list(lm_score._by_slot(key, keys.bits, 4))
        assert sum(hi - lo for _, lo, hi in slots) == 1000 and all(0 <= s < 16 for s, _, _ in slots)
        got = keys.ranks(key.view(np.int64))
        assert sorted(zip(*(z.tolist() for z in got))) == sorted(zip(v.tolist(), w.tolist()))


def test_scores_odd_rows(odd, empty):
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(odd, np.array([1, 9])).collect()}
    assert got[3].score is None and got[4].n_words == 0 and got[2].n_words == 20
    assert got[9].score < got[6].score
    assert lm_score.cross_entropy_difference(empty, np.array([1])).count() == 0
    assert lm_score.cross_entropy_difference(odd, np.zeros(0, np.int64)).count() == 11


def test_fingerprint_hash_is_not_seeded():
    assert xxhash.xxh64("a", seed=42).intdigest()  # Spark's xxhash64 is this function; line keys rest on it
