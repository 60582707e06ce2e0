"""Benchmark decontamination by SimHash windows of the items' sizes.

Words are lower-cased (A-Z) and end at white space and ASCII punctuation.  A
window or item is the multiset of its word 5-grams, each weighted by the bytes
of its words.  For an item of L words every window of L words of a document is
compared (a shorter document is one window):

* the window's weighted SimHash (64 bits) is looked up in a multi-index of the
  items of that size: with ``radius + 1`` blocks, two fingerprints within
  ``radius`` bits agree on at least one block, so none within it is missed;
* of these candidates, those are kept whose shingles shared with the item weigh enough for ``least``
  (the shared weight bounds the similarity from above, so this loses nothing);
* the rest is verified by the exact weighted Jaccard similarity of the two
  multisets.

Shingles enter the fingerprint with the square root of their weight: then the cosine of two
windows is their shared weight by the mean of their weights, so similarity 0.8 is an angle of 27 degrees and 15 % of
the bits (9.7 of 64) differ on average, however the weight is spread.  By the binomial, more than
``RADIUS`` = 24 bits differ in 3e-6 of such pairs; measured on edits of similarity 0.80 to 0.83, with long changed
words among them, all of 2,000 are found (the test asks for 0.99).

Windows that hold no shingle of any item have similarity 0 with all items and
need no fingerprint; a bitmap of the items' shingles finds the others.

The benchmark is the stated query set.  It is sent to the executors in blocks
of about ``block_bytes`` of text, one pass over the documents for each, so
that what is broadcast is bounded whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwhlens.llm.jaccard_join import without_ids
from kwhlens.llm.words import shingle_hashes, slices, text_buffers, tidy, word_hashes
from kwhlens.session import Scratch

SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which the fingerprints of window and item may differ to be found by the multi-index.
RADIUS = 24
#: Benchmark text sent to the executors at once.
BLOCK_BYTES = 32 << 20
#: Windows fingerprinted at once (512 bytes each).
WINDOWS = 8192
#: (shingle, item) pairs of one document looked at at once.
PAIRS = 1 << 20
_MAP_BITS = 22


def simhash(grams: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows grams[s : s + size], by the roots of the weights; ``starts`` ascend."""
    weights = np.rint(1024 * np.sqrt(weights)).astype(np.int64)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(starts, a + WINDOWS))
        b = int(starts[j - 1]) + size
        bits = np.unpackbits(grams[a:b].view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
        signed = (2 * bits - 1) * weights[a:b, None]
        total = np.zeros((b - a + 1, 64), np.int64)
        np.cumsum(signed, axis=0, out=total[1:])
        at = starts[i:j] - a
        out[i:j] = np.packbits(total[at + size] - total[at] > 0, axis=1).view(np.uint64)[:, 0]
        i = j
    return out


def similarity(g: np.ndarray, w: np.ndarray, h: np.ndarray, v: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    a, ia, ca = np.unique(g, return_index=True, return_counts=True)
    b, ib, cb = np.unique(h, return_index=True, return_counts=True)
    _, xa, xb = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int((np.minimum(ca[xa], cb[xb]) * w[ia[xa]]).sum())
    union = int(w.sum()) + int(v.sum()) - both
    return both / union if union else 0.0


def _grams(words: np.ndarray, spans: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and weights (bytes of the shingle's words)."""
    grams = shingle_hashes(words, k)
    size = np.concatenate([[0], np.cumsum(spans[:, 1] - spans[:, 0])])
    return grams, size[k : k + len(grams)] - size[: len(grams)]


class ItemIndex:
    """Items by size, with fingerprints, Hamming blocks and the bitmap of their shingles."""

    def __init__(self, ids: list, texts: list, shingle: int, radius: int):
        self.k, self.radius = shingle, radius
        raw, off = text_buffers(pa.array(texts, pa.string()))
        self.by_size: dict[int, list] = {}
        every, owner, slot, self.totals = [], [], [], []
        for i in range(len(ids)):
            words, _, spans = word_hashes(raw, off[i : i + 2], punct=True, spans=True)
            if len(words) < shingle:
                continue
            g, w = _grams(words, spans, shingle)
            self.by_size.setdefault(len(words), []).append((ids[i], g, w))
            every.append(g)
            owner.append(np.full(len(g), len(words)))
            slot.append(np.full(len(g), len(self.totals)))
            self.totals.append((len(words), len(self.by_size[len(words)]) - 1, int(w.sum())))
        self.totals = np.array(self.totals, np.int64).reshape(-1, 3)
        every = np.concatenate(every) if every else np.zeros(0, np.uint64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        pair = np.lexsort((owner, every))
        self.grams, self.sizes = every[pair], owner[pair]
        slot = np.concatenate(slot) if slot else np.zeros(0, np.int64)
        # each distinct shingle of each item once
        pair = np.lexsort((slot, every))
        g, o = every[pair], slot[pair]
        once = np.ones(len(g), bool)
        once[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
        self.shared, self.slots = g[once], o[once]
        self.bitmap = np.zeros(1 << _MAP_BITS, bool)
        self.bitmap[(every >> np.uint64(64 - _MAP_BITS)).astype(np.int64)] = True
        cuts = [round(b * 64 / (radius + 1)) for b in range(radius + 2)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
        self.index = {}
        for size, items in self.by_size.items():
            prints = np.concatenate([simhash(g, w, np.array([0]), len(g)) for _, g, w in items])
            tables = []
            for shift, mask in self.blocks:
                value = (prints >> shift) & mask
                order = np.argsort(value, kind="stable")
                tables.append((value[order], order))
            self.index[size] = (prints, tables)

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of one size within the radius."""
        own, tables = self.index[size]
        found = []
        for (shift, mask), (values, order) in zip(self.blocks, tables):
            v = (prints >> shift) & mask
            lo, hi = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            n = hi - lo
            window = np.repeat(np.arange(len(v)), n)
            item = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            found.append(window * len(own) + item)
        pairs = np.unique(np.concatenate(found))
        window, item = pairs // len(own), pairs % len(own)
        near = np.bitwise_count(prints[window] ^ own[item]) <= self.radius
        return window[near], item[near]

    def heavy(self, grams: np.ndarray, weights: np.ndarray, hits: np.ndarray, least: float) -> dict[int, list]:
        """By size: (item, its hits) of the items whose shingles weigh enough in the document for ``least``."""
        lo = np.searchsorted(self.shared, grams[hits], "left")
        n = np.searchsorted(self.shared, grams[hits], "right") - lo
        ends = np.cumsum(n)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            a = 0
            while a < len(hits):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + PAIRS, "right")))
                m = n[a:b]
                yield (np.repeat(hits[a:b], m),
                       self.slots[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[a:b], m)])
                a = b

        mass = np.zeros(len(self.totals))
        for p, item in pairs():
            mass += np.bincount(item, weights=weights[p], minlength=len(mass))
        enough = mass >= least * self.totals[:, 2] * (1 - 1e-9)
        out: dict[int, list] = {}
        if enough.any():
            found = [(p[enough[item]], item[enough[item]]) for p, item in pairs()]
            p, item = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((p, item))
            p, item = p[order], item[order]
            cut = np.flatnonzero(item[1:] != item[:-1]) + 1
            for own, where in zip(np.split(item, cut), np.split(p, cut)):
                size, i, _ = self.totals[own[0]].tolist()
                out.setdefault(size, []).append((i, where))
        return out

    def search(self, words: np.ndarray, spans: np.ndarray, hits: np.ndarray, least: float) -> Iterator[tuple]:
        """(item id, first word, words, similarity) of each item's best window in one document."""
        grams, weights = _grams(words, spans, self.k)
        lo = np.searchsorted(self.grams, grams[hits], "left")
        hi = np.searchsorted(self.grams, grams[hits], "right")
        heavy = self.heavy(grams, weights, hits, least)
        weight = np.concatenate([[0], np.cumsum(weights)])
        at: dict[int, list] = {}
        for p, a, b in zip(hits.tolist(), lo.tolist(), hi.tolist()):
            for size in set(self.sizes[a:b].tolist()):
                at.setdefault(size, []).append(p)
        for size, where in at.items():
            width = min(size, len(words))
            span = width - self.k + 1
            p = np.array(where)
            starts = np.unique((p[:, None] - np.arange(span)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts <= len(words) - width)]
            if size not in heavy:
                continue  # no item of the size has enough weight in the whole document
            window, item = self.candidates(size, simhash(grams, weights, starts, span))
            near = window * len(self.by_size[size]) + item
            own = weight[starts + span] - weight[starts]
            enough = []
            for i, where in heavy[size]:
                mass = np.concatenate([[0], np.cumsum(weights[where])])
                both = mass[np.searchsorted(where, starts + span)] - mass[np.searchsorted(where, starts)]
                total = int(self.by_size[size][i][2].sum())
                both = np.minimum(both, total)
                enough.append(np.flatnonzero(both / (own + total - both) >= least * (1 - 1e-9)) * len(self.by_size[size]) + i)
            window, item = np.divmod(np.intersect1d(near, np.concatenate(enough)), len(self.by_size[size]))
            best: dict[int, tuple] = {}
            for s, i in zip(starts[window].tolist(), item.tolist()):
                _, g, w = self.by_size[size][i]
                x = similarity(grams[s : s + span], weights[s : s + span], g, w)
                if x >= least and (i not in best or x > best[i][0]):
                    best[i] = (x, s)
            for i, (x, s) in best.items():
                yield self.by_size[size][i][0], s, width, x


def _search_map(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or ItemIndex(*shared.value)
            ids = batch.column(0).to_pylist()
            raw, off = text_buffers(batch.column(1))
            rows = []
            for i, j in slices(off):
                words, first, spans = word_hashes(raw, off[i : j + 1], punct=True, spans=True)
                grams = shingle_hashes(words, index.k)
                hit = np.flatnonzero(index.bitmap[(grams >> np.uint64(64 - _MAP_BITS)).astype(np.int64)])
                at = np.minimum(np.searchsorted(index.grams, grams[hit]), max(0, len(index.grams) - 1))
                hit = hit[index.grams[at] == grams[hit]] if len(index.grams) else hit[:0]
                owner = np.searchsorted(first, hit, side="right") - 1
                hit = hit[hit + index.k <= first[owner + 1]]
                owner = np.searchsorted(first, hit, side="right") - 1
                for d in np.unique(owner).tolist():
                    a, b = int(first[d]), int(first[d + 1])
                    for found in index.search(words[a:b], spans[a:b], hit[owner == d] - a, least):
                        rows.append((ids[i + d], *found))
            cols = list(zip(*rows)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(cols[0], pa.int64()), "item_id": pa.array(cols[1], pa.int64()),
                "word_start": pa.array(cols[2], pa.int64()), "n_words": pa.array(cols[3], pa.int64()),
                "similarity": pa.array(cols[4], pa.float64())})

    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", least: float = SIMILARITY,
                      radius: int = RADIUS, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, word_start, n_words, similarity): each item found in a document, at its best window.

    Of equally similar windows the first counts.  Null texts and texts of fewer
    than ``shingle`` words match nothing; items of fewer words or without text
    are not searched.  Repeated rows and items each give their rows.  A row without
    doc_id keeps a null doc_id in the result.  Other columns are not read.
    Empty tables give an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(
        F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")
    ).where("text is not null")
    volume = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(volume // block_bytes) + 1
    results = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in part], [r[1] for r in part], shingle, radius))
        results.append(base.mapInArrow(
            tidy(_search_map(shared, least)),
            "doc_id long, item_id long, word_start long, n_words long, similarity double"))
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    A row is named by a 64-bit hash of its text, so rows without doc_id or with a repeated one are
    judged each by its own text; rows of a null text stay.
    """
    text = options.pop("text_col", "text")
    name = F.xxhash64(F.col(text).cast("string"))
    found = benchmark_matches(docs.select(name.alias("_name"), F.col(text).alias("_text")), benchmark,
                              id_col="_name", text_col="_text", **options).select("doc_id")
    ids = Scratch(docs.sparkSession, "contaminated").table(found.distinct(), "ids")
    own = "_text_name" + "_" * max(len(c) for c in docs.columns)
    return without_ids(docs.withColumn(own, name), ids, own).drop(own)
