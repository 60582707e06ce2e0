"""Cross-entropy difference scores of documents (Moore-Lewis) with matched bigram models.

The target model is counted on the target documents, the background model on all
documents.  Both are interpolated bigram models over one vocabulary: every
word of the corpus, seen once or often, so V grows with it.  (A caller may
pool the words under a share ``least_share`` of all words as one unknown word.)

    p(w | v) = mix * c(v, w) / c(v) + (1 - mix) * (c(w) + 1) / (N + V + 1)

with only the second part where v was never seen.  A document's score is the
mean over its words of log p_background - log p_target; the lower, the
more it is like the target.

All documents are counted, and no count is pruned.  Common words and bigrams (of a share of
at least ``common_share``, so at most 1 / common_share each) are broadcast, which is what keeps a
hot one from being a hot key.  Every other bigram goes, with the document it is in, to a slot: one
of two common words by its key, one with a rare word by the hash of that word.  A slot
sees all of its bigrams, and all of its rare words, so it counts them and sends the losses, summed by document, to the slots of the
documents (at most one sum for each bigram of a document); no bigram table is written or joined.  The few bigrams of two rare words are joined to the
word counts.  A chunk's bigrams for a slot travel as one block: sorted keys as differences, in
byte planes, compressed.  Slots grow in number with the corpus, so that each holds about ``SLOT_WORDS`` words.
Common words are named by their rank, others by a 63-bit hash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kwhlens.llm.words import slices, text_buffers, tidy, word_hashes
from kwhlens.session import Scratch

COMMON_SHARE = 1e-6
MIX = 0.7
#: Target ids (8 bytes each) broadcast at most; more are joined to the documents.
BROADCAST_TARGETS = 5_000_000
#: Words counted at once in a task.
CHUNK = 1_000_000
#: Words of the corpus to a slot of bigrams, which is held whole.
SLOT_WORDS = 4_000_000
#: Set in the keys of words that are named by a hash.
_HASHED = np.uint64(1 << 63)
#: Odd; products with it, of as many bits as a key has, spread the keys and can be undone.
_SPREAD = 0x9E3779B97F4A7C15
_RANKS, _RARE_WORD, _RARE_CONTEXT, _OWN = range(4)


def target_ids(labels: DataFrame, where: str = "quality = 1", id_col: str = "doc_id") -> DataFrame:
    """(doc_id) of the target documents: the labelled rows, each doc_id once."""
    return labels.where(where).select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()


def _is_target(ids: pa.Array, targets: np.ndarray) -> np.ndarray:
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    own = ids.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(targets, own), max(0, len(targets) - 1))
    return known & (targets[at] == own) if len(targets) else np.zeros(len(own), bool)


def _flagged(base: DataFrame, targets: np.ndarray | DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray | None]:
    """``base`` and the sorted target ids if they are few; else ``base`` with the column ``target``, and None."""
    if isinstance(targets, DataFrame):
        ids = scratch.table(targets.select(F.col("doc_id").cast("long").alias("target_id")).distinct(), "targets")
        if ids.count() > BROADCAST_TARGETS:
            joined = base.join(ids, F.col("doc_id") == F.col("target_id"), "left")
            return joined.select("doc_id", "text", F.col("target_id").isNotNull().alias("target")), None
        targets = ids.where("target_id is not null").toArrow()["target_id"].to_numpy()
    return base, np.sort(targets)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, words per row) of slices of a batch."""
    raw, off = text_buffers(batch.column(1))
    for i, j in slices(off):
        words, first, _ = word_hashes(raw, off[i : j + 1], punct=True)
        yield i, j, words, np.diff(first)


def _summed(key: np.ndarray, weights: list) -> tuple[np.ndarray, list]:
    """Distinct keys and the sums of the weights by key."""
    distinct, back = np.unique(key, return_inverse=True)
    return distinct, [np.bincount(back, weights=x, minlength=len(distinct)).astype(np.int64) for x in weights]


def _chunk_map(shared, held_of, made):
    """The rows that ``made`` makes of the columns that ``held_of`` makes of slices, for a chunk of words at a time.

    ``held_of`` gets a slice's words, the words of each row, and the rows' ids, missing ids, and target flags.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets, names = shared.value
        kept, held = [], 0
        for batch in batches:
            flag = (_is_target(batch.column(0), targets) if targets is not None
                    else batch.column(2).to_numpy(zero_copy_only=False))
            ids = batch.column(0).fill_null(0).to_numpy()
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, j, words, n in _words(batch):
                kept.append(held_of(words, n, (ids[i:j], none[i:j], flag[i:j]), names))
                held += len(words) + j - i
                if held >= CHUNK:
                    yield made([np.concatenate(x) for x in zip(*kept)])
                    kept, held = [], 0
        if held:
            yield made([np.concatenate(x) for x in zip(*kept)])

    return tidy(run)


def _hashed(words: np.ndarray) -> np.ndarray:
    return (words | _HASHED).view(np.int64)


def _word_rows(words: np.ndarray, n: np.ndarray, rows: tuple, names) -> tuple:
    """Key, count, and whether it is a context, of each word; the beginnings of documents are contexts with key 0."""
    some, flag = n > 0, rows[2]
    context = np.ones(len(words), bool)
    context[np.cumsum(n)[some] - 1] = False
    begun = int(some.sum())
    return (np.concatenate([_hashed(words), np.zeros(begun, np.int64)]), np.repeat([True, False], [len(words), begun]),
            np.concatenate([context, np.ones(begun, bool)]), np.concatenate([np.repeat(flag, n), flag[some]]))


def _word_counts(columns: list) -> pa.RecordBatch:
    key, word, context, flag = columns
    key, sums = _summed(key, [word, word & flag, context, context & flag])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *sums)], names=["key", "c", "t", "vc", "vt"])


def _named(words: np.ndarray, names: tuple) -> np.ndarray:
    """Ranks of the common words, hashes (below 0) of the others; with a cut, words beyond it are unknown."""
    common, others = names
    key = _hashed(words)
    size = len(common)
    out = key
    if others is not None:
        at = np.minimum(np.searchsorted(others, key), max(0, len(others) - 1))
        out = np.where(others[at] == key, key, size) if len(others) else np.full(len(key), size)
    if size:
        at = np.minimum(np.searchsorted(common, key), size - 1)
        out = np.where(common[at] == key, at, out)
    return out


def _bigrams(words: np.ndarray, n: np.ndarray, names: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Context and word of each bigram; the context of a document's first word is its beginning."""
    w = _named(words, names)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    begin = np.cumsum(n) - n
    v[begin[n > 0]] = len(names[0]) + 1
    return v, w


@functools.cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte values, of one length, as compressed byte planes."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T for x in columns]
    return _codec()[0].compress(np.concatenate(planes).tobytes())


def _unpack(block: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(_codec()[1].decompress(block), np.uint8).reshape(8 * n, -1)
    return [np.ascontiguousarray(planes[8 * k : 8 * k + 8].T).view(np.int64).reshape(-1) for k in range(n)]


def _differences(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def _by_slot(sorted_keys: np.ndarray, bits: int, log_slots: int) -> Iterator[tuple[int, int, int]]:
    """(slot, first, end) of the keys of ``bits`` bits that begin with the same ``log_slots`` bits."""
    edges = np.searchsorted(sorted_keys >> np.uint64(bits - log_slots), np.arange((1 << log_slots) + 1, dtype=np.uint64))
    for slot in np.flatnonzero(np.diff(edges)).tolist():
        yield slot, int(edges[slot]), int(edges[slot + 1])


class _Keys:
    """Keys of bigrams of ranks below ``size``: both in one number, spread over ``bits`` bits."""

    def __init__(self, size: int, log_slots: int):
        self.size, self.log_slots = size, log_slots
        self.bits = max(log_slots, (size * size - 1).bit_length(), 1)
        self.mask = np.uint64((1 << self.bits) - 1)

    def of(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return ((v * self.size + w).view(np.uint64) * np.uint64(_SPREAD)) & self.mask

    def ranks(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        back = np.uint64(pow(_SPREAD, -1, 1 << self.bits))
        return np.divmod(((key.astype(np.uint64) * back) & self.mask).view(np.int64), self.size)


_BLOCKS = pa.schema([("slot", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])


def _rank_rows(keys: _Keys):
    def rows(words: np.ndarray, n: np.ndarray, rows: tuple, names: tuple) -> tuple:
        v, w = _bigrams(words, n, names)
        ranked = (v >= 0) & (w >= 0)
        return keys.of(v[ranked], w[ranked]), np.repeat(rows[2], n)[ranked]

    return rows


def _rank_blocks(keys: _Keys):
    """Blocks of the distinct bigrams of a chunk and their counts."""

    def blocks(columns: list) -> pa.RecordBatch:
        key, sums = _summed(columns[0], [np.ones(len(columns[0]), bool), columns[1]])
        return pa.RecordBatch.from_pylist([
            {"slot": slot, "kind": _RANKS, "block": _pack(_differences(key[a:b]), *(x[a:b] for x in sums))}
            for slot, a, b in _by_slot(key, keys.bits, keys.log_slots)], _BLOCKS)

    return blocks


def _common_map(least: float):
    """(key, c, t) of the bigrams of a slot that are seen at least so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(x, 3) for batch in batches for x in batch.column(2).to_pylist()]
        if held:
            delta, c, t = zip(*held)
            key, sums = _summed(np.concatenate([np.cumsum(x) for x in delta]), [np.concatenate(c), np.concatenate(t)])
            often = sums[0] >= least
            yield pa.RecordBatch.from_arrays([pa.array(x[often]) for x in (key, *sums)], names=["key", "c", "t"])

    return tidy(run)


def _entry_rows(keys: _Keys):
    """Bigrams that aren't common, with their documents; per document its words and the loss of its common bigrams.

    A bigram of two rare words counts for both words, but has no document here (its word is the rank ``size``).
    """

    def entries(words: np.ndarray, n: np.ndarray, rows: tuple, names: tuple) -> tuple:
        names, common, losses = names
        ids, none, flag = rows
        v, w = _bigrams(words, n, names)
        row = np.repeat(np.arange(len(n)), n)
        tag = (flag * 2 + none).astype(np.int64)
        v_rare, w_rare = v < 0, w < 0
        at_ranks = np.flatnonzero(~(v_rare | w_rare))
        key = keys.of(v[at_ranks], w[at_ranks])
        at = np.minimum(np.searchsorted(common, key), max(0, len(common) - 1))
        hit = common[at] == key if len(common) else np.zeros(len(key), bool)
        known = np.bincount(row[at_ranks[hit]], weights=losses[at[hit]], minlength=len(n)).astype(np.float64)
        at_ranks = at_ranks[~hit]
        out = [key[~hit], ids[row[at_ranks]], tag[row[at_ranks]]]
        for rare, mine, other in ((w_rare, w, v), (v_rare, v, w)):
            at = np.flatnonzero(rare)
            both = other[at] < 0
            out += [mine[at].view(np.uint64), np.where(both, keys.size, other[at]), np.where(both, 0, ids[row[at]]),
                    np.where(both, tag[row[at]] & 2, tag[row[at]])]
        return (*out, ids, none.astype(np.int64), n.astype(np.int64), known)

    return entries


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a row begins a run of equal rows, and the begins' places."""
    head = np.ones(len(columns[0]), bool)
    if len(head):
        head[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return head, np.flatnonzero(head)


def _entry_blocks(keys: _Keys):
    """Blocks by slot and kind; equal entries of a document are one, with the times it has them."""

    def blocks(columns: list) -> pa.RecordBatch:
        out = []
        for kind, lo, hi in ((_RANKS, 0, 3), (_RARE_WORD, 3, 7), (_RARE_CONTEXT, 7, 11)):
            key, *rest = columns[lo:hi]
            order = np.argsort(key, kind="stable") if kind == _RANKS else np.lexsort((rest[0], key))
            key, rest = key[order], [x[order] for x in rest]
            _, first = _runs(key, *rest)
            times = np.diff(np.append(first, len(key)))
            key, rest = key[first], [x[first] for x in rest]
            rest[-1] = rest[-1] + 4 * times
            if kind == _RANKS:
                slots = _by_slot(key, keys.bits, keys.log_slots)
            else:  # the highest bit is the mark of a hash
                slots = _by_slot(key & ~_HASHED, 63, keys.log_slots)
            out += [{"slot": slot, "kind": kind, "block": _pack(_differences(key[a:b]), *(x[a:b] for x in rest))}
                    for slot, a, b in slots]
        ids = columns[11]
        if len(ids):  # to any slot, the same each time
            slot = int(ids[0].view(np.uint64) * np.uint64(_SPREAD) >> np.uint64(32)) % (1 << keys.log_slots)
            out.append({"slot": slot, "kind": _OWN, "block": _pack(*columns[11:])})
        return pa.RecordBatch.from_pylist(out, _BLOCKS)

    return blocks


def _log_p(c2: np.ndarray, c1: np.ndarray, w: np.ndarray, total: int, size: int, mix: float) -> np.ndarray:
    low = (w + 1) / (total + size + 1)
    return np.log(np.where(c1 > 0, mix * c2 / np.maximum(c1, 1) + (1 - mix) * low, low))


def _slot_map(shared, keys: _Keys, total: tuple[int, int], size: int, mix: float):
    """Sums by document from all blocks of a slot, as blocks by the document's slot.

    A loss is log p_background - log p_target.
    """

    def loss(c2, t2, c1, t1, c, t) -> np.ndarray:
        return _log_p(c2, c1, c, total[0], size, mix) - _log_p(t2, t1, t, total[1], size, mix)

    def of_ranks(ranked: np.ndarray, key, ids, tag) -> tuple:
        distinct, at = np.unique(key, return_inverse=True)
        times = tag >> 2
        c2, t2 = (np.bincount(at, weights=x, minlength=len(distinct)) for x in (times, times * (tag >> 1 & 1)))
        v, w = keys.ranks(distinct)
        return ids, tag & 1, times * loss(c2, t2, ranked[2][v], ranked[3][v], ranked[0][w], ranked[1][w])[at]

    def of_rare(ranked: np.ndarray, kind: int, key, other, ids, tag) -> tuple:
        order = np.lexsort((other, key))
        key, other, ids, tag = (x[order] for x in (key, other, ids, tag))
        times = tag >> 2
        word, pair = np.cumsum(_runs(key)[0]) - 1, np.cumsum(_runs(key, other)[0]) - 1
        (c1, t1), (c2, t2) = ([np.bincount(at, weights=x)[at] for x in (times, times * (tag >> 1 & 1))] for at in (word, pair))
        mine = other < keys.size  # without the pairs of two rare words
        at, ids, tag, times, c1, t1, c2, t2 = (x[mine] for x in (other, ids, tag, times, c1, t1, c2, t2))
        if kind == _RARE_WORD:
            found = loss(c2, t2, ranked[2][at], ranked[3][at], c1, t1)
        else:
            found = loss(c2, t2, c1, t1, ranked[0][at], ranked[1][at])
        return ids, tag & 1, times * found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = shared.value
        held = {_RANKS: [], _RARE_WORD: [], _RARE_CONTEXT: [], _OWN: []}
        for batch in batches:
            for kind, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                columns = _unpack(block, 3 if kind == _RANKS else 4)
                if kind != _OWN:
                    columns[0] = np.cumsum(columns[0])
                held[kind].append(columns)
        parts = []
        for kind, blocks in held.items():
            if not blocks:
                continue
            columns = [np.concatenate(x) for x in zip(*blocks)]
            blocks.clear()
            if kind == _OWN:
                ids, none, n, known = columns
                parts.append((ids, none, n, known.view(np.float64)))
            else:
                ids, none, part = of_ranks(ranked, *columns) if kind == _RANKS else of_rare(ranked, kind, *columns)
                parts.append((ids, none, np.zeros(len(ids), np.int64), part))
        if parts:
            ids, none, *sums = _by_document(*(np.concatenate(x) for x in zip(*parts)))
            slot = (ids.view(np.uint64) * np.uint64(_SPREAD) >> np.uint64(32)).astype(np.int64) & ((1 << keys.log_slots) - 1)
            order = np.argsort(slot, kind="stable")
            edges = np.searchsorted(slot[order], np.arange((1 << keys.log_slots) + 1))
            yield pa.RecordBatch.from_pylist([
                {"slot": s, "kind": _OWN, "block": _pack(*(x[order[edges[s] : edges[s + 1]]] for x in (ids, none, *sums)))}
                for s in np.flatnonzero(np.diff(edges)).tolist()], _BLOCKS)

    return tidy(run)


def _by_document(ids: np.ndarray, none: np.ndarray, n: np.ndarray, part: np.ndarray) -> tuple:
    """Ids, whether they are missing, and the sums of words and losses, by id."""
    order = np.lexsort((ids, none))
    ids, none = ids[order], none[order]
    _, first = _runs(ids, none)
    sums = [np.add.reduceat(x[order], first) if len(first) else x for x in (n, part)]
    return ids[first], none[first], *sums


def _document_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, total) of the documents of a slot, from what all slots of bigrams have for them."""
    held = [_unpack(x, 4) for batch in batches for x in batch.column(2).to_pylist()]
    if held:
        ids, none, n, part = (np.concatenate(x) for x in zip(*held))
        ids, none, n, part = _by_document(ids, none, n, part.view(np.float64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=none.astype(bool)), pa.array(n), pa.array(part)], names=["doc_id", "n_words", "total"])


def _rare_rows(words: np.ndarray, n: np.ndarray, rows: tuple, names: tuple) -> tuple:
    v, w = _bigrams(words, n, names)
    at = np.flatnonzero((v < 0) & (w < 0))
    row = np.repeat(np.arange(len(n)), n)[at]
    return (v[at], w[at], *(x[row] for x in rows))


def _rare_batch(columns: list) -> pa.RecordBatch:
    v, w, ids, none, flag = columns
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, mask=none), pa.array(v), pa.array(w), pa.array(flag.astype(np.int64))], names=["doc_id", "v", "w", "t"])


def _rare_losses(rows: DataFrame, rest: DataFrame, total: tuple[int, int], size: int, mix: float) -> DataFrame:
    """(doc_id, n_words, total) of the bigrams of two rare words: counted by pair, joined to the counts of both words."""
    pair = Window.partitionBy("w", "v")
    counted = rows.select("doc_id", "v", "w", F.count(F.lit(1)).over(pair).alias("c2"), F.sum("t").over(pair).alias("t2"))
    for at, (c, t) in (("w", ("c", "t")), ("v", ("vc", "vt"))):
        own = rest.select(F.col("key").alias(at), F.col(c).alias(f"{at}_c"), F.col(t).alias(f"{at}_t"))
        counted = counted.join(own, at)

    def log_p(kind: str, n: int) -> Column:
        low = (F.col(f"w_{kind}") + 1) / F.lit(float(n + size + 1))
        seen = F.col(f"v_{kind}")
        return F.log(F.when(seen > 0, F.lit(mix) * F.col(f"{kind}2") / seen + F.lit(1 - mix) * low).otherwise(low))

    return counted.groupBy("doc_id").agg(F.sum(log_p("c", total[0]) - log_p("t", total[1])).alias("total")).select(
        "doc_id", F.lit(0).cast("long").alias("n_words"), "total")


def cross_entropy_difference(docs: DataFrame, targets: np.ndarray | DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             least_share: float = 0.0, common_share: float = COMMON_SHARE,
                             mix: float = MIX) -> DataFrame:
    """(doc_id, n_words, score) per doc_id; the lower the score, the more like the target documents.

    ``targets`` are the doc_ids of the target documents, as an array or as a table (doc_id); all are counted.
    Words are lower-cased (A-Z) and end at white space and ASCII punctuation.
    Rows that share a doc_id (or have none) are one document: their losses are
    pooled, each row beginning anew.  A text without words, null or not, has the score null.  Without target
    documents every score is that of a uniform target model.  Other columns are not
    read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    sc = spark.sparkContext
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    flagged, ids = _flagged(base, targets, scratch)

    def chunks(names, held_of, made, columns: str) -> DataFrame:
        return flagged.mapInArrow(_chunk_map(sc.broadcast((ids, names)), held_of, made), columns)

    # the vocabulary: a table; only its common words pass through the driver
    counts = ("c", "t", "vc", "vt")
    words = scratch.table(
        chunks(None, _word_rows, _word_counts, "key long, c long, t long, vc long, vt long").groupBy("key").agg(
            *[F.sum(x).alias(x) for x in counts]), "unigrams")
    every = words.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in counts]).first()
    n, t = every[:2]
    known = words.where((F.col("key") < 0) & (F.col("c") >= F.lit(least_share * n)))
    size, *inside = known.agg(
        F.count(F.lit(1)), *[F.coalesce(F.sum(x), F.lit(0)) for x in counts]).first()
    begin = words.where("key = 0").first()
    frequent = F.col("c") >= F.lit(common_share * n)
    top = known.where(frequent).toArrow()
    order = np.argsort(top["key"].to_numpy())
    rest = known.where(~frequent)
    # under a cut the other known words, at most 1 / least_share, are broadcast as well
    others = np.sort(rest.select("key").toArrow()["key"].to_numpy()) if least_share * n > 1 else None
    names = top["key"].to_numpy()[order], others
    ranked = np.zeros((4, len(order) + 2), np.int64)
    for k, x in enumerate(counts):
        ranked[k, :-2] = top[x].to_numpy()[order]
        ranked[k, -1] = begin[x] if begin else 0
        ranked[k, -2] = every[k] - inside[k] - ranked[k, -1]

    log_slots = max(0, -(-n // SLOT_WORDS) - 1).bit_length()
    keys = _Keys(len(order) + 2, log_slots)
    blocks = "slot int, kind int, block binary"

    def dealt(names, held_of, made) -> DataFrame:
        return chunks(names, held_of, made, blocks).repartitionById(1 << log_slots, F.col("slot"))

    top = dealt(names, _rank_rows(keys), _rank_blocks(keys)).mapInArrow(
        _common_map(common_share * n), "key long, c long, t long").toArrow()
    order = np.argsort(top["key"].to_numpy())
    common, c2, t2 = (top[x].to_numpy()[order] for x in ("key", "c", "t"))
    v, w = keys.ranks(common)
    losses = (_log_p(c2, ranked[2][v], ranked[0][w], n, size, mix) - _log_p(t2, ranked[3][v], ranked[1][w], t, size, mix))
    by_slot = dealt((names, common.astype(np.uint64), losses), _entry_rows(keys), _entry_blocks(keys)).mapInArrow(
        _slot_map(sc.broadcast(ranked), keys, (n, t), size, mix), blocks)
    by_document = by_slot.repartitionById(1 << log_slots, F.col("slot")).mapInArrow(
        tidy(_document_map), "doc_id long, n_words long, total double")
    both = chunks(names, _rare_rows, _rare_batch, "doc_id long, v long, w long, t long")
    return by_document.union(_rare_losses(both, rest, (n, t), size, mix)).groupBy("doc_id").agg(
        F.sum("n_words").alias("n_words"), F.sum("total").alias("total")
    ).select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("total") / F.col("n_words")).alias("score"))
