"""N-gram Jaccard self-join of documents and its connected components.

Documents are sets of word 5-grams; two link when 100 * |A n B| >= percent *
|A u B|.  The join is exact:

1. *Screening.*  Under any fixed order of the shingles, the first
   ``n - ceil(t n) + l`` shingles of two linked sets share at least ``l``.  The
   shingles are taken in hash order with ``l = n // 10``; a document with fewer
   shared prefix shingles than every possible partner demands links to nothing.
   Each task resolves repeats within its own documents first and ships one
   entry per shingle, so that no shingle, however common, makes a hot bucket.
2. *Classes.*  Of the remaining documents, equal sets become one class, named by its
   smallest doc_id.
3. *Rare-first prefix join.*  Exact document frequencies of the classes'
   shingles give the order (rarest first; shingles of one class alone come
   first and need no rows).  The longer set probes with its
   ``n - ceil(t n) + 1`` rarest shingles, the shorter is indexed under its
   ``n - ceil(2 t n / (1 + t)) + 1`` rarest; the length and positional filters are
   part of the join condition.  A suffix filter goes before each exact
   verification: the sets are parted at fixed hash values, and the smaller counts of
   the parts bound the overlap (one level of parts instead of a recursion).
4. *Two rounds.*  First every class is compared with the smallest class of each of its
   posting lists; the links found give preliminary components.  Then all
   candidate pairs across components are verified.  Pairs inside one component
   cannot change it, so a group of m near copies costs about m verifications,
   not m * m, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kwhlens.llm.components import connected_components
from kwhlens.llm.words import mix, parts, shingle_sets, tidy
from kwhlens.session import Scratch

PERCENT = 80
SHINGLE = 5
#: Shingle entries that a screening task holds at once (16 bytes each).
CHUNK = 500_000
#: Ids broadcast at most (8 bytes each); beyond it the text is joined to them by a shuffle.
BROADCAST_IDS = 1_000_000
#: Hash ranges of the suffix filter.
RANGES = 64


def _need(n: int, percent: int) -> int:
    """Smallest overlap of a set of n with any linked set."""
    return -(-n * percent // 100)


_CHUNK = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("known", pa.binary()),
                    ("ids", pa.binary()), ("sizes", pa.binary()), ("shared", pa.binary())])
_COUNTS = pa.schema([("slot", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("shared", pa.binary())])


def _dealt(values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, positions) of the values that each of n slots gets."""
    slot = (mix(values.view(np.uint64)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    edge = np.flatnonzero(np.diff(slot[order], prepend=-1))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
        yield int(slot[order[a]]), order[a:b]


def _flush(ids: list, sizes: list, keys: list, buckets: int) -> pa.RecordBatch:
    """One row per bucket: its entries, and the sizes and repeats within this chunk of the documents dealt to it."""
    counts = np.array([len(k) for k in keys], dtype=np.int64)
    key = np.concatenate(keys)
    doc = np.repeat(np.arange(len(ids)), counts)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    last = np.ones(len(key), bool)
    last[:-1] = head[1:]
    alone, known = head & last, head & ~last
    local = np.bincount(doc[~alone], minlength=len(ids)).astype(np.int64)
    own, n = np.array(ids, np.int64), np.array(sizes, np.int64)
    rows: dict[int, dict] = {}
    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
    low = key.astype(np.uint32)
    for b in range(buckets):
        at = by[edges[b] : edges[b + 1]]
        if len(at):
            one, more = at[alone[at]], at[known[at]]
            one = one[np.argsort(doc[one], kind="stable")]  # ids in order compress well
            rows[b] = {"bucket": b, "keys": low[one].tobytes(), "docs": own[doc[one]].tobytes(),
                       "known": low[more].tobytes()}
    for b, at in _dealt(own, buckets):
        rows.setdefault(b, {"bucket": b}).update(
            ids=own[at].tobytes(), sizes=n[at].tobytes(), shared=local[at].tobytes())
    return pa.RecordBatch.from_pylist(list(rows.values()), _CHUNK)


def _screen_map(percent: int, shingle: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, keys, held = [], [], [], 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for r, s in shingle_sets(batch.column(1), shingle):
                n = len(s)
                k = s[: min(n, n - _need(n, percent) + max(1, n // 10))]
                ids.append(own[r])
                sizes.append(n)
                keys.append(k.copy())
                held += len(k) + 1
                if held >= CHUNK:
                    yield _flush(ids, sizes, keys, buckets)
                    ids, sizes, keys, held = [], [], [], 0
        if ids:
            yield _flush(ids, sizes, keys, buckets)

    return run


def _screen_reduce(slots: int):
    """Counts of shared entries by document, from all entries of some buckets, packed by the document's slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, known, ids, sizes, shared = [], [], [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["keys"] is not None:
                    top = np.uint64(r["bucket"] << 32)
                    keys.append(np.frombuffer(r["keys"], np.uint32).astype(np.uint64) | top)
                    docs.append(np.frombuffer(r["docs"], np.int64))
                    known.append(np.frombuffer(r["known"], np.uint32).astype(np.uint64) | top)
                if r["ids"] is not None:
                    ids.append(np.frombuffer(r["ids"], np.int64))
                    sizes.append(np.frombuffer(r["sizes"], np.int64))
                    shared.append(np.frombuffer(r["shared"], np.int64))
        if keys:
            key, doc, more = np.concatenate(keys), np.concatenate(docs), np.unique(np.concatenate(known))
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            same = key[1:] == key[:-1]
            hit = np.zeros(len(key), bool)
            hit[1:] |= same
            hit[:-1] |= same
            if len(more) and len(key):
                at = np.minimum(np.searchsorted(more, key), len(more) - 1)
                hit |= more[at] == key
            who, count = np.unique(doc[hit], return_counts=True)
            ids.append(who)
            sizes.append(np.full(len(who), -1))
            shared.append(count)
        if ids:
            own, n, c = np.concatenate(ids), np.concatenate(sizes), np.concatenate(shared)
            yield pa.RecordBatch.from_pylist([
                {"slot": s, "ids": own[at].tobytes(), "sizes": n[at].tobytes(), "shared": c[at].tobytes()}
                for s, at in _dealt(own, slots)], _COUNTS)

    return run


def _screen_sum(percent: int):
    """(doc_id, n, active) per document, from all counts of some slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.frombuffer(x, np.int64) for x in batch.column(i).to_pylist()] for batch in batches for i in (1, 2, 3)]
        if not got:
            return
        ids, n, shared = (np.concatenate([x for part in got[i::3] for x in part]) for i in range(3))
        who, at = np.unique(ids, return_inverse=True)
        total = np.bincount(at, weights=shared)
        least = np.full(len(who), np.iinfo(np.int64).max)  # smallest set under an id that isn't empty
        np.minimum.at(least, at[n > 0], n[n > 0])
        need = np.maximum(1, -(-np.minimum(least, 1 << 40) * percent // 100) // 10)
        active = total >= need
        rows = np.flatnonzero(n >= 0)
        for i in range(0, len(rows), 100_000):
            r = rows[i : i + 100_000]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids[r]), "n": pa.array(n[r]), "active": pa.array(active[at[r]])})

    return run


def _class_map(shingle: int, with_set: bool):
    """(doc_id, n, class hash) per document, with its sorted shingle hashes if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, cls, sets, held = [], [], [], [], 0
            own = batch.column(0).to_pylist()

            def out():
                cols = {"doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()),
                        "cls": pa.array(cls, pa.int64())}
                if with_set:
                    cols["shingles"] = pa.array(sets, pa.binary())
                return pa.RecordBatch.from_pydict(cols)

            for r, s in shingle_sets(batch.column(1), shingle):
                x = mix(np.array([np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]) + np.uint64(len(s)))
                ids.append(own[r])
                n.append(len(s))
                cls.append(int(x.view(np.int64)[0]))
                if with_set:
                    sets.append(s.tobytes())
                    held += s.nbytes
                if held > 8 << 20:
                    yield out()
                    ids, n, cls, sets, held = [], [], [], [], 0
            yield out()

    return run


def _explode_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        for node, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
            h = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(h), "node": pa.array(np.full(len(h), node)), "n": pa.array(np.full(len(h), n))})


def _df_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle counts, combined within the task's chunks."""
    held, size = [], 0

    def out():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"h": pa.array(h), "c": pa.array(c.astype(np.int64))})

    for batch in parts(batches):
        for raw in batch.column(0).to_pylist():
            held.append(np.frombuffer(raw, np.int64))
            size += len(held[-1])
            if size >= CHUNK:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def _verify_map(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            u, v, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i, (x, y) in enumerate(zip(sa, sb)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))  # least overlap of a link
                if len(x) and len(y) and min(len(x), len(y)) >= need:
                    # suffix filter: the overlap is at most the sum of the smaller counts over fixed hash ranges
                    cut = np.uint64(64 - RANGES.bit_length() + 1)
                    a = np.bincount((x >> cut).astype(np.int64), minlength=RANGES)
                    b = np.bincount((y >> cut).astype(np.int64), minlength=RANGES)
                    if int(np.minimum(a, b).sum()) >= need:
                        o = len(np.intersect1d(x, y, assume_unique=True))
                        if o >= need:
                            keep.append(i)
            yield pa.RecordBatch.from_pydict({
                "u": pa.array([u[i] for i in keep], pa.int64()), "v": pa.array([v[i] for i in keep], pa.int64())})

    return run


def _with_ids(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids``; the ids are broadcast only if few."""
    return docs.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return (pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
            .mapInArrow(tidy(_verify_map(percent)), "u long, v long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links, itself included.

    Null text, or text without words: no shingles, linked with nothing.  Texts
    with fewer words than a shingle are one shingle.  A row without doc_id links with
    nothing and has a null component.  Repeated rows are copies of each other
    and each gives a row; different texts under one doc_id are linked by
    that id.  Other columns of ``docs`` are not read.  An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), base.rdd.getNumPartitions())

    # 1. screening
    named = base.where("doc_id is not null")
    schema = "bucket long, keys binary, docs binary, known binary, ids binary, sizes binary, shared binary"
    screened = scratch.table(
        named.mapInArrow(tidy(_screen_map(percent, shingle, 2 * dealt)), schema).repartition(dealt, "bucket")
        .mapInArrow(tidy(_screen_reduce(2 * dealt)), "slot long, ids binary, sizes binary, shared binary")
        .repartition(dealt, "slot").mapInArrow(tidy(_screen_sum(percent)), "doc_id long, n long, active boolean"), "screened")
    active = scratch.table(screened.where("active").select("doc_id").distinct(), "active")
    n_active = active.count()

    # 2. classes of equal sets
    alike = scratch.table(_with_ids(named, active, n_active).mapInArrow(
        tidy(_class_map(shingle, False)), "doc_id long, n long, cls long").where("n > 0"), "alike")
    least = alike.groupBy("cls").agg(F.min("doc_id").alias("node"))
    members = scratch.table(alike.join(least, "cls").select("doc_id", "n", "cls", "node"), "members")
    nodes = members.where("doc_id = node").select("doc_id").distinct()
    sets = scratch.table(
        _with_ids(named, nodes, n_active).mapInArrow(
            tidy(_class_map(shingle, True)), "doc_id long, n long, cls long, shingles binary")
        .where("n > 0").select(F.col("doc_id").alias("node"), "n", "shingles"), "sets")

    # 3. rare-first order and postings
    freq = (sets.select("shingles").mapInArrow(tidy(_df_map), "h long, c long")
            .groupBy("h").agg(F.sum("c").alias("df")).where("df > 1"))
    rows = sets.select("node", "n", "shingles").mapInArrow(tidy(_explode_map), "h long, node long, n long").join(freq, "h")
    common = Window.partitionBy("node", "n")
    ranked = rows.select(
        "h", "node", "n",
        # shingles of this class alone come first, then by rising frequency
        (F.col("n") - F.count(F.lit(1)).over(common)
         + F.row_number().over(common.orderBy("df", "h"))).alias("pos"))
    posts = scratch.table(ranked.where(f"pos <= n - (n * {percent} + 99) div 100 + 1"), "posts")
    short = f"pos <= n - (n * {2 * percent} + {99 + percent}) div {100 + percent} + 1"

    # 4. first round: each class with the smallest class of its posting lists
    hubs = posts.groupBy("h").agg(F.min(F.struct("node", "n", "pos")).alias("hub"), F.max("node").alias("top"))
    reach = f"{100 + percent} * least({{a}}.n - {{a}}.pos + 1, {{b}}.n - {{b}}.pos + 1) >= {percent} * ({{a}}.n + {{b}}.n)"
    star = (posts.alias("p").join(hubs.where("top > hub.node").alias("q"), "h")
            .where("p.node <> q.hub.node and " + reach.format(a="p", b="q.hub"))
            .select(F.col("q.hub.node").alias("u"), F.col("p.node").alias("v")).distinct())
    links = scratch.table(_verify(star, sets, percent), "links1")
    first = scratch.table(connected_components(links, scratch, "a"), "first")

    # second round: all candidates across the preliminary components
    placed = scratch.table(
        posts.join(first, posts.node == first.node, "left")
        .select("h", posts.node, "n", "pos", F.coalesce("root", posts.node).alias("comp")), "placed")
    heavy = (placed.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("h")
             .agg(F.max(F.struct("k", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"))
             .where("comps > 1").select("h", F.col("most.comp").alias("main")))
    mixed = scratch.table(placed.join(heavy, "h").withColumn("light", F.col("comp") != F.col("main")), "mixed")

    def across(probe: DataFrame, index: DataFrame) -> DataFrame:
        p, q = probe.alias("p"), index.where(short).alias("q")
        on = ("p.h = q.h and p.comp <> q.comp and (p.n > q.n or (p.n = q.n and p.node < q.node)) and "
              + reach.format(a="p", b="q"))
        return p.join(q, F.expr(on)).select(
            F.least("p.node", "q.node").alias("u"), F.greatest("p.node", "q.node").alias("v"))

    light, main = mixed.where("light"), mixed.where("not light")
    pairs = across(light, mixed).union(across(main, light)).distinct()
    more = scratch.table(links.union(_verify(pairs, sets, percent)).distinct(), "links2")
    comps = scratch.table(connected_components(more, scratch, "b"), "components")

    linked = members.join(comps, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("component_id"))
    lone = screened.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    known = members.select("doc_id").distinct()
    others = lone.join(known, "doc_id", "left_anti")
    # an empty text under a doc_id that has another text too
    empty = lone.where("n_shingles = 0").join(known, "doc_id", "left_semi")
    nameless = base.where("doc_id is null").mapInArrow(
        tidy(_class_map(shingle, False)), "doc_id long, n long, cls long").selectExpr("doc_id", "n", "doc_id")
    return linked.union(others).union(empty).union(nameless)


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id.  Rows without doc_id stay."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    ids = jaccard_components(docs, id_col, text_col, **options).where("component_id <> doc_id").select("doc_id").distinct()
    return without_ids(docs, scratch.table(ids, "dropped"), id_col)


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``ids(doc_id)``; the ids are broadcast only if few."""
    gone = ids.select(F.col("doc_id").alias("gone"))
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("long") == gone["gone"], "left_anti")
