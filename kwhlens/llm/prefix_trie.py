"""The trie of conversation prefixes, by adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is 16 bytes: the first half of the SHA-256 of its role and text (their
numbers need no table and no join, so a frequent turn is no hot key).  A conversation's key is
its turns' ids in a row.  Distinct keys are dealt over tasks by ranges of their sorted order, so
a hot first turn or a long common beginning is split like any other range, and equal conversations are one
key.  Each task puts a bounded run of keys (a block) into a radix tree and walks it
upwards; only byte depths that are multiples of 16 are nodes of the trie.

Every figure of a node is a sum (or minimum) over the blocks that hold keys under it:

* members, and members x code points of all nodes under it, add up as they are;
* code points of a node, child links and leaves count once, so where a block's first key
  shares its first L turns with the key before it, the block takes back what the earlier block has
  counted for these L nodes.

So only nodes on the border of two blocks (at most a path each) are summed by a shuffle; all
others are complete in their block.  A border node's key is a hash of its path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwhlens.llm.radix import RadixTree
from kwhlens.llm.words import tidy
from kwhlens.session import Scratch

#: Bytes of a turn id.
WIDTH = 16
#: Distinct conversations, and bytes of their keys, in a radix tree at most (one key at least).
BLOCK_KEYS, BLOCK_BYTES = 10_000, 4 << 20
#: Conversation ids put together in one row before they are hashed.
PACKED = 4096
#: A conversation takes its first turns from the one of this distance, and at most this many.
FAMILY, HEADS = 100, 6

_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """Hex of the 16-byte id of a turn; the role's length keeps role and text apart."""
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH)


def conversations_of(table: DataFrame) -> DataFrame:
    """(conv_id, ids, lens): each conversation's turn ids (hex) and their texts' code points in order.

    The order is turn (null first); equal turn numbers go by role and turn id.
    Null roles and texts are empty; rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = table.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_digest(role, text).alias("id"),
                 F.char_length(text).alias("len")).alias("row"))
    # sort_array puts null turns first
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
        "conv_id", F.col("rows.id").alias("ids"), F.col("rows.len").alias("lens"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, ids, lens) with the first h turns taken from conversation ``c - c % 100``, h = crc32(c) % 6.

    A first turn is taken by fewer than 200 conversations, so the join has no hot key; only the
    first five turns of every hundredth conversation are its right side.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = convs.select("conv_id", "ids", "lens", base.alias("base_id"),
                       (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base_id"), *[F.slice(c, 1, HEADS - 1).alias(f"base_{c}") for c in ("ids", "lens")])
    joined = own.join(heads, "base_id", "left")

    def spliced(c: str) -> Column:
        kind = "array<string>" if c == "ids" else "array<int>"
        head = F.slice(F.coalesce(F.col(f"base_{c}"), F.array().cast(kind)), F.lit(1), F.col("h"))
        return F.concat(head, F.slice(F.col(c), F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0))))

    return joined.select("conv_id", spliced("ids").alias("ids"), spliced("lens").alias("lens"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (class, conv_id) as rows of up to PACKED ids of a class each."""
    kept: list = []
    now, ids = None, []
    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now or len(ids) == PACKED:
                if ids:
                    kept.append((now, ids[0], len(ids), ",".join(map(str, ids))))
                now, ids = key, []
            ids.append(conv)
        if len(kept) > 1000:
            yield _table(kept, _PACKED_SCHEMA)
            kept = []
    if ids:
        kept.append((now, ids[0], len(ids), ",".join(map(str, ids))))
    if kept:
        yield _table(kept, _PACKED_SCHEMA)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by (class, first id) as one row per class: smallest id, members, hash of all ids."""
    kept: list = []
    now, first, n, sha = None, None, 0, None
    for batch in batches:
        for key, low, count, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if now is not None:
                    kept.append((first, n, sha.hexdigest()))
                now, first, n, sha = key, low, 0, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
            n += count
        if len(kept) > 10_000:
            yield _table(kept, _ENDS_SCHEMA)
            kept = []
    if now is not None:
        kept.append((first, n, sha.hexdigest()))
    if kept:
        yield _table(kept, _ENDS_SCHEMA)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


_PACKED_SCHEMA = pa.schema([("class", pa.string()), ("low", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
_ENDS_SCHEMA = pa.schema([("first_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])

#: What a block returns.  state: 0 complete; 1 complete, but its parent is on a border; 2 a share of a
#: border node; 3 the first and last key of a partition.
_NODE_SCHEMA = pa.schema([
    ("state", pa.int32()), ("block", pa.string()), ("path", pa.binary()), ("parent", pa.binary()),
    ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ("part", pa.int32()), ("first_key", pa.binary()), ("first_lens", pa.list_(pa.int32())), ("last_key", pa.binary())])
_NODE_DDL = ("state int, block string, path binary, parent binary, depth long, conv_id long, parent_conv_id long, "
             "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, part int, first_key binary, "
             "first_lens array<int>, last_key binary")


def path_hashes(key: bytes, depth: int) -> list[bytes]:
    """Names of the nodes on the path of ``key``, from the root down to ``depth``."""
    out = [hashlib.sha256(b"").digest()]
    for at in range(min(depth, len(key) // WIDTH)):
        out.append(hashlib.sha256(out[-1] + key[at * WIDTH : (at + 1) * WIDTH]).digest())
    return out


def shared_turns(a: bytes, b: bytes) -> int:
    """How many first turns two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // WIDTH


def border_rows(before: bytes, key: bytes, lens: list[int], block: str) -> Iterator[tuple]:
    """What is counted twice for the nodes that ``key`` shares with the key before it, as shares to add."""
    shared = shared_turns(before, key)
    ended = shared == len(before) // WIDTH  # the key before is no leaf, as this one goes on
    again, paths = 0, path_hashes(key, shared)
    for d in range(shared, -1, -1):
        again += lens[d - 1] if d else 0
        yield (2, block, paths[d], paths[d - 1] if d else None, d, None, None, 0,
               -1 if d < shared else 0, -1 if ended else 0, again, None, None, None, None, None)


class _Block:
    """The trie nodes of a run of sorted distinct keys."""

    def __init__(self, name: str, keys: int):
        self.name, self.keys = name, keys
        self.rows: list[tuple] = []  # key, lens, smallest conv_id, members, hash of the members
        self.bytes = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.bytes += len(row[0])

    def full(self) -> bool:
        return len(self.rows) >= self.keys or self.bytes >= BLOCK_BYTES

    def nodes(self, left: int, right: int) -> Iterator[tuple]:
        """Rows of all nodes; those of the first key down to depth ``left``, and of the last to ``right``, are border nodes."""
        tree = RadixTree()
        for i, row in enumerate(self.rows):
            tree.insert(row[0], i)
        # for each key: how far its path is a border, and the names of the nodes on both borders
        first, last = self.rows[0][0], self.rows[-1][0]
        on_left = [min(left, shared_turns(first, row[0])) for row in self.rows]
        on_right = [min(right, shared_turns(last, row[0])) for row in self.rows]
        left_paths, right_paths = path_hashes(first, left), path_hashes(last, right)
        under: dict[int, tuple] = {}  # by node: members, smallest, nodes just below, leaves, saved, a key, waiting rows
        for node, depth, number, below in tree.upwards():
            n, low, heads, leaves, saved, some, waiting = 0, None, 0, 0, 0, None, []
            for child in below:
                c = under.pop(child)
                n, heads, leaves, saved, some = n + c[0], heads + c[2], leaves + c[3], saved + c[4], c[5]
                low = c[1] if low is None else min(low, c[1])
                waiting += c[6]
            ends = _EMPTY
            if node.value is not None:
                key, _, smallest, members, ends = self.rows[node.value]
                n, some = n + members, node.value
                low = smallest if low is None else min(low, smallest)
            lens = self.rows[some][1]
            top = depth - len(node.prefix)  # nodes lie at the turn-aligned depths from here to ``depth``
            for at in range(depth // WIDTH, -(-top // WIDTH) - 1, -1):
                if at * WIDTH != depth:
                    ends = _EMPTY
                if at:
                    saved += (n - 1) * lens[at - 1]
                leaves = leaves if heads else 1
                mine = left_paths[at] if at <= on_left[some] else right_paths[at] if at <= on_right[some] else None
                border = mine is not None
                for child in waiting:  # children wait for their parent's smallest member
                    if child[0] == 2:
                        yield (2, self.name, child[1], mine, *child[2:])
                    elif border:
                        yield (1, self.name, None, mine, *child[2:])
                    else:
                        yield (0, self.name, None, None, *child[2:4], low, *child[5:])
                row = (2 if border else 0, mine, at, low, None, n, heads, leaves, saved,
                       ends if ends != _EMPTY else None, None, None, None, None)
                waiting, heads = [row], 1
            under[number] = (n, low, heads, leaves, saved, some, waiting)
        for row in waiting:
            yield (row[0], self.name, row[1], None, *row[2:])


def _trie_map(block_keys: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a partition of sorted distinct keys, block by block."""
    part = TaskContext.get().partitionId()
    held: list[tuple] = []
    block = before = first = None
    count, left = 0, 1 << 62

    def flush(rows) -> Iterator[pa.RecordBatch]:
        for row in rows:
            held.append(row)
            if len(held) >= 10_000:
                yield _table(held, _NODE_SCHEMA)
                held.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if block is None:
                first, block = row, _Block(f"{part}-0", block_keys)
            elif block.full():
                shared = shared_turns(before, row[0])
                yield from flush(block.nodes(left, shared))
                count, left = count + 1, shared
                block = _Block(f"{part}-{count}", block_keys)
                yield from flush(border_rows(before, row[0], row[1], block.name))
            block.add(row)
            before = row[0]
    if block is not None:
        yield from flush(block.nodes(left, 1 << 62))
        yield from flush([(3, *[None] * 11, part, first[0], first[1], before)])
    if held:
        yield _table(held, _NODE_SCHEMA)


def _border_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border rows between partitions, from the partitions' first and last keys in order."""
    before = None
    for batch in batches:
        for part, key, lens, last in zip(*(c.to_pylist() for c in batch.columns)):
            if before is not None:
                yield _table(list(border_rows(before, key, lens, f"{part}-0")), _NODE_SCHEMA)
            before = last


def prefix_trie(table: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """The trie of the rebuilt conversations of ``table`` (conv_id, turn, role, text), a row per node.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): the smallest member, the number of turns, the parent's smallest member (null for the root),
    members, children, childless nodes under it (itself included), code points that sharing saves under
    it, and the SHA-256 of the ids of the members that end here, in ascending order.

    Turns go by number (null first), equal numbers by role and turn id; repeated rows
    are turns of their own.  Null roles and texts are empty.  Rows without conv_id belong to no
    conversation.  Other columns are not read.  An empty table gives no node, not even a root.

    A conversation is held whole as ids (24 bytes a turn), its texts are not.  The ids of
    conversations that end in one node are hashed as a stream in one task: the digest is
    sequential, but its memory is constant and it reads packed ids.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "trie")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    convs = scratch.table(conversations_of(table), "convs")
    whole = scratch.table(rebuilt(convs).select(
        "conv_id", F.unhex(F.array_join("ids", "")).alias("key"), "lens"), "rebuilt")
    packed = (whole.select(F.sha2("key", 256).alias("class"), "conv_id")
              .repartitionByRange(n, "class", "conv_id").sortWithinPartitions("class", "conv_id")
              .mapInArrow(_pack, "class string, low long, n long, ids string"))
    ends = (packed.repartition(n, "class").sortWithinPartitions("class", "low")
            .mapInArrow(_ends, "first_id long, n long, ends string"))
    keys = scratch.table(ends.join(whole, F.col("first_id") == F.col("conv_id")).select(
        "key", "lens", "first_id", "n", "ends"), "keys")
    nodes = scratch.table(keys.repartitionByRange(n, "key").sortWithinPartitions("key")
                          .mapInArrow(tidy(partial(_trie_map, block_keys)), _NODE_DDL), "nodes", partition_by="state")
    for name in ("convs", "rebuilt", "keys"):
        scratch.drop(name)
    # one row per partition, streamed in order
    edges = (nodes.where("state = 3").select("part", "first_key", "first_lens", "last_key").repartition(1)
             .sortWithinPartitions("part").mapInArrow(_border_map, _NODE_DDL))
    shares = nodes.where("state = 2").unionByName(edges)
    border = scratch.table(shares.groupBy("path").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends").alias("ends")), "border")
    of_border = border.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # a block's border nodes with their smallest members: joined by block, so the root is no hot key
    seen = nodes.where("state = 2").select("block", F.col("path").alias("parent")).distinct().join(of_border, "parent")
    figures = ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    inner = nodes.where("state = 0").select("conv_id", "depth", "parent_conv_id", *figures)
    edge = nodes.where("state = 1").drop("parent_conv_id").join(seen, ["block", "parent"], "left").select(
        *inner.columns)
    rest = border.join(of_border, "parent", "left").select(*inner.columns)
    return inner.unionByName(edge).unionByName(rest).select(
        "conv_id", "depth", "parent_conv_id", *figures[:-1], F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))
