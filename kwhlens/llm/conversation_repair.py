"""Cheapest repair of conversation structure, worked out once per shared suffix.

A conversation's rows become one character each (its signature): what may be kept of a
system, user, assistant or other row (``s u a o``, capitals for truncated rows), and ``x`` for
blank and duplicate rows.  Signatures are minimised from the end: an automaton's node is a
suffix, registered by its first symbol and the node of the rest, so all conversations
that end alike share nodes.  Each node holds, for each state of the grammar
``(s?(ua)+)?``, the least cost to go and the first edit of the best audit suffix (the rest is in the
node that this edit leads to).

Conversations are dealt by ranges of (reversed signature, conv_id): suffixes that belong together
meet in one task, a frequent signature is split over several, and nothing is joined by signature.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwhlens.llm.prefix_trie import turn_digest
from kwhlens.llm.words import parts, tidy
from kwhlens.session import Scratch

#: Nodes of a task's automaton at most; beyond it the register starts anew (nodes are worked out again).
MOST_NODES = 500_000
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

#: Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 may end.
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The role that an inserted or reroled row has in each state, and the state after it.
_GIVEN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_NEVER = 1 << 60


class SuffixAutomaton:
    """Shared suffixes of signatures with the cost to go and the best edit per grammar state."""

    def __init__(self, most: int = MOST_NODES):
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.register: dict[tuple[str, int], int] = {}
        self.next = [-1]
        # node 0, the end: (cost, edit, state after it) for each state
        self.best = [self._inserted([(0, "", 0), (_NEVER, "", 1), (_NEVER, "", 2), (0, "", 3)])]

    @staticmethod
    def _inserted(own: list[tuple]) -> list[tuple]:
        """The better of an edit and an insertion; from 2 and 3 at most one insertion pays, from 0 and 1 two."""
        out = list(own)
        for q, after in ((2, own[3]), (3, own[2])):
            out[q] = min(own[q], (INSERT + after[0], "I", _GIVEN[q][1]), key=lambda x: x[:2])
        for q in (0, 1):
            out[q] = min(own[q], (INSERT + out[2][0], "I", 2), key=lambda x: x[:2])
        return out

    def _add(self, symbol: str, after: int) -> int:
        best = self.best[after]
        own = []
        role, extra = symbol.lower(), TRUNCATED * symbol.isupper()
        for q in range(4):
            options = [(DELETE + best[q][0], "D", q)]
            if symbol != "x":
                if (to := _KEPT.get((q, role))) is not None:
                    options.append((extra + best[to][0], "K", to))
                to = _GIVEN[q][1]
                options.append((REROLE + extra + best[to][0], "R", to))
            own.append(min(options))
        self.next.append(after)
        self.best.append(self._inserted(own))
        return len(self.next) - 1

    def node(self, signature: str) -> int:
        """The node of a whole signature; only suffixes that are new are worked out."""
        if len(self.next) > self.most:
            self._reset()
        at = 0
        for symbol in reversed(signature):
            key = (symbol, at)
            at = self.register.get(key, -1)
            if at < 0:
                at = self.register[key] = self._add(*key)
        return at

    def plan(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits, of equal ones the least audit."""
        at, q, audit = self.node(signature), 0, []
        cost = self.best[at][0][0]
        while True:
            _, edit, to = self.best[at][q]
            if not edit:
                return cost, "".join(audit)
            audit.append(edit)
            if edit != "I":
                at = self.next[at]
            q = to


def damaged(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the faults that crc32(``conv_id:turn``) % 20 plants; nulls are one space.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's.
    Null ids and turns are one space in the hashed text only.  A dropped row is returned with ``text`` null,
    so that its conversation is still there.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    name = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = table.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"),
                        (F.crc32(name.cast("binary")) % 20).cast("int").alias("fault"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 0, F.lit(None).cast("string")).when(F.col("fault") == 1, "")
        .when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(True), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("x")).drop("x")


def _last_fault(text: Column) -> Column:
    """blank, truncated or fine by the last character that is no white space."""
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return F.when(last == "", "blank").when(last.isin(".", "!", "?"), "fine").otherwise("truncated")


_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_SIGNED_DDL = "conv_id long, signature string, " + ", ".join(f"{c} long" for c in _STATS)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, signature, counts) of conversations with their rows in order."""
    for batch in parts(batches, 2000):
        out: list[tuple] = []
        for conv, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen, signature, before = set(), [], None
            count = dict.fromkeys(_STATS, 0)
            turns = set()
            for r in rows:
                first = r["role"][:1]
                if before is not None and before + first not in ("su", "ua", "au"):
                    count["illegal"] += 1
                before = first
                if r["turn"] is not None:
                    turns.add(r["turn"])
                fault = r["fault"]
                if fault != "blank" and r["id"] in seen:
                    fault = "duplicate"
                seen.add(r["id"])
                symbol = first if first in ("s", "u", "a") else "o"
                if fault == "fine":
                    signature.append(symbol)
                else:
                    count[fault] += 1
                    signature.append(symbol.upper() if fault == "truncated" else "x")
            if turns:
                count["gaps"] = max(turns) - min(turns) + 1 - len(turns)
            out.append((conv, "".join(signature), *count.values()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.string() if k == 1 else pa.int64()) for k, x in enumerate(zip(*out))],
            names=["conv_id", "signature", *_STATS])


def _planned(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = SuffixAutomaton(most)
    before, plan = None, None
    for batch in batches:
        plans = []
        for signature in batch.column(1).to_pylist():
            if signature != before:
                before, plan = signature, automaton.plan(signature)
            plans.append(plan)
        cost, audit = zip(*plans) if plans else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.columns[2:], pa.array(cost, pa.int64()), pa.array(audit, pa.string())],
            names=["conv_id", *_STATS, "cost", "audit"])


def repair_plans(rows: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``rows``.

    ``rows`` (conv_id, turn, role, text) are in order of turn (null first), equal turns by role and the
    hash of role and text; a row with text null isn't there, but names its conversation.  Null roles are
    empty.  Rows without conv_id are one conversation.  A row's first fault counts: blank, duplicate (role and text
    seen earlier), truncated.  ``audit`` has a letter per edit in order: Keep, Rerole, Delete, Insert.  A
    conversation is held whole as hashes and roles, without its texts.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role = F.coalesce(F.col("role"), F.lit(""))
    row = F.when(F.col("text").isNotNull(), F.struct(
        "turn", role.alias("role"), turn_digest(role, F.col("text")).alias("id"), _last_fault(F.col("text")).alias("fault")))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    signed = convs.mapInArrow(_signed, _SIGNED_DDL)
    return (signed.repartitionByRange(n, F.reverse("signature"), "conv_id")
            .sortWithinPartitions(F.reverse("signature"))
            .mapInArrow(tidy(partial(_planned, most_nodes)), "conv_id long, " + ", ".join(
                f"{c} long" for c in (*_STATS, "cost")) + ", audit string"))


_TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                    ("text", pa.string())])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit row and then its rows in order, as its repaired rows."""
    conv, audit, at, q, position = None, "", 0, 0, 0
    for batch in parts(batches):
        out: list[tuple] = []

        def given(edit: str, text: str) -> None:
            nonlocal q, position
            role, q = _GIVEN[q]
            out.append((conv, position, edit, role, text))
            position += 1

        def insertions() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                given("I", "")
                at += 1

        for own, plan, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if plan is not None:
                insertions()  # at the end of the conversation before
                conv, audit, at, q, position = own, plan, 0, 0, 0
                continue
            insertions()
            edit = audit[at]
            at += 1
            if edit == "K":
                q = _KEPT[q, role[:1]]
                out.append((conv, position, edit, role, text))
                position += 1
            elif edit == "R":
                given(edit, text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _TURNS)], schema=_TURNS)
    out = []
    insertions()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _TURNS)], schema=_TURNS)


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the kept, reroled and inserted rows in order.

    Rows and audits meet sorted in a task and pass as a stream, so a conversation's texts are
    never held together; a conversation is contiguous and in order in its partition.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role = F.coalesce(F.col("role"), F.lit(""))
    none = F.lit(None).cast("string")
    heads = plans.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), none.alias("role"),
                         none.alias("id"), none.alias("text"))
    both = heads.union(rows.where("text is not null").select(
        "conv_id", none.alias("audit"), "turn", role.alias("role"), turn_digest(role, F.col("text")).alias("id"), "text"))
    return (both.repartition(n, "conv_id")
            .sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "id")
            .mapInArrow(tidy(_edited), "conv_id long, position long, edit string, role string, text string"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, sha, out = None, None, []
    for batch in parts(batches):
        for own, position, role, text in zip(*(
                batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
            if position == 0:
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = own, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["conv_id", "repaired_sha256"])
            out = []
    if sha is not None:
        out.append((conv, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])],
            names=["conv_id", "repaired_sha256"])


def repair_digests(table: DataFrame) -> DataFrame:
    """The plans of ``table``'s damaged conversations and the SHA-256 of their repaired rows, as ``role:text`` lines.

    An empty table gives no rows; a conversation of which no row is left after the damage, or after the
    repair, has the hash of the empty string.  Other columns are not read.
    """
    scratch = Scratch(table.sparkSession, "repair")
    rows = damaged(table)
    plans = scratch.table(repair_plans(rows), "plans")
    digests = repaired_turns(rows, plans).mapInArrow(_hashed, "conv_id long, repaired_sha256 string").select(
        F.col("conv_id").alias("own_id"), "repaired_sha256")
    return plans.join(digests, F.col("conv_id").eqNullSafe(F.col("own_id")), "left").select(
        *plans.columns, F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
