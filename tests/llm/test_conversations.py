"""Prefix trie and structure repair against plain Python versions: odd rows, borders, ties."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kwhlens.llm import conversation_repair, prefix_trie
from kwhlens.llm.radix import Node4, Node16, Node48, Node256, RadixTree
from tests.llm.conftest import SMOKE

SCHEMA = "conv_id long, turn long, role string, text string, ids string, key string, path string, audit string, n int"
#: Nulls in any column, empty texts, ties, repeated rows, a long text, gaps, other roles, a turnless conversation (7 after 0).
ODD = [
    (0, 0, "system", "Be brief."), (0, 1, "user", "Hi there!"), (0, 2, "assistant", "Hello."), (0, 3, "user", "Bye."),
    (7, 0, "user", "alone."), (1, None, "user", "null turn"), (1, None, "user", "null turn"), (1, 0, None, None),
    (1, 5, "user", "a"), (1, 5, "user", "b"), (1, 5, "assistant", "b"), (2, 1, "", ""), (3, 0, "tool", "call()"),
    (3, 1, "user", "  \t\n"), (4, 0, "user", "é" * 70000 + "."), (4, 2, "assistant", "x? \x0b"), (None, 1, "user", "no id."),
    (None, None, None, None), (101, 0, "user", "Hi there!"), (-5, 0, "user", "negative."), (-100, 0, "user", "base."),
    *[(200 + k, t, "ua"[t % 2] + "x", f"turn {t}.") for k in range(5) for t in range(3 + k % 2)],
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "i", "k", "p", "K", 1) for r in ODD], SCHEMA)


def turn_id(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain_trie(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, r, turn_id(r, x), x))
    own = {c: [(v[2], v[4]) for v in sorted(vs)] for c, vs in convs.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n)).encode()).hexdigest())
        for n, m in members.items())


@pytest.mark.parametrize("block_keys", [1, 2, 10_000])
def test_trie_equals_plain_version(spark, odd, block_keys):
    for df in (odd, spark.read.parquet(f"{SMOKE}/conversations.parquet")):
        got = sorted(tuple(r) for r in prefix_trie.prefix_trie(df, block_keys).collect())
        assert got == plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_branches_in_every_layout(spark):
    """More than 48 children of a node, long common beginnings, prefixes that end."""
    rows = [(c, t, "user", f"{'same' if t < c % 4 else c} {t}") for c in range(300) for t in range(c % 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in prefix_trie.prefix_trie(df, 40).collect()) == plain_trie(rows)


def test_empty_tables(odd):
    none = odd.where("conv_id = -77")
    assert prefix_trie.prefix_trie(none).count() == 0
    assert conversation_repair.repair_digests(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(max_size=6), max_size=300))
def test_radix_tree_holds_its_keys(keys):
    tree = RadixTree()
    for k in random.Random(1).sample(sorted(keys), len(keys)):
        tree.insert(k, k)

    def walk(node, path):
        path += node.prefix
        if node.value is not None:
            yield path, node.value
        for byte, child in node.children():
            yield from walk(child, path + bytes([byte]))

    assert list(walk(tree.root, b"")) == [(k, k) for k in sorted(keys)]
    assert sum(n.value is not None for n, *_ in tree.upwards()) == len(keys)


@pytest.mark.parametrize("n, layout", [(4, Node4), (16, Node16), (48, Node48), (200, Node256)])
def test_radix_layouts(n, layout):
    tree = RadixTree()
    for b in random.Random(n).sample(range(n), n):
        tree.insert(bytes([b]), b)
    assert type(tree.root) is layout
    assert [c.value for _, c in tree.root.children()] == list(range(n))
    assert tree.root.get(n) is None if n < 256 else True


# ------------------------------------------------------------------ repair
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(rows):
    """(cost, audit) by trying all edits; rows are (initial, to be deleted, truncated)."""

    @functools.lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "")] if i == len(rows) and q in (0, 3) else []
        options = [("I", 2, i, STEP[q, r]) for r in "ua" if inserted < 3 and (q, r) in STEP]
        if i < len(rows):
            first, gone, cut = rows[i]
            options.append(("D", 3, i + 1, q))
            if not gone:
                options += [("K", cut, i + 1, STEP[q, first])] if (q, first) in STEP else []
                options += [("R", 2 + cut, i + 1, STEP[q, r]) for r in "ua" if (q, r) in STEP]
        for edit, cost, j, to in options:
            c, a = best(j, to, inserted + 1 if edit == "I" else 0)
            found.append((cost + c, edit + a))
        return min(found, default=(1 << 40, ""))

    return best(0, 0, 0)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("suaoSUAOx"), max_size=9))
def test_automaton_finds_the_cheapest_edits(symbols):
    automaton = conversation_repair.SuffixAutomaton(most=50)
    rows = tuple((s.lower(), s == "x", int(s.isupper())) for s in symbols)
    assert automaton.plan("".join(symbols)) == cheapest(rows)


def test_automaton_shares_suffixes():
    automaton = conversation_repair.SuffixAutomaton()
    for s in ("suaua", "uaua", "xuaua", "ua"):
        automaton.plan(s)
    assert len(automaton.next) == 1 + 4 + 1 + 1  # end, the suffixes of uaua, and two beginnings


def plain_repair(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        own = convs[c]
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        r = "user" if fault == 4 else r
        own += [(t is not None, t or 0, r, turn_id(r, x), x)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for c, own in convs.items():
        own.sort()
        turns = {v[1] for v in own if v[0]}
        count, seen, signs = collections.Counter(), set(), []
        for *_, r, _, x in own:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", x)
            fault = ("blank" if not body else "duplicate" if (r, x) in seen else
                     "truncated" if body[-1] not in ".!?" else "")
            seen.add((r, x))
            count[fault] += 1
            signs.append((r[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = cheapest(tuple(signs))
        q, left, lines = 0, iter(own), []
        for edit in audit:
            role = "assistant" if q == 2 else "user"
            *_, r, _, x = next(left) if edit != "I" else (role, None, "")
            if edit == "D":
                continue
            role = r if edit == "K" else role
            lines.append(f"{role}:{x}")
            q = STEP[q, role[0]]
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"],
                    count["truncated"], sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(signs, signs[1:])),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repair_equals_plain_version(spark, odd):
    many = spark.createDataFrame(
        [(1000 + k, t, r, x) for k in range(40) for t, (r, x) in enumerate(
            [("system", "S."), ("user", "Q"), ("user", "Q"), ("assistant", "A!"), ("bot", "?"), ("user", " ")][k % 5:])],
        "conv_id long, turn long, role string, text string")
    for df in (odd, many, spark.read.parquet(f"{SMOKE}/conversations.parquet")):
        got = sorted((tuple(r) for r in conversation_repair.repair_digests(df).collect()), key=str)
        assert got == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_turns_are_lawful(spark, odd):
    rows = conversation_repair.damaged(odd)
    plans = conversation_repair.repair_plans(rows, most_nodes=3)
    turns = collections.defaultdict(list)
    for r in conversation_repair.repaired_turns(rows, plans).collect():
        turns[r.conv_id].append((r.position, r.role[0]))
    for own in turns.values():
        assert [p for p, _ in sorted(own)] == list(range(len(own)))
        assert re.fullmatch("s?(ua)+", "".join(x for _, x in sorted(own)))
