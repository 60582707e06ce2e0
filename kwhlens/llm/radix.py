"""An adaptive radix tree over byte keys: nodes grow through four layouts, single paths are compressed.

A node holds the bytes that its keys share from its parent's branch on (``prefix``), the key
that ends in it (``value``, or None) and its children by their next byte.  Four layouts
hold up to 4, 16, 48 and 256 children; a full node is replaced by the next one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator


class Node4:
    """Up to 4 children: their bytes in order, searched one by one."""

    ROOM = 4
    __slots__ = ("prefix", "value", "keys", "nodes")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value = prefix, value
        self.keys, self.nodes = bytearray(), []

    def get(self, byte: int):
        for k, node in zip(self.keys, self.nodes):
            if k == byte:
                return node
        return None

    def put(self, byte: int, node) -> None:
        """A new or replaced child."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.nodes[at] = node
        else:
            self.keys.insert(at, byte)
            self.nodes.insert(at, node)

    def full(self) -> bool:
        return len(self.keys) == self.ROOM

    def children(self) -> Iterator[tuple[int, object]]:
        """(byte, child) in ascending order of the bytes."""
        return zip(self.keys, self.nodes)


class Node16(Node4):
    """Up to 16 children: their bytes in order, searched by bisection."""

    ROOM = 16
    __slots__ = ()

    def get(self, byte: int):
        at = bisect_left(self.keys, byte)
        return self.nodes[at] if at < len(self.keys) and self.keys[at] == byte else None


class Node48:
    """Up to 48 children: a slot number for each of the 256 bytes, and the slots."""

    ROOM = 48
    __slots__ = ("prefix", "value", "slot", "nodes", "used")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value = prefix, value
        self.slot, self.nodes, self.used = bytearray(b"\xff" * 256), [], []

    def get(self, byte: int):
        s = self.slot[byte]
        return None if s == 255 else self.nodes[s]

    def put(self, byte: int, node) -> None:
        s = self.slot[byte]
        if s == 255:
            self.slot[byte] = len(self.nodes)
            self.nodes.append(node)
            insort(self.used, byte)
        else:
            self.nodes[s] = node

    def full(self) -> bool:
        return len(self.nodes) == self.ROOM

    def children(self):
        return ((b, self.nodes[self.slot[b]]) for b in self.used)


class Node256:
    """A place for a child of each byte."""

    ROOM = 256
    __slots__ = ("prefix", "value", "nodes")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value = prefix, value
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> None:
        self.nodes[byte] = node

    def full(self) -> bool:
        return False

    def children(self):
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


_NEXT = {Node4: Node16, Node16: Node48, Node48: Node256}


def _grown(node):
    """``node`` in the next larger layout."""
    larger = _NEXT[type(node)](node.prefix, node.value)
    for byte, child in node.children():
        larger.put(byte, child)
    return larger


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of ``a`` are those of ``b`` from ``at`` on."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    return next(i for i in range(n) if a[i] != b[at + i])


class RadixTree:
    def __init__(self):
        self.root = Node4(b"")

    def insert(self, key: bytes, value) -> None:
        """Adds a key with its value (not None); a key that is there gets the new value."""
        at, node, parent, branch = 0, self.root, None, 0
        while True:
            same = _shared(node.prefix, key, at)
            if same < len(node.prefix):  # the compressed path parts here
                upper = Node4(node.prefix[:same])
                byte, node.prefix = node.prefix[same], node.prefix[same + 1 :]
                upper.put(byte, node)
                self._hang(parent, branch, upper)
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            child = node.get(key[at])
            if child is None:
                if node.full():
                    node = _grown(node)
                    self._hang(parent, branch, node)
                node.put(key[at], Node4(key[at + 1 :], value))
                return
            parent, branch, node, at = node, key[at], child, at + 1

    def _hang(self, parent, branch: int, node) -> None:
        if parent is None:
            self.root = node
        else:
            parent.put(branch, node)

    def upwards(self) -> Iterator[tuple[object, int, int, list[int]]]:
        """(node, depth of its branch point in bytes, its number, its children's numbers), children before parents."""
        stack: list = [(self.root, len(self.root.prefix), None)]
        number = 0
        done: list[list[int]] = [[]]
        while stack:
            node, depth, rest = stack[-1]
            if rest is None:
                rest = node.children()
                stack[-1] = (node, depth, rest)
                done.append([])
            following = next(rest, None)
            if following is None:
                stack.pop()
                yield node, depth, number, done.pop()
                done[-1].append(number)
                number += 1
            else:
                child = following[1]
                stack.append((child, depth + 1 + len(child.prefix), None))
