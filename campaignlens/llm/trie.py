"""A Patricia trie over byte strings whose terminal nodes hold owners, with spill by subtree."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

# What a node takes besides its label, roughly.
NODE_BYTES = 400


class Node:
    """A compressed edge: the bytes that lead here, the children by first byte, what ends here.

    A stub has a file instead: the strings below it are there, without the bytes up to it.
    """

    __slots__ = ("label", "children", "held", "file")

    def __init__(self, label: bytes, held: Any = None):
        self.label, self.children, self.held, self.file = label, {}, held, None


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class OwnerTrie:
    """Full byte strings, each with one value; values of an equal string are merged.

    When the trie holds more than ``budget`` bytes, the largest subtree under its first fork
    goes to a file (on the worker, as Spark's own spills do) and a stub takes its place;
    later strings that reach the stub join the file. ``items`` works each file off as a trie
    of its own. What cannot be split, a single string, may exceed the budget. Call ``close``
    to remove the files.
    """

    def __init__(self, merge: Callable[[Any, Any], Any], budget: int):
        self.root, self.size, self.merge, self.budget = Node(b""), 0, merge, budget
        self.stubs: list[Node] = []

    def insert(self, text: bytes, value: Any) -> None:
        self.size += self._insert(text, value)
        while self.size > self.budget and self._spill():
            pass

    def _insert(self, text: bytes, value: Any) -> int:
        """Bytes by which the trie has grown."""
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((text[at:], value), node.file)
                return 0
            if at == len(text):
                node.held = value if node.held is None else self.merge(node.held, value)
                return 0
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], value)
                return len(text) - at + NODE_BYTES
            n = len(child.label) if text.startswith(child.label, at) else shared_prefix(child.label, text[at : at + len(child.label)])
            if n < len(child.label):
                middle = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                node.children[text[at]] = middle
                node, at = middle, at + n
                if at == len(text):
                    node.held = value
                    return NODE_BYTES
                node.children[text[at]] = Node(text[at:], value)
                return len(text) - at + 2 * NODE_BYTES
            node, at = child, at + n

    @staticmethod
    def _walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        """Every node from ``node`` down with the bytes that lead to it after ``prefix``."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            yield (text := prefix + node.label), node
            stack += [(child, text) for child in node.children.values()]

    def _spill(self) -> bool:
        """Writes the largest subtree under the first fork; False if nothing is left to write."""
        fork = self.root
        while len(fork.children) == 1 and fork.held is None and next(iter(fork.children.values())).file is None:
            fork = next(iter(fork.children.values()))
        sizes = {
            first: sum(len(n.label) + NODE_BYTES for _, n in self._walk(child, b""))
            for first, child in fork.children.items()
            if child.file is None and not any(n.file is not None for _, n in self._walk(child, b""))
        }
        if not sizes:
            return False
        first = max(sizes, key=lambda b: (sizes[b], b))
        child = fork.children[first]
        stub = Node(child.label[:1])
        stub.file = tempfile.TemporaryFile(prefix="trie-")
        child.label = child.label[1:]
        for text, node in self._walk(child, b""):
            if node.held is not None:
                pickle.dump((text, node.held), stub.file)
        fork.children[first] = stub
        self.stubs.append(stub)
        self.size -= sizes[first]
        return True

    def items(self) -> Iterator[tuple[bytes, Any]]:
        """Every distinct string with its merged value; the trie is used up."""
        files = []
        for text, node in self._walk(self.root, b""):
            if node.file is not None:
                files.append((text, node.file))
            elif node.held is not None:
                yield text, node.held
        self.root, self.size = Node(b""), 0
        for head, file in files:
            file.seek(0, os.SEEK_SET)
            deeper = OwnerTrie(self.merge, self.budget)
            try:
                while True:
                    try:
                        deeper.insert(*pickle.load(file))
                    except EOFError:
                        break
                file.close()
                for text, value in deeper.items():
                    yield head + text, value
            finally:
                deeper.close()

    def close(self) -> None:
        for stub in self.stubs:
            stub.file.close()
        self.stubs = []
