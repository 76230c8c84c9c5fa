"""The trie against a dictionary, with budgets that force spills."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from campaignlens.llm.trie import OwnerTrie, shared_prefix


def gathered(texts, budget):
    trie = OwnerTrie(lambda a, b: (min(a[0], b[0]), a[1] + b[1]), budget)
    for i, text in enumerate(texts):
        trie.insert(text, (i, 1))
    spilled = len(trie.stubs)
    found = list(trie.items())
    trie.close()
    assert len(found) == len(dict(found))
    return dict(found), spilled


def expected(texts):
    out = {}
    for i, text in enumerate(texts):
        first, n = out.get(text, (i, 0))
        out[text] = (first, n + 1)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6) | st.sampled_from([b"", b"a", b"ab" * 50, b"ab" * 50 + b"c", b"ab" * 49])), st.sampled_from([0, 900, 3000, 1 << 40]))
def test_same_as_a_dictionary(texts, budget):
    assert gathered(texts, budget)[0] == expected(texts)


def test_spills_and_long_shared_prefixes():
    texts = [b"x" * 100_000 + bytes([i % 7]) + b"y" * (i % 11) for i in range(200)] + [b"z" * n for n in range(300)]
    found, spilled = gathered(texts, 50_000)
    assert spilled and found == expected(texts)


@pytest.mark.parametrize("a,b,n", [(b"", b"", 0), (b"abc", b"abd", 2), (b"abc", b"abc", 3), (b"x", b"y", 0), (b"abcdef", b"abcxef", 3)])
def test_shared_prefix(a, b, n):
    assert shared_prefix(a, b) == n
