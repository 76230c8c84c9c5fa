"""A linear-chain conditional random field over the words of texts, in NumPy.

A word's evidence for each label is the sum of learned weights of its features: affixes,
character trigrams and its place in per-label lexicons. Learned transitions tie neighbours
together, and forward-backward gives every word's label probabilities given the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np

BUCKETS = 1 << 15
RUN = 64  # letters of a word of a chain; a longer word is cut into runs that are words of their own
BLOCK = 1 << 13  # words whose features are held at a time
CACHE = 200_000
_SPACE = re.compile(r"\s")
_P = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def letters(word: str) -> str:
    """The word's letters in lower case; empty if it has none."""
    word = word.lower()
    if word.isalpha():
        return word
    return word[:-1] if word[:-1].isalpha() and not word[-1].isalpha() else "".join(filter(str.isalpha, word))


def in_runs(word: str) -> list[str]:
    """The letters of a word in runs of like size, at most RUN; each begins with the last two of the run before.

    Every letter and every trigram is in a run.
    """
    bare = letters(word)
    n = max(1, -(-(len(bare) - 2) // (RUN - 2)))
    step = -(-(len(bare) - 2) // n)
    return [bare[i * step : (i + 1) * step + 2] for i in range(n)] if n > 1 else [bare]


def cut(words: list[str]) -> list[str]:
    """The words of a chain: those of a text, long ones in runs, as where a text has no blanks."""
    if not words or max(map(len, words)) <= RUN:
        return words
    return [r for w in words for r in (in_runs(w) if len(w) > RUN else (w,))]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words end to end, and where each word's begin.

    Of ^word$: every trigram, the prefixes and suffixes of one, two and three letters.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    # Three marks before each word and three after, so that windows never reach the next word.
    before, after = "\x02" * 3, "\x03" * 3
    marked = (before + (after + before).join(words) + after).encode("utf-32-le", "surrogatepass")
    chars = np.frombuffer(marked, np.uint32).astype(np.uint64)
    begin = np.cumsum(np.concatenate(([3], sizes[:-1] + 6)))
    counts = sizes + 6
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    word = np.repeat(np.arange(len(words)), counts)
    nth = np.arange(int(counts.sum())) - starts[word]
    affix = nth < 6
    # The i-th trigram starts one mark before the word.
    at = np.where(affix, begin[word], begin[word] - 1 + nth - 6)
    size = np.where(affix, nth % 3 + 1, 3)
    at = np.where(affix & (nth >= 3), begin[word] + sizes[word] - size, at)
    kind = np.where(affix, nth + 1, 0).astype(np.uint64)
    h = kind * _P[3] + chars[at] * _P[0]
    h += np.where(size > 1, chars[at + 1] + 1, 0).astype(np.uint64) * _P[1]
    h += np.where(size > 2, chars[at + 2] + 1, 0).astype(np.uint64) * _P[2]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64), starts


def _steps(evidence: np.ndarray, starts: np.ndarray, jump: np.ndarray, begin: np.ndarray):
    """The words in runs of equal length that advance together, a run's words along the first axis.

    Gives the weights of labels (place, label, run), which words begin a chain (place, run),
    and the transitions. Places beyond the last word change nothing.
    """
    n, k = evidence.shape
    run = max(1, int(np.sqrt(n)))
    runs = -(-n // run)
    step = np.ones((runs * run, k))
    step[:n] = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    first = np.zeros(runs * run, bool)
    first[starts] = True
    step = np.ascontiguousarray(step.reshape(runs, run, k).transpose(1, 2, 0))
    return step, first.reshape(runs, run).T, np.exp(jump - jump.max()), np.exp(begin - begin.max()), n


def _ahead(x: np.ndarray, step: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Row vectors (..., label, run) moved over one word of each run."""
    moved = np.einsum("...ir,ij->...jr", x, move)
    if first.any():
        moved = np.where(first, x.sum(axis=-2, keepdims=True) * start[:, None], moved)
    return moved * step


def _product(steps) -> np.ndarray:
    """The product of each run's moves, (from, to, run), up to a factor."""
    step, first, move, start, n = steps
    k, runs = step.shape[1:]
    whole = np.repeat(np.eye(k)[:, :, None], runs, axis=2)
    for t in range(len(step)):
        there = np.arange(runs) * len(step) + t < n
        after = _ahead(whole, step[t], first[t], move, start)
        after /= after.sum(axis=(0, 1))
        whole = after if there.all() else np.where(there, after, whole)
    return whole


def chain_product(evidence: np.ndarray, starts: np.ndarray, jump: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The product of all moves of a block of words, labels x labels, up to a factor."""
    whole = _product(_steps(evidence, starts, jump, begin))
    out = np.eye(evidence.shape[1])
    for r in range(whole.shape[2]):
        out = out @ whole[:, :, r]
        out /= out.sum()
    return out


def passes(
    evidence: np.ndarray,
    starts: np.ndarray,
    jump: np.ndarray,
    begin: np.ndarray,
    entry: np.ndarray | None = None,
    leave: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Forward (a word and all before it) and backward (all after it) weights, each row in proportion.

    ``evidence`` (words x labels) are log weights, ``starts`` the first word of each chain,
    ``jump`` and ``begin`` log weights of transitions and of a chain's first label; ``entry``
    and ``leave`` are the weights before the first and after the last word of a block. All
    chains are one sequence of moves (a chain's first forgets what came before), cut into
    runs of equal length that advance together: products per run, then their ends in turn,
    then every word. The result is exact whatever the lengths of the chains; matrices are
    held per run only.
    """
    n, k = evidence.shape
    if not n:
        return np.zeros((0, k)), np.zeros((0, k))
    steps = _steps(evidence, starts, jump, begin)
    step, first, move, start, _ = steps
    run, _, runs = step.shape
    whole = _product(steps)
    entries, leaves = np.empty((k, runs)), np.empty((k, runs))
    a = np.full(k, 1 / k) if entry is None else entry
    b = np.full(k, 1 / k) if leave is None else leave
    for r in range(runs):
        entries[:, r] = a
        a = a @ whole[:, :, r]
        a /= a.sum()
    for r in range(runs - 1, -1, -1):
        leaves[:, r] = b
        b = whole[:, :, r] @ b
        b /= b.sum()
    ahead, back = np.empty((run, k, runs)), np.empty((run, k, runs))
    a, b = entries, leaves
    for t in range(run):
        a = _ahead(a, step[t], first[t], move, start)
        a /= a.sum(axis=0)
        ahead[t] = a
    for t in range(run - 1, -1, -1):
        there = np.arange(runs) * run + t < n
        back[t] = b
        weighed = step[t] * b
        before = np.where(first[t], (start[:, None] * weighed).sum(axis=0), move @ weighed)
        before /= before.sum(axis=0)
        b = np.where(there, before, b)
    ahead, back = (x.transpose(2, 0, 1) for x in (ahead, back))
    return ahead.reshape(-1, k)[:n], back.reshape(-1, k)[:n]


def forward_backward(evidence: np.ndarray, starts: np.ndarray, jump: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Label probabilities of every word, given its whole chain."""
    ahead, back = passes(evidence, starts, jump, begin)
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True)


@dataclass
class Tagger:
    """Labels, hashed feature weights, lexicon weights, transitions and first labels."""

    labels: list[str]
    weights: np.ndarray  # (BUCKETS + 1 + labels) x labels; the rows after the hashed ones are of the lexicons
    jump: np.ndarray
    begin: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)  # word: the label whose lexicon has it
    # Rows of the table for words seen before; begun anew when it has more than CACHE words.
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray = field(default_factory=lambda: np.empty((0, 0)), repr=False)

    def __post_init__(self):
        self.table = np.empty((0, len(self.labels) + 1))

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "table": np.empty((0, len(self.labels) + 1))}

    @property
    def window(self) -> int:
        """Characters of text worked at a time: fewer with more labels."""
        return max(1 << 12, (1 << 22) // max(4, len(self.labels)))

    def lexicon_rows(self, words: list[str]) -> np.ndarray:
        return np.array([BUCKETS + self.lexicon.get(w, len(self.labels)) for w in words], np.int64)

    def evidence(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log weights per word, zeros for words without letters; which words have letters."""
        room = CACHE * 4 // max(4, len(self.labels))
        if len(self.cache) > room:
            self.cache.clear()
        known = self.cache
        place = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = list(dict.fromkeys(words[i] for i in np.flatnonzero(place < 0)))
        if new:
            bare = [letters(w) for w in new]
            total = self.weights[self.lexicon_rows(bare)]
            for i in range(0, len(bare), BLOCK):
                rows, starts = features(bare[i : i + BLOCK])
                total[i : i + BLOCK] += np.add.reduceat(self.weights[rows], starts, axis=0)
            lettered = np.array([bool(b) for b in bare])
            total[~lettered] = 0
            first = len(known)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            if len(known) > len(self.table):
                self.table = np.concatenate([self.table[:first], np.empty((len(known) + room // 4, len(self.labels) + 1))])
            self.table[first : len(known), :-1] = total
            self.table[first : len(known), -1] = lettered
            place = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        rows = self.table[place]
        return rows[:, :-1], rows[:, -1] > 0

    def tag(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Per text its words (long ones in runs), which of them have letters, and their label probabilities."""
        split = [cut(t.split()) for t in texts]
        words = [w for ws in split for w in ws]
        sizes = np.array([len(ws) for ws in split], np.int64)
        ends = np.cumsum(sizes)
        evidence, lettered = self.evidence(words)
        found = forward_backward(evidence, (ends - sizes)[sizes > 0], self.jump, self.begin)
        return [
            (ws, lettered[e - n : e], found[e - n : e]) for ws, e, n in zip(split, ends.tolist(), sizes.tolist(), strict=True)
        ]

    def tag_windows(self, text: str) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """The same of one long text, window by window.

        A first sweep keeps the product of each window's moves, which gives the weights at
        its ends; a second one works the words out.
        """
        k, products, begun = len(self.labels), [], False
        for window in text_windows(text, self.window):
            words = cut(window.split())
            evidence, _ = self.evidence(words)
            products.append(chain_product(evidence, np.array([0][: not begun], np.int64), self.jump, self.begin) if words else np.eye(k))
            begun = begun or bool(words)
        leaves = [np.full(k, 1 / k)]
        for product in products[:0:-1]:
            b = product @ leaves[-1]
            leaves.append(b / b.sum())
        entry, begun = np.full(k, 1 / k), False
        for window, product, leave in zip(text_windows(text, self.window), products, leaves[::-1], strict=True):
            words = cut(window.split())
            evidence, lettered = self.evidence(words)
            starts = np.array([0][: bool(words) and not begun], np.int64)
            ahead, back = passes(evidence, starts, self.jump, self.begin, entry, leave)
            both = ahead * back
            yield words, lettered, both / both.sum(axis=1, keepdims=True)
            entry = entry @ product
            entry /= entry.sum()
            begun = begun or bool(words)


def text_windows(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters that end at white space; a longer word stays whole."""
    start = 0
    while len(text) - start > size:
        found = _SPACE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def train(
    chains: list[list[str]],
    targets: list[list[int]],
    labels: list[str],
    lexicon: dict[str, int],
    rounds: int = 60,
    rate: float = 0.3,
    decay: float = 1e-4,
) -> Tagger:
    """Adam on the mean log likelihood of the chains' labels, all words of the sample at once."""
    k = len(labels)
    tagger = Tagger(labels, np.zeros((BUCKETS + k + 1, k)), np.zeros((k, k)), np.zeros(k), lexicon)
    words = [letters(w) for c in chains for w in c]
    if not words or k < 2:
        return tagger
    rows, starts = features(words)
    extra = tagger.lexicon_rows(words)
    word = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(rows))))
    blank = np.array([not w for w in words])
    target = np.array([y for t in targets for y in t])
    sizes = np.array([len(c) for c in chains])
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    truth = np.eye(k)[target]
    inner = np.ones(len(words), bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (target[later - 1], target[later]), 1)
    parts = [tagger.weights, tagger.jump, tagger.begin]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, rounds + 1):
        evidence = np.add.reduceat(tagger.weights[rows], starts, axis=0) + tagger.weights[extra]
        evidence[blank] = 0
        ahead, back = passes(evidence, first, tagger.jump, tagger.begin)
        found = ahead * back
        found /= found.sum(axis=1, keepdims=True)
        miss = truth - found
        miss[blank] = 0
        grad = np.zeros_like(tagger.weights)
        for j in range(k):
            grad[:, j] = np.bincount(rows, miss[word, j], len(grad)) + np.bincount(extra, miss[:, j], len(grad))
        # Label pairs: what stands before a move, the move, and what stands after it.
        after = np.exp(evidence[later] - evidence[later].max(axis=1, keepdims=True)) * back[later]
        joint = ahead[later - 1][:, :, None] * np.exp(tagger.jump) * after[:, None, :]
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        grads = [grad / len(words) - decay * tagger.weights, (pairs - expected) / len(words) - decay * tagger.jump, (truth[first] - found[first]).sum(0) / len(words) - decay * tagger.begin]
        for p, g, a, b in zip(parts, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g**2 - b)
            p += rate * (1 - step / (rounds + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return tagger
