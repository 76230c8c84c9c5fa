"""Byte-level BPE ids of texts.

A single blank between two characters that are not white space always begins a new token,
in byte-level BPE as in pieces that carry the blank at their front. So a text is cut
there: a long text is read in windows, and what is known of a word holds wherever it stands.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np

_CUT = re.compile(r"(?<=\S) (?=\S)")
WINDOW = 1 << 19  # characters of a text worked at a time

# How byte-level vocabularies cut a text before they merge.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Beyond these characters two libraries may know letters and blanks of different Unicode versions.
_UNCOMMON = "[^\x00-\x1b\x20-\x7e\xa1-\u024f]"


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """The text cut at single blanks into parts of little more than ``size`` characters, without the blanks between them.

    A stretch without a single blank stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def words_of(window: str) -> list[str]:
    """The words of a window; a single blank stood between any two of them."""
    return _CUT.split(window)


class BytePairs:
    """A tokenizer given as the content of its file; ``plain`` reads special tokens' strings as ordinary text.

    Where the file is a byte-level vocabulary whose merges are numbered in the order in which
    they apply, texts of common characters are encoded by rank, which gives the same ids
    faster. Other texts, and other files, go through the file's own tokenizer.
    """

    def __init__(self, content: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.content, self.plain = content, plain
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = plain
        spec = json.loads(content)
        special = [] if plain else [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.odd = re.compile("|".join([_UNCOMMON, *special]))
        self.bytes = self.token_bytes()
        self.sizes = np.array([len(t) for t in self.bytes])
        self.ranked = self._by_rank(spec)
        # Ids of a byte-level vocabulary give back their text, unless a special token's string stands for one.
        self.lossless = self.ranked is not None and plain

    def __reduce__(self):
        return _of_worker, (self.content, self.plain)

    @classmethod
    def load(cls, path: str, plain: bool = False) -> BytePairs:
        """Reads the file; only the driver needs it."""
        with open(path, encoding="utf-8") as file:
            return cls(file.read(), plain)

    def _by_rank(self, spec: dict):
        """The vocabulary as ranks, None if ranks and merges could differ."""
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
        vocab = model.get("vocab", {})
        usual = (
            model.get("type") == "BPE"
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and spec["normalizer"] is None
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        made = [vocab.get(a + b, -1) for a, b in merges]
        if not usual or made != sorted(made) or len(set(made)) < len(made) or len(vocab) != 256 + len(made):
            return None
        import tiktoken

        ranks = {self.bytes[i]: i for i in vocab.values()}
        return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def token_bytes(self) -> list[bytes]:
        """What each id stands for. The alphabet of byte-level vocabularies writes printable bytes
        as themselves and the others, in order, as the characters from 256."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        out = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        return out

    def after_blank(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in a new order, the ids of a blank and each of them end to end, and the number of ids per word.

        Common words without white space at their ends are one text, cut again by the bytes of its tokens.
        """
        if self.ranked is None:
            joined, other = [], words
        else:
            odd = self.odd.search
            rest = {w for w in words if w[0].isspace() or w[-1].isspace() or odd(w)}
            joined, other = [w for w in words if w not in rest], [w for w in words if w in rest]
        ids = np.array(self.ranked.encode_ordinary(f" {' '.join(joined)}") if joined else [], np.int64)
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) + 1 for w in joined]), side="right")
        own = [e.ids for e in self.tokenizer.encode_batch([f" {w}" for w in other], add_special_tokens=False)]
        counts = np.concatenate([np.diff(cuts, prepend=0), [len(x) for x in own]]).astype(np.int64)
        return joined + other, np.concatenate([ids, *own]).astype(np.int64), counts

    def _ids(self, window: str) -> list[int]:
        """The ids of a window; of a mixed one, its runs of common and of other words in turn."""
        if self.ranked is None:
            return self.tokenizer.encode(window, add_special_tokens=False).ids
        if not self.odd.search(window):
            return self.ranked.encode_ordinary(window)
        out: list[int] = []
        runs = [(odd, " ".join(run)) for odd, run in groupby(words_of(window), lambda w: self.odd.search(w) is not None)]
        for i, (odd, run) in enumerate(runs):
            text = f" {run}" if i else run
            out += self.tokenizer.encode(text, add_special_tokens=False).ids if odd else self.ranked.encode_ordinary(text)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets of each text in them; an empty text has none."""
        parts, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for j, window in enumerate(windows(text) if text else ()):
                parts.append(np.array(self._ids(f" {window}" if j else window), np.int32))
                counts[i] += len(parts[-1])
        return np.concatenate(parts) if parts else np.empty(0, np.int32), np.concatenate(([0], np.cumsum(counts)))


@lru_cache(4)
def _of_worker(content: str, plain: bool) -> BytePairs:
    """One object per worker process."""
    return BytePairs(content, plain)
