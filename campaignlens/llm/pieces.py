"""SentencePiece encoding by batched Viterbi in NumPy, and exact decoding.

A text is cut into words that begin with the blank mark; no piece crosses such a border, so
the best segmentation of a text is that of its words. Words of equal length advance
together: hashes of all their substrings probe the sorted hashes of the pieces, and a
vectorised maximum per position stores where the best piece that ends there began. A word
met before is looked up. Pieces are scored by the model's own scores. Those of a BPE model
are ranks of merges, whose sum means nothing; there every piece costs more than all ranks of
a word together, so the best segmentation has the fewest pieces and, of those, the best ranks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from campaignlens.llm.texts import free_name, slices

MARK = "▁"
REAL_MARK = "\udc81"  # stands for the mark's own character in a text; no valid text has it
UNKNOWN_PENALTY = 10.0
RANKED_PIECE_COST = float(1 << 34)  # sums stay exact, and above all ranks, in words of up to 500,000 pieces
CACHE = 150_000
IDS_AT_A_TIME = 1 << 18  # decoded between two batches given out
CELLS = 1 << 19  # (word, end, length) triples probed at a time
_BASE, _BY_LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def _powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n, _BASE, np.uint64)))) if n else np.ones(1, np.uint64)


def substring_hash(prefix: np.ndarray, start: np.ndarray, size: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Hash of ``size`` characters from ``start`` in each row of prefix hashes."""
    return prefix[:, start + size] - prefix[:, start] * powers[size] + size.astype(np.uint64) * _BY_LENGTH


def prefix_hashes(words: list[str], size: int) -> np.ndarray:
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)
    out = np.zeros((len(words), size + 1), np.uint64)
    for t in range(size):
        out[:, t + 1] = out[:, t] * _BASE + chars[:, t] + np.uint64(1)
    return out


def are_ranks(scores: np.ndarray) -> bool:
    """Whether scores are places in an order, as a BPE model has them: whole, not positive, no two alike but the lowest."""
    placed = scores[scores > scores.min()]
    return len(placed) > 0 and bool((scores == np.round(scores)).all() and (scores <= 0).all()) and len(np.unique(placed)) == len(placed)


@dataclass
class PieceModel:
    """The pieces of a model file; ``keys`` are sorted hashes, ``ids`` and ``scores`` in their order."""

    pieces: list[str]
    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    bytes_of: list[bytes]  # what an id stands for in a decoded text
    byte_ids: np.ndarray  # 256 ids, -1 without byte fallback
    unknown: int
    unknown_score: float
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    flat: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32), repr=False)
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64), repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "flat": np.empty(0, np.int32), "first": np.zeros(1, np.int64)}

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Reads a model file; only the driver needs it."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        byte_ids = np.full(256, -1, np.int32)
        bytes_of = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(pieces[i][3:5], 16)] = i
                bytes_of[i] = bytes([int(pieces[i][3:5], 16)])
        for i in plain:
            bytes_of[i] = pieces[i].replace(MARK, " ").encode()
        keys, ids = [], []
        for size in sorted({len(pieces[i]) for i in plain}):
            own = [i for i in plain if len(pieces[i]) == size]
            prefix = prefix_hashes([pieces[i] for i in own], size)
            keys.append(substring_hash(prefix, np.array([0]), np.array([size]), _powers(size))[:, 0])
            ids += own
        keys, ids = np.concatenate(keys), np.array(ids, np.int32)
        order = np.argsort(keys)
        if (keys[order][1:] == keys[order][:-1]).any():
            raise ValueError("two pieces have the same hash")
        scores = np.array([sp.get_score(int(i)) for i in ids[order]])
        unknown_score = float(scores.min()) - UNKNOWN_PENALTY
        if are_ranks(scores):
            places = np.unique(scores, return_inverse=True)[1]
            scores = places - float(len(scores)) - RANKED_PIECE_COST
            unknown_score = float(scores.min()) - 4 * RANKED_PIECE_COST  # up to four bytes
        return cls(
            pieces, keys[order], ids[order], scores, max(len(pieces[i]) for i in plain), bytes_of, byte_ids, sp.unk_id(),
            unknown_score,
        )

    def segment(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """The words in groups of equal length, each with all their ids end to end and the number of ids per word.

        The segmentation of a word is the best one; of equal ones, that with the longest last pieces.
        """
        by_size: dict[int, list[str]] = {}
        for word in words:
            by_size.setdefault(len(word), []).append(word)
        for size, members in by_size.items():
            group = max(1, CELLS // (size * min(size, self.longest)))
            for i in range(0, len(members), group):
                part = members[i : i + group]
                yield part, *self._equal_length(part, size)

    def _equal_length(self, words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        prefix, powers = prefix_hashes(words, size), _powers(self.longest)
        best = np.full((len(words), size + 1), -np.inf)
        best[:, 0] = 0
        chosen = np.full((len(words), size + 1), -1, np.int32)
        length = np.ones((len(words), size + 1), np.int32)
        longest = min(self.longest, size)
        rows = np.arange(len(words))
        stride = max(1, CELLS // (len(words) * longest))
        for low in range(1, size + 1, stride):
            ends = np.arange(low, min(size + 1, low + stride))
            # For each end, the lengths of what may end there, longest first.
            counts = np.minimum(ends, longest)
            first = np.cumsum(counts) - counts
            sizes = np.repeat(counts, counts) - (np.arange(int(counts.sum())) - np.repeat(first, counts))
            start = np.repeat(ends, counts) - sizes
            keys = substring_hash(prefix, start, sizes, powers)
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == keys
            score = np.where(hit, self.scores[at], np.where(sizes == 1, self.unknown_score, -np.inf))
            piece = np.where(hit, self.ids[at], -1)
            for end, a, n in zip(ends.tolist(), first.tolist(), counts.tolist(), strict=True):
                total = best[:, end - n : end] + score[:, a : a + n]
                pick = total.argmax(axis=1)
                best[:, end] = total[rows, pick]
                chosen[:, end] = piece[rows, a + pick]
                length[:, end] = n - pick
        found, which, where = [], [], []
        left = np.full(len(words), size)
        active = rows
        while len(active):
            found.append(chosen[active, left[active]])
            which.append(active)
            where.append(left[active] - 1)
            left[active] -= length[active, left[active]]
            active = active[left[active] > 0]
        ids, which, where = (np.concatenate(x[::-1]) for x in (found, which, where))
        order = np.argsort(which, kind="stable")
        ids, which, where = ids[order], which[order], where[order]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            spelled = [self._fallback(words[which[u]][where[u]]) for u in unknown]
            times = np.ones(len(ids), np.int64)
            times[unknown] = [len(x) for x in spelled]
            ids, which = np.repeat(ids, times), np.repeat(which, times)
            ids[ids < 0] = np.concatenate(spelled)
        return ids, np.bincount(which, minlength=len(words))

    def _fallback(self, char: str) -> np.ndarray:
        data = (MARK if char == REAL_MARK else char).encode()
        ids = self.byte_ids[np.frombuffer(data, np.uint8)]
        return ids if (ids >= 0).all() else np.array([self.unknown], np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets of each text in them."""
        if len(self.cache) > CACHE:
            self.cache, self.flat, self.first = {}, np.empty(0, np.int32), np.zeros(1, np.int64)
        split = [_WORD.findall(MARK + t.replace(MARK, REAL_MARK).replace(" ", MARK)) if t else [] for t in texts]
        words = [w for ws in split for w in ws]
        known = self.cache
        place = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        if (place < 0).any():
            ids, sizes = [self.flat], []
            for part, own, counts in self.segment(list(dict.fromkeys(words[i] for i in np.flatnonzero(place < 0)))):
                known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
                ids.append(own)
                sizes.append(counts)
            self.flat = np.concatenate(ids)
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])
            place = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        start, size = self.first[place], self.first[place + 1] - self.first[place]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
        counts = np.cumsum([0, *map(len, split)])
        return self.flat[at], np.concatenate(([0], ends))[counts]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids that stand for nothing (control, unknown) add nothing."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")


def encode_texts(docs: DataFrame, model: PieceModel, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """The table (without its text if not ``keep_text``) with the piece ids of each whole text.

    A null text has null ids, an empty one an empty array. Characters that no piece has are
    written as their bytes, so every text decodes to itself. If ``ids_col`` is taken,
    underscores are added. Repeated rows get equal ids; an empty table stays empty.
    """
    name = free_name(docs, ids_col)
    rest = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col)
            ids, offsets = model.encode([t or "" for t in texts.to_pylist()])
            array = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], array], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_ids(table: DataFrame, model: PieceModel, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The table with the text of each array of ids; null ids give a null text."""
    name = free_name(table, text_col)
    schema = T.StructType([*table.schema.fields, T.StructField(name, T.StringType())])

    def decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(ids_col)
        values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        texts = [
            model.decode(values[a:b].tolist()) if there else None
            for a, b, there in zip(at[:-1], at[1:], column.is_valid().to_pylist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(ids_col).offsets.to_numpy()
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + IDS_AT_A_TIME, "right")) - 1)
                yield decoded(batch.slice(start, stop - start))
                start = stop

    return table.mapInArrow(run, schema)
