"""Aligning the tokens of two tokenizers on the bytes of each text, and counting linked ids.

Both token lines cut the same bytes. Where both end at once a group ends; an A and a B token
whose bytes overlap are linked. A word's alignment does not depend on its neighbours (see
``byte_pairs``), so words met before are looked up.

The first pass gathers each task's linked id pairs with the number of its documents that
hold them. The distinct pairs are hashed without gaps, shard by shard, every task's counts
become dense vectors in the order of the hash, and the vectors are summed in a tree. The
second pass aligns the texts again and looks the counts up; keys are verified, so a pair
that is not in the table at hand is noticed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.byte_pairs import WINDOW, BytePairs, windows, words_of
from campaignlens.llm.perfect_hash import PerfectHash, build
from campaignlens.llm.texts import free_name, slices
from campaignlens.session import written

MARK = "▁"
SHARD_KEYS = 1 << 16  # keys of a shard, about
FAN = 8  # vectors summed in one step of the tree
MAX_SHIPPED = 4_000_000  # pairs whose counts go to every task; 16 bytes each
PENDING = 2_000_000  # pairs a task holds before it sums them
CACHE_WORDS, CACHE_LINKS = 400_000, 4_000_000


class Pieces:
    """A piece model given as the bytes of its file; a text is encoded with a blank before it."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.proto = proto
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)

    def __reduce__(self):
        return Pieces, (self.proto,)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Reads the file; only the driver needs it."""
        with open(path, "rb") as file:
            return cls(file.read())

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)

    def token_bytes(self) -> list[bytes]:
        """What each id stands for, the mark as a blank and <0xHH> as its byte."""
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        return [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(MARK, " ").encode() for i, name in enumerate(names)
        ]


@dataclass
class Aligned:
    """Texts aligned: arrays with one number per text, and the links of all texts end to end."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    same: np.ndarray  # whether both lines of tokens give the text
    links: np.ndarray  # a * (ids of B) + b
    first: np.ndarray  # offsets of each text's links
    groups: list[str]


class Grown:
    """An array that rows are added to; only its first ``size`` rows are used."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.size = rows, len(rows)

    def add(self, new: np.ndarray) -> None:
        if self.size + len(new) > len(self.rows):
            room = np.empty((max(self.size, len(new)), *self.rows.shape[1:]), self.rows.dtype)
            self.rows = np.concatenate([self.rows[: self.size], new, room])
        else:
            self.rows[self.size : self.size + len(new)] = new
        self.size += len(new)


class Aligner:
    """Aligns texts by words; ``a`` encodes a blank and the word, ``b`` the word to the same bytes."""

    def __init__(self, a: BytePairs, b: Pieces, with_groups: bool = True):
        self.a, self.b, self.with_groups = a, b, with_groups
        self.a_bytes, self.b_bytes = a.bytes, b.token_bytes()
        self.a_sizes, self.b_sizes = a.sizes, np.array([len(t) for t in self.b_bytes])
        # Names of the ids with what may follow them: A , or | and B , or ;
        names_a, names_b = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        texts = [n + end for names, ends in ((names_a, ",|"), (names_b, ",;")) for end in ends for n in names]
        self.names = np.array(texts, object)
        self._clear()

    def __reduce__(self):
        return _of_worker, (self.a.content, self.a.plain, self.b.proto, self.with_groups)

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.shape = Grown(np.empty((0, 4), np.int64))  # n_a, n_b, n_groups, same
        self.groups: list[str] = []
        self.flat = Grown(np.empty(0, np.int64))
        self.first = Grown(np.zeros(1, np.int64))

    @property
    def width(self) -> int:
        return len(self.b_bytes)

    def _same(self, ids: np.ndarray, counts: np.ndarray, words: list[bytes], table: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Which words the bytes of their tokens give back."""
        ends = np.cumsum(counts)
        total = np.concatenate(([0], np.cumsum(sizes[ids])))[ends]
        if np.array_equal(total, np.cumsum([len(w) for w in words])) and b"".join(map(table.__getitem__, ids.tolist())) == b"".join(words):
            return np.ones(len(words), bool)
        parts = (ids[e - n : e].tolist() for e, n in zip(ends.tolist(), counts.tolist(), strict=True))
        return np.array([b"".join(map(table.__getitem__, x)) == w for x, w in zip(parts, words, strict=True)])

    def _align(self, words: list[str]) -> None:
        """Aligns new words, all at once: their tokens end to end are two lines over the same bytes."""
        words, a, n_a = self.a.after_blank(words)
        ids_b = self.b.encode_words(words)
        n_b = np.fromiter(map(len, ids_b), np.int64, len(words))
        b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        data = [f" {w}".encode() for w in words]
        same = self._same(b, n_b, data, self.b_bytes, self.b_sizes)
        if not self.a.lossless:
            same &= self._same(a, n_a, data, self.a_bytes, self.a_sizes)
        if not same.all():
            a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
            n_a, n_b = n_a * same, n_b * same
        end_a, end_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # Links: the bytes between any two neighbouring ends belong to one token of each line.
        ends = np.union1d(end_a, end_b)
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        links = a[link_a] * self.width + b[link_b]
        word_a, word_b = np.repeat(np.arange(len(words)), n_a), np.repeat(np.arange(len(words)), n_b)
        n_links = np.bincount(word_a[link_a], minlength=len(words))
        # Groups end where both lines have an end.
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        n_groups = np.bincount(word_a[last_a], minlength=len(words))
        self.groups += self._written(a, b, n_a + n_b, last_a, last_b) if self.with_groups else [""] * len(words)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.shape.add(np.stack([n_a, n_b, n_groups, same], axis=1))
        self.first.add(self.flat.size + np.cumsum(n_links))
        self.flat.add(links)

    def _written(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """The groups of each word: names in the order of groups, A before B within a group."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        sizes_a, sizes_b = np.bincount(group_a), np.bincount(group_b)
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = self.names[a + last_a * len(self.a_bytes)]
        text[np.arange(len(b)) + np.cumsum(sizes_a)[group_b]] = self.names[2 * len(self.a_bytes) + b + last_b * self.width]
        cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
        text = text.tolist()
        return ["".join(text[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def align(self, texts: list[str]) -> Aligned:
        """Each text (or window of one) as it follows a blank; the last group of each text has no semicolon."""
        if len(self.known) > CACHE_WORDS or self.flat.size > CACHE_LINKS:
            self._clear()
        split = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for part in split for w in part]
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = [words[i] for i in unknown.tolist()]
            self._align(list(dict.fromkeys(new)))
            place[unknown] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        begins = np.cumsum(counts) - counts
        shape = self.shape.rows[place]
        n_a, n_b, n_groups = (np.add.reduceat(shape[:, i], begins) if len(texts) else np.empty(0, np.int64) for i in range(3))
        same = np.logical_and.reduceat(shape[:, 3] > 0, begins) if len(texts) else np.empty(0, bool)
        first = self.first.rows
        start, size = first[place], first[place + 1] - first[place]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
        first = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        groups = []
        if self.with_groups:
            names = [self.groups[p] for p in place.tolist()]
            groups = ["".join(names[i : i + n])[:-1] for i, n in zip(begins.tolist(), counts.tolist(), strict=True)]
        return Aligned(n_a, n_b, n_groups, same, self.flat.rows[at], first, groups)


@lru_cache(1)
def _of_worker(content: str, plain: bool, proto: bytes, with_groups: bool) -> Aligner:
    """One object per worker process: the words its tasks have met are kept from task to task."""
    return Aligner(BytePairs(content, plain), Pieces(proto), with_groups)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of weights (or the number) of each."""
    if weights is None:
        keys, times = np.unique(keys, return_counts=True)
        return keys, times.astype(np.int64)
    keys, place = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, weights)
    return keys, sums


def aligned_rows(aligner: Aligner, texts: list[str | None]):
    """Per row (number in the list): n_a, n_b, n_groups, distinct links with how often each occurs, groups.

    Rows without tokens have zeros. A text of several windows is worked window by window;
    groups end at the blank between two windows.
    """
    short = [i for i, t in enumerate(texts) if t and len(t) <= WINDOW]
    found = aligner.align([texts[i] for i in short])
    for j, i in enumerate(short):
        if found.same[j]:
            links = counted(found.links[found.first[j] : found.first[j + 1]])
            yield i, int(found.n_a[j]), int(found.n_b[j]), int(found.n_groups[j]), *links, found.groups[j] if aligner.with_groups else ""
    for i, text in enumerate(texts):
        if text and len(text) > WINDOW:
            sizes, parts, same = np.zeros(3, np.int64), [], True
            keys, times = np.empty(0, np.int64), np.empty(0, np.int64)
            for window in windows(text):
                part = aligner.align([window])
                same = same and bool(part.same[0])
                if not same:
                    break
                sizes += part.n_a[0], part.n_b[0], part.n_groups[0]
                own = counted(part.links)
                keys, times = counted(np.concatenate([keys, own[0]]), np.concatenate([times, own[1]]))
                parts += part.groups
            if same:
                yield i, *sizes.tolist(), keys, times, ";".join(parts)


def pair_counts(docs: DataFrame, aligner: Aligner) -> DataFrame:
    """(task, key, n): in how many documents of a task (column ``text``) the ids of a pair are linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        keys, sums, pending = np.empty(0, np.int64), np.empty(0, np.int64), 0

        def settle() -> None:
            nonlocal held, keys, sums, pending
            own, times = counted(np.concatenate([np.empty(0, np.int64), *held]))
            keys, sums = counted(np.concatenate([keys, own]), np.concatenate([sums, times]))
            held, pending = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                part, n = keys[i : i + (1 << 16)], sums[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), task)), pa.array(part), pa.array(n)], names=["task", "key", "n"])

        for batch in slices(batches, "text"):
            for _, _, _, _, own, _, _ in aligned_rows(aligner, batch.column("text").to_pylist()):
                held.append(own)
                pending += len(own)
                if pending > PENDING:
                    settle()
                    if len(keys) > 2 * PENDING:
                        yield from rows()
                        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        settle()
        yield from rows()

    return docs.mapInArrow(run, "task long, key long, n long")


SHARD = "shard long, sizes array<long>, bits binary, keys binary"


def _hash_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    levels, keys = build(table.column("key").to_numpy())
    bits = np.packbits(np.concatenate(levels)).tobytes()
    return pa.table(
        {
            "shard": pa.array([key[0].as_py()], pa.int64()),
            "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
            "bits": pa.array([bits], pa.binary()),
            "keys": pa.array([keys.astype("<i8").tobytes()], pa.binary()),
        }
    )


def shard_hash(sizes: list[int], bits: bytes, keys: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    flat = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
    return np.split(flat, np.cumsum(sizes)[:-1]), np.frombuffer(keys, "<i8")


def hash_shards(keys: DataFrame) -> DataFrame:
    """One minimal perfect hash per shard of the distinct keys (columns ``shard`` and ``key``): bits per level, keys in order."""
    return keys.groupBy("shard").applyInArrow(_hash_shard, SHARD)


def _dense(key: tuple[pa.Scalar, ...], table: pa.Table, shard: pa.Table) -> pa.Table:
    (row,) = shard.to_pylist()
    lookup = PerfectHash.of([shard_hash(row["sizes"], row["bits"], row["keys"])])
    at = lookup.find(table.column("key").to_numpy())
    if (at < 0).any():
        raise ValueError("a pair is missing from the hash of its shard")
    vector = np.zeros(len(lookup.keys), np.int64)
    np.add.at(vector, at, table.column("n").to_numpy())
    return _vector(row["shard"], key[1].as_py(), vector)


def _vector(shard: int, node: int, vector: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "shard": pa.array([shard], pa.int64()),
            "node": pa.array([node], pa.int64()),
            "counts": pa.array([vector.astype("<i8").tobytes()], pa.binary()),
        }
    )


def _sum_vectors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_py(), "<i8") for v in table.column("counts"))
    return _vector(key[0].as_py(), key[1].as_py(), total)


def count_tree(partial: DataFrame, shards: DataFrame, tasks: int) -> DataFrame:
    """(shard, counts): the counts of all tasks in the order of each shard's hash.

    Up to FAN tasks make one dense vector per shard; vectors are summed FAN at a time.
    """
    nodes = -(-tasks // FAN)
    leaves = partial.select("shard", F.floor(F.col("task") / FAN).alias("node"), "key", "n")
    copies = shards.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nodes - 1).cast("long"))))
    present = leaves.select("shard", "node").distinct()
    kind = "shard long, node long, counts binary"
    vectors = (
        leaves.groupBy("shard", "node").cogroup(copies.join(present, ["shard", "node"]).groupBy("shard", "node")).applyInArrow(_dense, kind)
    )
    while nodes > 1:
        nodes = -(-nodes // FAN)
        parents = vectors.select("shard", F.floor(F.col("node") / FAN).alias("node"), "counts")
        vectors = parents.groupBy("shard", "node").applyInArrow(_sum_vectors, kind)
    return vectors.select("shard", "counts")


PAIRS = "key long, n long"


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
            arrays = [pa.array(np.frombuffer(x.as_py(), "<i8")) for x in (keys, counts)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n"])


@dataclass
class PairTable:
    """Counts by pair, and the highest count of each A id, for the second pass."""

    lookup: PerfectHash
    shards: int
    counts: np.ndarray
    best: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self.lookup.find(keys, keys % self.shards)


def count_pairs(docs: DataFrame, aligner: Aligner) -> tuple[DataFrame, DataFrame, int, int]:
    """The pairs of all documents: hashed shards with their counts, (key, n) rows, how many shards and pairs."""
    partial = written(pair_counts(docs, aligner), "pairs")
    keys = written(partial.select("key").distinct(), "keys")
    tasks, pairs = partial.agg(F.coalesce(F.max("task"), F.lit(0))).first()[0] + 1, keys.count()
    shards = max(1, -(-pairs // SHARD_KEYS))
    shard = F.col("key") % shards
    hashed = written(hash_shards(keys.withColumn("shard", shard)), "shards")
    sums = count_tree(partial.withColumn("shard", shard), hashed, tasks)
    table = written(hashed.join(sums, "shard"), "counts")
    return table, table.select("keys", "counts").mapInArrow(_pairs, PAIRS), shards, pairs


def shipped(table: DataFrame, rows: DataFrame, shards: int, pairs: int, a_ids: int, width: int, bound: int) -> PairTable:
    """The counts that go to every task: of all pairs if they are at most ``bound``, else of the most frequent ones."""
    best = np.zeros(a_ids, np.int64)
    # One row per A id at most.
    for row in rows.groupBy(F.floor(F.col("key") / width).alias("a")).agg(F.max("n").alias("n")).collect():
        best[row.a] = row.n
    if pairs > bound:
        # Pairs per power of two of their count: at most 64 rows.
        power = F.floor(F.log2("n")).cast("int")
        above, least = 0, 64
        for row in sorted(rows.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect(), reverse=True):
            above += row.n
            if above > bound:
                break
            least = row.p
        frequent = rows.where(power >= least)
        table = hash_shards(frequent.withColumn("shard", F.col("key") % shards))
        n_of = frequent.toArrow()
    found = sorted(table.collect(), key=lambda r: r.shard)
    empty = ([np.zeros(0, bool)], np.zeros(0, np.int64))
    by_shard = {r.shard: shard_hash(r.sizes, r.bits, r.keys) for r in found}
    lookup = PerfectHash.of([by_shard.get(i, empty) for i in range(shards)])
    if pairs <= bound:
        counts = np.concatenate([np.frombuffer(r.counts, "<i8") for r in found] or [np.zeros(0, np.int64)])
    else:
        counts = np.zeros(len(lookup.keys), np.int64)
        keys, times = (n_of.column(c).to_numpy() for c in ("key", "n"))
        counts[lookup.find(keys, keys % shards)] = times
    return PairTable(lookup, shards, counts, best)


def align_tokens(
    docs: DataFrame,
    a: BytePairs,
    b: Pieces,
    with_groups: bool = True,
    text_col: str = "text",
    max_shipped: int = MAX_SHIPPED,
) -> DataFrame:
    """The table without its text and with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups``.

    A space and the text are encoded by both tokenizers. A group ends where tokens of both
    end; ``groups`` writes them as ``a1,a2|b1;a3|b2``. Links are the pairs of an A and a B
    token whose bytes overlap; the count of an id pair is the number of rows that hold it
    linked. ``n_best`` counts the links whose count is the highest of their A id, ties
    included, ``count_sum`` sums the counts of all links. If the table has one of these
    names, underscores are added.

    Texts that are null, empty, or whose tokens do not give back their bytes have zeros and
    an empty ``groups``, and add no count. Every row is a document, repeated ones too. An
    empty table gives an empty table. Texts of any length are read whole, in windows cut at
    single blanks; a stretch without one is encoded at once.

    At most ``max_shipped`` counts go to every task; if there are more pairs, the most
    frequent ones do, and the links of the others are joined with their counts.
    """
    aligner = Aligner(a, b, with_groups)
    width = aligner.width
    slim = docs.select(F.col(text_col).alias("text"))
    table, rows, shards, pairs = count_pairs(slim, Aligner(a, b, with_groups=False))
    known = shipped(table, rows, shards, pairs, len(aligner.a_bytes), width, max_shipped)
    whole = pairs <= max_shipped
    rest = [c for c in docs.columns if c != text_col]
    names = [free_name(docs, c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")]
    schema = docs.select(*rest).schema
    for name in names[:-1]:
        schema = schema.add(name, "long", False)
    schema = schema.add(names[-1], "string", False)
    links = T.ArrayType(T.LongType(), False)
    other, times_of_other, place = (free_name(docs, c) for c in ("other_links", "other_times", "aligned_place"))
    if not whole:
        schema = schema.add(other, links, False).add(times_of_other, links, False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            sums = np.zeros((6, batch.num_rows), np.int64)
            groups, left = [""] * batch.num_rows, [([], [])] * batch.num_rows
            for i, n_a, n_b, n_groups, keys, times, text in aligned_rows(aligner, batch.column(text_col).to_pylist()):
                at = known.find(keys)
                n = known.counts[at[at >= 0]] if len(known.counts) else np.empty(0, np.int64)
                hit, seen = keys[at >= 0], times[at >= 0]
                sums[:, i] = n_a, n_b, n_groups, times.sum(), seen[n == known.best[hit // width]].sum(), (seen * n).sum()
                groups[i] = text
                if len(hit) < len(keys):
                    if whole:
                        raise ValueError("a pair was not counted")
                    left[i] = (keys[at < 0].tolist(), times[at < 0].tolist())
            columns = [*(batch.column(c) for c in rest), *map(pa.array, sums), pa.array(groups, pa.string())]
            if not whole:
                columns += [pa.array([x[i] for x in left], pa.list_(pa.int64())) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = docs.select(*rest, text_col).mapInArrow(run, schema)
    if whole:
        return found
    found = written(found.withColumn(place, F.monotonically_increasing_id()), "aligned")
    a_of = F.floor(F.col("key") / width)
    highest = rows.groupBy(a_of.alias("a")).agg(F.max("n").alias("highest"))
    judged = rows.withColumn("a", a_of).join(highest, "a").select("key", "n", (F.col("n") == F.col("highest")).alias("best"))
    open_links = found.select(F.col(place).alias("place"), F.explode(F.arrays_zip(F.col(other).alias("key"), F.col(times_of_other).alias("times"))).alias("l"))
    late = (
        open_links.select("place", "l.key", "l.times")
        .join(judged, "key")
        .groupBy("place")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("late_best"), F.sum(F.col("times") * F.col("n")).alias("late_sum"))
    )
    late_names = {c: free_name(found, c) for c in ("place", "late_best", "late_sum")}
    late = late.withColumnsRenamed(late_names)
    joined = found.join(late, F.col(place) == F.col(late_names["place"]), "left")
    extra = {names[4]: late_names["late_best"], names[5]: late_names["late_sum"]}
    return joined.select(
        *[(F.col(c) + F.coalesce(F.col(extra[c]), F.lit(0))).alias(c) if c in extra else F.col(c) for c in [*rest, *names]]
    )
