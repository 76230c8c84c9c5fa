"""A small byte-level convolutional network in NumPy: training on a bounded sample, scoring of whole texts.

Two channels enter: the bytes, and for every byte how far back the eight bytes that start
there were last seen. Filters of eight bytes run over both, every four bytes. Their outputs
are max-pooled over cells of 256 bytes, neighbouring cells are max-pooled into overlapping
chunks, a dense layer describes each chunk, and the largest and the mean description of a
document's chunks give one probability. No byte of a text is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH, STRIDE, CELL = 8, 4, 256
PER_CELL = CELL // STRIDE
FAR = 1 << 16  # from this distance on, repeats are of one bucket
PIECE = 1 << 20  # bytes whose repeats are sorted at a time
HELD = 1 << 23  # grams of all pieces compared at a time
BUCKETS = 18
TAPS = (0, 4)  # where a filter looks at the repeat channel
BLOCK = 2048  # cells worked on at a time
_DISTANCE = np.minimum(np.log2(np.maximum(np.arange(FAR + 1), 1)).astype(np.uint8) + 1, BUCKETS - 1)


def repeats(data: np.ndarray, piece: int = PIECE, held: int = HELD) -> np.ndarray:
    """Per byte the log2 bucket of the distance to the last place with the same eight bytes; 0 if there is none.

    Exact at any length. Pieces are sorted by the whole gram, then the first place of a gram
    in a piece meets its last place in the pieces before; a text of more than ``held`` bytes
    is worked once for each of several classes of grams, so that memory stays bounded.
    """
    out = np.zeros(len(data), np.uint8)
    n = len(data) - 7
    classes = -(-n // held)
    for c in range(classes):
        found = []
        for start in range(0, n, piece):
            grams = np.lib.stride_tricks.sliding_window_view(data[start : start + piece + 7], 8)
            grams = np.ascontiguousarray(grams).view(np.uint64).ravel()
            own = np.arange(len(grams))
            if classes > 1:
                hashes = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                own = np.flatnonzero(hashes % np.uint64(classes) == c)
                grams = grams[own]
            order = np.argsort(grams, kind="stable")
            ordered, place = grams[order], start + own[order]
            same = ordered[1:] == ordered[:-1]
            out[place[1:][same]] = _DISTANCE[np.minimum(place[1:][same] - place[:-1][same], FAR)]
            if n > piece and len(grams):
                firsts, lasts = np.append(True, ~same), np.append(~same, True)
                found.append((ordered[firsts], place[firsts], place[lasts]))
        if len(found) > 1:
            grams, first, last = map(np.concatenate, zip(*found, strict=True))
            order = np.argsort(grams, kind="stable")
            same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
            later = first[order[same + 1]]
            out[later] = _DISTANCE[np.minimum(later - last[order[same]], FAR)]
    return out


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end, their repeats, and cells per text.

    A text starts after eight zeros, which the last filters of the text before it see, and
    is filled with zeros to whole cells.
    """
    cells = np.array([(len(t) + WIDTH + CELL - 1) // CELL for t in texts], np.int64)
    data = np.zeros(int(cells.sum()) * CELL + WIDTH, np.uint8)
    back = np.zeros_like(data)
    at = 0
    for text, n in zip(texts, cells.tolist(), strict=True):
        own = np.frombuffer(text, np.uint8)
        data[at + WIDTH : at + WIDTH + len(own)] = own
        back[at + WIDTH : at + WIDTH + len(own)] = repeats(own)
        at += n * CELL
    return data, back, cells


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """The parameters, all float32."""

    taps: np.ndarray  # WIDTH x 256 x filters
    back: np.ndarray  # len(TAPS) x BUCKETS x filters
    bias: np.ndarray
    dense: np.ndarray  # filters x hidden
    dense_bias: np.ndarray
    out: np.ndarray  # 2 x hidden: of the largest and of the mean
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, filters: int, hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def some(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            some(WIDTH, 256, filters, scale=0.15),
            some(len(TAPS), BUCKETS, filters, scale=0.15),
            np.zeros(filters, np.float32),
            some(filters, hidden, scale=filters**-0.5),
            np.zeros(hidden, np.float32),
            some(2, hidden, scale=hidden**-0.5),
            np.zeros(1, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.taps, self.back, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]

    def cells(self, data: np.ndarray, back: np.ndarray, where: bool = False):
        """The largest output of each filter in each cell, and on request its place in the buffer."""
        n = (len(data) - WIDTH) // CELL
        largest = np.empty((n, len(self.bias)), np.float32)
        place = np.empty((n, len(self.bias)), np.int64) if where else None
        for first in range(0, n, BLOCK):
            last = min(n, first + BLOCK)
            view = data[first * CELL : last * CELL + WIDTH]
            seen = back[first * CELL : last * CELL + WIDTH]
            size = (last - first) * CELL
            total = self.taps[0].take(view[:size:STRIDE], axis=0)
            for k in range(1, WIDTH):
                total += self.taps[k].take(view[k : k + size : STRIDE], axis=0)
            for k, tap in enumerate(TAPS):
                total += self.back[k].take(seen[tap : tap + size : STRIDE], axis=0)
            total = total.reshape(last - first, PER_CELL, -1)
            if where:
                best = total.argmax(axis=1)
                largest[first:last] = np.take_along_axis(total, best[:, None, :], 1)[:, 0]
                place[first:last] = (np.arange(first, last)[:, None] * PER_CELL + best) * STRIDE
            else:
                largest[first:last] = total.max(axis=1)
        return np.maximum(largest + self.bias, 0), place

    def forward(self, data: np.ndarray, back: np.ndarray, cells: np.ndarray, train: bool = False):
        pooled, place = self.cells(data, back, train)
        starts = np.concatenate(([0], np.cumsum(cells)[:-1]))
        following = np.minimum(np.arange(len(pooled)) + 1, np.repeat(starts + cells - 1, cells))
        second = pooled[following] > pooled  # which of its two cells gives a chunk its value
        chunks = np.where(second, pooled[following], pooled)
        hidden = np.maximum(chunks @ self.dense + self.dense_bias, 0)
        top = np.maximum.reduceat(hidden, starts, axis=0)
        mean = np.add.reduceat(hidden, starts, axis=0) / cells[:, None].astype(np.float32)
        score = sigmoid(top @ self.out[0] + mean @ self.out[1] + self.out_bias[0])
        return score, (pooled, place, starts, following, second, chunks, hidden, top, mean)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.forward(*padded(texts))[0].astype(np.float64)

    def gradients(self, data, back, cells, target, weight) -> list[np.ndarray]:
        score, (pooled, place, starts, following, second, chunks, hidden, top, mean) = self.forward(data, back, cells, True)
        d = ((score - target) * weight).astype(np.float32)
        out = np.stack([d @ top, d @ mean])
        d_hidden = np.repeat((d / cells)[:, None] * self.out[1], cells, axis=0).astype(np.float32)
        owner = np.repeat(np.arange(len(cells)), cells)
        is_top = hidden == top[owner]
        # Of equal largest chunks the first takes the gradient.
        firsts = is_top & (np.cumsum(is_top, axis=0) - np.where(starts[owner][:, None] > 0, np.cumsum(is_top, axis=0)[starts[owner] - 1], 0) == 1)
        d_hidden += np.where(firsts, (d[:, None] * self.out[0])[owner], 0)
        d_hidden *= hidden > 0
        dense = chunks.T @ d_hidden
        d_chunks = d_hidden @ self.dense.T
        d_pooled = np.where(second, 0, d_chunks)
        np.add.at(d_pooled, following, np.where(second, d_chunks, 0))
        d_pooled *= pooled > 0
        filters = len(self.bias)
        which = np.broadcast_to(np.arange(filters), place.shape)

        def table(rows: np.ndarray, size: int) -> np.ndarray:
            return np.bincount((rows.astype(np.int64) * filters + which).ravel(), d_pooled.ravel(), size * filters).reshape(size, filters)

        taps = np.stack([table(data[place + k], 256) for k in range(WIDTH)])
        seen = np.stack([table(back[place + tap], BUCKETS) for tap in TAPS])
        return [taps, seen, d_pooled.sum(0), dense, d_hidden.sum(0), out, np.array([d.sum()])]


def train(
    texts: list[bytes],
    labels: np.ndarray,
    weights: np.ndarray,
    filters: int = 16,
    hidden: int = 16,
    steps: int = 500,
    batch: int = 32,
    rate: float = 0.01,
    seed: int = 1,
) -> Network:
    """Adam on the weighted log loss, over a fixed number of batches drawn with a fixed seed.

    Without examples the network is a constant: the probability one half.
    """
    net = Network.fresh(filters, hidden, seed)
    if not texts:
        for p in net.parts():
            p[...] = 0
        return net
    rng = np.random.default_rng(seed)
    prepared = [padded([t]) for t in texts]
    share = np.clip(np.average(labels, weights=weights), 0.01, 0.99)
    net.out_bias[0] = np.log(share / (1 - share))
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    order, at = rng.permutation(len(texts)), 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(texts)), 0
        picked, at = order[at : at + batch], at + batch
        data = np.concatenate([prepared[i][0][:-WIDTH] for i in picked] + [np.zeros(WIDTH, np.uint8)])
        back = np.concatenate([prepared[i][1][:-WIDTH] for i in picked] + [np.zeros(WIDTH, np.uint8)])
        cells = np.concatenate([prepared[i][2] for i in picked])
        w = weights[picked] / weights[picked].sum()
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parts(), net.gradients(data, back, cells, labels[picked], w), first, second, strict=True):
            m += 0.1 * (g.astype(np.float32) - m)
            v += 0.01 * (g.astype(np.float32) ** 2 - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    # A distance that no example had, as in texts longer than all of them, counts as the next smaller one.
    seen = np.sum([np.bincount(back, minlength=BUCKETS) for _, back, _ in prepared], axis=0)
    for bucket in range(1, BUCKETS):
        if not seen[bucket]:
            net.back[:, bucket] = net.back[:, bucket - 1]
    return net
