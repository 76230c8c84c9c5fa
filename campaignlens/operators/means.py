"""k-means from many starts at once: a pass over the rows serves every start and every k that has not converged.

The steps are MLlib's: k-means|| (Bahmani et al., 2012) with two rounds chooses the first centres, Lloyd's
iterations follow until no centre moves further than TOLERANCE. MLlib runs a job per start and iteration,
which for a sweep of 9 k with 10 starts is thousands of jobs; here there are as many as the longest start needs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from campaignlens.operators.passes import Blocks

TOLERANCE = 1e-4
ROUNDS = 2
FIRST = 20  # rows drawn per start for its first centre
LOCAL_STEPS = 30
FEW = 256  # rows whose distances are taken at a time
LARGE = 1e30


@dataclass
class Means:
    centres: np.ndarray
    cost: float
    iterations: int


def _spans(sets: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    ends = np.cumsum([0, *(len(c) for c in sets)])
    return list(zip(ends[:-1].tolist(), ends[1:].tolist()))


def _nearest(rows: np.ndarray, centres: np.ndarray, spans: Sequence[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per set of centres the place of each row's nearest one, and its squared distance."""
    away = (centres**2).sum(axis=1)[:, None] - 2.0 * (centres @ rows.T)
    own, every = (rows**2).sum(axis=1), np.arange(len(rows))
    for a, b in spans:
        at = away[a:b].argmin(axis=0) + a
        yield at, np.maximum(away[at, every] + own, 0)


def _local(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of weighted points on the driver: k-means++ and a few iterations."""
    rng = np.random.default_rng(seed)
    chosen = points[[rng.choice(len(points), p=weights / weights.sum())]]
    while len(chosen) < k:
        gap = ((points[:, None] - chosen[None]) ** 2).sum(axis=2).min(axis=1) * weights
        if not gap.sum() > 0:
            break
        chosen = np.vstack([chosen, points[rng.choice(len(points), p=gap / gap.sum())]])
    last = None
    for _ in range(LOCAL_STEPS):
        at = ((points[:, None] - chosen[None]) ** 2).sum(axis=2).argmin(axis=1)
        if last is not None and (at == last).all():
            break
        last = at
        for c in np.unique(at):
            mine = at == c
            chosen[c] = np.average(points[mine], axis=0, weights=weights[mine]) if weights[mine].sum() > 0 else points[rng.integers(len(points))]
    return chosen


def first_centres(blocks: Blocks, starts: Sequence[tuple[int, int]], rows: int, seed: int) -> list[np.ndarray]:
    """The first centres of each start ``(k, seed)``: k or, of fewer distinct candidates, all of them."""
    share = min(1.0, FIRST * len(starts) / rows)
    some = np.vstack([r for _, r in blocks.drawn(lambda x, rng: [(0, x[rng.random(len(x)) < share])], seed)] or [blocks.first])
    sets = [some[[np.random.default_rng(own).integers(len(some))]] for _, own in starts]
    for turn in range(ROUNDS):
        centres, spans = np.vstack(sets), _spans(sets)
        costs = blocks.total(lambda x: np.array([d.sum() for _, d in _nearest(x, centres, spans)]), len(sets))
        rates = [2.0 * k / c if c > 0 else 0.0 for (k, _), c in zip(starts, costs)]

        def draw(x: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[int, np.ndarray]]:
            for i, (_, d) in enumerate(_nearest(x, centres, spans)):
                yield i, x[rng.random(len(x)) < rates[i] * d]

        for i, found in blocks.drawn(draw, seed + turn + 1):
            sets[i] = np.vstack([sets[i], found])
    sets = [np.unique(s, axis=0) for s in sets]
    centres, spans = np.vstack(sets), _spans(sets)

    def counts(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(at, minlength=len(centres)) for at, _ in _nearest(x, centres, spans)).astype(float)

    weights = blocks.total(counts, len(centres))
    return [s if len(s) <= k else _local(s, weights[a:b], k, own) for s, (a, b), (k, own) in zip(sets, spans, starts)]


def _runs(sets: Sequence[np.ndarray]) -> list[tuple[int, int, int]]:
    """First centre, end and size of every run of sets of one size."""
    out: list[tuple[int, int, int]] = []
    for (a, b), c in zip(_spans(sets), sets):
        if out and out[-1][2] == len(c):
            out[-1] = (out[-1][0], b, len(c))
        else:
            out.append((a, b, len(c)))
    return out


def _step(x: np.ndarray, sets: Sequence[np.ndarray], kind: type) -> np.ndarray:
    """Per centre the sum of the rows that are nearest to it in its set, then their number; distances are of this kind of float.

    A few rows at a time, so that their distances stay in a core's cache; each few are added up in doubles.
    """
    centres, runs = np.vstack(sets), _runs(sets)
    shares = np.column_stack([-2.0 * centres, (centres**2).sum(axis=1)]).astype(kind)
    with_one = np.column_stack([x, np.ones(len(x))]).astype(kind)
    out, spans = np.zeros(shares.shape), _spans(sets)
    firsts = [a for a, _ in spans]
    for i in range(0, len(x), FEW):
        rows = with_one[i : i + FEW]
        member = shares @ rows.T
        for a, b, k in runs:
            away = member[a:b].reshape(-1, k, len(rows))
            np.less_equal(away, away.min(axis=1, keepdims=True), out=away, casting="unsafe")
        found = member @ rows
        # A row between equally near centres belongs to the first of them alone.
        for j in np.flatnonzero(np.add.reduceat(found[:, -1], firsts) != len(rows)):
            a, b = spans[j]
            member[a:b] = member[a:b].cumsum(axis=0).cumsum(axis=0) == 1
            found[a:b] = member[a:b] @ rows
        out += found
    return out


def fit_many(blocks: Blocks, starts: Sequence[tuple[int, int]], max_iter: int, seed: int = 42) -> list[Means]:
    """The fitted centres of each start ``(k, seed)``, with the sum of squared distances to them.

    A start's steps are first taken with distances of single precision, about the mean of the rows; when those settle,
    or the last step is left, steps with distances of doubles follow until these settle too.
    """
    width = blocks.width
    found = blocks.total(lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]), 1 + 2 * width)
    rows = int(found[0])
    if not rows:
        raise ValueError("k-means needs rows")
    mean = found[1 : 1 + width] / rows
    sets = first_centres(blocks, starts, rows, seed)
    # Squares of larger numbers are none in single precision.
    rough = [bool((found[1 + width :] < LARGE).all()) and max_iter > 1] * len(sets)
    steps, going = [0] * len(sets), list(range(len(sets))) if max_iter > 0 else []
    while going:
        going.sort(key=lambda i: (not rough[i], len(sets[i]), i))
        quick, fine = ([sets[i] - mean for i in going if rough[i] == r] for r in (True, False))

        def sums(x: np.ndarray) -> np.ndarray:
            x = x - mean
            return np.concatenate([_step(x, c, kind).ravel() for c, kind in ((quick, np.float32), (fine, np.float64)) if c])

        spans = _spans([*quick, *fine])
        total = blocks.total(sums, spans[-1][1] * (width + 1)).reshape(-1, width + 1)
        centres = np.vstack([sets[i] for i in going])
        moved = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1) + mean, centres)
        far = ((moved - centres) ** 2).sum(axis=1) > TOLERANCE**2
        still = []
        for i, (a, b) in zip(going, spans):
            sets[i], steps[i] = moved[a:b], steps[i] + 1
            if (rough[i] or far[a:b].any()) and steps[i] < max_iter:
                still.append(i)
            rough[i] = rough[i] and bool(far[a:b].any()) and steps[i] < max_iter - 1
        going = still
    centres, spans = np.vstack(sets) - mean, _spans(sets)

    def costs(x: np.ndarray) -> np.ndarray:
        x = x - mean
        return np.array([((x - centres[at]) ** 2).sum() for at, _ in _nearest(x, centres, spans)])

    found = blocks.total(costs, len(sets))
    return [Means(c, float(cost), n) for c, cost, n in zip(sets, found, steps)]
