from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from campaignlens.operators import means, passes


def sets_of(rng, width, sizes):
    return [rng.normal(size=(k, width)) for k in sizes]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_step_adds_up_each_row_at_its_nearest_centre(kind):
    rng = np.random.default_rng(1)
    x, sets = rng.normal(size=(700, 3)), sets_of(rng, 3, [2, 2, 5, 1, 4, 4])
    # Equally near centres: the first has the row.
    sets.append(np.repeat(x[:1], 3, axis=0))
    got, at = means._step(x, sets, kind), 0
    for centres in sets:
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(len(centres)):
            want = [*x[near == c].sum(axis=0), (near == c).sum()]
            assert got[at + c] == pytest.approx(want, abs=1e-3 if kind is np.float32 else 1e-9)
        at += len(centres)


def test_step_holds_the_distances_of_a_few_rows():
    """A block's distances to the centres of a sweep were held at once, 8.8 MB, more than a core's cache; single ones of a few rows are 0.6 MB."""
    rng = np.random.default_rng(2)
    x, sets = rng.normal(size=(passes.ROWS, 11)), sets_of(rng, 11, [k for k in range(2, 11) for _ in range(10)])
    means._step(x, sets, np.float32)
    tracemalloc.start()
    means._step(x, sets, np.float32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e6


@pytest.mark.parametrize("offset, scale", [(0.0, 1.0), (1e6, 1.0), (-1e9, 1.0), (0.0, 1e-6), (0.0, 1e20)])
def test_centres_settle_in_doubles(spark, offset, scale):
    """Steps begin in single precision; the centres are still fixed points of steps in doubles, wherever the rows lie."""
    rng = np.random.default_rng(3)
    rows = offset + scale * (rng.normal(size=(900, 2)) + 9 * np.array([[i % 2, i % 3 == 0] for i in range(900)]))
    blocks = passes.Blocks(spark.createDataFrame([(r.tolist(),) for r in rows], "x array<double>").repartition(2), "x")
    try:
        found = means.fit_many(blocks, [(k, s) for k in (1, 4) for s in range(4)], 100)
    finally:
        blocks.drop()
    for m in found:
        # About the rows' mean, where doubles have digits left.
        points, centres = rows - rows.mean(axis=0), m.centres - rows.mean(axis=0)
        away = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        again = np.array([points[away.argmin(axis=1) == c].mean(axis=0) for c in range(len(centres))])
        assert np.abs(again - centres).max() <= max(means.TOLERANCE * 3, 1e-6 * scale) and m.cost == pytest.approx(away.min(axis=1).sum(), rel=1e-6)
    assert min(m.cost for m in found[4:]) < 2200 * scale**2


def test_last_step_is_in_doubles(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(500, 2))
    blocks = passes.Blocks(spark.createDataFrame([(r.tolist(),) for r in rows], "x array<double>").coalesce(1), "x")
    try:
        for steps in (0, 1, 2, 5):
            found = means.fit_many(blocks, [(4, 1)], steps)[0]
            assert found.iterations <= steps
            before = means.fit_many(blocks, [(4, 1)], steps - 1)[0] if steps else None
            if before and found.iterations == steps:
                near = ((rows[:, None] - before.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
                want = np.array([rows[near == c].mean(axis=0) for c in range(4)])
                assert np.abs(found.centres - want).max() < 1e-6
    finally:
        blocks.drop()
