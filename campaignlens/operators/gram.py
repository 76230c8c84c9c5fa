"""Correlations of many columns from one pass: mergeable sums of products.

Every task turns its batches into arrays and adds up, for each pair of columns, the rows
where both are present, their sums, squares and products, as five matrix products per
batch. Values are taken relative to the task's first value of their column, so that large
offsets cancel; states with other origins are moved when they are merged. States are cut
into strips of columns and merged in a tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.functions.scalars import number

CELLS = 1 << 20  # numbers of a batch worked at a time
STRIP = 64  # left columns of a strip
TREE = (4096, 64, 1)  # nodes per level; a strip's states meet at their task modulo these
SPREAD = 1e-12  # a variance below this share of the mean square about the origin is rounding

# Matrices of a state, left columns x right columns, over the rows where both are present:
# rows, sums and squares of the left, the same of the right, products.
ROWS, LEFT, LEFT2, RIGHT, RIGHT2, BOTH = range(6)


def batch_state(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The six matrices of a batch (NaN is missing) about the origins ``a`` and ``b``."""
    m, n = ~np.isnan(left), ~np.isnan(right)
    x, y = np.where(m, left - a, 0.0), np.where(n, right - b, 0.0)
    m, n = m.astype(float), n.astype(float)
    return np.stack([m.T @ n, x.T @ n, (x * x).T @ n, m.T @ y, m.T @ (y * y), x.T @ y])


def moved(state: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state about origins that lie ``a`` and ``b`` below its own."""
    n, x, x2, y, y2, xy = state
    a, b = a[:, None], b[None, :]
    return np.stack([n, x + n * a, x2 + 2 * a * x + n * a * a, y + n * b, y2 + 2 * b * y + n * b * b, xy + a * y + b * x + n * a * b])


def correlations_of(state: np.ndarray) -> np.ndarray:
    """Pearson correlations, NaN without rows or spread."""
    n, x, x2, y, y2, xy = state
    with np.errstate(divide="ignore", invalid="ignore"):
        spread_x, spread_y = x2 - x * x / n, y2 - y * y / n
        r = (xy - x * y / n) / np.sqrt(spread_x * spread_y)
        r[(spread_x <= SPREAD * x2) | (spread_y <= SPREAD * y2)] = np.nan
    return np.clip(r, -1.0, 1.0)


def _packed(task: int, strip: int, a: np.ndarray, b: np.ndarray, state: np.ndarray) -> dict:
    return {"task": task, "strip": strip, "a": a.tobytes(), "b": b.tobytes(), "state": state.tobytes()}


STATE = "task long, strip long, a binary, b binary, state binary"
_STATE = pa.schema([("task", pa.int64()), ("strip", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("state", pa.binary())])


def _partial_states(left: int, right: int, same: bool):
    """Per task one row per strip; an origin of NaN stands for a column without a value yet."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, state = np.full(left, np.nan), np.full(right, np.nan), np.zeros((6, left, right))
        for batch in batches:
            step = max(1, CELLS // max(1, batch.num_columns))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                values = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype(float, copy=False)
                x, y = (values, values) if same else (values[:, :left], values[:, left:])
                for origin, z in ((a, x), (b, y)):
                    for j in np.flatnonzero(np.isnan(origin)):
                        present = z[~np.isnan(z[:, j]), j]
                        if len(present):
                            origin[j] = present[0]
                state += batch_state(x, y, np.nan_to_num(a), np.nan_to_num(b))
        task = TaskContext.get().partitionId()
        rows = [_packed(task, i // STRIP, a[i : i + STRIP], b, state[:, i : i + STRIP]) for i in range(0, left, STRIP)]
        yield pa.RecordBatch.from_pylist(rows, schema=_STATE)

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, total = None, None, None
    for column in table.select(["a", "b", "state"]).to_batches():
        for x, y, z in zip(*(c.to_pylist() for c in column.columns), strict=True):
            own_a, own_b = np.frombuffer(x), np.frombuffer(y)
            state = np.frombuffer(z).reshape(6, len(own_a), len(own_b))
            if total is None:
                a, b, total = own_a.copy(), own_b.copy(), state.copy()
                continue
            for origin, own in ((a, own_a), (b, own_b)):
                unset = np.isnan(origin)
                origin[unset] = own[unset]
            total += moved(state, np.nan_to_num(own_a - a), np.nan_to_num(own_b - b))
    return a, b, total


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return pa.Table.from_pylist([_packed(key[1].as_py(), key[0].as_py(), *_merged(table))], schema=_STATE)


def _finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    r = correlations_of(_merged(table)[2])
    i, j = (x.ravel() for x in np.indices(r.shape))
    r = r.ravel()
    return pa.table({"i": pa.array(i + key[0].as_py() * STRIP), "j": pa.array(j), "r": pa.array(r, mask=np.isnan(r))})


def cross_correlations(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(f1, f2, i, j, r)``: Pearson correlation of every left column with every right one.

    ``i`` and ``j`` are their places in the lists; without ``right`` the left columns meet
    each other. A pair's rows are those where both are present; r is null without spread.
    The rows are read once whatever the number of columns; a task holds six matrices of
    left x right numbers. An empty table gives a null per pair.
    """
    same = right is None
    right = list(left) if same else list(right)
    left, types = list(left), dict(df.dtypes)
    columns = left if same else [*left, *right]
    slim = df.select(*[number(c, types[c]).alias(f"c{k}") for k, c in enumerate(columns)])
    states = slim.mapInArrow(_partial_states(len(left), len(right), same), STATE)
    for nodes in TREE[:-1]:
        states = states.withColumn("task", F.col("task") % nodes).groupBy("strip", "task").applyInArrow(_merge, STATE)
    found = states.groupBy("strip").applyInArrow(_finish, "i long, j long, r double")
    firsts, seconds = (F.array(*[F.lit(c) for c in names]) for names in (left, right))
    return found.select(F.get(firsts, F.col("i").cast("int")).alias("f1"), F.get(seconds, F.col("j").cast("int")).alias("f2"), "i", "j", "r")
