"""Approximate nearest neighbours: a random-projection hash index whose candidates are verified.

Every row is indexed. A hash puts a vector into the cells of several tables; a query is compared,
by exact distance, with all rows that share one of its cells, so what is found is right and what
is missed lies in none of them. The width of the cells and the projections per table follow from
the distances of a bounded, drawn set of queries to their true neighbours, so that the expected
recall is the one asked for (Datar et al., 2004). Cells with many rows or queries are cut into
chunks; nothing is capped. Vectors travel once per table and chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from campaignlens.functions.draws import draw
from campaignlens.operators.neighbors import BLOCK, FOUND, best_of_chunk, k_best, matrix
from campaignlens.operators.pivots import blocks, exact, squares
from campaignlens.session import written

TABLES = 8
RECALL = 0.95
FIT_QUERIES = 200
FIT_ROWS = 500
MOST_PROJECTIONS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def meet(distance: np.ndarray, width: float, projections: int, tables: int) -> np.ndarray:
    """Probability that two vectors at a distance share a cell of some table."""
    c = width / np.maximum(distance, 1e-300)
    tail = np.array([math.erfc(x / math.sqrt(2)) for x in c])
    one = 1 - tail - np.sqrt(2 / math.pi) / c * -np.expm1(-(np.minimum(c, 1e100) ** 2) / 2)
    return 1 - (1 - np.clip(one, 0, 1) ** projections) ** tables


def choose(near: np.ndarray, far: np.ndarray, tables: int, recall: float) -> tuple[float, int]:
    """Cell width and projections per table that reach the recall at the near distances and meet fewest far ones."""
    near, far = (np.quantile(x[x > 0], np.linspace(0, 1, 257)) if (x > 0).any() else np.ones(1) for x in (near, far))
    best = None
    for projections in range(1, MOST_PROJECTIONS + 1):
        low, high = 0.0, float(near.max())
        while meet(near, high, projections, tables).mean() < recall:
            high *= 2
        for _ in range(30):
            middle = (low + high) / 2
            low, high = (low, middle) if meet(near, middle, projections, tables).mean() >= recall else (middle, high)
        share = meet(far, high, projections, tables).mean()
        if best is None or share < best[0] * 0.98:
            best = (share, high, projections)
    return best[1], best[2]


class Hasher:
    """Cell codes of vectors, one per table; seeded, so that every task and retry gives the same."""

    def __init__(self, dims: int, width: float, projections: int, tables: int, seed: int):
        draws = np.random.default_rng(seed)
        self.width, self.projections, self.tables = width, projections, tables
        self.lines = draws.normal(size=(dims, tables * projections))
        self.shift = draws.uniform(0, width, tables * projections)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), self.tables), np.int64)
        for part in blocks(len(rows), self.tables * self.projections):
            cells = np.floor((rows[part] @ self.lines + self.shift) / self.width).astype(np.int64).view(np.uint64)
            cells = cells.reshape(-1, self.tables, self.projections)
            code = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64) * _MIX, cells.shape[:2]).copy()
            for i in range(self.projections):
                code = (code ^ cells[:, :, i]) * _MIX
                code ^= code >> np.uint64(29)
            out[part] = code.view(np.int64)
        return out


def fit_hasher(train: DataFrame, queries: DataFrame, k: int, key: str, vector: str, tables: int, recall: float, seed: int) -> Hasher | None:
    """A hasher for the tables, from FIT_QUERIES drawn queries against all rows and FIT_ROWS drawn rows; None without rows."""
    double = F.col(vector).cast("array<double>").alias("v")
    some = [r["v"] for r in queries.orderBy(draw(key, seed)).select(double).limit(FIT_QUERIES).collect()]
    drawn = [r["v"] for r in train.orderBy(draw(key, seed)).select(double).limit(FIT_ROWS).collect()]
    if not some or not drawn:
        return None
    asked, others = np.array(some, np.float64), np.array(drawn, np.float64)

    def k_nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.full((len(asked), k), np.inf)
        for batch in batches:
            rows = matrix(batch["v"])
            for part in blocks(len(rows), len(asked)):
                found = np.sqrt(np.maximum(squares(asked, rows[part])[0], 0))
                held = np.partition(np.concatenate([held, found], axis=1), k - 1, axis=1)[:, :k]
        who, at = np.nonzero(np.isfinite(held))
        yield pd.DataFrame({"query": who, "distance": held[who, at]})

    order = W.partitionBy("query").orderBy("distance")
    nearest = train.select(double).mapInPandas(k_nearest, "query long, distance double")
    nearest = nearest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    near = np.array([r["distance"] for r in nearest.select("distance").collect()])  # k per drawn query
    far = np.concatenate([exact(others, np.broadcast_to(q, others.shape)) for q in asked])
    width, projections = choose(near, far, tables, recall)
    return Hasher(asked.shape[1], width, projections, tables, seed)


def nearest_hashed(
    train: DataFrame,
    queries: DataFrame,
    k: int,
    key: str,
    vector: str,
    label: str | None = None,
    tables: int = TABLES,
    recall: float = RECALL,
    seed: int = 42,
    block: int = BLOCK,
) -> DataFrame:
    """Rows ``(query, neighbour, label, distance, rank)``: the k nearest of the training rows that share a cell with a query.

    Distances are exact, equal ones go to the smaller key. ``recall`` is the expected share of the
    true neighbours; a query may have fewer than k. :func:`recall_of` measures it. ``key`` is a unique
    integer column of both tables, ``vector`` an array column without nulls.
    """
    hasher = fit_hasher(train, queries, k, key, vector, tables, recall, seed)
    if hasher is None:
        return train.sparkSession.createDataFrame([], f"{FOUND}, rank int")

    @F.pandas_udf("array<long>")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(hasher.codes(matrix(s))) if len(s) else [], dtype=object)

    def coded(df: DataFrame, name: str, *more: Column) -> DataFrame:
        slim = df.select(F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v"), *more)
        return written(slim.withColumn("codes", codes("v")), f"hashed-{name}")

    def cells(df: DataFrame, n: str) -> DataFrame:
        return df.select(F.explode("codes").alias("code")).groupBy("code").agg(F.ceil(F.count("*") / block).cast("int").alias(n))

    tag = F.col(label).cast("double") if label else F.lit(None).cast("double")
    rows, asked = coded(train, "neighbour", tag.alias("label")), coded(queries, "query")
    both = written(cells(rows, "row_parts").join(cells(asked, "query_parts"), "code"), "hashed-cells")
    # Small cells share a slot, so that a task step holds about a block of rows; a large cell has a step per pair of chunks.
    slots = max(1, -(-rows.count() * tables // block))
    slot = F.pmod(F.xxhash64("code"), F.lit(slots)).cast("int")

    def sent(df: DataFrame, name: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        opened = df.withColumn("code", F.explode("codes")).drop("codes").join(both, "code")
        opened = opened.withColumn(mine, F.pmod(F.xxhash64(name), own).cast("int"))
        return opened.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).withColumn("slot", slot).drop(own, other)

    left = sent(asked, "query", "query_parts", "row_parts", "query_part", "row_part")
    right = sent(rows, "neighbour", "row_parts", "query_parts", "row_part", "query_part")
    where = ["slot", "row_part", "query_part"]

    def compare(queries_in: pd.DataFrame, rows_in: pd.DataFrame) -> pd.DataFrame:
        found = []
        by_code = rows_in.groupby("code").indices
        for code, at in queries_in.groupby("code").indices.items():
            if code not in by_code:
                continue
            here, there = queries_in.iloc[at], rows_in.iloc[by_code[code]]
            asked, points, keys = matrix(here["v"]), matrix(there["v"]), there["neighbour"].to_numpy()
            tags = there["label"].to_numpy(dtype="float64", na_value=np.nan)
            who, place, dist = best_of_chunk(asked, points, keys, k)
            found.append(pd.DataFrame({"query": here["query"].to_numpy()[who], "neighbour": keys[place], "label": tags[place], "distance": dist}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "neighbour": [], "label": [], "distance": []})

    met = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInPandas(compare, FOUND)
    # A pair may meet in several tables. One shuffle, by query, serves both steps.
    once = met.repartition("query").groupBy("query", "neighbour").agg(F.max("label").alias("label"), F.min("distance").alias("distance"))
    return k_best(once, k)


def recall_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``(wanted, found, recall)``: how many of the true pairs (query, neighbour) are among the found ones."""
    have = found.select("query", "neighbour", F.lit(1).alias("hit"))
    counts = truth.select("query", "neighbour").join(have, ["query", "neighbour"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return counts.withColumn("recall", F.try_divide("found", "wanted"))
