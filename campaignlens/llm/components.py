"""Connected components of a link table, by alternating star contractions.

Each round hangs every node's larger neighbours on its smallest one, then every node's
smaller neighbours; the links become stars around the smallest node of a component in
O(log^2 n) rounds. A round is two aggregates and two joins over the links, with partial
minima, so a node with very many links is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.session import discard, written


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u and v, any order): root is the smallest node reachable.

    Links of a node with itself and repeated links are ignored. The links of each round
    are written to the shared folder, so the plan does not grow and a lost executor
    repeats one round at most. The driver sees a count and a checksum per round.
    """
    stars = written(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    state = _state(stars)
    while state[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
            .select("s.*")
            .where("u <> v")
            .distinct()
        )
        done, stars = stars, written(small, "links")
        discard(done)
        before, state = state, _state(stars)
        if state == before:
            break
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
