"""Synthetic minority rows between near neighbours (Chawla et al., 2002)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from campaignlens.functions.draws import draw_unit
from campaignlens.operators.neighbors import BLOCK, nearest
from campaignlens.operators.prep import first_by_draw


def smote(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    label: str,
    minority: int = 1,
    k: int = 5,
    seed: int = 42,
    block: int = BLOCK,
    parents: bool = False,
) -> DataFrame:
    """The rows of ``df`` and synthetic minority rows until that class has as many as the largest one.

    Every minority row gives the same number of synthetic rows, give or take one,
    each on the line to one of its k nearest minority rows. Synthetic rows have a
    null key and ``synthetic`` set. With ``parents`` they carry the keys of the two rows that
    they lie between, in ``parent`` and ``neighbour``, which are null in the rows of ``df``.
    """
    minor = df.filter(F.col(label) == minority)
    sizes = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    counts = sizes.agg(
        F.coalesce(F.sum(F.when(F.col("class") == minority, F.col("n"))), F.lit(0)).alias("few"),
        F.coalesce(F.max("n"), F.lit(0)).alias("many"),
    ).head()
    own = [*features, label]
    types = dict(df.dtypes)
    none = [F.lit(None).cast(types[key]).alias(c) for c in ("parent", "neighbour")] if parents else []
    kept = df.select(key, *own, F.lit(False).alias("synthetic"), *none)
    need = counts["many"] - counts["few"]
    if need <= 0 or counts["few"] < 2:
        return kept
    each, odd = divmod(need, counts["few"])

    vectors = minor.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("_v"))
    found = nearest(vectors, vectors, k + 1, key, "_v", block=block).filter(F.col("query") != F.col("neighbour"))
    order = W.partitionBy("query").orderBy("distance", "neighbour")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    known = F.max("rank").over(W.partitionBy("query"))
    found = found.select("query", "neighbour", "rank", known.alias("known"))

    rounds = minor.select(key).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(each))))
    extra = first_by_draw(minor.select(key), lambda classes: F.lit(odd), key, seed).withColumn("copy", F.lit(each))
    rounds = rounds.filter(F.col("copy") < each).unionByName(extra)
    tag = F.concat_ws("/", F.col(key).cast("string"), F.col("copy").cast("string"))
    rounds = rounds.withColumn("_tag", tag)
    rounds = rounds.withColumn("_pick", draw_unit("_tag", seed + 1)).withColumn("_gap", draw_unit("_tag", seed + 2))

    chosen = rounds.join(found, F.col(key) == F.col("query")).filter(
        F.col("rank") == F.floor(F.col("_pick") * F.col("known")) + 1
    )
    there = vectors.select(F.col(key).alias("_nk"), F.col("_v").alias("_nv"))
    made = chosen.select(key, "neighbour", "_gap").join(vectors, key).join(there, F.col("neighbour") == F.col("_nk"))
    mixed = [
        (F.col("_v")[i] + F.col("_gap") * (F.col("_nv")[i] - F.col("_v")[i])).alias(c) for i, c in enumerate(features)
    ]
    synthetic = made.select(
        F.lit(None).cast(types[key]).alias(key),
        *mixed,
        F.lit(minority).cast(types[label]).alias(label),
        F.lit(True).alias("synthetic"),
        *([F.col(key).alias("parent"), "neighbour"] if parents else []),
    )
    kept = kept.withColumns({c: F.col(c).cast("double") for c in features})
    return kept.unionByName(synthetic)
