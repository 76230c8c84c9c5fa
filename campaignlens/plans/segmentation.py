"""From contact rows to labelled segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from campaignlens.operators import prep, segments
from campaignlens.session import written


def cluster_input(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Key and scaled feature vector of every row; categories enter by their codes."""
    dictionary = prep.fit_label_dictionary(df, categorical)
    coded = prep.encode(df.select(key, *numeric, *categorical), dictionary, categorical)
    cols = [*numeric, *categorical]
    (scaled,) = prep.standardize(coded, [], cols)
    return prep.assemble(scaled, cols).select(key, "features")


def segment(
    df: DataFrame,
    key: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    ks: Sequence[int] = range(2, 11),
    starts: int = 10,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """The sweep over k, and the rows with the cluster of the best k."""
    df = written(df, "segment-input")
    vectors = cluster_input(df, key, numeric, categorical)
    sweep, models = segments.sweep_models(vectors, ks, "features", starts, seed, max_iter=300)
    k = segments.choose_k(sweep).head()["k"]
    assigned = segments.assign_clusters(models[k], vectors).select(key, "cluster")
    return sweep, df.join(assigned, key)
