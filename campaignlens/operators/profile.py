"""Table profiling: previews, structure, missing values, summaries, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from campaignlens.functions.draws import draw
from campaignlens.functions.moments import pearson, sample_kurtosis, sample_skewness, t_two_sided
from campaignlens.functions.scalars import indicator, is_missing, number, percent, ratio
from campaignlens.operators.gram import cross_correlations
from campaignlens.operators.prep import first_by_draw
from campaignlens.operators.quantiles import quantile_columns
from campaignlens.operators.sizing import small_side
from campaignlens.session import written

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def stacked(row: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row of equally shaped struct columns turned into one row per struct."""
    return row.select(*by, F.inline(F.array(*[F.col(f"`{n}`") for n in names])))


# Previews and samples


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(key).limit(n)


def preview_last(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The last n rows in key order."""
    return df.orderBy(F.col(key).desc()).limit(n)


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows drawn without replacement; the key must be unique.

    Small draws are a top-n; larger ones use a draw threshold and need no sort.
    """
    if n <= 10_000:
        return df.orderBy(draw(key, seed)).limit(n)
    return first_by_draw(df, lambda classes: F.lit(n), key, seed)


# Structure


def dataset_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def schema_table(df: DataFrame) -> DataFrame:
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def column_profile(df: DataFrame) -> DataFrame:
    """Non-missing rows and type per column, in one pass."""
    names = df.columns
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.when(~is_missing(c, t), 1)).alias("non_null"),
                F.lit(t).alias("type"),
            ).alias(c)
            for c, t in df.dtypes
        ]
    )
    return stacked(row, names)


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Column names of the ``numeric`` or ``text`` kind, in table order."""
    if kind == "numeric":
        return [c for c, t in df.dtypes if t.startswith(NUMERIC)]
    if kind == "text":
        return [c for c, t in df.dtypes if t == "string"]
    raise ValueError(f"unknown kind {kind!r}")


def distinct_levels(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct()


def between_open(df: DataFrame, c: str, lo: float, hi: float) -> DataFrame:
    """Rows strictly inside the interval."""
    return df.filter((F.col(c) > F.lit(lo)) & (F.col(c) < F.lit(hi)))


def share_where(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Rows that meet each predicate, as count and per cent, in one pass."""
    row = df.agg(
        *[
            F.struct(
                F.lit(name).alias("predicate"),
                F.count(F.when(p, 1)).alias("rows"),
                (F.avg(indicator(p)) * 100).alias("pct"),
            ).alias(name)
            for name, p in predicates.items()
        ]
    )
    return stacked(row, list(predicates))


# Data quality


def missing_counts(df: DataFrame) -> DataFrame:
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.when(is_missing(c, t), 1)).alias("missing_count"),
                F.count("*").alias("rows"),
            ).alias(c)
            for c, t in df.dtypes
        ]
    )
    return stacked(row, df.columns)


def missing_report(df: DataFrame) -> DataFrame:
    """Columns that have missing values, most affected first; empty when there are none."""
    return (
        missing_counts(df)
        .filter(F.col("missing_count") > 0)
        .select("column", "missing_count", percent(F.col("missing_count"), F.col("rows")).alias("missing_pct"))
        .orderBy(F.col("missing_count").desc(), "column")
    )


def completeness(df: DataFrame) -> DataFrame:
    total, cells = F.sum("missing_count"), F.sum("rows")
    return missing_counts(df).agg(
        total.alias("missing_total"), (F.lit(100.0) - percent(total, cells)).alias("completeness_pct")
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that equal an earlier row, nulls counted as equal.

    Only an 8-byte fingerprint per row is shuffled at first. Rows whose
    fingerprint is shared are then compared in full, so the count is exact.
    """
    marked = df.withColumn("_f", F.xxhash64(*df.columns))
    shared = marked.groupBy("_f").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("_f")
    suspects = marked.join(small_side(shared), "_f", "left_semi")
    copies = suspects.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


# Numeric summaries


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, optionally per group.

    The columns are written once; counts, moments and quantiles read that table.
    """
    df = written(df.select(*dict.fromkeys([*by, *cols])), "describe")
    types, by = dict(df.dtypes), list(by)
    row = df.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).alias(c)
            for c, v in ((c, number(c, types[c])) for c in cols)
        ]
    )
    quartiles = quantile_columns(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)
    out = _with_quantiles(stacked(row, cols, by), quartiles, by)
    return out.select(*by, "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def _with_quantiles(summary: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on the column name and the null-safe group."""
    keys = ["column", *by]
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    on = F.col("column") == F.col("_column")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return summary.join(found, on, "left").drop(*[f"_{k}" for k in keys])


def value_modes(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per column, the smallest of tied ones, with its count.

    Rows ``(by..., column, num, txt, rows)``: a number in ``num``, anything else as
    text in ``txt``. Values are counted before the choice, so no task holds them all.
    """
    types = dict(df.dtypes)
    numbers = [c for c in cols if types[c].startswith(NUMERIC)]
    texts = [c for c in cols if c not in numbers]
    parts = []
    if numbers:
        found = _modes(df, {c: number(c, types[c]) for c in numbers}, list(by))
        parts.append(found.select(*by, "column", F.col("v").alias("num"), F.lit(None).cast("string").alias("txt"), "rows"))
    if texts:
        found = _modes(df, {c: F.col(c).cast("string") for c in texts}, list(by))
        parts.append(found.select(*by, "column", F.lit(None).cast("double").alias("num"), F.col("v").alias("txt"), "rows"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _modes(df: DataFrame, values: dict[str, Column], by: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in values])
    entries = [F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values.values())]
    counted = (
        df.select(*by, F.inline(F.array(*entries)))
        .filter(F.col("v").isNotNull())
        .groupBy(*by, "i", "v")
        .agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), "v"))
    found = counted.groupBy(*by, "i").agg(best.alias("b"))
    return found.select(*by, names[F.col("i")].alias("column"), F.col("b.v").alias("v"), (-F.col("b.n")).alias("rows"))


def shape_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median, mode, skewness and kurtosis per numeric column; the columns are written once."""
    df = written(df.select(*dict.fromkeys(cols)), "shape")
    types = dict(df.dtypes)
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                sample_skewness(number(c, types[c])).alias("skewness"),
                sample_kurtosis(number(c, types[c])).alias("kurtosis"),
            ).alias(c)
            for c in cols
        ]
    )
    medians = quantile_columns(df, cols, {"median": 0.5})
    modes = value_modes(df, cols).select("column", F.col("num").alias("mode"))
    out = stacked(row, cols).join(medians, "column", "left").join(modes, "column", "left")
    return out.select("column", "median", "mode", "skewness", "kurtosis")


def range_mean_median(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Smallest, largest, mean and median per column, and the mean in units of 60; the columns are written once."""
    df = written(df.select(*dict.fromkeys([*by, *cols])), "range")
    types, by = dict(df.dtypes), list(by)
    row = df.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.avg(v).alias("mean"),
                (F.avg(v) / 60).alias("mean_per_60"),
            ).alias(c)
            for c, v in ((c, number(c, types[c])) for c in cols)
        ]
    )
    medians = quantile_columns(df, cols, {"median": 0.5}, by)
    out = _with_quantiles(stacked(row, cols, by), medians, by)
    return out.select(*by, "column", "min", "max", "mean", "median", "mean_per_60")


def class_center(df: DataFrame, cols: Sequence[str], label: str = "y") -> DataFrame:
    """Mean and median of each column for each class."""
    return range_mean_median(df, cols, [label]).select(label, "column", "mean", "median")


def nunique(df: DataFrame, cols: Sequence[str], exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Distinct non-missing values per column; ``exact=False`` uses a sketch."""
    count = F.count_distinct if exact else lambda c: F.approx_count_distinct(c, rsd)
    types = dict(df.dtypes)
    value = {c: F.when(~is_missing(c, types[c]), F.col(c)) for c in cols}
    row = df.agg(*[count(value[c]).alias(c) for c in cols])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("distinct_values")) for c in cols]
    return row.select(F.inline(F.array(*pairs)))


def conditional_total(df: DataFrame, c: str, positive: str = "yes") -> DataFrame:
    """Rows in the positive class, all rows, and the rest."""
    hits = F.count(F.when(F.col(c) == positive, 1))
    return df.agg(hits.alias("positive"), (F.count("*") - hits).alias("rest"), F.count("*").alias("total"))


def mode_level(df: DataFrame, c: str) -> DataFrame:
    """The most frequent level and its row count; the smallest level wins a tie."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("level")).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.col("rows").desc(), "level").limit(1)


def transpose_summary(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows ``(measure, key, value)`` from one column per measure."""
    wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot([key], list(cols), "measure", "value").select("measure", key, "value")


# Correlation


PAIRS_PER_PASS = 32  # so many correlations the JVM still compiles as one aggregate


def _few_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``(f1, f2, r)`` for the given pairs, each over the rows where both are present, side by side in one aggregate."""
    types = dict(df.dtypes)
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    slim = df.select(*[number(c, types[c]).alias(c) for c in columns])
    row = slim.agg(*[pearson(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    first, second = (F.array(*[F.lit(p[side]) for p in pairs]) for side in (0, 1))
    place = F.substring("pair", 2, 10).cast("int")
    return row.unpivot([], row.columns, "pair", "r").select(F.get(first, place).alias("f1"), F.get(second, place).alias("f2"), "r")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair, each over the rows where both are present, null without spread.

    The rows are read once at any width: few columns are one aggregate, more one Gram matrix.
    """
    cols = list(cols)
    if len(cols) * (len(cols) + 1) // 2 > PAIRS_PER_PASS:
        return cross_correlations(df, cols).select("f1", "f2", "r")
    half = _few_correlations(df, [(a, a) for a in cols] + list(combinations(cols, 2)))
    mirrored = F.when(F.col("f1") == F.col("f2"), F.array(F.struct("f1", "f2", "r"))).otherwise(
        F.array(F.struct("f1", "f2", "r"), F.struct(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "r"))
    )
    return half.select(F.inline(mirrored))  # of a row per pair


def correlation_matrix_wide(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same through one Gram matrix whatever the number of columns."""
    return cross_correlations(df, cols).select("f1", "f2", "r")


def high_correlation_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Pairs, each once, whose correlation exceeds the threshold in size."""
    cols = list(cols)
    pairs = list(combinations(cols, 2))
    if 0 < len(pairs) <= PAIRS_PER_PASS:
        found = _few_correlations(df, pairs)
    else:
        found = cross_correlations(df, cols).where("i < j").select("f1", "f2", "r")
    return found.filter(F.abs("r") > threshold)


def target_correlation(df: DataFrame, cols: Sequence[str], target: str, k: int = 5) -> DataFrame:
    """The k highest and the k lowest correlations with the target.

    ``lowest`` lists the last ones whatever their sign.
    """
    others = [c for c in cols if c != target]
    if 0 < len(others) <= PAIRS_PER_PASS:
        found = _few_correlations(df, [(c, target) for c in others])
    else:
        found = cross_correlations(df, others, [target])
    found = found.select(F.col("f1").alias("feature"), "r")
    # A row per column; both sides from one run of the rows.
    every = W.partitionBy()
    sides = {"highest": F.col("r").desc_nulls_last(), "lowest": F.col("r").asc_nulls_last()}
    placed = found.withColumns({f"_{side}": F.row_number().over(every.orderBy(by, "feature")) for side, by in sides.items()})
    listed = F.array_compact(
        F.array(*[F.when(F.col(f"_{side}") <= k, F.struct("feature", "r", F.lit(side).alias("side"), F.col(f"_{side}").alias("_place"))) for side in sides])
    )
    return placed.select(F.inline(listed)).orderBy("side", "_place").drop("_place")


def welch_t(df: DataFrame, c: str, by: str, a: str, b: str) -> DataFrame:
    """Welch's t statistic, degrees of freedom and two-sided p-value for the means of two groups.

    All three are null where a group has fewer than two values or neither has spread.
    """
    types = dict(df.dtypes)
    v = number(c, types[c])

    def side(level: str) -> tuple[Column, Column, Column]:
        x = F.when(F.col(by) == level, v)
        return F.count(x).cast("double"), F.avg(x), F.var_samp(x)

    na, ma, va = side(a)
    nb, mb, vb = side(b)
    row = df.agg(
        na.alias("na"), ma.alias("ma"), va.alias("va"), nb.alias("nb"), mb.alias("mb"), vb.alias("vb")
    )
    ea, eb = ratio(F.col("va"), F.col("na")), ratio(F.col("vb"), F.col("nb"))
    spread = ratio(ea * ea, F.col("na") - 1) + ratio(eb * eb, F.col("nb") - 1)
    found = row.select(
        F.col("ma").alias("mean_a"),
        F.col("mb").alias("mean_b"),
        ratio(F.col("ma") - F.col("mb"), F.sqrt(ea + eb)).alias("t"),
        ratio((ea + eb) * (ea + eb), spread).alias("df"),
    )
    return found.withColumn("p", t_two_sided(F.col("t"), F.col("df")))
