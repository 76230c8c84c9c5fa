"""Preparation for modelling: encoding, balancing, splitting, scaling, derived columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from campaignlens.functions.draws import draw
from campaignlens.functions.scalars import number, ratio, signed_log
from campaignlens.operators.sizing import rows_if_small, small_side
from campaignlens.session import written

# Draw order by threshold

CELL_DIGITS = 4  # 65,536 equal cells of the draw
FEW_CLASSES = 200


def _level(by: str | None) -> Column:
    return F.col(by).cast("string") if by else F.lit("all")


def _drawn(df: DataFrame, key: str, seed: int, by: str | None) -> DataFrame:
    """Class, draw and cell of the draw of every row that has a class."""
    slim = df.select(_level(by).alias("level"), draw(key, seed).alias("draw")).filter(F.col("level").isNotNull())
    return slim.withColumn("cell", F.substring("draw", 1, CELL_DIGITS))


def _boundaries(drawn: DataFrame, wanted: Callable[[DataFrame], Column]) -> DataFrame:
    """Per class: its size, the rows wanted, and the cell and place in it of the last wanted row."""
    cells = drawn.groupBy("level", "cell").agg(F.count("*").alias("n"))
    classes = cells.groupBy("level").agg(F.sum("n").alias("rows"))
    goals = classes.withColumn("wanted", F.least(wanted(classes).cast("long"), F.col("rows")))
    upto = F.sum("n").over(W.partitionBy("level").orderBy("cell"))
    placed = cells.withColumn("upto", upto).join(goals.select("level", "wanted"), "level")
    last = placed.filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
    last = last.select("level", "cell", (F.col("wanted") - F.col("upto") + F.col("n")).alias("place"))
    return goals.join(last, "level", "left")


def _cuts(drawn: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Per class the draw of its last wanted row, from a sort of the boundary cells alone."""
    inside = drawn.join(boundaries.select("level", "cell", "place"), ["level", "cell"])
    ranked = inside.withColumn("at", F.row_number().over(W.partitionBy("level").orderBy("draw")))
    return ranked.filter(F.col("at") == F.col("place")).select("level", F.col("draw").alias("cut"))


def within_draw(
    df: DataFrame, wanted: Callable[[DataFrame], Column], key: str, seed: int, by: str | None = None
) -> tuple[DataFrame, Column]:
    """The frame and a test for the first ``wanted`` rows of each class in draw order.

    ``wanted`` gets the class table ``(level, rows)`` and returns a column over it.
    Rows are counted by class and cell of the draw, then one cell per class is
    sorted to find the draw of the last wanted row. The test compares draws, so
    the table itself is neither sorted nor shuffled. With very many classes the
    thresholds are joined instead of written into the test.
    """
    # Counted by cell, then sorted in a few cells: the input itself is run once for both.
    drawn = written(_drawn(df, key, seed, by), "draws")
    boundaries = _boundaries(drawn, wanted)
    known = rows_if_small(boundaries, FEW_CLASSES)
    if known is None:
        cuts = _cuts(drawn, boundaries).select(F.col("level").alias("_level"), F.col("cut").alias("_cut"))
        joined = df.join(small_side(cuts), _level(by) == F.col("_level"), "left")
        return joined, F.coalesce(draw(key, seed) <= F.col("_cut"), F.lit(False))
    partial = [r for r in known if 0 < r["wanted"] < r["rows"]]
    test = F.lit(False)
    for r in known:
        if r["wanted"] == r["rows"]:
            test = test | (_level(by) == F.lit(r["level"]))
    if partial:
        table = F.broadcast(df.sparkSession.createDataFrame(partial, boundaries.schema))
        for r in _cuts(drawn, table).collect():
            test = test | ((_level(by) == F.lit(r["level"])) & (draw(key, seed) <= F.lit(r["cut"])))
    return df, F.coalesce(test, F.lit(False))


def first_by_draw(
    df: DataFrame, wanted: Callable[[DataFrame], Column], key: str, seed: int, by: str | None = None
) -> DataFrame:
    """The first ``wanted`` rows of each class in draw order."""
    frame, test = within_draw(df, wanted, key, seed, by)
    return frame.filter(test).select(*df.columns)


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """All rows of the smallest class and as many drawn from every other class."""
    return first_by_draw(df, lambda classes: classes.agg(F.min("rows")).scalar(), key, seed, label)


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: 'test' for ceil(test * rows) rows with class shares kept, else 'train'.

    Rounding gives the odd rows to the classes with the largest remainders. Rows without
    a label belong to neither part: their ``split`` is null.
    """

    def share(classes: DataFrame) -> Column:
        # Windows over the class table, one row per class.
        every = W.partitionBy()
        goal = F.ceil(F.round(F.sum("rows").over(every) * F.lit(float(test)), 6))
        exact = F.col("rows") * goal / F.sum("rows").over(every)
        whole = F.floor(exact)
        place = F.row_number().over(every.orderBy((exact - whole).desc(), "level"))
        return whole + F.when(place <= goal - F.sum(whole).over(every), 1).otherwise(0)

    frame, chosen = within_draw(df, share, key, seed, label)
    return frame.select(*df.columns, F.when(F.col(label).isNotNull(), F.when(chosen, "test").otherwise("train")).alias("split"))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    counts = df.groupBy(split).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("pct", ratio(F.col("rows") * 100, total))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in draw order, for a sink that keeps it."""
    return df.orderBy(draw(key, seed))


def subset_by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


# Encoding


def fit_label_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows ``(column, level, code)``; codes follow the sorted levels, from 0."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols]
    levels = df.select(F.inline(F.array(*entries))).filter(F.col("level").isNotNull()).distinct()
    rows = rows_if_small(levels)
    if rows is None:
        return _codes_by_sort(levels)
    known = df.sparkSession.createDataFrame(rows, levels.schema)
    order = W.partitionBy("column").orderBy("level")
    return known.withColumn("code", (F.row_number().over(order) - 1).cast("long"))


def _codes_by_sort(levels: DataFrame) -> DataFrame:
    """The same codes for any number of levels.

    The levels are sorted across partitions and written with their place, so that
    the place is fixed; the rows per partition and column then give the offsets.
    """
    placed = levels.orderBy("column", "level").withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "levels")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = placed.select("column", "level", part.alias("_part"), row.alias("_row"))
    sizes = placed.groupBy("column", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("column").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "column", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    found = placed.join(small_side(offsets), ["column", "_part"])
    return found.select("column", "level", (F.col("_offset") + F.col("_row") - F.col("_first")).alias("code"))


def encode(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], strict: bool = True) -> DataFrame:
    """Levels replaced by their codes; an unseen level is an error, or null if not strict."""
    return _look_up(df, dictionary, cols, "level", "code", strict)


def decode(df: DataFrame, dictionary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Codes replaced by their levels."""
    return _look_up(df, dictionary, cols, "code", "level", False)


def _look_up(
    df: DataFrame, dictionary: DataFrame, cols: Sequence[str], source: str, target: str, strict: bool
) -> DataFrame:
    rows = rows_if_small(dictionary.filter(F.col("column").isin(*cols)))
    out = df
    for c in cols:
        mine = dictionary.filter(F.col("column") == c)
        if rows is not None:
            mine = F.broadcast(
                df.sparkSession.createDataFrame([r for r in rows if r["column"] == c], dictionary.schema)
            )
        mine = mine.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
        found = F.col("_to")
        if strict:
            problem = F.concat(F.lit(f"unseen value in {c}: "), F.col(c).cast("string"))
            found = F.when(F.col("_to").isNull() & F.col(c).isNotNull(), F.raise_error(problem)).otherwise(found)
        value = F.col(c).cast("string") if source == "level" else F.col(c).cast("long")
        out = out.join(mine, value == F.col("_from"), "left").withColumn(c, found).drop("_from", "_to")
    return out.select(*df.columns)


def class_distribution(df: DataFrame, label: str, positive: str = "yes", negative: str = "no") -> DataFrame:
    """Rows and per cent per class, with the ratio of negative to positive rows."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("level")).agg(F.count("*").alias("rows"))
    whole = counts.agg(
        F.struct(
            F.sum("rows").alias("n"),
            F.sum(F.when(F.col("level") == negative, F.col("rows"))).alias("neg"),
            F.sum(F.when(F.col("level") == positive, F.col("rows"))).alias("pos"),
        )
    ).scalar()
    return counts.withColumn("_w", whole).select(
        "level",
        "rows",
        ratio(F.col("rows") * 100, F.col("_w.n")).alias("pct"),
        ratio(F.col("_w.neg"), F.col("_w.pos")).alias("imbalance"),
    )


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Adds the balanced weight: rows / (classes * rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.struct(F.sum("_n").alias("n"), F.count("*").alias("k"))).scalar()
    weights = counts.withColumn("_w", whole).select(
        "_l", ratio(F.col("_w.n"), F.col("_n") * F.col("_w.k")).alias(name)
    )
    return df.join(small_side(weights), F.col(label) == F.col("_l"), "left").drop("_l")


def one_hot(df: DataFrame, c: str, levels: Sequence[str]) -> DataFrame:
    """A 0/1 column per level."""
    return df.select("*", *[F.when(F.col(c) == v, 1).otherwise(0).cast("long").alias(f"{c}_{v}") for v in levels])


# Scaling and derived columns


def fit_standard(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column."""
    types = dict(train.dtypes)
    return train.agg(
        *[
            F.struct(
                F.avg(number(c, types[c])).alias("mean"), F.stddev_pop(number(c, types[c])).alias("std")
            ).alias(c)
            for c in cols
        ]
    )


def apply_standard(df: DataFrame, moments: Row, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / deviation with the fitted row; a column without spread is only centred."""
    scaled = {}
    for c in cols:
        mean, std = moments[c]["mean"], moments[c]["std"]
        scaled[c] = (F.col(c).cast("double") - F.lit(mean)) / F.lit(std if std else 1.0)
    return df.withColumns(scaled)


def standardize(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str]) -> list[DataFrame]:
    """Train and the other frames scaled with the moments of train alone: one row, found here."""
    moments = fit_standard(train, cols).head()
    return [apply_standard(f, moments, cols) for f in (train, *others)]


def scaling_check(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per column before and after scaling."""
    parts = []
    for stage, df in (("before", before), ("after", after)):
        row = df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"), F.avg(F.col(c)).alias("mean"), F.stddev_samp(F.col(c)).alias("std")
                ).alias(c)
                for c in cols
            ]
        )
        parts.append(row.select(F.lit(stage).alias("stage"), F.inline(F.array(*[F.col(c) for c in cols]))))
    return parts[0].unionByName(parts[1])


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns mapped to [0, 1]; null without spread."""
    types = dict(df.dtypes)
    bounds = df.agg(
        *[
            F.struct(F.min(number(c, types[c])).alias("lo"), F.max(number(c, types[c])).alias("hi")).alias(c)
            for c in cols
        ]
    )
    held = df.withColumn("_fit", bounds.select(F.struct(*cols)).scalar())
    out = {
        c: ratio(F.col(c).cast("double") - F.col(f"_fit.{c}.lo"), F.col(f"_fit.{c}.hi") - F.col(f"_fit.{c}.lo"))
        for c in cols
    }
    return held.withColumns(out).drop("_fit")


def log_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: signed_log(c) for c in cols})


def contacted_before(df: DataFrame, pdays: str = "pdays", never: int = -1) -> DataFrame:
    return df.withColumn("contacted_before", (F.col(pdays) != never).cast("long"))


def assemble(
    df: DataFrame,
    features: Sequence[str],
    without: Sequence[str] = (),
    output: str = "features",
    nominal: Mapping[str, int] | None = None,
) -> DataFrame:
    """Feature vector in the given column order; ``without`` leaves columns out (leakage).

    ``nominal`` names columns whose codes 0 to n - 1 have no order, with their n; the vector
    says so, and trees split them by sets of codes.
    """
    used = [c for c in features if c not in set(without)]
    levels = nominal or {}

    def value(c: str) -> Column:
        number = F.col(c).cast("double")
        if c not in levels:
            return number
        return number.alias(c, metadata={"ml_attr": {"type": "nominal", "name": c, "num_vals": levels[c]}})

    cast = df.select(*[value(c) if c in used else F.col(c) for c in df.columns])
    return VectorAssembler(inputCols=used, outputCol=output).transform(cast)


def level_counts(dictionary: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Number of levels of each column in a dictionary, for ``nominal``; a column without levels has none."""
    counts = dictionary.filter(F.col("column").isin(*cols)).groupBy("column").agg((F.max("code") + 1).cast("int").alias("n"))
    found = {r["column"]: r["n"] for r in counts.collect()}  # a row per column
    return {c: found[c] for c in cols if c in found}


def spread(rows: int) -> int:
    """Partitions for a fit: one per 25,000 rows up to 96 of them, more only where each would hold over 200,000."""
    return max(1, min(-(-rows // 25_000), 96), -(-rows // 200_000))


def placed(df: DataFrame, key: str, seed: int = 42, rows_per_part: int | None = None) -> DataFrame:
    """The same rows in partitions and an order that their keys decide, not the files they came from.

    A fit that draws by partition, as forests and k-means do, then finds the same model
    whatever the layout. The number of partitions follows from the number of rows; keys are
    expected to be unique.
    """
    rows = df.count()
    parts = max(1, -(-rows // rows_per_part)) if rows_per_part else spread(rows)
    drawn = df.withColumn("_draw", draw(key, seed))
    return drawn.repartition(parts, "_draw").sortWithinPartitions("_draw").drop("_draw")
