"""Whole-table and grouped summaries, correlations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.operators import profile
from campaignlens.plans.catalog.common import neat, on_contacts, on_table

NUMERIC = ["balance", "duration", "campaign", "day", "previous"]
NUMBERS = " ".join(NUMERIC)


def each(cols: list[str], body: str) -> str:
    """The same aggregate for several columns, as rows."""
    return " UNION ALL ".join(f"SELECT '{c}' AS name, {body.replace('$', c)}" for c in cols)


DESCRIBE = """count($) AS n, round(avg($), 6) AS mean, round(stddev_samp($), 6) AS std,
  min($)::DOUBLE AS min, round(quantile_cont($, 0.25), 6) AS q25, round(quantile_cont($, 0.5), 6) AS q50,
  round(quantile_cont($, 0.75), 6) AS q75, max($)::DOUBLE AS max"""


def named(df: DataFrame) -> DataFrame:
    for old, new in (("column", "name"), ("count", "n"), ("rows", "n")):
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


@on_contacts("describe", NUMBERS, each(NUMERIC, DESCRIBE + " FROM contacts"))
def describe(df: DataFrame) -> DataFrame:
    return neat(named(profile.describe(df, NUMERIC)))


@on_contacts("describe_by_class", NUMBERS + " y", each(NUMERIC, "y, " + DESCRIBE + " FROM contacts GROUP BY y"))
def describe_by_class(df: DataFrame) -> DataFrame:
    return neat(named(profile.describe(df, NUMERIC, ["y"])))


@on_table(
    "describe_lines",
    "lineitem",
    each(["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag, " + DESCRIBE + " FROM lineitem GROUP BY l_returnflag"),
)
def describe_lines(df: DataFrame) -> DataFrame:
    return neat(named(profile.describe(df, ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])))


@on_contacts(
    "mean_and_std",
    NUMBERS,
    each(NUMERIC, "round(avg($), 6) AS mean, round(stddev_samp($), 6) AS std FROM contacts"),
)
def mean_and_std(df: DataFrame) -> DataFrame:
    return neat(named(profile.describe(df, NUMERIC)).select("name", "mean", "std"))


@on_contacts(
    "shape_stats",
    NUMBERS,
    each(
        NUMERIC,
        """round(median($), 6) AS median,
  (SELECT $::DOUBLE FROM (SELECT $, count(*) AS n FROM contacts GROUP BY $) ORDER BY n DESC, $ LIMIT 1) AS mode,
  round(skewness($), 4) + 0.0 AS skewness, round(kurtosis($), 4) + 0.0 AS kurtosis FROM contacts""",
    ),
)
def shape_stats(df: DataFrame) -> DataFrame:
    out = neat(named(profile.shape_stats(df, NUMERIC)))
    return out.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("skewness", "kurtosis")})


@on_contacts(
    "range_mean_median",
    NUMBERS,
    each(
        NUMERIC,
        """min($)::DOUBLE AS min, max($)::DOUBLE AS max, round(avg($), 6) AS mean, round(median($), 6) AS median,
  round(avg($) / 60, 6) AS mean_per_60 FROM contacts""",
    ),
)
def range_mean_median(df: DataFrame) -> DataFrame:
    return neat(named(profile.range_mean_median(df, NUMERIC)))


@on_contacts(
    "class_center",
    NUMBERS + " y",
    each(NUMERIC, "y, round(avg($), 6) AS mean, round(median($), 6) AS median FROM contacts GROUP BY y"),
)
def class_center(df: DataFrame) -> DataFrame:
    return neat(named(profile.class_center(df, NUMERIC)))


LEVELS = ["job", "marital", "contact", "month", "client"]


@on_contacts("nunique", " ".join(LEVELS), each(LEVELS, "count(DISTINCT $) AS distinct_values FROM contacts"))
def nunique(df: DataFrame) -> DataFrame:
    return named(profile.nunique(df, LEVELS))


@on_contacts(
    "nunique_sketch",
    " ".join(LEVELS),
    " UNION ALL ".join(f"SELECT '{c}' AS name, TRUE AS close FROM contacts HAVING count(DISTINCT {c}) > 0" for c in LEVELS),
)
def nunique_sketch(df: DataFrame) -> DataFrame:
    """Whether the sketch is within five of its standard errors (0.01) of the exact count."""
    sketch, exact = (profile.nunique(df, LEVELS, exact=e) for e in (False, True))
    both = sketch.join(exact.withColumnRenamed("distinct_values", "exact"), "column")
    return both.select(F.col("column").alias("name"), (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


MATRIX = " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a}, {b}), 4) + 0.0 AS r FROM contacts" for a in NUMERIC for b in NUMERIC
)


@on_contacts("correlation_matrix", NUMBERS, MATRIX)
def correlation_matrix(df: DataFrame) -> DataFrame:
    return neat(profile.correlation_matrix(df, NUMERIC), 4)


@on_contacts("correlation_matrix_wide", NUMBERS, MATRIX)
def correlation_matrix_wide(df: DataFrame) -> DataFrame:
    return neat(profile.correlation_matrix_wide(df, NUMERIC), 4)


COMPONENTS = 64
HOLE = "(vec_id + k) % 7 = 0 OR (vec_id * k) % 31 = 5"  # where component k of a row counts as missing


def components(df: DataFrame) -> DataFrame:
    """The embedding's components as columns c0, c1, ... with holes."""
    hole = lambda k: ((F.col("vec_id") + k) % 7 == 0) | ((F.col("vec_id") * k) % 31 == 5)
    return df.select(*[F.when(~hole(k), F.get("embedding", F.lit(k)).cast("double")).alias(f"c{k}") for k in range(COMPONENTS)])


PRESENT = f"""WITH parts AS (
  SELECT vec_id, unnest(range({COMPONENTS})) AS k, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
present AS (SELECT vec_id, k, v FROM parts WHERE NOT ({HOLE})),
pairs AS (
  SELECT a.k AS i, b.k AS j, corr(a.v, b.v) AS r FROM present a JOIN present b ON a.vec_id = b.vec_id GROUP BY a.k, b.k)
"""


@on_table(
    "correlation_of_components",
    "embeddings",
    PRESENT + "SELECT 'c' || i AS f1, 'c' || j AS f2, round(r, 6) + 0.0 AS r FROM pairs",
)
def correlation_of_components(df: DataFrame) -> DataFrame:
    return neat(profile.correlation_matrix(components(df), [f"c{k}" for k in range(COMPONENTS)]))


@on_table(
    "high_correlation_components",
    "embeddings",
    PRESENT + "SELECT 'c' || i AS f1, 'c' || j AS f2, round(r, 6) + 0.0 AS r FROM pairs WHERE i < j AND abs(r) > 0.05",
)
def high_correlation_components(df: DataFrame) -> DataFrame:
    return neat(profile.high_correlation_pairs(components(df), [f"c{k}" for k in range(COMPONENTS)], 0.05))


@on_table(
    "high_correlation_pairs",
    "lineitem",
    """SELECT 'l_quantity' AS f1, 'l_extendedprice' AS f2, r FROM (
    SELECT round(corr(l_quantity, l_extendedprice), 4) + 0.0 AS r FROM lineitem) WHERE abs(r) > 0.7
  UNION ALL SELECT 'l_extendedprice', 'gross', r FROM (
    SELECT round(corr(l_extendedprice, l_extendedprice * (1 + l_tax)), 4) + 0.0 AS r FROM lineitem) WHERE abs(r) > 0.7
  UNION ALL SELECT 'l_quantity', 'gross', r FROM (
    SELECT round(corr(l_quantity, l_extendedprice * (1 + l_tax)), 4) + 0.0 AS r FROM lineitem) WHERE abs(r) > 0.7
  UNION ALL SELECT 'l_extendedprice', 'l_discount', r FROM (
    SELECT round(corr(l_extendedprice, l_discount), 4) + 0.0 AS r FROM lineitem) WHERE abs(r) > 0.7""",
)
def high_correlation_pairs(df: DataFrame) -> DataFrame:
    df = df.withColumn("gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    return neat(profile.high_correlation_pairs(df, ["l_quantity", "l_extendedprice", "l_discount", "gross"]), 4)


OTHERS = ["balance", "duration", "campaign", "day", "previous"]


@on_contacts(
    "target_correlation",
    NUMBERS + " y",
    ", found AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, CASE WHEN y = 'yes' THEN 1 ELSE 0 END) AS r FROM contacts" for c in OTHERS
    )
    + """) SELECT feature, round(r, 4) + 0.0 AS r, 'highest' AS side FROM (SELECT * FROM found ORDER BY r DESC, feature LIMIT 3)
  UNION ALL SELECT feature, round(r, 4) + 0.0, 'lowest' FROM (SELECT * FROM found ORDER BY r, feature LIMIT 3)""",
)
def target_correlation(df: DataFrame) -> DataFrame:
    coded = df.withColumn("target", F.when(F.col("y") == "yes", 1).otherwise(0))
    return neat(profile.target_correlation(coded, OTHERS, "target", 3), 4)


@on_contacts(
    "conditional_total",
    "y",
    "SELECT count(*) FILTER (y = 'yes') AS positive, count(*) FILTER (y <> 'yes') AS rest, count(*) AS total FROM contacts",
)
def conditional_total(df: DataFrame) -> DataFrame:
    return profile.conditional_total(df, "y")


@on_contacts(
    "mode_level",
    "job",
    "SELECT job AS level, count(*) AS n FROM contacts GROUP BY job ORDER BY n DESC, job LIMIT 1",
)
def mode_level(df: DataFrame) -> DataFrame:
    return named(profile.mode_level(df, "job"))


@on_contacts(
    "welch_t",
    "balance y",
    """, s AS (SELECT
    avg(balance) FILTER (y = 'yes') AS ma, var_samp(balance) FILTER (y = 'yes') AS va, count(*) FILTER (y = 'yes') AS na,
    avg(balance) FILTER (y = 'no') AS mb, var_samp(balance) FILTER (y = 'no') AS vb, count(*) FILTER (y = 'no') AS nb
    FROM contacts)
  SELECT round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round((ma - mb) / sqrt(va / na + vb / nb), 4) AS t,
    round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df FROM s""",
)
def welch_t(df: DataFrame) -> DataFrame:
    return neat(profile.welch_t(df, "balance", "y", "yes", "no"), 4).drop("p")


@on_contacts(
    "welch_p",
    "balance duration campaign previous y",
    # The tail of the t density as a share of its whole, with t = sqrt(df) tan(angle), by Simpson's rule.
    """, long AS (UNPIVOT (SELECT y, balance::DOUBLE AS balance, duration::DOUBLE AS duration, campaign::DOUBLE AS campaign,
    previous::DOUBLE AS previous FROM contacts) ON balance, duration, campaign, previous INTO NAME feature VALUE v),
  s AS (SELECT feature, avg(v) FILTER (y = 'yes') AS ma, var_samp(v) FILTER (y = 'yes') / count(*) FILTER (y = 'yes') AS ea, count(*) FILTER (y = 'yes') AS na,
    avg(v) FILTER (y = 'no') AS mb, var_samp(v) FILTER (y = 'no') / count(*) FILTER (y = 'no') AS eb, count(*) FILTER (y = 'no') AS nb
    FROM long GROUP BY feature),
  w AS (SELECT feature, (ma - mb) / sqrt(ea + eb) AS t, pow(ea + eb, 2) / (pow(ea, 2) / (na - 1) + pow(eb, 2) / (nb - 1)) AS df FROM s),
  angles AS (SELECT feature, df, atan(abs(t) / sqrt(df)) AS low FROM w),
  steps AS (SELECT i, CASE WHEN i IN (0, 40000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight FROM range(40001) AS r(i)),
  areas AS (SELECT feature, any_value(low) AS low,
    sum(weight * pow(greatest(cos(low + (pi() / 2 - low) * i / 40000), 0), df - 1)) * (pi() / 2 - any_value(low)) AS tail,
    sum(weight * pow(greatest(cos(pi() / 2 * i / 40000), 0), df - 1)) * pi() / 2 AS whole FROM angles, steps GROUP BY feature)
  SELECT feature, round(tail / whole, 9) AS p FROM areas""",
)
def welch_p(df: DataFrame) -> DataFrame:
    """Two-sided p-values of several columns, against a numeric integral of the density."""
    parts = [profile.welch_t(df, c, "y", "yes", "no").select(F.lit(c).alias("feature"), "p") for c in df.columns if c != "y"]
    return neat(reduce(DataFrame.unionByName, parts), 9)


@on_contacts(
    "vector_summary",
    "duration",
    "SELECT round(sum(duration), 2) AS total, min(duration) AS low, max(duration) AS high FROM contacts",
)
def vector_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.round(F.sum("duration"), 2).alias("total"), F.min("duration").alias("low"), F.max("duration").alias("high")
    )
