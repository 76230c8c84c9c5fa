"""Level counts, response rates, bins, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.functions.scalars import MONTHS
from campaignlens.operators import rates
from campaignlens.plans.catalog.common import neat, on_contacts, on_table
from campaignlens.schema import (
    AGE_EDGES,
    AGE_LABELS,
    BALANCE_EDGES,
    BALANCE_LABELS,
    CAMPAIGN_EDGES,
    CAMPAIGN_LABELS,
)

RATE = "round(avg(CASE WHEN y = 'yes' THEN 100.0::DOUBLE ELSE 0 END), 6)"
DIMS = ["job", "marital", "contact", "month", "poutcome"]


def many_sql(dims: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS level, count(*) AS n, {RATE} AS rate FROM contacts GROUP BY {d}" for d in dims
    )


def plain(df: DataFrame) -> DataFrame:
    """Names that are no SQL keywords."""
    new = {"rows": "n", "column": "name", "position": "pos", "from": "low", "to": "high", "yes": "yes_share", "no": "no_share"}
    return neat(df.withColumnsRenamed({k: v for k, v in new.items() if k in df.columns}))


@on_contacts(
    "value_counts",
    "contact",
    """SELECT contact AS level, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM contacts), 6) AS share
  FROM contacts GROUP BY contact""",
)
def value_counts(df: DataFrame) -> DataFrame:
    return plain(rates.value_counts(df, "contact"))


@on_table(
    "value_counts_documents",
    "documents",
    """SELECT lang AS level, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS share
  FROM documents GROUP BY lang""",
)
def value_counts_documents(df: DataFrame) -> DataFrame:
    return plain(rates.value_counts(df, "lang"))


@on_contacts(
    "level_breakdown",
    " ".join(DIMS),
    " UNION ALL ".join(
        f"""SELECT '{d}' AS name, {d} AS level, count(*) AS n,
    round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM contacts), 6) AS pct FROM contacts GROUP BY {d}"""
        for d in DIMS
    ),
)
def level_breakdown(df: DataFrame) -> DataFrame:
    return plain(rates.level_breakdown(df, DIMS))


def share_sql(dim: str) -> str:
    return f"""SELECT {dim} AS level, round(count(*) FILTER (y = 'no')::DOUBLE / count(*), 6) AS no_share,
  round(count(*) FILTER (y = 'yes')::DOUBLE / count(*), 6) AS yes_share FROM contacts GROUP BY {dim}"""


def rate_sql(dim: str) -> str:
    return f"SELECT {dim} AS level, count(*) AS n, {RATE} AS rate FROM contacts GROUP BY {dim}"


def _register(dim: str) -> None:
    @on_contacts(f"response_share_{dim}", f"{dim} y", share_sql(dim))
    def response_share(df: DataFrame) -> DataFrame:
        return plain(rates.response_share(df, dim))

    @on_contacts(f"response_rate_{dim}", f"{dim} y", rate_sql(dim))
    def response_rate(df: DataFrame) -> DataFrame:
        return plain(rates.response_rate(df, dim))


for _dim in ("job", "marital", "contact", "month", "poutcome"):
    _register(_dim)


@on_contacts("response_rate_by_value", "campaign y", rate_sql("campaign"))
def response_rate_by_value(df: DataFrame) -> DataFrame:
    """Rate per raw value of a number, without bins."""
    return plain(rates.response_rate(df, "campaign"))


@on_contacts("response_rate_many", " ".join(DIMS) + " y", many_sql(DIMS))
def response_rate_many(df: DataFrame) -> DataFrame:
    return plain(rates.response_rate_many(df, DIMS))


def binned_sql(column: str, edges: list[float], labels: list[str]) -> str:
    parts = []
    for i, (lo, hi, label) in enumerate(zip(edges, edges[1:], labels)):
        test = [f"{column} > {lo}"] if lo != float("-inf") else []
        test += [f"{column} <= {hi}"] if hi != float("inf") else []
        parts.append(
            f"SELECT {i}::BIGINT AS pos, '{label}' AS bin, count(*) AS n, {RATE} AS rate FROM contacts WHERE {' AND '.join(test)}"
        )
    return " UNION ALL ".join(parts)


@on_contacts("response_rate_balance_bins", "balance y", binned_sql("balance", BALANCE_EDGES, BALANCE_LABELS))
def balance_bins(df: DataFrame) -> DataFrame:
    return plain(rates.response_rate_binned(df, "balance", BALANCE_EDGES, BALANCE_LABELS))


@on_contacts("response_rate_campaign_bins", "campaign y", binned_sql("campaign", CAMPAIGN_EDGES, CAMPAIGN_LABELS))
def campaign_bins(df: DataFrame) -> DataFrame:
    return plain(rates.response_rate_binned(df, "campaign", CAMPAIGN_EDGES, CAMPAIGN_LABELS))


@on_contacts("response_rate_age_bins", "previous y", binned_sql("previous", AGE_EDGES, AGE_LABELS))
def age_bins(df: DataFrame) -> DataFrame:
    """Most of these bins are empty: they must be listed without a rate."""
    return plain(rates.response_rate_binned(df, "previous", AGE_EDGES, AGE_LABELS))


@on_contacts("overall_rate", "y", f"SELECT count(*) AS n, {RATE} AS rate FROM contacts")
def overall_rate(df: DataFrame) -> DataFrame:
    return plain(rates.overall_rate(df))


def ordered_sql(column: str, order: list[str], kind: str) -> str:
    wanted = ", ".join(f"({i}::BIGINT, '{v}')" for i, v in enumerate(order))
    return f"""SELECT pos, o.level, n, rate FROM (VALUES {wanted}) o(pos, level)
  {kind} JOIN (SELECT {column} AS level, count(*) AS n, {RATE} AS rate FROM contacts GROUP BY {column}) r ON o.level = r.level"""


# "S" does not occur and "P" is not asked for.
OUTCOMES = ["unknown", "S", "F", "O"]


@on_contacts("month_order", "month y", ordered_sql("month", MONTHS, "INNER"))
def month_order(df: DataFrame) -> DataFrame:
    return plain(rates.reorder_levels(rates.response_rate(df, "month"), MONTHS))


@on_contacts("level_order_present", "poutcome y", ordered_sql("poutcome", OUTCOMES, "INNER"))
def level_order_present(df: DataFrame) -> DataFrame:
    return plain(rates.reorder_levels(rates.response_rate(df, "poutcome"), OUTCOMES))


@on_contacts("level_order_complete", "poutcome y", ordered_sql("poutcome", OUTCOMES, "LEFT"))
def level_order_complete(df: DataFrame) -> DataFrame:
    return plain(rates.reorder_levels(rates.response_rate(df, "poutcome"), OUTCOMES, keep_missing=True))


@on_contacts(
    "best_worst",
    " ".join(DIMS) + " y",
    ", r AS ("
    + many_sql(DIMS)
    + """) SELECT dimension, first(level ORDER BY rate DESC, level) AS best, max(rate) AS best_rate,
    first(level ORDER BY rate, level) AS worst, min(rate) AS worst_rate, round(max(rate) - min(rate), 5) AS spread
  FROM r GROUP BY dimension""",
)
def best_worst(df: DataFrame) -> DataFrame:
    found = plain(rates.best_worst(rates.response_rate_many(df, DIMS), ["dimension"]))
    return found.withColumn("spread", F.round(F.col("best_rate") - F.col("worst_rate"), 5))


@on_contacts(
    "rate_gap",
    "poutcome y",
    f""", r AS ({rate_sql("poutcome")}) SELECT max(rate) FILTER (level = 'F') AS a_rate,
  max(rate) FILTER (level = 'O') AS b_rate,
  round(max(rate) FILTER (level = 'F') - max(rate) FILTER (level = 'O'), 5) AS gap FROM r""",
)
def rate_gap(df: DataFrame) -> DataFrame:
    found = plain(rates.rate_gap(rates.response_rate(df, "poutcome"), "F", "O"))
    return found.withColumn("gap", F.round(F.col("a_rate") - F.col("b_rate"), 5))


@on_contacts(
    "rate_of_level",
    "poutcome y",
    f"SELECT level, rate FROM ({rate_sql('poutcome')}) WHERE level = 'unknown'",
)
def rate_of_level(df: DataFrame) -> DataFrame:
    return plain(rates.rate_of(rates.response_rate(df, "poutcome"), "unknown"))


@on_contacts(
    "group_means",
    "nation_key balance duration campaign previous",
    """SELECT nation_key, round(avg(balance), 6) AS balance, round(avg(duration), 6) AS duration,
  round(avg(campaign), 6) AS campaign, round(avg(previous), 6) AS previous FROM contacts GROUP BY nation_key""",
)
def group_means(df: DataFrame) -> DataFrame:
    return neat(rates.group_means(df, "nation_key", ["balance", "duration", "campaign", "previous"]))


def histogram_sql(column: str, table: str, bins: int, lo: str, hi: str, by: str | None = None) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    link = f"USING ({by})" if by else "ON true"
    return f""", b AS (SELECT {key}{lo} AS lo, ({hi} - {lo}) / {bins} AS w, {hi} AS hi FROM {table} {group}),
  c AS (SELECT {key}least({bins - 1}, floor(({column} - lo) / w)) AS bin, count(*) AS n FROM {table} JOIN b {link}
    WHERE {column} BETWEEN lo AND hi GROUP BY ALL)
  SELECT {key.replace(by or '~', 'b.' + (by or ''))}CAST(g AS BIGINT) AS bin, round(lo + w * g, 6) AS low, round(lo + w * (g + 1), 6) AS high,
    coalesce(n, 0) AS n FROM b CROSS JOIN range({bins}) t(g) LEFT JOIN c ON c.bin = g {f'AND c.{by} = b.{by}' if by else ''}"""


@on_contacts("histogram", "duration", histogram_sql("duration", "contacts", 30, "min(duration)", "max(duration)"))
def histogram(df: DataFrame) -> DataFrame:
    return plain(rates.histogram(df, "duration", 30))


@on_contacts("histogram_range", "balance", histogram_sql("balance", "contacts", 50, "-500.0::DOUBLE", "8000.0::DOUBLE") .replace(
    "SELECT -500.0::DOUBLE AS lo, (8000.0::DOUBLE - -500.0::DOUBLE) / 50 AS w, 8000.0::DOUBLE AS hi FROM contacts",
    "SELECT -500.0::DOUBLE AS lo, 8500.0::DOUBLE / 50 AS w, 8000.0::DOUBLE AS hi"))
def histogram_range(df: DataFrame) -> DataFrame:
    return plain(rates.histogram(df, "balance", 50, -500, 8000))


@on_contacts("histogram_by", "duration y", histogram_sql("duration", "contacts", 20, "min(duration)", "max(duration)", "y"))
def histogram_by(df: DataFrame) -> DataFrame:
    return plain(rates.histogram(df, "duration", 20, by=["y"]))


BOX = """, q AS (SELECT {by} quantile_cont({c}, 0.25) AS q1, median({c}) AS med, quantile_cont({c}, 0.75) AS q3
    FROM {t} GROUP BY {g}),
  f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
  SELECT {by} round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
    min({c}) FILTER ({c} BETWEEN lo AND hi)::DOUBLE AS whisker_low, max({c}) FILTER ({c} BETWEEN lo AND hi)::DOUBLE AS whisker_high,
    count(*) FILTER ({c} NOT BETWEEN lo AND hi) AS outliers, count({c}) AS n
  FROM {t} JOIN f USING ({g}) GROUP BY {by} q1, med, q3"""


@on_contacts("box_stats", "campaign y", BOX.format(c="campaign", t="contacts", by="y,", g="y"))
def box_stats(df: DataFrame) -> DataFrame:
    return plain(rates.box_stats(df, "campaign", ["y"]))


# The same with rows of no group: contacts without an earlier outcome.
HOLES = """, holes AS (SELECT campaign, duration, CASE WHEN poutcome <> 'unknown' THEN poutcome END AS outcome FROM contacts)"""


def with_outcome(df: DataFrame) -> DataFrame:
    return df.withColumn("outcome", F.when(F.col("poutcome") != "unknown", F.col("poutcome")))


@on_contacts(
    "box_stats_missing_group",
    "campaign duration poutcome",
    HOLES
    + BOX.format(c="campaign", t="holes", by="outcome,", g="outcome").replace(
        "FROM holes JOIN f USING (outcome)", "FROM (SELECT h.campaign, f.* FROM holes h JOIN f ON h.outcome IS NOT DISTINCT FROM f.outcome)"
    ),
)
def box_stats_missing_group(df: DataFrame) -> DataFrame:
    return plain(rates.box_stats(with_outcome(df), "campaign", ["outcome"]))


@on_contacts(
    "histogram_missing_group",
    "campaign duration poutcome",
    HOLES
    + """, b AS (SELECT outcome, min(duration) AS lo, (max(duration) - min(duration)) / 20 AS w, max(duration) AS hi FROM holes GROUP BY outcome),
  placed AS (SELECT b.outcome, lo, w, least(19, floor((duration - lo) / w)) AS bin FROM holes h JOIN b ON h.outcome IS NOT DISTINCT FROM b.outcome)
  SELECT outcome, sum(n)::BIGINT AS n, count(*) AS bins FROM (
    SELECT b.outcome, i, (SELECT count(*) FROM placed p WHERE p.outcome IS NOT DISTINCT FROM b.outcome AND p.bin = i) AS n
    FROM b, range(0, 20) AS r(i)) GROUP BY outcome""",
)
def histogram_missing_group(df: DataFrame) -> DataFrame:
    bins = rates.histogram(with_outcome(df), "duration", 20, by=["outcome"])
    return bins.groupBy("outcome").agg(F.sum("rows").alias("n"), F.count("*").alias("bins"))


@on_table(
    "box_stats_documents",
    "documents",
    "WITH d AS (SELECT lang, n_chars FROM documents)" + BOX.format(c="n_chars", t="d", by="lang,", g="lang"),
)
def box_stats_documents(df: DataFrame) -> DataFrame:
    return plain(rates.box_stats(df, "n_chars", ["lang"]))


@on_contacts(
    "outlier_report",
    "campaign previous balance",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, outliers, n, round(100.0::DOUBLE * outliers / n, 6) AS pct FROM (
    SELECT count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, count({c}) AS n
    FROM contacts, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM contacts))"""
        for c in ("campaign", "previous", "balance")
    ),
)
def outlier_report(df: DataFrame) -> DataFrame:
    return plain(rates.outlier_report(df, ["campaign", "previous", "balance"]))
