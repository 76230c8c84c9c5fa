"""Verdicts, tiers, projections and summary reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.operators import rules
from campaignlens.plans import reports
from campaignlens.plans.catalog.common import neat, on_contacts, on_scored
from campaignlens.plans.catalog.rate_queries import RATE, binned_sql, many_sql
from campaignlens.session import written
from campaignlens.schema import BALANCE_EDGES, BALANCE_LABELS, CAMPAIGN_EDGES, CAMPAIGN_LABELS

VERDICT = "CASE WHEN ratio > 3 THEN 'severe' WHEN ratio > 1.5 THEN 'moderate' ELSE 'balanced' END AS verdict"


def imbalance_sql(c: str) -> str:
    return f""", c AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS seat FROM contacts GROUP BY {c}),
  r AS (SELECT max(n) FILTER (seat = 1)::DOUBLE / max(n) FILTER (seat = 2) AS ratio FROM c)
  SELECT round(ratio, 6) AS ratio, {VERDICT} FROM r"""


@on_contacts("imbalance_verdict", "y", imbalance_sql("y"))
def imbalance_verdict(df: DataFrame) -> DataFrame:
    return neat(rules.imbalance_verdict(df, "y"))


@on_contacts("imbalance_verdict_jobs", "job", imbalance_sql("job"))
def imbalance_verdict_jobs(df: DataFrame) -> DataFrame:
    return neat(rules.imbalance_verdict(df, "job"))


NUMERIC = ["balance", "campaign", "previous"]
SKEW = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, round(s, 4) + 0.0 AS skewness,
  CASE WHEN abs(s) > 1 THEN 'high' WHEN abs(s) > 0.5 THEN 'moderate' ELSE 'normal' END AS verdict
  FROM (SELECT skewness({c}) AS s FROM contacts)"""
    for c in NUMERIC
)


@on_contacts("skew_verdict", " ".join(NUMERIC), SKEW)
def skew_verdict(df: DataFrame) -> DataFrame:
    return neat(rules.skew_verdict(df, NUMERIC).withColumnRenamed("column", "name"), 4)


@on_scored(
    "propensity_tier",
    "SELECT id, score, CASE WHEN score > 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS tier FROM scored",
)
def propensity_tier(df: DataFrame) -> DataFrame:
    return rules.propensity_tier(df.select("id", "score"), "score")


@on_contacts(
    "campaign_projection",
    "y",
    """, b AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (y = 'yes')::DOUBLE / count(*) AS r FROM contacts)
  SELECT 'everyone' AS plan, n AS contacts, round(n * r, 6) AS conversions, round(100 * r, 6) AS efficiency_pct FROM b
  UNION ALL SELECT 'targeted', n * 0.4, round(n * 0.4 * r * 1.5, 6), round(150 * r, 6) FROM b""",
)
def campaign_projection(df: DataFrame) -> DataFrame:
    return neat(rules.campaign_projection(df, target=0.4, lift=1.5))


@on_contacts(
    "ab_test",
    "id balance y",
    """, a AS (SELECT *, CASE WHEN CAST('0x' || substr(md5('42:' || id), 1, 8) AS BIGINT) % 2 = 0 THEN 'model' ELSE 'random' END AS arm
    FROM contacts)
  SELECT arm, count(*) AS contacted, count(*) FILTER (y = 'yes') AS responses,"""
    + f" {RATE} AS rate FROM a WHERE arm = 'random' OR balance >= 5000 GROUP BY arm",
)
def ab_test(df: DataFrame) -> DataFrame:
    return neat(rules.ab_test(df, "balance", 5000, "id"))


SUMMARY_NUMERIC = ["balance", "duration", "campaign", "previous"]
SUMMARY_TEXT = ["job", "marital", "contact"]


def long_sql(section: str, item: str, measures: dict[str, str], source: str, text: str = "NULL") -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {item} AS item, '{m}' AS measure, round(({v})::DOUBLE, 4) + 0.0 AS value, {text} AS text FROM {source}"
        for m, v in measures.items()
    )


PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM contacts"
    for i, a in enumerate(SUMMARY_NUMERIC)
    for b in SUMMARY_NUMERIC[i + 1 :]
)

SUMMARY = (
    f""", top2 AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, y) AS seat FROM contacts GROUP BY y),
  imb AS (SELECT max(n) FILTER (seat = 1)::DOUBLE / max(n) FILTER (seat = 2) AS ratio FROM top2),
  imv AS (SELECT ratio, {VERDICT} FROM imb),
  sk AS ({SKEW.replace(NUMERIC[0], NUMERIC[0])} UNION ALL SELECT 'duration', round(s, 4) + 0.0,
    CASE WHEN abs(s) > 1 THEN 'high' WHEN abs(s) > 0.5 THEN 'moderate' ELSE 'normal' END FROM (SELECT skewness(duration) AS s FROM contacts)),
  lead AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) OVER () AS levels, {c} AS level, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM contacts) AS pct, "
        f"row_number() OVER (ORDER BY count(*) DESC, {c}) AS seat FROM contacts GROUP BY {c}"
        for c in SUMMARY_TEXT
    )
    + f"""), pairs AS ({PAIRS}), strong AS (SELECT * FROM pairs ORDER BY abs(r) DESC, f1, f2 LIMIT 1)
"""
    + " UNION ALL ".join(
        [
            long_sql("dataset", "'all'", {"rows": "count(*)", "columns": "8", "missing": "0"}, "contacts").replace(
                "round((8)::DOUBLE, 4) + 0.0 AS value, NULL AS text FROM contacts", "8.0::DOUBLE, NULL FROM imb"
            ).replace("round((0)::DOUBLE, 4) + 0.0 AS value, NULL AS text FROM contacts", "0.0::DOUBLE, NULL FROM imb"),
            long_sql(
                "target", "y", {"rows": "n", "pct": "p"},
                "(SELECT y, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM contacts) AS p FROM contacts GROUP BY y)",
            ),
            long_sql("target", "'imbalance'", {"ratio": "ratio"}, "imv", "verdict"),
            *[
                long_sql("numeric", f"'{c}'", {"min": f"min({c})", "max": f"max({c})", "mean": f"avg({c})", "median": f"median({c})"}, "contacts")
                for c in SUMMARY_NUMERIC
            ],
            long_sql("numeric", "name", {"skewness": "skewness"}, "sk", "verdict"),
            long_sql("categorical", "name", {"levels": "levels", "top_pct": "pct"}, "(SELECT * FROM lead WHERE seat = 1)", "level"),
            long_sql("correlation", "'strongest'", {"r": "r"}, "strong", "f1 || ' / ' || f2"),
        ]
    )
)


@on_contacts("eda_summary", " ".join([*SUMMARY_NUMERIC, *SUMMARY_TEXT, "y"]), SUMMARY)
def eda_summary(df: DataFrame) -> DataFrame:
    view = written(df, "summary-input")  # read by every part of the report
    return neat(reports.eda_summary(view, "y", SUMMARY_NUMERIC, SUMMARY_TEXT), 4)


FACTORS = (
    ", cr AS ("
    + many_sql(["contact", "poutcome"])
    + "), ab AS ("
    + binned_sql("balance", BALANCE_EDGES, BALANCE_LABELS)
    + "), cb AS ("
    + binned_sql("campaign", CAMPAIGN_EDGES, CAMPAIGN_LABELS)
    + """) SELECT 'contact' AS factor, 'best' AS item, first(level ORDER BY rate DESC, level) AS text, round(max(rate), 4) AS value
    FROM cr WHERE dimension = 'contact'
  UNION ALL SELECT 'contact', 'worst', first(level ORDER BY rate, level), round(min(rate), 4) FROM cr WHERE dimension = 'contact'
  UNION ALL SELECT 'contact', 'spread', NULL, round(max(rate) - min(rate), 4) FROM cr WHERE dimension = 'contact'
  UNION ALL SELECT 'outcome', 'first', 'F', round(rate, 4) FROM cr WHERE dimension = 'poutcome' AND level = 'F'
  UNION ALL SELECT 'outcome', 'second', 'P', round(rate, 4) FROM cr WHERE dimension = 'poutcome' AND level = 'P'
  UNION ALL SELECT 'outcome', 'gap', NULL, round(max(rate) FILTER (level = 'F') - max(rate) FILTER (level = 'P'), 4)
    FROM cr WHERE dimension = 'poutcome'
  UNION ALL SELECT 'money', 'median', y, round(median(balance), 4) FROM contacts GROUP BY y
  UNION ALL SELECT 'age', 'best', first(bin ORDER BY rate DESC, bin), round(max(rate), 4) FROM ab
  UNION ALL SELECT 'campaign', 'rate', bin, round(rate, 4) FROM cb WHERE pos IN (0, 4)"""
)


@on_contacts("top_factors", "contact poutcome balance campaign y", FACTORS)
def top_factors(df: DataFrame) -> DataFrame:
    return neat(
        reports.top_factors(
            written(df, "factor-input"),
            contact="contact",
            outcome="poutcome",
            outcome_levels=("F", "P"),
            money="balance",
            age=("balance", BALANCE_EDGES, BALANCE_LABELS),
            campaign=("campaign", CAMPAIGN_EDGES, CAMPAIGN_LABELS),
        ),
        4,
    )


HEADLINE = ["job", "marital", "contact", "month", "poutcome"]


@on_contacts(
    "headline_segments",
    " ".join([*HEADLINE, "y"]),
    ", o AS (SELECT avg(CASE WHEN y = 'yes' THEN 100.0::DOUBLE ELSE 0 END) AS overall FROM contacts), s AS ("
    + many_sql(HEADLINE).replace(RATE, "avg(CASE WHEN y = 'yes' THEN 100.0::DOUBLE ELSE 0 END)")
    + """) SELECT dimension, level, n, round(rate, 6) AS rate, round(overall, 6) AS overall, round(rate / overall, 6) AS lift
  FROM s, o""",
)
def headline_segments(df: DataFrame) -> DataFrame:
    return neat(reports.headline_segments(df, HEADLINE).withColumnRenamed("rows", "n"))
