"""Quality rules whose cutoffs are chosen under a proven bound on false rejection.

Every rule compares a ratio of counts with a cutoff. Labelled good documents are the
holdout: per stratum, rule and candidate cutoff the rejected ones are counted, and a cutoff
may be used only if the exact binomial (Clopper-Pearson) upper bound on its false-rejection
rate is at most the rule's share of ``risk``, at a confidence that is divided among all
strata, rules and cutoffs (Bonferroni). The strictest such cutoff is taken; a stratum with
too few labelled documents gets none, and its documents pass the rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.texts import BLANKS, UPPER, slices
from campaignlens.session import written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Rule: (count, its base, candidate cutoffs in thousandths of the base).
RULES = {
    "symbols": ("n_symbols", "n_words", (50, 100, 200, 400, 800)),
    "upper": ("n_upper", "word_chars", (100, 200, 300, 500, 700)),
    "dup_lines": ("n_dup_lines", "n_lines", (100, 200, 300, 400, 600)),
    "repeats": ("n_repeat_words", "n_words", (50, 100, 150, 200, 250)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Per text, the words inside windows that occur twice or more in it.

    Windows are compared exactly: words are numbered per text, then pairs of numbers, pairs
    of pairs and so on, until a number stands for a whole window (a power of two of words).
    """
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.empty(int(sizes.sum()), np.int64)
    at, base = 0, 0
    for w in words:
        seen: dict[bytes, int] = {}
        ids[at : at + len(w)] = [seen.setdefault(x, len(seen)) for x in w]
        ids[at : at + len(w)] += base
        at, base = at + len(w), base + len(seen)
    out = np.zeros(len(words), np.int64)
    if len(ids) < window:
        return out
    text = np.repeat(np.arange(len(words)), sizes)
    step = 1
    while step < window:
        ids = ids[:-step] * (ids.max() + 1) + ids[step:]
        ids = np.unique(ids, return_inverse=True)[1]
        step *= 2
    inside = np.flatnonzero(text[: len(ids)] == text[window - 1 :])
    if not len(inside):
        return out
    _, which, n = np.unique(ids[inside], return_inverse=True, return_counts=True)
    starts = inside[n[which] > 1]
    edges = np.zeros(len(text) + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    np.add.at(out, text[np.cumsum(edges[:-1]) > 0], 1)
    return out


def text_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of a list of texts, an array each."""
    upper, rows, words = UPPER.encode(), [], []
    for text in texts:
        text = text or ""
        data = text.encode()
        w = data.split()
        words.append(w)
        lines = [line for line in text.split("\n") if line.strip(BLANKS)]
        rows.append(
            (
                len(w),
                len(text) - sum(map(text.count, BLANKS)),
                sum(map(text.count, SYMBOLS)),
                len(lines) - len(set(lines)),
                0,
                len(data) - len(data.translate(None, upper)),
                len(lines),
            )
        )
    table = np.array(rows, np.int64).reshape(-1, len(COUNTS))
    table[:, 4] = repeated_words(words)
    return {name: table[:, i] for i, name in enumerate(COUNTS)}


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table without its text and with the counts of it (``COUNTS``, all long)."""
    rest = [c for c in docs.columns if c != text_col]
    schema = docs.select(*rest).schema
    for name in COUNTS:
        schema = schema.add(name, T.LongType(), False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            counts = text_counts(batch.column(len(rest)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c) for c in counts.values()]], names=schema.names)

    return docs.select(*rest, text_col).mapInArrow(run, schema)


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def exceeds(rule: str, cutoff: Column) -> Column:
    count, base, _ = RULES[rule]
    return 1000 * F.col(count) > cutoff * F.col(base)


def binomial_tail(n: int, x: int, p: float) -> float:
    """P(X <= x) of a binomial with n draws; the upper bound on the rate is below p when this is small."""
    if x >= n:
        return 1.0
    if x >= n * p:  # at or above the mean: no bound below p is near, and the sum would be long
        return 1.0
    term = math.exp(
        math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)
    )
    total = 0.0
    while x >= 0 and term > total * 1e-18:
        total += term
        term *= x * (1 - p) / ((n - x + 1) * p)
        x -= 1
    return total


def cutoffs(good: DataFrame, stratum: str, risk: float, error: float) -> DataFrame:
    """One row per stratum with the cutoff of each rule, null where none is safe.

    ``good`` has the counts of labelled good documents that pass the base rule. With
    probability 1 - ``error``, no stratum's rules together reject more than ``risk`` of
    its good documents.
    """
    names = [f"{rule}_{c}" for rule, (_, _, options) in RULES.items() for c in options]
    counted = written(
        good.groupBy(stratum).agg(
            F.count("*").alias("n"),
            *[
                F.sum(exceeds(rule, F.lit(c)).cast("long")).alias(f"{rule}_{c}")
                for rule, (_, _, options) in RULES.items()
                for c in options
            ],
        ),
        "holdout",
    )
    share, level = risk / len(RULES), error / max(1, counted.count() * len(names))
    schema = T.StructType([counted.schema[stratum], *[T.StructField(rule, T.LongType()) for rule in RULES]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            columns = [batch.column(0)]
            for rule, (_, _, options) in RULES.items():
                safe = [[c for c in options if binomial_tail(r["n"], r[f"{rule}_{c}"], share) <= level] for r in rows]
                columns.append(pa.array([min(s, default=None) for s in safe], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return written(counted.mapInArrow(run, schema), "cutoffs")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    risk: float = 0.05,
    error: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
) -> DataFrame:
    """Per row: id, stratum, the counts, ``base_failed``, ``failed_rules`` (an array) and ``kept``.

    ``labels`` has the id and ``quality`` (1 good); of repeated labels the smallest counts.
    Labelled good documents that pass the base rule are the holdout.

    A null or empty text has no words and fails the base rule. A null stratum is a stratum.
    Rows that repeat an id are judged each; rows without an id are never labelled. Without
    labels, or with too few, only the base rule rejects. An empty table gives an empty one.
    Other columns are not read, so their names cannot clash.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    rows = written(measured(slim), "measures").withColumn("base_failed", base_failed())
    good = labels.groupBy(F.col(id_col).alias("good_id")).agg(F.min("quality").alias("quality")).where("quality = 1")
    holdout = rows.where(~F.col("base_failed")).join(good, F.col("id") == F.col("good_id"))
    limits = cutoffs(holdout, "stratum", risk, error).withColumnRenamed("stratum", "limit_stratum")
    judged = rows.join(limits, F.col("stratum").eqNullSafe(F.col("limit_stratum")), "left")
    failed = F.array_compact(
        F.array(*[F.when(exceeds(rule, F.col(rule)), F.lit(rule)) for rule in RULES])
    )
    return judged.select(
        F.col("id").alias(id_col),
        F.col("stratum").alias(stratum_col),
        *COUNTS,
        "base_failed",
        failed.alias("failed_rules"),
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"),
    )
