"""Language of whole texts, word by word, by a conditional random field learned from labelled documents."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.crf import RUN, Tagger, cut, in_runs, train
from campaignlens.llm.texts import BLANKS, free_name, slices

# Bounds of the training sample per language: documents, spans of each, words of a span.
MAX_DOCS, SPANS, SPAN_WORDS = 200, 6, 10
LEXICON_WORDS, LEXICON_SHARE = 500, 0.9
UNKNOWN = "und"
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SPANS spans of SPAN_WORDS words of each text, at equal distances; long words count as their runs."""
    for batch in slices(batches, "text"):
        split = (cut(_BLANKS.split(t.strip(BLANKS))) for t in batch.column("text").to_pylist())
        spans = [[words[at : at + SPAN_WORDS] for at in (j * len(words) // SPANS for j in range(SPANS))] for words in split]
        arrays = [batch.column("lang"), batch.column("pair"), pa.array(spans, pa.list_(pa.list_(pa.string())))]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "pair", "spans"])


def lexicons(docs: DataFrame, lang_col: str, text_col: str, size: int = LEXICON_WORDS) -> DataFrame:
    """(word, lang): the most frequent words that are almost only of one language, counted over all documents."""
    words = docs.select(F.col(lang_col).alias("lang"), F.explode(F.split(F.lower(text_col), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counted = words.groupBy("word", "lang").agg(F.count("*").alias("n"))
    best = counted.groupBy("word").agg(F.sum("n").alias("total"), F.max(F.struct("n", "lang")).alias("top"))
    own = best.where(F.col("top.n") >= LEXICON_SHARE * F.col("total")).select("word", "top.n", "top.lang")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return own.withColumn("rank", rank).where(F.col("rank") <= size).select("word", "lang")


def fit_language(
    docs: DataFrame,
    learn: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = MAX_DOCS,
    seed: int = 1,
) -> Tagger:
    """A tagger learned from documents with a language; ``learn`` restricts them.

    Lexicons count every word of every such document. The weights are fitted on a bounded
    sample: about ``max_docs`` documents of each language by the hash of id and text, of which
    equal pairs are one document and ids may be null, and of each text, however long, SPANS spans of SPAN_WORDS words at equal distances, where a word
    of more than RUN letters counts as runs of at most so many. Spans of different languages
    are joined at random, so that transitions are learned from switches.
    The driver holds the spans and at most LEXICON_WORDS words per language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (learn if learn is not None else F.lit(True)))
    # Equal rows are one example; a narrow count, merged before it is shuffled.
    pair = F.xxhash64(F.col(id_col), F.col(text_col))
    pairs = known.select(F.col(lang_col).alias("lang"), pair.alias("pair")).distinct()
    counts = {r["lang"]: r["n"] for r in pairs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return Tagger([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    draw = F.shiftrightunsigned(pair, 32)
    limit = F.coalesce(*[F.when(F.col(lang_col) == lang, F.lit(int(min(1.0, max_docs / n) * (1 << 32)))) for lang, n in counts.items()])
    drawn = (
        known.where(draw < limit)
        .select(F.col(lang_col).alias("lang"), pair.alias("pair"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_spans, f"lang {known.select(lang_col).dtypes[0][1]}, pair long, spans array<array<string>>")
        .dropDuplicates(["lang", "pair"])
        .toArrow()
        .to_pylist()
    )
    place = {lang: i for i, lang in enumerate(labels)}
    lexicon: dict[str, int] = {}
    # Runs of a long word stand for it; whole words go first.
    for r in sorted(lexicons(known, lang_col, text_col).collect(), key=lambda r: (len(r["word"]) > RUN, r["word"])):
        for word in in_runs(r["word"]) if len(r["word"]) > RUN else [r["word"]]:
            lexicon.setdefault(word, place[r["lang"]])
    drawn.sort(key=lambda r: (r["lang"], r["pair"]))
    pieces = [(place[r["lang"]], span) for r in drawn for span in r["spans"] if any(span)]
    order = np.random.default_rng(seed).permutation(len(pieces))
    chains = [[w for o in order[i : i + 4] for w in pieces[o][1]] for i in range(0, len(order), 4)]
    targets = [[pieces[o][0] for o in order[i : i + 4] for _ in pieces[o][1]] for i in range(0, len(order), 4)]
    return train(chains, targets, labels, lexicon)


def _summed(tagger: Tagger, words: list[str], lettered: np.ndarray, chances: np.ndarray, tagged: bool) -> tuple:
    likely = chances.argmax(axis=1) if len(words) else np.zeros(0, np.int64)
    tags = [tagger.labels[i] for i in likely] if tagged else None
    if not lettered.any():
        return UNKNOWN, 0.0, 0, tags
    mean = chances[lettered].mean(axis=0)
    best = int(mean.argmax())
    return tagger.labels[best], min(1.0, float(mean[best])), int((np.diff(likely[lettered]) != 0).sum()), tags


def predict_language(docs: DataFrame, tagger: Tagger, text_col: str = "text", labels_col: str | None = None, keep_text: bool = True) -> DataFrame:
    """The table (without its text if not ``keep_text``) with ``lang_pred``, ``score`` and ``n_switches`` added (underscores added to taken names).

    Every word of the whole text gets label probabilities by forward-backward; the language
    is the one with the largest mean over words with letters, ``score`` is that mean, and
    ``n_switches`` counts changes of the likeliest label from one such word to the next.
    With ``labels_col`` the words' likeliest labels are added too, as an array. A word of
    more than RUN letters, as of a text without blanks, counts as several words, the runs
    of at most RUN letters that it is cut into. Long texts are worked in windows, exactly, so
    that memory does not grow with the text, and windows are the smaller the more labels.

    A null text, a text without letters, and any text when nothing was learned are ``und``
    with score 0. Ties go to the first language in alphabetical order. Repeated rows are
    predicted alike; an empty table stays empty.
    """
    name, score, switches = (free_name(docs, c) for c in ("lang_pred", "score", "n_switches"))
    rest = [c for c in docs.columns if keep_text or c != text_col]
    extra = [T.StructField(name, T.StringType(), False), T.StructField(score, T.DoubleType(), False), T.StructField(switches, T.LongType(), False)]
    if labels_col:
        extra.append(T.StructField(free_name(docs, labels_col), T.ArrayType(T.StringType())))
    schema = T.StructType([*[docs.schema[c] for c in rest], *extra])

    def one(text: str) -> tuple:
        """Sums over the windows of a text."""
        sums, n, changes, last, tags = np.zeros(len(tagger.labels)), 0, 0, -1, []
        for words, lettered, chances in tagger.tag_windows(text):
            likely = chances.argmax(axis=1) if len(words) else np.zeros(0, np.int64)
            if labels_col:
                tags += [tagger.labels[i] for i in likely]
            if lettered.any():
                sums += chances[lettered].sum(axis=0)
                n += int(lettered.sum())
                seen = likely[lettered]
                changes += int((np.diff(seen) != 0).sum()) + int(0 <= last != seen[0])
                last = int(seen[-1])
        if not n:
            return UNKNOWN, 0.0, 0, tags
        best = int(sums.argmax())
        return tagger.labels[best], min(1.0, float(sums[best] / n)), changes, tags

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, tagger.window):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            if not tagger.labels:
                rows = [(UNKNOWN, 0.0, 0, [None] * len(cut(t.split()))) for t in texts]
            elif len(texts) == 1 and len(texts[0]) > tagger.window:
                rows = [one(texts[0])]
            else:
                rows = [_summed(tagger, *found, bool(labels_col)) for found in tagger.tag(texts)]
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())]
            if labels_col:
                arrays.append(pa.array(columns[3], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *arrays], names=schema.names)

    return docs.mapInArrow(run, schema)
