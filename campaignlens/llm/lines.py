"""Line dedup: lines that many documents share stay in one of them.

Lines are exploded as 128-bit hashes of their normalised form, documents are counted
per hash, and each document is put together again from the positions of the lines it
keeps. Only hashes, positions and ids are shuffled with the counts; a document's text
moves once, to meet its list of dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlens.llm.texts import BLANKS, fold_case, free_name
from campaignlens.session import written


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lowered."""
    return fold_case(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents without the lines that ``min_docs`` or more of them share.

    A line counts when its key has at least ``min_chars`` code points. All lines of a
    frequent key go, except those of the document with the largest id that holds it.
    Adds ``n_lines`` (before) and ``n_dropped``; if the table has columns of these
    names, underscores are added to the new ones. Every other column stays as it is.

    A null or empty text is one empty line and comes back as the empty string. Rows that
    repeat an id are one document when documents are counted, and each row is cleaned.
    All rows without an id count as one document, which comes before every other. An
    empty table gives an empty table. Texts of any length are read whole.
    """
    print_col, row, n_lines, n_dropped, left_id, left_print = (
        free_name(docs, c) for c in ("text_print", "dropped_at", "n_lines", "n_dropped", "left_id", "left_print")
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)

    # One row per long line: which text (id and fingerprint), where, and the key's hash.
    placed = docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.md5(text)).alias("print"),
        F.posexplode(F.transform(lines, line_key)).alias("at", "key"),
    ).where(F.char_length("key") >= min_chars)
    hashed = written(placed.select("id", "print", "at", F.unhex(F.md5("key")).alias("hash")), "lines")

    # Documents per hash: first one row per hash and document, so that a hash found
    # everywhere is counted in parts before its parts meet. Both tables are written, so
    # that texts are hashed once and a join of plain tables can split a frequent hash.
    frequent = written(
        hashed.groupBy("hash", "id")
        .agg(F.lit(1).alias("one"))
        .groupBy("hash")
        .agg(F.count("one").alias("held_by"), F.max("id").alias("owner"))
        .where(F.col("held_by") >= min_docs)
        .select(F.col("hash").alias("frequent_hash"), "owner"),
        "frequent",
    )
    dropped = (
        hashed.join(frequent, F.col("hash") == F.col("frequent_hash"))
        .where(~F.col("id").eqNullSafe(F.col("owner")))
        .groupBy("id", "print")
        .agg(F.collect_set("at").alias(row))
        .withColumnsRenamed({"id": left_id, "print": left_print})
    )

    named = docs.withColumn(print_col, F.unhex(F.md5(text)))
    joined = named.join(
        dropped,
        F.col(id_col).eqNullSafe(F.col(left_id)) & (F.col(print_col) == F.col(left_print)),
        "left",
    )
    gone = F.coalesce(F.col(row), F.array().cast("array<int>"))
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone),
        lambda at: F.get(lines, at),
    )
    return joined.select(
        *[
            F.when(F.col(row).isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(c)
            for c in docs.columns
        ],
        F.size(lines).cast("long").alias(n_lines),
        F.size(gone).cast("long").alias(n_dropped),
    )
