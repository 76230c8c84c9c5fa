"""Web pages to WARC archives in seekable Zstandard bundles, and back.

Every task writes bundles of its own to the archive's folder, in the shared store, and
returns the places of its records; the index made of them is the commit: files of failed
attempts are in no index and are never read. Bundles are written and read through
``pyarrow.fs``, so the folder may be any store that it knows (file, HDFS, object stores).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.bundles import FRAME_BYTES, BundleWriter, digest_of, parse, read_frame, record, records, seek_table, sha1
from campaignlens.llm.texts import slices
from campaignlens.session import written

MIN_REVISIT = 1000
FRAMES_PER_TASK = 16
PREFIX = "urn:page:"
DATE = "2024-01-01T00:00:00Z"

INDEX = "record_id string, bundle string, frame int, frame_start long, frame_size long, offset long, size long"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long"


def _opened(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    info = system.get_file_info(path)
    return system.open_input_file(path), info.size


def write_archive(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit: int = MIN_REVISIT,
    date: str = DATE,
    frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Writes one record per row and returns the index: where each record is.

    The payload is the page in UTF-8, empty for null. Of equal payloads of at least
    ``min_revisit`` bytes, the row with the largest id is a response and the others are
    revisits that refer to it; all smaller ones are responses.

    A null id is smaller than every other; rows that repeat the largest id are responses
    all. A null address leaves the field out. An empty table gives an empty archive. Only the
    three named columns are read, so other names cannot clash.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload")
    ).select("*", F.octet_length("payload").alias("bytes"), F.sha2("payload", 256).alias("content"))
    # Only payloads that occur twice have an owner; partial counts come before the shuffle.
    owners = written(
        rows.where(F.col("bytes") >= min_revisit)
        .groupBy(F.col("content").alias("owned"))
        .agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
        .where("n > 1 AND owner IS NOT NULL")
        .select("owned", "owner"),
        "owners",
    )
    planned = rows.join(owners, F.col("content") == F.col("owned"), "left").select(
        "page_id",
        "url",
        "payload",
        F.sha1("payload").alias("digest"),
        F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def create():
            system, path = pafs.FileSystem.from_uri(f"{folder}/bundles")
            system.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            return f"{folder}/bundles/{name}", system.open_output_stream(f"{path}/{name}", compression=None)

        def placed(places: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*places, strict=True))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        writer = BundleWriter(create, frame_bytes)
        for batch in slices(batches, "payload"):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for page, url, payload, digest, refers in zip(*columns, strict=True):
                name = PREFIX + ("" if page is None else str(page))
                kind = "response" if refers is None else "revisit"
                target = None if refers is None else PREFIX + str(refers)
                if places := writer.add(name, record(name, kind, payload, digest, url, date, target)):
                    yield placed(places)
        if places := writer.close():
            yield placed(places)

    names = [f.split()[0] for f in INDEX.split(", ")]
    planned.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _by_frame(index: DataFrame, offsets: bool) -> DataFrame:
    """One row per frame of an index, spread over tasks."""
    frames = index.groupBy("bundle", "frame", "frame_start", "frame_size").agg(
        *([F.collect_set("offset").alias("offsets")] if offsets else [F.count("*").alias("n")])
    )
    tasks = index.select("bundle", "frame").distinct().count() // FRAMES_PER_TASK + 1
    return frames.repartition(tasks, "bundle", "frame")


def _read(frames: DataFrame, payloads: bool) -> DataFrame:
    schema = T.StructType.fromDDL(RECORD)
    if payloads:
        schema = schema.add("payload", T.BinaryType())

    def rows(frame: dict, file, table: list) -> Iterator[tuple]:
        entry = table[frame["frame"]]
        if entry[:2] != (frame["frame_start"], frame["frame_size"]):
            raise ValueError("index and seek table differ")
        data = read_frame(file, entry)
        wanted = frame.get("offsets")
        found = records(data) if wanted is None else ((o, *parse(data, o)[:2]) for o in sorted(wanted))
        for _, fields, payload in found:
            kind, digest = fields["WARC-Type"], digest_of(fields)
            if kind == "response" and sha1(payload) != digest:
                raise ValueError("payload does not match its digest")
            refers = fields.get("WARC-Refers-To")
            row = (
                fields["WARC-Record-ID"][1:-1],
                kind,
                fields.get("WARC-Target-URI"),
                refers[1:-1] if refers else None,
                digest,
                len(payload) if kind == "response" else None,
            )
            yield (*row, payload if kind == "response" else None) if payloads else row

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64()] + [pa.binary()] * payloads
        for batch in batches:
            for frame in batch.to_pylist():
                file, size = _opened(frame["bundle"])
                with file:
                    columns = list(zip(*rows(frame, file, seek_table(file, size)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    return frames.mapInArrow(run, schema)


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of an archive, frame by frame; digests of responses are checked.

    A revisit has no payload of its own: its ``payload`` and ``payload_bytes`` are null.
    """
    return _read(_by_frame(spark.read.schema(INDEX).parquet(f"{folder}/index"), False), payloads)


def fetch_records(ids: DataFrame, folder: str) -> DataFrame:
    """The records whose ``record_id`` is in ``ids``, read from their frames alone."""
    index = ids.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")
    return _read(_by_frame(index.join(ids.select("record_id").distinct(), "record_id", "left_semi"), True), True)


def resolved(read: DataFrame) -> DataFrame:
    """Records with the payload size of a revisit taken from the response it refers to."""
    sizes = (
        read.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("response_id"), F.col("payload_digest").alias("response_digest"))
        .agg(F.max("payload_bytes").alias("response_bytes"))
    )
    same = (F.col("refers_to") == F.col("response_id")) & (F.col("payload_digest") == F.col("response_digest"))
    return read.join(sizes, same, "left").select(
        "record_id", "record_type", "target_uri", "refers_to", "payload_digest",
        F.coalesce("payload_bytes", "response_bytes").alias("payload_bytes"),
    )
