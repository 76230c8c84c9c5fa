"""WARC bundles: formats, edge cases, random access, the query beside its SQL."""

from __future__ import annotations

import glob
import hashlib
import io
import os

import duckdb
import pytest
import zstandard
from pyarrow import fs as pafs

from campaignlens.llm import bundles, warc_queries
from campaignlens.llm.registry import ORACLES
from campaignlens.llm.warc import fetch_records, read_archive, resolved, write_archive
from campaignlens.session import shared_dir

SCHEMA = "page_id long, url string, html string, owner string, digest int"
LONG = "<p>é</p>" * 300
ROWS = [
    (1, "http://a/\r\nX: y ü", LONG, "x", 1),
    (5, None, LONG, None, None),
    (3, "http://c", LONG, "x", 1),
    (None, "http://d", LONG, "x", 1),
    (7, "http://e", None, "x", 1),
    (8, "http://f", "", "x", 1),
    (9, "http://g", "short", "x", 1),
    (10, "http://h", "short", "x", 1),
    (11, "http://i", "y" * 3_000_000, "x", 1),
    (11, "http://i", "y" * 3_000_000, "x", 1),
    (12, "http://j", "\r\n\r\nWARC/1.1\r\n" * 100, "x", 1),
]


def expected():
    out = []
    for page, _, html, *_ in ROWS:
        data = (html or "").encode()
        owner = max((r[0] for r in ROWS if r[2] == html and r[0] is not None), default=None)
        revisit = len(data) >= 1000 and page != owner
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=repr)


def test_bundle_is_seekable_zstandard():
    files = []

    class Kept(io.BytesIO):
        def close(self):
            files.append(self.getvalue())

    writer = bundles.BundleWriter(lambda: (f"b{len(files)}", Kept()), frame_bytes=1000, bundle_bytes=3000)
    data = {f"urn:page:{i}": os.urandom(i * 37 % 1500) for i in range(40)}
    places = []
    for name, payload in data.items():
        places += writer.add(name, bundles.record(name, "response", payload, bundles.sha1(payload), None, "2024-01-01T00:00:00Z", None))
    places += writer.close()
    assert len(files) > 3 and [p[0] for p in places] == list(data)
    for name, bundle, frame, start, size, offset, length in places:
        raw = files[int(bundle[1:])]
        table = bundles.seek_table(io.BytesIO(raw), len(raw))
        assert table[frame][:2] == (start, size)
        plain = bundles.read_frame(io.BytesIO(raw), table[frame])
        fields, payload, following = bundles.parse(plain, offset)
        assert (fields["WARC-Record-ID"], payload, following - offset) == (f"<{name}>", data[name], length)
        # A plain Zstandard reader sees all records and skips the table.
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert payload in whole
    with pytest.raises(ValueError):
        bundles.seek_table(io.BytesIO(b"0" * 100), 100)


def test_archive(spark):
    folder = shared_dir(spark, "warc-test")
    index = write_archive(spark.createDataFrame(ROWS, SCHEMA).repartition(3), folder, frame_bytes=4000)
    assert index.count() == len(ROWS)
    found = read_archive(spark, folder)
    number = lambda s: int(s.split(":")[2]) if s and s.split(":")[2] else None
    rows = sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in resolved(found).collect()), key=repr)
    assert rows == expected()
    one = fetch_records(spark.createDataFrame([("urn:page:12",), ("urn:page:99",)], "record_id string"), folder).collect()
    assert [(r.record_id, bytes(r.payload)) for r in one] == [("urn:page:12", ROWS[-1][2].encode())]
    uri = [r.target_uri for r in found.collect() if r.record_id == "urn:page:1"]
    assert uri == ["http://a/%0D%0AX:%20y%20%C3%BC"]
    # A file that no index names is not read.
    system, path = pafs.FileSystem.from_uri(f"{folder}/bundles/left-over.warc.zst")
    with system.open_output_stream(path) as f:
        f.write(b"broken")
    assert read_archive(spark, folder).count() == len(ROWS)


def test_empty_archive(spark):
    folder = shared_dir(spark, "warc-test")
    assert write_archive(spark.createDataFrame([], SCHEMA), folder).count() == 0
    assert read_archive(spark, folder).count() == 0


def test_query_agrees_with_sql(spark):
    directory, db = "/root/testdata/sf0.001", duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df, sql = warc_queries.op2_warc_bundles(spark, directory), db.sql(ORACLES["op2_warc_bundles"])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(repr, sql.select(*names).fetchall()))
