"""The query of the WARC operator, beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from campaignlens.llm.registry import query
from campaignlens.llm.warc import PREFIX, read_archive, resolved, write_archive
from campaignlens.session import shared_dir, written
from campaignlens.sources.readers import read_table


@query(
    "op2_warc_bundles",
    """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
owned AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM sized)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM owned
""",
)
def op2_warc_bundles(spark, sf_dir):
    folder = shared_dir(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), folder)
    found = resolved(written(read_archive(spark, folder, payloads=False), "records"))
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PREFIX) + 1}) AS bigint)")
    return found.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )
