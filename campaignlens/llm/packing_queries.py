"""The query of the packing operator, tested by brute force."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from campaignlens.llm.byte_pairs import BytePairs
from campaignlens.llm.packing import pack_documents
from campaignlens.llm.registry import query
from campaignlens.llm.texts import tokenizer_path
from campaignlens.sources.readers import read_table

TOKENIZER = "byte_bpe_50k.json"


def ids_checksum(batches):
    """The batches with the crc32 of each row's ids, as little-endian unsigned 32-bit numbers, in the place of the ids."""
    for batch in batches:
        column = batch.column("ids")
        at, values = column.offsets.to_numpy(), memoryview(column.values.to_numpy().astype("<u4")).cast("B")
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        place = batch.schema.get_field_index("ids")
        yield batch.set_column(place, pa.field("ids_crc32", pa.int64()), pa.array(np.array(sums, np.int64)))


@query("op13_power_of_two_packing")
def op13_power_of_two_packing(spark, sf_dir):
    tokenizer = BytePairs.load(tokenizer_path(spark, TOKENIZER))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack_documents(docs, tokenizer, longest=1024, end_id=0)
    return packed.mapInArrow(
        ids_checksum,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
