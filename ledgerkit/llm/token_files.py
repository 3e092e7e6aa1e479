"""Token-id files: documents as token ids in ascending doc_id order, coded by the range coder.

A file set is a Parquet table of segments (``part``, ``seg``, ``n_docs``, ``n_tokens``, ``payload``); the
payload is the coder's own format (see ``range_coder``). Order: by part, then seg, then within the
payload. Segments hold whole documents and are closed at ``SEGMENT`` ids; at the end
of a part, a rest of up to half of that joins the segment before it, as few blocks cost nearly as much as many.

Scale: one range shuffle of the texts by doc_id puts neighbours together; every task then codes its part
alone. Starts come from totals of parts and segments, never from rows. Files are read segment by segment.

Defined results: null text is empty and holds the end id alone; null doc_ids come first; repeated rows
are written each, in the order of their text; an empty table writes no segment.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerkit.llm.common import materialise, remove, scratch_root
from ledgerkit.llm.range_coder import BLOCK, MOST_IDS, decode_segment, encode_segment
from ledgerkit.llm.tokens import CHUNK, TOKENIZER, encoder
from ledgerkit.llm.words import chunks

END_ID = 0
#: Ids of a segment: as many blocks as are coded in step.
SEGMENT = 2048 * BLOCK
_SEGMENTS = "part int, seg int, n_docs long, n_tokens long, payload binary"


def _encode(name: str, end_id: int, segment: int):
    def run(batches):
        part, seg = TaskContext.get().partitionId(), 0
        keys, lengths, ids, waiting = [], [], [], None

        def close(keys, lengths, ids):
            n = np.concatenate(lengths)
            data = encode_segment([k for some in keys for k in some.to_pylist()], n, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (seg, pa.int32()), (len(n), pa.int64()), (int(n.sum()), pa.int64()), (data, pa.binary()))], names=["part", "seg", "n_docs", "n_tokens", "payload"])

        size = 0
        for batch in chunks(batches, 1, CHUNK, keep=True):
            coded, bounds = encoder(name).column(batch.column(1))
            if len(coded) and coded.max() >= MOST_IDS:
                raise ValueError(f"ids must lie below {MOST_IDS}")
            coded = np.insert(coded, bounds[1:], end_id).astype(np.uint16)
            starts = bounds + np.arange(len(bounds))
            at = 0
            while at < batch.num_rows:
                # Documents up to the first that fills the segment.
                end = min(batch.num_rows, int(np.searchsorted(starts, starts[at] + segment - size)))
                keys.append(batch.column(0).slice(at, end - at))
                lengths.append(np.diff(starts[at : end + 1]))
                ids.append(coded[starts[at] : starts[end]])
                size += int(starts[end] - starts[at])
                at = end
                if waiting and size > segment // 2:
                    yield close(*waiting)
                    waiting, seg = None, seg + 1
                if size >= segment:
                    waiting = keys, lengths, ids
                    keys, lengths, ids, size = [], [], [], 0
        if waiting:
            keys, lengths, ids = (a + b for a, b in zip(waiting, (keys, lengths, ids)))
        if keys:
            yield close(keys, lengths, ids)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode(tokenizer, end_id, segment), _SEGMENTS).write.parquet(path)


def _decode(batches):
    for batch in batches:
        for part, seg, payload in zip(*(c.to_pylist() for c in batch.columns)):
            doc_ids, lengths, ids = decode_segment(payload)
            ends = np.cumsum(lengths)
            raw = memoryview(ids.tobytes())
            crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seg, np.int32)), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                names=["part", "seg", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(_SEGMENTS).parquet(path)
    sizes = files.select("part", "seg", "n_tokens")
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(ahead, F.lit(0)).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, "part").select("part", "seg", (F.col("before") + F.col("within")).alias("base"))
    rows = files.select("part", "seg", "payload").mapInArrow(_decode, "part int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the documents' files to the shared folder and read them back; the rows stay, the files go."""
    path = f"{scratch_root(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path)
    rows = materialise(read_token_files(docs.sparkSession, path), "token-rows")
    remove(docs.sparkSession, path)
    return rows
