"""Operator 3: token ids of ordered documents in files of an adaptive context-mixing range coder (see id_coder).

A token table is a Parquet container with a row for each coded chunk: part (place in the order), chunk (place in the
part), the keys and id counts of its documents, and the coded bytes. A chunk holds whole documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bound_batches, partitions, scratch_dir, text_buffers
from .id_coder import CHUNK, decode_chunk, encode_chunk

_SCHEMA = "part int, chunk int, keys array<bigint>, counts array<bigint>, n_ids bigint, payload binary"


def write(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Encode whole texts (null: empty) with the tokenizers library's byte-level BPE, add end_id to each, and write
    them in ascending order of key (null keys first, rows with equal keys by text) as coded chunks under path.

    One shuffle of the texts, by ranges of the key. A task holds one chunk's ids and the coder's state; a document
    longer than a chunk makes a chunk of its own.
    """
    bound_batches(docs.sparkSession)
    if not 0 <= end_id < 1 << 16:
        raise ValueError("end_id does not fit 16 bits")

    def run(batches):
        from .bytebpe import opened

        coder = opened(tokenizer_path)
        part = TaskContext.get().partitionId()
        chunk = 0
        keys, counts, ids, held = [], [], [], 0

        def flush():
            row = [[part], [chunk], [keys], [counts], [held], [encode_chunk(np.concatenate(ids) if ids else np.zeros(0, np.uint16))]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["part", "chunk", "keys", "counts", "n_ids", "payload"])

        for batch in batches:
            got, at = coder.encode(*text_buffers(batch.column(1)))
            texts = len(at) - 1
            ended = np.insert(got, at[1:], np.uint16(end_id))
            size = np.diff(at) + 1
            stop = np.cumsum(size)
            own, i = batch.column(0).to_pylist(), 0
            while i < texts:
                # As many documents as fit, one at least.
                base = int(stop[i - 1]) if i else 0
                j = int(np.searchsorted(stop, base + CHUNK - held, side="right"))
                if j <= i and held:
                    yield flush()
                    chunk, keys, counts, ids, held = chunk + 1, [], [], [], 0
                    continue
                j = max(j, i + 1)
                keys, counts = keys + own[i:j], counts + size[i:j].tolist()
                ids.append(ended[base : int(stop[j - 1])])
                held += int(stop[j - 1]) - base
                i = j
        if keys:
            yield flush()

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "text")
    # Row groups of a few chunks each, so that a reader holds a few.
    ordered.mapInArrow(run, _SCHEMA).write.option("parquet.block.size", 16 << 20).option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the decoded chunks: start counts the ids of all
    documents before it in the order, ids_crc32 is over its ids as little-endian unsigned 32-bit numbers."""
    table = spark.read.schema(_SCHEMA).parquet(path)

    def run(batches):
        for batch in batches:
            for part, chunk, keys, counts, n, payload in zip(*(c for c in batch.columns)):
                ids = decode_chunk(payload.as_py())
                if len(ids) != n.as_py():
                    raise ValueError("a chunk has not the ids it states")
                size = np.array(counts.as_py(), np.int64)
                stop = np.cumsum(size)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[b - s : b]) for s, b in zip(size.tolist(), stop.tolist())]
                m = len(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, part.as_py(), np.int32)), pa.array(np.full(m, chunk.as_py(), np.int32)), keys.values, pa.array(stop - size), pa.array(size), pa.array(crc, pa.int64())],
                    names=["part", "chunk", "key", "within", "n_tokens", "ids_crc32"],
                )

    docs = table.mapInArrow(run, "part int, chunk int, key bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    # Sums of the parts before, and of the chunks before in the part: one row for each part and chunk.
    sizes = table.select("part", "chunk", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = sizes.select("part", "chunk", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own")).join(parts, "part")
    out = docs.join(chunks, ["part", "chunk"])
    return out.select(F.col("key").alias(key), (F.col("base") + F.col("own") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, path: str | None = None) -> DataFrame:
    """write() under path (or in the shared folder), then read(). Repeated rows each have a place in the order; an
    empty table gives no rows; other columns are not read."""
    path = path or f"{scratch_dir(docs.sparkSession)}/ids"
    write(docs, path, tokenizer_path, key, text, end_id)
    return read(docs.sparkSession, path, key)
