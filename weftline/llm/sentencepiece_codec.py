"""Operator 8: SentencePiece encoding and decoding by exact backtracking (see piece_bpe)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, text_buffers


def _codec(model_path: str, with_ids: bool):
    def run(batches):
        from .piece_bpe import opened

        coder = opened(model_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at = coder.encode(*text_buffers(batch.column(1)))
            rows = list(coder.digests(ids, at))
            cols = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
            if with_ids:
                end = np.uint16(coder.model.eos)
                cols.append(pa.array([np.append(ids[at[i] : at[i + 1]], end).astype("<u2").tobytes() for i in range(len(rows))], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return run


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode whole texts with an end id, decode the ids again, and return (key, n_tokens, ids_sha256, decoded_sha256,
    ids: little-endian unsigned 16-bit).

    Null and empty texts give the end id alone and decode to the empty text. Null keys stay null; repeated rows each
    give a row; other columns, whatever their names, are not read. An empty table gives no rows. A narrow operator: no
    shuffle; a worker holds one Arrow batch and a cache of bounded size.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_codec(model_path, with_ids), schema)
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts (key, text) of binary ids as encode_decode returns them; null ids give a null text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        from .piece_bpe import opened

        coder = opened(model_path)
        for batch in batches:
            texts = [None if b is None else coder.decode(np.frombuffer(b, "<u2").tolist()).decode() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
