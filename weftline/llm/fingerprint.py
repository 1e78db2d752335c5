"""Operator 4: bottom-k sketches of word shingles, and documents against edited versions of themselves.

A sketch is the k least of the distinct 48-bit shingle hashes of a text, written as "k.n.hashes": n is the number of
hashes kept, and if it is under k the sketch is the whole set. Hashes are base64 of big-endian 6-byte numbers in
ascending order. Sketches of parts merge to the sketch of the whole.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, partitions, text_buffers
from .words import shingles

K = 128
_BITS = 48


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct values."""
    if len(hashes) > 4 * k:
        few = np.unique(np.partition(hashes, 2 * k)[: 2 * k + 1])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def sketches(texts: list[bytes] | None = None, data=None, offs=None, k: int = K, width: int = 5) -> list[np.ndarray]:
    """Sketches of whole texts."""
    if texts is not None:
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = b"".join(texts)
    h, at = shingles(data, offs, width)
    h = h >> np.uint64(64 - _BITS)
    at = at.tolist()
    return [bottom(h[a:b], k) for a, b in zip(at[:-1], at[1:])]


def write(sketch: np.ndarray, k: int = K) -> str:
    return f"{k}.{len(sketch)}.{base64.b64encode(sketch.astype('>u8').view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()}"


def read(text: str) -> tuple[int, np.ndarray]:
    k, n, body = text.split(".")
    raw = np.frombuffer(base64.b64decode(body), np.uint8).reshape(int(n), 6)
    return int(k), np.hstack([np.zeros((int(n), 2), np.uint8), raw]).view(">u8").reshape(-1).astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union."""
    return np.union1d(a, b)[:k]


def _joint(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int, int]:
    """Over the part of the hash range that both sketches cover: size of union, of intersection, of a, of b."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 0, 0, 0, 0
    again = both[1:] == both[:-1]
    common, union = both[1:][again], both[np.concatenate([[True], ~again])]
    if len(a) < k and len(b) < k:
        return len(union), len(common), len(a), len(b)
    top = union[min(k, len(union)) - 1]
    ends = [np.searchsorted(x, top, side="right") for x in (union, common, a, b)]
    return tuple(map(int, ends))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A & B| / |A | B|, exact while both sketches are whole sets; two empty sets are alike."""
    union, common, _, _ = _joint(a, b, k)
    return common / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of A's shingles that B has; an empty A is contained in anything."""
    _, common, own, _ = _joint(a, b, k)
    return common / own if own else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles, exact under k."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << _BITS) / float(a[k - 1] + 1)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, width: int = 5) -> DataFrame:
    """(key, fingerprint, n_distinct): narrow, no shuffle. Null counts as empty; the empty text has the empty sketch."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            s = sketches(data=data, offs=offs, k=k, width=width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write(x, k) for x in s], pa.string()), pa.array([distinct(x, k) for x in s], pa.float64())], names=["key", "fingerprint", "n_distinct"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, fingerprint string, n_distinct double").withColumnRenamed("key", key)


def in_pairs_with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text, guest) whose partitions hold consecutive ranges of keys, each followed by the row that comes
    next in the whole order (guest = true; after the last comes the first). One shuffle of the texts.

    Ranges come from the keys alone: sorted in parallel, the least key of each partition is collected, which is one
    value for each partition.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(key).cast("bigint").alias("key"))
    n = partitions(spark)
    firsts = ids.where("key IS NOT NULL").repartitionByRange(4 * n, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("m"))
    bounds = sorted(r.m for r in firsts.select("m").collect())
    starts = np.array(bounds[1:], np.int64)
    least = docs.select(F.col(key).cast("bigint").alias("key")).agg(F.count(F.when(F.col("key").isNull(), 1)).alias("n"), F.min("key").alias("m")).first()
    lowest = None if least.n else least.m

    @F.pandas_udf("bigint")
    def place(x: pd.Series) -> pd.Series:
        """Twice the range of a key, plus 1 where the key is the range's first."""
        keys = x.to_numpy()
        at = np.searchsorted(starts, keys, side="right")
        first = (at > 0) & (starts[np.maximum(at, 1) - 1] == keys) if len(starts) else np.zeros(len(keys), bool)
        return pd.Series(2 * at.astype("int64") + first)

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", place(F.coalesce("key", F.lit(-(1 << 63))))).withColumn("bucket", F.shiftright("place", 1).cast("int"))
    begin = F.col("key").isNull() if lowest is None else (F.col("key") == F.lit(lowest))
    guest = F.when(begin, F.lit(len(starts))).when(F.col("key").isNotNull() & (F.col("place") % 2 == 1), F.col("bucket") - 1)
    rows = rows.withColumn("to", F.explode(F.when(guest.isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")), F.struct(guest.cast("int").alias("b"), F.lit(True).alias("guest"))))))
    rows = rows.select(F.col("to.b").alias("bucket"), F.col("to.guest").alias("guest"), "key", "text")
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "key", "text")


def against_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, width: int = 5) -> DataFrame:
    """For every document: its sketch, that of its edited text, and how alike they and the next document's are.

    The edited text has the last half of the code points (rounded down) replaced by the first as many (or all) of the
    next document in ascending key order; after the last comes the first. Null keys come before all others; rows with
    equal keys are ordered by text; a lone document is its own next. Null counts as empty. Other columns, whatever
    their names, are not read; an empty table gives no rows. Keys are whole numbers.
    """
    bound_batches(docs.sparkSession)
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # (bucket, key, text, sketch) whose next row is not known yet
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offs = text_buffers(batch.column(3))
            own = sketches(data=data, offs=offs, k=k, width=width)
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), own))
            done = []
            for b, guest, key_, text_, s in rows:
                if held is not None and held[0] == b:
                    done.append((held, text_, s))
                    held = None
                if not guest:
                    held = (b, key_, text_, s)
            if done:
                edited = []
                for (_, _, t, _), nxt, _ in done:
                    half = len(t) // 2
                    edited.append((t[: len(t) - half] + nxt[:half]).encode("utf-8", "surrogatepass"))
                new = sketches(edited, k=k, width=width)
                cols = [[], [], [], [], [], [], []]
                for ((_, key_, t, s), _, after), e, es in zip(done, edited, new):
                    for c, v in zip(cols, (key_, len(t), hashlib.sha256(e).hexdigest(), write(s, k), write(es, k), resemblance(s, es, k), resemblance(s, after, k))):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    out = in_pairs_with_next(docs, key, text).mapInArrow(run, "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("key", key)
