"""Shared plumbing: table reads, scratch tables in the cluster's shared folder, distributed numbering."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.operators.spread import HARMLESS, HEAVY_KEYS, spread_join  # noqa: F401
from weftline.scratch import cut, passing, scratch_dir  # noqa: F401  (used by the operators of this subpackage)

#: Bytes of one Arrow batch sent to a Python worker: bounds a worker's memory whatever the row lengths.
ARROW_BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int = ARROW_BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes too, unless the session sets its own bound. A bound of less than ARROW_BATCH_BYTES
    takes the place of that one and stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if held is None or held == str(ARROW_BATCH_BYTES) and most < ARROW_BATCH_BYTES:
        spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def numbered(df: DataFrame, keys: list[str], name: str, group: str | None = None, weight: str | None = None) -> DataFrame:
    """Add a gapless number from 0 in the order of keys (or the sum of weight before a row), over all rows or within
    each value of group, without a single-task sort: range-partition, number inside partitions, add the sums of the
    partitions before. What reaches one task is a row for each partition and group value.

    The sorted rows are written to the shared folder once, so that both uses see the same partitions.
    """
    from pyspark.sql import Window

    order = ([group] if group else []) + keys
    at, of = "__part", F.col(group) if group else F.lit(0)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    spread = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    spread = cut(spread.withColumn(at, F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), name)
    sums = spread.groupBy(at, of.alias("__g")).agg(F.sum(w).alias("__w"))
    before = Window.partitionBy("__g").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(at).alias("__p2"), F.col("__g").alias("__g2"), F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(at, of).orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    out = spread.withColumn(name, F.coalesce(F.sum(w).over(inside), F.lit(0)))
    # One row for each partition (and group value): its size is the number of partitions, whatever the data.
    out = out.join(F.broadcast(sums), (F.col(at) == F.col("__p2")) & of.eqNullSafe(F.col("__g2")))
    return out.withColumn(name, F.col(name) + F.col("__base")).drop(at, "__row", "__p2", "__g2", "__base")


def text_buffers(arr: pa.Array) -> tuple[bytes, "object"]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    import numpy as np

    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(arr) or offs[-1] == offs[0]:
        return b"", np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]
