"""Payload files as they arrive: each micro-batch of complete bundles is fused and projected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.pipeline import run
from weftline.sources.files import PAYLOADS


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON lines of (bundle_id, source, payload) that are added to a folder."""
    return spark.readStream.schema(PAYLOADS).option("maxFilesPerTrigger", files_per_batch).json(path)


def start(stream: DataFrame, out: str, checkpoint: str, config=None, taxonomy: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Writes projected profiles under out/batch=<id>. A batch that is run again replaces its own folder, so results
    are exactly once. A bundle's payloads must arrive in one batch."""

    def write(batch: DataFrame, number: int) -> None:
        rows = run(batch, config, taxonomy, on_error="quarantine")
        rows.withColumn("batch", F.lit(number)).drop("batch").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
