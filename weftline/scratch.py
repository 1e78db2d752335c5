"""Intermediate tables in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders made inside each open scope of passing(), the innermost last.
_scopes: ContextVar[tuple] = ContextVar("scopes", default=())


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where the session has no such setting, a local session gets a temporary
    folder; on a cluster that is an error, as executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/weftline-scratch"
    return f"{root.rstrip('/')}/weftline-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes inside are deleted at the end; lasting ones live on to the end of the scope around."""
    made: list[str] = []
    before = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in made:
            remove(spark, path)


def cut(df: DataFrame, name: str = "t", lasting: bool = False) -> DataFrame:
    """Write df as Parquet and read it back."""
    spark = df.sparkSession
    folder = scratch_dir(spark)
    scopes = _scopes.get()[: -1 if lasting else None]
    if scopes:
        scopes[-1].append(folder)
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
