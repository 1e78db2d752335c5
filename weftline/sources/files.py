"""Reading payloads from files, and writing results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.settings import SOURCES

PAYLOADS = "bundle_id string, source string, payload string"


class ReadError(ValueError):
    """A payload file is missing or is not UTF-8."""


def read_payloads(spark: SparkSession, paths: Mapping[str, str], bundle_id: str | None = None) -> DataFrame:
    """One row for each file of {source: path or glob}; the bundle is named by bundle_id, or by the file's name without
    its ending. Files are read whole; bytes that aren't UTF-8 raise ReadError when the rows are read."""
    out = None
    for source, path in paths.items():
        if source not in SOURCES:
            raise ReadError(f"unknown source {source!r}")
        files = spark.read.format("binaryFile").load(path)
        name = F.lit(bundle_id) if bundle_id is not None else F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
        text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))))
        rows = files.select(name.alias("bundle_id"), F.lit(source).alias("source"), text.alias("payload"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], PAYLOADS)


def read_text(spark: SparkSession, path: str) -> str:
    """One file's text; ReadError if it cannot be read."""
    try:
        return read_payloads(spark, {"recruiter_notes": path}).first().payload
    except Exception as e:
        raise ReadError(f"cannot read {path}") from e


def write_json(df: DataFrame, path: str, column: str = "output") -> None:
    """One JSON document for each line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
