"""Operator 10: exact histogram of encoded lengths, and what suffix sums over it answer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bound_batches, text_buffers


def lengths(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] | None = None, end_ids: int = 0) -> DataFrame:
    """Columns `keep` and n_tokens: the exact number of byte-level BPE ids of the whole text, plus end_ids.

    Null and empty texts have none (plus end_ids). Repeated rows each count; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    keep = keep or []
    kinds = [docs.schema[k].dataType.simpleString() for k in keep]

    def run(batches):
        from .bytebpe import opened

        coder = opened(tokenizer_path)
        for batch in batches:
            if batch.num_rows:
                n = coder.count(*text_buffers(batch.column(len(keep)))) + end_ids
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*[f"k{i}" for i in range(len(keep))], "n_tokens"])

    schema = ", ".join([*[f"k{i} {t}" for i, t in enumerate(kinds)], "n_tokens bigint"])
    cols = [F.col(k).alias(f"k{i}") for i, k in enumerate(keep)]
    out = docs.select(*cols, F.col(text).cast("string").alias("t")).mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "n_tokens")


def histogram(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n_tokens, docs): exact; partial sums are made before the shuffle, so a hot length or group costs one row
    for each task."""
    return counts.groupBy(*(by or []), "n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def answers(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For every length L of the histogram, taken as a context limit: documents and ids up to L, documents longer than
    L, ids that remain when every document is cut at L, ids lost by that, and the share of documents up to L.

    Sums over the histogram from the far end (suffix sums) give these; the histogram has a row for each distinct
    length and group, so a window over a group holds at most as many rows as there are distinct lengths.
    """
    by = by or []
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    suffix = part.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ids = F.col("n_tokens") * F.col("docs")
    longer, ids_longer = F.coalesce(F.sum("docs").over(suffix), F.lit(0)), F.coalesce(F.sum(ids).over(suffix), F.lit(0))
    return (
        hist.withColumns({"longer_docs": longer, "__ids_longer": ids_longer, "total_docs": F.sum("docs").over(whole), "total_ids": F.sum(ids).over(whole)})
        .withColumn("docs_within", F.col("total_docs") - F.col("longer_docs"))
        .withColumn("ids_within", F.col("total_ids") - F.col("__ids_longer"))
        .withColumn("ids_cut_at", F.col("ids_within") + F.col("longer_docs") * F.col("n_tokens"))
        .withColumn("ids_lost", F.col("total_ids") - F.col("ids_cut_at"))
        .withColumn("share_within", F.col("docs_within") / F.col("total_docs"))
        .drop("__ids_longer")
    )


def at_limits(hist: DataFrame, limits: list[int], by: list[str] | None = None) -> DataFrame:
    """(by..., context_limit, docs_within, longer_docs, ids_cut_at, ids_lost) for given limits, held lengths or not."""
    by = by or []
    rows = hist.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    inside = F.col("n_tokens") <= F.col("context_limit")
    kept = F.least("n_tokens", "context_limit") * F.col("docs")
    return rows.groupBy(*by, "context_limit").agg(
        F.sum(F.when(inside, F.col("docs")).otherwise(0)).alias("docs_within"),
        F.sum(F.when(~inside, F.col("docs")).otherwise(0)).alias("longer_docs"),
        F.sum(kept).alias("ids_cut_at"),
        F.sum(F.col("n_tokens") * F.col("docs") - kept).alias("ids_lost"),
    )


def quantile(answered: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """The least length L such that at least the share q of documents has at most L ids."""
    return answered.where(F.col("docs_within") >= F.ceil(F.lit(q) * F.col("total_docs"))).groupBy(*(by or [])).agg(F.min("n_tokens").alias("length"))
