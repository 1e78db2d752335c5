"""Evidence fusion over long tables of observations: (keys..., field, value, source, method, confidence, ord).

Everything is an aggregation that combines before the shuffle, so a key with a third of all observations costs a row
for each task and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.functions.confidence import conflict_penalty, noisy_or_agg
from weftline.settings import THRESHOLD


def group_values(obs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., field, value, confidence, sources, n, winner): observations that agree; confidences by noisy-or. The
    winner is the most confident observation, then by source, then by order. Observations without value are ignored."""
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("source"), F.col("ord"))
    return (
        obs.where("value IS NOT NULL")
        .groupBy(*by, "field", "value")
        .agg(
            noisy_or_agg(F.col("confidence")).alias("confidence"),
            F.array_sort(F.collect_set("source")).alias("sources"),
            F.count(F.lit(1)).alias("n"),
            F.min_by(F.struct("source", "method", "confidence"), rank).alias("winner"),
        )
    )


def merge_single(groups: DataFrame, by: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """One value for each (by..., field): (value, source, method, confidence, sources, losing_sources, n_groups, kept).
    Sources of other values count against the best, once for each value they hold; a confidence under the threshold means
    the field is dropped (kept = false)."""
    rank = F.struct((-F.round("confidence", 9)).alias("c"), F.col("winner.source").alias("s"), F.col("value").alias("v"))
    best = groups.groupBy(*by, "field").agg(
        F.min_by(F.struct("value", "confidence", "sources", "winner"), rank).alias("b"),
        F.sum(F.size("sources")).alias("votes"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    losing = F.col("votes") - F.size("b.sources")
    confidence = F.col("b.confidence") * F.when(F.col("n_groups") > 1, conflict_penalty(losing)).otherwise(1.0)
    return best.select(
        *by,
        "field",
        F.col("b.value").alias("value"),
        F.col("b.winner.source").alias("source"),
        F.when(F.size("b.sources") > 1, F.lit("merged")).otherwise(F.col("b.winner.method")).alias("method"),
        confidence.alias("confidence"),
        F.col("b.sources").alias("sources"),
        losing.alias("losing_sources"),
        "n_groups",
        (F.round(confidence, 12) >= threshold).alias("kept"),
    )


def losing_values(groups: DataFrame, singles: DataFrame, by: list[str]) -> DataFrame:
    """(by..., field, losers): the values that merge_single did not choose, where it had a choice; a row lists them all."""
    keys = [*by, "field"]
    chosen = singles.where("n_groups > 1").select(*keys, F.col("value").alias("__v"))
    rest = groups.join(chosen, keys).where("value <> __v")
    return rest.groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("losers"))


def merge_multi(groups: DataFrame, by: list[str]) -> DataFrame:
    """All values of each (by..., field) as an array<struct<value, confidence, sources>>, most confident first, then
    by the winners' source and by value."""
    item = F.struct((-F.round("confidence", 9)).alias("c"), F.col("winner.source").alias("s"), F.col("value").alias("v"), F.col("confidence"), F.col("sources"))
    rows = groups.groupBy(*by, "field").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.withColumn("items", F.transform("items", lambda x: F.struct(x["v"].alias("value"), x["confidence"].alias("confidence"), x["sources"].alias("sources"))))
