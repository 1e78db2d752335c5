"""Identity linkage: records of a bundle that share an e-mail or phone are one candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .components import components


def token_edges(tokens: DataFrame, by: list[str], node: str = "node") -> DataFrame:
    """(a, b): each holder of a token with its first holder; stars, not pairs, so a token that a third of all records
    hold gives as many edges as holders."""
    first = tokens.groupBy(*by, "token").agg(F.min(node).alias("b"))
    return tokens.join(first, [*by, "token"]).where(F.col(node) != F.col("b")).select(F.col(node).alias("a"), "b").distinct()


def candidates(records: DataFrame, tokens: DataFrame) -> DataFrame:
    """(bundle_id, node, root) for records (bundle_id, node, source) with tokens (bundle_id, node, token). node orders
    records by first appearance; root is the candidate's first.

    Records without token join the only candidate that has one; where no record of a bundle has a token and no source
    gave two records, all are one candidate; else each stands alone.
    """
    linked = components(token_edges(tokens, ["bundle_id"]))
    anchored = tokens.select("node").distinct().withColumn("anchored", F.lit(True))
    rows = records.select("bundle_id", "node", "source").join(anchored, "node", "left").join(linked.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
    rows = rows.select("bundle_id", "node", "source", F.coalesce("anchored", F.lit(False)).alias("anchored"), F.coalesce("root", "node").alias("own"))
    # Per bundle: least and greatest anchored root tell whether there is exactly one; counts by source tell the rest.
    per_source = rows.groupBy("bundle_id", "source").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("anchored"), F.col("own"))).alias("lo"), F.max(F.when(F.col("anchored"), F.col("own"))).alias("hi"), F.min("node").alias("first"))
    facts = per_source.groupBy("bundle_id").agg(F.max("n").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"))
    root = F.when(F.col("anchored"), F.col("own")).when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNull() & (F.col("most") == 1), F.col("first")).otherwise(F.col("node"))
    placed = rows.join(facts, "bundle_id").select("bundle_id", "node", root.alias("root"))
    # An unanchored record may come before the candidate's first anchored one.
    lead = placed.groupBy("bundle_id", "root").agg(F.min("node").alias("lead"))
    return placed.join(lead, ["bundle_id", "root"]).select("bundle_id", "node", F.col("lead").alias("root"))


def single_source_counts(records: DataFrame) -> DataFrame:
    """(bundle_id, most): the most records that one source gave to a bundle."""
    return records.groupBy("bundle_id", "source").count().groupBy("bundle_id").agg(F.max("count").alias("most"))


def ordered_groups(placed: DataFrame) -> DataFrame:
    """Numbers candidates of a bundle from 0 by first appearance."""
    w = Window.partitionBy("bundle_id").orderBy("root")
    return placed.select("bundle_id", "root").distinct().withColumn("ordinal", F.row_number().over(w) - 1)
