"""Greedy clustering of entries: in order, an entry joins the first cluster whose first member it agrees with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compatible(a: Column, b: Column) -> Column:
    """Evidence agrees unless both sides have it and differ; empty counts as absent."""
    none = lambda x: x.isNull() | (x == "")
    return none(a) | none(b) | (a == b)


def greedy_clusters(entries: DataFrame, by: list[str], key: str, evidence: list[str], order: str = "ord") -> DataFrame:
    """Adds `cluster`: the order of the first member. Entries of one (by..., key) are folded in order; an entry joins
    the first cluster whose exemplar's evidence (string columns) it is compatible with. The fold is sequential by
    definition, so entries with equal evidence are folded as one beforehand: a group costs its distinct evidence."""
    # Only the first entry of each distinct evidence can found a cluster; later equals go where it goes.
    rest = [F.coalesce(F.col(e), F.lit("")) for e in evidence]
    kinds = entries.groupBy(*by, key, *[c.alias(f"__e{i}") for i, c in enumerate(rest)]).agg(F.min(order).alias("__first"))
    item = F.struct(F.col("__first").alias("ord"), *[F.col(f"__e{i}") for i in range(len(evidence))])
    folded = kinds.groupBy(*by, key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = folded.schema["items"].dataType.elementType.simpleString()

    def agrees(x: Column, y: Column) -> Column:
        out = F.lit(True)
        for i in range(len(evidence)):
            out = out & compatible(x[f"__e{i}"], y[f"__e{i}"])
        return out

    def step(acc: Column, x: Column) -> Column:
        found = F.filter(acc["heads"], lambda h: agrees(h, x))
        head = F.get(found, F.lit(0))
        heads = F.when(F.size(found) > 0, acc["heads"]).otherwise(F.concat(acc["heads"], F.array(x)))
        joined = F.struct(x["ord"].alias("ord"), F.coalesce(head["ord"], x["ord"]).alias("cluster"))
        return F.struct(heads.alias("heads"), F.concat(acc["rows"], F.array(joined)).alias("rows"))

    o = entries.schema[order].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("heads"), F.array().cast(f"array<struct<ord:{o},cluster:{o}>>").alias("rows"))
    placed = folded.withColumn("__rows", F.aggregate("items", start, step)["rows"]).select(*by, key, F.explode("__rows").alias("__r"))
    placed = placed.select(*by, key, F.col("__r.ord").alias("__first"), F.col("__r.cluster").alias("cluster"))
    kinds = kinds.join(placed, [*by, key, "__first"])
    e = entries
    for i, c in enumerate(rest):
        e = e.withColumn(f"__e{i}", c)
    on = [*by, key, *[f"__e{i}" for i in range(len(evidence))]]
    return e.join(kinds.drop("__first"), on).drop(*[f"__e{i}" for i in range(len(evidence))])
