"""Joins in which a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.scratch import cut

#: Keys that spread_join() broadcasts.
HEAVY_KEYS = 1000
#: Narrow rows of one key that need no spreading.
HARMLESS = 100_000


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, spread: list[str], harmless: int = 0) -> DataFrame:
    """Left join of rows with a table of one row for each key (columns `on`, never null, the first a bigint or string; `weight`: how
    many rows the key has; and what is to be added), where a few keys may hold most rows.

    The HEAVY_KEYS keys of the greatest weight are broadcast, which are that many rows whatever the data. Rows that meet
    one of them are dealt out by `spread` (columns that tell rows apart) instead of by key; so no key that is left holds
    more than a HEAVY_KEYS-th of all rows. `table` should be cheap to read twice. Where no key has
    more than `harmless` rows, which a task takes in its stride, the join is left as it is. Names that begin with __ are
    taken.
    """
    added = [c for c in table.columns if c not in (*on, weight)]
    if harmless and (table.agg(F.max(weight)).first()[0] or 0) <= harmless:
        return rows.join(table.drop(weight), on, "left").select(*[F.col(f"`{c}`") for c in rows.columns], *added)
    heavy = table.orderBy(F.desc(weight), *on).limit(HEAVY_KEYS).select(*on, *added)
    heavy = cut(heavy, "heavy")
    light = table.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    keys, names = [f"__k{i}" for i in range(len(on))], [f"__a{i}" for i in range(len(added))]
    known = heavy.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], *[F.col(c).alias(n) for c, n in zip(added, names)], F.lit(True).alias("__heavy"))
    met = F.lit(True)
    for c, k in zip(on, keys):
        met = met & (F.col(c) == F.col(k))
    out = rows.join(F.broadcast(known), met, "left").drop(*keys)
    # A heavy row has its own hash for a key, beside a flag that no row of the table has.
    dealt = F.when(F.col("__heavy"), F.xxhash64(*spread).cast(rows.schema[on[0]].dataType)).otherwise(F.col(on[0]))
    out = out.withColumns({"__at": dealt, "__is": F.col("__heavy").isNotNull()})
    rest = light.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], *[F.col(c).alias(f"{n}_") for c, n in zip(added, names)], F.lit(False).alias("__is2"))
    match = (F.col("__at") == F.col(keys[0])) & (F.col("__is") == F.col("__is2"))
    for c, k in zip(on[1:], keys[1:]):
        match = match & (F.col(c) == F.col(k))
    joined = out.join(rest, match, "left")
    value = [F.coalesce(F.col(n), F.col(f"{n}_")).alias(c) for c, n in zip(added, names)]
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *value)
