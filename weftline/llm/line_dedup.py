"""Operator 5 [native]: drop lines that several documents hold, except in the document with the smallest key.

Only DataFrame functions. Lines are exploded to (two 64-bit hashes of the normalised line, with different seeds;
document; position); texts are not shuffled with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, spread_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(_BLANKS))
    return F.when(key.rlike("[A-Z]"), F.translate(key, _UPPER, _LOWER)).otherwise(key)


def line_hashes(line: Column) -> list[Column]:
    """128 bits of a line: two hashes of its bytes that start from different seeds, so neither follows from the other."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep`, key, n_lines (before), n_dropped, and text made of the lines that stay.

    A null or empty text is one empty line; a null text comes back empty. Rows with a null key hold lines like others;
    null counts as the smallest key. Rows with equal keys count as one document: none of their lines is dropped on
    account of the other. Repeated rows each come back. Other columns, whatever their names, are not read. Lines with
    under min_chars code points always stay. If all lines are dropped the text is empty.

    Shuffles: the lines' hashes twice (first aggregated to least and greatest document in each task; then to look up
    their document, see spread_join), then the positions to drop and the texts once. A line that a third of all documents
    hold is one row for each task in the first and is looked up in a broadcast table of the few most common lines in the
    second. The lines that several documents hold are written to the shared folder, as both uses read them.
    """
    keep = keep or []
    names = {k: f"k{i}" for i, k in enumerate(keep)}
    base = docs.select(
        *[F.col(k).alias(v) for k, v in names.items()],
        F.col(key).alias("id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    # Rows are told apart by key and text; equal rows share their drops.
    base = base.withColumn("th", F.xxhash64("text"))
    lines = base.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.where(F.char_length("line") >= min_chars).withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= min_chars)
    lines = lines.select(*line_hashes(F.col("line")), "id", "th", "pos")
    # Null is the smallest key. Plain columns, not structs, keep the aggregation in hash tables.
    nulls = F.max(F.col("id").isNull().cast("int")).alias("nulls")
    if min_docs <= 2:
        shared = lines.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), nulls, F.count(F.lit(1)).alias("n"))
        shared = shared.where((F.col("lo") != F.col("hi")) | ((F.col("nulls") == 1) & F.col("lo").isNotNull()))
    else:
        shared = lines.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.min("id").alias("lo"), nulls, F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    shared = shared.select("h1", "h2", "n", F.when(F.col("nulls") == 0, F.col("lo")).alias("first"), F.lit(True).alias("shared"))
    drops = spread_join(lines, cut(shared, "shared_lines"), ["h1", "h2"], "n", ["id", "th", "pos"])
    drops = drops.where(F.col("shared") & ~F.col("id").eqNullSafe(F.col("first")))
    # min_docs = 1 would make every line shared; it still stays in its first document.
    drops = drops.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    both = base.alias("b").join(drops.alias("d"), F.col("b.id").eqNullSafe(F.col("d.id")) & (F.col("b.th") == F.col("d.th")), "left")
    split = F.split("b.text", "\n")
    at = F.col("d.at")
    # The runs between dropped positions: before the first, between two, after the last.
    runs = F.transform(
        F.sequence(F.lit(0), F.size(at)),
        lambda j: F.slice(F.col("lines"), F.when(j > 0, F.get(at, j - 1) + 2).otherwise(1), F.coalesce(F.get(at, j), F.size("lines")) - F.when(j > 0, F.get(at, j - 1) + 1).otherwise(0)),
    )
    out = both.withColumn("lines", split)
    return out.select(
        *[F.col(f"b.{v}").alias(k) for k, v in names.items()],
        F.col("b.id").alias(key),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(at.isNull(), F.col("b.text")).otherwise(F.array_join(F.flatten(runs), "\n")).alias(text),
    )
