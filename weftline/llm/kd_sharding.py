"""Operator 2: K-d tree sharding.

Documents become points of metadata: length and labels (language, source), each an integer. A node is cut at the median
of its bytes along the dimension in which its points lie widest, until as many leaves as shards exist; their number can
follow from the bytes that a shard should have. A point's place along a dimension is a string of hex digits: the
dimension's value, then the content; so equal texts have one place. Medians are found by digits: bytes are counted by the
next three digits, for all nodes of a level at once, until the count that holds a node's median is small. Only such
counts (nodes x 4096 at most) reach the driver, and only a row for each node goes back, as a broadcast table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, numbered, spread_join

#: Hex digits that are counted at once, and those of a place: value, checksum, hash of the content, hash of the key.
_STEP, _WIDTHS = 3, (9, 9, 15, 15)


def _points(docs: DataFrame, key: str, text: str, dims: list[str]) -> DataFrame:
    """One narrow row for each document: id, size, crc, h (hash of the text) and the dimensions d0.. as integers from 0."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.select(
        F.col(key).cast("long").alias("id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(body).alias("h"),
        F.length(body).cast("long").alias("d0"),
        *[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"s{i}") for i, d in enumerate(dims)],
    )
    # A label's first four bytes give its place, so labels keep their order as far as those differ.
    for i in range(len(dims)):
        first = F.rpad(F.substring(F.hex(F.encode(F.col(f"s{i}"), "utf-8")), 1, 8), 8, "0")
        tail = F.pmod(F.xxhash64(f"s{i}"), F.lit(16))
        out = out.withColumn(f"d{i + 1}", F.conv(first, 16, 10).cast("long") * 16 + tail)
    return out.drop(*[f"s{i}" for i in range(len(dims))])


def _grouped(points: DataFrame, names: list[str], most: float) -> DataFrame:
    """Points with the labels of their group of equal texts (the least of each) and `loose`: whether the group has more
    than `most` bytes, so that it may be cut."""
    labels = names[1:]
    same = ["h", "crc", "size"]
    groups = points.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), *[F.min(d).alias(f"g_{d}") for d in labels]).where("n > 1")
    groups = groups.withColumn("loose", F.col("n") * F.col("size") > most)
    out = spread_join(points, cut(groups, "groups"), same, "n", ["id", *names])
    return out.select("id", "size", "crc", "h", names[0], *[F.coalesce(f"g_{d}", d).alias(d) for d in labels], F.coalesce("loose", F.lit(False)).alias("loose"))


def _place(dim: Column) -> Column:
    """A point's place along a dimension. The hash of the key takes part only in groups that may be cut."""
    hexed = lambda v, n: F.lpad(F.hex(v), n, "0")
    own = F.when(F.col("loose"), F.shiftrightunsigned(F.xxhash64("id", "size"), 4)).otherwise(F.lit(0).cast("long"))
    parts = (dim, F.col("crc"), F.shiftrightunsigned("h", 4), own)
    return F.concat(*[hexed(p, n) for p, n in zip(parts, _WIDTHS)])


def _cuts(placed: DataFrame, nodes: list[dict], names: list[str], tolerance: float) -> None:
    """Find the cut of each node: sets its `bound`, the least place that goes right (rows with a lesser place go left)."""
    spark = placed.sparkSession
    for depth in range(sum(_WIDTHS) // _STEP):
        todo = [n for n in nodes if not n["done"]]
        if not todo:
            return
        open_ = spark.createDataFrame([(n["first"], n["dim"], n["prefix"]) for n in todo], "node int, dim int, prefix string")
        # A row for each open node: as many as shards at most.
        rows = placed.join(F.broadcast(open_), "node").withColumn("place", _place(F.get(F.array(*names), F.col("dim"))))
        rows = rows.where(F.substring("place", 1, depth * _STEP) == F.col("prefix"))
        counts: dict[int, list] = {}
        for r in rows.groupBy("node", F.substring("place", depth * _STEP + 1, _STEP).alias("digit")).agg(F.sum("size").alias("w")).collect():
            counts.setdefault(r.node, []).append((r.digit, r.w))
        for n in todo:
            run, own = n["below"], sorted(counts[n["first"]])
            for digit, w in own:
                if run + w >= n["target"] or digit == own[-1][0]:
                    break
                run += w
            n["prefix"] += digit
            n["below"], n["done"] = run, w <= n["total"] * tolerance
            # What holds the median goes to whichever side leaves less over; "~" is behind all digits.
            n["bound"] = n["prefix"] + "~" * (n["target"] - run > run + w - n["target"])


def shard(docs: DataFrame, shards: int | None = 8, key: str = "doc_id", text: str = "text", dims: list[str] | None = None, tolerance: float = 0.002, target_bytes: int | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot): shards of nearly equal bytes (size: UTF-8 bytes plus 1; null is none). With
    `target_bytes` there are as many shards as bring a shard to that many bytes at most on average.

    Each split is off its target by at most `tolerance` of the node, or one document or group of equal texts. Equal texts
    are in one shard, unless they alone outweigh a shard; such a group is cut by a hash of the key, where a cut falls in
    it. Where labels differ among equal texts, the least of each counts for all. Slots number a shard's rows from 0 by
    ascending key; null keys come first, rows with equal keys follow in the order of content. `dims` default to lang and
    source as far as the table has them; null labels are empty ones. An empty table gives no rows. Other columns are not
    read. Texts are read once and never shuffled.
    """
    dims = [d for d in ("lang", "source") if d in docs.columns] if dims is None else dims
    names = [f"d{i}" for i in range(len(dims) + 1)]
    points = cut(_points(docs, key, text, dims), "points")
    total = points.agg(F.sum("size")).first()[0] or 0
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    points = _grouped(points, names, total / shards)
    # A node is known by its first shard; `level` holds (first shard, shards) of all nodes.
    placed, level, root = cut(points.withColumn("node", F.lit(0)), "level"), [(0, shards)], None
    while total and any(count > 1 for _, count in level):
        spans = {r.node: r for r in placed.groupBy("node").agg(F.sum("size").alias("w"), *[F.stddev_pop(F.log1p(d)).alias(d) for d in names]).collect()}
        root = root or spans[0]
        nodes = []
        for first, count in level:
            if count > 1 and first in spans:
                # Widest: the greatest spread of log values against that of all documents, so that lengths and labels
                # compare; of equals the first.
                r = spans[first]
                dim = max(range(len(names)), key=lambda i: (r[names[i]] or 0.0) / root[names[i]] if root[names[i]] else 0.0)
                nodes.append({"first": first, "left": count // 2, "dim": dim, "prefix": "", "below": 0, "total": r.w, "target": r.w * (count // 2) / count, "done": False})
        _cuts(placed, nodes, names, tolerance)
        rules = placed.sparkSession.createDataFrame([(n["first"], n["dim"], n["bound"], n["first"] + n["left"]) for n in nodes], "node int, dim int, bound string, other int")
        placed = placed.join(F.broadcast(rules), "node", "left")
        goes = _place(F.get(F.array(*names), F.col("dim"))) >= F.col("bound")
        placed = cut(placed.withColumn("node", F.when(goes, F.col("other")).otherwise(F.col("node"))).drop("dim", "bound", "other"), "level")
        level = [x for f, c in level for x in ([(f, c)] if c == 1 else [(f, c // 2), (f + c // 2, c - c // 2)])]
    out = numbered(placed.select("id", "size", "crc", F.col("node").alias("shard")), ["id", "crc"], "slot", group="shard")
    return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
