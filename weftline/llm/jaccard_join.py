"""Operator 6: n-gram Jaccard join with set-relation skipping.

A document's set is its distinct word shingles. Documents with equal sets count as one from the start. The join is
exact; hashing only proposes work that may be skipped:

1. Set relations. Sets that share a least hash are compared with one of them, their leader. A set found similar to its
   leader is in the leader's class, so no pair inside a class needs an answer of its own.
2. Index lists. Of each set, the tokens of its prefix (rarest first) go to lists, one for each token and group of like
   lengths. Two sets of different classes can only be similar if a list holds both. Lists of one class are dropped; to
   the entries of the others the sets' parity bitmaps are added. A list is sorted by the position of the token, and a
   block is skipped when its positions leave too few tokens behind them for any pair; inside a block pairs are skipped by
   length, by position, and where the bitmaps differ in more bits than similar sets can differ in tokens (bitmap filter,
   Sandes et al., 2020): every token flips one bit, so bits never differ more than sets do. A long list is dealt out in
   pairs of its parts.
3. Answers from answers. A set follows a highly similar one, its leader. Leaders of what is left are compared once; the
   answers of the sets that follow them are derived from theirs by the few tokens in which a set differs from its leader:
   these bound the intersection from both sides, so most pairs are found linked or not without being read.
4. What is left is compared token by token. Links and classes make components.
5. If asked for, a document's links are counted inside its component, by products of blocks of sets, as most were skipped
   above.

Texts are shuffled once, into a table bucketed by set; each comparison ships only the texts of the sets it names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftline.operators.components import components

from .common import HARMLESS, HEAVY_KEYS, bound_batches, cut, partitions, passing, spread_join, text_buffers
from .segments import SegmentCache, let_go, mix64
from .words import shingles

#: Documents in the sample that tells frequent tokens, and the documents of it that hold one at least.
SAMPLE_DOCS, SAMPLE_HOLDERS = 4000, 4
#: Least hashes of a set that look for its leader.
SKETCHES = 4
#: Sets drawn as further leaders for each least hash, and how often that is done.
CENTRES, ROUNDS = 6, 2
#: Frequent tokens that the order knows at most; others count as rare, which costs time and loses nothing.
MOST_FREQUENT = 200_000
#: Comparisons with one set that are one task's work; those with a set that has more are spread.
SPREAD = 1000
#: Entries of a list, or of a part of it, that one task compares, about.
LIST_PART = 4096
_SEEDS = [np.uint64(0xA0761D6478BD642F * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF) for i in range(16)]


class Order:
    """A total order of tokens: those frequent in a sample last, by how frequent; within that by hash."""

    def __init__(self, hashes: np.ndarray, holders: np.ndarray):
        self.level = np.minimum(15, np.log2(np.maximum(1, holders)).astype(np.int64) + 1).astype(np.uint64)
        self.cache = SegmentCache(max(10, (4 * len(hashes)).bit_length()))
        for i in range(0, len(hashes), 1 << 16):
            part = hashes[i : i + (1 << 16)]
            self.cache.add(np.where(part == 0, np.uint64(1), part), [[0]] * len(part))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        found = self.cache.find(np.where(h == 0, np.uint64(1), h))
        level = self.level[np.maximum(found, 0)] * (found >= 0) if len(self.level) else np.zeros(len(h), np.uint64)
        return (level.astype(np.uint64) << np.uint64(59)) | (h >> np.uint64(5))


def _sets(column, width: int):
    """Sorted distinct shingle hashes of each text."""
    let_go()
    h, at = shingles(*text_buffers(column), width)
    at = at.tolist()
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart: sums of two mixes of all hashes."""
    a = np.add.reduce(mix64(s ^ _SEEDS[8])) if len(s) else np.uint64(0)
    b = np.add.reduce(mix64(s ^ _SEEDS[9])) if len(s) else np.uint64(0)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _rows(names: list[str], kinds: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class SimilarityJoin:
    """The state of one join: the bucketed table of distinct sets, and its comparisons."""

    def __init__(self, docs: DataFrame, key: str, text: str, width: int, percent: int):
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        bound_batches(self.spark)
        self.n = partitions(self.spark)
        self.docs = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        self.name = f"weftline_sets_{uuid.uuid4().hex}"

        def describe(batches, width=width):
            for batch in batches:
                sets = _sets(batch.column(1), width)
                d = [_digest(s) for s in sets]
                yield _rows(["id", "n", "h1", "h2"], [pa.int64(), pa.int64(), pa.int64(), pa.int64()], [batch.column(0), [len(s) for s in sets], [x[0] for x in d], [x[1] for x in d]])

        #: One row for each document: (id, n, h1, h2).
        self.members = cut(self.docs.mapInArrow(describe, "id bigint, n bigint, h1 bigint, h2 bigint"), "members", lasting=True)
        sets = self.members.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"))
        #: One row for each distinct set: (sid, id: its least document, m: its documents, n, h1, h2).
        self.sets = cut(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
        holders = self.sets.select("sid", "id", "n", "h1", "h2")

        def same(batches, width=width):
            for batch in batches:
                own = [(len(x), *_digest(x)) for x in _sets(batch.column(4), width)]
                yield batch.filter(pa.array([x == y for x, y in zip(own, zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))))], pa.bool_()))

        held = self.docs.join(holders, "id").select("sid", "n", "h1", "h2", "text").mapInArrow(same, "sid bigint, n bigint, h1 bigint, h2 bigint, text string")
        held.repartition(self.n, "sid").write.bucketBy(self.n, "sid").sortBy("sid").format("parquet").saveAsTable(self.name)
        #: Texts by set; a row whose key is repeated with another text goes to the set of its own digest only.
        self.table = self.spark.table(self.name)

    def frequent(self) -> Order:
        """Token order from a sample of distinct sets: a bounded number of rows, the least by hash."""
        width = self.width
        picked = self.sets.select("sid").orderBy(F.xxhash64("sid"), "sid").limit(SAMPLE_DOCS)

        def tokens(batches):
            for batch in batches:
                sets = _sets(batch.column(0), width)
                if sets:
                    yield _rows(["h"], [pa.int64()], [np.concatenate(sets).view(np.int64)])

        sampled = self.table.join(F.broadcast(picked), "sid").select("text")
        found = sampled.mapInArrow(tokens, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLE_HOLDERS)
        got = found.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toPandas()
        return Order(got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64))

    def sketch(self) -> None:
        """For each set its least hashes and its parity bitmap, of some four to eight bits a token."""
        width = self.width

        def draw(batches):
            for batch in batches:
                sets = _sets(batch.column(1), width)
                mins, bitmaps, folded = [], [], []
                for s in sets:
                    mins.append([int(mix64(s ^ _SEEDS[k]).min().view(np.int64)) for k in range(SKETCHES)] if len(s) else [])
                    bits = 1 << min(14, max(8, (len(s) - 1).bit_length() + 2))
                    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
                    bitmaps.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
                    folded.append(_fold(np.frombuffer(bitmaps[-1], np.uint8)).tobytes())
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield _rows(["sid", "n", "mins", "bitmap", "folded"], kinds, [batch.column(0), [len(s) for s in sets], mins, bitmaps, folded])

        self.sketches = cut(self.table.select("sid", "text").mapInArrow(draw, "sid bigint, n bigint, mins array<bigint>, bitmap binary, folded binary"), "sketches")

    def proposals(self) -> DataFrame:
        """(a, b): sets and the leaders with which they share a least hash."""
        mins = self.sketches.select("sid", F.posexplode("mins").alias("k", "value"))
        lead = cut(mins.groupBy("value", "k").agg(F.min("sid").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1"), "lead")
        return spread_join(mins, lead, ["value", "k"], "m", ["sid"], HARMLESS).where("sid <> b").select(F.col("sid").alias("a"), "b").distinct()

    def more_proposals(self, classes: DataFrame, again: int) -> DataFrame:
        """(a, b) of different classes: sets with CENTRES sets drawn by hash among those that share a least hash with
        them. A class that a leader's outliers have split is put together again by this."""
        mins = self.sketches.join(classes, "sid").select("sid", "cls", F.posexplode("mins").alias("k", "value"))
        drawn = [F.min_by(F.struct("sid", "cls"), F.xxhash64("sid", F.lit(again * CENTRES + r))) for r in range(CENTRES)]
        lead = mins.groupBy("value", "k").agg(F.array_distinct(F.array(*drawn)).alias("centres"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").drop("lo", "hi")
        rows = spread_join(mins, cut(lead, "lead"), ["value", "k"], "m", ["sid"], HARMLESS).where("centres IS NOT NULL").select(F.col("sid").alias("a"), F.filter("centres", lambda c: c["cls"] != F.col("cls")).alias("centres"))
        return rows.select("a", F.explode("centres.sid").alias("b")).distinct()

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that bitmaps and lengths don't rule out."""
        percent = self.percent
        side = lambda x: self.sketches.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}"))
        rows = pairs.join(side("a"), "a").where("na > 0").join(side("b"), "b").where((percent * F.greatest("na", "nb") <= 100 * F.least("na", "nb")))

        def judge(batches):
            for batch in batches:
                keep = []
                for na, ma, nb, mb in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                    need = -(-percent * (na + nb) // (100 + percent))
                    if len(ma) < len(mb):
                        ma, mb = mb, ma
                    while len(ma) > len(mb):  # a bitmap folds to half its size
                        half = len(ma) // 2
                        ma = (int.from_bytes(ma[:half], "little") ^ int.from_bytes(ma[half:], "little")).to_bytes(half, "little")
                    differ = (int.from_bytes(ma, "little") ^ int.from_bytes(mb, "little")).bit_count()
                    keep.append(differ <= na + nb - 2 * need)
                out = batch.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["a", "b"])

        return rows.select("a", "b", "na", "ma", "nb", "mb").mapInArrow(judge, "a bigint, b bigint")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(a, b, na, nb, common): exact sizes and intersections for given pairs. One side's texts go to where the
        other's are; a task holds one set and a batch of others, and a set with many is in several tasks."""
        width = self.width
        pairs = cut(pairs.select("a", "b"), "pairs")
        # The sets with the most comparisons are that many rows whatever the data; no other has a HEAVY_KEYS-th of all.
        heavy = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPREAD).orderBy(F.desc("n"), "b").limit(HEAVY_KEYS)
        heavy = heavy.select(F.col("b").alias("c"), F.ceil(F.col("n") / SPREAD).alias("salts"))
        salted = pairs.join(F.broadcast(heavy), pairs.b == heavy.c, "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).alias("salt"))
        salted = cut(salted, "salted")
        one = self.table.join(salted, self.table.sid == salted.a).select("b", "salt", F.col("a").alias("a"), "text")
        centres = salted.select(F.col("b").alias("c"), "salt").distinct()
        other = self.table.join(centres, self.table.sid == centres.c).select(F.col("c").alias("b"), "salt", F.lit(None).cast("bigint").alias("a"), "text")
        met = other.union(one).repartition(self.n, "b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

        def match(batches):
            at, held = None, None
            for batch in batches:
                out: list[list] = [[], [], [], [], []]
                sets = _sets(batch.column(3), width)
                for b, salt, a, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets):
                    if a is None:
                        at, held = (b, salt), s
                    elif at == (b, salt):
                        both = np.sort(np.concatenate([held, s]))
                        common = int((both[1:] == both[:-1]).sum())
                        for c, v in zip(out, (a, b, len(s), len(held), common)):
                            c.append(v)
                yield _rows(["a", "b", "na", "nb", "common"], [pa.int64()] * 5, out)

        return met.mapInArrow(match, "a bigint, b bigint, na bigint, nb bigint, common bigint")

    def linked(self, compared: DataFrame) -> DataFrame:
        return compared.where(100 * F.col("common") >= self.percent * (F.col("na") + F.col("nb") - F.col("common")))

    def entries(self, order: Order, classes: DataFrame) -> DataFrame:
        """Index entries (token, sid, np: length and position, cls) of the prefixes of all sets."""
        width, percent = self.width, self.percent

        def prefix(batches):
            for batch in batches:
                sets = _sets(batch.column(2), width)
                sid, cls = (batch.column(i).to_numpy() for i in range(2))
                tokens, size = [], []
                for s in sets:
                    n = len(s)
                    need = -(-percent * n // 100)  # a similar set holds so many of these tokens at least
                    k = n - need + 1 if n else 0
                    t = order(s)
                    t = np.sort(np.partition(t, k - 1)[:k]) if k < n else np.sort(t)
                    tokens.append(t)
                    size.append(k)
                k = np.array(size)
                n = np.array([len(s) for s in sets])
                pos = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                cols = [np.concatenate(tokens).view(np.int64) if tokens else [], np.repeat(sid, k), (np.repeat(n, k) << 32) | pos, np.repeat(cls, k)]
                yield _rows(["token", "sid", "np", "cls"], [pa.int64()] * 4, cols)

        rows = self.table.select("sid", "text").join(classes.select("sid", "cls"), "sid").select("sid", "cls", "text")
        return rows.mapInArrow(prefix, "token bigint, sid bigint, np bigint, cls bigint")

    def degrees(self, sets: DataFrame) -> DataFrame:
        """(sid, links): the documents of other sets that are linked with a set, for sets (sid, root, k, m) of components
        of k sets. All pairs of a component are compared, in blocks of some CHUNK by CHUNK sets that a task counts; rows
        grow with k * k / CHUNK."""
        width, percent = self.width, self.percent
        chunks = F.ceil(F.col("k") / CHUNK).cast("int")
        spread = sets.select("sid", "root", "m", F.pmod(F.xxhash64("sid"), chunks).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("y"))
        spread = cut(spread.select("sid", "m", "root", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), F.when(F.col("x") > F.col("y"), 1).otherwise(0).alias("side")), "blocks")
        rows = self.table.select("sid", "text").join(spread, "sid").select("root", "lo", "hi", "side", "sid", "m", "text")
        rows = rows.repartition(self.n, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "side", "sid")

        def count(batches):
            at, held = None, {}

            def flush():
                return _rows(["sid", "links"], [pa.int64()] * 2, [[sid for _, sid in held], _links(list(held), *zip(*held.values()), at[1] == at[2], percent)])

            for batch in batches:
                own = _sets(batch.column(6), width)
                for root, lo, hi, side, sid, m, s in zip(*(batch.column(i).to_pylist() for i in range(6)), own):
                    if at != (root, lo, hi):
                        if held:
                            yield flush()
                        at, held = (root, lo, hi), {}
                    held[side, sid] = (m, s)  # a repeated row counts once
            if held:
                yield flush()

        return rows.mapInArrow(count, "sid bigint, links bigint").groupBy("sid").agg(F.sum("links").alias("links"))

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


#: Bits at most of the bitmaps that list entries carry, and pairs whose bitmaps are copied side by side at once.
ENTRY_BITS, BITMAP_ROWS = 1024, 1 << 14


def _fold(raw: np.ndarray) -> np.ndarray:
    """A bitmap of ENTRY_BITS at most: halves are put on each other."""
    while len(raw) * 8 > ENTRY_BITS:
        half = len(raw) // 2
        raw = raw[:half] ^ raw[half:]
    return raw


def _words(bitmaps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bitmaps as rows of ENTRY_BITS, and the bits that each has."""
    out = np.zeros((len(bitmaps), ENTRY_BITS // 8), np.uint8)
    for i, m in enumerate(bitmaps):
        out[i, : len(m)] = np.frombuffer(m, np.uint8)
    return out.view("<u8"), np.array([8 * len(m) for m in bitmaps])


def _differ(x: np.ndarray, y: np.ndarray, bits_x: np.ndarray, bits_y: np.ndarray) -> np.ndarray:
    """Bits in which pairs of rows differ, both folded to the smaller size of the two."""
    out = np.zeros(len(x), np.int64)
    least = np.minimum(bits_x, bits_y)
    for bits in np.unique(least).tolist():
        k = np.flatnonzero(least == bits)
        d = x[k] ^ y[k]
        while d.shape[1] * 64 > bits:
            half = d.shape[1] // 2
            d = d[:, :half] ^ d[:, half:]
        out[k] = np.bitwise_count(d).sum(axis=1)
    return out


class _Lists:
    """Entries of lists, sorted by list and position, as flat arrays; pairs of them that nothing rules out."""

    def __init__(self, table: pa.Table, percent: int):
        at, flags, sid, lp, cls = (table.column(i).to_numpy() for i in range(5))
        bitmaps, bits = _words(table.column(5).to_pylist())
        order = np.lexsort((sid, lp >> 32, lp & 0xFFFFFFFF, at))
        self.percent, self.flags, self.sid, self.cls = percent, flags[order], sid[order], cls[order]
        self.bitmaps, self.bits = bitmaps[order], bits[order]
        self.n = lp[order] >> 32
        self.left = self.n - (lp[order] & 0xFFFFFFFF)  # the token and what is behind it
        self.edge = _edges(at[order])

    def kept(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs of entries a and b, as rows (set, set), that are of different classes and that lengths, positions
        and bitmaps don't rule out; not two visitors, and of a list of two parts only one of each (see _dealt)."""
        n, p = self.n, self.percent
        need = (p * (n[a] + n[b]) + (99 + p)) // (100 + p)
        ok = (np.minimum(self.left[a], self.left[b]) >= need) & (self.cls[a] != self.cls[b]) & (np.minimum(n[a], n[b]) >= need)
        f, g = self.flags[a], self.flags[b]
        ok &= ((f & g & 2) == 0) & (((f & 4) == 0) | (((f ^ g) & 1) == 1)) & (self.sid[a] != self.sid[b])
        a, b, need = a[ok], b[ok], need[ok]
        near = n[a] + n[b] - 2 * need
        for i in range(0, len(a), BITMAP_ROWS):
            x, y = a[i : i + BITMAP_ROWS], b[i : i + BITMAP_ROWS]
            near[i : i + BITMAP_ROWS] -= _differ(self.bitmaps[x], self.bitmaps[y], self.bits[x], self.bits[y])
        near = near >= 0
        x, y = self.sid[a[near]], self.sid[b[near]]
        return np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)

    def pairs(self, short: int = 32, block: int = 512, step: int = 1 << 18):
        """Yield rows of kept(). Short lists of one size go side by side. A long list goes block by block; two blocks are
        skipped when the most that their positions leave is too little for the least pair of both."""
        size = np.diff(self.edge)
        for m in np.unique(size[(size > 1) & (size <= short)]).tolist():
            i, j = np.triu_indices(m, 1)
            starts = self.edge[:-1][size == m]
            few = max(1, step // len(i))
            for k in range(0, len(starts), few):
                some = starts[k : k + few, None]
                yield self.kept((some + i).ravel(), (some + j).ravel())
        for first, stop in zip(self.edge[:-1][size > short].tolist(), self.edge[1:][size > short].tolist()):
            cuts = [(i, min(stop, i + block)) for i in range(first, stop, block)]
            most = [int(self.left[i:j].max()) for i, j in cuts]
            least = [int(self.n[i:j].min()) for i, j in cuts]
            for k, x in enumerate(cuts):
                for j in range(k, len(cuts)):
                    if min(most[k], most[j]) * (100 + self.percent) < self.percent * (least[k] + least[j]):
                        continue
                    a, b = (z.ravel() for z in np.meshgrid(np.arange(*x), np.arange(*cuts[j]), indexing="ij"))
                    yield self.kept(a[a < b], b[a < b]) if j == k else self.kept(a, b)


#: Sets of a component that are compared with as many others in one block, about.
CHUNK = 128


def _links(keys: list[tuple[int, int]], weights, sets, same: bool, percent: int) -> np.ndarray:
    """For each set of a block the weight of those linked with it; only across sides unless the sides are the `same`."""
    n, m = np.array([len(s) for s in sets]), np.array(weights, np.int64)
    h, row = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    number = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    row, col = row[keep], (np.cumsum(shared) - 1)[number[keep]]
    common = np.zeros((len(n), len(n)))
    for a in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(col, [a, a + 4096])
        held = np.zeros((len(n), min(4096, int(shared.sum()) - a)), np.float32)
        held[row[i:j], col[i:j] - a] = 1
        common += held @ held.T
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(linked, False)
    if not same:
        side = np.array([x for x, _ in keys])
        linked &= side[:, None] != side[None, :]
    return linked @ m


def _whole_lists(batches):
    """Batches of rows sorted by their first column, regrouped so that no value's rows are in two of them."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if last is None else [*last.to_batches(), batch])
        token = table.column(0).to_numpy()
        stop = int(np.searchsorted(token, token[-1], side="left"))
        if stop:
            yield table.slice(0, stop).combine_chunks()
        last = table.slice(stop).combine_chunks()
    if last is not None and last.num_rows:
        yield last


def _edges(token: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))


def _dealt(lists: DataFrame, percent: int) -> DataFrame:
    """Entries (list, flags, sid, np, cls) of lists that hold more than one class.

    A list of up to LIST_PART entries is compared as it is. A longer one is parted by length: an entry is in the list of
    its own group of lengths and, to meet shorter sets, a visitor in that of the group below; similar sets' lengths differ
    by the cutoff at most, and so do two groups. What is still longer is dealt out in parts; every two of them, and each
    with itself, meet in some task. Flags: 1 the second of two parts, 2 a visitor, 4 a list of two parts.

    Windows are spilled where a token's entries are many; all of this follows one shuffle by token.
    """
    whole, same = Window.partitionBy("token"), Window.partitionBy("token", "group")
    mixed = lists.withColumns({"lo": F.min("cls").over(whole), "hi": F.max("cls").over(whole), "m": F.count(F.lit(1)).over(whole)}).where("lo <> hi").drop("lo", "hi")
    step = max(1e-6, float(np.log(100 / percent)))
    own = F.floor(F.log(F.shiftright("np", 32).cast("double")) / step + 1e-9).cast("int")
    groups = F.when(F.col("m") > LIST_PART, F.array(own, own - 1)).otherwise(F.array(F.lit(-2)))
    rows = mixed.select("token", "sid", "np", "cls", F.posexplode(groups).alias("visitor", "group"))
    rows = rows.withColumn("parts", F.ceil(F.count(F.lit(1)).over(same) / LIST_PART).cast("int"))
    rows = rows.withColumn("x", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    flags = (F.col("x") > F.col("y")).cast("int") + 2 * F.col("visitor") + F.when(F.col("x") != F.col("y"), 4).otherwise(0)
    # Two lists of one hash are compared together, which proposes more and loses nothing.
    return rows.select(F.xxhash64("token", "group", F.least("x", "y"), F.greatest("x", "y")).alias("list"), flags.cast("bigint").alias("flags"), "sid", "np", "cls")


#: Pairs that a task gathers before it sends them on, each once.
GATHER = 2_000_000


def _scan_lists(lists: DataFrame, n: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of lists (list, flags, sid, np, cls, folded), each at most once for every GATHER of a task."""

    def scan(batches):
        found: list[np.ndarray] = []
        size = 0

        def flush():
            pairs = np.unique(np.concatenate(found), axis=0)
            found.clear()
            return _rows(["a", "b"], [pa.int64()] * 2, [pairs[:, 0], pairs[:, 1]])

        for t in _whole_lists(batches):
            for some in _Lists(t, percent).pairs():
                if len(some):
                    found.append(some)
                    size += len(some)
                if size >= GATHER:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return lists.repartition(n, "list").sortWithinPartitions("list").mapInArrow(scan, "a bigint, b bigint")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, links: bool = False) -> DataFrame:
    """(key, n_shingles, component_id): documents whose sets' intersection is at least `percent` % of their union are
    linked; component_id is the least key reachable by links. With `links` also n_links, how many other documents a
    document is linked with itself: all pairs count, those of equal sets too, and each of several rows of a key. That
    compares all pairs of distinct sets of each component, so its work grows with the square of a component.

    Words are runs without ASCII blanks, A-Z in lower case. A text with fewer words than `width` is one shingle; null,
    empty and wordless texts have the empty set and are linked with nothing. Rows with a null key are linked with
    nothing, have a null component and no links. Rows that repeat a key each come back; their sets count for that key.
    Other columns, whatever their names, are not read. An empty table gives no rows. Keys are whole numbers.

    What is written on the way is deleted, but for the rows and labels that the result is read from.
    """
    return _run(docs, key, text, width, percent, links).withColumnRenamed("id", key)


def _run(docs: DataFrame, key: str, text: str, width: int, percent: int, counted: bool) -> DataFrame:
    """(id, n_shingles, component_id), with n_links if they are `counted`."""
    with passing(docs.sparkSession):
        work = SimilarityJoin(docs, key, text, width, percent)
        try:
            by_set = cut(_labels(work, counted), "by_set", lasting=True)
        finally:
            work.close()
    # Rows of one set may be many, and so may rows of the empty one, which has no label.
    full, none = work.members.where("n > 0"), work.members.where("n = 0")
    out = spread_join(full, by_set, ["h1", "h2", "n"], "m", ["id"])
    out = out.unionByName(none, allowMissingColumns=True)
    links = [F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links")] if counted else []
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"), *links)


def _labels(work: SimilarityJoin, counted: bool) -> DataFrame:
    """(h1, h2, n, m, component) of each distinct set, with links if they are `counted`."""
    percent = work.percent
    work.sketch()
    # 1. Leaders.
    stars = cut(work.compare(work.plausible(work.proposals())), "stars")
    near = work.linked(stars)
    classes = cut(components(near), "classes")
    links = near.select("a", "b")
    for again in range(ROUNDS):
        of = work.sets.select("sid").join(classes, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("cls"))
        got = cut(work.compare(work.plausible(work.more_proposals(of, again))), "more")
        links = links.union(work.linked(got).select("a", "b"))
        classes = cut(components(links), "classes")
    # A set follows the most similar of its leaders. A set that others follow follows nobody, so that answers go to
    # leaders that lead themselves.
    likeness = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    best = near.groupBy("a").agg(F.min_by(F.struct("b", (F.col("na") - F.col("common")).alias("more"), (F.col("nb") - F.col("common")).alias("less")), F.struct(-likeness, F.col("b"))).alias("l")).select(F.col("a").alias("s"), "l")
    leads = near.select(F.col("b").alias("s2")).distinct()
    follow = best.join(leads, best.s == leads.s2, "left_anti")
    zero = F.lit(0).cast("bigint")
    per_set = (
        work.sets.select("sid", "n")
        .join(classes, F.col("sid") == F.col("node"), "left")
        .join(follow, F.col("sid") == F.col("s"), "left")
        .select("sid", "n", F.coalesce("root", "sid").alias("cls"), F.coalesce(F.col("l.b"), F.col("sid")).alias("lead"), F.coalesce(F.col("l.more"), zero).alias("more"), F.coalesce(F.col("l.less"), zero).alias("less"))
    )
    per_set = cut(per_set, "per_set")
    # 2. Lists.
    mixed = cut(_dealt(work.entries(work.frequent(), per_set), percent), "mixed").join(work.sketches.select("sid", "folded"), "sid")
    found = cut(work.plausible(_scan_lists(mixed.select("list", "flags", "sid", "np", "cls", "folded"), work.n, percent).distinct()), "found")
    # 3. Leaders' answers, and what follows from them: a set holds `more` tokens that its leader hasn't, and lacks `less`.
    side = lambda x: per_set.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("lead").alias(f"l{x}"), F.col("more").alias(f"more{x}"), F.col("less").alias(f"less{x}"))
    led = found.join(side("a"), "a").join(side("b"), "b")
    led = cut(led.select("a", "b", "na", "nb", F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"), (F.col("morea") + F.col("moreb")).alias("more"), (F.col("lessa") + F.col("lessb")).alias("less")), "led")
    answers = cut(work.compare(led.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct()), "answers")
    known = answers.select(F.col("a").alias("la"), F.col("b").alias("lb"), "common")
    derived = cut(led.where("NOT (a = la AND b = lb)").join(known, ["la", "lb"], "left"), "derived")
    total = F.col("na") + F.col("nb")
    least, most = F.greatest(F.col("common") - F.col("less"), zero), F.least(F.col("common") + F.col("more"), "na", "nb")
    reaches = lambda c: 100 * c >= percent * (total - c)
    sure = F.coalesce(reaches(least), F.lit(False))
    # 4. Exact comparison of the rest.
    rest = work.compare(derived.where(~sure & (F.col("common").isNull() | reaches(most))).select("a", "b").distinct())
    links = links.union(work.linked(answers).select("a", "b")).union(derived.where(sure).select("a", "b")).union(work.linked(rest).select("a", "b"))
    comps = components(links)
    label = work.sets.join(comps, F.col("sid") == F.col("node"), "left").select("sid", "h1", "h2", "n", "id", "m", F.coalesce("root", "sid").alias("root"))
    label = cut(label, "label")
    roots = label.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("k"))
    by_set = spread_join(label, cut(roots, "roots").withColumn("weight", F.col("k")), ["root"], "weight", ["sid"], HARMLESS)
    # 5. Links of each set, counted inside its component.
    if counted:
        by_set = cut(by_set, "by_set")
        degrees = work.degrees(by_set.where("k > 1").select("sid", "root", "k", "m"))
        by_set = by_set.join(degrees, "sid", "left").withColumn("links", F.col("m") - 1 + F.coalesce("links", F.lit(0)))
    return by_set.select("h1", "h2", "n", "m", "component", *["links"] * counted)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of `docs` whose key is their component's least: one of each group of near copies. Rows with a null
    key stay, as do rows without words; rows that repeat a kept key stay. Columns and their order are those of docs."""
    found = _run(docs, key, text, width, percent, False).where("id IS NOT NULL AND id <> component_id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(found, docs[key].cast("bigint") == found["__gone"], "left_anti")
