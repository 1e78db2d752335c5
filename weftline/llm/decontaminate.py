"""Operator 1: benchmark decontamination with an FM-index per training shard.

A shard is some tens of MB of texts that one task holds. Its words become ids of benchmark words; the stretches of
benchmark words that are long enough to hold a window are indexed; all windows whose words the shard has are searched
backwards at once, their occurrences located, and the spans merged. Benchmark texts are taken in blocks of bounded size,
as flat arrays of some four times the block's bytes that go to every task; each block is one more narrow pass over the
documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, cut, text_buffers
from .segments import SegmentCache, let_go, mix64, pieces
from .words import WORD_CHARS, words

#: Bytes of benchmark text searched in one pass.
BLOCK_BYTES = 8 << 20
#: Bytes of text in a shard.
SHARD_BYTES = 24 << 20
#: Windows searched in step.
SEARCHED = 1 << 17


class Phrases:
    """Windows of a block of benchmark items, over ids of the words in it."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = [t.encode() for _, t in items]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        h, _, _, at = words(b"".join(texts), offs, WORD_CHARS)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        #: Words of all items as ids from 1.
        self.ids = (ids + 1).astype(np.int32)
        self.items = [item for item, _ in items]
        #: For each length of windows: (length, where each distinct one stands in ids, holders' offsets, holders).
        self.groups = []
        counts = np.diff(at)
        widths = np.minimum(window, counts)
        for n in np.unique(widths[counts > 0]).tolist():
            own = np.flatnonzero((widths == n) & (counts > 0))
            size = counts[own] - n + 1
            start = np.repeat(at[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            who = np.repeat(own, size).astype(np.int32)
            group = self._same(start, n)
            order = np.lexsort((who, group))
            group, who, start = group[order], who[order], start[order]
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (who[1:] != who[:-1])])
            group, who, start = group[new], who[new], start[new]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            self.groups.append((n, start[first], np.append(first, len(who)), who))
        self.shortest = self.groups[0][0] if self.groups else 0

    def _same(self, start: np.ndarray, n: int) -> np.ndarray:
        """A number for each window, equal for equal ones: hashes, of another seed if two different windows share one."""
        for seed in range(8):
            scale = mix64(np.arange(1 + n * seed, 1 + n * (seed + 1), dtype=np.uint64) << np.uint64(20))
            h = np.zeros(len(start), np.uint64)
            for k in range(n):
                h += mix64(self.ids[start + k].astype(np.uint64) * scale[k])
            _, first, group = np.unique(h, return_index=True, return_inverse=True)
            if all((self.ids[start + k] == self.ids[start[first[group]] + k]).all() for k in range(n)):
                return group
        raise AssertionError("no seed tells the windows apart")

    def table(self) -> SegmentCache:
        size = max(10, int(4 * len(self.vocabulary)).bit_length())
        cache = SegmentCache(size)
        if len(self.vocabulary):
            cache.add(np.where(self.vocabulary == 0, np.uint64(1), self.vocabulary), [[0]] * len(self.vocabulary))
        return cache


def find_spans(phrases: Phrases, table: SegmentCache, data: np.ndarray, offs: np.ndarray):
    """Of one shard: (words of each text, hit flags of all words, items of each text that has any)."""
    parts, counts = [], []
    for i, j in pieces(offs):
        h, _, _, at = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], WORD_CHARS)
        parts.append((table.find(np.where(h == 0, np.uint64(1), h)) + 1).astype(np.int32))
        counts.append(np.diff(at))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    hit = np.zeros(len(ids) + 1, np.int32)
    items: dict[int, set] = {}
    text_at = np.concatenate([[0], np.cumsum(n_words)])
    if not len(ids) or not phrases.groups:
        return n_words, hit[:-1] > 0, items
    # Stretches of benchmark words, cut at the ends of texts, that are long enough to hold a window.
    known = ids > 0
    begins = known & np.concatenate([[True], ~known[:-1]])
    first = text_at[:-1][n_words > 0]
    begins[first] = known[first]
    stops = known & np.concatenate([~known[1:], [True]])
    stops[first[1:] - 1] = known[first[1:] - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long_ = b - a >= phrases.shortest
    a, b = a[long_], b[long_]
    size = b - a + 1  # each with its end mark
    total = int(size.sum())
    where = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(total)
    symbols = ids[np.minimum(where, len(ids) - 1)]
    if total:
        symbols[np.cumsum(size) - 1] = 0
        from .fm_index import FMIndex

        index = FMIndex(symbols, len(phrases.vocabulary))
        # A window can only occur if all its words do.
        there = np.zeros(len(phrases.vocabulary) + 1, bool)
        there[symbols] = True
        absent = np.concatenate([[0], np.cumsum(~there[phrases.ids])])
        pairs = [np.zeros(0, np.int64)]
        for n, starts, offsets, holders in phrases.groups:
            use = np.flatnonzero(absent[starts + n] == absent[starts])
            for k in range(0, len(use), SEARCHED):
                some = use[k : k + SEARCHED]
                lo, hi = index.search(phrases.ids[starts[some][:, None] + np.arange(n)])
                for who, at in index.locate(lo, hi):
                    at = where[at]
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + n, -1)
                    text = np.searchsorted(text_at, at, side="right") - 1
                    # Texts and windows, then texts and the items that hold the windows; each pair once.
                    seen = np.unique((text << 32) | some[who])
                    w = seen & 0xFFFFFFFF
                    size = offsets[w + 1] - offsets[w]
                    own = holders[np.repeat(offsets[w] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                    pairs.append(np.unique(np.repeat(seen >> 32, size) << 32 | own))
        for p in np.unique(np.concatenate(pairs)).tolist():
            items.setdefault(p >> 32, set()).add(phrases.items[p & 0xFFFFFFFF])
    return n_words, np.cumsum(hit)[:-1] > 0, items


def _spans(flags: np.ndarray) -> np.ndarray:
    """Merged (from, to) of set flags."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)


def _cut(text: bytes, spans: np.ndarray) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    _, starts, ends, _ = words(text, np.array([0, len(text)], np.int64), WORD_CHARS)
    out, last = [], 0
    for a, b in spans.tolist():
        out.append(text[last : starts[a]])
        last = int(ends[b - 1])
    return b"".join([*out, text[last:]])


def _shards(batches, column: int):
    """Group Arrow batches to shards of about SHARD_BYTES."""
    let_go()
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
        if size >= SHARD_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _blocks(benchmark: DataFrame, item: str, text: str):
    """Lists of (item, text), each of some BLOCK_BYTES, in the order of a hash. A text over the bound makes a block of its
    own. Rows come to the driver partition by partition."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    held, size = [], 0
    for r in rows.orderBy(F.xxhash64("i", "t"), "i", "t").toLocalIterator():
        own = len(r.t.encode()) + len(r.i)
        if held and size + own > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += own
    yield held


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """(key, n_words, n_hit, items: sorted ids of benchmark items as strings, spans: merged [from, to) word positions).

    Words are runs of characters other than ASCII ones that are neither letters nor digits, A-Z in lower case. A window
    is `window` consecutive words of an item, or a shorter item's whole sequence. Null or wordless texts have no hits;
    items without id, text or words have no windows; repeated items count once; repeated documents each give a row.
    Other columns, whatever their names, are not read. No shuffle of documents.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.lit(None).cast("bigint").alias("n_words"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("binary").alias("flags"))
    schema = f"key {kind}, text string, n_words bigint, items array<string>, flags binary"
    for block in _blocks(benchmark, item, item_text):
        phrases = Phrases(block, window)

        def run(batches, phrases=phrases):
            table = phrases.table()
            for shard in _shards(batches, 1):
                data, offs = text_buffers(shard.column(1))
                n_words, hit, items = find_spans(phrases, table, np.frombuffer(data, np.uint8), offs)
                at = np.concatenate([[0], np.cumsum(n_words)]).tolist()
                old_items, old_flags = shard.column(3).to_pylist(), shard.column(4).to_pylist()
                new_items, new_flags = [], []
                for i in range(len(n_words)):
                    got, old = items.get(i), old_flags[i]
                    new_items.append(sorted({*(old_items[i] or ()), *(got or ())}))
                    flags = hit[at[i] : at[i + 1]] if got else None
                    if old:
                        was = np.unpackbits(np.frombuffer(old, np.uint8), count=at[i + 1] - at[i]).astype(bool)
                        flags = was if flags is None else was | flags
                    new_flags.append(None if flags is None else np.packbits(flags).tobytes())
                yield from pa.table([shard.column(0), shard.column(1), pa.array(n_words, pa.int64()), pa.array(new_items, pa.list_(pa.string())), pa.array(new_flags, pa.binary())], names=["key", "text", "n_words", "items", "flags"]).to_batches()

        out = out.mapInArrow(run, schema)

    def finish(batches):
        for batch in batches:
            n_words, spans = batch.column(1).to_pylist(), []
            for n, f in zip(n_words, batch.column(3).to_pylist()):
                spans.append(_spans(np.unpackbits(np.frombuffer(f, np.uint8), count=n)).tolist() if f else [])
            hits = [sum(b - a for a, b in s) for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), batch.column(2), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["key", "n_words", "n_hit", "items", "spans"])

    out = out.select("key", "n_words", "items", "flags").mapInArrow(finish, f"key {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<array<bigint>>")
    return out.withColumnRenamed("key", key)


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of scan()'s rows."""
    return scanned.select(
        key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, length: str | None = "n_chars") -> DataFrame:
    """Documents with all spans removed that scan() finds; the columns and their order stay.

    Where cutting brings new occurrences together, those are cut too, until none is left. `length` (if there is such a
    column) is set to the code points of a text that changed. A document of which no word is left goes; one that had no
    words to begin with stays, as do null texts and unchanged texts, byte for byte.
    """
    bound_batches(docs.sparkSession)
    blocks = [Phrases(block, window) for block in _blocks(benchmark, item, item_text)]
    if len(blocks) > 1:
        return _remove_in_blocks(docs, blocks, text, length)
    names = docs.columns
    at_text = names.index(text)
    at_length = names.index(length) if length in names else None

    def run(batches, phrases=blocks[0]):
        table = phrases.table()
        for shard in _shards(batches, at_text):
            column = shard.column(at_text)
            data, offs = text_buffers(column)
            n_words, hit, items = find_spans(phrases, table, np.frombuffer(data, np.uint8), offs)
            if items:
                raw, at = data.tobytes(), np.concatenate([[0], np.cumsum(n_words)])
                changed = {i: _cut(raw[offs[i] : offs[i + 1]], _spans(hit[at[i] : at[i + 1]])) for i in items}
                todo = sorted(changed)
                while todo:
                    joined = b"".join(changed[i] for i in todo)
                    o = np.concatenate([[0], np.cumsum([len(changed[i]) for i in todo])]).astype(np.int64)
                    n, h, more = find_spans(phrases, table, np.frombuffer(joined, np.uint8), o)
                    w = np.concatenate([[0], np.cumsum(n)])
                    for k in more:
                        changed[todo[k]] = _cut(changed[todo[k]], _spans(h[w[k] : w[k + 1]]))
                    todo = [todo[k] for k in sorted(more)]
                shard = _replaced(shard, changed, names, at_text, at_length)
            yield from shard.to_batches(max_chunksize=2000)

    return docs.mapInArrow(run, docs.schema)


def _replaced(shard: pa.Table, changed: dict[int, bytes], names: list[str], at_text: int, at_length: int | None) -> pa.Table:
    """The shard with changed texts and their lengths, without rows of which no word is left."""
    texts = shard.column(at_text).to_pylist()
    keep = np.ones(len(texts), bool)
    for i, t in changed.items():
        texts[i] = t.decode("utf-8", "replace")
        keep[i] = len(words(t, np.array([0, len(t)], np.int64), WORD_CHARS)[1]) > 0
    shard = shard.set_column(at_text, names[at_text], pa.array(texts, pa.string()))
    if at_length is not None:
        sizes = shard.column(at_length).to_pylist()
        for i in changed:
            sizes[i] = len(texts[i])
        shard = shard.set_column(at_length, names[at_length], pa.array(sizes, shard.schema.field(at_length).type))
    return shard.filter(pa.array(keep))


def _remove_in_blocks(docs: DataFrame, blocks: list[Phrases], text: str, length: str | None) -> DataFrame:
    """remove() for a benchmark of several blocks: each round searches all blocks in unchanged texts and cuts what they
    found together; the next round takes the texts that were cut, until none is."""
    names = docs.columns
    at_text = names.index(text)
    at_length = names.index(length) if length in names else None
    at_flags, flags_name = len(names), "__flags"
    while flags_name in [n.lower() for n in names]:
        flags_name += "_"
    unflagged = F.lit(None).cast("binary")

    def cutting(batches):
        for batch in batches:
            flags = batch.column(at_flags).to_pylist()
            found = {i: np.unpackbits(np.frombuffer(f, np.uint8)).astype(bool) for i, f in enumerate(flags) if f}
            shard = pa.Table.from_batches([batch])
            if found:
                texts = batch.column(at_text)
                shard = _replaced(shard, {i: _cut(texts[i].as_py().encode(), _spans(f)) for i, f in found.items()}, names, at_text, at_length)
            yield from shard.to_batches()

    done, todo = None, docs.withColumn(flags_name, unflagged)
    schema = todo.schema
    while True:
        for phrases in blocks:

            def mark(batches, phrases=phrases):
                table = phrases.table()
                for shard in _shards(batches, at_text):
                    data, offs = text_buffers(shard.column(at_text))
                    n_words, hit, items = find_spans(phrases, table, np.frombuffer(data, np.uint8), offs)
                    if items:
                        at = np.concatenate([[0], np.cumsum(n_words)]).tolist()
                        flags = shard.column(at_flags).to_pylist()
                        for i in items:
                            own = hit[at[i] : at[i + 1]]
                            if flags[i]:
                                own = own | np.unpackbits(np.frombuffer(flags[i], np.uint8), count=len(own)).astype(bool)
                            flags[i] = np.packbits(own).tobytes()
                        shard = shard.set_column(at_flags, flags_name, pa.array(flags, pa.binary()))
                    yield from shard.to_batches(max_chunksize=2000)

            todo = todo.mapInArrow(mark, schema)
        got = cut(todo.mapInArrow(cutting, schema), "decontaminated")
        settled = got.where(F.col(flags_name).isNull()).drop(flags_name)
        done = settled if done is None else done.union(settled)
        todo = got.where(F.col(flags_name).isNotNull())
        if todo.isEmpty():
            return done
        todo = todo.withColumn(flags_name, unflagged)
