"""Operator 7: WARC archives of pages, and their capture index by external merge.

Archives are WARC/1.1 files, each record a gzip member of its own, so that a record can be read from its offset. A task
gathers members to an archive of bounded bytes, which Spark's text writer puts into a file as it is; so archives reach
any file system Spark can write to, and only committed attempts count. Reading them back gives the captures of each
archive as a run sorted by URL key, timestamp and record; runs are cut into ranges of keys of bounded rows, and the parts
of all runs that fall in a range meet in one task, where a loser tree merges them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches, cut, partitions, scratch_dir, spread_join, text_buffers

#: Compressed bytes from which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Index rows of a range that one task merges, about.
RANGE_ROWS = 100_000
#: Pages carry no time of their own; record k is dated this many seconds after 1970 plus k modulo YEARS, so that any key
#: has a date of four-digit years.
EPOCH, YEARS = 1_600_000_000, 1 << 31
#: An empty gzip member, which Spark's writer puts behind an archive as its line end.
_END = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
_LINE = "\r\n"
_INDEX = "run string, pos bigint, urlkey string, ts string, page_id bigint, uri string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, offset bigint, length bigint"


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query: "com,example)/a?b". Port and fragment go; a URL
    without host is its own key."""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + ("?" + u.query if u.query else "")


class LoserTree:
    """Merge of k sorted iterators by key: after each row, one path of k's logarithm of matches is replayed."""

    def __init__(self, sources: list, key):
        self.sources, self.key, self.k = [iter(s) for s in sources], key, max(1, len(sources))
        self.heads = [self._next(i) for i in range(len(sources))] or [None]
        self.tree = [-1] * self.k  # losers; tree[0] is the winner
        for i in range(self.k):
            self._replay(i)

    def _next(self, i: int):
        row = next(self.sources[i], None)
        return None if row is None else (self.key(row), i, row)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # while the tree is built: wait here for the sibling
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (head := self.heads[self.tree[0]]) is not None:
            yield head[2]
            i = self.tree[0]
            self.heads[i] = self._next(i)
            self._replay(i)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 1000) -> DataFrame:
    """(value): one WARC record for each page, without the two line ends behind it.

    Of records with equal payloads of at least min_bytes, the one with the greatest key is a response and the others
    revisit it; rows that repeat that key are responses too. Null html is empty; a null URL is empty; blanks and control
    characters of a URL are written as %20.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    base = pages.select(F.col(key).cast("bigint").alias("id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"), payload.alias("payload"))
    base = base.withColumns({"digest": F.sha1(F.encode("payload", "utf-8")), "bytes": F.octet_length("payload").cast("bigint")})
    long_ = F.col("bytes") >= min_bytes
    # Short payloads look nothing up; each goes by a hash of its own, as many may be equal (or empty).
    base = base.withColumn("d", F.when(long_, F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")).otherwise(F.xxhash64("id", "url")))
    first = base.where(long_).groupBy("d", "digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = spread_join(base, cut(first, "first"), ["d", "digest"], "n", ["id", "url"])
    rows = rows.withColumn("revisit", F.coalesce(long_ & ~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(_LINE * 2))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.pmod(F.coalesce(F.col("id"), F.lit(0)), F.lit(YEARS)) + EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat_ws(
        _LINE,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(_LINE * 2), block).alias("value"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write WARC files under path, a gzip member for each record, closed when they reach archive_bytes."""
    bound_batches(pages.sparkSession)

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            data, offs = text_buffers(batch.column(0))
            view = memoryview(data)
            offs = offs.tolist()
            for a, b in zip(offs[:-1], offs[1:]):
                coder = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = coder.compress(view[a:b]) + coder.compress(b"\r\n\r\n") + coder.flush()
                held.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    packed = records(pages, key, url, html, min_bytes).mapInArrow(pack, "value binary")
    # The writer puts a value's bytes out as they are; a row is a file.
    out = packed.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
    out.option("encoding", "ISO-8859-1").option("lineSep", _END.decode("latin-1")).text(path)


def members(content: bytes, window: int = 1 << 16) -> Iterator[tuple[bytes, int, int]]:
    """(inflated bytes, offset, length) of each gzip member but empty ones; one member is held at a time. Raises
    ValueError where the archive is damaged."""
    view, at = memoryview(content), 0
    while at < len(view):
        coder, parts, fed = zlib.decompressobj(31), [], at
        try:
            while not coder.eof:
                if fed >= len(view):
                    raise ValueError(f"the member at {at} has no end")
                parts.append(coder.decompress(view[fed : fed + window]))
                fed = min(len(view), fed + window)
        except zlib.error as e:
            raise ValueError(f"the member at {at} is damaged") from e
        end = fed - len(coder.unused_data)
        if any(parts):
            yield b"".join(parts), at, end - at
        at = end


def parse(content: bytes) -> Iterator[tuple[dict, bytes, int, int]]:
    """(headers, block, offset, length) of the records of an archive, offset and length of their members in the file.
    Raises ValueError where the archive is damaged."""
    for data, at, length in members(content):
        stop = data.find(b"\r\n\r\n")
        lines = data[: max(stop, 0)].decode("utf-8", "replace").split(_LINE)
        if stop < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = headers.get("content-length", "")
        if not size.isdigit() or len(data) != stop + 8 + int(size) or not data.endswith(b"\r\n\r\n"):
            raise ValueError(f"the record at {at} has not the length it states")
        yield headers, data[stop + 4 : -4], at, length


def _capture(headers: dict, block: bytes) -> tuple:
    """Fields of a record; a response's payload is hashed and held against the record's digest."""
    cut_at = block.find(b"\r\n\r\n")
    http, payload = block[:cut_at], block[cut_at + 4 :]
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    kind = headers["warc-type"]
    number = lambda name: None if (x := headers[name][len("<urn:x-page:") : -1]) == "null" else int(x)
    refers = None
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != said or len(payload) != size:
            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
    else:
        refers = number("warc-refers-to")
    ts = "".join(c for c in headers["warc-date"] if c.isdigit())
    uri = headers["warc-target-uri"]
    return url_key(uri), ts, number("warc-record-id"), uri, size, said, kind, refers


def _order(row) -> tuple:
    return (row[2], row[3], row[4] is not None, row[4] or 0)


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under path; those of an archive are a run, numbered in its sorted order."""
    bound_batches(spark)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(name, 0, *_capture(h, b), at, size) for h, b, at, size in parse(content.as_py())]
                rows.sort(key=_order)
                rows = [(r[0], i, *r[2:]) for i, r in enumerate(rows)]
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(run, _INDEX)


_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)], names=_NAMES)


def merged(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in the order of URL key, timestamp and record across partitions: ranges of the full key (so that
    one URL's captures can lie in several) of some range_rows rows, in each of which the parts of all runs are merged by
    a loser tree. `runs` should be cheap to count.

    A task holds the index rows of its range in Arrow columns, not payloads; the tree holds one row of each run.
    """

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        names = table.column(0).to_numpy(zero_copy_only=False)
        edge = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
        keys = [table.column(k) for k in (2, 3, 4)]

        def part(a: int, b: int):
            for k in range(a, b):
                key, ts, page = (c[k].as_py() for c in keys)
                yield k, (key, ts, page is not None, page or 0)

        order = []
        for k, _ in LoserTree([part(a, b) for a, b in zip(edge[:-1], edge[1:])], lambda row: row[1]):
            order.append(k)
            if len(order) == 5000:
                yield from table.take(pa.array(order)).combine_chunks().to_batches()
                order = []
        if order:
            yield from table.take(pa.array(order)).combine_chunks().to_batches()

    n = max(partitions(runs.sparkSession), -(-runs.count() // range_rows))
    ranged = runs.repartitionByRange(n, "urlkey", "ts", "page_id", "run", "pos")
    return ranged.sortWithinPartitions("run", "pos").mapInArrow(run, _INDEX)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """Write the pages' archives (under path, or in the shared folder), read them back and return the merged capture
    index, a row for each page: run (archive), pos, urlkey, ts, page_id, uri, payload_bytes, payload_digest,
    record_type, refers_to, offset, length. Keys are whole numbers; null keys stay null and come first. An empty table
    gives no rows. Other columns are not read."""
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/warc"
    write_archives(pages, path, key, url, html, min_bytes)
    return merged(cut(sorted_runs(spark, path), "runs"))
