"""Vectorised text kernels: code points, segment hashes, and a bounded cache from segments to token ids.

A tokenizer whose ids depend only on segments of the text (GPT-2 style pretokens; or pieces of text between characters
that no vocabulary piece joins) needs one call for each distinct segment. Segments are found and hashed with numpy,
looked up in an open-addressing table that lives as long as the Python worker, and only unseen ones are encoded.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP ** i and its inverse modulo 2 ** 64, for i < n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in ((0, int(_STEP)), (1, pow(int(_STEP), -1, 1 << 64))):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


_codes = mix64((np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * _MULT)


def hash_values(values: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit value for each small integer."""
    if values.dtype == np.uint8 or not len(values) or values.max() < 1 << 16:
        return _codes[values]
    return mix64((values.astype(np.uint64) + np.uint64(1)) * _MULT)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial 64-bit hashes of values[starts:ends], from one running sum."""
    n = len(values)
    p, inv = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hash_values(values) * p[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inv[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _MULT)


def code_points(data, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the offsets of the texts among them. Malformed bytes become U+FFFD."""
    raw = data.tobytes() if isinstance(data, np.ndarray) else data
    try:
        cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    except UnicodeDecodeError:
        parts = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offs[:-1], offs[1:])]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    if len(cps) == len(raw):
        return cps, offs
    first = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return cps, first[offs]


#: Bytes of text hashed at once: temporary arrays stay near this size times about 100 bytes, and what powers() keeps near
#: this size times 32.
CHUNK = (1 << 18) - 1


def pieces(offs: np.ndarray, most: int = CHUNK):
    """Split texts into runs (from, to) of at most `most` values, or one text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j
        i = j


class SegmentCache:
    """Ids of segments by 64-bit hash, in flat arrays; emptied when full, so a worker's memory is bounded."""

    def __init__(self, slots_log2: int = 22):
        self.mask = np.int64((1 << slots_log2) - 1)
        self.most = 1 << (slots_log2 - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.at = np.zeros(int(self.mask) + 1, np.int32)
        self.n, self.used = 0, 0
        self.offset, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint16)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        k = self.keys[slot]
        out = np.where(k == h, self.at[slot], -1)
        todo = np.flatnonzero((k != h) & (k != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            k = self.keys[slot[todo]]
            hit = k == h[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (k != 0)]
        return out

    def add(self, h: np.ndarray, ids: list) -> None:
        """Distinct hashes that are not there yet, and their ids."""
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(lens.sum())
        while self.n + len(h) > len(self.offset):
            self.offset, self.length = np.concatenate([self.offset, np.zeros_like(self.offset)]), np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        flat = np.fromiter((x for y in ids for x in y), np.uint16, total)
        self.ids[self.used : self.used + total] = flat
        self.offset[self.n : self.n + len(h)] = self.used + np.cumsum(lens) - lens
        self.length[self.n : self.n + len(h)] = lens
        entry = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n, self.used = self.n + len(h), self.used + total
        slot, todo = (h & np.uint64(self.mask)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            claim = todo[free]
            self.keys[slot[claim]] = h[claim]
            won = claim[self.keys[slot[claim]] == h[claim]]
            self.at[slot[won]] = entry[won]
            left = np.ones(len(h), bool)
            left[won] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def lookup(self, h: np.ndarray, encode) -> np.ndarray:
        """Entries of all hashes; encode(positions) gives ids (a list for each) of those first seen at positions."""
        h = np.where(h == 0, np.uint64(1), h)
        out = self.find(h)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if self.n + len(new) > self.most and self.n:
                self.clear()
                return self.lookup(h, encode)
            base = self.n
            if len(new) > self.most:
                self.__init__(int(len(new)).bit_length() + 1)
                base = 0
                return self.lookup(h, encode)
            self.add(new, encode(miss[first]))
            out[miss] = base + back
        return out

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each segment has."""
        lens = self.length[entries].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        index = np.repeat(self.offset[entries] - (ends - lens), lens) + np.arange(total)
        return self.ids[index], lens


class SegmentEncoder:
    """Base of the two encoders: subclasses find the starts of segments and encode unseen ones."""

    #: Code points worked on at once: temporary arrays stay near this size times about 60 bytes.
    chunk = 1 << 20
    #: Slots of the cache, of 12 bytes each.
    slots_log2 = 22

    def __init__(self):
        self.cache = SegmentCache(self.slots_log2)

    def starts(self, cps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A flag for each code point that begins a segment; first: the flags of those that begin a text."""
        raise NotImplementedError

    def encode_new(self, segments: list[str]) -> list:
        raise NotImplementedError

    def entries(self, cps: np.ndarray, offs: np.ndarray):
        """(entries of all segments, segments before each text)."""
        n = len(cps)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        first = np.zeros(n + 1, bool)
        first[offs] = True
        flags = self.starts(cps, first[:n])
        at = np.flatnonzero(flags)
        ends = np.append(at[1:], n)
        h = span_hashes(cps, at, ends)

        def encode(where: np.ndarray) -> list:
            a, b = at[where], ends[where]
            size = b - a
            index = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            text = cps[index].tobytes().decode("utf-32-le", "surrogatepass")
            cut = np.concatenate([[0], np.cumsum(size)]).tolist()
            return self.encode_new([text[x:y] for x, y in zip(cut[:-1], cut[1:])])

        return self.cache.lookup(h, encode), np.searchsorted(at, offs)

    def encode(self, data, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts and the offsets of the texts among them."""
        ids, counts = [], []
        for i, j in pieces(offs, self.chunk):
            cps, o = code_points(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            entries, before = self.entries(cps, o)
            got, lens = self.cache.gather(entries)
            ids.append(got)
            counts.append(np.diff(np.concatenate([[0], np.cumsum(lens)])[before]))
        if not ids:
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def count(self, data, offs: np.ndarray) -> np.ndarray:
        """The number of ids of each text."""
        out = [np.zeros(0, np.int64)]
        for i, j in pieces(offs, self.chunk):
            cps, o = code_points(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            entries, before = self.entries(cps, o)
            out.append(np.diff(np.concatenate([[0], np.cumsum(self.cache.length[entries], dtype=np.int64)])[before]))
        return np.concatenate(out)


#: The encoder that a Python worker keeps from task to task.
_kept: dict = {}


def kept(make: Callable[[str], SegmentEncoder], path: str) -> SegmentEncoder:
    """make(path), once for each worker process as long as no other encoder is asked for."""
    if (make, path) not in _kept:
        let_go()
        _kept[make, path] = make(path)
    return _kept[make, path]


def let_go() -> None:
    """Drop the worker's encoder, which takes some 100 MB: workers outlive a stage, and operators without an encoder run in
    them too. What is freed goes back to the system."""
    if _kept:
        _kept.clear()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass
