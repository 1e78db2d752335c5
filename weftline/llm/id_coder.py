"""Token-id files: an adaptive context-mixing range coder over blocks that are reset and checksummed one by one.

Every block starts with empty state and is coded on its own, so many blocks advance in step as the lanes of numpy
arrays. For each id two predictions are looked up by context: the id that last followed the two ids before it
(order 2) and the one before it (order 1). How often a prediction has held gives its confidence, and each confidence
stands for a fixed hit rate; the stretched rates are mixed with weights that follow the coding error inside the block,
one set where the two agree and one where they differ. The mixed probabilities split the coder's range in three: order-2 hit, order-1 hit, escape. An
escaped id is coded by order 0: a chunk has a few distributions of ids (say, one for each language in it), and a block
follows its own ids in choosing among them, by what each would have spent on the last ids. All arithmetic is on integers,
so any machine decodes the same ids.

Chunk layout (little endian): magic, crc32 of the rest of the header, block size, ids, blocks, tables, bytes of order-0
counts; for each block its 32-bit words and the crc32 of those and its ids; zlib of order-0 counts (ids, then 16-bit floats of each
table's counts); then the words of all blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR2"
BLOCK = 2048
#: Ids of a chunk: enough blocks side by side for numpy, and some 8 MB of coded bytes.
CHUNK = 4 << 20
#: Order-0 tables of a chunk at most; ids by whose likeness they are made; ids after which a block chooses again.
TABLES, _SEGMENT, _SWITCH = 8, 512, 16
_HEAD = struct.Struct("<4sIIQIII")
_SLOTS1, _SLOTS2, _CONF = 9, 10, 8
_FLOOR = 64  # least share of 65536 that the escape keeps
_BOTTOM, _HALF = 1 << 31, (1 << 31) - 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch: of a 12-bit probability, times 256; squash: its inverse, 16-bit, of (x >> 3) + 256."""
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.round(np.log(p / (1 - p)) * 256).astype(np.int32)
    squash = np.round(65536 / (1 + np.exp(-(np.arange(512) - 256) * 8 / 256))).clip(32, 65536 - 32).astype(np.int32)
    return stretch, squash


_STRETCH, _SQUASH = _tables()
_LOG2 = np.round(np.log2(1 + np.arange(64) / 64) * 64).astype(np.int64)
# Stretched hit rates to begin with, by confidence; the weights of a block's lanes learn how far to trust them.
_START1 = _STRETCH[[40, 500, 1100, 1700, 2300, 2800, 3200, 3600]]
_START2 = _STRETCH[[40, 900, 1800, 2500, 3000, 3400, 3700, 3900]]


# What becomes of a confidence: by a miss (a prediction of little confidence is replaced), then by a hit.
_STEP = np.array([0, 0, 0, *[-2] * (_CONF - 3), *[1] * (_CONF - 1), 0], np.int32)
_REPLACED = (np.arange(2 * _CONF) < 3).astype(np.int32)


class _Model:
    """Predictions and mixing for a number of lanes."""

    def __init__(self, lanes: int):
        self.base1, self.base2 = np.arange(lanes, dtype=np.int64) << _SLOTS1, np.arange(lanes, dtype=np.int64) << _SLOTS2
        self.tab1, self.tab2 = np.zeros(lanes << _SLOTS1, np.int32), np.zeros(lanes << _SLOTS2, np.int32)
        # Hashes of the last id for order 1 and of the one before it for order 2.
        self.hash1, self.hash2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.w1, self.w2 = np.full(lanes, 1 << 12, np.int32), np.full(lanes, 1 << 12, np.int32)
        self.against = np.full(lanes, -(1 << 9), np.int32)  # weight of order 1 in order 2 where they differ
        self.last, self.steps = np.zeros(lanes, np.int64), 0

    def predict(self, n: int) -> None:
        """For the first n lanes: the two predicted ids, and shares fa and fb of 65536 for a hit of each."""
        k = self.hash1[:n]
        self.slot1 = k >> 4
        self.slot1 &= (1 << _SLOTS1) - 1
        self.slot1 += self.base1[:n]
        k = k + self.hash2[:n]
        k >>= 5
        k &= (1 << _SLOTS2) - 1
        k += self.base2[:n]
        self.slot2 = k
        self.e1, self.e2 = self.tab1.take(self.slot1, mode="clip"), self.tab2.take(k, mode="clip")
        self.id1, self.id2 = self.e1 >> 3, self.e2 >> 3
        self.c1, self.c2 = self.e1 & 7, self.e2 & 7
        self.x1, self.x2 = _START1.take(self.c1.astype(np.int64), mode="clip"), _START2.take(self.c2.astype(np.int64), mode="clip")
        # Flags are whole numbers from here on: products with them cost less than choices.
        self.differ = (self.id1 != self.id2).astype(np.int32)
        z = self.w1[:n] * self.x1
        other = self.against[:n] * self.x1
        other -= z
        other *= self.differ
        other += z
        other += self.w2[:n] * self.x2
        other >>= 15
        other += 256
        # Stretched sums in 1/256, times 1 << 12; squash takes eighths.
        self.pa = _SQUASH.take(other.astype(np.int64), mode="clip")
        z >>= 15
        z += 256
        self.pb = _SQUASH.take(z.astype(np.int64), mode="clip")
        self.fa = self.pa - (self.pa >> 9)
        rest = 65536 - self.fa
        fb = rest >> 4
        fb *= self.pb >> 4
        fb >>= 8
        rest -= _FLOOR
        np.minimum(fb, rest, out=fb)
        fb *= self.differ
        self.fb = fb

    def update(self, n: int, ids: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        """ids: as 32-bit integers; h1, h2: flags (0 or 1, 32-bit) of those that are the predicted ones."""
        fresh = (ids << 3) + 1
        for h, e, c, tab, slot in ((h1, self.e1, self.c1, self.tab1, self.slot1), (h2, self.e2, self.c2, self.tab2, self.slot2)):
            c += h << 3
            at = c.astype(np.int64)
            e += _STEP.take(at, mode="clip")
            new = fresh - e
            new *= _REPLACED.take(at, mode="clip")
            e += new
            tab[slot] = e
        if self.steps & 1:  # every second id moves the weights
            err = h2 << 16
            err -= self.pa
            err >>= 6
            # Where the predictions differ, order 1 errs on its own, unless order 2 has hit.
            alone = h1 << 16
            alone -= self.pb
            alone >>= 6
            alone *= 1 - h2
            alone -= err
            alone *= self.differ
            alone += err
            alone *= self.x1
            alone >>= 12
            self.w1[:n] += alone
            err2 = err * self.x2
            err2 >>= 12
            self.w2[:n] += err2
            err *= self.differ
            err *= self.x1
            err >>= 12
            self.against[:n] += err
        self.steps += 1
        if not self.steps & 15:
            np.clip(self.w1, 1 << 8, 1 << 14, out=self.w1)
            np.clip(self.w2, 1 << 8, 1 << 14, out=self.w2)
            np.clip(self.against, -(1 << 13), 1 << 13, out=self.against)
        np.multiply(self.last[:n], 60493, out=self.hash2[:n])
        self.last[:n] = ids
        np.multiply(self.last[:n], 40503, out=self.hash1[:n])


def _float16(counts: np.ndarray) -> np.ndarray:
    """Counts as 16-bit codes of four digits behind the leading bit."""
    e = np.maximum(np.frexp(counts.astype(np.float64))[1] - 1, 4)
    return np.where(counts < 16, counts, 16 * (e - 3) + (counts >> (e - 4) & 15)).astype("<u2")


def _from_float16(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.int64)
    return np.where(codes < 16, codes, (16 + (codes & 15)) << np.maximum((codes >> 4) - 1, 0))


def _cluster(ids: np.ndarray) -> np.ndarray:
    """A table number for each id: segments of ids are clustered by the likeness of what they hold."""
    m = len(ids) // _SEGMENT
    k = min(TABLES, 1 + m // 32)
    if k == 1:
        return np.zeros(len(ids), np.int64)
    at = (ids[: m * _SEGMENT].reshape(m, _SEGMENT) * np.int32(40503) >> 4 & 255) + (np.arange(m, dtype=np.int32) << 8)[:, None]
    x = np.sqrt(np.bincount(at.ravel(), minlength=m << 8).reshape(m, 256).astype(np.float32) / _SEGMENT)
    # Centres are found on some segments, whatever the chunk's size; then each segment goes to its nearest.
    r = np.random.default_rng(1)
    some = x[r.choice(m, min(m, 1024), replace=False)]
    centre = some[r.choice(len(some), k, replace=False)]
    for _ in range(8):
        own = np.argmax(some @ centre.T, axis=1)
        for j in range(k):
            mean = some[own == j].sum(axis=0)
            centre[j] = mean / max(1e-9, float(np.linalg.norm(mean)))
    own = np.argmax(x @ centre.T, axis=1)
    return np.repeat(own, _SEGMENT)[np.minimum(np.arange(len(ids)), m * _SEGMENT - 1)]


class _Order0:
    """The order-0 tables of a chunk and the lanes' choices among them."""

    def __init__(self, counts: np.ndarray):
        """counts: a row for each table, a column for each of the chunk's distinct ids. Frequencies of a table sum to
        1 << bits."""
        tables, total = len(counts), counts.sum(axis=0)
        self.tables, self.wide = counts.shape
        self.bits = min(18, self.wide.bit_length() + 4)
        # Ids that a table has not seen keep a small part of it, by how common they are elsewhere.
        part = counts * 64 + total * counts.sum(axis=1, keepdims=True) // max(1, int(total.sum()))
        freq = 1 + part * ((1 << self.bits) - self.wide) // np.maximum(1, part.sum(axis=1, keepdims=True))
        freq[np.arange(tables), np.argmax(freq, axis=1)] += (1 << self.bits) - freq.sum(axis=1)
        self.cum = (np.cumsum(freq, axis=1) - freq).ravel()
        # Costs in 1/64 bit by integers: the place of the leading bit and a table of what follows it.
        e = np.frexp(freq.astype(np.float64))[1] - 1
        self.cost = np.ascontiguousarray(((self.bits - e) * 64 - _LOG2.take((freq << 6 >> e) & 63)).T.astype(np.int16))
        self.freq = freq.ravel()
        self.first = int(np.argmax(counts.sum(axis=1)))

    def slots(self) -> np.ndarray:
        return np.repeat(np.tile(np.arange(self.wide, dtype=np.uint16), self.tables), self.freq)

    def begin(self, lanes: int) -> None:
        self.score = np.zeros((lanes, self.tables), np.int32)
        self.base = np.full(lanes, self.first * self.wide, np.int64)  # where the chosen table begins in freq,
        self.slot0 = np.full(lanes, self.first << self.bits, np.int64)  # and in slots()

    def follow(self, ids: np.ndarray) -> None:
        """ids: the last rows of ids of the first lanes."""
        if self.tables > 1:
            n = ids.shape[1]
            own = self.score[:n]
            own >>= 1
            # An id costs at most 18 bits: 16 of them fit 16-bit numbers.
            spent = self.cost.take(ids[0], axis=0, mode="clip")
            for row in ids[1:]:
                spent += self.cost.take(row, axis=0, mode="clip")
            own += spent
            chosen = np.argmin(own, axis=1)
            np.multiply(chosen, self.wide, out=self.base[:n])
            np.left_shift(chosen, self.bits, out=self.slot0[:n])


def encode_chunk(ids: np.ndarray) -> bytes:
    """Coded form of ids (each under 65536)."""
    ids = np.ascontiguousarray(ids, np.int32)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    head, tables = b"", 0
    sizes, checks, words = np.zeros(blocks, "<u4"), np.zeros(blocks, "<u4"), []
    if n:
        if ids.min() < 0 or ids.max() >= 1 << 16:
            raise ValueError("an id does not fit 16 bits")
        seen = np.flatnonzero(np.bincount(ids))
        own = _cluster(ids)
        tables = int(own.max()) + 1
        # From here on an id is its place among the distinct ones, which keeps tables small.
        place = np.zeros(int(seen[-1]) + 1, np.int32)
        place[seen] = np.arange(len(seen), dtype=np.int32)
        coded = place[ids]
        codes = _float16(np.bincount(own * len(seen) + coded, minlength=tables * len(seen)).reshape(tables, -1))
        head = zlib.compress(seen.astype("<u2").tobytes() + codes.tobytes(), 6)
        zero = _Order0(_from_float16(codes))
        zero.begin(blocks)
        freq, cum = zero.freq, zero.cum
        full = np.zeros(blocks * BLOCK, np.int32)
        full[:n] = coded
        grid = np.ascontiguousarray(full.reshape(blocks, BLOCK).T)
        last = n - (blocks - 1) * BLOCK
        model = _Model(blocks)
        # low has 63 bits; the sign bit is the carry.
        low, span = np.zeros(blocks, np.int64), np.full(blocks, 1 << 62, np.int64)
        out = np.zeros(blocks * (BLOCK + 4), np.uint32)
        begin = np.arange(blocks, dtype=np.int64) * (BLOCK + 4)
        pos = begin.copy()

        def carry() -> None:
            if low.min() < 0:
                who = np.flatnonzero(low < 0)
                low[who] &= (1 << 63) - 1
                at = pos[who] - 1
                while len(at):  # add one to the word before, and on while that overflows
                    out[at] += np.uint32(1)
                    at = at[out[at] == 0] - 1

        def emit(lanes: np.ndarray) -> None:
            lo, at = low[lanes], pos[lanes]
            out[at] = (lo >> 31).astype(np.uint32)
            low[lanes] = (lo & _HALF) << 32
            pos[lanes] = at + 1

        for t in range(BLOCK if blocks > 1 else last):
            k = blocks if t < last else blocks - 1
            now = grid[t, :k]
            if t and not t % _SWITCH:
                zero.follow(grid[t - _SWITCH : t, :k])
            at0 = now + zero.base[:k]
            model.predict(k)
            hit1, hit2 = (now == model.id1).astype(np.int32), (now == model.id2).astype(np.int32)
            fa, fb = model.fa, model.fb
            escape = (hit2 | hit1 & (fb != 0)) == 0
            flag = escape.astype(np.int32)
            # The share of the order-2 hit begins at 0, of the order-1 hit at fa, of the escape at fa + fb.
            start = fa * (1 - hit2) + fb * flag
            width = (fa - fb) * hit2 + fb + (65536 - fa - fb - fb) * flag
            r = span[:k] >> 16
            s = r * width.astype(np.int64)
            r0 = s >> zero.bits
            r *= start.astype(np.int64)
            inside = r0 * cum.take(at0, mode="clip")
            inside *= flag.astype(np.int64)
            r += inside
            low[:k] += r
            r0 *= freq.take(at0, mode="clip")
            s = np.where(escape, r0, s)
            carry()
            span[:k] = s
            lanes = (s < _BOTTOM).nonzero()[0]
            if len(lanes):
                emit(lanes)
                span[lanes] <<= 32
            model.update(k, now, hit1, hit2)
        every = np.arange(blocks)
        for _ in range(2):
            emit(every)
        sizes[:] = pos - begin
        words = [out[b:e] for b, e in zip(begin.tolist(), pos.tolist())]
        raw = ids.astype("<u4")
        checks[:] = [zlib.crc32(raw[b * BLOCK : (b + 1) * BLOCK], zlib.crc32(w.astype("<u4"))) for b, w in enumerate(words)]
    body = np.concatenate(words).astype("<u4").tobytes() if words else b""
    rest = struct.pack("<IQIII", BLOCK, n, blocks, tables, len(head)) + sizes.tobytes() + checks.tobytes() + head
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest + body


def _opened(data: bytes):
    """(block size, ids, distinct ids, order-0 tables, words and checksum of each block, words) of a chunk; ValueError if
    it's damaged."""
    if len(data) < _HEAD.size or data[:4] != MAGIC:
        raise ValueError("not a coded chunk")
    _, check, block, n, blocks, tables, head = _HEAD.unpack_from(data)
    end = _HEAD.size + 8 * blocks + head
    if end > len(data) or zlib.crc32(memoryview(data)[8:end]) != check:
        raise ValueError("the header of a chunk is damaged")
    sizes = np.frombuffer(data, "<u4", blocks, _HEAD.size).astype(np.int64)
    checks = np.frombuffer(data, "<u4", blocks, _HEAD.size + 4 * blocks)
    if not block or blocks != -(-n // block) or (n and not 0 < tables <= TABLES) or len(data) - end != 4 * int(sizes.sum()):
        raise ValueError("a chunk has not the length its header states")
    if not n:
        return block, n, None, None, sizes, checks, None
    # At most 65536 ids and their codes, whatever the compressed bytes say.
    raw = zlib.decompressobj().decompress(data[end - head : end], (2 + 2 * tables) << 16)
    seen = len(raw) // (2 + 2 * tables)
    codes = np.frombuffer(raw, "<u2", seen * tables, 2 * seen).reshape(tables, seen)
    distinct = np.frombuffer(raw, "<u2", seen).astype(np.int32)
    return block, n, distinct, _Order0(_from_float16(codes)), sizes, checks, np.append(np.frombuffer(data, "<u4", offset=end), np.zeros(4, np.uint32))


def decode_chunk(data: bytes, only: list[int] | None = None) -> np.ndarray:
    """Ids of a chunk (or of the blocks in `only`). Raises ValueError if the chunk is damaged or cut off."""
    block, n, distinct, zero, sizes, checks, words = _opened(data)
    if not n:
        return np.zeros(0, np.int32)
    blocks = len(sizes)
    begin = np.cumsum(sizes) - sizes
    length = np.full(blocks, block, np.int64)
    length[-1] = n - (blocks - 1) * block
    pick = np.arange(blocks) if only is None else np.asarray(sorted(only), np.int64)
    checks, coded = checks[pick], [zlib.crc32(words[b : b + n]) for b, n in zip(begin[pick].tolist(), sizes[pick].tolist())]
    length, begin = length[pick], begin[pick]
    lanes = len(pick)
    freq, cum, slot = zero.freq, zero.cum, zero.slots()
    zero.begin(lanes)
    model, pos = _Model(lanes), begin.copy()
    span = np.full(lanes, 1 << 62, np.int64)
    words = words.astype(np.int64)
    # The coder's low has 63 bits: one word and 31 bits of the next; the bit that is left is carried along.
    code, spare = (words[pos] << 31) | (words[pos + 1] >> 1), words[pos + 1] & 1
    pos += 2
    grid = np.zeros((block, lanes), np.int32)
    for t in range(int(length.max())):
        k = int((length > t).sum()) if t >= length[-1] else lanes  # only the last lane can be shorter
        if t and not t % _SWITCH:
            zero.follow(grid[t - _SWITCH : t, :k])
        base = zero.base[:k]
        model.predict(k)
        r = span[:k] >> 16
        c = code[:k]
        # Where the escape's share begins, and the order-1 hit's.
        to1, to2 = r * (model.fa + model.fb).astype(np.int64), r * model.fa.astype(np.int64)
        hit2, escape = c < to2, c >= to1
        c = c - np.where(escape, to1, to2 * ~hit2)
        s = np.where(escape, (r << 16) - to1, np.where(hit2, to2, to1 - to2))
        r0 = s >> zero.bits
        where0 = (c.view(np.uint64) // r0.view(np.uint64)).view(np.int64)
        np.minimum(where0, (1 << zero.bits) - 1, out=where0)
        where0 += zero.slot0[:k]
        found = slot.take(where0, mode="clip")
        at0 = base + found
        inside = r0 * cum.take(at0, mode="clip")
        inside *= escape
        c -= inside
        r0 *= freq.take(at0, mode="clip")
        s = np.where(escape, r0, s)
        now = np.where(hit2, model.id2, np.where(escape, found.astype(np.int32), model.id1))
        code[:k], span[:k] = c, s
        low = (s < _BOTTOM).nonzero()[0]
        if len(low):
            at = pos[low]
            word = words.take(at, mode="clip")
            code[low] = (c[low] << 32) | (spare[low] << 31) | (word >> 1)
            spare[low] = word & 1
            pos[low] = at + 1
            span[low] <<= 32
        grid[t, :k] = now
        model.update(k, now, (now == model.id1).astype(np.int32), (now == model.id2).astype(np.int32))
    grid = distinct.take(grid, mode="clip")
    parts = [grid[: length[i], i] for i in range(lanes)]
    for i, p in enumerate(parts):
        if zlib.crc32(p.astype("<u4"), coded[i]) != checks[i]:
            raise ValueError(f"checksum of block {pick[i]} is wrong")
    return np.concatenate(parts)
