"""Words and word shingles of UTF-8 texts as 64-bit hashes, with numpy over whole batches."""

from __future__ import annotations

import numpy as np

from .segments import _MULT, mix64, pieces, span_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words that are runs of anything but ASCII blanks.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, *range(9, 14)]] = False
#: Bytes of words that are runs of anything but ASCII characters other than letters and digits.
WORD_CHARS = np.zeros(256, bool)
WORD_CHARS[48:58] = WORD_CHARS[65:91] = WORD_CHARS[97:123] = WORD_CHARS[128:] = True


def words(data, offs: np.ndarray, inside: np.ndarray):
    """(hashes, byte starts, byte ends, words before each text) of words, A-Z in lower case; a word is a run of bytes
    that are set in `inside`, and never passes from one text into the next."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    own = np.zeros(n + 2, bool)
    own[1:-1] = inside[raw]
    begins, stops = own[1:-1] & ~own[:-2], own[1:-1] & ~own[2:]
    edge = offs[(offs > 0) & (offs < n)]
    begins[edge] = own[1:-1][edge]
    stops[edge - 1] = own[1:-1][edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return span_hashes(_LOWER[raw], starts, ends), starts, ends, np.searchsorted(starts, offs)


def shingles(data, offs: np.ndarray, width: int = 5):
    """(hashes, shingles before each text): every run of `width` words of each text, repeated ones too; the whole
    sequence of a text with fewer words; none of a text without words."""
    out, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    scale = [np.uint64(pow(int(_MULT), j + 1, 1 << 64)) for j in range(width)]
    for i, j in pieces(offs):
        h, _, _, at = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], NOT_BLANK)
        n = np.diff(at)
        full = np.maximum(n - width + 1, 0)
        some = (n > 0) & (n < width)
        take = np.where(some, 1, full)
        first = np.repeat(at[:-1] - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
        size = np.repeat(np.minimum(n, width), take)
        s = np.zeros(len(first), np.uint64)
        for k in range(width):
            w = h[np.minimum(first + k, max(0, len(h) - 1))] * scale[k] if len(h) else s
            s += np.where(size > k, w, np.uint64(0))
        out.append(mix64(s + size.astype(np.uint64)))
        counts.append(take)
    return np.concatenate(out), np.cumsum(np.concatenate(counts))
