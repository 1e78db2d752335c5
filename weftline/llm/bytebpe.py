"""Byte-level BPE ids through the tokenizers library, called once for each distinct pretoken."""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .segments import SegmentEncoder, kept

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# The characters that \s matches in the tokenizer's split pattern.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What the split pattern takes together with an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        c = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        c[WHITE_SPACE] = SPACE
        _classes.append(c)
    return _classes[0]


class ByteBPE(SegmentEncoder):
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them, special tokens' strings included."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def starts(self, cps, first):
        c = classes()[cps]
        n = len(c)
        before = np.empty_like(c)
        before[0], before[1:] = 255, c[:-1]
        before[first] = 255
        white = c == SPACE
        starts = c != before
        # The last blank of a run goes with the word behind it, and begins a segment of its own.
        last = white.copy()
        last[:-1] &= ~white[1:] & ~first[1:]
        last[-1] = False
        starts |= last
        blank = np.flatnonzero(last & (cps == 0x20))
        starts[blank + 1] = False
        quote = np.flatnonzero((cps == 0x27) & starts)
        for q in quote[quote + 1 < n]:
            if c[q + 1] != LETTER or first[q + 1]:
                continue
            for tail in CONTRACTIONS:
                k = len(tail)
                if q + k < n and all(cps[q + 1 + i] == ord(ch) and not first[q + 1 + i] for i, ch in enumerate(tail)):
                    starts[q + 1] = False
                    if q + 1 + k < n:
                        starts[q + 1 + k] = True
                    break
        return starts

    def encode_new(self, segments):
        return [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]

    def encode(self, data, offs):
        ids, at = super().encode(data, offs)
        raw = data.tobytes() if isinstance(data, np.ndarray) else data
        if any(s.encode() in raw for s in self.special):  # a special token's string is taken before the split
            parts = [ids[at[i] : at[i + 1]] for i in range(len(at) - 1)]
            for i in range(len(parts)):
                text = raw[offs[i] : offs[i + 1]]
                if any(s.encode() in text for s in self.special):
                    parts[i] = np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint16)
            ids = np.concatenate(parts)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return ids, at

    def count(self, data, offs):
        raw = data.tobytes() if isinstance(data, np.ndarray) else data
        if any(s.encode() in raw for s in self.special):
            return np.diff(self.encode(data, offs)[1])
        return super().count(data, offs)


def opened(path: str) -> ByteBPE:
    """One encoder for each worker process and file."""
    return kept(ByteBPE, path)
