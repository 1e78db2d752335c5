"""SentencePiece encoding and decoding: exact BPE by backtracking.

Encoding looks for the one token sequence whose neighbours all survive a re-merge. At each position the longest
matching token is tried first (matches come from an Aho-Corasick automaton), then its shorter prefixes; a candidate is
kept if re-merging the previous token and it gives the same two tokens. A position from which nothing fits is marked in
a bitfield and the previous token is shortened. The text is first cut wherever the two neighbouring characters occur
together in no token, since no merge can cross such a place; equal segments are encoded once for each worker.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .segments import CHUNK, SegmentEncoder, kept

MARK = "▁"


class PieceModel:
    """Vocabulary of a BPE model with byte fallback, as the sentencepiece library reports it."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.unk, self.eos = n, sp.unk_id(), sp.eos_id()
        self.byte = {}
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.out: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unused(i):
                self.out.append(b"")
            elif sp.is_unknown(i):
                self.out.append(" ⁇ ".encode())
            else:
                self.rank[piece], self.ids[piece] = sp.get_score(i), i
                self.out.append(piece.replace(MARK, " ").encode())


#: Pairs of tokens of which a worker remembers whether they are compatible, some 130 bytes each.
MOST_FITS = 1 << 18


class BacktrackEncoder(SegmentEncoder):
    chunk, slots_log2 = CHUNK, 20

    def __init__(self, path: str):
        import ahocorasick

        super().__init__()
        self.model = m = PieceModel(path)
        pairs = {(p[i], p[i + 1]) for p in m.ids for i in range(len(p) - 1)}
        keys = np.array(sorted((ord(a) << 21) | ord(b) for a, b in pairs), np.int64)
        self.pairs = keys
        self.small = np.zeros((1 << 10, 1 << 10), bool)
        low = keys[((keys >> 21) < 1 << 10) & ((keys & 0x1FFFFF) < 1 << 10)]
        self.small[low >> 21, low & 0x1FFFFF] = True
        # Tokens that merging can produce at all; a sequence of tokens never has others.
        self.tokens = {p: p for p in m.ids if len(p) == 1 or self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.tokens:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.shorter: dict[str, str | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE: merge the best-scored adjacent pair, the leftmost of equals, until none is in the vocabulary."""
        parts, rank = list(text), self.model.rank
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether re-merging the two tokens' characters gives the two tokens back."""
        key = (a, b)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= MOST_FITS:
                self.fits.clear()
            # The vocabulary's own strings are kept, not copies of them for each pair.
            known = self.fits[self.tokens.get(a, a), self.tokens.get(b, b)] = self.merged(a + b) == [a, b]
        return known

    def prefix(self, token: str) -> str | None:
        """The longest token that is a proper prefix."""
        if token not in self.shorter:
            self.shorter[token] = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.tokens), None)
        return self.shorter[token]

    def split(self, text: str) -> list[str]:
        """Tokens of one segment; a character outside the vocabulary stands alone."""
        n = len(text)
        longest = [1] * (n + 1)
        for end, k in self.automaton.iter(text):
            s = end - k + 1
            if k > longest[s]:
                longest[s] = k
        if longest[0] == n:
            return [text]
        failed = 0  # bit i: nothing fits from position i on
        out: list[str] = []
        pos, token = 0, text[: longest[0]]
        while True:
            while token is not None:
                end = pos + len(token)
                if not failed >> end & 1 and (not out or self.compatible(out[-1], token)):
                    break
                token = self.prefix(token)
            if token is None:
                if not out:
                    raise AssertionError(f"no token sequence for {text!r}")
                failed |= 1 << pos
                token = out.pop()
                pos -= len(token)
                token = self.prefix(token)
                continue
            out.append(token)
            pos += len(token)
            if pos == n:
                return out
            token = text[pos : pos + longest[pos]]

    def encode_new(self, segments):
        ids, byte = self.model.ids, self.model.byte
        out = []
        for s in segments:
            got: list[int] = []
            for p in self.split(s):
                i = ids.get(p)
                if i is None:
                    got += [byte[b] for b in p.encode("utf-8", "replace")] if byte else [self.model.unk]
                else:
                    got.append(i)
            out.append(got)
        return out

    def starts(self, cps, first):
        a, b = cps[:-1], cps[1:]
        out = np.ones(len(cps), bool)
        low = (a < 1 << 10) & (b < 1 << 10)
        joined = np.zeros(len(a), bool)
        joined[low] = self.small[a[low], b[low]]
        rest = np.flatnonzero(~low)
        if len(rest):
            key = (a[rest].astype(np.int64) << 21) | b[rest]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[rest] = self.pairs[at] == key
        out[1:] = ~joined
        return out | first

    def entries(self, cps, offs):
        """Blanks become marks, and one mark is put before every text that has characters."""
        size = np.diff(offs)
        full = size > 0
        shift = np.concatenate([[0], np.cumsum(full)])
        marked = np.full(len(cps) + int(full.sum()), ord(MARK), np.uint32)
        to = np.arange(len(cps)) + np.repeat(shift[1:], size)
        marked[to] = np.where(cps == 0x20, ord(MARK), cps)
        return super().entries(marked, offs + shift)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text: tokens' bytes joined, without the mark put before the text."""
        raw = b"".join(map(self.model.out.__getitem__, ids))
        if raw[:1] == b" ":
            raw = raw[1:]
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw

    def digests(self, ids: np.ndarray, offs: np.ndarray):
        """For each text with its end id: (number of ids, sha256 of the decimal ids, sha256 of the decoded text)."""
        names = self.names
        for i in range(len(offs) - 1):
            own = ids[offs[i] : offs[i + 1]].tolist()
            own.append(self.model.eos)
            yield len(own), hashlib.sha256(" ".join(map(names.__getitem__, own)).encode()).hexdigest(), hashlib.sha256(self.decode(own)).hexdigest()

    @property
    def names(self) -> list[str]:
        if not hasattr(self, "_names"):
            self._names = [str(i) for i in range(self.model.size)]
        return self._names


def opened(path: str) -> BacktrackEncoder:
    """One encoder for each worker process and file."""
    return kept(BacktrackEncoder, path)
