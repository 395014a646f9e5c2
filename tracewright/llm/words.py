"""Words and word shingles of text columns as flat numpy arrays.

A word is a run of letters, digits and non-ASCII bytes of the lower-cased text.
Word hashes are polynomial over the bytes and independent of the position, so
texts can be hashed in pieces of bounded size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix, utf8

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, BACK)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Words:
    """Words of the rows of a text column: `row`, `start`, `end` (bytes), `hash`, and `first`: each row's first word."""

    def __init__(self, text: pa.Array):
        self.raw, offsets = utf8(pc.utf8_lower(text))
        n = len(offsets) - 1
        inside = np.zeros(len(self.raw) + 2, bool)
        inside[1:-1] = _WORD[self.raw]
        turn = inside[1:] != inside[:-1]
        turn[offsets] |= inside[1:][offsets] & inside[:-1][offsets]  # a row's end also ends its word
        begins = inside[1:] & turn
        ends = inside[:-1] & turn
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(n + 1))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.zeros(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, "right")))
            a, b = self.start[i], self.end[j - 1]
            up, down = _powers(1 << max(20, int(b - a).bit_length()))
            upto = np.concatenate(([np.uint64(0)], np.cumsum(_VALUE[self.raw[a:b]] * up[: b - a], dtype=np.uint64)))
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = mix((upto[e] - upto[s]) * down[s])
            i = j
        return out

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word at which it begins, hash) of every run of k words inside a row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: n] == self.row[k - 1 :])
        code = np.zeros(len(at), np.uint64)
        for j in range(k):
            code = code * STEP + self.hash[at + j]
        return at, mix(code)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the distinct shingles, sorted; a row of fewer than k words has one shingle of all of them."""
        at, code = self.grams(k)
        rows, codes = [self.row[at]], [code]
        size = np.diff(self.first)
        for r in np.flatnonzero((size > 0) & (size < k)):
            c = np.uint64(size[r])
            for h in self.hash[self.first[r] : self.first[r + 1]]:
                c = np.uint64((int(c) * int(STEP) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            rows.append(np.array([r]))
            codes.append(mix(np.array([c], np.uint64)))
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        return row[fresh], code[fresh]
