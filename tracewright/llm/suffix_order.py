"""Suffix sorting of one block with a difference cover, one suffix bucket at a time.

A difference cover modulo `PERIOD` holds, for any two residues, a common shift
that brings both onto the cover.  The suffixes that start on the cover are ranked
first; then each bucket of suffixes is sorted by its first PERIOD bytes alone,
and ties are decided by the rank of the cover suffix a common shift further on.
So memory is that of the block's text, the cover's ranks and one bucket.
"""

from __future__ import annotations

from functools import cmp_to_key, lru_cache

import numpy as np

PERIOD = 32
BUCKET = 1 << 17
FAR = 4 * PERIOD  # depth of the cover's ranks


@lru_cache(1)
def cover() -> tuple[np.ndarray, np.ndarray]:
    """(is a residue on the cover, common shift of two residues)."""
    chosen: list[int] = [0]
    have: set[int] = {0}
    while len(have) < PERIOD:  # greedy: the residue that adds most differences

        def adds(x: int) -> int:
            return len({(x - y) % PERIOD for y in chosen} | {(y - x) % PERIOD for y in chosen} | have)

        best = max(range(PERIOD), key=lambda x: (adds(x), -x))
        have |= {(best - y) % PERIOD for y in chosen} | {(y - best) % PERIOD for y in chosen}
        chosen.append(best)
    on = np.zeros(PERIOD, bool)
    on[chosen] = True
    shift = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            shift[a, b] = next(d for d in range(PERIOD) if on[(a + d) % PERIOD] and on[(b + d) % PERIOD])
    return on, shift


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first key leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    if len(order):
        change = np.zeros(len(order), bool)
        for k in keys:
            change[1:] |= k[order[1:]] != k[order[:-1]]
        new[order] = np.cumsum(change)
    return new


class Block:
    """The text of a block and the ranks of its cover suffixes."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        padded = np.concatenate([text, np.zeros(FAR + PERIOD + 8, np.uint8)])
        self.words = np.zeros(n + FAR + PERIOD, np.uint64)
        for j in range(8):
            self.words |= padded[j : j + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * j)
        on, self.shift = cover()
        at = np.flatnonzero(np.resize(on, n + PERIOD))
        self.place = np.full(n + FAR + 2 * PERIOD, len(at), np.int64)
        self.place[at] = np.arange(len(at))
        rank = _ranks(*[self.words[at + 8 * j] for j in range(PERIOD // 8)])
        depth = PERIOD
        while depth < FAR:
            rank = _ranks(rank, np.append(rank, -1)[self.place[np.minimum(at + depth, len(self.place) - 1)]])
            depth *= 2
        self.rank = np.append(rank, -1)

    def _cover_rank(self, at: np.ndarray) -> np.ndarray:
        return self.rank[self.place[at]]

    def _compare(self, p: int, q: int) -> int:
        d = self.shift[p % PERIOD, q % PERIOD]
        return int(np.sign(self._cover_rank(p + d) - self._cover_rank(q + d)))

    def sort(self, starts: np.ndarray):
        """Yields the starts of each suffix bucket in suffix order."""
        head = self.words[starts]
        order = np.argsort(head >> np.uint64(32), kind="stable")
        lead = (head >> np.uint64(32))[order]
        cut = 0
        while cut < len(order):
            end = min(len(order), cut + BUCKET)
            end = int(np.searchsorted(lead, lead[end - 1], "right"))  # whole buckets of four bytes
            yield self._sort_bucket(starts[order[cut:end]])
            cut = end

    def _sort_bucket(self, p: np.ndarray) -> np.ndarray:
        group = _ranks(*[self.words[p + 8 * j] for j in range(PERIOD // 8)])
        order = np.argsort(group, kind="stable")
        p, group = p[order], group[order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(p)))
        residue = p % PERIOD
        low, high = np.minimum.reduceat(residue, first), np.maximum.reduceat(residue, first)
        third = np.add.reduceat((residue != np.repeat(low, size)) & (residue != np.repeat(high, size)), first) > 0
        rank = self._cover_rank(p + np.repeat(self.shift[low, high], size))
        order = np.lexsort((rank, group))
        p = p[order]
        for g in np.flatnonzero(third):  # more than two residues: no shift fits all, so compare pairs
            part = slice(first[g], first[g] + size[g])
            p[part] = sorted(p[part].tolist(), key=cmp_to_key(self._compare))
        return p

    def same(self, p: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
        """Whether the strings of `length` (at least 8) bytes at p and q are equal."""
        out = np.ones(len(p), bool)
        for j in [*range(0, length - 8, 8), length - 8]:
            out &= self.words[p + j] == self.words[q + j]
        return out


def repeated(text: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which starts begin a string of `length` bytes that a start of smaller `order` also begins."""
    block, out = Block(text), np.zeros(len(starts), bool)
    back = np.zeros(len(text) + 1, np.int64)
    back[starts] = np.arange(len(starts))
    for p in block.sort(starts):
        fresh = np.append(True, ~block.same(p[1:], p[:-1], length))
        at = back[p]
        first = np.flatnonzero(fresh)
        least = np.minimum.reduceat(order[at], first)
        out[at] = order[at] > np.repeat(least, np.diff(np.append(first, len(p))))
    return out
