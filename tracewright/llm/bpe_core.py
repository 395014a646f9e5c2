"""Byte-pair merging of many sequences at once, on ragged numpy arrays.

All symbols of a batch lie in one flat array; `owner` tells the sequence of
each.  In every round each sequence applies its own lowest-ranked pair at all
non-overlapping places at once, and only the pairs next to a change are looked
up again.  Sequences without a pair left leave the working set.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .common import mix, pick, utf8

NO_RANK = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Vocabulary:
    """Vocabulary, merges and first symbols of a tokenizer file (`.json`)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        self.first = np.array([self.ids[c] for c in letters], np.int64)
        self.last = np.array([self.ids[c + self.suffix] for c in letters], np.int64)
        keys, ranks, made = [], [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(self.ids[a] << 32 | self.ids[b])
            ranks.append(rank)
            made.append(self.ids[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int64)[order]
        self.made = np.array(made, np.int64)  # by rank

    def names(self) -> list[str]:
        """Token text by id, added tokens included."""
        out = [""] * (1 + max(max(self.ids.values()), *self.added.values(), 0))
        for text, i in {**self.ids, **self.added}.items():
            out[i] = text
        return out

    def inside_pairs(self) -> np.ndarray:
        """256 x 256 table: True where two bytes stand side by side inside some token."""
        back = {c: b for b, c in enumerate(byte_letters())}
        seen = np.zeros((256, 256), bool)
        for text in self.ids:
            if self.suffix and text.endswith(self.suffix):
                text = text[: -len(self.suffix)]
            codes = [back[c] for c in text if c in back]
            if len(codes) > 1 and len(codes) == len(text):
                seen[codes[:-1], codes[1:]] = True
        return seen

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of whole words, flat, and the length of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        flat = self.first[raw]
        if self.suffix:
            ends = np.cumsum(lengths)[lengths > 0] - 1
            flat[ends] = self.last[raw[ends]]
        return flat, lengths

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, flat: np.ndarray, lengths: np.ndarray, want_ids: bool = False):
        """Merges all sequences; returns symbol counts, and (flat ids, counts) with `want_ids`."""
        n = len(lengths)
        counts = lengths.astype(np.int64).copy()
        owner = np.repeat(np.arange(n), lengths)
        sym = flat.astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), NO_RANK)
        if len(sym) > 1:
            both = np.flatnonzero(owner[:-1] == owner[1:])
            rank[both] = self.pair_ranks(sym[both], sym[both + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            low = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            live = low < NO_RANK
            if not live.all():
                keep = np.repeat(live, size)
                counts[owner[starts[~live]]] = size[~live]
                if want_ids:
                    done.append((owner[~keep], sym[~keep]))
                sym, owner, rank, low, size = sym[keep], owner[keep], rank[keep], low[live], size[live]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, size)
            # of a run of overlapping places (a a a) every second one counts, from the left
            at = np.flatnonzero(hit)
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
            run = np.flatnonzero(fresh)
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            at = moved[at]
            for again in (at, at[at > 0] - 1):
                again = again[again < len(sym) - 1]
                same = owner[again] == owner[again + 1]
                rank[again] = NO_RANK
                again = again[same]
                rank[again] = self.pair_ranks(sym[again], sym[again + 1])
            rank[-1] = NO_RANK
        if not want_ids:
            return counts
        if not done:
            return np.zeros(0, np.int64), counts
        who = np.concatenate([d[0] for d in done])
        out = np.concatenate([d[1] for d in done])
        return out[np.argsort(who, kind="stable")], counts


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def string_hashes(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings that lie one after the other, by prefix sums of a polynomial."""
    n = len(raw)
    up, down = np.full(n + 1, _BASE), np.full(n + 1, _BACK)
    up[0] = down[0] = 1
    np.cumprod(up, dtype=np.uint64, out=up)
    np.cumprod(down, dtype=np.uint64, out=down)
    upto = np.concatenate(([np.uint64(0)], np.cumsum(_VALUE[raw] * up[:n], dtype=np.uint64)))
    return mix((upto[ends[1:]] - upto[ends[:-1]]) * down[ends[:-1]])


class Characters:
    """Which characters the pre-token pattern classes as the library does.

    The two know different versions of Unicode; a text with a character that
    they class differently is left to the library as a whole.
    """

    HIGH = re.compile(r"[^\x00-\u024f]")

    def __init__(self, library: Tokenizer, pattern: regex.Pattern):
        self.library, self.pattern = library, pattern
        self.known: dict[str, bool] = {}

    def _same(self, c: str) -> bool:
        pre = self.library.pre_tokenizer.pre_tokenize_str
        return all(len(pre(x)) == len(self.pattern.findall(x)) for x in ("!" + c, "a" + c, c + c))

    def agreed(self, text: str) -> bool:
        if text.isascii():
            return True
        for c in set(self.HIGH.findall(text)):
            if c not in self.known:
                self.known[c] = self._same(c)
            if not self.known[c]:
                return False
        return True


class WordTable:
    """A bounded exact map from words to small arrays of numbers, held in flat arrays.

    Words are found by a 64-bit hash and confirmed on their bytes; a word whose hash
    another one has is worked out each time.  When more than `most` words are held,
    the half that was not asked for lately goes.
    """

    def __init__(self, work: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 1_500_000):
        self.work, self.most, self.turn = work, most, 0
        self._start_over()

    def _start_over(self) -> None:
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.text, self.text_end = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.value, self.value_end = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int32)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The values of distinct words, flat, and the number of values of each."""
        self.turn += 1
        if len(self.key) > self.most:
            self._shed()
        raw, ends = utf8(words)
        key = string_hashes(raw, ends)
        size = np.diff(ends)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        found = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        taken = found.copy()
        slot = self.slot[at] if len(self.key) else np.zeros(len(key), np.int32)
        found &= np.diff(self.text_end)[slot] == size if len(self.key) else False
        which = np.flatnonzero(found)
        mine, theirs = pick(raw, ends[:-1][which], size[which]), pick(self.text, self.text_end[slot[which]], size[which])
        unlike = np.flatnonzero(mine != theirs)
        found[which[np.searchsorted(np.cumsum(size[which]), unlike, "right")]] = False
        which = np.flatnonzero(found)
        self.used[slot[which]] = self.turn
        new = np.flatnonzero(~found)
        values, counts = self.work(words.take(pa.array(new)).to_pylist()) if len(new) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        total, begin = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        total[which], begin[which] = np.diff(self.value_end)[slot[which]], self.value_end[slot[which]]
        total[new], begin[new] = counts, len(self.value) + np.cumsum(counts) - counts
        out = pick(np.concatenate([self.value, values.astype(np.uint32)]), begin, total)
        fresh = ~taken[new]
        fresh[fresh] = np.isin(np.arange(int(fresh.sum())), np.unique(key[new[fresh]], return_index=True)[1])
        self._add(key[new[fresh]], pick(raw, ends[:-1][new[fresh]], size[new[fresh]]), size[new[fresh]], pick(values, (np.cumsum(counts) - counts)[fresh], counts[fresh]), counts[fresh])
        return out, total

    def _add(self, key: np.ndarray, text: np.ndarray, size: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(key)
        place = np.searchsorted(self.key, key[order])
        self.slot = np.insert(self.slot, place, len(self.slot) + order.astype(np.int32))
        self.key = np.insert(self.key, place, key[order])
        self.text, self.value = np.concatenate([self.text, text]), np.concatenate([self.value, values.astype(np.uint32)])
        self.text_end = np.concatenate([self.text_end, self.text_end[-1] + np.cumsum(size)])
        self.value_end = np.concatenate([self.value_end, self.value_end[-1] + np.cumsum(counts)])
        self.used = np.concatenate([self.used, np.full(len(key), self.turn, np.int32)])

    def _shed(self) -> None:
        """Keeps the half that was used last."""
        key, keep = np.zeros(len(self.key), np.uint64), np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        key[self.slot] = self.key
        size, counts = np.diff(self.text_end)[keep], np.diff(self.value_end)[keep]
        text, values, used = pick(self.text, self.text_end[keep], size), pick(self.value, self.value_end[keep], counts), self.used[keep]
        self._start_over()
        self._add(key[keep], text, size, values, counts)
        self.used = used
