"""Operator 1: benchmark decontamination by greedy string tiling.

Five-word seeds of every document are joined with those of the benchmark; pairs
whose seeds could reach the threshold are tiled: the longest matches of words
that are not marked yet are marked first, found by running Karp-Rabin over
windows of a falling length, and tiles never overlap.  The share of an item's
words under tiles decides, so passages count in any order.

Items with the same words are one, under their smallest id; that is settled over
the whole benchmark before it is dealt, by the hash of the words, into parts of a
bounded size (`part_bytes` of text, summed and not estimated).  The driver holds
one part at a time and hands it out as a broadcast variable: a larger benchmark
means more passes over the documents, not a larger broadcast, and gives the same
rows.  Each pass is narrow, there is no shuffle of documents, and a hot passage
costs each document only its own tiling.

Defined cases: null and empty texts match nothing; items without an id, without a
text or of fewer than five words match nothing; null document ids pass through;
every row of the documents is judged on its own; item ids have to be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, mix, text_groups, tidy
from .words import BACK, BASE, Words

SEED = 5
FIRST_WINDOW = 20


def _windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin values of all windows of `size` tokens."""
    n = len(tokens)
    up, down = np.full(n + 1, BASE), np.full(n + 1, BACK)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    upto = np.concatenate(([np.uint64(0)], np.cumsum(tokens * up[:n], dtype=np.uint64)))
    return (upto[size:] - upto[:-size]) * down[: n - size + 1]


def tiles(pattern: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in pattern, place in text, length), longest first."""
    p_free, t_free = np.ones(len(pattern), bool), np.ones(len(text), bool)
    p_list, t_list = pattern.tolist(), text.tolist()
    out: list[tuple[int, int, int]] = []
    size = max(least, min(FIRST_WINDOW, len(pattern), len(text)))

    def scan(size: int) -> tuple[int, list[tuple[int, int, int]]]:
        if min(len(pattern), len(text)) < size:
            return 0, []

        def open_windows(free: np.ndarray) -> np.ndarray:
            upto = np.concatenate(([0], np.cumsum(free)))
            return np.flatnonzero(upto[size:] - upto[:-size] == size)

        table: dict[int, list[int]] = {}
        codes = _windows(text, size)
        for t in open_windows(t_free).tolist():
            table.setdefault(int(codes[t]), []).append(t)
        found, longest = [], 0
        codes = _windows(pattern, size)
        for p in open_windows(p_free).tolist():
            for t in table.get(int(codes[p]), ()):
                if p and t and p_free[p - 1] and t_free[t - 1] and p_list[p - 1] == t_list[t - 1]:
                    continue  # part of the match that begins one word earlier
                n = 0
                while p + n < len(p_list) and t + n < len(t_list) and p_free[p + n] and t_free[t + n] and p_list[p + n] == t_list[t + n]:
                    n += 1
                if n >= size:
                    found.append((p, t, n))
                    longest = max(longest, n)
                    if longest > 2 * size:
                        return longest, found
        return longest, found

    while True:
        longest, found = scan(size)
        if longest > 2 * size:
            size = longest
            continue
        queue = sorted(found, key=lambda m: (-m[2], m[0], m[1]))
        while queue:
            p, t, n = queue.pop(0)
            both = p_free[p : p + n] & t_free[t : t + n]
            if both.all():
                p_free[p : p + n] = t_free[t : t + n] = False
                out.append((p, t, n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], both.astype(np.int8), [0]))))
            rest = [(p + a, t + a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= size]
            if rest:  # what other tiles left of it competes again
                queue = sorted(queue + rest, key=lambda m: (-m[2], m[0], m[1]))
        if size <= least:
            return out
        size = size // 2 if size > 2 * least else least


class Items:
    """Words and seeds of a part of the benchmark."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words(pa.array(texts, pa.string()))
        kept: dict[bytes, int] = {}
        parts = []
        self.ids: list[int] = []
        for i in sorted(range(len(ids)), key=lambda i: ids[i]):
            own = words.hash[words.first[i] : words.first[i + 1]]
            if len(own) >= SEED and own.tobytes() not in kept:
                kept[own.tobytes()] = len(self.ids)
                self.ids.append(ids[i])
                parts.append(own)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))
        self.words = np.concatenate([np.zeros(0, np.uint64), *parts])
        whose = np.repeat(np.arange(len(parts)), self.size)
        at = np.flatnonzero(whose[: max(0, len(whose) - SEED + 1)] == whose[SEED - 1 :])
        code = _windows(self.words, SEED)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.code, self.item = code[order], whose[at][order]
        self.place = (at - self.begin[whose[at]])[order]
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.code >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, words: Words, threshold: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item, tiles) of the pairs whose tiles cover at least the threshold of the item."""
        if len(words.hash) < SEED or not len(self.code):
            return
        code = _windows(words.hash, SEED)
        at = np.flatnonzero(self.hint[(code >> np.uint64(44)).astype(np.int64)])
        at = at[words.row[at] == words.row[at + SEED - 1]]
        low, high = np.searchsorted(self.code, code[at], "left"), np.searchsorted(self.code, code[at], "right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        seed = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        row, item, place = words.row[at], self.item[seed], self.place[seed]
        order = np.lexsort((place, item, row))
        row, item, place, at = row[order], item[order], place[order], at[order]
        if not len(row):
            return
        fresh = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))
        first = np.flatnonzero(fresh)
        # words of the item under some seed: no tiling can cover more
        step = np.where(fresh, SEED, np.minimum(SEED, np.diff(place, prepend=0)))
        bound = np.add.reduceat(step, first)
        for a, b, most in zip(first.tolist(), [*first[1:].tolist(), len(row)], bound.tolist(), strict=True):
            k = int(item[a])
            if most < threshold * self.size[k]:
                continue
            spot = np.unique(at[a:b])
            inside = np.unique((spot[:, None] + np.arange(SEED)).ravel())
            gap = np.flatnonzero(np.diff(inside) > 1) + 1
            text = np.insert(words.hash[inside], gap, np.arange(1, len(gap) + 1).astype(np.uint64))  # a gap ends every match
            where = np.insert(inside, gap, -1) - words.first[row[a]]
            found = tiles(self.words[self.begin[k] : self.begin[k + 1]], text)
            if sum(n for _, _, n in found) >= threshold * self.size[k]:
                yield int(row[a]), k, [(p, int(where[t]), n) for p, t, n in found]


def distinct_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, text, deal): one row for each different list of at least five words, under its smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_groups(batch.column(1)):
                words = Words(batch.column(1).slice(start, end - start))
                size = np.diff(words.first)
                step = np.arange(len(words.hash), dtype=np.uint64) - np.repeat(words.first[:-1], size).astype(np.uint64)
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(words.hash + mix(step + np.uint64(salt << 32))), dtype=np.uint64))) for salt in (1, 2)]
                names = [pa.array(np.diff(x[words.first]).view(np.int64)) for x in sums]
                out = pa.RecordBatch.from_arrays([*[c.slice(start, end - start) for c in batch.columns], *names], ["id", "text", "w1", "w2"])
                yield out.filter(pa.array(size >= SEED))

    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = rows.mapInArrow(tidy(run), "id long, text string, w1 long, w2 long")
    return rows.groupBy("w1", "w2").agg(F.min(F.struct("id", "text")).alias("x")).select("x.*", F.col("w1").alias("deal"))


def benchmark_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_bytes: int = 8 << 20) -> Iterator[Broadcast]:
    """The benchmark as broadcast variables of bounded size, one after the other."""
    rows = checkpointed(distinct_items(benchmark, id_col, text_col))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    for part in range(parts):
        own = rows.where(F.pmod("deal", F.lit(parts)) == part).collect()
        yield rows.sparkSession.sparkContext.broadcast(Items([r.id for r in own], [r.text for r in own]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = 8 << 20) -> DataFrame:
    """(id, item, coverage, n_tiles, n_words, tiles): one row per document and item at or above the threshold."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for part_items in benchmark_parts(benchmark, item_col, item_text_col, part_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = part_items) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for start, end in text_groups(batch.column(1)):
                    rows = list(items.matches(Words(batch.column(1).slice(start, end - start)), threshold))
                    ids = batch.column(0).take(pa.array([start + r for r, _, _ in rows], pa.int64()))
                    covered = [sum(n for _, _, n in t) for _, _, t in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array([items.ids[k] for _, k, _ in rows], pa.int64()),
                            pa.array([c / int(items.size[k]) for c, (_, k, _) in zip(covered, rows, strict=True)], pa.float64()),
                            pa.array([len(t) for _, _, t in rows], pa.int64()),
                            pa.array(covered, pa.int64()),
                            pa.array([[{"item_word": p, "doc_word": d, "n_words": n} for p, d, n in t] for _, _, t in rows], pa.list_(pa.struct([("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))),
                        ],
                        ["id", "item", "coverage", "n_tiles", "n_words", "tiles"],
                    )

        part = docs.select(id_col, text_col).mapInArrow(tidy(run), f"id {kind}, item long, coverage double, n_tiles long, n_words long, tiles array<struct<item_word:long,doc_word:long,n_words:long>>")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = 8 << 20) -> DataFrame:
    """The documents, with all their columns, that no item reaches the threshold in."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for part_items in benchmark_parts(benchmark, item_col, item_text_col, part_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = part_items) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for start, end in text_groups(batch.column(at)):
                    for row, _, _ in items.matches(Words(batch.column(at).slice(start, end - start)), threshold):
                        clean[start + row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
