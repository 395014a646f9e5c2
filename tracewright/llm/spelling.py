"""Operator 12: spelling variants by Aho-Corasick automata over halves of words.

An edit of one code point leaves one half of a word as it is: its left half at
the start of the other word, or its right half at the end.  So every word enters
an automaton shard with both halves, all words are scanned, a hit counts where
the half's offset and the two lengths allow one edit, and the pair is then
verified by its common ends (prefix + suffix >= longer length - 1).

A half is dealt to the shard of (side, length of its word, the three code points
at its end of the word), so a word needs scanning in the shards of its own two
ends and three lengths only, and a shard holds about `shard` halves however large
the vocabulary is.  A key with more halves than that gets shards of its own, over
which its halves are dealt and all of which scan its words.  Within a shard the
halves come first and the words stream past in Arrow batches; a shard's pairs are
counted per scanned word where they are found, and never leave the task.

Words are counted with map-side partial sums.  The largest form is the smallest
of (-n, word) over all shards.  A form has at least `ratio` times its word's
count, so the chain to the root is at most log(largest n) / log(ratio) long, and it
is doubled until no root has a form.

Defined cases: null and empty texts have no words; a null id reads as an empty one
in the hash of the changed runs; runs of any length are words; rows that repeat an
id count as often as they occur; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, give_back

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = 3
PAIRS = 1 << 20
SHARD = 20_000


def counted_words(docs: DataFrame, least_length: int = 6, least: int = 5, one_in: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters, one in `one_in` of which (by document and run) lacks a code point."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"([a-z\\u00C0-\\u00FF]{{{least_length},}})"), 1)).alias("run"))
    h = F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keys(word: Column, size: Column, length: Column) -> list[Column]:
    """Shard keys of a word's two ends where the other word has `length` code points."""
    left, right = F.substring(word, F.lit(1), F.lit(ENDS)), F.substring(word, size - ENDS + 1, F.lit(ENDS))
    return [F.xxhash64(F.lit(side), length, end) for side, end in enumerate([left, right])]


def dealt(words: DataFrame, shards: int, shard: int) -> DataFrame:
    """(shard, scanned, word, n, left): each word's two halves, and the word itself wherever it is to be scanned."""
    word, size = F.col("word"), F.length("word")
    sides = _keys(word, size, size)
    halves = F.array(*[F.struct(k.alias("key"), F.lit(False).alias("scanned"), F.lit(i == 0).alias("left")) for i, k in enumerate(sides)])
    scans = [k for d in (-1, 0, 1) for k in _keys(word, size, size + d)]
    scans = F.transform(F.array_distinct(F.array(*scans)), lambda k: F.struct(k.alias("key"), F.lit(True).alias("scanned"), F.lit(None).cast("boolean").alias("left")))
    rows = words.select("word", "n", F.explode(F.concat(halves, scans)).alias("r")).select("word", "n", "r.*")
    hot = rows.where(~F.col("scanned")).groupBy("key").count().where(F.col("count") > shard).select("key", F.ceil(F.col("count") / shard).cast("int").alias("split"))
    # at most 2 words / shard keys are hot: a few thousand rows for a hundred million words
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("split", F.coalesce("split", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), "split").cast("int")
    rows = rows.withColumn("part", F.explode(F.when(F.col("scanned"), F.sequence(F.lit(0), F.col("split") - 1)).otherwise(F.array(own))))
    number = F.when(F.col("split") == 1, F.pmod("key", F.lit(shards))).otherwise(F.xxhash64("key", "part").bitwiseOR(F.lit(1 << 62)))
    return rows.select(number.alias("shard"), "scanned", "word", "n", "left")


class Shard:
    """The halves of a shard's words: hits of other words on them, and the verified pairs."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.n: list[int] = []
        self.sides: list[tuple[bool, bool]] = []
        self.automaton: ahocorasick.Automaton | None = None

    def add(self, word: str, n: int, left: bool, right: bool) -> None:
        self.words.append(word)
        self.n.append(n)
        self.sides.append((left, right))

    def close(self) -> None:
        """Builds the automaton; owners of a half are a range of `owner`, sorted by (half, side, length)."""
        halves: list[tuple[str, int, int, int]] = []
        for i, (word, sides) in enumerate(zip(self.words, self.sides, strict=True)):
            middle = len(word) // 2
            halves += [((word[:middle], word[middle:])[side], side, len(word), i) for side in (0, 1) if sides[side]]
        halves.sort()
        self.owner = np.array([h[3] for h in halves], np.int64)
        self.codes, self.start, self.size = _codes(self.words)
        self.count = np.array(self.n, np.int64)
        self.place = np.empty(len(self.words), np.int64)  # in code-point order
        self.place[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        self.ranges: list[dict[tuple[int, int], tuple[int, int]]] = []
        self.automaton = ahocorasick.Automaton()
        for i, (half, side, size, _) in enumerate(halves):
            if not i or half != halves[i - 1][0]:
                self.automaton.add_word(half, (len(self.ranges), len(half)))
                self.ranges.append({})
            first, _ = self.ranges[-1].get((side, size), (i, i))
            self.ranges[-1][side, size] = (first, i + 1)
        self.automaton.make_automaton()

    def hits(self, text: list[str], start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(scanned word, side, first, end of its owners) where the offset and the lengths allow one edit."""
        joined = "\n".join(text)
        ends = (start + size).tolist()
        starts, sizes = start.tolist(), size.tolist()
        at = 0
        for last, (half, length) in self.automaton.iter(joined):
            while last >= ends[at]:
                at += 1
            sides = [s for s, fits in ((0, last - length + 1 == starts[at]), (1, last + 1 == ends[at])) if fits]
            for side in sides:
                for d in (-1, 0, 1):
                    found = self.ranges[half].get((side, sizes[at] + d))
                    if found:
                        yield at, side, *found

    def near(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scanned word, owner) of all pairs one edit apart, each pair at one of the owner's halves."""
        codes, start, size = _codes(text)
        found = np.array(list(self.hits(text, start + np.arange(len(text)), size)), np.int64).reshape(-1, 4)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for who, side, first, count in _blocks(found):
            t = np.repeat(who, count)
            upto = np.cumsum(count)
            w = self.owner[np.repeat(first - (upto - count), count) + np.arange(int(upto[-1]))]
            on_right = np.repeat(side, count) == 1
            pre = _shared(codes, self.codes, start[t], self.start[w], np.minimum(size[t], self.size[w]), 1)
            post = _shared(codes, self.codes, start[t] + size[t] - 1, self.start[w] + self.size[w] - 1, np.minimum(size[t], self.size[w]), -1)
            longer = np.maximum(size[t], self.size[w])
            same = (size[t] == self.size[w]) & (pre == longer)
            # where the left half stands too, the pair was counted at that half
            ok = ~same & (pre + post >= longer - 1) & ~(on_right & (pre >= self.size[w] // 2))
            a.append(t[ok])
            b.append(w[ok])
        return np.concatenate(a), np.concatenate(b)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words one after the other, and where each begins and how long it is."""
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size


def _shared(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Equal code points of each pair from a[i] and b[j] on, at most `most`."""
    out = np.zeros(len(i), np.int64)
    alive = np.flatnonzero(most > 0)
    k = 0
    while len(alive):
        alive = alive[a[i[alive] + step * k] == b[j[alive] + step * k]]
        k += 1
        out[alive] = k
        alive = alive[most[alive] > k]
    return out


def _blocks(found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(scanned word, side, first owner, owners) in blocks of at most PAIRS pairs."""
    who, side, first, end = found.T
    cuts = -(-(end - first) // PAIRS)  # ranges of more owners than that come in pieces
    piece = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    who, side, first, end = (np.repeat(x, cuts) for x in (who, side, first, end))
    first = first + piece * PAIRS
    count = np.minimum(end - first, PAIRS)
    upto = np.cumsum(count)
    i = 0
    while i < len(who):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right")))
        yield who[i:j], side[i:j], first[i:j], count[i:j]
        i = j


def _best(shard: Shard, scanned: pa.RecordBatch) -> pa.RecordBatch:
    """(word, near words, count and text of the best of them) of the scanned words that have any."""
    text = scanned.column("word").to_pylist()
    a, b = shard.near(text)
    order = np.lexsort((shard.place[b], -shard.count[b], a))
    a, b = a[order], b[order]
    who, first, count = np.unique(a, return_index=True, return_counts=True)
    best = b[first]
    columns = [scanned.column("word").take(pa.array(who)), pa.array(count.astype(np.int64)), pa.array(shard.count[best]), pa.array([shard.words[i] for i in best], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "form_n", "form"])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the words that stream past the halves of their shard."""
    shard, number, closed = Shard(), None, False
    try:
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            scanned = batch.column("scanned").to_numpy(zero_copy_only=False).astype(np.int64)
            change = np.flatnonzero((shards[1:] != shards[:-1]) | (scanned[1:] != scanned[:-1])) + 1
            for i, j in zip([0, *change.tolist()], [*change.tolist(), len(shards)], strict=True):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if shards[i] != number:
                    shard, number, closed = Shard(), shards[i], False
                if not scanned[i]:
                    for row in part.select(["word", "n", "left", "right"]).to_pylist():
                        shard.add(**row)
                    continue
                if not shard.words:
                    continue
                if not closed:
                    shard.close()
                    closed = True
                yield _best(shard, part)
    finally:
        give_back()


def group_spellings(docs: DataFrame, least_length: int = 6, least: int = 5, ratio: int = 5, one_in: int = 199, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n)."""
    if least_length < 2 * ENDS or ratio <= 1:
        raise ValueError(f"words have {2 * ENDS} code points at least, and a form more occurrences than its word")
    spark = docs.sparkSession
    bounded_batches(spark)
    words = checkpointed(counted_words(docs, least_length, least, one_in, id_col, text_col))
    shards = max(1, -(-2 * words.count() // shard))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), shards)
    rows = dealt(words, shards, shard).repartition(parts, "shard").groupBy("shard", "scanned", "word", "n")
    rows = rows.agg(F.coalesce(F.bool_or("left"), F.lit(False)).alias("left"), F.coalesce(F.bool_or(~F.col("left")), F.lit(False)).alias("right"))
    rows = rows.sortWithinPartitions("shard", "scanned", "word")
    found = rows.mapInArrow(scan, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    larger = -F.col("best.less") >= ratio * F.col("n")
    forms = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(larger, F.col("best.form")).alias("form"), F.when(larger, -F.col("best.less")).alias("form_n"),
    )
    forms = checkpointed(forms)
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # counts grow by `ratio` with each form, so this ends after the logarithm of a logarithm of the largest
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpointed(roots.join(further, "root", "left").select("word", "root", "next"))
        roots = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where("next is not null").isEmpty():
            break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
