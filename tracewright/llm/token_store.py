"""Operator 6: token ids in binary files of directly addressable codes.

An id is cut into chunks of 8 bits.  Level 0 holds every id's lowest chunk,
level 1 the next chunk of those ids that go on, and so forth; a bitmap per level
says which entries go on, and its rank directory (a count per 512 bits and one
per 64 bits within them) gives the place in the next level.  Any token is read
with one step per level, without decoding a block.

Rows are dealt out in ranges of the id and sorted there, so files follow the id
order; every task writes its files under a temporary name and renames them, so
a task that is run again replaces its own files.  Starts are summed over the
files' totals (one small row per file).

Defined cases: a null text has only the end id; rows without an id come last;
rows that share an id are ordered by a hash of their text and each kept; an
empty table writes no file and reads as no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe_codec import WordCodec
from .common import GROUP_BYTES, GROUP_ROWS, bounded_batches, checkpointed, partitions_for, scratch_path, text_groups, tidy

MAGIC = b"TWDAC01\n"
FILE_TOKENS = 8 << 20


class LibraryCodec(WordCodec):
    """Words that are not known yet are encoded by the tokenizers library, all of a group in one call."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True  # their strings were cut out before lower-casing

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(units), 50_000):
            part = units[i : i + 50_000]
            coded = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            out.append(np.array(coded.ids, np.uint32))
            sizes.append(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part)) if coded.word_ids else np.zeros(len(part), np.int64))
        return np.concatenate(out), np.concatenate(sizes)


@lru_cache(2)
def codec_for(path: str) -> LibraryCodec:
    """One codec per worker process: its memo serves all tasks that the process runs."""
    return LibraryCodec(path)


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of an array of unsigned 32-bit ids."""
    values, levels = ids.astype(np.uint32), []
    while True:
        more = values > 255
        padded = np.zeros(-(-len(values) // 512) * 512, bool)
        padded[: len(values)] = more
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(words).astype(np.int64).reshape(-1, 8)
        within = (np.cumsum(ones, 1) - ones).astype(np.uint16)
        before = np.cumsum(ones.sum(1)) - ones.sum(1)
        levels.append(struct.pack("<QQ", len(values), len(words)) + words.tobytes() + before.astype(np.uint64).tobytes() + within.tobytes() + (values & 255).astype(np.uint8).tobytes())
        if not more.any():
            return struct.pack("<Q", len(levels)) + b"".join(levels)
        values = values[more] >> 8


class Codes:
    """Random access to packed ids."""

    def __init__(self, blob: bytes, at: int = 0):
        (n,) = struct.unpack_from("<Q", blob, at)
        at += 8
        self.levels = []
        for _ in range(n):
            size, words = struct.unpack_from("<QQ", blob, at)
            at += 16
            bits = np.frombuffer(blob, np.uint64, words, at)
            at += 8 * words
            before = np.frombuffer(blob, np.uint64, words // 8, at)
            at += words
            within = np.frombuffer(blob, np.uint16, words, at)
            at += 2 * words
            self.levels.append((bits, before, within, np.frombuffer(blob, np.uint8, size, at)))
            at += size
        self.end = at

    def __len__(self) -> int:
        return len(self.levels[0][3])

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        out = np.zeros(len(places), np.uint32)
        which, at = np.arange(len(places)), np.asarray(places, np.int64)
        for level, (bits, before, within, chunk) in enumerate(self.levels):
            out[which] |= chunk[at].astype(np.uint32) << np.uint32(8 * level)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            on = (word >> bit) & np.uint64(1) == 1
            at, word, bit, which = at[on], word[on], bit[on], which[on]
            if not len(at):
                break
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            at = before[at >> 9].astype(np.int64) + within[at >> 6] + lower
        return out

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids of consecutive places: one directory look-up per level, whatever came before."""
        out, where = np.zeros(end - start, np.uint32), None
        for level, (bits, before, within, chunk) in enumerate(self.levels):
            part = chunk[start:end].astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= part
            else:
                out[where] |= part
            w = start >> 6
            on = np.unpackbits(bits[w : -(-end // 64)].view(np.uint8), bitorder="little")[start - 64 * w :][: end - start].view(bool)
            if not on.any():
                break
            lower = np.bitwise_count(bits[w] & ((np.uint64(1) << np.uint64(start & 63)) - np.uint64(1)))
            start = int(before[start >> 9]) + int(within[w]) + int(lower)
            end = start + int(on.sum())
            where = np.flatnonzero(on) if where is None else where[on]
        return out


def file_bytes(ids: list, tokens: np.ndarray, offsets: np.ndarray) -> bytes:
    """A file: document ids (with a flag for null), their offsets, and the packed tokens."""
    known = np.array([i is not None for i in ids], np.uint8)
    numbers = np.array([i or 0 for i in ids], "<i8")
    return MAGIC + struct.pack("<Q", len(ids)) + known.tobytes() + numbers.tobytes() + offsets.astype("<u8").tobytes() + pack(tokens)


class TokenFile:
    """Reads one file; `document(i)` and `codes.get(places)` touch only what they need."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack_from("<Q", blob, 8)
        known = np.frombuffer(blob, np.uint8, n, 16)
        numbers = np.frombuffer(blob, "<i8", n, 16 + n)
        self.ids = [int(i) if k else None for i, k in zip(numbers, known, strict=True)]
        self.offsets = np.frombuffer(blob, "<u8", n + 1, 16 + 9 * n).astype(np.int64)
        self.codes = Codes(blob, 24 + 17 * n)

    def document(self, i: int) -> np.ndarray:
        return self.codes.span(int(self.offsets[i]), int(self.offsets[i + 1]))


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes; returns the files as (file, shard, n_docs, n_tokens), written once."""
    bounded_batches(docs.sparkSession, GROUP_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task = codec_for(tokenizer), TaskContext.get()
        store, folder = _store(path)
        ids: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held, serial = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, parts, sizes, held, serial
            name = f"{folder}/{task.partitionId():08d}-{serial:06d}.dac"
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}") as f:
                f.write(file_bytes(ids, np.concatenate(parts), offsets))
            store.move(f"{name}.{task.taskAttemptId()}", name)
            row = pa.RecordBatch.from_pydict({"file": [name], "shard": [task.partitionId() << 24 | serial], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])]})
            ids, parts, sizes, held, serial = [], [], [], 0, serial + 1
            return row

        for batch in batches:
            text = batch.column(1).fill_null("")
            for start, stop in text_groups(text, GROUP_BYTES):
                flat, size = codec.encode_flat(text.slice(start, stop - start).to_pylist())
                ids += batch.column(0).slice(start, stop - start).to_pylist()
                parts.append(np.insert(flat, np.cumsum(size), end_id))
                sizes.append(size + 1)
                held += len(parts[-1])
                if held >= FILE_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = F.col("id").asc_nulls_last()
    rows = rows.repartitionByRange(partitions_for(docs, 24), order).sortWithinPartitions(order, F.xxhash64("text"))
    return checkpointed(rows.mapInArrow(tidy(run), "file string, shard long, n_docs long, n_tokens long"))


def read_tokens(spark: SparkSession, files: DataFrame, path: str, id_col: str = "doc_id", checks: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids array<long>) from the files; with `checks` ids_crc32 instead of the ids."""
    total = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    begun = files.select("file", "shard", total.alias("start"))  # one row per file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(name) as f:
                    file = TokenFile(f.read())
                for a in range(0, len(file.ids), 1000):
                    b = min(a + 1000, len(file.ids))
                    offsets = file.offsets[a : b + 1]
                    tokens = file.codes.span(int(offsets[0]), int(offsets[-1])).astype("<u4")
                    cut = (offsets - offsets[0]).tolist()
                    if checks:
                        blob = tokens.tobytes()
                        last = pa.array([zlib.crc32(blob[4 * i : 4 * j]) for i, j in zip(cut, cut[1:], strict=False)], pa.int64())
                    else:
                        last = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(tokens.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(file.ids[a:b], pa.int64()), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), last], ["id", "start", "n_tokens", "last"])

    n = max(1, files.count())
    kind = "long" if checks else "array<long>"
    out = begun.repartition(n, "file").select("file", "start").mapInArrow(tidy(run), f"id long, start long, n_tokens long, last {kind}")
    return out.withColumnsRenamed({"id": id_col, "last": "ids_crc32" if checks else "ids"})


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_files: bool = False) -> DataFrame:
    """Writes the token files below the shared folder and reads them back.

    The rows read are written as a table of their own, after which the files go, with those
    that failed tries left; `keep_files` leaves them.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    found = read_tokens(spark, write_tokens(docs, tokenizer, path, end_id, id_col, text_col), path, id_col, checks=True)
    if keep_files:
        return found
    found = checkpointed(found)
    store, folder = _store(path)
    store.delete_dir(folder)
    return found
