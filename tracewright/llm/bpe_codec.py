"""Operator 7: BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that stands side by side in no vocabulary token can never be
merged across, so it marks a certain cut.  Words are cut there, the fragments
are encoded independently (distinct fragments of a batch once, together, on
ragged arrays) and the ids are concatenated.  Words come from a bounded memo.
One narrow pass over the rows: no shuffle.

Defined cases: a null text counts as empty (no ids, decoded to the empty
string); a null id stays null; repeated rows each give a row; other columns are
not read.  Texts that hold the string of an added token are cut there first.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .bpe_core import Characters, Vocabulary, WordTable
from .common import GROUP_BYTES, GROUP_ROWS, bounded_batches, pick, text_groups, tidy, utf8

#: The pre-token pattern of the word tokenizer.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that str.split() takes for white space and the pattern's \s doesn't.
CONTROL_SPACE = re.compile(r"[\x1c-\x1f]")
WHITE_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class WordCodec:
    """Encodes and decodes as the library does for the word-end `.json` file."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PRE_TOKENS)
        self.inside = self.vocabulary.inside_pairs()
        self.marks = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, self.marks)) + ")") if self.marks else None
        self.names = pa.array(self.vocabulary.names(), pa.string())
        self.words = WordTable(self._encode_units)
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.characters = Characters(self.exact, self.pattern)

    @staticmethod
    def normalize(text: str) -> str:
        """NFC and lower case, one character at a time (no final-sigma rule)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def fragments(self, words: list[bytes]) -> tuple[list[tuple[bytes, bool]], list[int]]:
        """Cuts words at forced boundaries: (fragment, is the word's end), and the fragments of each word."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 1:
            cut[1:-1] = ~self.inside[raw[:-1], raw[1:]]
        cut[ends] = True
        at = np.flatnonzero(cut)
        start = np.concatenate(([0], at[:-1]))
        blob = raw.tobytes()
        last = np.zeros(len(raw) + 1, bool)
        last[ends] = True
        parts = [(blob[a:b], c) for a, b, c in zip(start.tolist(), at.tolist(), last[at].tolist(), strict=True)]
        upto = np.searchsorted(at, ends, "right")
        return parts, np.diff(np.concatenate(([0], upto))).tolist()

    def _encode_fragments(self, parts: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        v = self.vocabulary
        lengths = np.fromiter((len(p) for p, _ in parts), np.int64, len(parts))
        raw = np.frombuffer(b"".join(p for p, _ in parts), np.uint8)
        flat = v.first[raw]
        final = np.fromiter((c for _, c in parts), bool, len(parts))
        ends = (np.cumsum(lengths) - 1)[final]
        flat[ends] = v.last[raw[ends]]
        return v.merge(flat, lengths, want_ids=True)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit) by forced-boundary splitting."""
        out, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(units), 50_000):
            found = [[w.encode() for w in self.pattern.findall(u)] for u in units[i : i + 50_000]]
            words = [w for ws in found for w in ws]
            upto = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
            if not words:
                sizes.append(np.diff(upto))
                continue
            parts, each = self.fragments(words)
            order = {p: k for k, p in enumerate(dict.fromkeys(parts))}
            ids, counts = self._encode_fragments(list(order))
            which = np.fromiter(map(order.__getitem__, parts), np.int64, len(parts))
            out.append(pick(ids, (np.cumsum(counts) - counts)[which], counts[which]).astype(np.uint32))
            ends = np.concatenate(([0], np.cumsum(counts[which])))[np.concatenate(([0], np.cumsum(each)))]
            sizes.append(np.diff(ends[upto]))
        return np.concatenate(out), np.concatenate(sizes)

    def _one(self, text: str) -> np.ndarray:
        """The ids of a text that cannot go with the others: it holds added tokens, odd characters or odd spaces."""
        if not self.characters.agreed(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        if any(m in text for m in self.marks):
            parts = self.added.split(text)
            rest = [self.encode_flat([p])[0] for p in parts[::2]]
            between = [np.array([self.vocabulary.added[m]], np.uint32) for m in parts[1::2]]
            return np.concatenate([x for pair in zip(rest, [*between, rest[0][:0]], strict=True) for x in pair])
        units = pa.array([u for u in WHITE_SPACE.split(self.normalize(text)) if u], pa.large_string()).dictionary_encode()
        ids, size = self.words.look_up(units.dictionary)
        at = units.indices.to_numpy()
        return pick(ids, (np.cumsum(size) - size)[at], size[at])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, flat, and the number of ids of each; distinct words are looked up once."""
        plain, apart = [self.normalize(text) for text in texts], {}
        for i, text in enumerate(texts):
            if not self.characters.agreed(text) or any(m in text for m in self.marks) or CONTROL_SPACE.search(text):
                plain[i], apart[i] = "", self._one(text)
        rows = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
        units = rows.flatten().dictionary_encode()
        ids, size = self.words.look_up(units.dictionary)
        at = units.indices.to_numpy()
        each = size[at]
        ids = pick(ids, (np.cumsum(size) - size)[at], each)
        upto = np.concatenate(([0], np.cumsum(each)))[rows.offsets.to_numpy() - rows.offsets[0].as_py()]
        if not apart:
            return ids, np.diff(upto)
        out, a = [], 0
        for i, code in apart.items():
            out += [ids[upto[a] : upto[i]], code]
            a = i + 1
        count = np.diff(upto)
        count[list(apart)] = [len(code) for code in apart.values()]
        return np.concatenate([*out, ids[upto[a] :]]), count

    def decode_flat(self, ids: np.ndarray, size: np.ndarray) -> pa.Array:
        """The token texts of each row, joined by blanks: the file names no decoder."""
        offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.names.take(pa.array(ids))), " ")


@lru_cache(2)
def codec_for(path: str) -> WordCodec:
    """One codec per worker process: its memo serves all tasks that the process runs."""
    return WordCodec(path)


def _digests(blob: np.ndarray | memoryview, ends: np.ndarray) -> pa.Array:
    """SHA-256 of each row of bytes."""
    at = ends.tolist()
    return pa.array([hashlib.sha256(blob[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids array<int>, decoded string); with `digests` SHA-256 of ids and text instead of the values."""
    bounded_batches(docs.sparkSession, GROUP_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(tokenizer)
        for batch in batches:
            text = batch.column(1).fill_null("")
            for start, end in text_groups(text, GROUP_BYTES // 2):  # ids and decoded texts are held beside them
                flat, size = codec.encode_flat(text.slice(start, end - start).to_pylist())
                plain = codec.decode_flat(flat, size)
                counts = pa.array(size)
                if digests:
                    blob = memoryview(flat.astype("<u4").view(np.uint8))
                    values = [_digests(blob, np.concatenate(([0], np.cumsum(4 * size)))), _digests(*utf8(plain))]
                else:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                    values = [pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))), plain.cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), counts, *values], ["id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kinds = ["string", "string"] if digests else ["array<int>", "string"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}"
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
