"""Operator 3: token counts by rank-synchronous array merging.

Texts are cut at spaces into units whose tokens do not depend on their
neighbours; a batch's unknown units are cut into pre-tokens, all pre-tokens are
merged together on ragged arrays (`bpe_core`), and the surviving symbols are
counted.  Known units come from a bounded memo.  One narrow pass: no shuffle,
any row order, a lost task is just run again.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null id stays
null; repeated rows each give a row; other columns of the input are not read.
A special token's string inside a text is that one token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .bpe_core import Characters, Vocabulary, WordTable
from .common import GROUP_BYTES, GROUP_ROWS, bounded_batches, text_groups, tidy

#: The pre-token pattern of the byte-level tokenizer.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class TokenCounter:
    """Counts the tokens of texts as the library does for a byte-level `.json` file."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PRE_TOKENS)
        special = sorted(self.vocabulary.added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = special
        self.spaced = WordTable(lambda units: self._count([self.pattern.findall(" " + u) for u in units]))
        self.plain = WordTable(lambda words: self._count([[w] for w in words]))
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.characters = Characters(self.exact, self.pattern)

    def _count(self, units: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each unit, ones), a unit given as its pre-tokens."""
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(units), 50_000):
            part = units[i : i + 50_000]
            counts = self.vocabulary.merge(*self.vocabulary.symbols([p.encode() for unit in part for p in unit]))
            ends = np.concatenate(([0], np.cumsum([len(unit) for unit in part])))
            out.append(np.diff(np.concatenate(([0], np.cumsum(counts)))[ends]))
        return np.concatenate(out), np.ones(len(units), np.int64)

    def count(self, texts: list[str]) -> list[int]:
        find = self.pattern.findall
        n = len(texts)
        total = np.zeros(n, np.int64)
        easy, slow, owner = [], [], []  # texts to cut at blanks; pre-tokens of the others and whose they are
        for i, text in enumerate(texts):
            if not self.characters.agreed(text):
                total[i] = len(self.exact.encode(text, add_special_tokens=False).ids)
                continue
            parts = [text]
            if self.special and any(m in text for m in self.marks):
                parts = self.special.split(text)
                total[i] += len(parts) - 1
            if len(parts) == 1 and not ("  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or ODD_SPACE.search(text)):
                first, blank, rest = text.partition(" ")
                if blank:
                    easy.append((i, rest))
                parts = [first]
            for part in parts:
                found = find(part) if part else []
                slow += found
                owner += [i] * len(found)
        if easy:
            rows = pc.split_pattern(pa.array([rest for _, rest in easy], pa.large_string()), " ")
            units = rows.flatten().dictionary_encode()
            size = self.spaced.look_up(units.dictionary)[0].astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(size[units.indices.to_numpy()])))
            total[[i for i, _ in easy]] += np.diff(upto[rows.offsets.to_numpy() - rows.offsets[0].as_py()])
        if slow:
            words = pa.array(slow, pa.large_string()).dictionary_encode()
            size = self.plain.look_up(words.dictionary)[0].astype(np.int64)
            np.add.at(total, owner, size[words.indices.to_numpy()])
        return total.tolist()


@lru_cache(2)
def counter_for(path: str) -> TokenCounter:
    """One counter per worker process: its memo serves all tasks that the process runs."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Adds byte and token counts: (id, n_bytes, n_tokens, over_limit)."""
    bounded_batches(docs.sparkSession, GROUP_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(tokenizer)
        for batch in batches:
            text = batch.column(1).fill_null("")
            n_tokens: list[int] = []
            for start, end in text_groups(text, GROUP_BYTES):
                n_tokens += counter.count(text.slice(start, end - start).to_pylist())
            tokens = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(text).cast(pa.int64()), tokens, pc.greater(tokens, limit)],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(tidy(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
