"""Operator 5: language identification with string kernels.

Two texts compare by the byte n-grams of lengths 1 to 3 that both hold (a
blended-spectrum presence kernel, normalised; n-grams are hashed into a fixed
number of dimensions).  Nyström landmarks turn the kernel into vectors, a kernel
ridge regression is solved for each language against the rest, and since the
kernel is linear in the presence vectors, landmarks, Nyström map and weights
fold into one matrix: whole texts are scored by batched matrix products.

Fitting uses a bounded sample (`sample` rows at most, `per_label` of each label,
chosen by hash, so the choice does not depend on partitioning); scoring is one
narrow pass over all rows.

A text is `familiar` if at least `KNOWN` of its n-grams occur in the sample's
texts: one in another script, or of random letters, is not, whatever language
its few known n-grams resemble most.

Defined cases: `und` with score 0 where the text is null or holds no letter, and
everywhere if nothing can be learned (then any text with a letter is familiar);
a row without an id is neither held out
nor learned from; ties go to the smaller label; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, tidy, utf8

DIMENSIONS = 1 << 15
LENGTHS = (1, 2, 3)
ROWS = 64
CHUNK = 1 << 20
SALTS = 64
UNKNOWN = "und"
KNOWN = 0.5


def presence(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 matrix: which hashed n-grams each row's bytes hold."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.uint8)
    flat = out.reshape(-1)
    for start in range(0, len(raw), CHUNK):
        part = raw[start : start + CHUNK + max(LENGTHS) - 1].astype(np.uint32)
        at = np.arange(start, start + min(CHUNK, len(raw) - start))
        row = np.searchsorted(offsets, at, "right") - 1
        left = offsets[row + 1] - at
        gram = np.zeros(len(at), np.uint32)
        for k in range(max(LENGTHS)):
            tail = part[k : k + len(at)]
            gram[: len(tail)] = gram[: len(tail)] << np.uint32(8) | tail
            if k + 1 in LENGTHS:
                slot = ((gram + np.uint32(k * 0x01000193)) * np.uint32(0x9E3779B1)) >> np.uint32(17)
                ok = left > k
                flat[row[ok] * DIMENSIONS + slot[ok]] = 1
    return out


def text_presence(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Presence matrices of consecutive row ranges of a text column, case folded."""
    raw, offsets = utf8(pc.utf8_lower(text))
    for start in range(0, len(text), ROWS):
        end = min(len(text), start + ROWS)
        part = offsets[start : end + 1]
        yield start, end, presence(raw[part[0] : part[-1]], part - part[0])


class LanguageModel:
    """Fits on presence vectors and labels; keeps one matrix of (dimensions x labels)."""

    def __init__(self, vectors: np.ndarray, labels: list[str], landmarks: int = 160, ridge: float = 0.1):
        self.labels = sorted(set(labels))

        def scaled(rows: np.ndarray) -> np.ndarray:
            return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True, dtype=np.float32), 1))

        marks = scaled(vectors[:landmarks])
        kernel = np.concatenate([scaled(vectors[i : i + 128]) @ marks.T for i in range(0, len(vectors), 128)]).astype(np.float64)
        values, basis = np.linalg.eigh(kernel[: len(marks)])
        keep = values > 1e-6 * values[-1]
        nystrom = basis[:, keep] / np.sqrt(values[keep])
        z = np.hstack([kernel @ nystrom, np.ones((len(kernel), 1))])
        y = np.where(np.array(labels)[:, None] == np.array(self.labels)[None, :], 1.0, -1.0)
        size = y.shape[0] / (len(self.labels) * np.maximum((y > 0).sum(0), 1))
        weight = (y > 0) @ size  # every label counts alike
        damp = ridge * np.eye(z.shape[1])
        damp[-1, -1] = 1e-9
        a = np.linalg.solve((z * weight[:, None]).T @ z + damp, (z * weight[:, None]).T @ y)
        self.matrix = (marks.T @ (nystrom @ a[:-1])).astype(np.float32)
        self.bias = a[-1].astype(np.float32)
        self.known = vectors.any(0).astype(np.float32)

    def score(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best label, its share, and whether it is familiar, of each row."""
        x = vectors.astype(np.float32)
        s = (x @ self.matrix) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + self.bias
        best = s.argmax(1)
        e = np.exp(4.0 * (s - s.max(1, keepdims=True)).astype(np.float64))
        return best, 1.0 / e.sum(1), x @ self.known >= KNOWN * x.sum(1)


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, per_label: int = 400, sample: int = 4000) -> LanguageModel | None:
    """Learns from at most `sample` labelled rows outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    usable = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col, folds, fold))
    order = F.xxhash64(F.col(id_col).cast("string"))
    ranked = usable.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), order.alias("h"))
    for key in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):  # a label with most of the rows is first thinned in SALTS parts
        ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("h", "id"))).where(F.col("rn") <= per_label)
    chosen = ranked.orderBy("rn", "lang", "h").limit(sample)
    texts = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    texts = texts.join(F.broadcast(chosen.select("id", "lang", "rn", "h")), "id")  # at most `sample` rows

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(row).tobytes() for _, _, m in text_presence(batch.column(3)) for row in m]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bits, pa.binary())], ["lang", "rn", "h", "bits"])

    rows = texts.select("lang", "rn", "h", "text").mapInArrow(tidy(vectors), "lang string, rn int, h long, bits binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.rn, r.lang, r.h, r.bits))
    x = np.unpackbits(np.frombuffer(b"".join(r.bits for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    return LanguageModel(x, [r.lang for r in rows])


def identify_language(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, fold: int = 2, keep: list[str] | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score, familiar) of every row; `keep` names columns to pass through after them."""
    bounded_batches(docs.sparkSession)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score, familiar = np.zeros(len(text), np.int64), np.zeros(len(text)), known.copy()
            if model is not None:
                for start, end, m in text_presence(text.fill_null("")):
                    best[start:end], score[start:end], near = model.score(m)
                    familiar[start:end] &= near
            else:
                known[:] = False
            names = [*(model.labels if model else []), UNKNOWN]
            best[~known], score[~known] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.string()).take(pa.array(best)), pa.array(score), pa.array(familiar), *batch.columns[3:]], ["id", "held_out", "lang_pred", "score", "familiar", *kept])

    kept = [f"k{i}" for i in range(len(keep))]
    kinds = "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), held_out(id_col, folds, fold), F.col(text_col), *[F.col(c) for c in keep])
    out = out.mapInArrow(tidy(run), f"id {kind}, held_out boolean, lang_pred string, score double, familiar boolean{kinds}")
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", "familiar", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
