"""Operator 9: quality scores by co-training of two views.

One classifier sees the text's content (byte shares, symbols, repeated words),
the other the page's metadata (source, language, stated length); no number goes
into both.  Over several rounds each labels the pool documents that it is surest
of and hands them to the other.  Each is then calibrated on labelled rows that
neither was fitted on, and the calibrated views are combined into one score on
labelled rows that took no part in either.

Fitting takes bounded samples, chosen by hash and so independent of the
partitioning: `per_class` labelled rows of each class, and `pool` rows without
labels for the rounds.  Scoring is one narrow pass over all documents.

Defined cases: a null text is an empty one; nulls in metadata are a value of
their own; rows without an id are scored but not learned from; of several labels
of a document the smallest counts; without labels of both classes every score is
0.5 and everything is kept; missing metadata columns count as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, text_groups, tidy, utf8
from .words import Words

SALTS = 64
SOURCES = 32
LANGS = 16
SURE = 0.97
PARTS = 5  # of the labelled rows one calibrates, one combines, the others fit


def text_view(text: pa.Array) -> np.ndarray:
    """Content of each text: byte shares, case, word statistics."""
    raw, offsets = utf8(text)
    n = len(text)
    size = np.maximum(np.diff(offsets), 1)[:, None]
    row = np.repeat(np.arange(n), np.diff(offsets))
    share = np.bincount(row * 256 + raw, minlength=256 * n).reshape(n, 256) / size
    words = Words(text)
    count = np.diff(words.first)
    order = np.lexsort((words.hash, words.row))
    code, own = words.hash[order], words.row[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(fresh)
    times = np.diff(np.append(first, len(code)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, own[first], times)
    some = np.maximum(count, 1)
    stats = np.stack(
        [
            share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1), share[:, 128:].sum(1),
            share[:, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]].sum(1),
            np.bincount(own[first], minlength=n) / some, most / some,
            np.bincount(words.row, weights=words.end - words.start, minlength=n) / some,
        ], 1,
    )
    return np.hstack([np.sqrt(share), stats]).astype(np.float32)


def _codes(column: pa.Array, size: int) -> np.ndarray:
    kinds = column.dictionary_encode()
    names = [zlib.crc32(v.encode()) % (size - 1) for v in kinds.dictionary.to_pylist()]
    at = np.array([*names, size - 1], np.int64)[kinds.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)]
    return np.eye(size, dtype=np.float32)[at]


def metadata_view(source: pa.Array, lang: pa.Array, chars: pa.Array) -> np.ndarray:
    """Metadata of each page: source, language, stated length."""
    stated = chars.cast(pa.float64()).to_numpy(zero_copy_only=False)
    known = ~np.isnan(stated)
    size = np.log1p(np.maximum(np.where(known, stated, 0), 0))
    numbers = np.stack([size, size**2, known], 1)
    return np.hstack([numbers.astype(np.float32), _codes(source, SOURCES), _codes(lang, LANGS)])


class Logistic:
    """Ridge logistic regression on standardised columns, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12):
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        damp = np.full(z.shape[1], ridge)
        damp[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(damp)
            w += np.linalg.solve(hessian, z.T @ (y - p) - damp * w)
        self.weights = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


def _share(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


class CoTrained:
    """Two views, their calibrations and their combination."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = 4, grow: int = 150):
        part = np.arange(len(y)) % PARTS
        fit, held, last = part > 1, part == 0, part == 1
        own = [([v[fit]], [y[fit]]) for v in views]
        free = np.ones(len(pool[0]), bool)
        for turn in range(rounds + 1):
            self.models = [Logistic(np.concatenate(x), np.concatenate(t)) for x, t in own]
            if turn == rounds or not free.any():
                break
            for k, model in enumerate(self.models):
                p = _share(model.logit(pool[k]))
                for label, sure in ((1.0, p), (0.0, 1 - p)):
                    best = np.flatnonzero(free & (sure >= SURE))
                    best = best[np.argsort(-sure[best], kind="stable")][:grow]
                    own[1 - k][0].append(pool[1 - k][best])
                    own[1 - k][1].append(np.full(len(best), label))
                    free[best] = False
        self.calibrated = [Logistic(m.logit(v[held])[:, None], y[held]) for m, v in zip(self.models, views, strict=True)]
        each = [c.logit(m.logit(v[last])[:, None]) for c, m, v in zip(self.calibrated, self.models, views, strict=True)]
        self.joint = Logistic(np.stack(each, 1), y[last])

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated shares of the text view, the metadata view, and both."""
        each = [c.logit(m.logit(v)[:, None]) for c, m, v in zip(self.calibrated, self.models, views, strict=True)]
        return _share(each[0]), _share(each[1]), _share(self.joint.logit(np.stack(each, 1)))


def _columns(docs: DataFrame, id_col: str, text_col: str) -> list:
    def given(name: str, kind: str):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    return [F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), given("source", "string"), given("lang", "string"), given("n_chars", "double")]


def _views(batch: pa.RecordBatch, start: int, end: int) -> list[np.ndarray]:
    text, source, lang, chars = (batch.column(i).slice(start, end - start) for i in range(1, 5))
    return [text_view(text), metadata_view(source, lang, chars)]


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2000, pool: int = 4000) -> CoTrained | None:
    """Learns from at most 2 x `per_class` labelled and `pool` other rows."""
    bounded_batches(docs.sparkSession)
    order = F.xxhash64(F.col("id").cast("string"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    ranked = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").withColumn("h", order)
    for key in (["y", F.pmod("h", F.lit(SALTS))], ["y"]):
        ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("h", "id"))).where(F.col("rn") <= per_class)
    others = docs.select(F.col(id_col).alias("id")).where("id is not null").join(known, "id", "left_anti").withColumn("h", order).orderBy("h", "id").limit(pool)
    chosen = ranked.select("id", "y", "h").unionByName(others.select("id", F.lit(-1).alias("y"), "h"))
    rows = docs.select(*_columns(docs, id_col, text_col)).join(F.broadcast(chosen), "id")  # at most 2 x per_class + pool rows
    rows = rows.select("id", "text", "source", "lang", "n_chars", "y", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_groups(batch.column(1)):
                views = _views(batch, start, end)
                blobs = [pa.array([r.tobytes() for r in v], pa.binary()) for v in views]
                yield pa.RecordBatch.from_arrays([batch.column(5).slice(start, end - start), batch.column(6).slice(start, end - start), *blobs], ["y", "h", "a", "b"])

    found = sorted(rows.mapInArrow(tidy(run), "y int, h long, a binary, b binary").collect(), key=lambda r: (r.h, r.a))
    labelled, free = [r for r in found if r.y >= 0], [r for r in found if r.y < 0]
    if any(len({r.y for i, r in enumerate(labelled) if i % PARTS in part}) < 2 for part in ((0,), (1,), range(2, PARTS))):
        return None

    def matrices(rows: list, width: tuple[int, int]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(r[c] for r in rows), np.float32).reshape(len(rows), w) for c, w in zip("ab", width, strict=True)]

    width = (len(labelled[0].a) // 4, len(labelled[0].b) // 4)
    return CoTrained(matrices(labelled, width), np.array([float(r.y) for r in labelled]), matrices(free, width))


def score_quality(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, p_text, p_meta, score, kept) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_groups(batch.column(1)):
                half = np.full(end - start, 0.5)
                shares = model.score(_views(batch, start, end)) if model is not None else (half, half, half)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *map(pa.array, shares), pa.array(shares[2] >= least)], ["id", "p_text", "p_meta", "score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(*_columns(docs, id_col, text_col)).mapInArrow(tidy(run), f"id {kind}, p_text double, p_meta double, score double, kept boolean")
    return out.withColumnRenamed("id", id_col)
