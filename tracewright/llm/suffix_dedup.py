"""Operator 2: removal of repeated 100-byte strings with suffix sorting in blocks.

Every 100-byte string has an anchor: the smallest hashed 40-byte string inside
it, the leftmost of equals.  Equal strings have equal anchors at equal offsets,
so strings only need to be compared within an anchor's hash.  Consecutive
strings with one anchor form a run, and a run is one small record
(anchor hash, fingerprint of all its bytes, document, start, length):

1. runs of equal bytes: all but the first are removed as a whole;
2. runs that share an anchor but differ (the edges of a repeat) are sorted as
   suffixes, bucket by bucket, with a difference cover (`suffix_order`), and
   strings that equal one of an earlier start are removed;
3. an anchor with very many different runs (the edge of a passage that
   thousands of documents hold) is resolved string by string, spread over all
   tasks by the hash of the string.

Before each shuffle a task drops its own repeats and keeps the first, and an
anchor with several runs in one piece of text goes to step 3 without being
shuffled, so no anchor, passage or copy gathers in one task.  Records travel as
packed arrays.  Step 2 compares bytes.  A run is named by 64 bits of its anchor
and 64 of its bytes, a string of step 3 by 128 bits of its own.

Defined cases: a null text is empty; texts shorter than 100 bytes stay whole; a
row without an id comes after all others; a cut may go through a character, whose
other bytes count as kept (in `kept_sha256` and the sizes) but cannot stand in
`kept_text`, which leaves them out; ids have to be integers; rows that repeat an id come in the
order of a hash of their text, and rows equal in id and text are one document
whose result each of them gets; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, mix, partitions_for, tidy, tidy_pair, utf8
from .suffix_order import repeated
from .words import _powers

LENGTH = 100
ANCHOR = 40
PIECE = 1 << 18
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
MANY_HERE = 4
MANY = 1000
BLOCK = 1 << 20
RUN = np.dtype([("key", "<u8"), ("code", "<u8"), ("id", "<i8"), ("tag", "<i8"), ("start", "<i8"), ("size", "<i2")])
SPAN = np.dtype([("id", "<i8"), ("tag", "<i8"), ("start", "<i8"), ("size", "<i8")])
DOC = np.dtype([("id", "<i8"), ("tag", "<i8")])
WANT = np.dtype([("id", "<i8"), ("tag", "<i8"), ("start", "<i8"), ("size", "<i2"), ("key", "<u8"), ("many", "?")])
POINT = np.dtype([("key", "<u8"), ("code", "<u8"), ("id", "<i8"), ("tag", "<i8"), ("start", "<i8")])
RUNS, SPANS, WANTS, POINTS, TEXTS, MARKS = range(6)
PACKED = "bucket int, kind int, blob binary"


def _pack(rows: np.ndarray) -> bytes:
    """The columns of a record array one after the other, so that they compress."""
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names)


def _pack_runs(rows: np.ndarray) -> bytes:
    """Runs of few documents: each document once, and small numbers for the rest."""
    own = np.zeros(len(rows), DOC)
    own["id"], own["tag"] = rows["id"], rows["tag"]
    doc, at = np.unique(own, return_inverse=True)
    if len(doc) > 65535 or rows["start"].max() >> 32:
        return b"\0" + _pack(rows)
    head = len(rows).to_bytes(8, "little") + len(doc).to_bytes(8, "little") + doc.tobytes()
    return b"\1" + head + rows["key"].tobytes() + rows["code"].tobytes() + at.astype("<u2").tobytes() + rows["start"].astype("<u4").tobytes() + rows["size"].astype("u1").tobytes()


def _unpack_runs(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\0":
        return _unpack(blob[1:], RUN)
    n, docs = (int.from_bytes(blob[i : i + 8], "little") for i in (1, 9))
    doc = np.frombuffer(blob, DOC, docs, 17)
    out, at = np.zeros(n, RUN), 17 + 16 * docs
    for name, kind in (("key", "<u8"), ("code", "<u8"), ("doc", "<u2"), ("start", "<u4"), ("size", "u1")):
        column = np.frombuffer(blob, kind, n, at)
        at += n * column.itemsize
        if name == "doc":
            out["id"], out["tag"] = doc["id"][column], doc["tag"][column]
        else:
            out[name] = column
    return out


def _unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    n = len(blob) // kind.itemsize
    out, at = np.zeros(n, kind), 0
    for c in kind.names:
        out[c] = np.frombuffer(blob, kind[c], n, at)
        at += n * kind[c].itemsize
    return out


def _frame(batch: pa.RecordBatch) -> bytes:
    """Rows as a compressed Arrow stream: texts of one bucket compress far better together."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unframe(rows: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in rows["blob"].to_pylist()])


def _gather(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[_unpack(b, kind) for b in blobs]])


def _changed(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _document_bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(rows["id"].view(np.uint64) ^ mix(rows["tag"].view(np.uint64))) % np.uint64(buckets)).astype(np.int32)


def _dealt(rows: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    first = np.flatnonzero(_changed(bucket))
    for a, b in zip(first, [*first[1:], len(rows)], strict=True):
        yield int(bucket[a]), kind, (_pack_runs if kind == RUNS else _pack)(rows[a:b])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["bucket", "kind", "blob"])


def _united(spans: np.ndarray) -> np.ndarray:
    """Spans of a document that touch or overlap become one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["tag"], spans["id"]))]
    doc = np.cumsum(_changed(spans["id"], spans["tag"]))
    end = spans["start"] + spans["size"]
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + doc * far) - doc * far  # documents don't mix: each has its own range
    fresh = _changed(doc)
    fresh[1:] |= spans["start"][1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    out = spans[first].copy()
    out["size"] = np.maximum.reduceat(end, first) - out["start"]
    return out


def _hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over the bytes, and the factors to read substrings with."""
    up, down = _powers(1 << max(20, len(raw).bit_length()))
    value = _VALUES[raw]
    value *= up[: len(raw)]
    return np.concatenate(([np.uint64(0)], np.cumsum(value, dtype=np.uint64))), down[: len(raw) + 1]


def find_runs(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a batch's bytes: (row, start in the row, length less one, anchor hash, fingerprint) of the runs."""
    window = LENGTH - ANCHOR + 1
    for base in range(0, max(0, len(raw) - LENGTH + 1), PIECE):
        part = raw[base : base + PIECE + LENGTH - 1]
        n = len(part) - LENGTH + 1
        upto, down = _hashes(part)
        anchor = mix((upto[ANCHOR:] - upto[:-ANCHOR]) * down[: len(part) - ANCHOR + 1])
        low = anchor & ~np.uint64((1 << 22) - 1) | np.arange(len(anchor), dtype=np.uint64)
        span = 1
        while span * 2 <= window:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:n], low[window - span : window - span + n])
        at = (low & np.uint64((1 << 22) - 1)).astype(np.int64)
        place = base + np.arange(n)
        row = np.searchsorted(offsets, [base, base + n], "right") - 1
        ok = np.ones(n, bool)
        for end in offsets[row[0] + 1 : row[1] + 2]:  # no string crosses the end of a document
            ok[max(0, end - LENGTH + 1 - base) : max(0, end - base)] = False
        first = np.zeros(n, bool)
        first[0] = ok[0]
        first[1:] = ok[1:] & (~ok[:-1] | (at[1:] != at[:-1]))
        last = np.zeros(n, bool)
        last[-1] = ok[-1]
        last[:-1] = ok[:-1] & (~ok[1:] | first[1:])
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        row = np.searchsorted(offsets, place[s], "right") - 1
        code = mix((upto[e + LENGTH] - upto[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (at[s] - s).astype(np.uint64))
        yield row, base + s - offsets[row], e - s, anchor[at[s]], code


def split_runs(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts runs by (anchor, bytes, document, start): (runs, is the first of its bytes, number of different runs of the anchor)."""
    runs = runs[np.lexsort((runs["start"], runs["tag"], runs["id"], runs["code"], runs["key"]))]
    fresh = _changed(runs["key"], runs["code"])
    group = np.cumsum(_changed(runs["key"])) - 1
    return runs, fresh, np.bincount(group, weights=fresh)[group] if len(runs) else np.zeros(0)


def _spans(runs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(runs), SPAN)
    for c in ("id", "tag", "start"):
        out[c] = runs[c]
    out["size"] = runs["size"].astype(np.int64) + LENGTH
    return out


def _wants(runs: np.ndarray, many: np.ndarray | bool) -> np.ndarray:
    out = np.zeros(len(runs), WANT)
    for c in ("id", "tag", "start", "size", "key"):
        out[c] = runs[c]
    out["many"] = many
    return out


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, text_out: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256); with `text_out` also kept_text and spans, then the columns named in `keep`."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = keep or []
    buckets = partitions_for(docs, 4)
    tasks = partitions_for(docs, 16)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    body = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("own_id"), key.alias("id"), F.xxhash64(body).alias("tag"), body.alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = utf8(batch.column(2))
            pieces = [np.zeros(0, RUN)]
            for row, start, size, anchor, code in find_runs(raw, offsets):
                runs = np.zeros(len(row), RUN)
                runs["id"], runs["tag"], runs["start"], runs["size"], runs["key"], runs["code"] = ids[row], tags[row], start, size, anchor, code
                pieces.append(runs)
            runs, fresh, unlike = split_runs(np.concatenate(pieces))
            twin = ~_changed(runs["key"], runs["code"], runs["id"], runs["tag"], runs["start"])  # a row that repeats id and text
            gone = _united(_spans(runs[~fresh & ~twin]))
            many = unlike >= MANY_HERE
            wants = _wants(runs[fresh & many], True)
            marks = np.unique(runs["key"][many])
            runs = runs[fresh & ~many]
            out = [*_dealt(runs, (runs["key"] % np.uint64(buckets)).astype(np.int32), RUNS)]
            out += [*_dealt(gone, _document_bucket(gone, buckets), SPANS), *_dealt(wants, _document_bucket(wants, buckets), WANTS)]
            out += [(b, MARKS, x) for b, _, x in _dealt(marks.view([("key", "<u8")]), (marks % np.uint64(buckets)).astype(np.int32), MARKS)]
            yield _batch(out)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {k: [] for k in range(6)}
        for batch in batches:
            bucket, kind, blob = (c.to_pylist() for c in batch.columns)
            through = [x for x in zip(bucket, kind, blob, strict=True) if x[1] in (SPANS, WANTS)]
            if through:
                yield _batch(through)
            for k, x in zip(kind, blob, strict=True):
                if k in (RUNS, MARKS):
                    held[k].append(x)
        runs = np.concatenate([np.zeros(0, RUN), *map(_unpack_runs, held[RUNS])])
        marks = np.unique(np.frombuffer(b"".join(held[MARKS]), np.uint64))
        held.clear()
        runs, fresh, unlike = split_runs(runs)
        twin = ~_changed(runs["key"], runs["code"], runs["id"], runs["tag"], runs["start"]) if len(runs) else np.zeros(0, bool)
        marked = np.isin(runs["key"], marks)
        gone = _united(_spans(runs[~fresh & ~twin]))
        some = fresh & (marked | (unlike > 1))
        wants = _wants(runs[some], marked[some] | (unlike[some] > MANY))
        yield _batch([*_dealt(gone, _document_bucket(gone, buckets), SPANS), *_dealt(wants, _document_bucket(wants, buckets), WANTS)])

    packed = base.select("id", "tag", "text").mapInArrow(tidy(anchors), PACKED)
    first = checkpointed(packed.repartition(tasks, "bucket").mapInArrow(tidy(resolve), PACKED))

    # documents are dealt by the same hash as their records
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros(batch.num_rows, SPAN)
            rows["id"], rows["tag"] = batch["id"].to_numpy(), batch["tag"].to_numpy()
            bucket = _document_bucket(rows, buckets)
            order = np.argsort(bucket, kind="stable")
            batch, bucket = batch.take(pa.array(order)), bucket[order]
            first = np.flatnonzero(_changed(bucket)).tolist()
            yield _batch([(int(bucket[a]), TEXTS, _frame(batch.slice(a, b - a))) for a, b in zip(first, [*first[1:], len(bucket)], strict=False)])

    def fetch(key: tuple, docs_: pa.Table, blobs: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if blobs.num_rows and docs_.num_rows:
            docs_ = _unframe(docs_)
            wants = _gather(blobs["blob"].to_pylist(), WANT)
            raw, offsets = utf8(docs_["text"])
            at = _rows_of(wants, docs_)
            begin = offsets[at] + wants["start"]
            out += _points(raw, begin, wants, buckets)
            near = np.flatnonzero(~wants["many"])
            order = near[np.argsort(wants["key"][near] % np.uint64(buckets), kind="stable")]
            size = wants["size"].astype(np.int64) + LENGTH
            home = (wants["key"][order] % np.uint64(buckets)).astype(np.int32)
            cut = np.flatnonzero(_changed(home)) if len(home) else []  # none where every anchor has many contexts
            for a, b in zip(cut, [*cut[1:], len(home)], strict=False):
                part = order[a:b]
                texts = b"".join(raw[begin[i] : begin[i] + size[i]].tobytes() for i in part)
                out.append((int(home[a]), TEXTS, len(part).to_bytes(8, "little") + _pack(wants[part]) + texts))
        b = _batch(out)
        return pa.Table.from_batches([b])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points: list[bytes] = []
        wants: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        for batch in batches:
            for bucket, kind, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == POINTS:
                    points.append(blob)
                elif kind == TEXTS:
                    n = int.from_bytes(blob[:8], "little")
                    wants.append(_unpack(blob[8 : 8 + n * WANT.itemsize], WANT))
                    texts.append(np.frombuffer(blob, np.uint8, offset=8 + n * WANT.itemsize))
                else:
                    yield _batch([(bucket, kind, blob)])
        p = _gather(points, POINT)
        p = p[np.lexsort((p["start"], p["tag"], p["id"], p["code"], p["key"]))]
        if len(p):
            twin = ~_changed(p["key"], p["code"], p["id"], p["tag"], p["start"])
            gone = _point_spans(p[~_changed(p["key"], p["code"]) & ~twin])
            yield _batch([*_dealt(gone, _document_bucket(gone, buckets), SPANS)])
        if wants:
            for gone in sort_blocks(np.concatenate(wants), np.concatenate(texts)):
                yield _batch([*_dealt(gone, _document_bucket(gone, buckets), SPANS)])

    bare = base.select("id", "tag", "text")
    whole, bare_docs = base.mapInArrow(tidy(place), PACKED), bare.mapInArrow(tidy(place), PACKED)
    asked = first.where(f"kind = {WANTS}")
    strings = bare_docs.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(tidy_pair(fetch), PACKED)
    second = strings.repartition(tasks, "bucket").mapInArrow(tidy(compare), PACKED)
    spans = first.where(f"kind = {SPANS}").unionByName(second)

    def finish(key: tuple, docs_: pa.Table, blobs: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return empty
        docs_ = _unframe(docs_)
        gone = _united(_gather(blobs["blob"].to_pylist(), SPAN))
        raw, offsets = utf8(docs_["text"])
        ids, tags = docs_["id"].to_numpy(), docs_["tag"].to_numpy()
        order = np.lexsort((gone["tag"], gone["id"]))
        gone = gone[order]
        name = gone["id"].astype(object), gone["tag"].astype(object)
        index: dict[tuple[int, int], list[int]] = {}
        for i, k in enumerate(zip(*name, strict=True)):
            index.setdefault(k, []).append(i)
        removed, count, digests, texts, places = [], [], [], [], []
        for r in range(len(ids)):
            own = gone[index.get((int(ids[r]), int(tags[r])), [])]
            text = raw[offsets[r] : offsets[r + 1]]
            left, at = [], 0
            for s, n in zip(own["start"].tolist(), own["size"].tolist(), strict=True):
                left.append(text[at:s])
                at = s + n
            left.append(text[at:])
            blob = b"".join(x.tobytes() for x in left)
            removed.append(len(text) - len(blob))
            count.append(len(own))
            digests.append(hashlib.sha256(blob).hexdigest())
            if text_out:
                texts.append(blob.decode("utf-8", "ignore"))
                places.append([{"start": s, "size": n} for s, n in zip(own["start"].tolist(), own["size"].tolist(), strict=True)])
        columns = [docs_["own_id"], pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digests, pa.string())]
        if text_out:
            columns += [pa.array(texts, pa.string()), pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))]
        columns += [docs_[f"k{i}"] for i in range(len(keep))]
        return pa.table(columns, names=result)

    result = ["own_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text", "spans"] * text_out + [f"k{i}" for i in range(len(keep))]
    empty = pa.table({c: pa.array([], pa.null()) for c in result})
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"own_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string, spans array<struct<start:long,size:long>>" * text_out
    schema += "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = whole.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(tidy_pair(finish), schema)
    return out.withColumnsRenamed({"own_id": id_col, **{f"k{i}": c for i, c in enumerate(keep)}})


def _rows_of(wants: np.ndarray, docs: pa.Table) -> np.ndarray:
    """The row of each record's document."""
    place = {k: i for i, k in enumerate(zip(docs["id"].to_pylist(), docs["tag"].to_pylist(), strict=True))}
    return np.array([place[k] for k in zip(wants["id"].tolist(), wants["tag"].tolist(), strict=True)], np.int64)


def _points(raw: np.ndarray, begin: np.ndarray, wants: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Step 3: the strings of runs of very frequent anchors, as fingerprints; repeats met here are dropped at once."""
    many = np.flatnonzero(wants["many"])
    if not len(many):
        return []
    size = wants["size"][many].astype(np.int64) + 1
    which = np.repeat(many, size)
    step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    at = begin[which] + step
    p = np.zeros(len(which), POINT)
    for c in ("id", "tag"):
        p[c] = wants[c][which]
    p["start"] = wants["start"][which] + step
    for c in range(0, len(raw), PIECE):  # fingerprints in pieces of bounded size
        inside = np.flatnonzero((at >= c) & (at < c + PIECE))
        if len(inside):
            part = raw[c : c + PIECE + LENGTH]
            for name, salt in (("key", 0), ("code", 1)):
                upto, down = _hashes(part ^ np.uint8(0x5A * salt))
                i = at[inside] - c
                whole = (upto[i + LENGTH] - upto[i]) * down[i]
                half = (upto[i + LENGTH // 2] - upto[i]) * down[i]
                p[name][inside] = mix(whole + mix(half) * np.uint64(salt))
    p = p[np.lexsort((p["start"], p["tag"], p["id"], p["code"], p["key"]))]
    fresh = _changed(p["key"], p["code"])
    twin = ~_changed(p["key"], p["code"], p["id"], p["tag"], p["start"])
    gone = _point_spans(p[~fresh & ~twin])
    p = p[fresh]
    return [*_dealt(gone, _document_bucket(gone, buckets), SPANS), *_dealt(p, (p["key"] % np.uint64(buckets)).astype(np.int32), POINTS)]


def _point_spans(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), SPAN)
    for c in ("id", "tag", "start"):
        out[c] = points[c]
    out["size"] = LENGTH
    return _united(out)


def sort_blocks(wants: np.ndarray, text: np.ndarray) -> Iterator[np.ndarray]:
    """Step 2: blocks of whole anchor groups, each sorted as suffixes; yields the spans to remove."""
    size = wants["size"].astype(np.int64) + LENGTH
    begin = np.cumsum(size) - size
    order = np.lexsort((wants["start"], wants["tag"], wants["id"], wants["key"]))
    key = wants["key"][order]
    upto = np.cumsum(size[order])
    cut = 0
    while cut < len(order):
        end = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + BLOCK, "right")))
        end = int(np.searchsorted(key[end - 1 :], key[end - 1], "right")) + end - 1  # the whole group
        rows = order[cut:end]
        block = np.concatenate([text[begin[i] : begin[i] + size[i]] for i in rows])
        number = size[rows] - LENGTH + 1
        where = np.repeat(np.cumsum(size[rows]) - size[rows], number)
        step = np.arange(len(where)) - np.repeat(np.cumsum(number) - number, number)
        owner = np.repeat(rows, number)
        first = np.lexsort((wants["start"][owner] + step, wants["tag"][owner], wants["id"][owner]))
        rank = np.zeros(len(owner), np.int64)
        rank[first] = np.arange(len(owner))
        again = repeated(block, where + step, rank, LENGTH)
        gone = np.zeros(int(again.sum()), SPAN)
        gone["id"], gone["tag"], gone["start"], gone["size"] = wants["id"][owner[again]], wants["tag"][owner[again]], (wants["start"][owner] + step)[again], LENGTH
        yield _united(gone)
        cut = end
