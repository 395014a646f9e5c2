"""Operators against brute force, libraries and exact round trips on small whole tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewright.llm import bpe_core, quality, queries
from tracewright.llm.bpe_codec import WordCodec
from tracewright.llm.bpe_core import WordTable
from tracewright.llm.components import connected_components, label_components
from tracewright.llm.decontamination import drop_contaminated, find_contamination, tiles
from tracewright.llm.jaccard_join import runs_for, survival
from tracewright.llm.language_id import LanguageModel, text_presence
from tracewright.llm.quality import fit_quality, score_quality
from tracewright.llm.suffix_order import repeated
from tracewright.llm.token_counts import TokenCounter
from tracewright.llm.token_store import Codes, LibraryCodec, pack

Q = queries.queries()
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile("[0-9a-z\x80-\U0010ffff]+")


@pytest.fixture(scope="module")
def texts(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(sorted(zip(t["doc_id"], t["text"], strict=True)))


def test_sql_and_license_scan_agree(spark, sf_dir):
    from comparing import duck, rows_of

    df = Q["op8_license_scan"](spark, sf_dir)
    want = duck(sf_dir).execute(queries.oracle_sql()["op8_license_scan"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in want.description], want.fetchall())


def test_suffix_dedup(spark, sf_dir, texts):
    got = {r.doc_id: r for r in Q["op2_suffix_dedup"](spark, sf_dir).collect()}
    seen = set()
    for i, text in texts.items():
        b = text.encode()
        gone = np.zeros(len(b) + 2, np.int8)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p + 1 : p + 101] = 1
            seen.add(s)
        kept = np.frombuffer(b, np.uint8)[gone[1:-1] == 0].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest())


def test_token_counts(spark, sf_dir, texts):
    library = Tokenizer.from_file(BYTE)
    for r in Q["op3_token_counts"](spark, sf_dir).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_codec(spark, sf_dir, texts):
    library = Tokenizer.from_file(WORD)
    for r in Q["op7_bpe_codec"](spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())


def test_token_files(spark, sf_dir, texts):
    library, start = Tokenizer.from_file(WORD), 0
    got = {r.doc_id: r for r in Q["op6_token_store"](spark, sf_dir).collect()}
    for i, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_language(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"]).to_pydict()
    lang = dict(zip(t["doc_id"], t["lang"], strict=True))
    held = [r for r in Q["op5_language_id"](spark, sf_dir).collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def naive_slots(text):
    """Slots of the distinct byte 1- to 3-grams of a text."""
    b = text.lower().encode()
    out = set()
    for k in (1, 2, 3):
        for i in range(len(b) - k + 1):
            out.add((int.from_bytes(b[i : i + k], "big") + (k - 1) * 0x01000193) * 0x9E3779B1 % 2**32 >> 17)
    return out


def test_presence_is_that_of_the_grams(texts):
    some = [x[:3000] for x in list(texts.values())[:150]] + ["", "a", "ß"]
    rows = [set(np.flatnonzero(r).tolist()) for _, _, m in text_presence(pa.array(some)) for r in m]
    assert rows == [naive_slots(x) for x in some]


def test_language_model_is_kernel_ridge_regression_on_landmarks(texts, sf_dir):
    lang = dict(zip(*[pq.read_table(f"{sf_dir}/documents.parquet", columns=[c])[c].to_pylist() for c in ("doc_id", "lang")], strict=True))
    ids = [i for i in texts if lang[i] is not None][:90]
    x = np.concatenate([m for _, _, m in text_presence(pa.array([texts[i][:2000] for i in ids]))])
    model = LanguageModel(x[:60], [lang[i] for i in ids[:60]], landmarks=25, ridge=0.1)
    grams = [naive_slots(texts[i][:2000]) for i in ids]

    def kernel(a, b):
        return np.array([[len(p & q) / np.sqrt(len(p) * len(q)) for q in b] for p in a])

    # the same minimum, found in the span of the landmarks: f = K(x, marks) c + bias
    marks, y = grams[:25], np.array([[1.0 if lang[i] == name else -1.0 for name in model.labels] for i in ids[:60]])
    weight = np.array([60 / (len(model.labels) * sum(lang[j] == lang[i] for j in ids[:60])) for i in ids[:60]])
    k, g = kernel(grams[:60], marks), kernel(marks, marks)
    a = np.hstack([k, np.ones((60, 1))])
    damp = np.zeros((26, 26))
    damp[:25, :25] = 0.1 * g
    damp[25, 25] = 1e-9
    c = np.linalg.lstsq((a * weight[:, None]).T @ a + damp, (a * weight[:, None]).T @ y, rcond=None)[0]
    want = np.hstack([kernel(grams[60:], marks), np.ones((30, 1))]) @ c
    best, share, _ = model.score(x[60:])
    e = np.exp(4 * (want - want.max(1, keepdims=True)))
    assert best.tolist() == want.argmax(1).tolist() and np.allclose(share, 1 / e.sum(1), atol=1e-3)


def naive_text_view(text):
    b, words = text.encode(), WORDS.findall(text.lower())
    n, w = max(1, len(b)), max(1, len(words))
    count = collections.Counter(b)
    some = lambda keep: sum(v for c, v in count.items() if keep(c)) / n
    times = collections.Counter(words)
    marks = some(lambda c: 32 < c < 127 and not chr(c).isalnum())
    stats = [some(lambda c: 65 <= c < 91), some(lambda c: 97 <= c < 123), some(lambda c: 48 <= c < 58), some(lambda c: c > 127), marks, len(times) / w, max(times.values(), default=0) / w, sum(len(x.encode()) for x in words) / w]
    return [*[(count[c] / n) ** 0.5 for c in range(256)], *stats]


def test_text_view(texts):
    some = ["", "a a b", "É é 12"] + list(texts.values())[:40]
    assert np.allclose(quality.text_view(pa.array(some)), [naive_text_view(x) for x in some], atol=1e-5)


def test_views_share_nothing():
    # the metadata view is not given the text, and the text view says nothing of its length
    one, many = "ab cd! ", "ab cd! ab cd! "
    view = quality.text_view(pa.array([one, many]))
    assert np.allclose(view[0, :256], view[1, :256])
    meta = quality.metadata_view(pa.array(["a", None]), pa.array([None, "en"]), pa.array([3.0, None]))
    assert meta.shape == (2, 3 + quality.SOURCES + quality.LANGS) and (meta[:, 3:].sum(1) == 2).all()


def test_logistic_is_at_its_minimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 6)) * [1, 5, 0.1, 1, 1, 1] + 3
    y = (x[:, 0] + rng.standard_normal(300) > 3).astype(float)
    model = quality.Logistic(x, y)
    z = (x - model.mean) / model.scale
    p = 1 / (1 + np.exp(-model.logit(x)))
    assert np.allclose(z.T @ (y - p), model.weights[:-1], atol=1e-6) and abs((y - p).sum()) < 1e-4


def test_quality(spark, sf_dir):
    """Accuracy on labelled rows that took no part in fitting."""
    t = pq.read_table(f"{sf_dir}/labels.parquet").to_pydict()
    label = {i: q for i, q in zip(t["doc_id"], t["quality"], strict=True) if q is not None}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in score_quality(docs, fit_quality(docs, labels.where("doc_id % 3 > 0"))).collect()}
    held = [i for i in label if i % 3 == 0]
    assert len(held) > 30 and np.mean([got[i].kept == (label[i] == 1) for i in held]) > 0.9
    got = {r.doc_id: r for r in Q["op9_quality"](spark, sf_dir).collect()}
    assert np.mean([got[i].kept == (q == 1) for i, q in label.items()]) > 0.95


def test_co_training_by_hand():
    """The rounds, calibration and combination written out on plain lists."""
    rng = np.random.default_rng(4)
    y = (np.arange(200) % 2).astype(float)
    views = [rng.standard_normal((200, 3)) + y[:, None] * 1.5, rng.standard_normal((200, 2)) + y[:, None]]
    free = (np.arange(300) % 2).astype(float)
    pool = [rng.standard_normal((300, 3)) + free[:, None] * 1.5, rng.standard_normal((300, 2)) + free[:, None]]
    model = quality.CoTrained(views, y, pool, rounds=2, grow=20)
    rows = [k for k in range(200) if k % 5 > 1]
    own = [([v[k] for k in rows], [y[k] for k in rows]) for v in views]
    taken = set()
    for turn in range(3):
        fitted = [quality.Logistic(np.array(x), np.array(t)) for x, t in own]
        for k in (0, 1) if turn < 2 else ():
            p = 1 / (1 + np.exp(-fitted[k].logit(pool[k])))
            for want in (1.0, 0.0):
                sure = p if want else 1 - p
                best = sorted((i for i in range(300) if i not in taken and sure[i] >= quality.SURE), key=lambda i: (-sure[i], i))[:20]
                taken |= set(best)
                own[1 - k][0].extend(pool[1 - k][i] for i in best)
                own[1 - k][1].extend([want] * len(best))
    assert taken and all(np.allclose(a.weights, b.weights) for a, b in zip(model.models, fitted, strict=True))
    held, last = np.arange(200) % 5 == 0, np.arange(200) % 5 == 1
    level = [quality.Logistic(m.logit(v[held])[:, None], y[held]) for m, v in zip(fitted, views, strict=True)]
    joint = quality.Logistic(np.stack([c.logit(m.logit(v[last])[:, None]) for c, m, v in zip(level, fitted, views, strict=True)], 1), y[last])
    share = 1 / (1 + np.exp(-joint.logit(np.stack([c.logit(m.logit(v)[:, None]) for c, m, v in zip(level, fitted, views, strict=True)], 1))))
    assert np.allclose(model.score(views)[2], share)


def greedy_tiles(item, text):
    """Tiles of five words and more, longest first, of equal ones the first in the item, then in the text."""
    free_a, free_b, out = [True] * len(item), [True] * len(text), []
    at = collections.defaultdict(list)
    for t, w in enumerate(text):
        at[w].append(t)
    while True:
        best = (4, 0, 0)
        for p in range(len(item)):
            for t in at[item[p]] if free_a[p] else ():
                n = 0
                while p + n < len(item) and t + n < len(text) and free_a[p + n] and free_b[t + n] and item[p + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < 5:
            return out
        free_a[p : p + n] = free_b[t : t + n] = [False] * n
        out.append(n)


def contaminations(docs, items, threshold=0.5):
    """{(doc, item): (coverage, tiles, words)} of lists of words; items with the same words are one."""
    first = {}
    for k, words in sorted(items.items()):
        if len(words) >= 5:
            first.setdefault(tuple(words), k)
    holders = collections.defaultdict(set)
    for words, k in first.items():
        for j in range(len(words) - 4):
            holders[words[j : j + 5]].add(k)
    out = {}
    for i, words in docs.items():
        for k in set().union(*(holders.get(tuple(words[j : j + 5]), ()) for j in range(len(words) - 4))):
            found = greedy_tiles(items[k], words)
            if sum(found) >= threshold * len(items[k]):
                out[i, k] = (sum(found) / len(items[k]), len(found), sum(found))
    return out


def test_contamination(spark, sf_dir, texts):
    t = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()
    items = {k: WORDS.findall(x.lower()) for k, x in zip(t["item_id"], t["text"], strict=True)}
    want = contaminations({i: WORDS.findall(x.lower()) for i, x in texts.items()}, items)
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles, r.n_words) for r in Q["op1_decontamination"](spark, sf_dir).collect()}
    assert want and got == want


def test_contamination_does_not_depend_on_the_parts(spark):
    rng = np.random.default_rng(3)
    items = {k: [f"w{x}" for x in rng.integers(0, 30, 24)] for k in range(40)}
    items |= {100 + k: items[k] for k in range(5)}  # the same words under other ids
    docs = {}
    for i in range(60):
        a, b = items[int(rng.integers(40))], items[int(rng.integers(40))]
        cut = int(rng.integers(5, 20))
        docs[i] = [*a[cut:], "x", *b[: int(rng.integers(3, 24))], *a[:cut], *a[: int(rng.integers(0, 9))]]
    want = contaminations(docs, items)
    bench = spark.createDataFrame([(k, " ".join(w) + "." * (k // 100)) for k, w in items.items()], "item_id long, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    for part_bytes in (8 << 20, 700):
        found = find_contamination(table, bench, part_bytes=part_bytes).collect()
        assert {(r.doc_id, r.item_id): (r.coverage, r.n_tiles, r.n_words) for r in found} == want and len(found) == len(want)
        left = drop_contaminated(table, bench, part_bytes=part_bytes).collect()
        assert {r.doc_id for r in left} == set(docs) - {i for i, _ in want}


def test_embeddings(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pandas()
    x = np.stack(t.embedding.values).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (t.label.values[:, None] == t.label.values[None, :])
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    node, root = label_components(t.vec_id.values[a], t.vec_id.values[b])
    root = dict(zip(node.tolist(), root.tolist(), strict=True))
    for r in Q["op4_embedding_dedup"](spark, sf_dir).collect():
        at = int(np.flatnonzero(t.vec_id.values == r.vec_id)[0])
        assert (r.n_links, r.component_id, r.kept) == (near[at].sum(), root.get(r.vec_id, r.vec_id), root.get(r.vec_id, r.vec_id) == r.vec_id)


def test_jaccard(spark, sf_dir, texts):
    sets, holders, shared = {}, collections.defaultdict(list), collections.Counter()
    for i, text in texts.items():
        w = WORDS.findall(text.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for g in sets[i]:
            shared.update((j, i) for j in holders[g])
            holders[g].append(i)
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    links = collections.Counter(i for p in pairs for i in p)
    node, root = label_components(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    root = dict(zip(node.tolist(), root.tolist(), strict=True))
    for r in Q["op10_jaccard_join"](spark, sf_dir).collect():
        assert (r.n_links, r.component_id) == (links[r.doc_id], root.get(r.doc_id, r.doc_id))


def test_components_in_rounds_and_in_one_task_agree(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    chain = np.arange(1000, 1040)
    a, b = np.concatenate([a, chain[:-1]]), np.concatenate([b, chain[1:]])
    edges = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long").repartition(6)
    keep = a != b
    node, root = label_components(a[keep], b[keep])
    want = dict(zip(node.tolist(), root.tolist(), strict=True))
    for most in (0, 10**6):
        assert {r.node: r.component for r in connected_components(edges, most).collect()} == want


def test_runs_meet_the_target_recall():
    assert (1 - survival(3, 0.8)) ** runs_for(0.999, 0.8) <= 0.001


SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(SPACES + "'sdmtre aA1éÉİΣ<|>")), max_size=60))
def test_any_text_is_tokenized_as_the_libraries_do(text):
    word, byte = _libraries()
    ids = word[0].encode(text, add_special_tokens=False).ids
    for codec in word[1:]:
        flat, size = codec.encode_flat([text, "x", text])
        assert flat.tolist() == ids + word[0].encode("x", add_special_tokens=False).ids + ids and size.tolist() == [len(ids), 1, len(ids)]
    assert word[1].decode_flat(np.array(ids, np.uint32), np.array([len(ids)])).to_pylist() == [word[0].decode(ids, skip_special_tokens=False)]
    assert byte[1].count([text]) == [len(byte[0].encode(text, add_special_tokens=False).ids)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.text(alphabet="abä", max_size=4), max_size=12), max_size=8), st.integers(0, 12), st.booleans())
def test_word_table_gives_what_the_function_gives(groups, most, collide):
    def work(words):
        assert len(words) == len(set(words))
        return np.array([ord(c) for w in words for c in w], np.uint32), np.array([len(w) for w in words], np.int64)

    table = WordTable(work, most)
    with pytest.MonkeyPatch.context() as patch:
        if collide:
            patch.setattr(bpe_core, "string_hashes", lambda raw, ends: np.diff(ends).astype(np.uint64))
        for group in groups:
            words = sorted(group)
            flat, size = table.look_up(pa.array(words, pa.large_string()))
            want = work(words)
            assert flat.tolist() == want[0].tolist() and size.tolist() == want[1].tolist()
            assert len(table.key) <= most + len(words)


def _libraries(found=[]):  # noqa: B006
    if not found:
        found += [(Tokenizer.from_file(WORD), WordCodec(WORD), LibraryCodec(WORD)), (Tokenizer.from_file(BYTE), TokenCounter(BYTE))]
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.randoms())
def test_codes_give_any_token(ids, rng):
    x = np.array(ids, np.uint32)
    codes = Codes(pack(x))
    places = np.array([rng.randrange(len(ids)) for _ in range(50)] if ids else [], np.int64)
    assert (codes.get(places) == x[places]).all()
    a = rng.randrange(len(ids) + 1)
    assert (codes.span(0, len(ids)) == x).all() and (codes.span(a, len(ids)) == x[a:]).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"abc" * 9, b"x" * 40, b"the end "]), min_size=1, max_size=60))
def test_suffix_order_finds_repeats(parts):
    text = np.frombuffer(b"".join(parts) + bytes(100), np.uint8)
    starts = np.arange(len(text) - 100)
    seen, want = set(), []
    for p in starts:
        s = text[p : p + 100].tobytes()
        want.append(s in seen)
        seen.add(s)
    assert repeated(text, starts, starts, 100).tolist() == want


def test_tiles_are_longest_first_and_take_reordered_parts():
    a = np.arange(1, 41, dtype=np.uint64)
    text = np.concatenate([a[20:], np.array([99, 98], np.uint64), a[:20]])
    found = tiles(a, text)
    assert sorted((p, n) for p, _, n in found) == [(0, 20), (20, 20)]
    assert tiles(a, np.arange(100, 140, dtype=np.uint64)) == []
