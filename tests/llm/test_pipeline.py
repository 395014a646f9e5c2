"""The corpus pipeline against a brute-force version of its stages."""

import collections
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

WORDS = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORDS.findall(text.lower())


def groups(docs):
    """Smallest id of each document's group of near copies."""
    sets, holders, shared = {}, collections.defaultdict(list), collections.Counter()
    for i, text in docs.items():
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for g in sets[i]:
            shared.update((j, i) for j in holders[g])
            holders[g].append(i)
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in docs}


def without_repeats(docs):
    seen, out = set(), {}
    for i, text in docs.items():
        b = text.encode()
        keep = np.ones(len(b), bool)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                keep[p : p + 100] = False
            seen.add(s)
        left = np.frombuffer(b, np.uint8)[keep].tobytes().decode("utf-8", "ignore")
        if keep.all() or left.strip(" "):
            out[i] = left
    return out


def covered(item, text):
    """Words of the item under greedy longest tiles of five words and more."""
    free_a, free_b, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and free_a[p + n] and free_b[t + n] and item[p + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < 5:
            return total
        free_a[p : p + n] = free_b[t : t + n] = [False] * n
        total += n


def contaminated(text, items):
    w = words(text)
    grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for item in items:
        if len(item) >= 5 and any(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)) and covered(item, w) >= 0.5 * len(item):
            return True
    return False


def test_pipeline_is_its_stages_by_brute_force(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    docs = {i: x for i, x in sorted(zip(t["doc_id"], t["text"], strict=True)) if any(c.isalpha() for c in x)}
    root = groups(docs)
    docs = without_repeats({i: x for i, x in docs.items() if root[i] == i})
    items = [words(x) for x in pq.read_table(f"{sf_dir}/benchmark.parquet")["text"].to_pylist()]
    docs = {i: x for i, x in docs.items() if not contaminated(x, items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, x in docs.items():
        ids = library.encode(x, add_special_tokens=False).ids
        want[i] = (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert got == want


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_dedup", "suffix_dedup", "decontamination", "bpe_codec"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes


def test_documents_that_share_an_id_go_by_their_own_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(0, a), (1, a + " x"), (1, b), (2, None), (2, ""), (3, b + " y")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.jaccard_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == sorted([(0, a), (1, b), (2, ""), (2, "")])
