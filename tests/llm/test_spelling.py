"""Spelling variants against all pairs of words."""

import collections
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import queries
from tracewright.llm.spelling import Shard, counted_words, group_spellings


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def naive_words(rows, one_in=199):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def naive(n):
    """(word, form, root, n, n_near, form_n); neighbours through strings that lack a code point."""
    shorter = collections.defaultdict(set)
    for w in n:
        for s in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            shorter[s].add(w)
    near = {w: set() for w in n}
    for group in shorter.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")


def found(spark, rows, **how):
    return sorted(map(tuple, group_spellings(table(spark, rows), **how).collect()))


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = naive(naive_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert sum(r[1] is not None for r in want) > 50
    df = queries.queries()["op12_spelling"](spark, sf_dir)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, df.collect())) == want


WORDS = ["abcdefgh", "abcdefg", "bcdefgh", "abcdefghi", "xabcdefgh", "abcXdefgh", "abdefgh", "aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaaa", "abcedfgh", "étésété", "étésèté", "Étésété", "zzzzzz×", "zzzzzz"]


@pytest.mark.parametrize("shard", [1, 2, 20_000])
def test_edits_at_every_place_and_hot_keys(spark, shard):
    rows = [(None, " ".join([w] * (5 + 26 * (i % 3) * (i % 4))).upper() if i % 2 and w.isascii() else ", ".join([w] * (5 + 140 * (i % 4)))) for i, w in enumerate(WORDS)]
    rows += [(i, f"hot{a}{b}hot " * 5) for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "abcdefgh")]
    got = found(spark, rows, shard=shard)
    assert got == naive(naive_words(rows)) and len(got) > 75


def test_chains_lead_to_the_root(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    rows = [(k, (w + " ") * (5 * 5 ** k)) for k, w in enumerate(words)]
    got = {r[0]: r for r in found(spark, rows, one_in=1 << 33)}
    assert [got[w][1] for w in words] == [*words[1:], None] and {r[2] for r in got.values()} == {"aabbbb"}


def test_odd_texts(spark):
    long = "ab" * 3000
    rows = [(1, None), (2, ""), (3, "12 34!"), (None, "nothing much"), *[(7, f"{long} {long}x {long[:4000]}y{long[4000:]}")] * 5, (8, "\U0001f642lonely\U0001f642"), *[(9, "rátio İstanbul stanbul")] * 6]
    got = found(spark, rows)
    assert got == naive(naive_words(rows)) and {r[4] for r in got if len(r[0]) > 5000} >= {1}
    assert found(spark, []) == []
    with pytest.raises(ValueError):
        group_spellings(table(spark, rows), least_length=5)


def test_changed_runs(spark):
    rows = [(i, f"alpha{chr(97 + i % 26)}word betaword") for i in range(400)]
    got = {r.word: r.n for r in counted_words(table(spark, rows), one_in=3).collect()}
    assert got == naive_words(rows, 3)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=6, max_size=9), min_size=1, max_size=25))
def test_halves_find_every_pair_once(words):
    words = sorted(words)
    shard = Shard()
    for w in words:
        shard.add(w, 5, True, True)
    shard.close()
    a, b = shard.near(words)
    pairs = sorted(zip(a.tolist(), b.tolist(), strict=True))
    assert pairs == [(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if one_edit(u, v)]
