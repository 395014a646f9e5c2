"""Personal data: base spans by plain regular expressions, and what the trees add."""

import hashlib
import re

import pytest
from odd_rows import LONG, documents
from pyspark.sql import functions as F

from tracewright.llm import personal_data, queries
from tracewright.llm.personal_data import Boosted, candidates, find_personal_data, fit_spans, select_spans

KINDS = ["email", "ip", "card", "phone"]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (c > "4")) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else False, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def check(row, text):
    want = base(text)
    assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text, want, row)
    assert [row[f"n_{k}"] for k in KINDS] == [sum(w.startswith(k) for w in want) for k in KINDS]
    spans = row.spans.split(",") if row.spans else []
    assert set(want) <= set(spans) and len(set(spans)) == len(spans)
    places = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in spans)]
    assert places == sorted(places)
    return set(spans) - set(want)


def test_base_spans_of_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.queries()["op13_personal_data"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        check(r, texts[r.doc_id])


TRICKY = [
    "a@b.co_x@d.com", "a@b@c.de", "a@b..c", "x.@-.-", "a@b.c.", "@a.b", "a@b", "\U0001f642 jo@ex.orgé", "a@b.cx@d.e", "%+-@a.b.c.d", "to a@b.c,d@e.f",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "0000255.00.1.1", "1.2.3", "1.2.3.4 5.6.7.8", "9" * 40 + ".1.2.3", "v1.2.3.4-5",
    "4539 1488 0343 6467", "4539-1488-0343-6467 7", "4539  1488 0343 6467", "4539148803436467", "45391488034364670000000", "1 2 3 4 5 6 7 8 9 0 1 2 8", "٤539148803436467",
    "+1 (826) 555-4081 190.137.223.204", "+12345678", "+1-2-3-4-5-6-7-8-9", "+1 ()()()()( ) 2 34567890 .", "+1+2345678901", "+1 2345678901 +2 3456789012", "(+44) 20 7946 0958", "+１ 234567890",
    "12 34 +5 678 901 2345 6.7.8.9", "\n+1 (826)\n555-4081", "", None, "no digits at all", "  +  ", "(((((((((", "1234567", "tel.+49 30 901820",
]


def test_base_spans_of_tricky_texts(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TRICKY)] + [(None, TRICKY[0], "x", "y"), (0, TRICKY[0], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, start string").repartition(2)
    got = find_personal_data(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        check(r, TRICKY[r.doc_id or 0])


def test_odd_rows(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect() if r.doc_id is not None}
    rows = find_personal_data(documents(spark)).collect()
    assert len(rows) == documents(spark).count()
    for r in rows:
        if r.doc_id is not None:
            check(r, texts[r.doc_id])
    assert find_personal_data(documents(spark, empty=True)).collect() == []


def test_texts_of_many_megabytes(spark):
    """Runs of one family over megabytes: time in proportion, no deep recursion."""
    rows = [(1, "a" * 2_000_000 + "@x.org"), (2, "1 " * 700_000), (3, "a@b" + ".c" * 700_000), (4, "1.1.1.1 " * 100_000), (5, "+" * 1_000_000), (6, LONG + " jo@ex.org"), (7, "a@" * 300_000)]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, text in rows:
        if i not in (1, 4, 5):  # plain expressions take quadratic time there
            check(got[i], text)
    assert got[1].spans == "email:0:2000006" and got[5].spans == ""
    assert got[4].n_ip == 100_000 and got[4].spans.startswith("ip:0:7,ip:8:15,")


def with_check(digits):
    return next(digits + c for c in "0123456789" if luhn(digits + c))


@pytest.fixture(scope="module")
def corpus(spark):
    """Cards with a right and with a wrong check digit, addresses, phones of good and bad length, and three kinds of texts that the base misses."""
    rows = []
    for i in range(300):
        card = with_check(f"4{i * 7919 + 10**13:014d}")
        wrong = card[:-1] + str((int(card[-1]) + 1 + i % 9) % 10)
        one = [card, wrong][i % 2]
        rows.append((i, f"words before {one} and after" if i % 3 else f"{i} {i * 31} {one}, 77 {i}"))
        rows.append((1000 + i, f"from 10.{i % 256 + 256 * (i % 2)}.3.{i % 200} in the log"))
        phone = f"+1 (826) 555-{i:04d}" + f" 55-{i:04d}{i:04d}" * (i % 2)
        rows.append((2000 + i, f"so {phone} rings" if i % 3 else f"10.0.0.7 {phone} 12.{i % 256}.3.4"))
        rows.append((3000 + i, f"did jo.{i}@mail.example.com write" if i % 2 else f"wrote 12 to a{i}.bo@example.org, 5 of them"))
    a, b = with_check("455099781072080"), with_check("235382095301374")
    rows += [(5001, f"wh {a} {b[:-1]}{(int(b[-1]) + 1) % 10} thheed"), (5002, "des +1 (826) 555-4081 190.137.223.204 du"), (5003, "write to jo.17 (at) mail [dot] example.com for more"), (5004, "plain words only, 12 of them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return dict(rows), docs


def test_trees_add_what_the_base_misses(spark, corpus):
    texts, docs = corpus
    got = {r.doc_id: r for r in find_personal_data(docs).collect()}
    added = {i: check(got[i], texts[i]) for i in texts}
    assert added[5001] == {"card:3:19"}  # the digits of two numbers are one base match, which fails
    assert added[5002] == {"phone:4:21"}
    assert added[5003] == {f"email:9:{9 + len('jo.17 (at) mail [dot] example.com')}"}
    assert not any(v for i, v in added.items() if 1000 <= i < 2000 or i == 5004)
    for i in range(300):  # numbers before a card make one long base match, which fails
        kinds = {x.split(":")[0]: texts[i][int(x.split(":")[1]) : int(x.split(":")[2])] for x in added[i]}
        assert kinds in ({}, {"card": kinds.get("card")}) and all(luhn(v) and len(v) == 16 for v in kinds.values())


def test_thresholds_are_the_least_scores_of_the_asked_precision(spark, corpus):
    spans = candidates(corpus[1], "doc_id", "text").cache()
    strict, loose = fit_spans(spans, precision=1.0), fit_spans(spans, precision=0.5)
    assert strict.thresholds.keys() == {"email", "ip", "card", "phone"}
    assert all(loose.thresholds[k] <= strict.thresholds[k] for k in strict.thresholds)
    few = fit_spans(spans, most=3)
    assert few.trees is not None
    assert fit_spans(spans.where("passed")).trees is None
    bare = select_spans(spans, Boosted())
    assert bare.where("kind != 'none'").count() == spans.where("passed").count()
    spans.unpersist()


def test_no_python_in_the_plans(spark, sf_dir):
    plan = candidates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_all_matches_are_learned_from(spark, monkeypatch):
    """2,600 distinct numbers of one kind and label to learn from, 900 of the other: every one counts."""
    weights = []
    real = personal_data.GBTClassifier.fit

    def fit(self, lines):
        weights.append({r.label: r.n for r in lines.groupBy("label").agg(F.sum(self.getOrDefault("weightCol")).alias("n")).collect()})
        return real(self, lines)

    monkeypatch.setattr(personal_data.GBTClassifier, "fit", fit)
    rows = [(i, f"from 10.{i % 200}.3.{i // 200} in the log") for i in range(5200)] + [(6000 + i, f"from 10.{i % 200}.3.{256 + i // 200} in the log") for i in range(1800)]
    spans = candidates(spark.createDataFrame(rows + rows[:50], "doc_id long, text string"), "doc_id", "text").cache()
    base = spans.where("base").select("kind", "passed", "value", "before", "after").distinct()
    base = base.where(F.pmod(F.xxhash64("kind", "value", "before", "after"), F.lit(2)) == 0)
    want = {float(r.passed): r["count"] for r in base.groupBy("passed").count().collect()}
    fit_spans(spans)
    assert weights == [want] and want[1.0] > 2000
    spans.unpersist()


def test_thresholds_equal_those_of_one_window(spark):
    rows = [(["ip", "card"][i % 2], (i * 7919 % 1000) / 999, float(i * 31 % 10 < 7 + 3 * (i * 7919 % 1000 > 600)), float(1 + i % 3)) for i in range(900)]
    scored = spark.createDataFrame(rows, "kind string, score double, label double, n double")
    for precision in (0.7, 0.9, 0.99, 1.0):
        want = {}
        for kind in ("ip", "card", "all"):
            own = [r for r in rows if kind in (r[0], "all")]
            least = [s for s in {r[1] for r in own} if sum(r[2] * r[3] for r in own if r[1] >= s) >= precision * sum(r[3] for r in own if r[1] >= s) - 1e-12]
            want |= {kind: min(least)} if least else {}
        assert personal_data._thresholds(scored, precision) == want
