"""Operator 13: personal data by candidate gradient boosting, DataFrame functions only.

1. Islands: maximal runs of the characters that addresses, numbers or veiled
   addresses are made of.  No match of any pattern crosses an island's edge, so
   the texts are scanned three times whatever the number of patterns.
2. Generators propose spans inside the islands, overlapping ones too: the base
   patterns of each kind, and wider ones (digit groups of a card or a phone inside
   a longer run of numbers, phones without a plus, "name (at) host (dot) net").
3. Boosted trees score every span by its format (digits, groups, checksums,
   labels) and context (what touches it, digits and cue words around it).  They
   learn from the base patterns' own matches: those that pass their kind's check
   against those that fail it.  All distinct matches count, half of them (by hash)
   to learn from and half held out; equal feature vectors are one weighted row.
4. A kind's threshold is the smallest score whose precision on the held-out spans
   reaches `precision`, and no less than that of all kinds together.  Spans that
   reach it and touch no base span are added to the base spans.

Patterns are possessive and begin at a run's first character, so they take linear
time on runs of any length.  Positions are sums of the lengths of gaps and matches
along a document, in one shuffle of islands; texts are not shuffled.

Defined cases: a null text is empty; every row gives a row, rows that repeat an id
too; where nothing can be learned (no passing or no failing match, an empty table)
only base spans are found; positions count code points; other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

KINDS = ["email", "ip", "card", "phone"]
AROUND = 24
SENTINEL = "none"
SALTS = 16
STEPS = 1024  # parts of the scores that are summed apart
LINES = 50_000  # of a task that trees learn from

LOCAL, HOST, AT, DOT = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]", r"[(\[][Aa][Tt][)\]]", r"[(\[][Dd][Oo][Tt][)\]]"

#: Runs outside which no pattern of the family matches.
ISLANDS = {
    "number": r"[0-9+(][0-9 ().+-]{6,}+",
    "address": f"(?<!{LOCAL}){LOCAL}*+@[A-Za-z0-9._%+@-]*+",
    "veiled": f"(?<!{LOCAL}){LOCAL}++ ?{AT} ?{HOST}++(?:(?:\\.| ?{DOT} ?){HOST}++)++",
}

#: (kind, family, pattern), the base pattern of each kind first.
BASE = [
    ("email", "address", f"(?:\\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\\.{HOST}++)++"),
    ("ip", "number", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "number", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", "number", r"\+[0-9][ ().0-9-]+[0-9]"),
]
WIDER = [
    ("email", "veiled", ISLANDS["veiled"]),
    ("card", "number", r"(?<![0-9])[0-9]{12,19}(?![0-9])"),
    ("card", "number", r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){3}(?![0-9])"),
    ("card", "number", r"(?<![0-9])[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}(?![0-9])"),
    ("phone", "number", r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone", "number", r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])"),
    ("ip", "number", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
]
GENERATORS = BASE + WIDER

CUES = {
    "email": "(?i)mail|contact|write to|reach",
    "ip": "(?i)\\bip\\b|address|host|server|from",
    "card": "(?i)card|credit|debit|visa|master|amex|payment",
    "phone": "(?i)phone|tel\\b|call|mobile|cell|fax",
    "other": "(?i)order|invoice|token|version|isbn|serial|number|\\bid\\b|\\bno\\b",
}


def _cut(text: Column, pattern: str) -> Column:
    """The matches of a pattern with the length of the gap before each and what lies around it."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))

    def placed(s: Column) -> Column:
        def one(f: Column, i: Column) -> Column:
            gap = F.get(s["gaps"], i)
            return F.struct(F.length(gap).cast("long").alias("gap"), f.alias("found"), F.right(gap, F.lit(AROUND)).alias("before"), F.left(F.get(s["gaps"], i + 1), F.lit(AROUND)).alias("after"))

        return F.transform(s["found"], one)

    return F.get(F.transform(F.array(both), placed), F.lit(0))


def _start(by: list[str], order: str) -> Column:
    along = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.col("gap") + F.length("found")).over(along) - F.length("found")


def islands(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, family, at, found, before, after, start); a sentinel row for every document."""
    text = F.col("text")
    holds = {"number": text.rlike("[0-9]"), "address": F.contains(text, F.lit("@")), "veiled": text.rlike(AT)}
    nothing = F.array(F.struct(F.lit(0).cast("long").alias("gap"), F.lit("").alias("found"), F.lit("").alias("before"), F.lit("").alias("after")))
    families = [F.struct(F.lit(SENTINEL).alias("family"), nothing.alias("cuts"))]
    families += [F.struct(F.lit(name).alias("family"), F.when(holds[name], _cut(text, pattern)).alias("cuts")) for name, pattern in ISLANDS.items()]
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a generator's rows carry what is selected beside it: never the text, nor the array that is taken apart
    rows = base.select("uid", "id", F.explode(F.array(*families)).alias("f")).select("uid", "id", "f.family", "f.cuts")
    rows = rows.select("uid", "id", "family", F.posexplode("cuts").alias("at", "cut"))
    rows = rows.select("uid", "id", "family", "at", "cut.*").repartition("uid")
    return rows.withColumn("start", _start(["uid", "family"], "at")).drop("gap")


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, kind, start, end, value, before, after, base, passed), distinct spans; a row of kind none for every document."""
    found = islands(docs, id_col, text_col)
    by_family = []
    for name in ISLANDS:
        own = [F.struct(F.lit(n).alias("generator"), F.lit(kind).alias("kind"), _cut(F.col("found"), pattern).alias("cuts")) for n, (kind, family, pattern) in enumerate(GENERATORS) if family == name]
        by_family.append(F.when(F.col("family") == name, F.array(*own)))
    keys, outer = ["uid", "family", "at", "generator"], ["id", "origin", "island_before", "island_after"]
    spans = found.where(F.col("family") != SENTINEL).withColumnsRenamed({"start": "origin", "before": "island_before", "after": "island_after"})
    spans = spans.select("uid", "family", "at", *outer, F.explode(F.coalesce(*by_family)).alias("g"))
    spans = spans.select("uid", "family", "at", *outer, "g.generator", "g.kind", "g.cuts")
    spans = spans.select(*keys, *outer, "kind", F.posexplode("cuts").alias("nth", "cut"))
    spans = spans.select(
        *keys, "id", "kind", "nth", "cut.gap", "cut.found", "origin",
        F.when(F.col("nth") > 0, F.col("cut.before")).otherwise(F.right(F.concat("island_before", "cut.before"), F.lit(AROUND))).alias("before"),
        F.left(F.concat("cut.after", F.when(F.length("cut.after") < AROUND, F.col("island_after")).otherwise("")), F.lit(AROUND)).alias("after"),
    ).withColumn("start", F.col("origin") + _start(keys, "nth"))
    end = F.col("start") + F.length("found")
    spans = spans.select("uid", "id", "kind", "start", end.alias("end"), "generator", F.col("found").alias("value"), "before", "after")
    spans = spans.groupBy("uid", "kind", "start", "end").agg(F.first("id").alias("id"), F.min(F.struct("generator", "value", "before", "after")).alias("s"))
    spans = spans.select("uid", "id", "kind", "start", "end", "s.value", "s.before", "s.after", (F.col("s.generator") < len(BASE)).alias("base"))
    spans = spans.withColumn("passed", F.col("base") & passes(F.col("kind"), F.col("value")))
    none = found.where(F.col("family") == SENTINEL).select("uid", "id", F.lit(SENTINEL).alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), "found", "before", "after", F.lit(False).alias("base"), F.lit(False).alias("passed"))
    return spans.union(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    return F.coalesce(F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)), F.lit(False))


def passes(kind: Column, value: Column) -> Column:
    """The check of a base pattern's match."""
    n = F.length(_digits(value))
    parts = value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    return F.when(kind == "email", True).when(kind == "ip", parts).when(kind == "card", n.between(12, 19) & _luhn(value)).otherwise(n.between(9, 15))


def features(spans: DataFrame) -> DataFrame:
    """The spans with a vector of format and context features."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    plain = F.regexp_replace(F.regexp_replace(value, f" ?{AT} ?", "@"), f" ?{DOT} ?", ".")
    # spans of any length are described; what a long one holds beyond that is of no use
    plain = F.left(plain, F.lit(400))
    is_mail = F.col("kind") == "email"
    domain = F.when(is_mail, F.substring_index(plain, "@", -1)).otherwise("")
    groups = F.filter(F.split(plain, "[^0-9]+"), lambda g: g != "")
    sizes = F.when(~is_mail, F.transform(groups, F.length)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(groups, lambda g: F.left(g, F.lit(6)).cast("int"))
    word = "[\\p{L}\\p{N}_]"
    listed = {f"is_{k}": F.col("kind") == k for k in KINDS} | {
        "n_chars": F.length(plain), "n_digits": F.length(_digits(plain)), "n_groups": F.size(sizes), "longest": F.coalesce(F.array_max(sizes), F.lit(0)), "shortest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "paren": F.contains(plain, F.lit("(")), "luhn": _luhn(plain), "largest_part": F.when(F.col("kind") == "ip", F.coalesce(F.array_max(parts), F.lit(-1))).otherwise(-1),
        "n_distinct": F.size(F.array_distinct(F.split(_digits(plain), ""))),
        "labels": F.size(F.split(domain, "\\.")), "tld": F.length(F.substring_index(domain, ".", -1)), "tld_letters": domain.rlike("\\.[A-Za-z]+$"), "local": F.when(is_mail, F.length(F.substring_index(plain, "@", 1))).otherwise(0),
        "touched_left": before.rlike(f"{word}$"), "touched_right": after.rlike(f"^{word}"), "signed_left": before.rlike("[-+.#$/]$"), "signed_right": after.rlike("^[-+.#%/][0-9]"),
        "digits_left": F.length(_digits(before)), "digits_right": F.length(_digits(after)), "quoted": before.rlike("[\"'=]\\s?$"),
    } | {f"cue_{k}": before.rlike(p) for k, p in CUES.items()}
    numbers = spans.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{name}") for name, c in listed.items()])
    names = [f"f_{name}" for name in listed]
    return VectorAssembler(inputCols=names, outputCol="features").transform(numbers).drop(*names)


@dataclass
class Boosted:
    """Trees and the threshold of each kind; no trees: nothing beyond the base."""

    trees: GBTClassificationModel | None = None
    thresholds: dict[str, float] = field(default_factory=dict)


def _score(spans: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    return trees.transform(spans).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _thresholds(scored: DataFrame, precision: float) -> dict[str, float]:
    """By kind, and for all of them, the smallest score from which on up the weighted mean of the labels reaches `precision`.

    Rows of one score are summed, then scores of one part, so that no task holds a kind's rows.
    """
    right, wrong = F.sum(F.col("n") * F.col("label")).cast("long"), F.sum(F.col("n") * (1 - F.col("label"))).cast("long")
    each = scored.select("score", "label", "n", F.explode(F.array("kind", F.lit("all"))).alias("kind"))
    each = each.groupBy("kind", "score").agg(right.alias("right"), wrong.alias("wrong")).withColumn("part", F.floor(F.col("score") * STEPS))
    above = Window.partitionBy("kind").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy("kind", "part").agg(F.sum("right").alias("r"), F.sum("wrong").alias("w"))
    parts = parts.select("kind", "part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("r", "w")])
    upto = Window.partitionBy("kind", "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    right, wrong = F.sum("right").over(upto) + F.col("r_above"), F.sum("wrong").over(upto) + F.col("w_above")
    reached = each.join(parts, ["kind", "part"]).withColumn("precision", right / (right + wrong)).where(F.col("precision") >= precision)
    return {r.kind: r.score for r in reached.groupBy("kind").agg(F.min("score").alias("score")).collect()}


def fit_spans(spans: DataFrame, most: int | None = None, precision: float = 0.99, rounds: int = 12, depth: int = 3) -> Boosted:
    """Trees and thresholds learned from all distinct base matches; with `most`, from at most so many per kind and label, and as many held out."""
    known = spans.where("base").select("kind", "passed", "value", "before", "after").distinct()
    known = known.withColumn("h", F.xxhash64("kind", "value", "before", "after")).withColumn("held_out", F.pmod("h", F.lit(2)) == 1)
    if most is not None:
        group = ["kind", "passed", "held_out"]
        for by in ([*group, F.pmod(F.shiftright("h", 8), F.lit(SALTS))], group):  # the smallest hashes of each slice, then of each group
            known = known.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("place") <= most)
    known = known.select("kind", "held_out", F.col("passed").cast("double").alias("label"), "value", "before", "after")
    lines = checkpointed(features(known).groupBy("kind", "held_out", "label", "features").agg(F.count("*").cast("double").alias("n")))
    classes = {(r.held_out, r.label): r.lines for r in lines.groupBy("held_out", "label").agg(F.count("*").alias("lines")).collect()}
    if len(classes) < 4:
        return Boosted()
    lines = lines.coalesce(1 + sum(classes.values()) // LINES)
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="n", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=13, cacheNodeIds=False).fit(lines.where("not held_out"))
    thresholds = _thresholds(_score(lines.where("held_out"), trees), precision)
    overall = thresholds.pop("all", 2.0)
    return Boosted(trees, {k: max(t, overall) for k, t in thresholds.items()})


def select_spans(spans: DataFrame, model: Boosted) -> DataFrame:
    """(uid, id, kind, start, end, base) of base spans and of others that reach their threshold and touch none; rows of kind none stay."""
    listed = ["uid", "id", "kind", "start", "end", F.col("passed").alias("base")]
    sure = spans.where(F.col("passed") | (F.col("kind") == SENTINEL)).select(*listed)
    if model.trees is None or not model.thresholds:
        return sure
    least = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair])
    rest = spans.where(~F.col("base") & (F.col("kind") != SENTINEL))  # a base match that failed stays dropped
    chosen = _score(features(rest), model.trees).where(F.col("score") >= least[F.col("kind")])
    both = sure.union(chosen.select(*listed))
    before = Window.partitionBy("uid").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("uid").orderBy(F.desc("start"), F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("base") & (F.col("kind") != SENTINEL)
    touched = (F.coalesce(F.max(F.when(own, F.col("end"))).over(before), F.lit(0)) > F.col("start")) | (F.col("end") > F.min(F.when(own, F.col("start"))).over(after))
    both = both.withColumn("touched", F.coalesce(touched, F.lit(False)))
    return both.where(F.col("base") | (F.col("kind") == SENTINEL) | ~F.col("touched")).drop("touched")


def find_personal_data(docs: DataFrame, most: int | None = None, precision: float = 0.99, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    found = checkpointed(candidates(docs, id_col, text_col))
    chosen = select_spans(found, fit_spans(found, most, precision))
    real = F.col("kind") != SENTINEL
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", place.alias("place"), "end", F.concat_ws(":", "kind", "start", "end").alias("text"))

    def joined(when: Column) -> Column:
        return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(when, span))), lambda s: s["text"]))

    out = chosen.groupBy("uid").agg(
        F.first("id").alias(id_col), *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base") & real), 256).alias("base_sha256"), joined(real).alias("spans"),
    )
    return out.drop("uid")
