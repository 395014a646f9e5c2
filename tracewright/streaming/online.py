"""Models that learn batch by batch, with state that survives a restart.

After batch i the model is written as version i in the shared folder.  A batch
starts from the newest version below its own number, so a batch that is run again
after a failure writes the same version again.  A batch reaches the driver as a few
sums; rows are never collected.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.connectors import folder
from ..sources.tables import Tables
from .more import _in_three_batches
from .queries import sink


@dataclass
class Versions:
    """Model states by batch number, one small file each."""

    spark: SparkSession
    path: str

    def write(self, batch: int, state: dict) -> None:
        text = self.spark.createDataFrame([(json.dumps(state),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.path}/batch={batch}")

    def before(self, batch: int | None = None) -> dict | None:
        """The newest state below a batch number; the newest of all without one."""
        system = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = system.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/_SUCCESS"))
        numbers = [int(f.getPath().getParent().getName().split("=")[1]) for f in found or []]
        numbers = [n for n in numbers if batch is None or n < batch]
        if not numbers:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/batch={max(numbers)}").first().value)


@dataclass
class OnlineLinear:
    """A linear or logistic model by gradient steps: batch t moves the weights by step / sqrt(t) times its mean gradient.

    `features` are SQL expressions; the last weight is the intercept's.  `shrink` is the weight of
    the squared length of the others.  Rows with a null in a feature or the label are left out, and
    a batch without rows changes nothing.
    """

    features: list[str]
    label: str
    logistic: bool = True
    step: float = 1.0
    shrink: float = 0.0

    def start(self) -> dict:
        return {"t": 0, "w": [0.0] * (len(self.features) + 1)}

    def predicted(self, w: list[float]) -> Column:
        margin = F.lit(w[-1])
        for a, x in zip(w, self.features, strict=False):
            margin = margin + F.lit(a) * F.expr(x)
        return 1 / (1 + F.exp(-margin)) if self.logistic else margin

    def next(self, state: dict, d: DataFrame) -> dict:
        w = state["w"]
        known = d.where(" AND ".join(f"({x}) IS NOT NULL" for x in [*self.features, self.label]))
        off = self.predicted(w) - F.expr(self.label).cast("double")
        sums = known.agg(F.count("*").alias("n"), *[F.sum(off * F.expr(x)).alias(f"g{j}") for j, x in enumerate([*self.features, "1.0D"])]).first()
        if not sums.n:
            return state
        t = state["t"] + 1
        pull = [self.shrink * a for a in w[:-1]] + [0.0]
        return {"t": t, "w": [a - self.step / math.sqrt(t) * (sums[f"g{j}"] / sums.n + pull[j]) for j, a in enumerate(w)]}


@dataclass
class OnlineClusters:
    """Centres as means that forget: what was seen before a batch counts by 0.5 ^ (batches / half life)."""

    features: list[str]
    centres: list[list[float]]
    half_life: float | None = None

    def start(self) -> dict:
        return {"centres": self.centres, "weights": [0.0] * len(self.centres)}

    def nearest(self, centres: list[list[float]]) -> Column:
        """Number of the nearest centre; the smaller of equals."""
        apart = [sum(((F.expr(x) - a) * (F.expr(x) - a) for x, a in zip(self.features, c, strict=True)), F.lit(0.0)) for c in centres]
        return F.least(*[F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(apart)])["k"]

    def next(self, state: dict, d: DataFrame) -> dict:
        known = d.where(" AND ".join(f"({x}) IS NOT NULL" for x in self.features))
        rows = known.groupBy(self.nearest(state["centres"]).alias("k")).agg(F.count("*").alias("n"), *[F.sum(F.expr(x).cast("double")).alias(f"s{j}") for j, x in enumerate(self.features)])
        keep = 0.5 ** (1 / self.half_life) if self.half_life else 1.0
        centres, weights = [list(c) for c in state["centres"]], [w * keep for w in state["weights"]]
        for r in rows.collect():  # a row per centre
            total = weights[r.k] + r.n
            centres[r.k] = [(c * weights[r.k] + r[f"s{j}"]) / total for j, c in enumerate(centres[r.k])]
            weights[r.k] = total
        return {"centres": centres, "weights": weights}


def learning(model: OnlineLinear | OnlineClusters, versions: Versions) -> Callable[[DataFrame, int], None]:
    """A batch function that writes the model's next version."""

    def learn(d: DataFrame, i: int) -> None:
        versions.write(i, model.next(versions.before(i) or model.start(), d))

    return learn


def _learned(t: Tables, model: OnlineLinear | OnlineClusters) -> dict:
    versions = Versions(t.spark, folder(t, "model"))
    sink(t, _in_three_batches(t), learning(model, versions))
    return versions.before()


def _linear_sql(link: str, label: str, step: float, shrink: float) -> str:
    """The same steps over the events by event_id % 3."""
    parts = [f"r AS (SELECT event_id % 3 AS part, value / 100.0::DOUBLE AS x, CAST({label} AS DOUBLE) AS y FROM events)", "w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for t in (1, 2, 3):
        off = link.format("w.a * r.x + w.b")
        parts.append(f"w{t} AS (SELECT any_value(w.a) - {step} / sqrt({t}) * (avg(({off} - r.y) * r.x) + {shrink} * any_value(w.a)) AS a, any_value(w.b) - {step} / sqrt({t}) * avg({off} - r.y) AS b FROM r, w{t - 1} w WHERE r.part = {t - 1})")
    return f"WITH {', '.join(parts)} SELECT round(a, 9) AS weight, round(b, 9) AS intercept FROM w3"


def _weights(t: Tables, state: dict) -> DataFrame:
    return t.spark.createDataFrame([tuple(round(a, 9) for a in state["w"])], "weight double, intercept double")


@query("stream_logistic_regression", _linear_sql("1 / (1 + exp(-({})))", "event_type IN ('purchase', 'signup')", 2.0, 0.01))
def stream_logistic_regression(t: Tables) -> DataFrame:
    return _weights(t, _learned(t, OnlineLinear(["value / 100.0D"], "event_type IN ('purchase', 'signup')", True, 2.0, 0.01)))


@query("stream_linear_regression", _linear_sql("({})", "(event_id % 1000) / 1000.0::DOUBLE", 0.5, 0.0))
def stream_linear_regression(t: Tables) -> DataFrame:
    """A line learned by a gradient step per batch."""
    return _weights(t, _learned(t, OnlineLinear(["value / 100.0D"], "(event_id % 1000) / 1000.0D", False, 0.5)))


_HALF = 0.5 ** (1 / 2.0)
_MOVES = ", ".join(
    f"""c{i + 1} AS (SELECT c.k, CASE WHEN n IS NULL THEN c.c ELSE (c.c * c.w * {_HALF!r} + s) / (c.w * {_HALF!r} + n) END AS c, c.w * {_HALF!r} + coalesce(n, 0) AS w
FROM c{i} c LEFT JOIN (SELECT k, count(*) AS n, sum(value) AS s FROM (SELECT value, (SELECT k FROM c{i} ORDER BY (value - c) * (value - c), k LIMIT 1) AS k FROM events WHERE event_id % 3 = {i}) GROUP BY k) m USING (k))"""
    for i in range(3)
)


@query("stream_kmeans", f"WITH c0 AS (SELECT * FROM (VALUES (0, 10.0::DOUBLE, 0.0::DOUBLE), (1, 50.0, 0.0), (2, 60.0, 0.0)) x(k, c, w)), {_MOVES} SELECT k, round(c, 6) AS centre, round(w, 6) AS weight FROM c3")
def stream_kmeans(t: Tables) -> DataFrame:
    """Three centres that forget half of what they saw in two batches."""
    state = _learned(t, OnlineClusters(["value"], [[10.0], [50.0], [60.0]], half_life=2.0))
    rows = [(k, round(c[0], 6), round(w, 6)) for k, (c, w) in enumerate(zip(state["centres"], state["weights"], strict=True))]
    return t.spark.createDataFrame(rows, "k int, centre double, weight double")
