"""The older learning API (`pyspark.mllib`): models, metrics, tests and distributed matrices, over RDDs of table rows.

These exist in Spark as RDD code only.  Each query returns numbers that SQL gives
for the same rows: parameters with a closed form, counts, or metrics.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.mllib import classification as C
from pyspark.mllib import clustering as K
from pyspark.mllib import evaluation as E
from pyspark.mllib import feature as M
from pyspark.mllib import regression as R
from pyspark.mllib import tree
from pyspark.mllib.linalg import DenseMatrix, Vectors
from pyspark.mllib.linalg.distributed import CoordinateMatrix, IndexedRow, IndexedRowMatrix, MatrixEntry
from pyspark.mllib.stat import KernelDensity, Statistics
from pyspark.mllib.stat.distribution import MultivariateGaussian
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import reliable
from ..registry import query
from ..sources.tables import Tables


def _points(df: DataFrame, label: str, *features: str):
    return df.select(F.col(label).cast("double"), *[F.col(c).cast("double") for c in features]).rdd.map(lambda r: R.LabeledPoint(r[0], list(r[1:])))


def _vectors(df: DataFrame, *columns: str):
    return df.select(*[F.col(c).cast("double") for c in columns]).rdd.map(lambda r: Vectors.dense(list(r)))


def _fit_line(name: str, weight: str, train) -> None:
    """`weight` is the closed form for y = 3 x without intercept, from x2, the mean square of x."""

    @query(f"mllib_{name}", f"SELECT round({weight}, 3) AS weight, round(avg(x) * ({weight}), 3) AS predicted FROM (SELECT l_discount * 10 AS x FROM lineitem), (SELECT avg((l_discount * 10) ** 2) AS x2 FROM lineitem) GROUP BY x2")
    def run(t: Tables) -> DataFrame:
        rows = t.lineitem.select((F.col("l_discount") * 10).alias("x"), (F.col("l_discount") * 30).alias("y"))
        found = float(train(_points(rows, "y", "x")).weights[0])
        return rows.agg(F.round(F.lit(found), 3).alias("weight"), F.round(F.avg("x") * found, 3).alias("predicted"))


_fit_line("linear_sgd", "3.0::DOUBLE", lambda d: R.LinearRegressionWithSGD.train(d, iterations=200, step=2.0, convergenceTol=1e-9))
_fit_line("lasso_sgd", "(3 * x2 - 0.2) / x2", lambda d: R.LassoWithSGD.train(d, iterations=200, step=2.0, regParam=0.2, convergenceTol=1e-9))
_fit_line("ridge_sgd", "3 * x2 / (x2 + 0.2)", lambda d: R.RidgeRegressionWithSGD.train(d, iterations=200, step=2.0, regParam=0.2, convergenceTol=1e-9))

_SIDES = "SELECT (p_size > 25)::INT AS side, count(*) AS n FROM part WHERE abs(p_size - 25.5) > 8 GROUP BY 1"


def _sides(t: Tables) -> DataFrame:
    """Two classes of parts, with a gap between them."""
    return t.part.where("abs(p_size - 25.5) > 8").select(((F.col("p_size") - 25.5) / 25).alias("x"), (F.col("p_size") > 25).cast("double").alias("label"))


def _fit_sides(name: str, train) -> None:
    @query(f"mllib_{name}", _SIDES)
    def run(t: Tables) -> DataFrame:
        rows = _sides(t)
        model = train(_points(rows, "label", "x"))
        found = model.predict(_vectors(rows, "x")).map(lambda p: (int(p),))
        return t.spark.createDataFrame(found, "side int").groupBy("side").agg(F.count("*").alias("n"))


_fit_sides("svm_sgd", lambda d: C.SVMWithSGD.train(d, iterations=60, intercept=True))
_fit_sides("logistic_sgd", lambda d: C.LogisticRegressionWithSGD.train(d, iterations=60, intercept=True))
_fit_sides("boosted_trees", lambda d: tree.GradientBoostedTrees.trainClassifier(d, {}, numIterations=3))
_fit_sides("decision_tree", lambda d: tree.DecisionTree.trainClassifier(d, 2, {}, maxDepth=2))

def _groups(t: Tables, *ranges: tuple[int, int]) -> DataFrame:
    """Lines whose quantities fall into ranges far from each other."""
    inside = " OR ".join(f"l_quantity BETWEEN {a} AND {b}" for a, b in ranges)
    return t.lineitem.where(inside).selectExpr("l_quantity", "l_discount * 10 AS discount")


def _groups_sql(columns: str, *ranges: tuple[int, int]) -> str:
    at = " ".join(f"WHEN l_quantity BETWEEN {a} AND {b} THEN {i}" for i, (a, b) in enumerate(ranges))
    return f"SELECT {columns} FROM (SELECT l_quantity, l_discount * 10 AS discount, CASE {at} END AS cluster FROM lineitem) WHERE cluster IS NOT NULL GROUP BY cluster"


def _assigned(t: Tables, model, points, centres) -> DataFrame:
    """Each centre with the number of rows that the model gives to it."""
    sizes = t.spark.createDataFrame(model.predict(points).map(lambda c: (int(c),)), "cluster int").groupBy("cluster").agg(F.count("*").alias("n"))
    places = t.spark.createDataFrame([(i, *(round(float(x), 4) for x in c)) for i, c in enumerate(centres)], "cluster int, x double, y double")
    return places.join(sizes, "cluster").drop("cluster")


_CENTRES = "round(avg(l_quantity), 4) AS x, round(avg(discount), 4) AS y, count(*) AS n"
_TWO, _FOUR = [(1, 17), (34, 50)], [(1, 5), (14, 18), (33, 37), (46, 50)]


@query("mllib_kmeans", _groups_sql(_CENTRES, *_TWO))
def mllib_kmeans(t: Tables) -> DataFrame:
    points = _vectors(_groups(t, *_TWO), "l_quantity", "discount")
    model = K.KMeans.train(points, 2, maxIterations=30, seed=1, epsilon=1e-9)
    return _assigned(t, model, points, model.centers)


@query("mllib_bisecting_kmeans", _groups_sql(_CENTRES, *_FOUR))
def mllib_bisecting_kmeans(t: Tables) -> DataFrame:
    """Four groups in two pairs: cut between the pairs first, then within each."""
    points = _vectors(_groups(t, *_FOUR), "l_quantity", "discount")
    model = K.BisectingKMeans.train(points, 4, maxIterations=30)
    return _assigned(t, model, points, model.clusterCenters)


@query("mllib_gaussian_mixture", _groups_sql("round(avg(l_quantity), 2) AS mean, round(var_pop(l_quantity), 2) AS variance, round(covar_pop(l_quantity, discount), 3) AS cross, round(count(*) / (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 8 OR l_quantity BETWEEN 43 AND 50), 3) AS weight", (1, 8), (43, 50)))
def mllib_gaussian_mixture(t: Tables) -> DataFrame:
    """Two groups so far apart that each row belongs to one: the components have their moments.

    It starts from the centres of k-means: from sampled rows it may stay where both components are wide.
    """
    points = _vectors(_groups(t, (1, 8), (43, 50)), "l_quantity", "discount")
    centres = K.KMeans.train(points, 2, maxIterations=30, seed=1).centers
    start = SimpleNamespace(k=2, weights=[0.5, 0.5], gaussians=[MultivariateGaussian(Vectors.dense(c), DenseMatrix(2, 2, [9.0, 0.0, 0.0, 1.0])) for c in centres])
    model = K.GaussianMixture.train(points, 2, convergenceTol=1e-9, maxIterations=60, initialModel=start)
    rows = [(round(float(g.mu[0]), 2), round(float(g.sigma[0, 0]), 2), round(float(g.sigma[0, 1]), 3), round(float(w), 3)) for g, w in zip(model.gaussians, model.weights)]
    return t.spark.createDataFrame(rows, "mean double, variance double, cross double, weight double")


_SCORED = "SELECT l_tax AS score, (l_returnflag = 'R')::INT AS label FROM lineitem"


@query("mllib_binary_metrics", f"""WITH s AS ({_SCORED}), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place FROM s)
SELECT round((sum(place) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1.0) / 2) / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)), 6) AS area FROM r""")
def mllib_binary_metrics(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_tax", (F.col("l_returnflag") == "R").cast("double")).rdd.map(tuple)
    return t.spark.createDataFrame([(round(E.BinaryClassificationMetrics(pairs).areaUnderROC, 6),)], "area double")


@query("mllib_multiclass_metrics", "SELECT round(avg((p = y)::INT), 6) AS accuracy, round(count(*) FILTER (p = 1 AND y = 1) / count(*) FILTER (p = 1), 6) AS precision, round(count(*) FILTER (p = 1 AND y = 1) / count(*) FILTER (y = 1), 6) AS recall FROM (SELECT (p_size % 3)::INT AS p, (p_partkey % 3)::INT AS y FROM part)")
def mllib_multiclass_metrics(t: Tables) -> DataFrame:
    m = E.MulticlassMetrics(t.part.selectExpr("double(p_size % 3)", "double(p_partkey % 3)").rdd.map(tuple))
    return t.spark.createDataFrame([(round(m.accuracy, 6), round(m.precision(1.0), 6), round(m.recall(1.0), 6))], "accuracy double, precision double, recall double")


@query("mllib_regression_metrics", "SELECT round(avg((p - y) ** 2), 4) AS mse, round(avg(abs(p - y)), 4) AS mae, round(1 - sum((p - y) ** 2) / sum((y - m) ** 2), 6) AS r2 FROM (SELECT p_size * 30.0::DOUBLE AS p, p_retailprice AS y, avg(p_retailprice) OVER () AS m FROM part)")
def mllib_regression_metrics(t: Tables) -> DataFrame:
    m = E.RegressionMetrics(t.part.selectExpr("p_size * 30D", "double(p_retailprice)").rdd.map(tuple))
    return t.spark.createDataFrame([(round(m.meanSquaredError, 4), round(m.meanAbsoluteError, 4), round(m.r2, 6))], "mse double, mae double, r2 double")


_RANKED = "SELECT list(DISTINCT n_nationkey ORDER BY n_nationkey DESC) AS pred, list(DISTINCT n_nationkey ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 0) AS truth FROM nation GROUP BY n_regionkey"


@query("mllib_ranking_metrics", f"WITH r AS ({_RANKED}) SELECT round(avg(len(list_intersect(pred[1:2], truth)) / 2.0), 6) AS precision_at_2, round(avg(len(list_intersect(pred[1:3], truth)) / 3.0), 6) AS precision_at_3 FROM r")
def mllib_ranking_metrics(t: Tables) -> DataFrame:
    rows = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_set("n_nationkey"), False).alias("pred"), F.collect_set(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"))).alias("truth"))
    m = E.RankingMetrics(rows.select("pred", "truth").rdd.map(lambda r: ([float(x) for x in r[0]], [float(x) for x in r[1]])))
    return t.spark.createDataFrame([(round(m.precisionAt(2), 6), round(m.precisionAt(3), 6))], "precision_at_2 double, precision_at_3 double")


@query("mllib_multilabel_metrics", f"WITH r AS ({_RANKED}), s AS (SELECT pred[1:3] AS pred, truth FROM r) SELECT round(avg(len(list_intersect(pred, truth)) / len(list_distinct(list_concat(pred, truth)))), 6) AS accuracy, round(avg(len(list_intersect(pred, truth)) / len(pred)), 6) AS precision, round(avg(len(list_intersect(pred, truth)) / len(truth)), 6) AS recall FROM s")
def mllib_multilabel_metrics(t: Tables) -> DataFrame:
    rows = t.nation.groupBy("n_regionkey").agg(F.slice(F.sort_array(F.collect_set("n_nationkey"), False), 1, 3).alias("pred"), F.collect_set(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"))).alias("truth"))
    m = E.MultilabelMetrics(rows.select("pred", "truth").rdd.map(lambda r: ([float(x) for x in r[0]], [float(x) for x in r[1]])))
    return t.spark.createDataFrame([(round(m.accuracy, 6), round(m.precision(), 6), round(m.recall(), 6))], "accuracy double, precision double, recall double")


@query("mllib_chi_selector", "SELECT sum(o_orderkey % 3)::DOUBLE AS kept FROM orders")
def mllib_chi_selector(t: Tables) -> DataFrame:
    """Of two features the one that the label depends on is kept."""
    rows = t.orders.selectExpr("o_orderkey % 3 AS label", "o_custkey % 5 AS a", "o_orderkey % 3 AS b")
    model = M.ChiSqSelector(numTopFeatures=1).fit(_points(rows, "label", "a", "b"))
    kept = model.transform(_vectors(rows, "a", "b")).map(lambda v: (float(v[0]),))
    return t.spark.createDataFrame(kept, "x double").agg(F.sum("x").alias("kept"))


@query("mllib_chi_square_test", "WITH c AS (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment), m AS (SELECT avg(n) AS e FROM c) SELECT round(sum((n - e) ** 2 / e), 6) AS statistic, (count(*) - 1)::INT AS freedom FROM c, m")
def mllib_chi_square_test(t: Tables) -> DataFrame:
    counts = [float(r.n) for r in t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")).collect()]  # a row per segment
    found = Statistics.chiSqTest(Vectors.dense(counts))
    return t.spark.createDataFrame([(round(found.statistic, 6), int(found.degreesOfFreedom))], "statistic double, freedom int")


# the normal distribution function of z by its series, which DuckDB can add up
PHI = "0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * sign(z) * list_sum(list_transform(range(0, 80), lambda k: CASE WHEN z = 0 THEN 0 ELSE exp((2 * k + 1) * ln(abs(z)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2) END))"


@query("mllib_kolmogorov_smirnov", f"SELECT round(max(greatest(i / n - f, f - (i - 1) / n)), 6) AS statistic, count(*) AS n FROM (SELECT {PHI} AS f, i, n FROM (SELECT (c_acctbal - 4500) / 3000 AS z, row_number() OVER (ORDER BY c_acctbal) AS i, count(*) OVER () AS n FROM customer))")
def mllib_kolmogorov_smirnov(t: Tables) -> DataFrame:
    """The largest distance of the balances from a normal distribution of given mean and deviation."""
    values = t.customer.select(F.col("c_acctbal").cast("double")).rdd.map(lambda r: r[0])
    found = Statistics.kolmogorovSmirnovTest(values, "norm", 4500.0, 3000.0)
    return t.spark.createDataFrame([(round(found.statistic, 6), t.customer.count())], "statistic double, n long")


@query("mllib_idf", "SELECT round(ln((count(*) + 1.0) / (count(*) FILTER (p_size > 40) + 1)), 6) AS a, round(ln((count(*) + 1.0) / (count(*) FILTER (p_size > 10) + 1)), 6) AS b FROM part")
def mllib_idf(t: Tables) -> DataFrame:
    idf = M.IDF().fit(_vectors(t.part.selectExpr("p_size > 40 AS a", "p_size > 10 AS b"), "a", "b")).idf()
    return t.spark.createDataFrame([(round(float(idf[0]), 6), round(float(idf[1]), 6))], "a double, b double")


@query("mllib_pca", "SELECT round((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b ** 2), 3) AS variance FROM (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_tax * 100) AS b, var_samp(l_tax * 100) AS c FROM lineitem)")
def mllib_pca(t: Tables) -> DataFrame:
    """The variance along the first component is the larger eigenvalue of the covariance."""
    rows = _vectors(t.lineitem.selectExpr("l_quantity", "l_tax * 100 AS tax"), "l_quantity", "tax")
    along = M.PCA(1).fit(rows).transform(rows).map(lambda v: (float(v[0]),))
    return t.spark.createDataFrame(along, "x double").agg(F.round(F.var_samp("x"), 3).alias("variance"))


@query("mllib_standard_scaler", "SELECT round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS deviation FROM customer")
def mllib_standard_scaler(t: Tables) -> DataFrame:
    model = M.StandardScaler(withMean=True, withStd=True).fit(_vectors(t.customer, "c_acctbal"))
    return t.spark.createDataFrame([(round(float(model.mean[0]), 4), round(float(model.std[0]), 4))], "mean double, deviation double")


@query("mllib_normalizer_product", "SELECT round(sum(2 * p_size / length), 4) AS a, round(sum(3 * p_retailprice / length), 4) AS b, round(sum((p_size / length) ** 2 + (p_retailprice / length) ** 2), 4) AS squares FROM (SELECT p_size, p_retailprice, sqrt(p_size ** 2 + p_retailprice ** 2) AS length FROM part)")
def mllib_normalizer_product(t: Tables) -> DataFrame:
    """Vectors brought to length one, then each component times its own factor."""
    unit = M.Normalizer().transform(_vectors(t.part, "p_size", "p_retailprice"))
    found = M.ElementwiseProduct(Vectors.dense([2.0, 3.0])).transform(unit).map(lambda v: (float(v[0]), float(v[1])))
    squares = (F.col("a") / 2) ** 2 + (F.col("b") / 3) ** 2
    return t.spark.createDataFrame(found, "a double, b double").agg(F.round(F.sum("a"), 4).alias("a"), F.round(F.sum("b"), 4).alias("b"), F.round(F.sum(squares), 4).alias("squares"))


@query("mllib_hashing_tf", "SELECT sum(len(string_split(n_name, ' ')))::DOUBLE AS n FROM nation")
def mllib_hashing_tf(t: Tables) -> DataFrame:
    tf = M.HashingTF(1 << 12).transform(t.nation.select(F.split("n_name", " ")).rdd.map(lambda r: r[0])).map(lambda v: (float(v.toArray().sum()),))
    return t.spark.createDataFrame(tf, "x double").agg(F.sum("x").alias("n"))


@query("mllib_coordinate_matrix", "SELECT o_custkey % 7 AS i, count(*)::DOUBLE AS n FROM orders GROUP BY 1")
def mllib_coordinate_matrix(t: Tables) -> DataFrame:
    entries = t.orders.selectExpr("o_custkey % 7", "o_orderkey").rdd.map(lambda r: MatrixEntry(r[1], r[0], 1.0))
    back = CoordinateMatrix(entries).transpose().entries.map(lambda e: (e.i, float(e.value)))
    return t.spark.createDataFrame(back, "i long, x double").groupBy("i").agg(F.sum("x").alias("n"))


@query("mllib_indexed_row_matrix", "SELECT sum(p_size * p_size)::DOUBLE AS a, round(sum(p_size * p_retailprice), 2) AS b FROM part")
def mllib_indexed_row_matrix(t: Tables) -> DataFrame:
    rows = t.part.selectExpr("p_partkey", "double(p_size)", "double(p_retailprice)").rdd.map(lambda r: IndexedRow(r[0], [r[1], r[2]]))
    gram = IndexedRowMatrix(rows).computeGramianMatrix().toArray()
    return t.spark.createDataFrame([(float(gram[0][0]), round(float(gram[0][1]), 2))], "a double, b double")


@query("mllib_kernel_density", "SELECT round(avg(exp(-0.5 * ((10 - p_size) / 3.0) ** 2) / (3.0 * sqrt(2 * pi()))), 8) AS at_10, round(avg(exp(-0.5 * ((40 - p_size) / 3.0) ** 2) / (3.0 * sqrt(2 * pi()))), 8) AS at_40 FROM part")
def mllib_kernel_density(t: Tables) -> DataFrame:
    density = KernelDensity()
    density.setSample(t.part.select(F.col("p_size").cast("double")).rdd.map(lambda r: r[0]))
    density.setBandwidth(3.0)
    a, b = density.estimate([10.0, 40.0])
    return t.spark.createDataFrame([(round(float(a), 8), round(float(b), 8))], "at_10 double, at_40 double")


@query("mllib_linear_data", "SELECT count(*)::INT AS n, count(*)::INT AS on_the_line FROM part")
def mllib_linear_data(t: Tables) -> DataFrame:
    """As many generated points as there are parts, made in the tasks; without noise all lie on the line a fit finds."""
    from pyspark.ml.linalg import Vectors as NewVectors
    from pyspark.ml.regression import LinearRegression
    from pyspark.mllib.util import LinearDataGenerator

    points = LinearDataGenerator.generateLinearRDD(t.spark.sparkContext, t.part.count(), 2, 0.0, intercept=2.0)
    rows = reliable(points.map(lambda p: (float(p.label), NewVectors.dense(p.features.toArray()))).toDF(["label", "features"]))
    fitted = LinearRegression(solver="normal").fit(rows).transform(rows)
    return fitted.agg(F.count("*").cast("int").alias("n"), F.sum((F.abs(F.col("label") - F.col("prediction")) < 1e-6).cast("int")).cast("int").alias("on_the_line"))
