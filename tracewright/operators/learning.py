"""Machine learning through pyspark.ml, checked by quality or by exact sums."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import evaluation as E
from pyspark.ml import feature as M
from pyspark.ml import fpm, recommendation, regression, stat, tuning
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import reliable
from ..registry import query
from ..sources.tables import Tables
from .mllib import PHI


_PRICES = "floor(o_totalprice / 50000) / 2"


def _line(t: Tables) -> DataFrame:
    """Lines with a target that is linear in the quantity."""
    rows = t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_extendedprice").where("l_quantity > 0")
    return M.VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(rows).withColumn("label", F.col("l_quantity") * 3 + 5)


def _two(t: Tables) -> DataFrame:
    """Two classes that a threshold on the price class separates."""
    rows = t.orders.select(F.expr(_PRICES).cast("double").alias("x"), F.lit(1.0).alias("y"))
    return M.VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows).withColumn("label", (F.col("x") > 2).cast("double"))


def _kept(df: DataFrame, run) -> DataFrame:
    """Caches the rows while a model is fitted; the result is a few rows, brought home before they are let go."""
    df = df.cache()
    try:
        found = run(df)
        return df.sparkSession.createDataFrame(found.collect(), found.schema)  # an aggregate by class or quantity
    finally:
        df.unpersist()


_GOOD = "SELECT true AS good"
_CLASSES = f"SELECT ({_PRICES} > 2)::INT::DOUBLE AS prediction, count(*) AS n, count(*) AS correct FROM orders GROUP BY 1"


def _classifier(name: str, make) -> None:
    """Rows by predicted class, and how many of them are right: all, as the classes can be told apart."""

    def run(d: DataFrame) -> DataFrame:
        return make().fit(d).transform(d).groupBy("prediction").agg(F.count("*").alias("n"), F.count(F.when(F.col("prediction") == F.col("label"), 1)).alias("correct"))

    query(f"ml_{name}", _CLASSES)(lambda t: _kept(_two(t), run))


_classifier("logistic_regression", lambda: C.LogisticRegression(maxIter=60))
_classifier("decision_tree", lambda: C.DecisionTreeClassifier(maxDepth=3))
_classifier("random_forest", lambda: C.RandomForestClassifier(numTrees=5, seed=1, featureSubsetStrategy="all"))
_classifier("gbt", lambda: C.GBTClassifier(maxIter=3, seed=1))
_classifier("linear_svc", lambda: C.LinearSVC(maxIter=100))
_classifier("mlp", lambda: C.MultilayerPerceptronClassifier(layers=[2, 4, 2], maxIter=200, seed=1))
_classifier("one_vs_rest", lambda: C.OneVsRest(classifier=C.LogisticRegression(maxIter=60)))


@query(
    "ml_naive_bayes",
    """WITH p AS (SELECT p_partkey, p_size AS a, 50 - p_size AS b, (p_size > 25)::INT AS y FROM part),
    m AS (SELECT y, ln((count(*) + 1.0) / ((SELECT count(*) FROM p) + 2)) AS prior, ln((sum(a) + 1.0) / (sum(a + b) + 2)) AS ta, ln((sum(b) + 1.0) / (sum(a + b) + 2)) AS tb FROM p GROUP BY y),
    best AS (SELECT p_partkey, p.y AS label, arg_max(m.y, prior + a * ta + b * tb) AS predicted FROM p, m GROUP BY 1, 2)
    SELECT label, predicted, count(*) AS n, round(any_value(prior), 6) AS prior FROM best JOIN m ON m.y = label GROUP BY 1, 2""",
)
def ml_naive_bayes(t: Tables) -> DataFrame:
    """A smoothed multinomial model of two counts: its priors, and what it predicts for every part."""
    parts = t.part.select("p_size", (50 - F.col("p_size")).alias("rest"), (F.col("p_size") > 25).cast("double").alias("label"))
    rows = M.VectorAssembler(inputCols=["p_size", "rest"], outputCol="features").transform(parts)
    model = C.NaiveBayes(smoothing=1.0).fit(rows)
    prior = t.spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(model.pi)], "label int, prior double")  # two classes
    found = model.transform(rows).groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return found.join(F.broadcast(prior), "label")


_LINE = "SELECT l_quantity, round(3 * l_quantity + 5, 2) AS predicted FROM lineitem WHERE l_quantity > 0 GROUP BY l_quantity"


def _regressor(name: str, make) -> None:
    """The mean prediction for each quantity, which lies on the line."""

    def run(d: DataFrame) -> DataFrame:
        return make().fit(d).transform(d).groupBy("l_quantity").agg(F.round(F.avg("prediction"), 2).alias("predicted"))

    query(f"ml_{name}", _LINE)(lambda t: _kept(_line(t), run))


_regressor("linear_regression", lambda: regression.LinearRegression())
_regressor("glm", lambda: regression.GeneralizedLinearRegression(family="gaussian", link="identity"))
_regressor("isotonic", lambda: regression.IsotonicRegression(featureIndex=0))
_regressor("tree_regression", lambda: regression.DecisionTreeRegressor(maxDepth=9, maxBins=64))


@query("ml_glm_poisson", "SELECT o_orderstatus, round(avg(n), 4) AS mean FROM (SELECT o_orderstatus, length(o_orderpriority)::DOUBLE AS n FROM orders) GROUP BY 1")
def ml_glm_poisson(t: Tables) -> DataFrame:
    """A Poisson model on one category fits the category's mean."""
    rows = M.RFormula(formula="n ~ o_orderstatus").fit(d := t.orders.select("o_orderstatus", F.length("o_orderpriority").cast("double").alias("n"))).transform(d)
    found = regression.GeneralizedLinearRegression(family="poisson", link="log", maxIter=50, tol=1e-10).fit(rows).transform(rows)
    return found.groupBy("o_orderstatus").agg(F.round(F.avg("prediction"), 4).alias("mean"))


def _close(name: str, make, most: float) -> None:
    def run(d: DataFrame) -> DataFrame:
        return make().fit(d).transform(d).agg(F.count(F.when(F.abs(F.col("prediction") - F.col("label")) <= most, 1)).alias("close"))

    query(f"ml_{name}", "SELECT count(*) AS close FROM lineitem WHERE l_quantity > 0")(lambda t: _kept(_line(t), run))


_close("forest_regression", lambda: regression.RandomForestRegressor(numTrees=5, seed=1, featureSubsetStrategy="all", maxDepth=8, maxBins=64), 30.0)


def weighted(rows: DataFrame) -> DataFrame:
    """Each different pair of features and label once, with the number of its rows."""
    return rows.groupBy("features", "label").agg(F.count("*").cast("double").alias("weight"))


@query("ml_gbt_regression", "SELECT count(*) AS close FROM lineitem WHERE l_quantity > 0")
def ml_gbt_regression(t: Tables) -> DataFrame:
    """Boosting takes a row of weight n as n equal rows, so equal lines are one row in each of its passes."""

    def run(d: DataFrame) -> DataFrame:
        model = regression.GBTRegressor(maxIter=10, seed=1, maxBins=64, weightCol="weight").fit(d)
        near = F.abs(F.col("prediction") - F.col("label")) <= 30.0
        return model.transform(d).agg(F.coalesce(F.sum(F.when(near, F.col("weight").cast("long"))), F.lit(0)).alias("close"))

    return _kept(reliable(weighted(_line(t))), run)  # few rows, in few partitions


@query("ml_survival", _GOOD)
def ml_survival(t: Tables) -> DataFrame:
    d = _line(t).withColumn("censor", F.lit(1.0)).withColumn("label", F.exp(F.col("l_quantity") / 50))
    d = M.VectorAssembler(inputCols=["l_quantity"], outputCol="f").transform(d.drop("features")).withColumnRenamed("f", "features")
    slope = regression.AFTSurvivalRegression(maxIter=20).fit(d).coefficients[0]
    return t.spark.createDataFrame([(bool(abs(slope - 0.02) < 0.005),)], "good boolean")


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _clusterer(name: str, make) -> None:
    """How many vectors got the centre that is nearest to them, and the clusters' sizes together: all of them."""

    def run(d: DataFrame) -> DataFrame:
        model = make().fit(d)
        centres = [c.tolist() for c in model.clusterCenters()]
        x = vector_to_array("features")
        far = F.array(*[F.aggregate(F.zip_with(x, F.lit(c), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda p, q: p + q) for c in centres])
        told = model.transform(d).select(F.get(far, F.col("prediction")).alias("own"), F.array_min(far).alias("least"))
        return told.agg(F.count(F.when(F.col("own") <= F.col("least") + 1e-6, 1)).alias("nearest"), F.lit(sum(model.summary.clusterSizes)).cast("long").alias("n"))

    query(f"ml_{name}", "SELECT count(*) AS nearest, count(*) AS n FROM embeddings")(lambda t: _kept(_vectors(t), run))


_clusterer("kmeans", lambda: K.KMeans(k=10, seed=1, maxIter=5))


@query("ml_bisecting_kmeans", "SELECT count(*) AS n, count(*) AS told FROM embeddings")
def ml_bisecting_kmeans(t: Tables) -> DataFrame:
    """The summary's sizes are those of the clusters that the model tells."""

    def run(d: DataFrame) -> DataFrame:
        model = K.BisectingKMeans(k=5, seed=1, maxIter=3).fit(d)
        sizes = F.array(*[F.lit(n) for n in model.summary.clusterSizes])
        by = model.transform(d).groupBy("prediction").agg(F.count("*").alias("k"))
        return by.agg(F.lit(sum(model.summary.clusterSizes)).cast("long").alias("n"), F.sum(F.least("k", F.get(sizes, F.col("prediction")))).alias("told"))

    return _kept(_vectors(t), run)


@query("ml_gaussian_mixture", f"SELECT round(avg(x), 4) AS mean FROM (SELECT ({_PRICES})::DOUBLE AS x FROM orders)")
def ml_gaussian_mixture(t: Tables) -> DataFrame:
    """The means of the parts, weighted, give the mean of all rows."""
    rows = M.VectorAssembler(inputCols=["x"], outputCol="features").transform(t.orders.select(F.expr(_PRICES).cast("double").alias("x")))
    model = K.GaussianMixture(k=2, seed=1, maxIter=20).fit(rows)
    mean = sum(w * g.mean[0] for w, g in zip(model.weights, model.gaussians, strict=True))
    return t.spark.createDataFrame([(round(float(mean), 4),)], "mean double")


def _words(t: Tables) -> DataFrame:
    return M.RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+").transform(t.conversations.select("conv_id", "turn", "text"))


@query("ml_lda", "SELECT count(*) AS n, count(*) AS proper FROM conversations")
def ml_lda(t: Tables) -> DataFrame:
    """Every turn gets shares of three topics that add up to one (to nothing where it has no known word)."""
    counts = M.CountVectorizer(inputCol="words", outputCol="features", vocabSize=200).fit(_words(t)).transform(_words(t))
    shares = K.LDA(k=3, maxIter=3, seed=1).fit(counts).transform(counts).select(vector_to_array("topicDistribution").alias("s"), F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x).alias("known"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    proper = (F.size("s") == 3) & F.forall("s", lambda x: x >= 0) & (F.abs(total - (F.col("known") > 0).cast("double")) < 1e-6)
    return shares.agg(F.count("*").alias("n"), F.count_if(proper).alias("proper"))


@query("ml_als", "SELECT count(*) AS n, count(*) AS recovered FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def ml_als(t: Tables) -> DataFrame:
    """Ratings that are a product of a customer's and a part's number are found again by one factor."""
    met = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")).distinct()
    return recovered(met.withColumn("rating", (1 + F.col("user") % 3) * (1 + F.col("item") % 4) / 4.0))


BLOCK_RATINGS = 1_000_000  # ratings that a task of ALS holds at once
MOST_ROUNDS = 160


def recovered(ratings: DataFrame, rounds: int = 10) -> DataFrame:
    """How many ratings (user, item, rating) a model of one factor gives back.

    Its random start, which differs with the partitions, can take more rounds than usual, so
    they are doubled until no rating is missed or `MOST_ROUNDS` are made; blocks grow in number with the ratings.
    """
    d = reliable(ratings)
    blocks = max(10, -(-d.count() // BLOCK_RATINGS))
    while True:
        als = recommendation.ALS(rank=1, maxIter=rounds, regParam=1e-6, seed=1, numUserBlocks=blocks, numItemBlocks=blocks, intermediateStorageLevel="DISK_ONLY", finalStorageLevel="DISK_ONLY")
        found = als.fit(d).transform(d).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("prediction") - F.col("rating")) < 0.01).alias("recovered"))
        n, right = found.first()
        if n == right or 2 * rounds > MOST_ROUNDS:
            return d.sparkSession.createDataFrame([(n, right)], found.schema)  # one row
        rounds *= 2


@query("ml_text_features", "SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda x: length(x) >= 1))::DOUBLE AS n FROM conversations")
def ml_text_features(t: Tables) -> DataFrame:
    tf = M.HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 12).transform(_words(t))
    return tf.select("conv_id", "turn", F.aggregate(vector_to_array("tf"), F.lit(0.0), lambda a, x: a + x).alias("n"))


_PLAIN = "list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda x: length(x) >= 1)"


@query("ml_idf", f"WITH d AS (SELECT list_distinct({_PLAIN}) AS w FROM conversations), n AS (SELECT count(*) AS n FROM d) SELECT word, round(ln((n + 1.0) / (count(*) + 1)), 6) AS idf FROM (SELECT unnest(w) AS word FROM d), n GROUP BY word, n HAVING count(*) >= 20")
def ml_idf(t: Tables) -> DataFrame:
    """Inverse document frequencies of a counted vocabulary."""
    d = _words(t)
    counter = M.CountVectorizer(inputCol="words", outputCol="tf", minDF=20.0, vocabSize=1 << 18).fit(d)
    idf = M.IDF(inputCol="tf", outputCol="idf").fit(counter.transform(d)).idf
    return t.spark.createDataFrame([(w, round(float(x), 6)) for w, x in zip(counter.vocabulary, idf, strict=True)], "word string, idf double")


_STOP = ["the", "a", "of", "and", "to"]


@query("ml_stopwords_ngram", f"SELECT conv_id, turn, len(w)::INT AS kept, greatest(len(w) - 1, 0)::INT AS pairs FROM (SELECT conv_id, turn, list_filter({_PLAIN}, lambda x: x NOT IN ('the', 'a', 'of', 'and', 'to')) AS w FROM conversations)")
def ml_stopwords_ngram(t: Tables) -> DataFrame:
    d = M.StopWordsRemover(inputCol="words", outputCol="kept", stopWords=_STOP).transform(_words(t))
    return M.NGram(n=2, inputCol="kept", outputCol="pairs").transform(d).select("conv_id", "turn", F.size("kept").alias("kept"), F.size("pairs").alias("pairs"))


@query("ml_tokenizer", "SELECT n_nationkey, len(string_split(lower(n_name), ' '))::INT AS n, string_split(lower(n_name), ' ')[1] AS first FROM nation")
def ml_tokenizer(t: Tables) -> DataFrame:
    d = M.Tokenizer(inputCol="n_name", outputCol="w").transform(t.nation)
    return d.select("n_nationkey", F.size("w").alias("n"), F.col("w")[0].alias("first"))


@query("ml_scalers", "SELECT round(min(x), 6) AS low, round(max(x), 6) AS high FROM (SELECT (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS x FROM customer)")
def ml_scalers(t: Tables) -> DataFrame:
    d = M.VectorAssembler(inputCols=["c_acctbal"], outputCol="v").transform(t.customer.select("c_acctbal"))
    steps = [M.MinMaxScaler(inputCol="v", outputCol="a"), M.MaxAbsScaler(inputCol="v", outputCol="b"), M.StandardScaler(inputCol="v", outputCol="c", withMean=True), M.Normalizer(inputCol="v", outputCol="d")]
    x = vector_to_array("a")[0]
    return Pipeline(stages=steps).fit(d).transform(d).agg(F.round(F.min(x), 6).alias("low"), F.round(F.max(x), 6).alias("high"))


@query("ml_bucketizers", "SELECT b::DOUBLE AS b, count(*) AS n FROM (SELECT CASE WHEN p_size < 10 THEN 0 WHEN p_size < 25 THEN 1 ELSE 2 END AS b FROM part) GROUP BY b")
def ml_bucketizers(t: Tables) -> DataFrame:
    d = t.part.select(F.col("p_size").cast("double").alias("x"))
    d = M.Bucketizer(splits=[float("-inf"), 10, 25, float("inf")], inputCol="x", outputCol="b").transform(d)
    d = M.Binarizer(threshold=20, inputCol="x", outputCol="c").transform(d)
    return d.groupBy("b").agg(F.count("*").alias("n"))


@query(
    "ml_quantile_discretizer",
    """WITH o AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders),
    splits AS (SELECT x AS split FROM o WHERE i IN (ceil(n * 0.25), ceil(n * 0.5), ceil(n * 0.75)))
    SELECT (SELECT count(*) FROM splits WHERE split <= x)::DOUBLE AS q, count(*) AS n, min(x) AS low, max(x) AS high FROM o GROUP BY 1""",
)
def ml_quantile_discretizer(t: Tables) -> DataFrame:
    """Quarters of the prices, cut at exact quantiles."""
    d = M.QuantileDiscretizer(numBuckets=4, inputCol="o_totalprice", outputCol="q", relativeError=0.0).fit(t.orders).transform(t.orders)
    return d.groupBy("q").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("ml_index_encode", "SELECT c_mktsegment, (row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1)::DOUBLE AS i FROM customer GROUP BY c_mktsegment")
def ml_index_encode(t: Tables) -> DataFrame:
    d = t.customer.select("c_mktsegment")
    out = Pipeline(stages=[M.StringIndexer(inputCol="c_mktsegment", outputCol="i"), M.OneHotEncoder(inputCol="i", outputCol="h")]).fit(d).transform(d)
    return out.select("c_mktsegment", "i").distinct()


@query("ml_vector_transforms", "SELECT p_partkey, p_size * p_size::DOUBLE AS squared, p_size * 2.0::DOUBLE AS scaled FROM part")
def ml_vector_transforms(t: Tables) -> DataFrame:
    d = M.VectorAssembler(inputCols=["p_size"], outputCol="v").transform(t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size")))
    d = M.PolynomialExpansion(degree=2, inputCol="v", outputCol="p").transform(d)
    d = M.ElementwiseProduct(scalingVec=Vectors.dense([2.0]), inputCol="v", outputCol="e").transform(d)
    d = M.VectorSlicer(inputCol="p", outputCol="s", indices=[1]).transform(d)
    return d.select("p_partkey", vector_to_array("s")[0].alias("squared"), vector_to_array("e")[0].alias("scaled"))


@query("ml_interaction_formula", "SELECT p_partkey, (p_size * p_size)::DOUBLE AS first, (p_size * p_size + CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN p_size ELSE 0 END)::DOUBLE AS shown FROM part")
def ml_interaction_formula(t: Tables) -> DataFrame:
    """The size times what the formula makes of the size and of whether the brand is the first one."""
    brand = t.part.agg(F.min("p_brand")).first()[0]
    d = t.part.select("p_partkey", "p_retailprice", "p_size", (F.col("p_brand") == brand).cast("double").alias("own"))
    d = M.RFormula(formula="p_retailprice ~ p_size + own").fit(d).transform(d)
    d = M.VectorAssembler(inputCols=["p_size"], outputCol="a").transform(d)
    x = vector_to_array("x")
    return M.Interaction(inputCols=["a", "features"], outputCol="x").transform(d).select("p_partkey", x[0].alias("first"), (x[0] + x[1]).alias("shown"))


@query("ml_pca", "SELECT round(greatest(u, v) / (u + v), 6) AS share FROM (SELECT (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b ** 2) AS u, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b ** 2) AS v FROM (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_tax * 100) AS b, var_samp(l_tax * 100) AS c FROM lineitem))")
def ml_pca(t: Tables) -> DataFrame:
    """The share of the variance along the first of two components."""
    d = M.VectorAssembler(inputCols=["l_quantity", "tax"], outputCol="v").transform(t.lineitem.selectExpr("l_quantity", "l_tax * 100 AS tax"))
    return t.spark.createDataFrame([(round(float(M.PCA(k=2, inputCol="v", outputCol="p").fit(d).explainedVariance[0]), 6),)], "share double")


@query("ml_dct", "SELECT vec_id, round((e[1] + e[2]) / sqrt(2.0), 5) AS a, round((e[1] - e[2]) / sqrt(2.0), 5) AS b FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def ml_dct(t: Tables) -> DataFrame:
    """The cosine transform of two numbers is their sum and difference, scaled."""
    e = F.col("embedding").cast("array<double>")
    d = t.embeddings.select("vec_id", array_to_vector(F.slice(e, 1, 2)).alias("v"))
    x = vector_to_array("c")
    return M.DCT(inputCol="v", outputCol="c").transform(d).select("vec_id", F.round(x[0], 5).alias("a"), F.round(x[1], 5).alias("b"))


def _chi_square_sql(column: str) -> str:
    return f"(SELECT sum((coalesce(k, 0) - e) ** 2 / e) FROM (SELECT a.v, b.v AS w, a.k * b.k / (SELECT count(*) FROM d) AS e FROM (SELECT {column} AS v, count(*) AS k FROM d GROUP BY 1) a, (SELECT y AS v, count(*) AS k FROM d GROUP BY 1) b) LEFT JOIN (SELECT {column} AS v, y AS w, count(*) AS k FROM d GROUP BY 1, 2) USING (v, w))"


@query("ml_chi_square", f"WITH d AS (SELECT o_orderkey % 3 AS a, o_orderstatus = 'F' AS b, o_custkey % 3 AS y FROM orders) SELECT round({_chi_square_sql('a')}, 6) AS a, round({_chi_square_sql('b')}, 6) AS b, 4 AS freedom_a, 2 AS freedom_b")
def ml_chi_square(t: Tables) -> DataFrame:
    """The statistics of two columns against a third."""
    d = t.orders.select((F.col("o_orderkey") % 3).cast("double").alias("a"), (F.col("o_orderstatus") == "F").cast("double").alias("b"), (F.col("o_custkey") % 3).cast("double").alias("label"))
    found = stat.ChiSquareTest.test(M.VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(d), "f", "label")
    s = vector_to_array("statistics")
    return found.select(F.round(s[0], 6).alias("a"), F.round(s[1], 6).alias("b"), F.col("degreesOfFreedom")[0].alias("freedom_a"), F.col("degreesOfFreedom")[1].alias("freedom_b"))


@query("ml_kolmogorov_smirnov", f"SELECT round(max(greatest(i / n - f, f - (i - 1) / n)), 6) AS statistic FROM (SELECT {PHI} AS f, i, n FROM (SELECT (p_retailprice - 1000) / 300 AS z, row_number() OVER (ORDER BY p_retailprice) AS i, count(*) OVER () AS n FROM part))")
def ml_kolmogorov_smirnov(t: Tables) -> DataFrame:
    """The largest distance of the prices from a normal distribution of given mean and deviation."""
    return stat.KolmogorovSmirnovTest.test(t.part, "p_retailprice", "norm", 1000.0, 300.0).select(F.round("statistic", 6).alias("statistic"))


@query("ml_word2vec", "SELECT count(*) AS n, count(*) AS averaged FROM conversations")
def ml_word2vec(t: Tables) -> DataFrame:
    """The vector of a turn is the mean of its words' vectors, words outside the vocabulary counting as zeros."""
    words = _words(t).withColumn("id", F.struct("conv_id", "turn"))
    model = M.Word2Vec(vectorSize=8, minCount=5, maxIter=1, seed=1, inputCol="words", outputCol="v").fit(words)
    first = model.getVectors().select("word", vector_to_array("vector")[0].alias("x"))
    means = words.select("id", F.explode("words").alias("word")).join(first, "word").groupBy("id").agg(F.sum("x").alias("x"))
    both = model.transform(words).select("id", vector_to_array("v").alias("v"), F.size("words").alias("k")).join(means, "id", "left")
    same = (F.size("v") == 8) & (F.abs(F.col("v")[0] - F.coalesce(F.col("x") / F.greatest("k", F.lit(1)), F.lit(0.0))) < 1e-5)
    return both.agg(F.count("*").alias("n"), F.count_if(same).alias("averaged"))


_EQUAL_SETS = f"SELECT list_sort(list_distinct({_PLAIN})) AS w FROM conversations"


@query("ml_minhash_lsh", f"WITH s AS ({_EQUAL_SETS}) SELECT count(*) AS pairs FROM (SELECT w, count(*) AS n FROM s WHERE len(w) > 0 GROUP BY w), range(n * (n - 1) // 2)")
def ml_minhash_lsh(t: Tables) -> DataFrame:
    """Equal word sets always meet: their hashes are equal."""
    return equal_set_pairs(_words(t).where("size(words) > 0"))


def equal_set_pairs(d: DataFrame, tables: int = 8) -> DataFrame:
    """Pairs of rows (words) whose word sets are equal and whose hashes are equal in every table.

    One table's hash alone brings together all sets that share a frequent word, so the rows
    meet by all hashes at once.  Rows of one set are a class with its size, not pairs.
    """
    sets = M.HashingTF(inputCol="words", outputCol="features", binary=True, numFeatures=1 << 18).transform(d)
    hashed = M.MinHashLSH(inputCol="features", outputCol="h", numHashTables=tables, seed=1).fit(sets).transform(sets)
    hashes = F.array(*[vector_to_array(F.col("h")[i])[0] for i in range(tables)])
    classes = hashed.groupBy(hashes.alias("h"), F.array_sort(F.array_distinct("words")).alias("w")).agg(F.count("*").alias("n"))
    return classes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))


@query("ml_projection_lsh", "SELECT count(*) AS pairs FROM (SELECT embedding, count(*) AS n FROM embeddings GROUP BY embedding), range(n * (n - 1) // 2)")
def ml_projection_lsh(t: Tables) -> DataFrame:
    """Equal vectors always meet in the similarity join."""
    d = _vectors(t)
    model = M.BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=0.001, numHashTables=1, seed=1).fit(d)
    return model.approxSimilarityJoin(d, d, 1e-9).where("datasetA.vec_id < datasetB.vec_id").agg(F.count("*").alias("pairs"))


_BASKETS = "SELECT DISTINCT user_id, event_type AS item FROM events"


@query("ml_fp_growth", f"WITH b AS ({_BASKETS}), n AS (SELECT 0.1 * count(DISTINCT user_id) AS least FROM events), found AS (SELECT item AS items, count(*) AS freq FROM b GROUP BY 1 UNION ALL SELECT x.item || ' ' || y.item, count(*) FROM b x JOIN b y ON x.user_id = y.user_id AND x.item < y.item GROUP BY 1) SELECT items, freq FROM found, n WHERE freq >= least")
def ml_fp_growth(t: Tables) -> DataFrame:
    """Frequent sets of one and two items."""
    baskets = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("items"))
    found = fpm.FPGrowth(minSupport=0.1, minConfidence=0.5).fit(baskets).freqItemsets
    return found.where("size(items) < 3").select(F.array_join(F.array_sort("items"), " ").alias("items"), "freq")


@query("ml_association_rules", f"WITH b AS ({_BASKETS}), one AS (SELECT item, count(*) AS n FROM b GROUP BY 1), two AS (SELECT x.item AS a, y.item AS c, count(*) AS n FROM b x JOIN b y ON x.user_id = y.user_id AND x.item <> y.item GROUP BY 1, 2) SELECT a AS antecedent, c AS consequent, round(two.n / one.n, 6) AS confidence FROM two JOIN one ON one.item = a WHERE two.n >= 0.1 * (SELECT count(DISTINCT user_id) FROM events) AND two.n / one.n >= 0.5")
def ml_association_rules(t: Tables) -> DataFrame:
    baskets = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("items"))
    rules = fpm.FPGrowth(minSupport=0.1, minConfidence=0.5).fit(baskets).associationRules.where("size(antecedent) = 1")
    return rules.select(F.col("antecedent")[0].alias("antecedent"), F.col("consequent")[0].alias("consequent"), F.round("confidence", 6).alias("confidence"))


@query("ml_prefix_span", """WITH s AS (SELECT user_id, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS p FROM events),
f AS (SELECT user_id, item, min(p) AS first, max(p) AS last FROM s GROUP BY 1, 2), n AS (SELECT 0.2 * count(DISTINCT user_id) AS least FROM events),
found AS (SELECT item AS pattern, count(*) AS freq FROM f GROUP BY 1 UNION ALL SELECT x.item || ' ' || y.item, count(*) FROM f x JOIN f y ON x.user_id = y.user_id AND x.first < y.last GROUP BY 1) SELECT pattern, freq FROM found, n WHERE freq >= least""")
def ml_prefix_span(t: Tables) -> DataFrame:
    """Frequent sequences of one and two events of a user."""
    steps = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_type"))).alias("s")).select(F.transform("s", lambda x: F.array(x["event_type"])).alias("sequence"))
    found = fpm.PrefixSpan(minSupport=0.2, maxPatternLength=2).findFrequentSequentialPatterns(steps)
    return found.select(F.array_join(F.flatten("sequence"), " ").alias("pattern"), "freq")


@query("ml_tuning", _CLASSES)
def ml_tuning(t: Tables) -> DataFrame:
    def run(d: DataFrame) -> DataFrame:
        lr = C.LogisticRegression(maxIter=60)
        grid = tuning.ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.5]).build()
        best = tuning.TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=E.BinaryClassificationEvaluator(), trainRatio=0.75, seed=1).fit(d)
        return best.transform(d).groupBy("prediction").agg(F.count("*").alias("n"), F.count(F.when(F.col("prediction") == F.col("label"), 1)).alias("correct"))

    return _kept(_two(t), run)


@query("ml_evaluators", "SELECT round(avg((p = y)::INT), 6) AS accuracy, round(avg((p - y) ** 2), 6) AS mse FROM (SELECT (p_size > 25)::INT AS p, (p_retailprice > 1400)::INT AS y FROM part)")
def ml_evaluators(t: Tables) -> DataFrame:
    p = t.part.select((F.col("p_size") > 25).cast("double").alias("prediction"), (F.col("p_retailprice") > 1400).cast("double").alias("label"))
    accuracy = E.MulticlassClassificationEvaluator(metricName="accuracy").evaluate(p)
    return t.spark.createDataFrame([(round(accuracy, 6), round(E.RegressionEvaluator(metricName="mse").evaluate(p), 6))], "accuracy double, mse double")


@query("ml_sql_transformer", "SELECT p_partkey, p_size + 1 AS more FROM part")
def ml_sql_transformer(t: Tables) -> DataFrame:
    return M.SQLTransformer(statement="SELECT p_partkey, p_size + 1 AS more FROM __THIS__").transform(t.part)


@query("ml_summarizer", "SELECT round(avg(c_acctbal), 6) AS mean, round(var_samp(c_acctbal), 4) AS variance FROM customer")
def ml_summarizer(t: Tables) -> DataFrame:
    d = M.VectorAssembler(inputCols=["c_acctbal"], outputCol="v").transform(t.customer)
    s = d.select(stat.Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s"))
    return s.select(F.round(vector_to_array("s.mean")[0], 6).alias("mean"), F.round(vector_to_array("s.variance")[0], 4).alias("variance"))


@query("ml_correlation_matrix", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def ml_correlation_matrix(t: Tables) -> DataFrame:
    d = M.VectorAssembler(inputCols=["l_quantity", "l_extendedprice"], outputCol="v").transform(t.lineitem)
    m = stat.Correlation.corr(d, "v").first()[0]
    return t.spark.createDataFrame([(round(float(m[0, 1]), 6),)], "r double")
