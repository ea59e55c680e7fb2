"""Models on pyspark.ml: fold-clean logistic regression, trees, k-means and routing; stand-ins for encoders and scorers."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.segment import best_windows
from rankloom.plans.session import cut


def _kept(rows: DataFrame) -> DataFrame:
    """rows written once, in as many parts as there are cores at most: what each of a fit's many jobs reads, and reports on, is
    the numbers alone and not the plan that made them."""
    return cut(rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism))


def logistic_oof(rows: DataFrame, features: list[str], c: float = 0.15, trees: bool = False, only: int | None = None) -> DataFrame:
    """rows (id, fold, label, features): (id, fold, score), each fold scored by a model of the others. Scaling is fitted
    on the training folds, classes are balanced, and the penalty is 1/(c * weight). only: the one fold to score."""
    rows = _kept(rows.select("id", "fold", "label", *features))
    data = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep").transform(rows.fillna(0.0, features)).select("id", "fold", "label", "raw")
    out = []
    for (held,) in data.select("fold").distinct().orderBy("fold").collect():
        if only is not None and held != only:
            continue
        train = data.where(F.col("fold") != held)
        n = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
        if len(n) < 2:
            continue
        total = sum(n.values())
        weight = F.when(F.col("label") == 1, total / (2.0 * n[1])).otherwise(total / (2.0 * n[0]))
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
        train = scaler.transform(train).withColumn("weight", weight)
        kind = GBTClassifier(featuresCol="x", weightCol="weight", maxIter=10, maxDepth=3, seed=276) if trees else LogisticRegression(featuresCol="x", weightCol="weight", regParam=1 / (c * total), maxIter=60, standardization=False)
        test = kind.fit(train).transform(scaler.transform(data.where(F.col("fold") == held)))
        out.append(test.select("id", "fold", vector_to_array("probability")[1].alias("score")))
    return reduce(DataFrame.unionByName, out)


def kmeans_profile(vectors: DataFrame, k: int = 8, seed: int = 2026) -> DataFrame:
    """(cluster, size)."""
    rows = vectors.select(array_to_vector("embedding").alias("features"))
    got = KMeans(k=k, seed=seed, distanceMeasure="cosine").fit(rows).transform(rows)
    return got.groupBy(F.col("prediction").cast("long").alias("cluster")).agg(F.count("*").alias("size"))


def hashed_encoding(tokens: Column, dims: int = 16, most: int = 512, pool: str = "mean") -> Column:
    """A stand-in encoder of the same contract: token vectors from a hash, cut to most tokens, pooled by mean or last
    token; zeros for an empty text. dims is 32 at most (hex digits)."""
    t = F.slice(tokens, 1, most) if pool == "mean" else F.slice(F.slice(tokens, 1, most), -1, 1)
    vec = lambda h: F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda j: F.conv(F.substring(h, j, F.lit(1)), 16, 10).cast("double") / 7.5 - 1)
    zero = F.array_repeat(F.lit(0.0), dims)
    total = F.aggregate(F.transform(t, lambda w: vec(F.md5(w))), zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return F.transform(total, lambda x: x / F.greatest(F.size(t), F.lit(1)))


def coverage_score(q: Column, passage: Column) -> Column:
    """A stand-in pair scorer: the share of the query's distinct terms in the passage."""
    return F.size(F.array_intersect(F.array_distinct(q), passage)) / F.greatest(F.size(F.array_distinct(q)), F.lit(1))


def best_passage_score(pairs: DataFrame, width: int, stride: int, scorer=coverage_score) -> DataFrame:
    """(qid, doc_id, score): the best of a pair scorer over the windows of d; scorer maps two array columns to a score. The
    windows of a pair are scored within its row."""
    rows = pairs.where(F.size("d") > 0)
    best = best_windows(F.col("d"), width, stride, 1, lambda w: scorer(F.col("q"), w))
    return rows.select("qid", "doc_id", F.element_at(best, 1)["score"].alias("score"))


def yes_no(logits: Column, yes: int, no: int) -> Column:
    """The score of an answer token pair: the difference of their logits."""
    return F.element_at(logits, yes + 1) - F.element_at(logits, no + 1)


def kmeans_by_silhouette(vectors: DataFrame, ks: tuple[int, ...] = (8, 12, 16, 24), sample: int = 1200, per_cluster: int = 5, seed: int = 2026) -> tuple[DataFrame, DataFrame]:
    """((k, silhouette, chosen), (cluster, nth, id)) for vectors (id, embedding): k of the best cosine silhouette over a
    bounded sample, and the members nearest to each of its centroids."""
    rows = vectors.select("id", array_to_vector("embedding").alias("features")).cache()
    part = rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).cache()
    found, models = [], {}
    for k in ks:
        models[k] = KMeans(k=k, seed=seed, distanceMeasure="cosine").fit(rows)
        got = models[k].transform(part)
        many = got.select("prediction").distinct().count() > 1
        found.append((k, float(ClusteringEvaluator(distanceMeasure="cosine").evaluate(got)) if many else -1.0))
    best = max(found, key=lambda x: (x[1], -x[0]))[0]
    spark = vectors.sparkSession
    centre = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(models[best].clusterCenters())], "cluster int, centre array<double>")
    at = models[best].transform(rows).select("id", vector_to_array("features").alias("v"), F.col("prediction").alias("cluster")).join(F.broadcast(centre), "cluster")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    at = at.withColumn("cos", dot(F.col("v"), F.col("centre")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("centre"), F.col("centre"))))
    near = at.withColumn("nth", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("cos"), "id"))).where(F.col("nth") <= per_cluster)
    scores = spark.createDataFrame([(k, s, k == best) for k, s in found], "k long, silhouette double, chosen boolean")
    return scores, near.select(F.col("cluster").cast("long").alias("cluster"), F.col("nth").cast("long").alias("nth"), "id")


def nested_priors(rows: DataFrame, features: list[str], outer: int, c: float = 0.15) -> DataFrame:
    """(id, fold, role, score) for one outer fold: inner scores of its training folds, each by a model of the other
    training folds, and outer scores of the held fold by a model of them all. No row scores itself."""
    inner = logistic_oof(rows.where(F.col("fold") != outer), features, c)
    held = logistic_oof(rows.withColumn("fold", F.when(F.col("fold") == outer, outer).otherwise(-1)), features, c, only=outer)
    return inner.withColumn("role", F.lit("inner")).unionByName(held.withColumn("role", F.lit("outer"))).select("id", "fold", "role", "score")


def pairwise_logistic(rows: DataFrame, features: list[str], c: float = 0.1) -> DataFrame:
    """(feature, weight) of a logistic model without intercept on differences of (winner, loser) pairs, both ways.
    rows hold per pair x and y, arrays of features of the winner and the loser."""
    diff = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    both = rows.select(diff("x", "y").alias("d"), F.lit(1.0).alias("label")).unionByName(rows.select(diff("y", "x").alias("d"), F.lit(0.0).alias("label")))
    both = _kept(both).select(array_to_vector("d").alias("features"), "label")
    n = both.count()
    model = LogisticRegression(fitIntercept=False, regParam=1 / (c * max(1, n)), standardization=False, maxIter=80).fit(both)
    return rows.sparkSession.createDataFrame(list(zip(features, [float(w) for w in model.coefficients.toArray()], strict=True)), "feature string, weight double")


def route_arms(rows: DataFrame, arms: list[str], components: int = 8, trees: int = 20) -> DataFrame:
    """(id, fold, arm, predicted) for rows (id, fold, embedding, one utility per arm): principal components and one forest
    per arm, fitted on the other folds; arm is the one of highest predicted utility, the first of equals."""
    data = _kept(rows.select("id", "fold", "embedding", *arms)).select("id", "fold", array_to_vector("embedding").alias("raw"), *arms)
    out = []
    for (held,) in data.select("fold").distinct().orderBy("fold").collect():
        train, test = data.where(F.col("fold") != held), data.where(F.col("fold") == held)
        pca = PCA(k=components, inputCol="raw", outputCol="x").fit(train)
        train, test = pca.transform(train), pca.transform(test)
        for a in arms:
            test = RandomForestRegressor(featuresCol="x", labelCol=a, predictionCol=f"p_{a}", numTrees=trees, maxDepth=4, seed=276).fit(train).transform(test)
        best = F.array_max(F.array(*(F.struct(F.col(f"p_{a}").alias("predicted"), F.lit(-i).alias("i")) for i, a in enumerate(arms))))
        out.append(test.select("id", "fold", F.element_at(F.array(*map(F.lit, arms)), 1 - best["i"]).alias("arm"), best["predicted"].alias("predicted")))
    return reduce(DataFrame.unionByName, out)
