"""Prediction heads: one distributed pyspark.ml fit per action, applied as transformers."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.config import RouterConfig
from routelens.functions.expr import clip
from routelens.operators import routing as R

FOREST = RouterConfig()

#: every row keeps its node in each tree instead of walking down from the root at each level; ten levels need no checkpoint
KEPT_NODES = {"cacheNodeIds": True, "checkpointInterval": -1}

LEARNERS = {
    "forest": lambda seed, kw: RandomForestRegressor(seed=seed, **{"featureSubsetStrategy": "0.5", **KEPT_NODES, **kw}),
    "boosted": lambda seed, kw: GBTRegressor(seed=seed, maxIter=20, maxDepth=4, stepSize=0.06),
    "ridge": lambda seed, kw: LinearRegression(regParam=1.0, elasticNetParam=0.0, solver="normal"),
    "tree": lambda seed, kw: DecisionTreeRegressor(seed=seed, maxDepth=10, minInstancesPerNode=5),
}


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df)


def packed(df: DataFrame) -> DataFrame:
    """The rows of a fit in at most two partitions a core.

    A fit runs hundreds of small jobs over the same rows and every task reports to the driver, so what the driver gets must
    not grow with the partitions of the input.
    """
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def fit_heads(fit: DataFrame, pool: Sequence[str], features: Sequence[str], kind="regret", learner="forest", seed=17,
              threads: int = 3, **params) -> dict:
    """One regressor per action on its available rows; fits run side by side from a small pool, at most two forests at once: each
    fills the cores, and holds its rows' draws and nodes of all trees.

    ``kind`` names a target, or is a list with one target expression for each action.
    """
    kw = {"numTrees": FOREST.num_trees, "maxDepth": FOREST.max_depth, "minInstancesPerNode": FOREST.min_leaf, **params}
    goals = {f"target__{a}": t for a, t in zip(pool, R.targets(pool, kind) if isinstance(kind, str) else kind)}
    x = assemble(fit.withColumns(goals), features).select("features", *goals, *[f"available__{a}" for a in pool])
    x = packed(x).persist()

    def one(a):
        est = LEARNERS[learner](seed, kw).setFeaturesCol("features").setLabelCol(f"target__{a}").setPredictionCol(f"head__{a}")
        return a, est.fit(x.filter(F.col(f"available__{a}")).select("features", f"target__{a}"))

    with ThreadPoolExecutor(min(2, threads) if learner == "forest" else threads) as ex:
        out = dict(ex.map(one, pool))
    x.unpersist()
    return out


def apply_heads(df: DataFrame, models: dict, features: Sequence[str]) -> DataFrame:
    """Add ``head__a`` clipped to [0, 1]."""
    x = assemble(df, features)
    for m in models.values():
        x = m.transform(x)
    return x.withColumns({f"head__{a}": clip(F.col(f"head__{a}"), 0.0, 1.0) for a in models}).drop("features")


def fit_classifier(fit: DataFrame, features: Sequence[str], target, name: str, learner="forest", seed=17, weight: str | None = None, **params):
    """Binary classifier of a 0/1 expression, or the constant rate if only one class occurs."""
    x = packed(fit.select(*features, target.cast("double").alias("_t"), *([weight] if weight else []))).persist()
    rate, lo, hi = x.agg(F.avg("_t"), F.min("_t"), F.max("_t")).first()
    if lo == hi:
        x.unpersist()
        return 0.5 if rate is None else float(rate)
    kw = {"numTrees": FOREST.num_trees, "maxDepth": FOREST.max_depth, "minInstancesPerNode": FOREST.min_leaf, **params}
    est = RandomForestClassifier(seed=seed, **KEPT_NODES, **kw) if learner == "forest" else GBTClassifier(seed=seed, maxIter=10, maxDepth=4)
    est = est.setFeaturesCol("features").setLabelCol("_t").setProbabilityCol(f"_p_{name}").setRawPredictionCol(f"_r_{name}").setPredictionCol(f"_c_{name}")
    if weight:
        est = est.setWeightCol(weight)
    model = est.fit(assemble(x, features))
    x.unpersist()
    return model


def apply_classifier(df: DataFrame, model, features: Sequence[str], name: str) -> DataFrame:
    """Add the probability of class 1 under ``name``."""
    if isinstance(model, float):
        return df.withColumn(name, F.lit(model))
    x = model.transform(assemble(df, features))
    return x.withColumn(name, vector_to_array(f"_p_{name}")[1]).drop("features", f"_p_{name}", f"_r_{name}", f"_c_{name}")


def multinomial_router(fit: DataFrame, features: Sequence[str], label: str = "oracle_action"):
    """Scaled, class-balanced multinomial logistic model of the cheapest correct action."""
    fit = packed(fit.select(label, *features)).persist()
    sizes = {r[0]: r[1] for r in fit.groupBy(label).agg(F.count("*")).collect()}  # one row per action
    n, k = sum(sizes.values()), len(sizes)
    balance = F.create_map(*[F.lit(v) for a, c in sizes.items() for v in (a, n / (k * c))])
    w = fit.withColumn("_w", balance[F.col(label)])
    model = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_xs", withMean=True),
        LogisticRegression(featuresCol="_xs", labelCol="_y", weightCol="_w", family="multinomial", probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred", regParam=1.0 / max(n, 1), maxIter=30),
    ]).fit(w)
    fit.unpersist()
    return model


def apply_multinomial(df: DataFrame, model, label: str = "oracle_action", abstain: str = "ABSTAIN") -> DataFrame:
    """Best action other than abstaining, and its lead over the abstain probability."""
    names = list(model.stages[0].labels)
    x = model.transform(df if label in df.columns else df.withColumn(label, F.lit(names[0])))
    p = vector_to_array("_prob")
    probs = {n: p[i] for i, n in enumerate(names)}
    acts = [n for n in names if n != abstain]
    top = F.greatest(*[probs[a] for a in acts]) if len(acts) > 1 else probs[acts[0]]
    who = F.coalesce(*[F.when(probs[a] == top, F.lit(a)) for a in acts])
    return x.withColumn("cand", who).withColumn("conf", top - probs.get(abstain, F.lit(0.0))).drop("_y", "_x", "_xs", "_prob", "_raw", "_pred")


def _forest_of(model: RandomForestRegressionModel, lo: int, hi: int) -> RandomForestRegressionModel:
    """The trees from ``lo`` to before ``hi`` as a forest of their own."""
    gateway, java = SparkContext._active_spark_context._gateway, model._java_obj
    trees, own = java.trees(), gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, hi - lo)
    for i in range(lo, hi):
        own[i - lo] = trees[i]
    made = gateway.jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(f"{model.uid}_{lo}_{hi}", own, java.numFeatures())
    return RandomForestRegressionModel(made)._set(featuresCol="features", numTrees=hi - lo)


def forest_prefixes(df: DataFrame, model, features: Sequence[str], sizes: Sequence[int], out: str) -> DataFrame:
    """Mean prediction of the first k trees for every k: one pass over all trees, no refit.

    The trees between two sizes are one forest, so a row has one column a size however many trees there are.
    """
    x, sizes = assemble(df, features), sorted(sizes)
    if sizes[-1] > model.getNumTrees:
        raise ValueError(f"{sizes[-1]} of {model.getNumTrees} trees")
    made, run = {}, F.lit(0.0)
    for lo, hi in zip([0, *sizes], sizes):
        x = _forest_of(model, lo, hi).setPredictionCol(f"_t{hi}").transform(x)
        run = run + F.col(f"_t{hi}") * (hi - lo)
        made[f"{out}_{hi}"] = clip(run / hi, 0.0, 1.0)
    return x.withColumns(made).drop("features", *[f"_t{k}" for k in sizes])
