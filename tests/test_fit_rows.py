"""Rows of fits: few partitions whatever the input has, and short plans for what several fits read."""

import os

from pyspark.sql import functions as F

from routelens.config import RouterConfig
from routelens.operators import heads as H
from routelens.operators import splits as S
from routelens.plans import model_queries as Q
from routelens.sources.files import dropped, settled


def test_a_fit_has_few_tasks_a_job(spark):
    df = spark.range(640).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y")).repartition(64)
    sc = spark.sparkContext
    sc.setJobGroup("few-tasks", "fit")
    H.fit_classifier(df, ["x"], F.col("y") > 1, "p", numTrees=2, maxDepth=3)
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = [i.numTasks for i in map(tracker.getStageInfo, stages) if i]
    assert tasks and max(tasks) <= 2 * sc.defaultParallelism


def test_rows_of_several_fits_are_a_table(spark):
    plan = Q.featured(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_routed_rows_are_a_table_without_the_rows_of_the_fit(spark):
    x, _ = Q.fitted(Q.featured(spark, "/root/testdata/sf0.001"), learner="tree")
    assert "UDF" not in x._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in x.select("side").distinct().collect()} == {"val", "test"}


def test_forests_keep_the_nodes_of_their_rows(spark):
    """Rows keep their node in each tree, which changes no tree: at every level they would walk down from the root instead."""
    x = spark.range(400).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("y"))
    x = H.assemble(x, ("a", "b")).coalesce(1).persist()
    est = H.LEARNERS["forest"](17, {"numTrees": 4, "maxDepth": 4}).setLabelCol("y")
    assert est.getCacheNodeIds()
    kept, plain = est.fit(x), est.copy({est.cacheNodeIds: False}).fit(x)
    tree = lambda m: [t.toDebugString.split("\n", 1)[1] for t in m.trees]
    assert tree(kept) == tree(plain)


def test_prefixes_are_means_of_the_first_trees_up_to_the_whole_forest(spark):
    x = spark.range(300).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("y"), F.lit(True).alias("available__v"))
    x = x.withColumn("y", F.col("y") * F.col("a")).coalesce(1).persist()
    model = H.fit_heads(x, ["v"], ("a", "b"), [F.col("y")], numTrees=30, maxDepth=4)["v"]
    got = H.forest_prefixes(x, model, ("a", "b"), (25, 1, 7, 30), "h")
    assert got.columns == [*x.columns, "h_1", "h_7", "h_25", "h_30"]
    each = H.assemble(x, ("a", "b"))
    for i, t in enumerate(model.trees):
        each = t.setPredictionCol(f"t{i}").transform(each)
    rows = lambda df: {(r.a, r.b): r for r in df.collect()}
    trees, whole = rows(each), rows(model.transform(H.assemble(x, ("a", "b"))))
    for key, r in rows(got).items():
        for k in (1, 7, 25, 30):
            assert abs(r[f"h_{k}"] - sum(trees[key][f"t{i}"] for i in range(k)) / k) < 1e-12
        assert abs(r.h_30 - whole[key].head__v) < 1e-12


def test_the_curve_of_first_trees_ends_at_the_frozen_forest(spark):
    got = {r.system for r in Q.forest_prefix_curve(spark, "/root/testdata/sf0.001").collect()}
    assert got == {f"trees_{k:02d}" for k in (1, 2, 5, 10, 20, 25, 50, 100, 200)}


def test_the_search_tries_the_candidates_of_the_reference(spark, monkeypatch):
    all_of_them = Q.candidates()
    assert len(all_of_them) == 16 and {c["numTrees"] for c in all_of_them} == {200, 400, 800} and max(c["maxDepth"] for c in all_of_them) == 24
    assert all_of_them[0] == {"numTrees": 800, "minInstancesPerNode": 5, "featureSubsetStrategy": "log2", "maxDepth": 10}
    assert {"numTrees": H.FOREST.num_trees, "minInstancesPerNode": H.FOREST.min_leaf, "featureSubsetStrategy": "0.5", "maxDepth": H.FOREST.max_depth} in all_of_them
    few = [{"numTrees": n, "minInstancesPerNode": leaf, "featureSubsetStrategy": "sqrt", "maxDepth": 2} for n, leaf in ((1, 5), (2, 1), (3, 20))]
    monkeypatch.setattr(Q, "candidates", lambda: few)
    got = sorted(Q.hyper_parameter_search(spark, "/root/testdata/sf0.001").collect())
    assert [(r.trees, r.min_leaf, r.feature_share) for r in sorted(got, key=lambda r: r.candidate)] == [(1, 5, "sqrt"), (2, 1, "sqrt"), (3, 20, "sqrt")]
    best = min(got, key=lambda r: r.loss)
    assert [r for r in got if r.selected] == [best]
    assert {r.auroc_forgone for r in got} == {round(max(r.auroc for r in got) - best.auroc, 6)}


def test_rank_agreement():
    assert Q.rank_agreement([1.0, 2.0, 2.0, 5.0], [3.0, 4.0, 4.0, 9.0]) == 1.0
    assert abs(Q.rank_agreement([1.0, 2.0, 3.0, None], [9.0, 9.0, 1.0, 2.0]) + 0.75 ** 0.5) < 1e-12
    assert Q.rank_agreement([1.0, 2.0], [5.0, 5.0]) is None and Q.rank_agreement([], []) is None


def test_few_shots_of_every_corpus_by_count_and_by_share(spark, monkeypatch):
    assert S.shot_counts(5, (0, 2, 9), (0.0, 0.5, 1.0)) == [("count", None, 0), ("count", None, 2), ("count", None, 5), ("fraction", 0.0, 0), ("fraction", 0.5, 2), ("fraction", 1.0, 5)]
    assert len(S.shot_counts(10_000, Q.SHOTS, Q.SHARES)) == 24
    monkeypatch.setattr(H, "FOREST", RouterConfig(num_trees=2, max_depth=3))
    monkeypatch.setattr(Q, "SHOTS", (0, 2))
    monkeypatch.setattr(Q, "SHARES", (0.0, 1.0))
    d = Q.featured(spark, "/root/testdata/sf0.001")
    pool = {r[0]: r[1] for r in d.filter("side = 'fit'").groupBy("dataset_key").count().collect()}
    test = {r[0]: r[1] for r in d.filter("side = 'test'").groupBy("dataset_key").count().collect()}
    got = Q.few_shot_curve(spark, "/root/testdata/sf0.001").collect()
    want = {(c, curve, k) for c in test for curve, ks in (("count", (0, 2, pool.get(c, 0))), ("fraction", (0, pool.get(c, 0)))) for k in ks if k <= pool.get(c, 0)}
    assert {(r.system, r.curve, r.k) for r in got} == want and {r[0] for r in want} == {"de", "en", "es", "fr"}
    assert all(r.n_rows == test[r.system] and r.pool_rows == pool.get(r.system, 0) for r in got)
    same = {}
    for r in got:
        assert same.setdefault((r.system, r.k), r.auroc) == r.auroc


def test_used_up_tables_are_deleted(spark):
    t = settled(spark.range(3), "gone")
    dropped(t)
    assert not os.path.exists(t._settled_at)
