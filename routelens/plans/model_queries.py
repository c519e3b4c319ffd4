"""Queries that fit models: calibration, heads, learned policies and experiment arms."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from routelens.config import BETA_GRID
from routelens.functions import expr as E
from routelens.functions.hashing import uniform
from routelens.operators import calibration as K
from routelens.operators import heads as H
from routelens.operators import metrics as M
from routelens.operators import routing as R
from routelens.operators import splits as S
from routelens.operators.isotonic import stage_two
from routelens.plans.data_queries import corpora
from routelens.plans.metric_queries import calls, rounded
from routelens.plans.policy_queries import BANDS, EPS, PRICE, sides
from routelens.plans.registry import query
from routelens.plans.views import POOL, table
from routelens.sources.files import dropped, settled

ROTATIONS = 10
PROBE_FOLDS = 5
CROSS_FOLDS = 3
TEXT_STATS = ("log_chars", "n_lines")
#: sizes of forests on the curve of the first trees, besides the whole forest
TREES = (1, 2, 5, 10, 20, 25, 50, 100, 200, 400, 800)
#: rows of the target corpus on the few-shot curves, besides all of them, and their shares
SHOTS = (0, 1, 2, 4, 8, 16, 32, 50, 64, 128, 200, 256, 512)
SHARES = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.85, 1.0)


def featured(spark, sf):
    """The score matrix with document features and fit / val / test sides, kept for several fits."""
    e = table(spark, sf, "documents").select(
        F.sha2(F.lower(F.trim("text")), 256).alias("content_doc_key"), F.log1p(F.length("text").cast("double")).alias("log_chars"),
        F.log1p(F.size(F.split("text", "\n")).cast("double")).alias("n_lines")).groupBy("content_doc_key").agg(F.max("log_chars").alias("log_chars"), F.max("n_lines").alias("n_lines"))
    s = settled(sides(spark, sf).join(e, "content_doc_key"), "featured")
    return s.withColumns({f"is_{i}": F.col("dataset_key").eqNullSafe(c).cast("double") for i, c in enumerate(corpora(s))})


def corpus_columns(d) -> tuple[str, ...]:
    return tuple(c for c in d.columns if re.fullmatch("is_[0-9]+", c))


def features_of(d) -> tuple[str, ...]:
    """The features of ``featured`` rows: text statistics and one column for each corpus that occurs."""
    return (*TEXT_STATS, *corpus_columns(d))


def part(d, side):
    return d.filter(F.col("side") == side)


def stack(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def side_by_side(fn, items, threads: int = 4):
    """Run independent fits from a small driver thread pool; Spark interleaves their jobs."""
    with ThreadPoolExecutor(threads) as ex:
        return list(ex.map(fn, items))


def calibrated(d, pool=POOL):
    return K.apply_calibrators(d, K.fit_calibrators(part(d, "fit"), pool))


def headed(c, features=None, kind="regret", learner="forest", seed=17, pool=POOL):
    """Heads fitted on calibrated rows and attached to those that are routed, the rows of the other sides; with the fit-side costs."""
    features = features_of(c) if features is None else features
    x = H.apply_heads(c.filter("side <> 'fit'"), H.fit_heads(part(c, "fit"), pool, features, kind, learner, seed), features)
    return settled(x, "headed"), R.one_row(R.mean_costs(part(c, "fit"), pool), pool)


def fitted(d, *arm, **more):
    """Calibrate, fit heads and attach both; returns the rows to route and the fit-side costs."""
    return headed(calibrated(d), *arm, **more)


def route_with(x, costs, pool=POOL):
    beta = R.choose_beta(R.beta_ledger(part(x, "val"), pool, costs, BETA_GRID), EPS).first()[0]
    return R.select_action(x.filter("side <> 'fit'"), pool, R.utilities(pool, costs, F.lit(beta))), beta


def scored(r, system):
    """AUROC, accuracy and cost of one routed arm on the test side."""
    t = part(r, "test").withColumn("system", F.lit(system)).withColumn("ms", F.col("verifier_ms") + F.col("feature_latency_ms"))
    g = t.groupBy("system").agg(F.count("*").alias("n_rows"), F.avg("ms").alias("mean_ms"),
                                F.avg(((F.col("p") >= 0.5).cast("int") == F.col("label_supported")).cast("double")).alias("acc"))
    return g.join(M.auroc(t, ["system"], "p", "label_supported"), "system")


@query("platt_fit", "K1")
def platt_fit(spark, sf):
    d = settled(sides(spark, sf), "sides")
    got = K.fit_calibrators(part(d, "fit"), POOL)
    n = part(d, "fit").agg(F.count("*").alias("fit_rows"))
    return stack([n.select(F.lit(a).alias("verifier"), F.lit(round(b0, 6)).alias("intercept"), F.lit(round(b1, 6)).alias("slope"), "fit_rows") for a, (b0, b1) in got.items()])


@query("cross_fitted_calibration", "K3 K5")
def cross_fitted_calibration(spark, sf):
    """Each fold's rows are calibrated by a fit on the other folds; quality per action."""
    d = sides(spark, sf).withColumn("fold", F.floor(uniform("xfit", F.col("content_doc_key")) * 3))
    d = settled(d, "folded")
    out = stack([K.apply_calibrators(d.filter(F.col("fold") == f), K.fit_calibrators(d.filter(F.col("fold") != f), POOL), True) for f in range(3)])
    x = out.select("label_supported", F.explode(F.array(*[
        F.struct(F.lit(a).alias("action"), F.col(f"available__{a}").alias("av"), F.col(f"cal__{a}").alias("p")) for a in POOL])).alias("s")).select(F.col("label_supported").alias("y"), "s.*").filter("av")
    x = settled(x, "cross-fitted")
    n = x.groupBy("action").agg(F.count("*").alias("n_rows"))
    return rounded(n.join(M.proper_scores(x, ["action"]), "action").join(M.calibration_error(x, ["action"], right=True), "action").join(M.auroc(x, ["action"]), "action"))


@query("forest_router", "H2 X1")
def forest_router(spark, sf):
    x, costs = fitted(featured(spark, sf))
    r, beta = route_with(x, costs)
    return rounded(scored(r, "router").withColumn("beta", F.lit(beta)))


@query("router_with_stage_two", "X1 K2 Q2 Q8")
def router_with_stage_two(spark, sf):
    """The confirmatory chain: calibrate, heads, beta, route, isotonic, MCC threshold, metrics."""
    x, costs = fitted(featured(spark, sf))
    r, _ = route_with(x, costs)
    r = r.select("side", "episode_key", "dataset_key", F.col("label_supported").alias("y"), "p", (F.col("verifier_ms") + F.col("feature_latency_ms")).alias("ms"), F.lit("router").alias("system"))
    q = stage_two(settled(r, "routed"), ["system"], settle=settled)
    q = settled(q, "stage-two")
    thr = part(q, "val").select("threshold").first()[0]
    t = part(q, "test").withColumn("ok", (F.col("d") == F.col("y")).cast("int"))
    k = ["system"]
    return rounded(M.auroc(t, k, "q").join(M.decision_metrics(t, k), k).join(M.calibration_error(t, k, "q"), k).join(M.latency_summary(t, k), k)
                   .join(M.risk_coverage(t, k, "q"), k).withColumn("threshold", F.lit(thr)))


@query("correctness_heads", "H3")
def correctness_heads(spark, sf):
    d = featured(spark, sf)
    x = d
    for a, t in zip(POOL, R.targets(POOL, "correctness")):
        m = H.fit_classifier(part(d, "fit").filter(F.col(f"available__{a}")), features_of(d), t, f"head__{a}")
        x = H.apply_classifier(x, m, features_of(d), f"head__{a}")
    costs = R.one_row(R.mean_costs(part(d, "fit"), POOL), POOL)
    return rounded(scored(R.select_action(part(x, "test"), POOL, R.utilities(POOL, costs, F.lit(0.4))), "correctness"))


@query("learner_sweep", "H4 X11")
def learner_sweep(spark, sf):
    d = featured(spark, sf)
    def arm(name):
        x, costs = fitted(d, learner=name)
        return scored(route_with(x, costs)[0], name)

    return rounded(stack(side_by_side(arm, ("boosted", "ridge", "tree"))))


@query("no_verifier_arm", "H5 X4")
def no_verifier_arm(spark, sf):
    d = featured(spark, sf)
    m = H.fit_classifier(part(d, "fit"), features_of(d), F.col("label_supported"), "prob")
    t = H.apply_classifier(part(d, "test"), m, features_of(d), "prob").withColumn("p", E.clip(F.col("prob"))).withColumn("system", F.lit("no_verifier"))
    return rounded(M.auroc(t, ["system"], "p", "label_supported").join(t.groupBy("system").agg(F.count("*").alias("n_rows"), F.avg("feature_latency_ms").alias("mean_ms")), "system"))


@query("pairwise_router", "H6")
def pairwise_router(spark, sf):
    """Weighted pair classifiers; an action's value is the mean probability of its wins."""
    d = featured(spark, sf)
    costs = R.one_row(R.mean_costs(part(d, "fit"), POOL), POOL)
    prefs = R.pairwise_preferences(part(d, "fit"), POOL, E.discounts(F.lit(0.4), costs), ["episode_key", *features_of(d)]).persist()
    x, wins = d, {a: [] for a in POOL}
    for i, a in enumerate(POOL):
        for b in POOL[i + 1:]:
            name = f"win_{a}_{b}"
            m = H.fit_classifier(prefs.filter((F.col("first") == a) & (F.col("second") == b)), features_of(d), F.col("target"), name, weight="gap")
            x = H.apply_classifier(x, m, features_of(d), name)
            wins[a].append(F.col(name))
            wins[b].append(F.lit(1.0) - F.col(name))
    x = x.withColumns({f"head__{a}": reduce(lambda u, v: u + v, w) / len(w) for a, w in wins.items()})
    return rounded(scored(R.select_action(part(x, "test"), POOL, R.cols("head", POOL)), "pairwise"))


@query("reward_regression", "H7")
def reward_regression(spark, sf):
    """Heads on the discounted correctness itself."""
    d = featured(spark, sf)
    costs = R.one_row(R.mean_costs(part(d, "fit"), POOL), POOL)
    c = K.apply_calibrators(d, K.fit_calibrators(part(d, "fit"), POOL))
    factors = E.discounts(F.lit(0.4), costs)
    rewards = [t * f for t, f in zip(R.targets(POOL, "correctness"), factors, strict=True)]
    x = H.apply_heads(c, H.fit_heads(part(c, "fit"), POOL, features_of(d), rewards, "ridge"), features_of(d))
    return rounded(scored(R.select_action(part(x, "test"), POOL, R.cols("head", POOL)), "reward"))


def candidates(draws: int = 16, seed: int = 0) -> list[dict]:
    """Forests of the random search, as the reference draws them without repeats, then its two frozen ones."""
    rng = np.random.default_rng(seed)
    out = [{"numTrees": int(rng.choice([200, 400, 800])), "minInstancesPerNode": int(rng.choice([1, 2, 5, 10])),
            "featureSubsetStrategy": str(rng.choice(["sqrt", "log2", "0.5"])), "maxDepth": int(rng.choice([6, 10, 12, 16, 24]))} for _ in range(draws)]
    out += [{"numTrees": n, "minInstancesPerNode": leaf, "featureSubsetStrategy": share, "maxDepth": 10} for n, leaf, share in ((800, 1, "sqrt"), (200, 5, "0.5"))]
    return [c for i, c in enumerate(out) if c not in out[:i]]


def rank_agreement(a, b):
    """Spearman's correlation of two short columns, equal values sharing their mean rank; None if one of them does not vary."""
    both = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    ranks = [[sum(v < x for v in c) + (sum(v == x for v in c) + 1) / 2 for x in c] for c in zip(*both)]
    if not both or any(min(r) == max(r) for r in ranks):
        return None
    return float(np.corrcoef(*ranks)[0, 1])


@query("hyper_parameter_search", "H8 H9")
def hyper_parameter_search(spark, sf):
    """Random candidates ranked by validation head loss, with the AUROC each would have given, how both agree and what the choice by loss forgoes."""
    d = featured(spark, sf)
    c = settled(K.apply_calibrators(d, K.fit_calibrators(part(d, "fit"), POOL)), "calibrated")
    loss = reduce(lambda a, b: a + b, [F.avg(F.when(F.col(f"available__{a}"), F.pow(F.col(f"head__{a}") - t, 2))) for a, t in zip(POOL, R.targets(POOL, "regret"))]) / len(POOL)

    def candidate(item):
        i, kw = item
        v = settled(H.apply_heads(part(c, "val"), H.fit_heads(part(c, "fit"), POOL, features_of(d), seed=17, **kw), features_of(d)), "candidate")
        r = R.select_action(v, POOL, R.cols("head", POOL)).withColumn("candidate", F.lit(i))
        got = M.auroc(r, ["candidate"], "p", "label_supported").join(v.agg(loss.alias("loss")).withColumn("candidate", F.lit(i)), "candidate").first()
        dropped(v)
        return None if got is None else (i, got["auroc"], got["loss"], kw["numTrees"], kw["maxDepth"], kw["minInstancesPerNode"], kw["featureSubsetStrategy"])

    # rows of one partition leave cores idle, which other candidates take; rows that fill the cores are fitted by one candidate at a time
    cores, parts = spark.sparkContext.defaultParallelism, H.packed(part(c, "fit")).rdd.getNumPartitions()
    rows = [r for r in side_by_side(candidate, list(enumerate(candidates())), max(1, min(4, cores // (2 * parts)))) if r]
    names = ("candidate", "auroc", "loss", "trees", "depth", "min_leaf", "feature_share")
    t = spark.createDataFrame(rows, "candidate int, auroc double, loss double, trees int, depth int, min_leaf int, feature_share string")
    x = [dict(zip(names, r)) for r in rows]  # one row a candidate
    best = min((r for r in x if r["loss"] is not None), key=lambda r: (round(r["loss"], 9), r["depth"], r["trees"], r["candidate"]), default=None)
    rho = rank_agreement([r["loss"] for r in x], [r["auroc"] for r in x])
    forgone = None if best is None or best["auroc"] is None else max(r["auroc"] for r in x if r["auroc"] is not None) - best["auroc"]
    return rounded(t.withColumn("selected", F.col("candidate") == F.lit(best and best["candidate"]).cast("int"))
                   .withColumn("spearman", F.lit(rho).cast("double")).withColumn("auroc_forgone", F.lit(forgone).cast("double")))


def _selective(d):
    t = R.selective_targets(d, POOL, BANDS, PRICE, ["episode_key"])
    return d.join(t.drop("y"), "episode_key")


@query("oracle_action_router", "H11 R18 M14")
def oracle_action_router(spark, sf):
    d = settled(_selective(featured(spark, sf)), "selective")
    x = settled(d.join(S.fold_groups(d, 3, 3), "content_doc_key"), "folded")
    out = stack([H.apply_multinomial(x.filter(F.col("fold") == f), H.multinomial_router(x.filter(F.col("fold") != f), features_of(d))) for f in range(3)])
    act = F.when(F.col("conf") >= 0, F.col("cand")).otherwise(F.lit("ABSTAIN"))
    return rounded(R.policy_metrics(R.direct_policy(out, POOL, BANDS, PRICE, act, 2.0), ["dataset_key"]))


@query("cost_to_go_router", "H12")
def cost_to_go_router(spark, sf):
    """Regress each action's cost-to-go on the other folds; the smallest wins, confidence is one minus it."""
    d = settled(_selective(featured(spark, sf)), "selective")
    x = H.assemble(settled(d.join(S.fold_groups(d, 3, CROSS_FOLDS), "content_doc_key"), "folded"), features_of(d))
    rows = H.packed(x.select("fold", "features", *[f"cost_to_go__{a}" for a in POOL])).persist()

    def fold(f):
        fit, out = rows.filter(F.col("fold") != f), x.filter(F.col("fold") == f)
        for a in POOL:
            est = H.GBTRegressor(seed=17, maxIter=10, maxDepth=4, featuresCol="features", labelCol=f"cost_to_go__{a}", predictionCol=f"ctg__{a}")
            out = est.fit(fit).transform(out)
        return out.drop("features")

    cost = R.cols("ctg", POOL)
    out = stack(side_by_side(fold, range(CROSS_FOLDS), 3))
    rows.unpersist()
    out = out.withColumn("cand", E.pick([F.lit(a) for a in POOL], E.first_argmax([-c for c in cost]))).withColumn("conf", F.lit(1.0) - E.row_min(cost))
    act = F.when(F.col("conf") >= 0.2, F.col("cand")).otherwise(F.lit("ABSTAIN"))
    return rounded(R.policy_metrics(R.direct_policy(out, POOL, BANDS, PRICE, act, 2.0), ["dataset_key"]))


@query("two_stage_router", "H13")
def two_stage_router(spark, sf):
    """First: is any action right? Then: which one, learned on the rows where one is. Both on the other folds."""
    d = settled(_selective(featured(spark, sf)), "selective")
    rows = settled(d.join(S.fold_groups(d, 3, CROSS_FOLDS), "content_doc_key"), "folded")

    def fold(f):
        fit, out = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
        gate = H.fit_classifier(fit, features_of(d), F.col("oracle_available"), "gate")
        pickr = H.multinomial_router(fit.filter("oracle_available"), features_of(d))
        return H.apply_multinomial(H.apply_classifier(out, gate, features_of(d), "gate"), pickr)

    x = settled(stack(side_by_side(fold, range(CROSS_FOLDS), 3)), "two-stage")
    act = F.when(F.col("gate") >= 0.5, F.col("cand")).otherwise(F.lit("ABSTAIN"))
    m = R.policy_metrics(R.direct_policy(x, POOL, BANDS, PRICE, act, 2.0).withColumn("system", F.lit("two_stage")), ["system"])
    g = M.auroc(x.withColumn("system", F.lit("two_stage")).withColumn("y", F.col("oracle_available").cast("int")), ["system"], "gate", "y", name="gate_auroc")
    return rounded(m.join(g, "system"))


@query("learned_deferral", "H14 R14")
def learned_deferral(spark, sf):
    """Escalate when a model predicts that the cheapest verifier errs."""
    c = calibrated(featured(spark, sf))
    x, costs = headed(c)
    first = POOL[0]
    wrong = (F.col(f"cal__{first}") >= 0.5).cast("int") != F.col("label_supported")
    x = H.apply_classifier(x, H.fit_classifier(part(c, "fit"), features_of(c), wrong, "risk", minInstancesPerNode=5), features_of(c), "risk")
    x = settled(x, "risks")
    r, _ = route_with(x, costs)
    ceiling = part(r, "val").agg(F.avg(R.latency_ceiling(F.col("verifier_ms"), F.col("feature_latency_ms")))).first()[0]
    e = R.escalation(r, POOL, costs, "cascade").withColumn("conf", -F.col("risk"))
    tau = R.choose_tau(part(e, "val"), ceiling).first()[0]
    return rounded(scored(R.escalate(e, F.lit(tau)), "learned_deferral"))


@query("corpus_identity_probe", "H15 X13")
def corpus_identity_probe(spark, sf):
    """Can the features tell the corpus? Grouped five-fold accuracy against the majority share."""
    d = featured(spark, sf)
    x = settled(d.join(S.fold_groups(d, 41, PROBE_FOLDS), "content_doc_key"), "folded")
    feats = ("log_chars", "n_lines")
    from pyspark.ml.feature import StringIndexer

    idx = StringIndexer(inputCol="dataset_key", outputCol="ds").fit(x)
    x = H.assemble(idx.transform(x), feats)
    est = H.RandomForestClassifier(labelCol="ds", featuresCol="features", numTrees=10, maxDepth=5, seed=17)
    rows = H.packed(x.select("fold", "ds", "features")).persist()
    out = stack([est.fit(rows.filter(F.col("fold") != f)).transform(x.filter(F.col("fold") == f)).select("ds", "prediction") for f in range(PROBE_FOLDS)])
    rows.unpersist()
    top = x.groupBy("ds").count().agg((F.max("count") / F.sum("count")).alias("m")).first()[0]
    return rounded(out.agg(F.count("*").alias("n_rows"), F.avg((F.col("ds") == F.col("prediction")).cast("double")).alias("accuracy")).withColumn("majority", F.lit(top)))


@query("forest_prefix_curve", "H16")
def forest_prefix_curve(spark, sf):
    """Routing by the first trees of the frozen forest, up to all of them."""
    d = featured(spark, sf)
    c = K.apply_calibrators(d, K.fit_calibrators(part(d, "fit"), POOL))
    models = H.fit_heads(part(c, "fit"), POOL, features_of(d))
    n = min(m.getNumTrees for m in models.values())
    sizes = sorted({k for k in TREES if k < n} | {n})
    x = part(c, "test")
    for a, m in models.items():
        x = H.forest_prefixes(x, m, features_of(d), sizes, f"h_{a}")
    x = settled(x, "prefixes")

    def curve(k):
        y = x.withColumns({f"head__{a}": F.col(f"h_{a}_{k}") for a in POOL})
        return scored(R.select_action(y, POOL, R.cols("head", POOL)), f"trees_{k:02d}")

    return rounded(stack([curve(k) for k in sizes]))


@query("rotation_protocol", "X2 F4")
def rotation_protocol(spark, sf):
    """Out-of-fold predictions over ten rotations of group folds; every row is predicted once."""
    d = featured(spark, sf).drop("side")
    x = settled(d.join(S.fold_groups(d, 17, ROTATIONS), "content_doc_key"), "folded")

    def rotation(t):
        gap = F.pmod(F.col("fold") - F.lit(t), F.lit(ROTATIONS))
        s = x.withColumn("side", F.when(gap == 0, "test").when(gap == 1, "val").otherwise("fit"))
        f, costs = fitted(s, learner="tree")
        return part(route_with(f, costs)[0], "test").withColumn("rotation", F.lit(t))

    o = settled(stack(side_by_side(rotation, range(ROTATIONS))).select("episode_key", "p", "label_supported", "verifier_ms", F.lit("router").alias("system")), "rotated")
    return rounded(o.groupBy("system").agg(F.count("*").alias("n_rows"), F.count_distinct("episode_key").alias("episodes"), F.avg("verifier_ms").alias("mean_ms")).join(M.auroc(o, ["system"], "p", "label_supported"), "system"))


@query("ablation_arms", "X4 X10 R8 R21")
def ablation_arms(spark, sf):
    """Feature, target, head and mask ablations as deltas against the reference arm."""
    d = featured(spark, sf)
    x, costs = fitted(d, learner="tree")
    r, beta = route_with(x, costs)
    arms = [scored(r, "reference")]
    for name, feats in (("without_corpus", ("log_chars", "n_lines")), ("corpus_only", corpus_columns(d))):
        y, c = fitted(d, feats, learner="tree")
        arms.append(scored(route_with(y, c)[0], name))
    y, c = fitted(d, kind="brier", learner="tree")
    arms.append(scored(route_with(y, c)[0], "target_brier"))
    t = x.filter("side <> 'fit'")
    arms.append(scored(R.select_action(t, POOL, R.cols("head", POOL)), "no_cost"))
    arms.append(scored(R.select_action(t, POOL, [uniform("head", F.col("episode_key"), a) for a in POOL]), "random_heads"))
    arms.append(scored(R.select_action(t, POOL, R.targets(POOL, "regret")), "oracle_heads"))
    arms.append(scored(R.select_action(t, POOL, R.utilities(POOL, costs, F.lit(beta)), blocked=("v_high",)), "masked_high"))
    a = stack(arms).persist()
    ref = a.filter("system = 'reference'").first()
    return rounded(a.withColumn("delta_auroc", F.col("auroc") - F.lit(ref["auroc"])).withColumn("delta_ms", F.col("mean_ms") - F.lit(ref["mean_ms"])))


@query("per_corpus_training", "X5")
def per_corpus_training(spark, sf):
    """In-domain training per corpus against the best fixed verifier of that corpus."""
    d = featured(spark, sf)
    def corpus(c):
        x, costs = fitted(d.filter(F.col("dataset_key") == c), ("log_chars", "n_lines"), learner="tree")
        return scored(route_with(x, costs)[0], c)

    out = side_by_side(corpus, [c for c in corpora(d) if c is not None])
    fixed = M.auroc(calls(spark, sf).filter("role = 'test'"), ["dataset_key", "verifier"]).groupBy("dataset_key").agg(F.max_by("verifier", F.struct("auroc", "verifier")).alias("best_fixed"), F.max("auroc").alias("best_fixed_auroc"))
    return rounded(stack(out).join(fixed.withColumnRenamed("dataset_key", "system"), "system", "left"))


@query("pool_subset_lattice", "X7 X12")
def pool_subset_lattice(spark, sf):
    """Every non-empty pool subset routed with the same heads, as bitmask rows."""
    x, costs = fitted(featured(spark, sf), learner="tree")
    out = []
    for mask in range(1, 2 ** len(POOL)):
        keep = [a for i, a in enumerate(POOL) if mask >> i & 1]
        gone = [a for a in POOL if a not in keep]
        r = R.select_action(part(x, "test"), POOL, R.utilities(POOL, costs, F.lit(0.4)), blocked=gone).filter(F.col("sel").isNotNull())
        out.append(scored(r, "+".join(keep)).withColumn("mask", F.lit(mask)).withColumn("size", F.lit(len(keep))))
    return rounded(stack(out))


@query("learning_curve", "X9 F8")
def learning_curve(spark, sf):
    d = featured(spark, sf)
    def size(frac):
        g = S.subsample_groups(part(d, "fit"), 23, frac)
        s = settled(part(d, "fit").join(g, "content_doc_key").unionByName(d.filter("side <> 'fit'")), "subsampled")
        x, costs = fitted(s, learner="tree")
        return scored(route_with(x, costs)[0], f"fraction_{frac}")

    return rounded(stack(side_by_side(size, (0.1, 0.25, 0.5, 0.75, 1.0))))


@query("few_shot_curve", "X14 F9 W11")
def few_shot_curve(spark, sf):
    """Training on the other corpora plus k rows of each corpus in turn, by count and by share; the knee is where 95 % of the gain is reached.

    Points of one corpus with the same k are one fit.
    """
    d = featured(spark, sf)
    sizes = {r[0]: r[1] for r in part(d, "fit").groupBy("dataset_key").agg(F.count("*")).collect()}  # one row a corpus
    points = {c: S.shot_counts(sizes.get(c, 0), SHOTS, SHARES) for c in corpora(d) if c is not None}

    def shots(arm):
        corpus, k = arm
        fit = S.few_shot(part(d, "fit"), corpus, k, 31)
        own = (F.col("side") == "val") | (F.col("side") == "test") & (F.col("dataset_key") == corpus)
        s = settled(fit.unionByName(d.filter(own)), "few-shot")
        x, costs = fitted(s, ("log_chars", "n_lines"))
        out = settled(scored(route_with(x, costs)[0], corpus).withColumn("k", F.lit(k)), "shots")
        dropped(s, x)
        return out

    arms = stack(side_by_side(shots, [(c, k) for c, p in points.items() for k in sorted({k for _, _, k in p})]))
    grid = spark.createDataFrame([(c, *p, sizes.get(c, 0)) for c, own in points.items() for p in own], "system string, curve string, fraction double, k int, pool_rows long")
    c = settled(grid.join(arms, ["system", "k"]), "curves")
    ends = c.groupBy("system", "curve").agg(F.min_by("auroc", "k").alias("_a"), F.max_by("auroc", "k").alias("_b"))
    gain = F.col("_b") - F.col("_a")
    hit = F.coalesce((gain > 0) & (F.col("auroc") >= F.col("_a") + 0.95 * gain), F.lit(False))
    return rounded(c.join(ends, ["system", "curve"]).withColumn("reaches_knee", hit).drop("_a", "_b"))


@query("leave_one_corpus_policies", "X15 F6")
def leave_one_corpus_policies(spark, sf):
    d = featured(spark, sf)
    def heldout(c):
        s = d.withColumn("side", F.when(F.col("dataset_key") == c, "test").when(F.col("side") == "val", "val").otherwise("fit"))
        x, costs = fitted(s, ("log_chars", "n_lines"), learner="tree")
        return scored(route_with(x, costs)[0], c)

    return rounded(stack(side_by_side(heldout, [c for c in corpora(d) if c is not None])))
