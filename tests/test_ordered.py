"""Ordered aggregates against direct computation, with ties and one dominating key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelens.operators import metrics as M
from routelens.operators import thresholds as Q
from routelens.operators.ordered import dense_index, quantile_points, quantiles, running_totals, squash, with_grid
from routelens.functions.hashing import uniform


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for key, n in (("hot", 700), ("b", 60), ("c", 40)):
        p = np.round(rng.random(n), 2)
        y = (rng.random(n) < p).astype(int)
        data += [(key, f"{key}{i}", float(a), int(b), float(20 + 300 * rng.random())) for i, (a, b) in enumerate(zip(p, y))]
    df = spark.createDataFrame(data, "k string, id string, p double, y int, ms double").cache()
    return df, data


def brute_auc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


def by_key(data, key):
    d = [r for r in data if r[0] == key]
    return np.array([r[2] for r in d]), np.array([r[3] for r in d]), np.array([r[4] for r in d]), [r[1] for r in d]


def test_auroc_is_tie_exact_and_antisymmetric(rows):
    df, data = rows
    got = {r.k: r.auroc for r in M.auroc(df, ["k"]).collect()}
    flipped = {r.k: r.auroc for r in M.auroc(df.withColumn("p", 1 - F.col("p")), ["k"]).collect()}
    for k in ("hot", "b", "c"):
        p, y, _, _ = by_key(data, k)
        assert got[k] == pytest.approx(brute_auc(p, y), abs=1e-12)
        assert got[k] + flipped[k] == pytest.approx(1.0, abs=1e-12)


def test_one_class_key_has_no_auroc(spark):
    df = spark.createDataFrame([("a", 0.1, 1), ("a", 0.9, 1)], "k string, p double, y int")
    assert M.auroc(df, ["k"]).first().auroc is None


def test_quantiles_match_linear_interpolation(rows):
    df, data = rows
    got = {r.k: r for r in quantiles(df, ["k"], "ms", (0.5, 0.95, 0.99), names=("a", "b", "c")).collect()}
    points = {(r.k, r.prob): r.value for r in quantile_points(df, ["k"], "p", [0.0, 0.33, 1.0], F.col("p")).collect()}
    for k in ("hot", "b", "c"):
        p, _, ms, _ = by_key(data, k)
        assert [got[k].a, got[k].b, got[k].c] == pytest.approx(np.percentile(ms, [50, 95, 99]))
        assert [points[(k, q)] for q in (0.0, 0.33, 1.0)] == pytest.approx(np.quantile(p, [0.0, 0.33, 1.0]))


def test_running_totals_descend(spark):
    df = spark.createDataFrame([("a", 0.1, 1), ("a", 0.5, 2), ("a", 0.50001, 4), ("a", 0.9, 8)], "k string, p double, n int")
    got = {r.p: (r.cum_n, r.tot_n) for r in running_totals(df, ["k"], "p", ["n"], descending=True).collect()}
    assert got == {0.9: (8, 15), 0.50001: (12, 15), 0.5: (14, 15), 0.1: (15, 15)}


def test_dense_index_is_a_permutation(rows):
    df, _ = rows
    got = dense_index(df, ["k"], "id", uniform("t", F.col("id"))).collect()
    hot = sorted(r.idx for r in got if r.k == "hot")
    assert hot == list(range(700)) and {r.n for r in got if r.k == "hot"} == {700}


def test_calibration_error_bounds(rows):
    df, _ = rows
    for r in M.calibration_error(df, ["k"]).collect():
        assert 0 <= r.ece <= r.mce <= 1


def test_risk_coverage_against_sorting(rows):
    import hashlib

    df, data = rows
    d = df.withColumn("ok", ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int"))
    got = {r.k: r for r in M.risk_coverage(d, ["k"], "p", "ok", "id").collect()}
    for k in ("hot", "b", "c"):
        p, y, _, ids = by_key(data, k)
        ok = ((p >= 0.5).astype(int) == y).astype(int)
        order = sorted(range(len(p)), key=lambda i: (-abs(p[i] - 0.5), int(hashlib.sha256(ids[i].encode()).hexdigest()[:8], 16), ids[i]))
        run = np.cumsum(ok[order]) / np.arange(1, len(p) + 1)
        cut = [max(int(round(i * len(p) / 50)), 1) for i in range(1, 51)]
        assert got[k].aurc == pytest.approx(np.mean([1 - run[c - 1] for c in cut]))
        assert got[k].selerr_100 == pytest.approx(1 - run[-1])


def test_conformal_beyond_sample_is_unbounded(spark):
    df = spark.createDataFrame([("a", 0.2, 0), ("a", 0.4, 0)], "k string, p double, y int")
    assert Q.conformal_threshold(df, ["k"], delta=0.1).first().tau is None
    assert Q.conformal_threshold(df, ["k"], delta=0.5).first().tau == 0.4


def test_tie_rank_correlation_against_brute_force(rows):
    df, data = rows
    got = {r.k: r for r in M.rank_correlations(df, ["k"]).collect()}
    p, y, _, _ = by_key(data, "b")
    s = np.sign(p[:, None] - p[None]) * np.sign(y[:, None] - y[None])
    up = np.triu_indices(len(p), 1)
    tau = s[up].sum() / np.sqrt((p[:, None] != p[None])[up].sum() * (y[:, None] != y[None])[up].sum())
    assert got["b"].kendall_tau_b == pytest.approx(tau)


@pytest.mark.parametrize("values", ["1 - id * 5e-12", "1e6 + id * 1e-5", "id * 1.0", "id * 1e-3 + int(id > 199990) * 1e9", "0.5"])
def test_cells_follow_the_values(spark, values):
    rows = spark.range(200_000).select(F.lit("k").alias("k"), F.expr(values).alias("v")).distinct()
    sizes = [r[0] for r in with_grid(rows, ["k"], [F.col("v"), squash(F.col("v"))]).groupBy("_cell").count().select("count").collect()]
    assert max(sizes) <= max(5 * sum(sizes) / len(sizes), 1)
    assert len(sizes) > 5000 or sum(sizes) == 1
