"""Arms, isotonic blocks and the nested study against plain versions; null keys in ordered statistics."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from routelens.operators import arms as A
from routelens.operators import isotonic as I
from routelens.operators import metrics as M
from routelens.operators import nested as N
from routelens.operators import ordered as O
from routelens.operators.neighbours import nearest_mean

NAMES = ("a", "b", "c", "d")
GRID = (0.0, 0.5, 2.0)


def score_rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        y = int(r.random() < 0.5)
        cal = [min(max(0.5 + (0.2 + 0.2 * j) * (y - 0.5) + 0.8 * (r.random() - 0.5), 0.01), 0.99) for j in range(4)]
        out.append((0, ("fit", "val", "test")[i % 3], y, 1.0 + i % 2, [r.choice("xyz"), str(i % 2), None if i % 11 == 0 else "n"], cal, [r.random() < 0.8 for _ in range(4)], [5.0 * 3**j + r.random() for j in range(4)]))
    return out


SCHEMA = "run int, side string, y int, feature_ms double, bins array<string>, cal array<double>, av array<boolean>, ms array<double>"


def plain_auroc(pairs):
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def plain_arm(rows, arm, beta, prior, side):
    import math

    cell = lambda b: "|".join(("∅" if v is None else v) if arm.mask >> i & 1 else "*" for i, v in enumerate(b))
    s, n, total, count, rate = defaultdict(float), defaultdict(int), defaultdict(float), defaultdict(int), defaultdict(list)
    cost = {}
    for j in arm.members:
        seen = [r[7][j] for r in rows if r[1] == "fit" and r[6][j]]
        cost[j] = sum(seen) / len(seen)
    for r in rows:
        if r[1] != "fit":
            continue
        rate[cell(r[4])].append(r[2])
        right = {j: r[5][j] if r[2] else 1 - r[5][j] for j in arm.members}
        for j in arm.members:
            if r[6][j]:
                t = 1 + right[j] - max(right.values())
                for k, d, m in (((cell(r[4]), j), s, n), (j, total, count)):
                    d[k] += t
                    m[k] += 1
    labels = [y for v in rate.values() for y in v]
    pairs, ms = [], []
    for r in rows:
        if r[1] != side:
            continue
        c = cell(r[4])
        head = lambda j: (s[c, j] + prior * total[j] / count[j]) / (n[c, j] + prior) if n[c, j] + prior > 0 and c in rate else 0.5
        worth = [(head(j) * math.exp(-beta * cost[j] / max(cost.values())), j) for j in arm.members if r[6][j]]
        if worth:
            best = max(w for w, _ in worth)
            j = next(j for w, j in worth if abs(w - best) < 1e-15)
            pairs.append((r[5][j], r[2]))
            ms.append(r[3] + r[7][j])
        else:
            base = (sum(rate[c]) + prior * sum(labels) / len(labels)) / (len(rate[c]) + prior) if c in rate else 0.5
            pairs.append((base, r[2]))
            ms.append(r[3])
    return plain_auroc(pairs), sum(ms) / len(ms)


@pytest.mark.parametrize("prior", [0.0, 5.0])
def test_arms_against_plain_routing(spark, prior):
    rows = score_rows(240)
    arms = [*A.pools_of(NAMES, 3, 0b011), A.Arm("none", (), 0b111), A.Arm("one", (2,), 0), A.Arm("all", (0, 1, 2, 3), 0b101)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    led = A.arms_ledger(df, ["run"], arms, 4, 3, GRID, prior).cache()
    got = {(r.side, r.arm, r.beta): r for r in A.summary(led, ["side", "arm", "beta"], 4).collect()}
    for arm in arms:
        for side in ("val", "test"):
            for beta in GRID:
                if (side, arm.name, beta) not in got:  # it chooses like a smaller discount
                    continue
                r = got[side, arm.name, beta]
                auroc, ms = plain_arm(rows, arm, beta, prior, side)
                assert r.n_rows == 80 and r.auroc == pytest.approx(auroc) and r.mean_ms == pytest.approx(ms)
    assert {r.arm for r in A.chosen_discounts(A.summary(led.filter("side = 'val'"), ["arm", "beta"], 4), ["arm"], 0.01).collect()} == {a.name for a in arms}


def test_test_rows_meet_the_chosen_discounts_only(spark):
    """As many ledger rows as with all discounts and a filter behind them, but the test rows' plan holds one entry an arm."""
    df, seen = spark.createDataFrame(score_rows(240, 5), SCHEMA), {}
    arms = A.lattice_of(NAMES[:2], ("f", "g", "h"))

    def settle(x, name):
        return seen.setdefault(name, x.cache())

    got = A.tested_arms(df, ["run"], arms, 4, 3, GRID, 0.01, 1.0, settle)
    led = A.arms_ledger(df, ["run"], arms, 4, 3, GRID, 1.0).cache()
    beta = A.chosen_discounts(A.summary(led.filter("side = 'val'"), ["run", "arm", "beta"], 2), ["run", "arm"], 0.01)
    want = led.filter("side = 'test'").join(beta, ["run", "arm", "beta"])
    plain = lambda x: sorted((r.arm, r.beta, round(r.score, 9), r.pos, r.neg, round(r.ms, 6), r.c0, r.c1) for r in x.collect())
    assert plain(got) == plain(want)
    assert {r[0] for r in seen["arm-chosen"].select(F.size("plan")).collect()} == {len(arms)}
    assert seen["arm-choices"].select(F.max(F.size("plan"))).first()[0] > len(arms)


def test_rounded_ledger_is_bounded(spark):
    df = spark.createDataFrame(score_rows(600), SCHEMA)
    led = A.arms_ledger(df, ["run"], A.pools_of(NAMES, 3, 0b011), 4, 3, (0.0,), digits=1)
    assert led.groupBy("side", "arm").count().agg(F.max("count")).first()[0] <= 11


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 2.0), ("e", None)], "n string, v double")
    assert {r.n: r.r for r in df.withColumn("r", A.average_rank("v")).collect()} == {"a": 1, "b": 3, "c": 3, "d": 3, "e": None}


def test_lattice_arms():
    arms = A.lattice_of(("x", "y"), ("f", "g", "h"))
    assert len(arms) == 8 + 4 and len({a.name for a in arms}) == 12 and arms[0].mask == 0 and arms[8].members == ()


def plain_isotonic(points):
    """Largest of the smallest block means."""
    w, s = [p[1] for p in points], [p[2] for p in points]
    return [max(min(sum(s[j : k + 1]) / sum(w[j : k + 1]) for k in range(i, len(points))) for j in range(i + 1)) for i in range(len(points))]


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_blocks_and_values(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in ("u", None, "w"):
        for _ in range(r.choice([1, 5, 120])):
            p = round(r.random() ** 3, r.choice([1, 3, 6]))
            rows.append((k, p, int(r.random() < p), "val"))
    rows += [("u", None, 1, "val")]
    df = spark.createDataFrame(rows, "k string, p double, y int, side string").cache()
    blocks = I.fit_isotonic(df, ["k"])
    ask = spark.createDataFrame([(k, x / 37 - 0.2) for k in ("u", None, "w", "none") for x in range(60)], "k string, p double").union(df.select("k", "p").where("p is not null"))
    got = I.apply_isotonic(ask, blocks, ["k"]).collect()
    assert len(got) == ask.count()
    for key in ("u", None, "w"):
        led = defaultdict(lambda: [0, 0])
        for k, p, y, _ in rows:
            if k == key and p is not None:
                led[p][0] += 1
                led[p][1] += y
        points = sorted((p, *v) for p, v in led.items())
        value = plain_isotonic(points)
        for row in got:
            if row.k != key:
                continue
            below = [i for i, p in enumerate(points) if p[0] <= row.p]
            above = [i for i, p in enumerate(points) if p[0] >= row.p]
            if not below or not above:
                want = value[0] if not below else value[-1]
            else:
                a, b = below[-1], above[0]
                want = value[a] if a == b else value[a] + (value[b] - value[a]) * (row.p - points[a][0]) / (points[b][0] - points[a][0])
            assert row.q == pytest.approx(min(max(want, 1e-6), 1 - 1e-6))
    assert all(row.q is None for row in got if row.k == "none")


def test_pooling_commutes_with_cutting():
    r = random.Random(9)
    for _ in range(50):
        blocks = [(float(i), float(i), r.randint(1, 4), 0) for i in range(40)]
        blocks = [(a, b, w, r.randint(0, w)) for a, b, w, _ in blocks]
        cut = r.randint(0, 40)
        assert I.pooled(I.pooled(blocks[:cut]) + I.pooled(blocks[cut:])) == I.pooled(blocks)


def test_isotonic_over_many_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = [("k", i / 500, int((i * 7919) % 500 < i)) for i in range(500)]
        df = spark.createDataFrame(rows, "k string, p double, y int")
        got = [(b.lo, b.hi, b.w, b.s) for b in I.fit_isotonic(df, ["k"]).orderBy("lo").collect()]
        assert got == I.pooled([(p, p, 1, y) for _, p, y in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_null_keys_keep_their_statistics(spark):
    rows = [(k, i / 10, i % 2 if k else (i // 2) % 2, f"{k}{i}", float(i)) for k in ("a", None, "n") for i in range(9)]
    df = spark.createDataFrame(rows, "k string, p double, y int, episode_key string, ms double").withColumn("ok", F.col("y"))
    for out in (
        M.auroc(df, ["k"]), O.quantiles(df, ["k"], "p", (0.5,)), O.quantile_points(df, ["k"], "p", (0.1, 0.9)).select("k").distinct(), M.rank_correlations(df, ["k"]),
        M.average_precision_unsupported(df, ["k"]), M.latency_summary(df, ["k"]), M.risk_coverage(df, ["k"]), M.calibration_error(df, ["k"]), O.dense_index(df, ["k"], "episode_key", F.length("episode_key") / 10).select("k").distinct(),
    ):
        assert {r.k for r in out.collect()} == {"a", None, "n"}
    by = {r.k: r.auroc for r in M.auroc(df, ["k"]).collect()}
    assert by["a"] == by["n"] != by[None]
    assert by[None] == pytest.approx(plain_auroc([(p, y) for k, p, y, *_ in rows if k is None]))


STUDY = N.Study(costs=(1.0, 3.0), betas=(0.0, 1.0), seeds=(3, 4), folds=3, inner=2, masks=(0, 1), priors=(1.0, 4.0))


def study_rows(n=120):
    r = random.Random(4)
    return [(f"e{i}", f"g{i // 2}", i % 3, r.choice("xy"), int(r.random() < 0.5), *[v for _ in range(2) for v in (r.random(), r.random() < 0.9, 2 + r.random())], 0.5) for i in range(n)]


STUDY_SCHEMA = "episode_key string, content_doc_key string, fold int, b string, label_supported int, score__p double, available__p boolean, latency_ms__p double, score__q double, available__q boolean, latency_ms__q double, feature_latency_ms double"


def test_nested_study_fits_and_choices(spark):
    rows = study_rows()
    df = spark.createDataFrame(rows, STUDY_SCHEMA).cache()
    prof = N.profiles(df, STUDY, ("p", "q"), ("b",)).cache()
    assert prof.agg(F.sum("n")).first()[0] == len(rows) * 2
    inner = {(r.seed, r.episode_key): r.inner for r in N.with_inner_folds(df, STUDY, "content_doc_key").collect()}
    heads = N.fits(prof, STUDY, ("b",)).cache()
    ok = lambda r, j: r[6 + 3 * j] and (r[5 + 3 * j] >= 0.5) == (r[4] == 1)
    for h in heads.collect():
        fit = [r for r in rows if r[2] != h.outer and (h.held == N.FINAL or inner[h.seed, r[0]] != h.held)]
        for j in range(2):
            cell = [r for r in fit if h.mask == 0 or r[3] == h.cell]
            seen = lambda x: [r for r in x if r[6 + 3 * j]]
            mean = sum(ok(r, j) for r in seen(fit)) / len(seen(fit))
            want = (sum(ok(r, j) for r in seen(cell)) + h.prior * mean) / (len(seen(cell)) + h.prior)
            assert h[f"p{j}"] == pytest.approx(want)
    results = N.inner_results(prof, heads, STUDY, ("b",)).cache()
    chosen = N.selected(results).cache()
    assert chosen.count() == 2 * 3 * (1 + 2 + 2)
    best = results.groupBy("seed", "outer", "method", "trained_beta").agg(F.max(F.round("primary", 12)).alias("top"))
    assert chosen.join(best, ["seed", "outer", "method", "trained_beta"]).where("round(primary, 12) <> top").count() == 0
    pred = N.predictions(df, heads, chosen, STUDY, ("p", "q"), ("b",), ["episode_key"]).cache()
    assert pred.count() == len(rows) * 2 * 6 and pred.groupBy("episode_key", "method", "beta", "seed").count().where("count > 1").count() == 0
    for r in pred.collect():
        row = rows[int(r.episode_key[1:])]
        j = ("p", "q").index(r.selected_action)
        assert r.correct == int(ok(row, j)) and r.fold == row[2] and (row[6 + 3 * j] or not (row[6] or row[9]))
    some = pred.select("method", "beta", "seed", "fold").distinct().limit(2)
    assert N.predictions(df, heads, chosen, STUDY, ("p", "q"), ("b",), ["episode_key"], todo=some).select("method", "beta", "seed", "fold").distinct().count() == 2


def test_pools():
    assert [a.members for a in A.pools_of(NAMES, 3, 1)] == list(combinations(range(4), 3))


@pytest.mark.parametrize("n, k", [(3, 5), (200, 5), (700, 25)])
def test_nearest_mean_against_all_pairs(spark, n, k):
    r = random.Random(n)
    spot = lambda: (r.choice([r.gauss(0, 1), r.gauss(50, 0.1), 1000.0 * r.random(), 7.0]), round(r.random(), 2), r.choice([0.0, 1.0]))
    train = [(r.choice("uv"), f"t{i:04d}", *spot(), r.random()) for i in range(n)] + [("u", f"s{i:03d}", 7.0, 0.5, 1.0, r.random()) for i in range(60)]
    ask = [("uv"[i % 2], i, *spot()) for i in range(80)] + [("u", 900, 7.0, 0.5, 1.0), ("v", 901, -5000.0, 0.0, 0.0), ("none", 902, 0.0, 0.0, 0.0), ("u", 903, None, 0.0, 0.0)]
    t = spark.createDataFrame(train, "key string, id string, x double, y double, z double, value double")
    q = spark.createDataFrame(ask, "key string, ask long, x double, y double, z double")
    got = {(row.key, row.ask): row.prediction for row in nearest_mean(t, q, ["key"], ["x", "y", "z"], "value", "id", "ask", k).collect()}
    keys = {row[0] for row in train}
    assert set(got) == {(a[0], a[1]) for a in ask if a[0] in keys and None not in a}
    for key, i, *p in ask:
        if (key, i) not in got:
            continue
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, row[2:5])) ** 0.5, row[1], row[5]) for row in train if row[0] == key)[:k]
        zero = [v for d, _, v in near if d == 0]
        want = sum(zero) / len(zero) if zero else sum(v / d for d, _, v in near) / sum(1 / d for d, _, v in near)
        assert got[key, i] == pytest.approx(want)


def test_nearest_mean_meets_few_rows_of_a_crowd(spark):
    """Most rows in a thousandth of the range: a query meets rows near it, not the crowd."""
    sizes, r = [], random.Random(5)
    spots = [(r.random(), r.random()) for _ in range(2000)] + [(1000.0 * r.random(), 0.0) for _ in range(20)]
    t = spark.createDataFrame([("u", i, *p, 1.0 * i) for i, p in enumerate(spots)], "key string, id long, x double, y double, value double")
    q = spark.createDataFrame([("u", i, *p) for i, p in enumerate(spots[::40] * 3)], "key string, ask long, x double, y double")
    import routelens.operators.neighbours as near
    from routelens.sources.files import settled

    width = near._first_width(t, ["key"], ["x", "y"], [0.0, 0.0], 1000.0, len(spots), 5)
    assert t.filter(f"abs(x - 0.5) < {1.5 * width} and abs(y - 0.5) < {1.5 * width}").count() < 500
    settle = lambda d, name: (sizes.append(d.count()) if name == "pending" else None, settled(d, name))[1]
    got = {row.ask: row.prediction for row in nearest_mean(t, q, ["key"], ["x", "y"], "value", "id", "ask", 5, settle).collect()}
    assert sizes[0] == len(spots[::40]) and len(got) == 3 * sizes[0]
    assert got == pytest.approx({i: 40.0 * (i % sizes[0]) for i in got})
