"""Targets, routing, baselines, cascades and selective policies over the score matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.config import BETA_GRID, TARGET_SHARES
from routelens.functions import expr as E
from routelens.functions.hashing import uniform
from routelens.operators import metrics as M
from routelens.operators import routing as R
from routelens.operators import splits as S
from routelens.operators.ordered import join_keys, quantile_points, quantiles
from routelens.plans.metric_queries import rounded
from routelens.plans.registry import query
from routelens.plans.views import POOL, u_sql, wide, with_sql

CELL = ("dataset_key", "long_doc")
EPS = 0.005


def sides(spark, sf):
    """The score matrix with fit / val / test sides; groups never straddle."""
    w = wide(spark, sf)
    held = S.holdout_groups(w.filter("role = 'train'"), 17)
    j = w.join(held, "content_doc_key", "left")
    side = F.when(F.col("role") == "test", "test").when(F.col("held"), "val").otherwise("fit")
    return j.withColumn("side", side).withColumn("long_doc", F.col("feature_latency_ms") >= 2.0).drop("held")


def setup(spark, sf):
    """Rows with their head values, and the fit-side cost of each action."""
    s = sides(spark, sf).persist()  # read again by every fitted parameter; a lost block is recomputed
    fit = s.filter("side = 'fit'")
    heads = R.cell_heads(fit, POOL, CELL)
    d = s.join(heads, list(CELL), "left").fillna(0.5, subset=[f"head__{a}" for a in POOL])
    return d, R.one_row(R.mean_costs(fit, POOL), POOL)


def chosen_beta(d, costs):
    return R.choose_beta(R.beta_ledger(d.filter("side = 'val'"), POOL, costs, BETA_GRID), EPS).first()[0]


def routed(d, costs, beta):
    return R.select_action(d, POOL, R.utilities(POOL, costs, beta))


# SQL mirror of the same views; i indexes the pool
I = (0, 1, 2)
_G = "greatest"
_SIDES = [
    "strata AS (SELECT content_doc_key AS g, min(dataset_key) AS d, round_even(avg(label_supported::double),0)::int AS y FROM wide WHERE role='train' GROUP BY 1)",
    f"held AS (SELECT g, idx < greatest(round_even(n*0.2::double,0),1) AS held FROM (SELECT g, row_number() OVER (PARTITION BY d, y ORDER BY {u_sql(chr(39)+'split'+chr(39), chr(39)+'17'+chr(39), 'g')}, g)-1 AS idx, count(*) OVER (PARTITION BY d, y) AS n FROM strata))",
    "sides AS (SELECT w.*, CASE WHEN role='test' THEN 'test' WHEN held THEN 'val' ELSE 'fit' END AS side, feature_latency_ms>=2 AS long_doc, "
    + ", ".join(f"CASE WHEN label_supported=1 THEN c{i} ELSE 1-c{i} END AS q{i}" for i in I)
    + " FROM wide w LEFT JOIN held ON g=content_doc_key)",
]
_SETUP = [
    *_SIDES,
    "heads AS (SELECT dataset_key, long_doc, " + ", ".join(f"avg(1+(q{i}-greatest(q0,q1,q2))) FILTER (a{i}) AS h{i}" for i in I) + " FROM sides WHERE side='fit' GROUP BY ALL)",
    "costs AS (SELECT " + ", ".join(f"avg(l{i}) FILTER (a{i}) AS k{i}" for i in I) + " FROM sides WHERE side='fit')",
    "base AS (SELECT s.*, " + ", ".join(f"coalesce(h{i},0.5::double) AS h{i}" for i in I) + ", k0, k1, k2, greatest(k0,k1,k2) AS kmax FROM sides s LEFT JOIN heads USING (dataset_key, long_doc), costs)",
]
_AUC = """SELECT {k}, CASE WHEN sum(pos)>0 AND sum(neg)>0 THEN sum(pos*(below+neg/2.0::double))/(sum(pos)*sum(neg)) END AS auroc FROM (
 SELECT *, coalesce(sum(neg) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::double AS below
 FROM (SELECT {k}, p, sum({y})::double AS pos, sum(1-{y})::double AS neg FROM {t} GROUP BY ALL)) GROUP BY {k}"""


def pick(prefix: str, idx: str) -> str:
    return f"CASE {idx} WHEN 0 THEN {prefix}0 WHEN 1 THEN {prefix}1 WHEN 2 THEN {prefix}2 END"


def argmax(exprs: list[str], av: list[str] | None = None) -> str:
    u = [f"CASE WHEN {a} THEN {x} END" for a, x in zip(av, exprs)] if av else exprs
    g = f"greatest({', '.join(u)})"
    return f"CASE WHEN {u[0]}={g} THEN 0 WHEN {u[1]}={g} THEN 1 WHEN {u[2]}={g} THEN 2 END"


AV = ["a0", "a1", "a2"]
NAME = "['v_cheap','v_mid','v_high'][sel+1]"
UTIL = [f"h{i}*exp(-beta*k{i}/kmax)" for i in I]
_BETAS = "(VALUES " + ",".join(f"({b}::double)" for b in BETA_GRID) + ") bg(beta)"
_LEDGER = [
    f"vr AS (SELECT *, {pick('c', 'sel')} AS p, {pick('l', 'sel')}+feature_latency_ms AS ms FROM (SELECT *, {argmax(UTIL, AV)} AS sel FROM base, {_BETAS} WHERE side='val'))",
    "ledger AS (SELECT beta, auroc, mean_ms FROM (" + _AUC.format(k="beta", t="vr", y="label_supported") + ") JOIN (SELECT beta, avg(ms) AS mean_ms FROM vr GROUP BY 1) USING (beta))",
    "best AS (SELECT arg_min(beta, (round(mean_ms,9), beta)) AS beta FROM ledger WHERE round(auroc,12)>=round((SELECT max(auroc) FROM ledger)-0.005::double,12))",
]
_ROUTED = [
    *_SETUP, *_LEDGER,
    f"routed AS (SELECT *, {NAME} AS selected_action, {pick('c', 'sel')} AS p, {pick('l', 'sel')} AS vms FROM (SELECT *, {argmax(UTIL, AV)} AS sel FROM base, best))",
]


def sql(body: str, *views: str) -> str:
    return with_sql(body, "wide", *views)


# ------------------------------------------------------------------------------ targets and costs

for _kind, _expr in {
    "regret": "1+(q{i}-greatest(q0,q1,q2))", "prob_quality": "q{i}", "brier": "1-(c{i}-label_supported)*(c{i}-label_supported)",
    "pairwise_rank": "((q{i}>q0)::int+(q{i}>q1)::int+(q{i}>q2)::int)/2.0::double",
    "correctness": "((s{i}>=0.5::double)=(label_supported=1))::int::double", "is_best": "(q{i}>=greatest(q0,q1,q2)-1e-12::double)::int::double",
}.items():
    def _target(spark, sf, kind=_kind):
        s = sides(spark, sf)
        return rounded(s.select("episode_key", *[t.alias(f"t{i}") for i, t in enumerate(R.targets(POOL, kind))]))

    query(f"target_{_kind}", "H1", sql("SELECT episode_key, " + ", ".join(f"round({_expr.format(i=i)},6) AS t{i}" for i in I) + " FROM sides", *_SIDES))(_target)


@query("pairwise_preference_targets", "H6", sql("""
SELECT a AS first, b AS second, sum(t)::bigint AS wins, count(*) AS pairs, round(sum(gap),6) AS weight FROM (
 SELECT ['v_cheap','v_mid','v_high'][i+1] AS a, ['v_cheap','v_mid','v_high'][j+1] AS b, (r[i+1]>r[j+1])::int AS t, abs(r[i+1]-r[j+1]) AS gap FROM (
  SELECT [r0,r1,r2] AS r, [a0,a1,a2] AS av, i, j FROM (SELECT *, """ + ", ".join(f"((s{i}>=0.5::double)=(label_supported=1))::int*exp(-0.4::double*k{i}/kmax) AS r{i}" for i in I) +
    """ FROM base) , (VALUES (0,1),(0,2),(1,2)) v(i,j) WHERE (a0 AND r0>0) OR (a1 AND r1>0) OR (a2 AND r2>0)) WHERE av[i+1] AND av[j+1] AND abs(r[i+1]-r[j+1])>1e-12::double) GROUP BY ALL""", *_SETUP))
def pairwise_preference_targets(spark, sf):
    d, costs = setup(spark, sf)
    p = R.pairwise_preferences(d, POOL, E.discounts(F.lit(0.4), costs), ["episode_key"])
    return rounded(p.groupBy("first", "second").agg(F.sum("target").cast("bigint").alias("wins"), F.count("*").alias("pairs"), F.sum("gap").alias("weight")))


@query("training_costs", "R1", sql("""
SELECT v AS verifier, round(k,6) AS cost, rank() OVER (ORDER BY k) AS cost_rank FROM (SELECT unnest(['v_cheap','v_mid','v_high']) AS v, unnest([k0,k1,k2]) AS k FROM costs)""", *_SETUP))
def training_costs(spark, sf):
    fit = sides(spark, sf).filter("side = 'fit'")
    c = R.mean_costs(fit, POOL).unpivot([], list(POOL), "verifier", "cost")
    # the pool is a bounded dimension: at most one row per verifier is ranked
    from pyspark.sql import Window as W
    return rounded(c.withColumn("cost_rank", F.rank().over(W.partitionBy(F.lit(1)).orderBy("cost")).cast("bigint")))


@query("cost_discount_factors", "R2", sql("""
SELECT beta, round(exp(-beta*k0/kmax),6) AS d0, round(exp(-beta*k1/kmax),6) AS d1, round(exp(-beta*k2/kmax),6) AS d2 FROM (SELECT *, greatest(k0,k1,k2) AS kmax FROM costs), """ + _BETAS, *_SETUP))
def cost_discount_factors(spark, sf):
    fit = sides(spark, sf).filter("side = 'fit'")
    c = R.mean_costs(fit, POOL).withColumn("beta", F.explode(F.array(*[F.lit(b) for b in BETA_GRID])))
    return rounded(c.select("beta", *[d.alias(f"d{i}") for i, d in enumerate(E.discounts(F.col("beta"), [F.col(a) for a in POOL]))]))


# ------------------------------------------------------------------------------ routing

@query("beta_ledger", "R5", sql("SELECT beta, round(auroc,6) AS auroc, round(mean_ms,6) AS mean_ms FROM ledger", *_SETUP, *_LEDGER))
def beta_ledger(spark, sf):
    d, costs = setup(spark, sf)
    return rounded(R.beta_ledger(d.filter("side = 'val'"), POOL, costs, BETA_GRID))


@query("beta_choice", "R5", sql("SELECT beta FROM best", *_SETUP, *_LEDGER))
def beta_choice(spark, sf):
    d, costs = setup(spark, sf)
    return R.choose_beta(R.beta_ledger(d.filter("side = 'val'"), POOL, costs, BETA_GRID), EPS)


@query("beta_choice_product", "R6 R1", sql("""
SELECT arg_max(beta, (g, -beta)) AS beta, round(max(g),6) AS gain FROM (SELECT beta, round(greatest((auroc-qf)/(qg-qf),0)*greatest((cg-mean_ms)/(cg-cf),0),12) AS g FROM ledger,
 (SELECT arg_min(auroc, cost) AS qf, min(cost) AS cf FROM act), (SELECT max(auroc) AS qg, arg_max(cost, (auroc, -i)) AS cg FROM act WHERE cost>(SELECT min(cost) FROM act)))""", *_SETUP, *_LEDGER,
    "ua AS (SELECT i, s AS p, label_supported FROM (SELECT label_supported, unnest([0,1,2]) AS i, unnest([s0,s1,s2]) AS s, unnest([a0,a1,a2]) AS a FROM base WHERE side='val') WHERE a)",
    "act AS (SELECT x.i, auroc, [k0,k1,k2][x.i+1] AS cost FROM (" + _AUC.format(k="i", t="ua", y="label_supported") + ") x, costs)"))
def beta_choice_product(spark, sf):
    d, costs = setup(spark, sf)
    val, price = d.filter("side = 'val'"), R.mean_costs(d.filter("side = 'fit'"), POOL).first().asDict()
    return rounded(R.choose_beta_product(R.beta_ledger(val, POOL, costs, BETA_GRID), R.action_aurocs(val, POOL), price))


@query("route_rows", "R3 R4 R22", sql("""
SELECT episode_key, selected_action, round(p,6) AS p, CASE WHEN p>=0.5::double THEN 1 ELSE 0 END AS d, CASE WHEN (p>=0.5::double)=(label_supported=1) THEN 1 ELSE 0 END AS ok,
 round(vms,6) AS verifier_ms, round(vms+feature_latency_ms,6) AS ms FROM routed WHERE side='test'""", *_ROUTED))
def route_rows(spark, sf):
    d, costs = setup(spark, sf)
    r = routed(d.filter("side = 'test'"), costs, F.lit(chosen_beta(d, costs)))
    f = R.prediction_frame(r, ["episode_key"], F.col("feature_latency_ms"))
    out = rounded(f.select("episode_key", "selected_action", "p", "verifier_ms", "ms", "d", "ok"))
    return out.withColumn("d", F.col("d").cast("int")).withColumn("ok", F.col("ok").cast("int"))


_SCOPED = """scoped AS (SELECT 'ALL' AS scope, * FROM routed WHERE side='test' UNION ALL SELECT dataset_key, * FROM routed WHERE side='test')"""


@query("route_confirmatory_report", "X1 R1 R2 R3 R4 R5 M1 M6 M11 M13 J11 P13", sql("""
SELECT s.scope, count(*) AS n_rows, count(DISTINCT content_doc_key) AS source_groups, any_value(beta) AS beta, round(any_value(auroc),6) AS auroc,
 round(avg(vms+feature_latency_ms),6) AS mean_ms, round(quantile_cont(vms+feature_latency_ms,0.5),6) AS p50_ms, round(quantile_cont(vms+feature_latency_ms,0.95),6) AS p95_ms,
 round(avg((selected_action='v_cheap')::int),6) AS rate_v_cheap, round(avg((selected_action='v_mid')::int),6) AS rate_v_mid, round(avg((selected_action='v_high')::int),6) AS rate_v_high
FROM scoped s JOIN au ON s.scope IS NOT DISTINCT FROM au.scope GROUP BY s.scope""", *_ROUTED, _SCOPED, "au AS (" + _AUC.format(k="scope", t="scoped", y="label_supported") + ")"))
def route_confirmatory_report(spark, sf):
    d, costs = setup(spark, sf)
    beta = chosen_beta(d, costs)
    r = routed(d.filter("side = 'test'").withColumn("beta", F.lit(beta)), costs, F.col("beta"))
    f = R.prediction_frame(r, ["dataset_key", "content_doc_key", "beta"], F.col("feature_latency_ms"))
    x = f.withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col("dataset_key"))))
    base = x.groupBy("scope").agg(
        F.count("*").alias("n_rows"), F.count_distinct("content_doc_key").alias("source_groups"), F.max("beta").alias("beta"), F.avg("ms").alias("mean_ms"),
        *[F.avg((F.col("selected_action") == a).cast("double")).alias(f"rate_{a}") for a in POOL])
    tail = quantiles(x, ["scope"], "ms", (0.5, 0.95), names=("p50_ms", "p95_ms"))
    return rounded(join_keys(join_keys(base, M.auroc(x, ["scope"]), ["scope"]), tail, ["scope"]))


@query("call_shares", "M13 M11", sql("""
SELECT coalesce(dataset_key,'ALL') AS dataset_key, count(*) AS n_rows, round(avg((selected_action='v_cheap')::int),6) AS v_cheap, round(avg((selected_action='v_mid')::int),6) AS v_mid,
 round(avg((selected_action='v_high')::int),6) AS v_high, round(avg((selected_action<>'v_cheap')::int),6) AS upgrade_rate FROM routed WHERE side='test' GROUP BY GROUPING SETS ((), (dataset_key))""", *_ROUTED))
def call_shares(spark, sf):
    d, costs = setup(spark, sf)
    r = routed(d.filter("side = 'test'"), costs, F.lit(chosen_beta(d, costs)))
    g = r.rollup("dataset_key").agg(F.count("*").alias("n_rows"), *[F.avg((F.col("selected_action") == a).cast("double")).alias(a) for a in POOL],
                                    F.avg((F.col("selected_action") != "v_cheap").cast("double")).alias("upgrade_rate"))
    return rounded(g.withColumn("dataset_key", F.coalesce("dataset_key", F.lit("ALL"))))


@query("latency_breakdown", "M12 R22", sql("""
SELECT round(sum(vms)/sum(n),6) AS verifier_ms, round(sum(f)/sum(n),6) AS feature_ms, round(sum(e)/sum(n),6) AS total_ms, round(max(abs(e-vms-f)),6) AS worst_gap, sum(n)::bigint AS n_rows FROM (
 SELECT dataset_key, count(*) AS n, sum(vms) AS vms, sum(feature_latency_ms) AS f, sum(vms+feature_latency_ms) AS e FROM routed WHERE side='test' GROUP BY 1)""", *_ROUTED))
def latency_breakdown(spark, sf):
    d, costs = setup(spark, sf)
    f = R.prediction_frame(routed(d.filter("side = 'test'"), costs, F.lit(chosen_beta(d, costs))), ["dataset_key"], F.col("feature_latency_ms"))
    g = f.groupBy("dataset_key").agg(F.count("*").alias("n"), F.sum("verifier_ms").alias("v"), F.sum("feature_ms").alias("f"), F.sum("ms").alias("e"))
    n = F.sum("n")
    return rounded(g.agg((F.sum("v") / n).alias("verifier_ms"), (F.sum("f") / n).alias("feature_ms"), (F.sum("e") / n).alias("total_ms"),
                         F.max(F.abs(F.col("e") - F.col("v") - F.col("f"))).alias("worst_gap"), n.alias("n_rows")))


@query("selection_utility", "M21", sql("""
SELECT round(avg(((p>=0.5::double)=(label_supported=1))::int*exp(-0.4::double*""" + pick("k", "sel") + """/kmax)),6) AS utility,
 round((avg((p>=0.5::double)::int) FILTER (label_supported=1)+avg((p<0.5::double)::int) FILTER (label_supported=0))/2,6) AS bacc, round(avg(vms),6) AS mean_ms FROM routed WHERE side='test'""", *_ROUTED))
def selection_utility(spark, sf):
    d, costs = setup(spark, sf)
    r = routed(d.filter("side = 'test'"), costs, F.lit(chosen_beta(d, costs)))
    y, dec = F.col("label_supported"), F.col("p") >= 0.5
    disc = E.pick(E.discounts(F.lit(0.4), costs), F.col("sel"))
    return rounded(r.agg(F.avg((dec == (y == 1)).cast("double") * disc).alias("utility"),
                         ((F.avg(F.when(y == 1, dec.cast("double"))) + F.avg(F.when(y == 0, (~dec).cast("double")))) / 2.0).alias("bacc"), F.avg("verifier_ms").alias("mean_ms")))


@query("serving_mask", "R21", sql(f"""
SELECT {NAME} AS selected_action, count(*) AS n_rows, round(avg({pick('c', 'sel')}),6) AS mean_p FROM (SELECT *, {argmax(UTIL, ['a0', 'a1', 'false'])} AS sel FROM base, best WHERE side='test') GROUP BY ALL""", *_SETUP, *_LEDGER))
def serving_mask(spark, sf):
    d, costs = setup(spark, sf)
    r = R.select_action(d.filter("side = 'test'"), POOL, R.utilities(POOL, costs, F.lit(chosen_beta(d, costs))), blocked=("v_high",))
    return rounded(r.groupBy("selected_action").agg(F.count("*").alias("n_rows"), F.avg("p").alias("mean_p")))


@query("random_heads", "R21", sql(f"""
SELECT {NAME} AS selected_action, count(*) AS n_rows, round(avg({pick('c', 'sel')}),6) AS mean_p FROM (SELECT *, {argmax([u_sql(chr(39) + 'head' + chr(39), 'episode_key', chr(39) + v + chr(39)) for v in POOL], AV)} AS sel FROM sides WHERE side='test') GROUP BY ALL""", *_SIDES))
def random_heads(spark, sf):
    t = sides(spark, sf).filter("side = 'test'")
    r = R.select_action(t, POOL, [uniform("head", F.col("episode_key"), v) for v in POOL])
    return rounded(r.groupBy("selected_action").agg(F.count("*").alias("n_rows"), F.avg("p").alias("mean_p")))


# ------------------------------------------------------------------------------ baselines

_OK = [f"((s{i}>=0.5::double)=(label_supported=1))::int" for i in I]
_SUITE = [
    "tests AS (SELECT * FROM base WHERE side='test')",
    "suite AS (" + " UNION ALL ".join(
        [f"SELECT 'always_{v}' AS system, *, {argmax([str(float(j == i)) + '::double' for j in I], AV)} AS sel FROM tests" for i, v in enumerate(POOL)]
        + [f"SELECT 'oracle' AS system, *, {argmax([f'{_OK[i]}+(kmax-k{i})*1e-9::double' for i in I], AV)} AS sel FROM tests"]) + ")",
]
_SUITE_SCOPE = f"""x AS (SELECT *, {pick('c', 'sel')} AS p, {pick('l', 'sel')} AS ms FROM suite), y AS (SELECT 'ALL' AS scope, * FROM x UNION ALL SELECT dataset_key, * FROM x)"""


@query("baseline_suite", "R7 R8 X17 M11", sql("""
SELECT system, scope, count(*) AS n_rows, round(any_value(auroc),6) AS auroc, round(avg(ms),6) AS mean_ms, round(avg(((p>=0.5::double)=(label_supported=1))::int),6) AS acc
FROM y JOIN au USING (system, scope) GROUP BY ALL""", *_SETUP, *_SUITE, _SUITE_SCOPE, "au AS (" + _AUC.format(k="system, scope", t="y", y="label_supported") + ")"))
def baseline_suite(spark, sf):
    d, costs = setup(spark, sf)
    t = d.filter("side = 'test'")
    parts = [R.fixed_action(t, POOL, v).withColumn("system", F.lit(f"always_{v}")) for v in POOL] + [R.cheapest_correct(t, POOL, costs).withColumn("system", F.lit("oracle"))]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    f = R.prediction_frame(x, ["system", "dataset_key"]).withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col("dataset_key"))))
    g = f.groupBy("system", "scope").agg(F.count("*").alias("n_rows"), F.avg("ms").alias("mean_ms"), F.avg(F.col("ok").cast("double")).alias("acc"))
    return rounded(g.join(M.auroc(f, ["system", "scope"]), ["system", "scope"]))


_SHARES = "sh AS (SELECT " + ", ".join(f"avg((selected_action='{v}')::int) AS w{i}" for i, v in enumerate(POOL)) + " FROM routed WHERE side='test')"
_UCTL = u_sql("'control'", "'5'", "episode_key")


def _control_sql(renorm: bool) -> str:
    if renorm:
        w = [f"CASE WHEN tot>0 THEN (CASE WHEN a{i} THEN w{i} ELSE 0 END)/tot ELSE a{i}::int::double/(a0::int+a1::int+a2::int) END" for i in I]
        inner = f"SELECT *, {w[0]} AS z0, {w[1]} AS z1, {w[2]} AS z2, {_UCTL} AS u FROM (SELECT *, (CASE WHEN a0 THEN w0 ELSE 0 END)+(CASE WHEN a1 THEN w1 ELSE 0 END)+(CASE WHEN a2 THEN w2 ELSE 0 END) AS tot FROM routed, sh WHERE side='test')"
        sel = f"SELECT *, least((u>z0)::int+(u>z0+z1)::int+(u>z0+z1+z2)::int,2) AS sel2 FROM ({inner})"
    else:
        inner = f"SELECT *, least((u>w0)::int+(u>w0+w1)::int+(u>w0+w1+w2)::int,2) AS pk FROM (SELECT *, {_UCTL} AS u FROM routed, sh WHERE side='test')"
        sel = f"SELECT *, CASE WHEN {pick('a', 'pk')} THEN pk WHEN a0 THEN 0 WHEN a1 THEN 1 ELSE 2 END AS sel2 FROM ({inner})"
    return f"SELECT ['v_cheap','v_mid','v_high'][sel2+1] AS selected_action, count(*) AS n_rows, round(avg({pick('c', 'sel2')}),6) AS mean_p, round(avg({pick('l', 'sel2')}),6) AS mean_ms FROM ({sel}) GROUP BY ALL"


def _control(spark, sf, renormalise):
    d, costs = setup(spark, sf)
    r = routed(d.filter("side = 'test'"), costs, F.lit(chosen_beta(d, costs)))
    shares = R.one_row(R.action_shares(r, POOL), POOL)
    t = d.filter("side = 'test'")
    c = R.matched_random(t, POOL, shares, 5, renormalise=renormalise)
    return rounded(c.groupBy("selected_action").agg(F.count("*").alias("n_rows"), F.avg("p").alias("mean_p"), F.avg("verifier_ms").alias("mean_ms")))


@query("matched_random_renormalised", "R9", sql(_control_sql(True), *_ROUTED, _SHARES))
def matched_random_renormalised(spark, sf):
    return _control(spark, sf, True)


@query("matched_random_fallback", "R9", sql(_control_sql(False), *_ROUTED, _SHARES))
def matched_random_fallback(spark, sf):
    return _control(spark, sf, False)


@query("control_bank", "R9 X10", sql("""
SELECT draw, count(*) AS n_rows, round(avg(CASE WHEN (p2>=0.5::double)=(label_supported=1) THEN 1.0::double ELSE 0 END),6) AS acc FROM (
 SELECT *, """ + pick("c", "CASE WHEN " + pick("a", "pk") + " THEN pk WHEN a0 THEN 0 WHEN a1 THEN 1 ELSE 2 END") + """ AS p2 FROM (
  SELECT *, least((u>w0)::int+(u>w0+w1)::int+(u>w0+w1+w2)::int,2) AS pk FROM (SELECT *, """ + u_sql("'control'", "draw", "episode_key") + """ AS u FROM routed, sh, range(16) r(draw) WHERE side='test'))) GROUP BY draw""", *_ROUTED, _SHARES))
def control_bank(spark, sf):
    d, costs = setup(spark, sf)
    r = routed(d.filter("side = 'test'"), costs, F.lit(chosen_beta(d, costs)))
    shares = R.one_row(R.action_shares(r, POOL), POOL)
    t = d.filter("side = 'test'").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))))
    c = R.matched_random(t, POOL, shares, F.col("draw"), renormalise=False)
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("label_supported")).cast("double")
    return rounded(c.groupBy("draw").agg(F.count("*").alias("n_rows"), F.avg(hit).alias("acc")))


_CHAIN = """chain AS (SELECT *, CASE WHEN st0 THEN 0 WHEN st1 THEN 1 WHEN a2 THEN 2 WHEN a1 THEN 1 WHEN a0 THEN 0 ELSE 2 END AS lv FROM (
 SELECT *, a0 AND abs(c0-0.5::double)>0.15::double AS st0, a1 AND abs(c1-0.5::double)>0.15::double AS st1 FROM base WHERE side='test')),
cc AS (SELECT *, (CASE WHEN a0 THEN l0 ELSE 0 END)+(CASE WHEN a1 AND NOT st0 THEN l1 ELSE 0 END)+(CASE WHEN a2 AND NOT st0 AND NOT st1 THEN l2 ELSE 0 END) AS cost,
 a0::int+(a1 AND NOT st0)::int+(a2 AND NOT st0 AND NOT st1)::int AS calls, """ + pick("c", "lv") + """ AS p FROM chain)"""


@query("confidence_chain", "R11", sql("""
SELECT lv AS level, count(*) AS n_rows, round(avg(p),6) AS mean_p, round(avg(cost),6) AS mean_ms, round(avg(calls),6) AS mean_calls FROM cc GROUP BY lv""", *_SETUP, _CHAIN))
def confidence_chain(spark, sf):
    d, _ = setup(spark, sf)
    c = R.confidence_chain(d.filter("side = 'test'"), POOL, 0.15)
    out = c.groupBy(F.col("sel").alias("level")).agg(F.count("*").alias("n_rows"), F.avg("p").alias("mean_p"), F.avg("verifier_ms").alias("mean_ms"), F.avg("calls").alias("mean_calls"))
    return rounded(out).withColumn("level", F.col("level").cast("int"))


@query("matched_random_chain", "R10", sql("""
SELECT sel2 AS level, count(*) AS n_rows, round(avg((CASE WHEN a0 THEN l0 ELSE 0 END)+(CASE WHEN a1 AND sel2>=1 THEN l1 ELSE 0 END)+(CASE WHEN a2 AND sel2>=2 THEN l2 ELSE 0 END)),6) AS mean_ms,
 round(avg(a0::int+(a1 AND sel2>=1)::int+(a2 AND sel2>=2)::int),6) AS mean_calls FROM (
 SELECT *, least((u>z0)::int+(u>z0+z1)::int+(u>z0+z1+z2)::int,2) AS sel2 FROM (
  SELECT *, """ + ", ".join(f"CASE WHEN tot>0 THEN (CASE WHEN a{i} THEN w{i} ELSE 0 END)/tot ELSE a{i}::int::double/(a0::int+a1::int+a2::int) END AS z{i}" for i in I) + f""", {_UCTL} AS u FROM (
   SELECT *, (CASE WHEN a0 THEN w0 ELSE 0 END)+(CASE WHEN a1 THEN w1 ELSE 0 END)+(CASE WHEN a2 THEN w2 ELSE 0 END) AS tot FROM cc, (SELECT """ + ", ".join(f"avg((lv={i})::int) AS w{i}" for i in I) + """ FROM cc)))) GROUP BY 1""", *_SETUP, _CHAIN))
def matched_random_chain(spark, sf):
    d, _ = setup(spark, sf)
    t = d.filter("side = 'test'")
    shares = R.one_row(R.action_shares(R.confidence_chain(t, POOL, 0.15), POOL), POOL)
    c = R.matched_random(t, POOL, shares, 5)
    cost, calls = R.chain_cost(POOL, F.col("sel"))
    out = c.groupBy(F.col("sel").alias("level")).agg(F.count("*").alias("n_rows"), F.avg(cost).alias("mean_ms"), F.avg(calls).alias("mean_calls"))
    return rounded(out).withColumn("level", F.col("level").cast("int"))


# ------------------------------------------------------------------------------ escalation

def _escalated(spark, sf, kind):
    d, costs = setup(spark, sf)
    beta = F.lit(chosen_beta(d, costs))
    r = routed(d, costs, beta)
    ref = r.filter("side = 'val'").agg(F.avg(R.latency_ceiling(F.col("verifier_ms"), F.col("feature_latency_ms")))).first()[0]
    x = R.escalation(r, POOL, costs, kind, beta).persist()
    tau = R.choose_tau(x.filter("side = 'val'"), ref).first()[0]
    e = R.escalate(x.filter("side = 'test'").withColumn("tau", F.lit(tau)), F.col("tau"))
    g = e.withColumn("system", F.lit(kind)).groupBy("system").agg(
        F.max("tau").alias("tau"), F.avg("verifier_ms").alias("mean_ms"), F.avg("calls").alias("mean_calls"), F.count("*").alias("n_rows"))
    return rounded(g.join(M.auroc(e.withColumn("system", F.lit(kind)), ["system"], "p", "label_supported"), "system"))


def _esc_sql(kind: str) -> tuple[str, list[str]]:
    first = "0" if kind == "cascade" else "sel"
    nxt = argmax([f"CASE WHEN {first}<>{i} THEN h{i} END" for i in I], AV)
    conf = {
        "cascade": "abs(c0-0.5::double)", "second_verifier_confidence": "abs(p-0.5::double)",
        "second_raw_margin": "list_sort([h0,h1,h2],'DESC')[1]-list_sort([h0,h1,h2],'DESC')[2]",
        "second_discounted_margin": f"list_sort([{','.join(UTIL)}],'DESC')[1]-list_sort([{','.join(UTIL)}],'DESC')[2]",
    }[kind]
    p1 = "c0" if kind == "cascade" else "p"
    pn = pick("c", "nx")
    p2 = pn if kind == "cascade" else f"(p+{pn})*0.5::double"
    views = [
        *_ROUTED,
        f"e0 AS (SELECT *, coalesce({nxt},{first}) AS nx FROM routed)",
        f"e1 AS (SELECT side, label_supported, vms, {p1} AS p1, {p2} AS p2, {'l0' if kind == 'cascade' else 'vms'} AS b1, feature_latency_ms AS fms, {pick('l', 'nx')} AS b2, {conf} AS conf FROM e0)",
        "taus AS (SELECT DISTINCT round(unnest(q),9) AS tau FROM (SELECT quantile_cont(conf, [" + ",".join(f"{0.6 * i / 24!r}::double" for i in range(25)) + "]) AS q FROM e1 WHERE side='val'))",
        "ev AS (SELECT tau, label_supported, CASE WHEN conf<tau THEN p2 ELSE p1 END AS p, b1+CASE WHEN conf<tau THEN b2 ELSE 0 END AS ms FROM e1, taus WHERE side='val')",
        "tl AS (SELECT tau, auroc FROM (" + _AUC.format(k="tau", t="ev", y="label_supported") + ") JOIN (SELECT tau, avg(ms) AS m FROM ev GROUP BY 1) USING (tau) WHERE m<=(SELECT avg(1.5::double*(vms+fms)-fms) FROM e1 WHERE side='val'))",
        "tb AS (SELECT coalesce(arg_max(tau, (round(auroc,12), -tau)),0) AS tau FROM tl)",
        f"ee AS (SELECT '{kind}' AS system, tau, label_supported, CASE WHEN conf<tau THEN p2 ELSE p1 END AS p, b1+CASE WHEN conf<tau THEN b2 ELSE 0 END AS ms, 1+(conf<tau)::int AS calls FROM e1, tb WHERE side='test')",
        "au AS (" + _AUC.format(k="system", t="ee", y="label_supported") + ")",
    ]
    body = "SELECT system, round(any_value(tau),6) AS tau, round(avg(ms),6) AS mean_ms, round(avg(calls),6) AS mean_calls, count(*) AS n_rows, round(any_value(auroc),6) AS auroc FROM ee JOIN au USING (system) GROUP BY system"
    return body, views


for _kind, _cov in (("cascade", "R12"), ("second_verifier_confidence", "R15"), ("second_raw_margin", "R15"), ("second_discounted_margin", "R15")):
    def _esc(spark, sf, kind=_kind):
        return _escalated(spark, sf, kind)

    _b, _v = _esc_sql(_kind)
    query(f"escalate_{_kind}", f"{_cov} X11", sql(_b, *_v))(_esc)


@query("escalate_disagreement", "R13 X11", sql("""
SELECT round(any_value(auroc),6) AS auroc, round(avg(ms),6) AS mean_ms, round(avg(calls),6) AS mean_calls, count(*) AS n_rows FROM dd JOIN au USING (system)""", *_SETUP,
    """dd AS (SELECT 'd' AS system, label_supported, CASE WHEN df THEN c2 ELSE (c0+c1)*0.5::double END AS p, l0+l1+CASE WHEN df THEN l2 ELSE 0 END AS ms, 2+df::int AS calls FROM (
 SELECT *, (c0>=0.5::double)<>(c1>=0.5::double) AS df FROM base WHERE side='test'))""", "au AS (" + _AUC.format(k="system", t="dd", y="label_supported") + ")"))
def escalate_disagreement(spark, sf):
    d, costs = setup(spark, sf)
    e = R.disagreement(d.filter("side = 'test'"), POOL, costs).withColumn("system", F.lit("d"))
    g = e.groupBy("system").agg(F.avg("verifier_ms").alias("mean_ms"), F.avg("calls").alias("mean_calls"), F.count("*").alias("n_rows"))
    return rounded(g.join(M.auroc(e, ["system"], "p", "label_supported"), "system").drop("system"))


# ------------------------------------------------------------------------------ target mix

def noisy_heads(d):
    """Cell heads spread by a hash draw, so that shares can be moved in small steps."""
    return d.withColumns({f"head__{a}": F.col(f"head__{a}") * (F.lit(0.5) + F.lit(0.5) * uniform("price", F.col("episode_key"), a)) for a in POOL})


@query("target_mix_prices", "R16")
def target_mix_prices(spark, sf):
    d, _ = setup(spark, sf)
    got = R.calibrate_prices(noisy_heads(d), POOL, TARGET_SHARES)
    return d.limit(1).select(*[F.lit(v).alias(k) for k, v in got.items()])


@query("target_mix_reselection", "R17 X15")
def target_mix_reselection(spark, sf):
    """Prices are fitted on the other fold and applied to the held one."""
    d, _ = setup(spark, sf)
    d = noisy_heads(d).withColumn("fold", F.floor(uniform("mix", F.col("content_doc_key")) * 2))
    out = None
    for fold in (0, 1):
        got = R.calibrate_prices(d.filter(F.col("fold") != fold), POOL, TARGET_SHARES)
        r = R.priced_selection(d.filter(F.col("fold") == fold), POOL, [F.lit(got["low_price"]), F.lit(0.0), F.lit(got["high_price"])])
        part = r.withColumn("price_low", F.lit(got["low_price"])).withColumn("price_high", F.lit(got["high_price"])).withColumn("calibration_l1", F.lit(got["l1"]))
        out = part if out is None else out.unionByName(part)
    g = out.groupBy("fold").agg(F.count("*").alias("n_rows"), F.max("price_low").alias("price_low"), F.max("price_high").alias("price_high"), F.max("calibration_l1").alias("calibration_l1"),
                                *[F.avg((F.col("selected_action") == a).cast("double")).alias(f"rate_{a}") for a in POOL])
    worst = F.greatest(*[F.abs(F.col(f"rate_{a}") - s) for a, s in zip(POOL, TARGET_SHARES)])
    return rounded(g.withColumn("max_share_error", worst).withColumn("eligible", worst <= 0.05))


# ------------------------------------------------------------------------------ selective policies

BANDS = {"v_cheap": (0.15, 0.85), "v_mid": (0.25, 0.75), "v_high": (0.35, 0.65)}
PRICE = {"v_cheap": 20.0, "v_mid": 60.0, "v_high": 250.0}
_DEC = [f"CASE WHEN s{i}<={BANDS[v][0]}::double THEN 0 WHEN s{i}>={BANDS[v][1]}::double THEN 1 END AS d{i}" for i, v in enumerate(POOL)]
_STOP = f"stops AS (SELECT *, {', '.join(_DEC)} FROM base)"


@query("selective_targets", "H10", sql("""
SELECT episode_key, label_supported AS y, """ + ", ".join(
    f"d{i} AS decision__{v}, coalesce(d{i}=label_supported,false) AS correct_stop__{v}, coalesce(d{i}<>label_supported,false) AS wrong_stop__{v}, round({PRICE[v]}::double/330.0::double+CASE WHEN d{i}=label_supported THEN 0.0::double ELSE 1.0::double END,6) AS cost_to_go__{v}"
    for i, v in enumerate(POOL)) + """, CASE WHEN d0=label_supported THEN 'v_cheap' WHEN d1=label_supported THEN 'v_mid' WHEN d2=label_supported THEN 'v_high' ELSE 'ABSTAIN' END AS oracle_action,
 coalesce(d0=label_supported,false) OR coalesce(d1=label_supported,false) OR coalesce(d2=label_supported,false) AS oracle_available FROM stops""", *_SETUP, _STOP))
def selective_targets(spark, sf):
    t = R.selective_targets(sides(spark, sf), POOL, BANDS, PRICE, ["episode_key"])
    return t.select(*[rnd6(c, k) for c, k in t.dtypes])


def rnd6(c, kind):
    return F.round(c, 6).alias(c) if kind == "double" else F.col(c)


_POLM = """count(*) AS n_rows, count(DISTINCT content_doc_key) AS documents, count(dec) AS stops, count(*) FILTER (dec=label_supported) AS correct_stops, count(*) FILTER (dec<>label_supported) AS wrong_stops,
 count(*)-count(dec) AS abstains, round(count(dec)/count(*),6) AS coverage, round(count(*) FILTER (dec=label_supported)/count(*),6) AS correct_stop_rate, round(count(*) FILTER (dec<>label_supported)/count(*),6) AS wrong_stop_rate,
 round(count(*) FILTER (dec<>label_supported)/nullif(count(dec),0),6) AS conditional_error, round(avg(cost),6) AS mean_cost_ms, round(avg(calls),6) AS mean_calls"""
_ACT = f"act AS (SELECT *, {argmax(['h0', 'h1', 'h2'])} AS cand, {u_sql(chr(39) + 'conf' + chr(39), 'episode_key')} AS conf FROM stops)"
_DIRECT = f"dp AS (SELECT *, CASE WHEN conf>=0.1::double THEN {pick('d', 'cand')} END AS dec, 2.0::double+CASE WHEN conf>=0.1::double THEN [20.0::double,60.0::double,250.0::double][cand+1] ELSE 0 END AS cost, (conf>=0.1::double)::int AS calls FROM act)"


def _candidates(d):
    names = [F.lit(a) for a in POOL]
    return d.withColumn("cand", E.pick(names, E.first_argmax(R.cols("head", POOL)))).withColumn("conf", uniform("conf", F.col("episode_key")))


@query("direct_policy", "R18 M14", sql(f"SELECT dataset_key, {_POLM} FROM dp GROUP BY dataset_key", *_SETUP, _STOP, _ACT, _DIRECT))
def direct_policy(spark, sf):
    d = _candidates(setup(spark, sf)[0])
    act = F.when(F.col("conf") >= 0.1, F.col("cand")).otherwise(F.lit("ABSTAIN"))
    return rounded(R.policy_metrics(R.direct_policy(d, POOL, BANDS, PRICE, act, 2.0), ["dataset_key"]))


# sequential: candidate first, then v_cheap, v_mid, v_high, skipping the candidate
_SEQ = f"""sq0 AS (SELECT *, {pick('d', 'cand')} AS dc, [20.0::double,60.0::double,250.0::double][cand+1] AS pc FROM act),
sq AS (SELECT *, CASE WHEN conf>=0.1::double THEN coalesce(dc, CASE WHEN cand<>0 THEN d0 END, CASE WHEN cand<>1 THEN d1 END, CASE WHEN cand<>2 THEN d2 END) END AS dec,
 2.0::double+CASE WHEN conf>=0.1::double THEN pc+CASE WHEN dc IS NULL AND cand<>0 THEN 20 ELSE 0 END+CASE WHEN dc IS NULL AND (cand=0 OR d0 IS NULL) AND cand<>1 THEN 60 ELSE 0 END
  +CASE WHEN dc IS NULL AND (cand=0 OR d0 IS NULL) AND (cand=1 OR d1 IS NULL) AND cand<>2 THEN 250 ELSE 0 END ELSE 0 END AS cost,
 CASE WHEN conf>=0.1::double THEN 1+(dc IS NULL AND cand<>0)::int+(dc IS NULL AND (cand=0 OR d0 IS NULL) AND cand<>1)::int+(dc IS NULL AND (cand=0 OR d0 IS NULL) AND (cand=1 OR d1 IS NULL) AND cand<>2)::int ELSE 0 END AS calls FROM sq0)"""


@query("sequential_policy", "R19 M14", sql(f"SELECT dataset_key, {_POLM} FROM sq GROUP BY dataset_key", *_SETUP, _STOP, _ACT, _SEQ))
def sequential_policy(spark, sf):
    d = _candidates(setup(spark, sf)[0])
    s = R.sequential_policy(d, POOL, POOL, BANDS, PRICE, F.col("cand"), F.col("conf") >= 0.1, 2.0)
    return rounded(R.policy_metrics(s, ["dataset_key"]))


_OPS = """o AS (SELECT conf, coalesce(dd=label_supported,false)::int AS r, coalesce(dd<>label_supported,false)::int AS w, pc FROM (SELECT *, """ + pick("d", "cand") + """ AS dd, [20.0::double,60.0::double,250.0::double][cand+1] AS pc FROM act)),
pts AS (SELECT threshold, (SELECT count(*) FROM o) AS n, count(conf) AS act, coalesce(sum(r),0)::bigint AS cr, coalesce(sum(w),0)::bigint AS wr, coalesce(sum(pc),0) AS sp FROM (SELECT DISTINCT conf AS threshold FROM o UNION ALL SELECT max(conf)+1e-9::double FROM o) t LEFT JOIN o ON conf>=threshold GROUP BY threshold)"""
_OPCOLS = """round(threshold,9) AS threshold, n AS n_rows, round(act/n,6) AS active_rate, cr AS correct_stops, wr AS wrong_stops, round(cr/n,6) AS correct_stop_rate, round(wr/n,6) AS wrong_stop_rate, round(2.0::double+sp/n,6) AS mean_cost_ms, round(act/n,6) AS mean_calls"""


def _direct_points(spark, sf):
    d = _candidates(setup(spark, sf)[0])
    return R.operating_points(R.direct_policy(d, POOL, BANDS, PRICE, F.col("cand"), 2.0), "conf", 2.0)


def _points_rounded(df):
    return df.select(*[(F.round(c, 9 if c == "threshold" else 6).alias(c) if k == "double" else F.col(c)) for c, k in df.dtypes])


@query("operating_point_sweep", "R20", sql(f"SELECT {_OPCOLS} FROM pts", *_SETUP, _STOP, _ACT, _OPS))
def operating_point_sweep(spark, sf):
    return _points_rounded(_direct_points(spark, sf))


@query("operating_point_choice", "R20", sql(f"SELECT true AS feasible, {_OPCOLS} FROM pts WHERE round(wr/n,12)<=0.05::double ORDER BY round(cr/n,12) DESC, round(wr/n,12), round(2.0::double+sp/n,9), threshold DESC LIMIT 1", *_SETUP, _STOP, _ACT, _OPS))
def operating_point_choice(spark, sf):
    return _points_rounded(R.choose_operating_point(_direct_points(spark, sf), 0.05))


@query("sequential_operating_point", "R20", sql("""
SELECT feasible, round(threshold,9) AS threshold, n AS n_rows, round(act/n,6) AS active_rate, cr AS correct_stops, wr AS wrong_stops, round(cr/n,6) AS correct_stop_rate, round(wr/n,6) AS wrong_stop_rate, round(2.0::double+sp/n,6) AS mean_cost_ms, round(ca/n,6) AS mean_calls
FROM (SELECT *, (round(wr/n,12)<=0.1::double AND round(cr/n,12)>=round(0.5::double,12)) AS feasible FROM spts) WHERE feasible ORDER BY round(2.0::double+sp/n,9), round(cr/n,12) DESC, round(wr/n,12), threshold DESC LIMIT 1""", *_SETUP, _STOP, _ACT, _SEQ.replace("conf>=0.1::double", "true"),
    "tg AS (SELECT DISTINCT round(unnest(q),9) AS threshold FROM (SELECT quantile_cont(conf, [" + ",".join(f"{i / 40!r}::double" for i in range(41)) + "]) AS q FROM sq) UNION ALL SELECT max(conf)+1e-9::double FROM sq)",
    "spts AS (SELECT threshold, (SELECT count(*) FROM sq) AS n, count(conf) AS act, count(*) FILTER (dec=label_supported) AS cr, count(*) FILTER (dec<>label_supported) AS wr, coalesce(sum(cost-2.0::double),0) AS sp, coalesce(sum(calls),0)::bigint AS ca FROM tg LEFT JOIN sq ON conf>=threshold GROUP BY threshold)"))
def sequential_operating_point(spark, sf):
    d = _candidates(setup(spark, sf)[0])
    s = R.sequential_policy(d, POOL, POOL, BANDS, PRICE, F.col("cand"), F.lit(True), 2.0)
    q = quantile_points(s.withColumn("scope", F.lit("ALL")), ["scope"], "conf", [i / 40 for i in range(41)], F.col("conf"))
    pts = R.operating_points(s, "conf", 2.0, q.select(F.round("value", 9).alias("threshold")).distinct())
    return _points_rounded(R.choose_operating_point(pts, 0.1, F.lit(0.5)))


@query("live_substitution", "R23 V3", sql("""
SELECT count(*) AS calls, round(max(abs(p2-p)),6) AS max_abs_change, round(avg(p2-p),6) AS mean_change, round(avg((((p2>=0.5::double)=(p>=0.5::double)))::int),6) AS same_decision FROM (
 SELECT *, 1/(1+exp(-(z0+z1*ln(sc/(1-sc))))) AS p2 FROM (SELECT *, least(greatest(least(greatest(""" + pick("s", "sel") + """+0.02::double*(""" + u_sql("'live'", "episode_key") + """-0.5::double),0),1),1e-6::double),1-1e-6::double) AS sc,
  [0.05::double,0.0::double,-0.05::double][sel+1] AS z0, [0.6::double,0.8::double,1.1::double][sel+1] AS z1 FROM routed WHERE side='test'))""", *_ROUTED))
def live_substitution(spark, sf):
    from routelens.plans.views import VERIFIERS

    d, costs = setup(spark, sf)
    r = routed(d.filter("side = 'test'"), costs, F.lit(chosen_beta(d, costs)))
    plan = r.select("episode_key", "selected_action", E.pick(R.cols("score", POOL), F.col("sel")).alias("score"))
    rerun = plan.select("episode_key", "selected_action", F.least(F.greatest(F.col("score") + 0.02 * (uniform("live", F.col("episode_key")) - 0.5), F.lit(0.0)), F.lit(1.0)).alias("live"))
    j = r.join(rerun, ["episode_key", "selected_action"], "left")
    a0 = E.pick([F.lit(VERIFIERS[v][3]) for v in POOL], F.col("sel"))
    a1 = E.pick([F.lit(VERIFIERS[v][4]) for v in POOL], F.col("sel"))
    p2 = E.platt(F.coalesce("live", E.pick(R.cols("score", POOL), F.col("sel"))), a0, a1)
    d2 = p2 - F.col("p")
    return rounded(j.agg(F.count("*").alias("calls"), F.max(F.abs(d2)).alias("max_abs_change"), F.avg(d2).alias("mean_change"),
                         F.avg(((p2 >= 0.5) == (F.col("p") >= 0.5)).cast("double")).alias("same_decision")))
