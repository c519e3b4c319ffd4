"""Competing call policies in one table, each recalibrated and re-thresholded after its second call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from routelens.operators import metrics as M
from routelens.operators import routing as R
from routelens.operators.isotonic import apply_isotonic, fit_isotonic, stage_two
from routelens.plans.metric_queries import rounded
from routelens.plans.policy_queries import _AUC, _ROUTED, _SIDES, AV, I, UTIL, argmax, chosen_beta, pick, routed, setup, sides, sql
from routelens.plans.registry import query
from routelens.plans.views import POOL
from routelens.sources.files import settled

KINDS = ("cascade", "second_verifier_confidence", "second_raw_margin", "second_discounted_margin")
TAU_PROBS = [0.6 * i / 24 for i in range(25)]
MCC_PROBS = [0.02 + 0.96 / 96 * i for i in range(97)]


def policies(spark, sf):
    """(policy, side, y, p, ms, calls) of validation and test rows: the router, its cascades and second calls, and the disagreement rule."""
    d, costs = setup(spark, sf)
    beta = F.lit(chosen_beta(d, costs))
    r = settled(routed(d.filter("side <> 'fit'"), costs, beta), "routed")
    ceiling = r.filter("side = 'val'").agg(F.avg(R.latency_ceiling(F.col("verifier_ms"), F.col("feature_latency_ms")))).first()[0]

    def named(x, name, calls):
        return x.select(F.lit(name).alias("policy"), "side", F.col("label_supported").alias("y"), "p", (F.col("verifier_ms") + F.col("feature_latency_ms")).alias("ms"), calls.cast("bigint").alias("calls"))

    out = [named(r, "reference", F.lit(1)), named(R.disagreement(d.filter("side <> 'fit'"), POOL, costs), "disagreement", F.col("calls"))]
    for kind in KINDS:
        x = R.escalation(r, POOL, costs, kind, beta)
        tau = R.choose_tau(x.filter("side = 'val'"), ceiling).first()[0]
        out.append(named(R.escalate(x, F.lit(tau)), kind, F.col("calls")))
    return settled(reduce(lambda a, b: a.unionByName(b), out), "policies")


def _escalation_sql(n: int, kind: str) -> list[str]:
    """Views of one escalating policy, told apart by its number."""
    first = "0" if kind == "cascade" else "sel"
    nxt = argmax([f"CASE WHEN {first}<>{i} THEN h{i} END" for i in I], AV)
    margin = lambda xs: f"list_sort([{','.join(xs)}],'DESC')[1]-list_sort([{','.join(xs)}],'DESC')[2]"
    conf = {"cascade": "abs(c0-0.5::double)", "second_verifier_confidence": "abs(p-0.5::double)", "second_raw_margin": margin(["h0", "h1", "h2"]), "second_discounted_margin": margin(UTIL)}[kind]
    p1, ms1 = ("c0", "l0") if kind == "cascade" else ("p", "vms")
    pn = pick("c", "nx")
    p2 = pn if kind == "cascade" else f"(p+{pn})*0.5::double"
    moved = "CASE WHEN conf<tau THEN p2 ELSE p1 END AS p, ms1+CASE WHEN conf<tau THEN ms2 ELSE 0 END AS ms"
    return [
        f"esc{n} AS (SELECT side, label_supported AS y, feature_latency_ms AS f, vms, {p1} AS p1, {p2} AS p2, {ms1} AS ms1, {pick('l', 'nx')} AS ms2, {conf} AS conf FROM (SELECT *, coalesce({nxt},{first}) AS nx FROM routed WHERE side<>'fit'))",
        f"taus{n} AS (SELECT DISTINCT round(unnest(q),9) AS tau FROM (SELECT quantile_cont(conf, [" + ",".join(f"{x!r}::double" for x in TAU_PROBS) + f"]) AS q FROM esc{n} WHERE side='val'))",
        f"tried{n} AS (SELECT tau, y, {moved} FROM esc{n}, taus{n} WHERE side='val')",
        f"tau{n} AS (SELECT coalesce(arg_max(tau, (round(auroc,12), -tau)),0) AS tau FROM (" + _AUC.format(k="tau", t=f"tried{n}", y="y") + f") JOIN (SELECT tau, avg(ms) AS m FROM tried{n} GROUP BY 1) USING (tau) WHERE m<=(SELECT avg(1.5::double*(vms+f)-f) FROM esc{n} WHERE side='val'))",
        f"pol{n} AS (SELECT '{kind}' AS policy, side, y, p, ms+f AS ms, calls FROM (SELECT *, {moved}, 1+(conf<tau)::int AS calls FROM esc{n}, tau{n}))",
    ]


_POLICIES = [
    *_ROUTED, *[v for n, k in enumerate(KINDS) for v in _escalation_sql(n, k)],
    """policies AS (SELECT 'reference' AS policy, side, label_supported AS y, p, vms+feature_latency_ms AS ms, 1 AS calls FROM routed WHERE side<>'fit' UNION ALL
 SELECT 'disagreement', side, label_supported, CASE WHEN df THEN c2 ELSE (c0+c1)*0.5::double END, l0+l1+CASE WHEN df THEN l2 ELSE 0 END+feature_latency_ms, 2+df::int FROM (SELECT *, (c0>=0.5::double)<>(c1>=0.5::double) AS df FROM base WHERE side<>'fit')"""
    + "".join(f" UNION ALL SELECT * FROM pol{n}" for n in range(len(KINDS))) + ")",
]


def iso_sql(t: str, key: str) -> list[str]:
    """Isotonic values as the largest of the smallest block means, and rows of ``t`` (``key``, side, y, p) recalibrated as ``q``."""
    return [
        f"iso_points AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY x) AS i FROM (SELECT {key}, p AS x, count(*) AS w, sum(y) AS s FROM {t} WHERE side='val' AND p IS NOT NULL GROUP BY ALL))",
        f"iso_sums AS (SELECT *, sum(w) OVER o AS cw, sum(s) OVER o AS cs FROM iso_points WINDOW o AS (PARTITION BY {key} ORDER BY i))",
        f"iso AS (SELECT {key}, any_value(x) AS x, i, max(least_mean) AS v FROM (SELECT m.{key}, m.i, m.x, min((b.cs-a.cs+a.s)/(b.cw-a.cw+a.w)::double) AS least_mean FROM iso_sums m JOIN iso_sums a ON a.{key}=m.{key} AND a.i<=m.i JOIN iso_sums b ON b.{key}=m.{key} AND b.i>=m.i GROUP BY m.{key}, m.i, m.x, a.i) GROUP BY {key}, i)",
        f"iso_near AS (SELECT t.{key}, t.p, arg_max(v, x) FILTER (x<=t.p) AS va, max(x) FILTER (x<=t.p) AS xa, arg_min(v, x) FILTER (x>=t.p) AS vb, min(x) FILTER (x>=t.p) AS xb FROM (SELECT DISTINCT {key}, p FROM {t}) t JOIN iso USING ({key}) GROUP BY t.{key}, t.p)",
        f"staged AS (SELECT t.*, least(greatest(CASE WHEN xa IS NULL THEN vb WHEN xb IS NULL OR xa=xb THEN va ELSE va+(vb-va)*((t.p-xa)/(xb-xa)) END,1e-6::double),1-1e-6::double) AS q FROM {t} t JOIN iso_near n ON n.{key}=t.{key} AND n.p=t.p)",
    ]


_STAGE_TWO = [
    *iso_sql("policies", "policy"),
    "mcc_grid AS (SELECT DISTINCT policy, unnest(g) AS t FROM (SELECT policy, quantile_cont(q, [" + ",".join(f"{x!r}::double" for x in MCC_PROBS) + "]) AS g FROM staged WHERE side='val' GROUP BY policy))",
    """cut AS (SELECT policy, arg_max(t, (m, -t)) AS threshold FROM (SELECT policy, t, round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)>0 THEN (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END,12) AS m FROM (
 SELECT g.policy, t, count(*) FILTER (y=1 AND q>=t)::double AS tp, count(*) FILTER (y=0 AND q>=t)::double AS fp, count(*) FILTER (y=0 AND q<t)::double AS tn, count(*) FILTER (y=1 AND q<t)::double AS fn
 FROM mcc_grid g JOIN staged s ON s.policy=g.policy AND side='val' GROUP BY g.policy, t)) GROUP BY policy)""",
    "done AS (SELECT policy, y, q AS p, p AS raw, ms, calls, threshold, (q>=threshold)::int AS d FROM staged JOIN cut USING (policy) WHERE side='test')",
    """table1 AS (SELECT policy, any_value(threshold) AS threshold, count(*) AS n_rows, avg(ms) AS mean_ms, avg(calls) AS mean_calls, avg((d=y)::int) AS acc,
 (count(*) FILTER (d=1 AND y=1)/count(*) FILTER (y=1)::double+count(*) FILTER (d=0 AND y=0)/count(*) FILTER (y=0)::double)/2 AS bacc,
 count(*) FILTER (d=1 AND y=1)::double AS tp, count(*) FILTER (d=1 AND y=0)::double AS fp, count(*) FILTER (d=0 AND y=0)::double AS tn, count(*) FILTER (d=0 AND y=1)::double AS fn FROM done GROUP BY policy)""",
]


@query("competitor_policies", "X11 K2 R12 R13 R15 Q2", sql("""
SELECT t.policy, round(threshold,6) AS threshold, n_rows, round(auroc,6) AS auroc, round(acc,6) AS acc, round(bacc,6) AS bacc,
 round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)>0 THEN (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END,6) AS mcc, round(mean_ms,6) AS mean_ms, round(mean_calls,6) AS mean_calls,
 round(auroc-(SELECT auroc FROM au WHERE policy='reference'),6) AS delta_auroc, round(mean_ms-(SELECT mean_ms FROM table1 WHERE policy='reference'),6) AS delta_ms
FROM table1 t JOIN au USING (policy)""", *_POLICIES, *_STAGE_TWO, "au AS (" + _AUC.format(k="policy", t="done", y="y") + ")"))
def competitor_policies(spark, sf):
    """Every policy after stage two (isotonic on validation, MCC threshold), against the reference router."""
    k = ["policy"]
    t = settled(stage_two(policies(spark, sf), k, settle=settled).filter("side = 'test'"), "staged")
    g = t.groupBy(*k).agg(F.max("threshold").alias("threshold"), F.count(F.lit(1)).alias("n_rows"), F.avg("ms").alias("mean_ms"), F.avg("calls").alias("mean_calls"))
    g = g.join(M.auroc(t, k, "q"), k).join(M.decision_metrics(t, k).select(*k, "acc", "bacc", "mcc"), k)
    g = settled(g, "policy-table")
    ref = g.filter("policy = 'reference'").select(F.col("auroc").alias("ra"), F.col("mean_ms").alias("rm")).first()
    return rounded(g.withColumn("delta_auroc", F.col("auroc") - F.lit(ref.ra)).withColumn("delta_ms", F.col("mean_ms") - F.lit(ref.rm)))


_ONE = "one AS (SELECT 'v' AS k, side, label_supported AS y, c1 AS p FROM sides WHERE side<>'fit')"
_STAGES = "stages AS (SELECT 'stage1' AS stage, y, p FROM staged WHERE side='test' UNION ALL SELECT 'stage2', y, q FROM staged WHERE side='test')"


@query("isotonic_recalibration", "K2 K4", sql("""
SELECT stage, round(auroc,6) AS auroc, round(ece,6) AS ece, round(mce,6) AS mce, round(brier,6) AS brier, round(nll,6) AS nll FROM (""" + _AUC.format(k="stage", t="stages", y="y") + """) JOIN (
 SELECT stage, sum(n*abs(mp-my))/sum(n) AS ece, max(abs(mp-my)) AS mce FROM (SELECT stage, least(greatest(floor(p*15),0),14) AS b, count(*) AS n, avg(p) AS mp, avg(y::double) AS my FROM stages GROUP BY ALL) GROUP BY stage) USING (stage) JOIN (
 SELECT stage, avg((p-y)*(p-y)) AS brier, avg(-(y*ln(least(greatest(p,1e-7::double),1-1e-7::double))+(1-y)*ln(1-least(greatest(p,1e-7::double),1-1e-7::double)))) AS nll FROM stages GROUP BY stage) USING (stage)""",
    *_SIDES, _ONE, *iso_sql("one", "k"), _STAGES))
def isotonic_recalibration(spark, sf):
    """Stage-1 against stage-2 quality: AUROC, ECE and Brier before and after."""
    d = sides(spark, sf).filter("side <> 'fit'").select(F.lit("v").alias("k"), "side", F.col("cal__v_mid").alias("p"), F.col("label_supported").alias("y"))
    d = settled(d, "stage-rows")
    t = apply_isotonic(d.filter("side = 'test'"), fit_isotonic(d.filter("side = 'val'"), ["k"]), ["k"])
    x = t.select("y", F.explode(F.array(F.struct(F.lit("stage1").alias("stage"), F.col("p").alias("p")), F.struct(F.lit("stage2").alias("stage"), F.col("q").alias("p")))).alias("s")).select("y", "s.*")
    x = settled(x, "stages")
    return rounded(M.auroc(x, ["stage"]).join(M.calibration_error(x, ["stage"]), "stage").join(M.proper_scores(x, ["stage"]), "stage"))


@query("stage_deltas", "K4", sql("""
SELECT policy, round(a2-a1,6) AS auroc_delta, round(e2-e1,6) AS ece_delta, round(b2-b1,6) AS brier_delta FROM (
 SELECT policy, max(auroc) FILTER (stage=1) AS a1, max(auroc) FILTER (stage=2) AS a2 FROM (""" + _AUC.format(k="policy, stage", t="both_stages", y="y") + """) GROUP BY policy) JOIN (
 SELECT policy, max(ece) FILTER (stage=1) AS e1, max(ece) FILTER (stage=2) AS e2 FROM (SELECT policy, stage, sum(n*abs(mp-my))/sum(n) AS ece FROM (SELECT policy, stage, least(greatest(floor(p*15),0),14) AS b, count(*) AS n, avg(p) AS mp, avg(y::double) AS my FROM both_stages GROUP BY ALL) GROUP BY policy, stage) GROUP BY policy) USING (policy) JOIN (
 SELECT policy, avg((p-y)*(p-y)) FILTER (stage=1) AS b1, avg((p-y)*(p-y)) FILTER (stage=2) AS b2 FROM both_stages GROUP BY policy) USING (policy)""",
    *_POLICIES, *_STAGE_TWO, "both_stages AS (SELECT policy, 1 AS stage, y, raw AS p FROM done UNION ALL SELECT policy, 2, y, p FROM done)"))
def stage_deltas(spark, sf):
    """What stage two changes for each policy on the test rows."""
    k = ["policy"]
    t = settled(stage_two(policies(spark, sf), k, settle=settled).filter("side = 'test'"), "staged")
    at = lambda p, n: M.auroc(t, k, p, name=f"a{n}").join(M.calibration_error(t, k, p).select(*k, F.col("ece").alias(f"e{n}")), k).join(M.proper_scores(t, k, p).select(*k, F.col("brier").alias(f"b{n}")), k)
    j = at("p", 1).join(at("q", 2), k)
    return rounded(j.select("policy", *[(F.col(f"{x}2") - F.col(f"{x}1")).alias(f"{n}_delta") for x, n in (("a", "auroc"), ("e", "ece"), ("b", "brier"))]))
