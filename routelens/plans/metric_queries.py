"""Metrics, thresholds and ordered aggregates over the score table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routelens.functions.expr import quality_gain, rnd
from routelens.functions.hashing import uniform
from routelens.operators import metrics as M
from routelens.operators import ordered as O
from routelens.operators import thresholds as Q
from routelens.plans.registry import query
from routelens.plans.views import episodes, scores, u_sql, with_sql


def calls(spark, sf) -> DataFrame:
    """Available calls with the generic metric columns y, p, ms, d, ok."""
    s = scores(spark, sf).filter("available")
    return s.select(
        "*", F.col("label_supported").alias("y"), F.col("cal").alias("p"), F.col("latency_ms").alias("ms"),
        (F.col("cal") >= 0.5).cast("int").alias("d"),
    ).withColumn("ok", (F.col("d") == F.col("y")).cast("int"))


CALLS_SQL = """calls AS (SELECT *, label_supported AS y, cal AS p, latency_ms AS ms,
 CASE WHEN cal>=0.5::double THEN 1 ELSE 0 END AS d, CASE WHEN (cal>=0.5::double)=(label_supported=1) THEN 1 ELSE 0 END AS ok
 FROM scores WHERE available)"""


def calls_sql(body: str, *more: str) -> str:
    return with_sql(body, "scores", CALLS_SQL, *more)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Round every DOUBLE column to six digits; cast INT counts to BIGINT."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        out.append(rnd(c).alias(f.name) if kind == "double" else c.cast("bigint").alias(f.name) if kind == "int" else c)
    return df.select(*out)


AUROC_SQL = """SELECT {k}, round(sum(pos*(below+neg/2.0::double))/(any_value(npos)*any_value(nneg)),6) AS auroc FROM (
 SELECT *, coalesce(sum(neg) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::double AS below,
  sum(pos) OVER (PARTITION BY {k})::double AS npos, sum(neg) OVER (PARTITION BY {k})::double AS nneg
 FROM (SELECT {k}, p, sum(y)::double AS pos, sum(1-y)::double AS neg FROM calls GROUP BY ALL)) GROUP BY {k}"""


@query("auroc_by_verifier", "M1 W1", calls_sql(AUROC_SQL.format(k="verifier")))
def auroc_by_verifier(spark, sf):
    return rounded(M.auroc(calls(spark, sf), ["verifier"]))


@query("auroc_by_verifier_corpus", "M1 M8", calls_sql(AUROC_SQL.format(k="verifier, dataset_key")))
def auroc_by_verifier_corpus(spark, sf):
    return rounded(M.auroc(calls(spark, sf), ["verifier", "dataset_key"]))


@query("auprc_unsupported", "M2", calls_sql("""
SELECT verifier, round(sum(neg/tn*(cn/(cn+cp))),6) AS auprc_unsup FROM (
 SELECT *, sum(neg) OVER (PARTITION BY verifier ORDER BY p) AS cn, sum(pos) OVER (PARTITION BY verifier ORDER BY p) AS cp,
  sum(neg) OVER (PARTITION BY verifier) AS tn
 FROM (SELECT verifier, p, sum(y)::double AS pos, sum(1-y)::double AS neg FROM calls GROUP BY ALL)) GROUP BY verifier"""))
def auprc_unsupported(spark, sf):
    return rounded(M.average_precision_unsupported(calls(spark, sf), ["verifier"]))


_DECISION_SQL = """
SELECT verifier, tp, fp, tn, fn, round((tp+tn)/n,6) AS acc, round((tp/(tp+fn)+tn/(tn+fp))/2,6) AS bacc,
 round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)>0 THEN (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END,6) AS mcc,
 round((2*tp/(2*tp+fp+fn)+2*tn/(2*tn+fp+fn))/2,6) AS f1_macro, round(2*tn/(2*tn+fp+fn),6) AS f1_unsup,
 round(tn/(tn+fn),6) AS prec_unsup, round(tn/(tn+fp),6) AS rec_unsup FROM (
 SELECT verifier, count(*) FILTER (y=1 AND d=1)::double AS tp, count(*) FILTER (y=0 AND d=1)::double AS fp,
  count(*) FILTER (y=0 AND d=0)::double AS tn, count(*) FILTER (y=1 AND d=0)::double AS fn, count(*)::double AS n
 FROM calls GROUP BY verifier)"""


@query("decision_quality", "M3 P17 Q1", calls_sql(
    "SELECT * REPLACE (tp::bigint AS tp, fp::bigint AS fp, tn::bigint AS tn, fn::bigint AS fn) FROM (" + _DECISION_SQL + ")"))
def decision_quality(spark, sf):
    return rounded(M.decision_metrics(calls(spark, sf), ["verifier"]))


_ECE_SQL = """SELECT verifier, round(sum(n*abs(mp-my))/sum(n),6) AS ece, round(max(abs(mp-my)),6) AS mce FROM (
 SELECT verifier, least(greatest({bin},0),14) AS b, count(*) AS n, avg(p) AS mp, avg(y::double) AS my FROM calls GROUP BY ALL) GROUP BY verifier"""


@query("calibration_error_left", "M4", calls_sql(_ECE_SQL.format(bin="floor(p*15)")))
def calibration_error_left(spark, sf):
    return rounded(M.calibration_error(calls(spark, sf), ["verifier"]))


@query("calibration_error_right", "M4", calls_sql(_ECE_SQL.format(bin="ceil(p*15)-1")))
def calibration_error_right(spark, sf):
    return rounded(M.calibration_error(calls(spark, sf), ["verifier"], right=True))


@query("proper_scoring", "M5", calls_sql("""
SELECT verifier, round(avg((p-y)*(p-y)),6) AS brier,
 round(avg(-(y*ln(least(greatest(p,1e-7::double),1-1e-7::double))+(1-y)*ln(1-least(greatest(p,1e-7::double),1-1e-7::double)))),6) AS nll
FROM calls GROUP BY verifier"""))
def proper_scoring(spark, sf):
    return rounded(M.proper_scores(calls(spark, sf), ["verifier"]))


@query("latency_profile", "M6 S12", calls_sql("""
SELECT verifier, round(avg(ms),6) AS mean_ms, count(*) AS n, round(quantile_cont(ms,0.5),6) AS p50_ms,
 round(quantile_cont(ms,0.95),6) AS p95_ms, round(quantile_cont(ms,0.99),6) AS p99_ms, round(1000/avg(ms),6) AS qps
FROM calls GROUP BY verifier"""))
def latency_profile(spark, sf):
    return rounded(M.latency_summary(calls(spark, sf), ["verifier"]))


_SLOT_SQL = "('0x'||substr(sha256(episode_key),1,8))::bigint"
_RC_SQL = f"""rc AS (SELECT verifier, row_number() OVER w AS r, (sum(ok) OVER (w ROWS UNBOUNDED PRECEDING))::double AS c, count(*) OVER (PARTITION BY verifier) AS n
 FROM calls WINDOW w AS (PARTITION BY verifier ORDER BY abs(p-0.5::double) DESC, {_SLOT_SQL}, episode_key))"""


@query("risk_coverage_curve", "M7 W2", calls_sql("""
SELECT verifier, """ + ", ".join(
    f"round(max(1-c/r) FILTER (r=greatest(round_even({c}::double*n,0),1)),6) AS selerr_{int(c * 100)}" for c in (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
) + """, any_value(aurc) AS aurc FROM rc JOIN (
 SELECT verifier, round(avg(1-c/r),6) AS aurc FROM rc, range(1,51) t(i) WHERE r=greatest(round_even(i::double*n/50.0::double,0),1) GROUP BY verifier) a USING (verifier)
GROUP BY verifier""", _RC_SQL))
def risk_coverage_curve(spark, sf):
    return rounded(M.risk_coverage(calls(spark, sf), ["verifier"]))


@query("macro_auroc_by_verifier", "M8", calls_sql("""
SELECT verifier, round(avg(auroc),6) AS macro_auroc, round(sum(auroc*n)/sum(n),6) AS weighted_auroc, round(min(auroc),6) AS worst_auroc,
 arg_min(dataset_key, (auroc, dataset_key)) AS worst_corpus FROM (
SELECT verifier, dataset_key, sum(pos*(below+neg/2.0::double))/(any_value(npos)*any_value(nneg)) AS auroc, any_value(npos)+any_value(nneg) AS n FROM (
 SELECT *, coalesce(sum(neg) OVER (PARTITION BY verifier, dataset_key ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::double AS below,
  sum(pos) OVER (PARTITION BY verifier, dataset_key)::double AS npos, sum(neg) OVER (PARTITION BY verifier, dataset_key)::double AS nneg
 FROM (SELECT verifier, dataset_key, p, sum(y)::double AS pos, sum(1-y)::double AS neg FROM calls GROUP BY ALL)) GROUP BY ALL) GROUP BY verifier"""))
def macro_auroc_by_verifier(spark, sf):
    return rounded(M.macro_auroc(calls(spark, sf), ["verifier"]))


@query("rank_correlation", "M9 W1", calls_sql("""
SELECT verifier, round(corr(p,y),6) AS point_biserial, round(corr(rk,ry),6) AS spearman, round(any_value(s)/sqrt(any_value(px)::double*any_value(py)),6) AS kendall_tau_b
FROM r JOIN k USING (verifier) GROUP BY verifier""",
    """r AS (SELECT verifier, y, p, rank() OVER (PARTITION BY verifier ORDER BY p)+(count(*) OVER (PARTITION BY verifier, p)-1)/2.0::double AS rk,
  rank() OVER (PARTITION BY verifier ORDER BY y)+(count(*) OVER (PARTITION BY verifier, y)-1)/2.0::double AS ry FROM calls)""",
    """k AS (SELECT a.verifier, sum(sign(a.p-b.p)*sign(a.y-b.y))::double AS s, count(*) FILTER (a.p<>b.p) AS px, count(*) FILTER (a.y<>b.y) AS py
 FROM calls a JOIN calls b ON a.verifier=b.verifier AND a.episode_key<b.episode_key GROUP BY a.verifier)"""))
def rank_correlation(spark, sf):
    return rounded(M.rank_correlations(calls(spark, sf), ["verifier"]))


@query("average_rank_of_scores", "W1", calls_sql("""
SELECT verifier, round(sum(rk*n),6) AS rank_sum, round(sum(rk*rk*n),6) AS rank_sq_sum, count(*) AS distinct_values FROM (
 SELECT verifier, score, any_value(rk) AS rk, count(*) AS n FROM (
 SELECT verifier, score, rank() OVER (PARTITION BY verifier ORDER BY score)+(count(*) OVER (PARTITION BY verifier, score)-1)/2.0::double AS rk FROM calls)
 GROUP BY ALL) GROUP BY verifier"""))
def average_rank_of_scores(spark, sf):
    r = M.average_ranks(calls(spark, sf), ["verifier"], "score", F.col("score"))
    return rounded(r.groupBy("verifier").agg(
        F.sum(F.col("avg_rank") * F.col("n")).alias("rank_sum"),
        F.sum(F.col("avg_rank") * F.col("avg_rank") * F.col("n")).alias("rank_sq_sum"),
        F.count("*").alias("distinct_values")))


@query("seed_mean_and_spread", "M10", calls_sql("""
SELECT verifier, count(*) AS corpora, round(avg(m),6) AS mean_ms, round(stddev_pop(m),6) AS sd_pop, round(stddev_samp(m),6) AS sd_samp FROM (
 SELECT verifier, dataset_key, avg(ms) AS m FROM calls GROUP BY ALL) GROUP BY verifier"""))
def seed_mean_and_spread(spark, sf):
    g = calls(spark, sf).groupBy("verifier", "dataset_key").agg(F.avg("ms").alias("m"))
    return rounded(g.groupBy("verifier").agg(
        F.count("*").alias("corpora"), F.avg("m").alias("mean_ms"), F.stddev_pop("m").alias("sd_pop"),
        F.stddev_samp("m").alias("sd_samp")))


@query("balance_score", "M16", calls_sql("""
SELECT verifier, round(1-sqrt((1-(a-0.6876::double)/(0.7931::double-0.6876::double))**2+((ln(greatest(m,1e-6::double))-ln(42.6::double))/(ln(1170.2::double)-ln(42.6::double)))**2)/sqrt(2),6) AS balance
FROM (SELECT verifier, avg(ok::double) AS a, avg(ms) AS m FROM calls GROUP BY verifier)"""))
def balance_score(spark, sf):
    g = calls(spark, sf).groupBy("verifier").agg(F.avg(F.col("ok").cast("double")).alias("a"), F.avg("ms").alias("m"))
    return rounded(g.select("verifier", quality_gain(F.col("a"), F.col("m"), 0.6876, 0.7931, 42.6, 1170.2).alias("balance")))


@query("prior_shift", "M17", with_sql("""
SELECT dataset_key, coalesce(max(n) FILTER (role='train'),0) AS train_rows, coalesce(max(n) FILTER (role='test'),0) AS test_rows,
 coalesce(max(g) FILTER (role='train'),0) AS train_groups, coalesce(max(g) FILTER (role='test'),0) AS test_groups,
 round(max(r) FILTER (role='train'),6) AS train_rate, round(max(r) FILTER (role='test'),6) AS test_rate,
 coalesce(max(mi) FILTER (role='test'),0) AS test_minority,
 round(100*(max(r) FILTER (role='test')-max(r) FILTER (role='train')),6) AS shift_points
FROM (SELECT dataset_key, role, count(*) AS n, count(DISTINCT content_doc_key) AS g, avg(label_supported::double) AS r,
  least(count(*) FILTER (label_supported=1), count(*) FILTER (label_supported=0)) AS mi FROM episodes GROUP BY ALL) GROUP BY dataset_key""", "episodes"))
def prior_shift(spark, sf):
    e = episodes(spark, sf)
    y = F.col("label_supported")
    g = e.groupBy("dataset_key", "role").agg(
        F.count("*").alias("n"), F.countDistinct("content_doc_key").alias("g"), F.avg(y.cast("double")).alias("r"),
        F.least(F.count_if(y == 1), F.count_if(y == 0)).alias("mi"))
    at = lambda c, role: F.max(F.when(F.col("role") == role, F.col(c)))
    zero = F.lit(0).cast("bigint")
    return rounded(g.groupBy("dataset_key").agg(
        F.coalesce(at("n", "train"), zero).alias("train_rows"), F.coalesce(at("n", "test"), zero).alias("test_rows"),
        F.coalesce(at("g", "train"), zero).alias("train_groups"), F.coalesce(at("g", "test"), zero).alias("test_groups"),
        at("r", "train").alias("train_rate"), at("r", "test").alias("test_rate"),
        F.coalesce(at("mi", "test"), zero).alias("test_minority"),
        (100 * (at("r", "test") - at("r", "train"))).alias("shift_points")))


@query("dataset_inventory", "M18 P19", with_sql("""
SELECT dataset_key, role, count(*) AS n_rows, count(DISTINCT content_doc_key) AS groups, count(DISTINCT generator_id) AS generators,
 sum(label_supported)::bigint AS positives FROM episodes GROUP BY ALL""", "episodes"))
def dataset_inventory(spark, sf):
    return episodes(spark, sf).groupBy("dataset_key", "role").agg(
        F.count("*").alias("n_rows"), F.countDistinct("content_doc_key").alias("groups"),
        F.countDistinct("generator_id").alias("generators"), F.sum("label_supported").alias("positives"))


@query("verifier_scorecard", "M15", calls_sql("""
SELECT s.verifier, count(*) AS n_rows, round(avg(s.available::int),6) AS availability,
 round(avg(c.ok::double),6) AS acc, round(avg((c.p-c.y)*(c.p-c.y)),6) AS brier, round(avg(c.ms),6) AS mean_ms,
 round(quantile_cont(c.ms,0.5),6) AS p50_ms, round(quantile_cont(c.ms,0.95),6) AS p95_ms, any_value(auroc) AS auroc,
 round(1000*count(c.ms)/sum(c.ms),6) AS calls_per_sec
FROM scores s LEFT JOIN calls c USING (episode_key, verifier) JOIN a ON a.verifier=s.verifier GROUP BY s.verifier""",
    "a AS (" + AUROC_SQL.format(k="verifier") + ")"))
def verifier_scorecard(spark, sf):
    s = scores(spark, sf)
    c = calls(spark, sf)
    av = F.col("available")
    ok = ((F.col("cal") >= 0.5).cast("int") == F.col("label_supported")).cast("double")
    gap = F.col("cal") - F.col("label_supported")
    base = s.groupBy("verifier").agg(
        F.count("*").alias("n_rows"), F.avg(av.cast("double")).alias("availability"),
        F.avg(F.when(av, ok)).alias("acc"), F.avg(F.when(av, gap * gap)).alias("brier"),
        F.avg(F.when(av, F.col("latency_ms"))).alias("mean_ms"),
        (1000.0 * F.count_if(av) / F.sum(F.when(av, F.col("latency_ms")))).alias("calls_per_sec"))
    tail = O.quantiles(c, ["verifier"], "ms", (0.5, 0.95), names=("p50_ms", "p95_ms"))
    return rounded(base.join(tail, "verifier").join(M.auroc(c, ["verifier"]), "verifier"))


# ------------------------------------------------------------------------------ thresholds

@query("threshold_mcc", "Q2", calls_sql("""
SELECT verifier, round(arg_max(t, (m, -t)),6) AS threshold, round(max(m),6) AS mcc FROM (
 SELECT verifier, t, round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)>0 THEN (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END,12) AS m FROM (
  SELECT g.verifier, t, count(*) FILTER (y=1 AND p>=t)::double AS tp, count(*) FILTER (y=0 AND p>=t)::double AS fp,
   count(*) FILTER (y=0 AND p<t)::double AS tn, count(*) FILTER (y=1 AND p<t)::double AS fn
  FROM grid g JOIN calls c ON c.verifier=g.verifier GROUP BY g.verifier, t)) GROUP BY verifier""",
    "grid AS (SELECT DISTINCT verifier, unnest(q) AS t FROM (SELECT verifier, quantile_cont(p, [" +
    ",".join(repr(0.02 + 0.96 / 96 * i) + "::double" for i in range(97)) + "]) AS q FROM calls GROUP BY verifier))"))
def threshold_mcc(spark, sf):
    return rounded(Q.mcc_threshold(calls(spark, sf), ["verifier"]))


_CUTS = """cuts AS (SELECT verifier, p AS t, npos, nneg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
 SELECT *, sum(pos) OVER (PARTITION BY verifier) AS npos, sum(neg) OVER (PARTITION BY verifier) AS nneg FROM (
  SELECT verifier, p, sum(y)::double AS pos, sum(1-y)::double AS neg FROM calls GROUP BY ALL)) WINDOW w AS (PARTITION BY verifier ORDER BY p DESC))"""


@query("threshold_youden", "Q3", calls_sql(
    "SELECT verifier, CASE WHEN max(round(tp/npos-fp/nneg,12))<=0 THEN 1.0 ELSE round(arg_max(t, (round(tp/npos-fp/nneg,12), t)),6) END AS threshold FROM cuts GROUP BY verifier", _CUTS))
def threshold_youden(spark, sf):
    return rounded(Q.youden_threshold(calls(spark, sf), ["verifier"]))


@query("threshold_bacc", "Q6", calls_sql(
    "SELECT verifier, round(arg_max(t, (round((tp/npos+(nneg-fp)/nneg)/2,9), round((nneg-fp)/nneg,9), t)),6) AS threshold FROM cuts GROUP BY verifier", _CUTS))
def threshold_bacc(spark, sf):
    return rounded(Q.bacc_threshold(calls(spark, sf), ["verifier"]))


@query("threshold_conformal", "Q4", calls_sql("""
SELECT verifier, any_value(n) AS n_units, round(max(p) FILTER (r=ceil((n+1)*0.9::double)),6) AS tau FROM (
 SELECT verifier, p, row_number() OVER (PARTITION BY verifier ORDER BY p) AS r, count(*) OVER (PARTITION BY verifier) AS n FROM calls WHERE y=0)
GROUP BY verifier"""))
def threshold_conformal(spark, sf):
    return rounded(Q.conformal_threshold(calls(spark, sf), ["verifier"], delta=0.1))


@query("threshold_conformal_group", "Q5", calls_sql("""
SELECT verifier, any_value(n) AS n_units, round(max(p) FILTER (r=ceil((n+1)*0.9::double)),6) AS tau FROM (
 SELECT verifier, p, row_number() OVER (PARTITION BY verifier ORDER BY p) AS r, count(*) OVER (PARTITION BY verifier) AS n FROM (
  SELECT verifier, content_doc_key, max(p) AS p FROM calls WHERE y=0 GROUP BY ALL)) GROUP BY verifier"""))
def threshold_conformal_group(spark, sf):
    return rounded(Q.conformal_threshold(calls(spark, sf), ["verifier"], delta=0.1, group="content_doc_key"))


@query("threshold_sensitivity", "Q8 Q1", calls_sql("""
SELECT verifier, rule, round(any_value(t),6) AS threshold, round(avg(CASE WHEN (p>=t)=(y=1) THEN 1.0::double ELSE 0 END),6) AS acc,
 round((count(*) FILTER (y=1 AND p>=t)/count(*) FILTER (y=1)::double + count(*) FILTER (y=0 AND p<t)/count(*) FILTER (y=0)::double)/2,6) AS bacc
FROM calls JOIN rules USING (verifier) GROUP BY ALL""", _CUTS, """rules AS (
 SELECT DISTINCT verifier, 'fixed05' AS rule, 0.5::double AS t FROM calls UNION ALL
 SELECT verifier, 'youden', arg_max(t, (round(tp/npos-fp/nneg,12), t)) FROM cuts GROUP BY verifier UNION ALL
 SELECT verifier, 'bacc', arg_max(t, (round((tp/npos+(nneg-fp)/nneg)/2,9), round((nneg-fp)/nneg,9), t)) FROM cuts GROUP BY verifier)"""))
def threshold_sensitivity(spark, sf):
    c = calls(spark, sf)
    rules = (
        Q.youden_threshold(c, ["verifier"]).withColumn("rule", F.lit("youden"))
        .unionByName(Q.bacc_threshold(c, ["verifier"]).withColumn("rule", F.lit("bacc")))
        .unionByName(c.select("verifier").distinct().select("verifier", F.lit(0.5).alias("threshold"), F.lit("fixed05").alias("rule")))
    )
    j = c.join(rules, "verifier").withColumn("d2", (F.col("p") >= F.col("threshold")).cast("int"))
    m = M.decision_metrics(j, ["verifier", "rule", "threshold"], "y", "d2")
    return rounded(m.select("verifier", "rule", "threshold", "acc", "bacc"))


@query("oof_thresholds", "Q7 F3", calls_sql("""
SELECT verifier, fold AS held_fold, round(any_value(t),6) AS threshold, count(*) AS evaluation_rows, count(DISTINCT content_doc_key) AS evaluation_groups,
 round(avg(CASE WHEN (p>=t)=(y=1) THEN 1.0::double ELSE 0 END),6) AS acc
FROM f JOIN chosen USING (verifier, fold) GROUP BY ALL""",
    f"f AS (SELECT *, floor({u_sql(chr(39) + 'oof' + chr(39), 'content_doc_key')}*5)::bigint AS fold FROM calls)",
    """oc AS (SELECT verifier, h, p AS t, npos, nneg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
  SELECT *, sum(pos) OVER (PARTITION BY verifier, h) AS npos, sum(neg) OVER (PARTITION BY verifier, h) AS nneg FROM (
   SELECT verifier, h, p, sum(y)::double AS pos, sum(1-y)::double AS neg FROM f, range(5) r(h) WHERE fold<>h GROUP BY ALL))
  WINDOW w AS (PARTITION BY verifier, h ORDER BY p DESC))""",
    "chosen AS (SELECT verifier, h AS fold, arg_max(t, (round((tp/npos+(nneg-fp)/nneg)/2,9), round((nneg-fp)/nneg,9), t)) AS t FROM oc GROUP BY ALL)"))
def oof_thresholds(spark, sf):
    c = calls(spark, sf).withColumn("fold", F.floor(uniform("oof", F.col("content_doc_key")) * 5))
    others = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda h: h != F.col("fold"))
    train = c.withColumn("held_fold", F.explode(others)).withColumn("held_fold", F.col("held_fold").cast("bigint"))
    t = Q.bacc_threshold(train, ["verifier", "held_fold"])
    held = c.withColumnRenamed("fold", "held_fold").join(t, ["verifier", "held_fold"])
    hit = ((F.col("p") >= F.col("threshold")).cast("int") == F.col("y")).cast("double")
    return rounded(held.groupBy("verifier", "held_fold").agg(
        F.max("threshold").alias("threshold"), F.count("*").alias("evaluation_rows"),
        F.countDistinct("content_doc_key").alias("evaluation_groups"), F.avg(hit).alias("acc")))


def gamma_rows(spark, sf) -> DataFrame:
    """Every verifier call as one sentence of its episode's summary."""
    s = scores(spark, sf)
    return s.select(
        F.col("content_doc_key").alias("doc_group_key"), F.col("episode_key").alias("summary_id"), "generator_id",
        F.concat_ws(":", "episode_key", "verifier").alias("sentence_id"), "label_supported",
        F.col("score").alias("confidence"), F.col("available").alias("base_accept"))


_GAMMA = """g AS (SELECT content_doc_key AS doc, episode_key AS summ, generator_id AS gen, label_supported AS y, score AS conf, available AS acc FROM scores)"""
_GCURVE = """cand AS (SELECT DISTINCT conf AS gamma FROM g UNION SELECT 0.0::double UNION SELECT 1.0::double),
summ AS (SELECT doc, summ, gen, max(conf) FILTER (acc) AS ta, max(conf) FILTER (acc AND y=0) AS tw FROM g GROUP BY ALL),
curve AS (SELECT gamma,
 (SELECT count(*) FILTER (conf>gamma) FROM g) AS sentence_activate_n, (SELECT count(*) FILTER (acc AND conf>gamma) FROM g) AS sentence_accept_n,
 (SELECT count(*) FILTER (acc AND y=0 AND conf>gamma) FROM g) AS sentence_wrong_n,
 (SELECT count(*) FILTER (acc AND conf>gamma)/count(*)::double FROM g) AS sentence_coverage,
 (SELECT count(*) FILTER (ta>gamma)/count(*)::double FROM summ) AS summary_coverage,
 (SELECT count(*) FILTER (tw>gamma)/count(*)::double FROM summ) AS summary_risk,
 (SELECT avg(m) FROM (SELECT doc, avg(CASE WHEN tw>gamma THEN 1.0::double ELSE 0 END) AS m FROM summ GROUP BY doc)) AS document_risk,
 (SELECT avg(m) FROM (SELECT doc, max(CASE WHEN tw>gamma THEN 1.0::double ELSE 0 END) AS m FROM summ GROUP BY doc)) AS document_max_rate,
 (SELECT count(DISTINCT doc) FROM g) AS D FROM cand)"""


@query("gamma_risk_curve", "M19 Q9", with_sql("""
SELECT round(gamma,6) AS gamma, sentence_activate_n, sentence_accept_n, sentence_wrong_n, round(sentence_coverage,6) AS sentence_coverage,
 round(summary_coverage,6) AS summary_coverage, round(summary_risk,6) AS summary_risk, round(document_risk,6) AS document_risk,
 round(document_max_rate,6) AS document_max_rate, round((D*document_risk+1)/(D+1),6) AS crc_bound FROM curve""", "scores", _GAMMA, _GCURVE))
def gamma_risk_curve(spark, sf):
    return rounded(Q.gamma_curve(gamma_rows(spark, sf)))


@query("gamma_risk_control", "Q9", with_sql("""
SELECT CASE WHEN coalesce(s.a,0)>0 THEN round(s.gamma,6) ELSE 1.0::double END AS gamma, CASE WHEN coalesce(s.a,0)>0 THEN round(s.b,6) ELSE 0.0::double END AS bound,
 CASE WHEN coalesce(s.a,0)>0 THEN round(s.r,6) ELSE 0.0::double END AS document_risk, CASE WHEN coalesce(s.a,0)>0 THEN 'CALIBRATED' ELSE 'FALLBACK_NO_ACCEPT' END AS status
FROM (SELECT arg_min({'gamma':gamma,'a':sentence_accept_n,'b':(D*document_risk+1)/(D+1),'r':document_risk}, gamma) AS s FROM curve
 WHERE round((D*document_risk+1)/(D+1),12)<=0.2::double)""", "scores", _GAMMA, _GCURVE))
def gamma_risk_control(spark, sf):
    return rounded(Q.gamma_choice(Q.gamma_curve(gamma_rows(spark, sf)), 0.2))


@query("gamma_generator_risk", "M19", with_sql("""
SELECT gen AS generator_id, count(*) AS summaries, round(avg(CASE WHEN ta>0.6::double THEN 1.0::double ELSE 0 END),6) AS coverage,
 round(avg(CASE WHEN tw>0.6::double THEN 1.0::double ELSE 0 END),6) AS risk FROM summ GROUP BY gen""", "scores", _GAMMA,
    "summ AS (SELECT doc, summ, gen, max(conf) FILTER (acc) AS ta, max(conf) FILTER (acc AND y=0) AS tw FROM g GROUP BY ALL)"))
def gamma_generator_risk(spark, sf):
    return rounded(Q.gamma_by_generator(gamma_rows(spark, sf), 0.6))
