"""Bootstrap intervals and paired comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.functions.hashing import hash32, uniform
from routelens.operators import resampling as B
from routelens.plans.metric_queries import rounded
from routelens.plans.registry import query
from routelens.plans.views import scores, u_sql, with_sql

DRAWS = 2000


def systems(spark, sf):
    """Every verifier as a system over the same rows."""
    return scores(spark, sf).select(F.col("verifier").alias("system"), "episode_key", "content_doc_key", "dataset_key", F.col("label_supported").alias("y"), F.col("cal").alias("p"), F.col("latency_ms").alias("ms"))


SYS = "sy AS (SELECT verifier AS system, episode_key, content_doc_key, dataset_key, label_supported AS y, cal AS p, latency_ms AS ms FROM scores)"


def draws_sql(group: str, seed: int, stratum: str = "'ALL'", tag: str = "boot") -> str:
    t, s = f"'{tag}'", f"'{seed}'"
    return f"""pos AS (SELECT st, g, row_number() OVER (PARTITION BY st ORDER BY {u_sql(t, s, 'g')}, g)-1 AS idx, count(*) OVER (PARTITION BY st) AS n FROM (SELECT DISTINCT {stratum} AS st, {group} AS g FROM sy)),
dr AS (SELECT draw, pos.g, m FROM (SELECT st, draw, floor({u_sql(t, s, 'draw', 'st', 'idx')}*n)::bigint AS pick, count(*) AS m FROM pos, range({DRAWS}) r(draw) GROUP BY ALL) x JOIN pos ON pos.st=x.st AND pos.idx=x.pick)"""


def auc_sql(group: str, src: str = "sy", cond: str = "") -> str:
    return f"""bl AS (SELECT system, draw, p, sum(y*m)::double AS pos, sum((1-y)*m)::double AS neg FROM {src} JOIN dr ON dr.g={group} {cond} GROUP BY ALL),
ba AS (SELECT system, draw, CASE WHEN sum(pos)>0 AND sum(neg)>0 THEN sum(pos*(below+neg/2))/(sum(pos)*sum(neg)) END AS auroc FROM (
 SELECT *, coalesce(sum(neg) OVER (PARTITION BY system, draw ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM bl) GROUP BY ALL)"""


DELTA = "dl AS (SELECT a.system, a.draw, a.auroc-r.auroc AS delta FROM ba a JOIN ba r ON r.draw=a.draw AND r.system='v_high' WHERE a.system<>'v_high')"


def ci_sql(v: str, t: str, k: str, level: float = 0.05) -> str:
    return f"""SELECT {k}, count(*) AS draws, round(avg({v}),6) AS mean, round(least(1.0::double, 2.0::double*least(count(*) FILTER (round({v},12)<=0), count(*) FILTER (round({v},12)>=0))/count(*)),6) AS p_value,
 round(quantile_cont({v},{level / 2!r}::double),6) AS ci_low, round(quantile_cont({v},{1 - level / 2!r}::double),6) AS ci_high FROM {t} WHERE {v} IS NOT NULL GROUP BY {k}"""


@query("bootstrap_rows_paired", "B1", with_sql(ci_sql("delta", "dl", "system"), "scores", SYS, draws_sql("episode_key", 1), auc_sql("episode_key"), DELTA))
def bootstrap_rows_paired(spark, sf):
    s = systems(spark, sf)
    a = B.draw_aurocs(s, B.draw_table(s, "episode_key", DRAWS, 1), ["system"], "episode_key")
    return rounded(B.intervals(B.paired_delta(a, "system", "v_high"), ["system"]))


@query("bootstrap_clusters_paired", "B2", with_sql(ci_sql("delta", "dl", "system"), "scores", SYS, draws_sql("content_doc_key", 2), auc_sql("content_doc_key"), DELTA))
def bootstrap_clusters_paired(spark, sf):
    s = systems(spark, sf)
    a = B.draw_aurocs(s, B.draw_table(s, "content_doc_key", DRAWS, 2), ["system"], "content_doc_key")
    return rounded(B.intervals(B.paired_delta(a, "system", "v_high"), ["system"]))


@query("bootstrap_cluster_single", "B3", with_sql(ci_sql("auroc", "ba", "system"), "scores", SYS, draws_sql("content_doc_key", 3), auc_sql("content_doc_key")))
def bootstrap_cluster_single(spark, sf):
    s = systems(spark, sf)
    a = B.draw_aurocs(s, B.draw_table(s, "content_doc_key", DRAWS, 3), ["system"], "content_doc_key")
    return rounded(B.intervals(a, ["system"], "auroc"))


@query("bootstrap_family_bonferroni", "B4", with_sql(
    "SELECT *, (ci_low>0 OR ci_high<0) AS significant FROM (" + ci_sql("delta", "dl", "system", 0.05 / 2) + ")", "scores", SYS, draws_sql("content_doc_key", 4), auc_sql("content_doc_key"), DELTA))
def bootstrap_family_bonferroni(spark, sf):
    s = systems(spark, sf)
    a = B.draw_aurocs(s, B.draw_table(s, "content_doc_key", DRAWS, 4), ["system"], "content_doc_key")
    out = rounded(B.intervals(B.paired_delta(a, "system", "v_high"), ["system"], level=0.05 / 2))
    return out.withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


@query("bootstrap_corpus_stratified", "B5", with_sql(ci_sql("delta", "dl", "system"), "scores", SYS, draws_sql("content_doc_key", 5, "dataset_key"), auc_sql("content_doc_key"), DELTA))
def bootstrap_corpus_stratified(spark, sf):
    s = systems(spark, sf)
    dr = B.draw_table(s, "content_doc_key", DRAWS, 5, F.col("dataset_key"))
    a = B.draw_aurocs(s, dr, ["system"], "content_doc_key")
    return rounded(B.intervals(B.paired_delta(a, "system", "v_high"), ["system"]))


_CTRL = f"""ctl AS (SELECT 'control' AS system, c.j, episode_key, content_doc_key, y, p FROM (SELECT *, ['v_cheap','v_mid','v_high'][least(floor(u*3)::bigint,2)+1] AS want FROM (
 SELECT e.*, j, {u_sql(chr(39) + 'ctl' + chr(39), 'j', 'episode_key')} AS u FROM (SELECT DISTINCT episode_key AS ek FROM sy) k JOIN sy e ON e.episode_key=k.ek, range(16) r(j))) c WHERE system=want)"""


@query("bootstrap_redrawn_control", "B6", with_sql(ci_sql("delta", "dl", "system"), "scores", SYS, draws_sql("content_doc_key", 6), _CTRL,
    """bl AS (SELECT system, draw, p, sum(y*m)::double AS pos, sum((1-y)*m)::double AS neg FROM (SELECT system, content_doc_key, p, y, draw, m FROM sy JOIN dr ON dr.g=content_doc_key WHERE system='v_high'
 UNION ALL SELECT system, content_doc_key, p, y, draw, m FROM ctl JOIN dr ON dr.g=content_doc_key AND j=('0x'||substr(sha256('ctl|'||draw),1,8))::bigint%16) GROUP BY ALL),""" + auc_sql("content_doc_key").split("GROUP BY ALL),", 1)[1], DELTA))
def bootstrap_redrawn_control(spark, sf):
    """Each draw compares against one of sixteen random controls, chosen by the draw."""
    s = systems(spark, sf)
    dr = B.draw_table(s, "content_doc_key", DRAWS, 6)
    x = s.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))))
    want = F.get(F.array(F.lit("v_cheap"), F.lit("v_mid"), F.lit("v_high")), F.least(F.floor(uniform("ctl", F.col("j"), F.col("episode_key")) * 3), F.lit(2)).cast("int"))
    ctl = x.filter(F.col("system") == want).withColumn("system", F.lit("control"))
    control = [r[0] for r in spark.range(DRAWS).orderBy("id").select(hash32("ctl", F.col("id")) % 16).collect()]  # one number a draw
    a = B.draw_aurocs(ctl, dr, ["system"], "content_doc_key", on=("j", control))
    b = B.draw_aurocs(s.filter("system = 'v_high'"), dr, ["system"], "content_doc_key")
    return rounded(B.intervals(B.paired_delta(a.unionByName(b), "system", "v_high"), ["system"]))


@query("bootstrap_additive_bacc", "B7", with_sql(ci_sql("bacc", "bb", "system"), "scores", SYS, draws_sql("content_doc_key", 7),
    """bb AS (SELECT system, draw, (sum(m*(y=1 AND p>=0.5::double)::int)/sum(m*y)::double+sum(m*(y=0 AND p<0.5::double)::int)/sum(m*(1-y))::double)/2 AS bacc FROM sy JOIN dr ON dr.g=content_doc_key GROUP BY ALL)"""))
def bootstrap_additive_bacc(spark, sf):
    s = systems(spark, sf)
    y, p = F.col("y"), F.col("p")
    sums = {"tp": ((y == 1) & (p >= 0.5)).cast("bigint"), "tn": ((y == 0) & (p < 0.5)).cast("bigint"), "P": y.cast("bigint"), "N": (1 - y).cast("bigint"), "ms": F.col("ms")}
    t = B.additive_draws(s, B.draw_table(s, "content_doc_key", DRAWS, 7), ["system"], "content_doc_key", sums)
    return rounded(B.intervals(t.withColumn("bacc", (F.col("tp") / F.col("P") + F.col("tn") / F.col("N")) / 2.0), ["system"], "bacc"))
