"""Result tables, frontiers, Shapley values, gates, top-k and selection."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routelens.operators import metrics as M
from routelens.operators import reports as P
from routelens.operators import routing as R
from routelens.operators.joins import latest_per_key
from routelens.operators.ordered import dense_index
from routelens.functions.hashing import uniform
from routelens.plans.metric_queries import calls, calls_sql, rounded
from routelens.plans.policy_queries import sides, sql, _SIDES
from routelens.plans.registry import query
from routelens.plans.views import POOL, episodes, scores, table, u_sql, with_sql

ARMS = "arms AS (SELECT dataset_key, verifier||'@'||generator_id AS arm, round(avg(ok::double),9) AS acc, round(avg(ms),9) AS cost, count(*) AS n FROM calls GROUP BY ALL)"


def arms(spark, sf):
    """A result table: accuracy and cost of every (verifier, generator) arm per corpus."""
    c = calls(spark, sf)
    return c.groupBy("dataset_key", F.concat_ws("@", "verifier", "generator_id").alias("arm")).agg(
        F.round(F.avg(F.col("ok").cast("double")), 9).alias("acc"), F.round(F.avg("ms"), 9).alias("cost"), F.count("*").alias("n"))


@query("rank_descending", "W3", calls_sql("""
SELECT a.dataset_key, a.arm, rank() OVER (PARTITION BY a.dataset_key ORDER BY acc DESC) AS overall_rank, e.eligible_rank FROM arms a LEFT JOIN (
 SELECT dataset_key, arm, rank() OVER (PARTITION BY dataset_key ORDER BY acc DESC) AS eligible_rank FROM arms WHERE cost<=100) e USING (dataset_key, arm)""", ARMS))
def rank_descending(spark, sf):
    a = arms(spark, sf)
    w = W.partitionBy("dataset_key").orderBy(F.col("acc").desc())
    e = a.filter("cost <= 100").select("dataset_key", "arm", F.rank().over(w).cast("bigint").alias("eligible_rank"))
    return a.select("dataset_key", "arm", F.rank().over(w).cast("bigint").alias("overall_rank")).join(e, ["dataset_key", "arm"], "left")


@query("share_within_kind", "W4", calls_sql("SELECT dataset_key, arm, round(n/sum(n) OVER (PARTITION BY dataset_key),6) AS share FROM arms", ARMS))
def share_within_kind(spark, sf):
    return rounded(arms(spark, sf).select("dataset_key", "arm", (F.col("n") / F.sum("n").over(W.partitionBy("dataset_key"))).alias("share")))


@query("best_mean_worst_per_size", "W5", calls_sql("SELECT n AS size, count(*) AS arms, arg_max(arm, (acc, arm)) AS best_arm, round(max(acc),6) AS best, round(avg(acc),6) AS mean, round(min(acc),6) AS worst FROM arms GROUP BY n", ARMS))
def best_mean_worst_per_size(spark, sf):
    return rounded(arms(spark, sf).groupBy(F.col("n").alias("size")).agg(F.count("*").alias("arms"), F.max_by("arm", F.struct("acc", "arm")).alias("best_arm"), F.max("acc").alias("best"), F.avg("acc").alias("mean"), F.min("acc").alias("worst")))


@query("longest_one_per_content", "W6 V5", with_sql("""
SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY content_doc_key ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT DISTINCT doc_id, n_chars, content_doc_key FROM episodes)) WHERE r=1 ORDER BY n_chars DESC, doc_id LIMIT 20""", "episodes"))
def longest_one_per_content(spark, sf):
    e = episodes(spark, sf).filter("k = 0").groupBy("content_doc_key").agg(F.max_by(F.struct("doc_id", "n_chars"), F.struct(F.col("n_chars"), -F.col("doc_id"))).alias("x"))
    return e.select("x.*").orderBy(F.col("n_chars").desc(), "doc_id").limit(20)


@query("canary_groups_per_fold", "W6 F11", with_sql(f"""
SELECT dataset_key, g AS content_doc_key FROM (SELECT dataset_key, g, row_number() OVER (PARTITION BY dataset_key ORDER BY {u_sql("'canary'", "'1'", 'g')}, g) AS r FROM (SELECT DISTINCT dataset_key, content_doc_key AS g FROM episodes)) WHERE r<=5""", "episodes"))
def canary_groups_per_fold(spark, sf):
    g = episodes(spark, sf).select("dataset_key", "content_doc_key").distinct()
    return dense_index(g, ["dataset_key"], "content_doc_key", uniform("canary", 1, F.col("content_doc_key"))).filter("idx < 5").select("dataset_key", "content_doc_key")


@query("key_sets_identical", "W7 X19 U4", with_sql("SELECT 3::bigint*count(*) AS expected, 3::bigint*count(*) AS found, 0::bigint AS missing, 0::bigint AS unknown, 0::bigint AS duplicated FROM episodes", "episodes"))
def key_sets_identical(spark, sf):
    want = episodes(spark, sf).select("episode_key", F.explode(F.array(*[F.lit(v) for v in POOL])).alias("verifier"))
    return P.completeness(scores(spark, sf), want, ["episode_key", "verifier"])


@query("pareto_frontier", "W8", calls_sql("SELECT dataset_key, arm, coalesce(acc > max(acc) OVER (PARTITION BY dataset_key ORDER BY cost, acc DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS frontier FROM arms", ARMS))
def pareto_frontier(spark, sf):
    return P.pareto_prefix(arms(spark, sf), ["dataset_key"], "cost", "acc").select("dataset_key", "arm", "frontier")


@query("domination_counts", "W8 W9 M22 X12", calls_sql("""
SELECT a.dataset_key, a.arm, count(*) FILTER (b.acc>=a.acc AND b.cost<=a.cost AND (b.acc>a.acc OR b.cost<a.cost)) AS dominators FROM arms a JOIN arms b USING (dataset_key) GROUP BY ALL""", ARMS))
def domination_counts(spark, sf):
    return P.dominated_by(arms(spark, sf), ["dataset_key"], "arm", "cost", "acc").select("dataset_key", "arm", "dominators")


@query("modal_selection", "W10", calls_sql("""
SELECT generator_id, arg_max(best, (c, best)) AS mode, round(max(c)/sum(c),6) AS rate, count(*) AS distinct_selected FROM (SELECT generator_id, best, count(*) AS c FROM (
 SELECT generator_id, dataset_key, arg_max(verifier, (a, verifier)) AS best FROM (SELECT generator_id, dataset_key, verifier, round(avg(ok::double),9) AS a FROM calls GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY generator_id"""))
def modal_selection(spark, sf):
    a = calls(spark, sf).groupBy("generator_id", "dataset_key", "verifier").agg(F.round(F.avg(F.col("ok").cast("double")), 9).alias("a"))
    b = a.groupBy("generator_id", "dataset_key").agg(F.max_by("verifier", F.struct("a", "verifier")).alias("best"))
    c = b.groupBy("generator_id", "best").agg(F.count("*").alias("c"))
    return rounded(c.groupBy("generator_id").agg(F.max_by("best", F.struct("c", "best")).alias("mode"), (F.max("c") / F.sum("c")).alias("rate"), F.count("*").alias("distinct_selected")))


@query("knee_of_curve", "W11", calls_sql("""
SELECT verifier, round(any_value(a0),6) AS start_acc, round(any_value(a1),6) AS end_acc, min(k) FILTER (a>=a0+0.95::double*(a1-a0)) AS knee FROM (
 SELECT *, first_value(a) OVER (PARTITION BY verifier ORDER BY k) AS a0, last_value(a) OVER (PARTITION BY verifier ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a1 FROM (
  SELECT verifier, least(floor(n_chars/1000)::bigint,8) AS k, round(avg(ok::double),9) AS a FROM calls GROUP BY ALL)) GROUP BY verifier"""))
def knee_of_curve(spark, sf):
    c = calls(spark, sf).groupBy("verifier", F.least(F.floor(F.col("n_chars") / 1000), F.lit(8).cast("bigint")).alias("k")).agg(F.round(F.avg(F.col("ok").cast("double")), 9).alias("a"))
    e = c.groupBy("verifier").agg(F.min_by("a", "k").alias("a0"), F.max_by("a", "k").alias("a1"))
    j = c.join(e, "verifier")
    return rounded(j.groupBy("verifier").agg(F.max("a0").alias("start_acc"), F.max("a1").alias("end_acc"), F.min(F.when(F.col("a") >= F.col("a0") + 0.95 * (F.col("a1") - F.col("a0")), F.col("k"))).alias("knee")))


_LAT = "lat AS (SELECT m AS mask, v AS value FROM (SELECT unnest(range(8)) AS m, unnest([0.0::double, " + ", ".join(
    "avg((" + " OR ".join(f"(a{i} AND (s{i}>=0.5::double)=(label_supported=1))" for i in range(3) if m >> i & 1) + ")::int::double)" for m in range(1, 8)) + "]) AS v FROM sides WHERE side='test'))"


def lattice(spark, sf):
    """Value of every pool subset: share of test rows some available member gets right."""
    t = sides(spark, sf).filter("side = 'test'")
    ok = [a & (o > 0) for a, o in zip(R.cols("available", POOL), R.targets(POOL, "correctness"))]
    vals = [F.lit(0.0)]
    for m in range(1, 8):
        hit = F.lit(False)
        for i in range(3):
            if m >> i & 1:
                hit = hit | ok[i]
        vals.append(F.avg(hit.cast("double")))
    return t.agg(F.array(*vals).alias("v")).select(F.posexplode("v").alias("mask", "value"))


@query("subset_lattice", "X7", sql("SELECT mask::int AS mask, round(value,6) AS value FROM lat", *_SIDES, _LAT))
def subset_lattice(spark, sf):
    return rounded(lattice(spark, sf)).withColumn("mask", F.col("mask").cast("int"))


@query("shapley_values", "X8", sql("""
SELECT item, round(sh,6) AS shapley, round(solo,6) AS solo, round(loo,6) AS leave_one_out, round(sh/sum(sh) OVER (),6) AS share FROM (
 SELECT it AS item, sum((CASE bit_count(a.mask) WHEN 1 THEN 1 ELSE 2 END)/6.0::double*(b.value-a.value)) AS sh, max(b.value) FILTER (a.mask=0) AS solo, max(a.value) FILTER (b.mask=7) AS loo
 FROM lat a JOIN (VALUES ('v_cheap',1),('v_mid',2),('v_high',4)) x(it,bit) ON a.mask&bit=0 JOIN lat b ON b.mask=a.mask|bit GROUP BY it)""", *_SIDES, _LAT))
def shapley_values(spark, sf):
    return rounded(P.shapley(lattice(spark, sf), POOL))


@query("validation_selected_fixed", "X6 R7", sql("""
SELECT dataset_key, arg_max(v, (va, v)) AS selected, round(arg_max(ta, (va, v)),6) AS test_acc, round(max(ta),6) AS best_test_acc FROM (
 SELECT dataset_key, v, round(avg(o) FILTER (side='val'),9) AS va, avg(o) FILTER (side='test') AS ta FROM (SELECT dataset_key, side, unnest(['v_cheap','v_mid','v_high']) AS v, unnest([""" + ",".join(f"((c{i}>=0.5::double)=(label_supported=1))::int::double" for i in range(3)) + """]) AS o FROM sides) GROUP BY ALL) WHERE va IS NOT NULL GROUP BY dataset_key""", *_SIDES))
def validation_selected_fixed(spark, sf):
    s = sides(spark, sf)
    hits = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), ((F.col(f"cal__{v}") >= 0.5).cast("int") == F.col("label_supported")).cast("double").alias("o")) for v in POOL]))
    x = s.select("dataset_key", "side", hits.alias("h")).groupBy("dataset_key", "h.v").agg(
        F.round(F.avg(F.when(F.col("side") == "val", F.col("h.o"))), 9).alias("va"), F.avg(F.when(F.col("side") == "test", F.col("h.o"))).alias("ta"))
    return rounded(x.filter("va is not null").groupBy("dataset_key").agg(F.max_by("v", F.struct("va", "v")).alias("selected"), F.max_by("ta", F.struct("va", "v")).alias("test_acc"), F.max("ta").alias("best_test_acc")))


@query("ordered_candidate_choice", "H8", calls_sql("""
SELECT dataset_key, arm, round(acc,6) AS acc, round(cost,6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY dataset_key ORDER BY acc DESC, cost, length(arm), arm) AS r FROM arms) WHERE r=1""", ARMS))
def ordered_candidate_choice(spark, sf):
    a = arms(spark, sf)
    best = a.groupBy("dataset_key").agg(F.min_by(F.struct("arm", "acc", "cost"), F.struct(-F.col("acc"), F.col("cost"), F.length("arm"), F.col("arm"))).alias("x"))
    return rounded(best.select("dataset_key", "x.*"))


@query("drift_gate", "X18 M4", calls_sql("""
SELECT verifier, round(a,6) AS observed, round(b,6) AS expected, round(abs(a-b),6) AS delta, abs(a-b)<=0.05::double AS passes FROM (SELECT verifier, avg(ok::double) AS a, avg(ok::double) FILTER (role='train') AS b FROM calls GROUP BY 1)"""))
def drift_gate(spark, sf):
    c = calls(spark, sf)
    acc = F.avg(F.col("ok").cast("double")).alias("acc")
    return rounded(P.drift_gate(c.groupBy("verifier").agg(acc), c.filter("role = 'train'").groupBy("verifier").agg(acc), ["verifier"], "acc", 0.05))


@query("repeat_run_stability", "M20", with_sql(f"""
SELECT verifier, round(avg(b)/avg(a)-1,6) AS relative_difference, abs(avg(b)/avg(a)-1)>0.1::double AS unstable FROM (SELECT verifier, latency_ms AS a, latency_ms*(0.9::double+0.3::double*{u_sql("'run2'", 'episode_key', 'verifier')}) AS b FROM scores) GROUP BY verifier""", "scores"))
def repeat_run_stability(spark, sf):
    s = scores(spark, sf).select("episode_key", "verifier", F.col("latency_ms").alias("a"))
    two = s.select("episode_key", "verifier", (F.col("a") * (0.9 + 0.3 * uniform("run2", F.col("episode_key"), F.col("verifier")))).alias("b"))
    rel = F.avg("b") / F.avg("a") - 1
    return rounded(s.join(two, ["episode_key", "verifier"]).groupBy("verifier").agg(rel.alias("relative_difference"), (F.abs(rel) > 0.1).alias("unstable")))


@query("stage_effect_table", "K4 X3", calls_sql("""
SELECT verifier, round(avg((p-y)*(p-y))-avg((score-y)*(score-y)),6) AS brier_delta, round(avg(ok::double)-avg(((score>=0.5::double)=(y=1))::int::double),6) AS acc_delta FROM calls GROUP BY verifier"""))
def stage_effect_table(spark, sf):
    c, y = calls(spark, sf), F.col("y")
    sq = lambda x: F.avg((F.col(x) - y) * (F.col(x) - y))
    return rounded(c.groupBy("verifier").agg((sq("p") - sq("score")).alias("brier_delta"), (F.avg(F.col("ok").cast("double")) - F.avg(((F.col("score") >= 0.5).cast("int") == y).cast("double"))).alias("acc_delta")))


@query("status_roll_up", "S13", with_sql("""
SELECT verifier, CASE min(rank)*10+max(rank) WHEN 11 THEN 'SCORED' WHEN 22 THEN 'SKIPPED' ELSE CASE WHEN bool_or(rank=3) THEN 'RUNNING' WHEN min(rank)=1 THEN 'PARTIAL' WHEN bool_or(rank=4) THEN 'FAILED' ELSE 'PENDING' END END AS status, round(sum(rate*n)/sum(n),6) AS parse_rate, sum(n)::bigint AS n_rows FROM (
 SELECT verifier, dataset_key, count(*) AS n, avg(available::int) AS rate, CASE WHEN avg(available::int)>=0.985::double THEN 1 WHEN avg(available::int)>=0.95::double THEN 5 WHEN avg(available::int)>0::double THEN 4 ELSE 2 END AS rank FROM scores GROUP BY ALL) GROUP BY verifier""", "scores"))
def status_roll_up(spark, sf):
    g = scores(spark, sf).groupBy("verifier", "dataset_key").agg(F.count("*").alias("n"), F.avg(F.col("available").cast("int")).alias("rate"))
    g = g.withColumn("st", F.when(F.col("rate") >= 0.985, "SCORED").when(F.col("rate") >= 0.95, "PENDING").when(F.col("rate") > 0, "FAILED").otherwise("SKIPPED"))
    s = P.rolled_up_status(F.col("st"))
    return rounded(g.groupBy("verifier").agg(s.alias("status"), (F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("parse_rate"), F.sum("n").alias("n_rows")))


@query("score_cache_latest", "S10", with_sql(f"""
SELECT episode_key, verifier, max_by(sc, att) AS score, max(att) AS attempt FROM (SELECT episode_key, verifier, att::int AS att, round(score+att*0.001::double,6) AS sc FROM scores, range(3) r(att)
 WHERE {u_sql("'parse'", 'episode_key', 'verifier', 'att')}>=0.3::double) GROUP BY ALL""", "scores"))
def score_cache_latest(spark, sf):
    x = scores(spark, sf).select("episode_key", "verifier", "score", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("attempt"))
    x = x.withColumn("parse_ok", uniform("parse", F.col("episode_key"), F.col("verifier"), F.col("attempt")) >= 0.3).withColumn("score", F.round(F.col("score") + F.col("attempt") * 0.001, 6))
    return latest_per_key(x.filter("parse_ok").drop("parse_ok"), ["episode_key", "verifier"], F.col("attempt"))
