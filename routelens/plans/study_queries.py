"""The nested out-of-fold study: selection, stored parts and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.config import TARGET_SHARES
from routelens.functions import expr as E
from routelens.functions.hashing import uniform
from routelens.operators import metrics as M
from routelens.operators import nested as N
from routelens.operators import reports as P
from routelens.operators import splits as S
from routelens.plans.metric_queries import rounded
from routelens.plans.policy_queries import argmax, pick
from routelens.plans.registry import query
from routelens.plans.views import POOL, u_sql, wide, with_sql
from routelens.session import scratch_path
from routelens.sources.files import part_coverage, settled, unfinished, write_table

# Fixed values of the study: discounts, seeds, folds; the prices of the three actions
STUDY = N.Study(
    costs=(20.0, 60.0, 250.0), betas=(0.0, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2), seeds=(17, 29, 43), folds=5, inner=3, masks=(0, 1, 2, 3), priors=(1.0, 20.0)
)
BINS = ("corpus", "long_doc")
CONFIG = ["method", "beta", "seed"]
KEEP = ("episode_key", "dataset_key", "content_doc_key", "feature_latency_ms")


def study_rows(spark, sf):
    """Training rows with their outer fold (label-stratified, groups whole) and their bins."""
    w = wide(spark, sf).filter("role = 'train'")
    f = S.fold_groups(w, 29, STUDY.folds, strata=("stratum_label",), tag="label")
    x = w.join(f, "content_doc_key").withColumn("fold", F.col("fold").cast("int"))
    return x.withColumn("corpus", F.coalesce("dataset_key", F.lit(""))).withColumn("long_doc", (F.col("feature_latency_ms") >= 2.0).cast("string"))


def study(spark, sf):
    """(rows, heads, inner results, chosen candidates)."""
    rows = settled(study_rows(spark, sf), "study-rows")
    prof = settled(N.profiles(rows, STUDY, POOL, BINS), "study-profiles")
    heads = settled(N.fits(prof, STUDY, BINS), "study-heads")
    results = settled(N.inner_results(prof, heads, STUDY, BINS), "study-results")
    return rows, heads, results, settled(N.selected(results), "study-choices")


def study_predictions(spark, sf):
    rows, heads, _, chosen = study(spark, sf)
    return settled(N.predictions(rows, heads, chosen, STUDY, POOL, BINS, KEEP), "study-predictions")


# ------------------------------------------------------------------------------------ SQL mirror

_C = STUDY.costs
_VAL = lambda name, cols, rows: f"(VALUES {','.join(rows)}) {name}({cols})"
_BETA = _VAL("bb", "beta", [f"({b}::double)" for b in STUDY.betas])
_CONFIGS = _VAL("cf", "method, beta, trained_beta", [f"('{m}',{b}::double,{0.0 if m == 'S1' else b}::double)" for m, b in STUDY.configurations()])
_TRAINED = _VAL("tc", "method, beta", [f"('{m}',{b}::double)" for m, b in STUDY.configurations() if m != "S1"] + ["('S1',0.0::double)"])
_CAND = _VAL("cd", "mask, prior, parameters", [f"({m},{p}::double,'{t}')" for m, p, t in STUDY.candidates()])
_CELL = "CASE WHEN mask&1>0 THEN corpus ELSE '*' END||'|'||CASE WHEN mask&2>0 THEN long_doc ELSE '*' END"
_HEAD = [f"CASE WHEN method='S3' THEN coalesce(t{i},0.5::double) ELSE coalesce(p{i},0.5::double)*exp(-beta*{_C[i] / max(_C)!r}::double) END" for i in range(3)]
_SEL = f"coalesce({argmax(_HEAD, [f'a{i}=1' for i in range(3)])},0)"
_DISC = "exp(-beta*" + pick("{}", "sel").replace("{}0", f"{_C[0] / max(_C)!r}::double").replace("{}1", f"{_C[1] / max(_C)!r}::double").replace("{}2", f"{_C[2] / max(_C)!r}::double") + ")"
_P = [f"least(greatest(coalesce(p{i},0.5::double),1e-7::double),1-1e-7::double)" for i in range(3)]
_LOSS = "(" + "+".join(f"(-a{i}*(o{i}*ln({_P[i]})+(1-o{i})*ln(1-{_P[i]})))" for i in range(3)) + ")"

_STUDY = [
    "st AS (SELECT content_doc_key AS g, round_even(avg(label_supported::double),0)::int AS yy FROM wide WHERE role='train' GROUP BY 1)",
    f"sf AS (SELECT g, (row_number() OVER (PARTITION BY yy ORDER BY {u_sql(chr(39) + 'label' + chr(39), chr(39) + '29' + chr(39), 'g')}, g)-1)%{STUDY.folds} AS fold FROM st)",
    f"""sr AS (SELECT w.episode_key, w.dataset_key, content_doc_key, label_supported AS y, feature_latency_ms AS fms, coalesce(dataset_key,'') AS corpus, (feature_latency_ms>=2)::varchar AS long_doc, fold, seed,
 floor({u_sql(chr(39) + 'inner' + chr(39), 'seed', 'content_doc_key')}*{STUDY.inner})::int AS held, """ + ", ".join(
        f"a{i}::int AS a{i}, (a{i} AND (s{i}>=0.5::double)=(label_supported=1))::int AS o{i}, coalesce(l{i},0) AS l{i}, coalesce(s{i},0.5::double) AS s{i}" for i in range(3)) + f""" FROM wide w JOIN sf ON g=content_doc_key, {_VAL("sd", "seed", [f"({s})" for s in STUDY.seeds])} WHERE role='train')""",
    "prof AS (SELECT seed, fold, held, corpus, long_doc, a0, a1, a2, o0, o1, o2, y, count(*) AS n, sum(l0) AS l0, sum(l1) AS l1, sum(l2) AS l2 FROM sr GROUP BY ALL)",
    f"""tr AS (SELECT p.* EXCLUDE (held), o.f AS outer_f, h.g AS without, mask, {_CELL} AS cell, CASE WHEN o0=1 THEN 0 WHEN o1=1 THEN 1 WHEN o2=1 THEN 2 END AS best
 FROM prof p, range({STUDY.folds}) o(f), range(-1,{STUDY.inner}) h(g), (VALUES {','.join(f'({m})' for m in STUDY.masks)}) mm(mask) WHERE o.f<>p.fold AND h.g<>p.held)""",
    "hs AS (SELECT seed, outer_f, without, mask, cell, " + ", ".join(f"sum(n*a{i})::double AS n{i}, sum(n*o{i})::double AS s{i}, coalesce(sum(n) FILTER (best={i}),0)::double AS c{i}" for i in range(3)) + " FROM tr GROUP BY ALL)",
    "hd AS (SELECT seed, outer_f, without, mask, prior, cell, " + ", ".join(
        f"({c}{i}+prior*coalesce(sum({c}{i}) OVER w/sum(n{i}) OVER w,0.5::double))/(n{i}+prior) AS {o}{i}" for c, o in (("s", "p"), ("c", "t")) for i in range(3)) + f" FROM hs, (VALUES {','.join(f'({p}::double)' for p in STUDY.priors)}) pp(prior) WINDOW w AS (PARTITION BY seed, outer_f, without, mask, prior))",
    f"""tried AS (SELECT *, {pick('o', 'sel')} AS hit, {pick('l', 'sel')} AS lat FROM (SELECT x.*, method, beta, {_LOSS} AS loss, a0+a1+a2 AS asked, {_SEL} AS sel FROM (
 SELECT p.*, o.f AS outer_f, cd.mask, cd.prior, parameters, {_CELL} AS cell FROM prof p, range({STUDY.folds}) o(f), {_CAND} WHERE o.f<>p.fold) q LEFT JOIN hd h ON h.seed=q.seed AND h.outer_f=q.outer_f AND h.without=q.held AND h.mask=q.mask AND h.prior=q.prior AND h.cell=q.cell, {_TRAINED}) x)""".replace("x.*, method", "q.*, p0, p1, p2, t0, t1, t2, method").replace(" x)", ")"),
    f"""inner_table AS (SELECT *, CASE WHEN method='S1' THEN likelihood ELSE inner_utility END AS prim FROM (SELECT seed, outer_f, method, beta AS trained_beta, mask, prior, parameters, sum(n*hit*{_DISC})/sum(n) AS inner_utility,
 (coalesce(sum(n*hit) FILTER (y=1)/sum(n) FILTER (y=1)::double, sum(n*hit) FILTER (y=0)/sum(n) FILTER (y=0)::double)+coalesce(sum(n*hit) FILTER (y=0)/sum(n) FILTER (y=0)::double, sum(n*hit) FILTER (y=1)/sum(n) FILTER (y=1)::double))/2 AS inner_bacc,
 sum(lat)/sum(n) AS inner_latency_ms, -sum(n*loss)/sum(n*asked) AS likelihood FROM tried GROUP BY ALL))""",
    "picked AS (SELECT * FROM inner_table QUALIFY row_number() OVER (PARTITION BY seed, outer_f, method, trained_beta ORDER BY round(prim,12) DESC, round(inner_bacc,12) DESC, round(inner_latency_ms,9), length(parameters), parameters DESC)=1)",
    f"""preds AS (SELECT method, beta, seed, fold, episode_key, dataset_key, content_doc_key, fms AS feature_latency_ms, y, ['v_cheap','v_mid','v_high'][sel+1] AS selected_action, CASE WHEN {pick('o', 'sel')}=1 THEN y ELSE 1-y END AS d, {pick('o', 'sel')} AS correct,
 {pick('s', 'sel')} AS p, fms+{pick('l', 'sel')} AS ms, a0, a1, a2, o0, o1, o2, """ + ", ".join(f"coalesce(p{i},0.5::double) AS p{i}" for i in range(3)) + f""" FROM (SELECT *, {_SEL} AS sel FROM (SELECT x.*, p0, p1, p2, t0, t1, t2 FROM (
 SELECT r.*, cf.method, cf.beta, k.mask, k.prior, {_CELL.replace('mask', 'k.mask')} AS cell FROM sr r, {_CONFIGS} JOIN picked k ON true WHERE k.seed=r.seed AND k.outer_f=r.fold AND k.method=cf.method AND k.trained_beta=cf.trained_beta) x LEFT JOIN hd h ON h.seed=x.seed AND h.outer_f=x.fold AND h.without=-1 AND h.mask=x.mask AND h.prior=x.prior AND h.cell=x.cell)))""",
]


def study_sql(body: str, *more: str) -> str:
    return with_sql(body, "wide", *_STUDY, *more)


@query("nested_selection", "H8 X16", study_sql("""
SELECT seed::bigint AS seed, outer_f::bigint AS fold, method, trained_beta, parameters, round(prim,6) AS primary_score, round(inner_utility,6) AS inner_utility, round(inner_bacc,6) AS inner_bacc, round(inner_latency_ms,6) AS inner_latency_ms FROM picked"""))
def nested_selection(spark, sf):
    """The candidate that each seed, fold, method and trained discount chose on its inner folds."""
    k = study(spark, sf)[3]
    return rounded(k.select("seed", F.col("outer").alias("fold"), "method", "trained_beta", "parameters", F.col("primary").alias("primary_score"), "inner_utility", "inner_bacc", "inner_latency_ms"))


@query("nested_parts_resumed", "X16 S9 X19", study_sql("""
SELECT method, beta, seed::bigint AS seed, fold::bigint AS fold, count(*) AS expected, count(*) AS found, 0::bigint AS duplicates, count(*) FILTER (fold=2 AND seed=29) AS made_again, count(DISTINCT selected_action) AS actions, round(avg(correct),6) AS acc FROM preds GROUP BY ALL"""))
def nested_parts_resumed(spark, sf):
    """Parts are written per configuration and fold; after some are lost only these are made again, and every row is there once."""
    rows, heads, _, chosen = study(spark, sf)
    keys = [*CONFIG, "fold"]
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(b)).alias("beta")) for m, b in STUDY.configurations()]))
    want = rows.select("episode_key", "fold").withColumn("seed", F.explode(F.lit(list(STUDY.seeds)))).withColumn("g", grid).select("episode_key", "seed", "fold", "g.*")
    path = scratch_path(spark, "nested-parts")

    def stored():
        return spark.read.schema(made.schema).parquet(path)

    made = N.predictions(rows, heads, chosen, STUDY, POOL, BINS, KEEP)
    write_table(made.filter("not (fold = 2 and seed = 29)"), path, keys)
    todo = settled(unfinished(want, stored(), keys, "episode_key"), "todo")
    again = N.predictions(rows, heads, chosen, STUDY, POOL, BINS, KEEP, todo=todo)
    write_table(again, path, keys)
    done = stored()
    cover = part_coverage(want, done, keys, "episode_key")
    facts = done.groupBy(*keys).agg(F.count_distinct("selected_action").alias("actions"), F.avg("correct").alias("acc"))
    remade = todo.withColumn("redo", F.lit(1))
    j = cover.join(facts, keys).join(remade, keys, "left")
    return rounded(j.withColumn("made_again", F.when(F.col("redo") == 1, F.col("found")).otherwise(0)).drop("redo"))


def config_metrics(pred, keys):
    """Quality, latency and call shares per group of ``keys``; null keys are a group."""
    y, d = F.col("y"), F.col("d")
    of = lambda v: F.count_if((y == v) & (d == v)) / F.count_if(y == v)
    safe = lambda v: F.when(F.count_if(y == v) > 0, of(v))
    return pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("content_doc_key").alias("groups"), F.avg("correct").alias("acc"), ((F.coalesce(safe(1), safe(0)) + F.coalesce(safe(0), safe(1))) / 2).alias("bacc"),
        F.avg("ms").alias("mean_ms"), *[F.avg((F.col("selected_action") == a).cast("double")).alias(f"rate_{a}") for a in POOL])


_METRICS = """count(*) AS n_rows, count(DISTINCT content_doc_key) AS groups, avg(correct) AS acc,
 (coalesce(avg((d=1)::int) FILTER (y=1),avg((d=0)::int) FILTER (y=0))+coalesce(avg((d=0)::int) FILTER (y=0),avg((d=1)::int) FILTER (y=1)))/2 AS bacc, avg(ms) AS mean_ms, """ + ", ".join(f"avg((selected_action='{a}')::int) AS rate_{a}" for a in POOL)
_NUMBERS = ("acc", "bacc", "mean_ms", *[f"rate_{a}" for a in POOL])
_R = ", ".join(f"round({c},6) AS {c}" for c in _NUMBERS)
_BY_CORPUS = f"by_corpus AS (SELECT method, beta, seed, dataset_key, {_METRICS} FROM preds GROUP BY ALL)"
_BY_SEED = f"by_seed AS (SELECT method, beta, seed, {_METRICS} FROM preds GROUP BY ALL)"


@query("nested_config_metrics", "X16 M11", study_sql(f"""
SELECT method, beta, seed::bigint AS seed, coalesce(dataset_key,'') AS dataset_key, pooled, n_rows, groups, {_R} FROM (SELECT method, beta, seed, NULL AS dataset_key, true AS pooled, * EXCLUDE (method, beta, seed) FROM by_seed UNION ALL SELECT method, beta, seed, dataset_key, false, * EXCLUDE (method, beta, seed, dataset_key) FROM by_corpus)""", _BY_CORPUS, _BY_SEED))
def nested_config_metrics(spark, sf):
    """One table for the pooled and the per-corpus metrics: grouping sets over the stored predictions."""
    p = study_predictions(spark, sf)
    both = config_metrics(p, CONFIG).withColumn("dataset_key", F.lit("")).withColumn("pooled", F.lit(True)).unionByName(
        config_metrics(p, [*CONFIG, "dataset_key"]).withColumn("dataset_key", F.coalesce("dataset_key", F.lit(""))).withColumn("pooled", F.lit(False)))
    return rounded(both)


@query("nested_family_macro", "X16 M8", study_sql("SELECT method, beta, seed::bigint AS seed, " + ", ".join(f"round(avg({c}),6) AS {c}" for c in _NUMBERS) + " FROM by_corpus GROUP BY ALL", _BY_CORPUS))
def nested_family_macro(spark, sf):
    """Means of the per-corpus metrics: every corpus counts the same."""
    g = config_metrics(study_predictions(spark, sf), [*CONFIG, "dataset_key"])
    return rounded(g.groupBy(*CONFIG).agg(*[F.avg(c).alias(c) for c in _NUMBERS]))


_SUMMARY = "seeds_table AS (SELECT method, beta, count(DISTINCT seed) AS seed_count, " + ", ".join(f"avg({c}) AS {c}_mean, coalesce(stddev_samp({c}),0) AS {c}_std" for c in _NUMBERS) + " FROM by_seed GROUP BY ALL)"


def seed_summary(spark, sf):
    g = config_metrics(study_predictions(spark, sf), CONFIG)
    return g.groupBy("method", "beta").agg(F.count_distinct("seed").alias("seed_count"), *[a for c in _NUMBERS for a in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))])


@query("nested_seed_summary", "X16 M10", study_sql("SELECT method, beta, seed_count, " + ", ".join(f"round({c}_{k},6) AS {c}_{k}" for c in _NUMBERS for k in ("mean", "std")) + " FROM seeds_table", _BY_SEED, _SUMMARY))
def nested_seed_summary(spark, sf):
    return rounded(seed_summary(spark, sf))


@query("nested_pareto", "X16 W8", study_sql("""
SELECT method, beta, round(bacc_mean,6) AS bacc_mean, round(mean_ms_mean,6) AS mean_ms_mean FROM seeds_table a WHERE NOT EXISTS (SELECT 1 FROM seeds_table b WHERE round(b.bacc_mean,9)>=round(a.bacc_mean,9) AND round(b.mean_ms_mean,9)<=round(a.mean_ms_mean,9)
 AND (round(b.bacc_mean,9)>round(a.bacc_mean,9) OR round(b.mean_ms_mean,9)<round(a.mean_ms_mean,9)))""", _BY_SEED, _SUMMARY))
def nested_pareto(spark, sf):
    """Configurations that no other one beats in balanced accuracy and latency."""
    s = seed_summary(spark, sf).select(F.lit(0).alias("all"), F.concat_ws("@", "method", F.col("beta").cast("string")).alias("name"), "method", "beta", F.round("bacc_mean", 9).alias("bacc_mean"), F.round("mean_ms_mean", 9).alias("mean_ms_mean"))
    return rounded(P.dominated_by(s, ["all"], "name", "mean_ms_mean", "bacc_mean").filter("dominators = 0").select("method", "beta", "bacc_mean", "mean_ms_mean"))


_ACTION = "acts AS (SELECT method, beta, seed, y, unnest(['v_cheap','v_mid','v_high']) AS action, unnest([a0,a1,a2]) AS a, unnest([o0,o1,o2]) AS o, unnest([p0,p1,p2]) AS p FROM preds WHERE method<>'S3'), asked AS (SELECT method, beta, seed, action, o, least(greatest(p,1e-7::double),1-1e-7::double) AS p FROM acts WHERE a=1)"


@query("nested_correctness_calibration", "X16 K5", study_sql("""
SELECT method, beta, seed::bigint AS seed, action, n_rows, round(nll,6) AS nll, round(brier,6) AS brier, round(ece,6) AS ece, round(auroc,6) AS auroc FROM (
 SELECT method, beta, seed, action, count(*) AS n_rows, avg(-(o*ln(p)+(1-o)*ln(1-p))) AS nll, avg((p-o)*(p-o)) AS brier FROM asked GROUP BY ALL) JOIN (
 SELECT method, beta, seed, action, sum(n*abs(mp-mo))/sum(n) AS ece FROM (SELECT method, beta, seed, action, least(greatest(ceil(p*15)-1,0),14) AS b, count(*) AS n, avg(p) AS mp, avg(o) AS mo FROM asked GROUP BY ALL) GROUP BY ALL) USING (method, beta, seed, action) LEFT JOIN (
 SELECT method, beta, seed, action, CASE WHEN sum(pos)>0 AND sum(neg)>0 THEN sum(pos*(below+neg/2.0::double))/(sum(pos)*sum(neg)) END AS auroc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY method, beta, seed, action ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::double AS below FROM (
  SELECT method, beta, seed, action, p, sum(o)::double AS pos, sum(1-o)::double AS neg FROM asked GROUP BY ALL)) GROUP BY ALL) USING (method, beta, seed, action)""", _ACTION))
def nested_correctness_calibration(spark, sf):
    """How well the out-of-fold chances say whether an action is right, per configuration and action."""
    p = study_predictions(spark, sf).filter("method <> 'S3'")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.col(f"a{i}").alias("a"), F.col(f"o{i}").alias("y"), E.clip(F.col(f"p{i}"), 1e-7, 1 - 1e-7).alias("p")) for i, a in enumerate(POOL)]))
    x = p.select(*CONFIG, each.alias("e")).select(*CONFIG, "e.*").filter("a = 1")
    k = [*CONFIG, "action"]
    n = x.groupBy(*k).agg(F.count(F.lit(1)).alias("n_rows"))
    return rounded(n.join(M.proper_scores(x, k), k).join(M.calibration_error(x, k, right=True).drop("mce"), k).join(M.auroc(x, k), k, "left"))


_RATES = "rates AS (SELECT method, beta, seed, " + ", ".join(f"avg((selected_action='{a}')::int) AS w{i}" for i, a in enumerate(POOL)) + " FROM preds GROUP BY ALL)"
_DRAW = u_sql("'matched'", "method", "beta_text", "seed", "episode_key")


@query("nested_baselines", "X16 R9 X17", study_sql(f"""
SELECT baseline, method, beta, seed::bigint AS seed, n_rows, round(acc,6) AS acc, round(bacc,6) AS bacc, round(mean_ms,6) AS mean_ms FROM (
 SELECT baseline, method, beta, seed, count(*) AS n_rows, avg(hit) AS acc, (avg(hit) FILTER (y=1)+avg(hit) FILTER (y=0))/2 AS bacc, avg(ms) AS mean_ms FROM (SELECT *, {pick('o', 'sel')} AS hit, fms+{pick('l', 'sel')} AS ms FROM based) GROUP BY ALL)""",
    _RATES, "once AS (SELECT * FROM sr WHERE seed=17)",
    "based AS (" + " UNION ALL ".join(f"SELECT * EXCLUDE (seed), 'always_{a}' AS baseline, '' AS method, 0.0::double AS beta, 0 AS seed, coalesce({argmax([str(float(j == i)) + '::double' for j in range(3)], [f'a{j}=1' for j in range(3)])},0) AS sel FROM once" for i, a in enumerate(POOL))
    + " UNION ALL SELECT * EXCLUDE (seed), 'cheapest_correct', '', 0.0::double, 0, CASE WHEN o0=1 THEN 0 WHEN o1=1 THEN 1 WHEN o2=1 THEN 2 WHEN a0=1 THEN 0 WHEN a1=1 THEN 1 WHEN a2=1 THEN 2 ELSE 0 END FROM once"
    + f""" UNION ALL SELECT * EXCLUDE (method, beta, seed, w0, w1, w2, z0, z1, z2, beta_text, u), 'matched_random', method, beta, seed, CASE WHEN a0+a1+a2=0 THEN 0 WHEN u<=z0 THEN 0 WHEN u<=z0+z1 THEN 1 ELSE 2 END FROM (SELECT *, {_DRAW} AS u FROM (
 SELECT o.* EXCLUDE (seed), r.*, round(r.beta*100)::int::varchar AS beta_text, """ + ", ".join(f"CASE WHEN w0*a0+w1*a1+w2*a2>0 THEN w{i}*a{i}/(w0*a0+w1*a1+w2*a2) ELSE a{i}/greatest(a0+a1+a2,1)::double END AS z{i}" for i in range(3)) + " FROM once o, rates r)))"))
def nested_baselines(spark, sf):
    """Fixed actions, the cheapest right one, and for every configuration a random call with its own call shares."""
    rows, heads, _, chosen = study(spark, sf)
    pred = N.predictions(rows, heads, chosen, STUDY, POOL, BINS, KEEP)
    base = rows.withColumns(N._flags(POOL, "label_supported")).select("episode_key", F.col("label_supported").alias("y"), "feature_latency_ms", *[f"{c}{i}" for i in range(3) for c in "ao"], *[F.coalesce(f"latency_ms__{a}", F.lit(0.0)).alias(f"l{i}") for i, a in enumerate(POOL)])
    av, ok = [F.col(f"a{i}") == 1 for i in range(3)], [F.col(f"o{i}") == 1 for i in range(3)]
    first = F.coalesce(*[F.when(a, F.lit(i)) for i, a in enumerate(av)], F.lit(0))
    none = [F.lit("").alias("method"), F.lit(0.0).alias("beta"), F.lit(0).alias("seed")]
    fixed = [base.select("*", F.lit(f"always_{a}").alias("baseline"), *none, F.when(av[i], F.lit(i)).otherwise(first).alias("sel")) for i, a in enumerate(POOL)]
    fixed.append(base.select("*", F.lit("cheapest_correct").alias("baseline"), *none, F.coalesce(*[F.when(o, F.lit(i)) for i, o in enumerate(ok)], first).alias("sel")))
    rates = pred.groupBy(*CONFIG).agg(*[F.avg((F.col("selected_action") == a).cast("double")).alias(f"w{i}") for i, a in enumerate(POOL)])
    shares = {(r.method, r.beta, r.seed): (r.w0, r.w1, r.w2) for r in rates.collect()}  # one row a configuration
    table = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(b).alias("beta"), F.lit(s).alias("seed"), *[F.lit(v).alias(f"w{i}") for i, v in enumerate(w)]) for (m, b, s), w in sorted(shares.items())]))
    x = base.withColumn("c", table).select(*base.columns, "c.*")
    total, live = sum((F.col(f"w{i}") * F.col(f"a{i}") for i in range(3)), F.lit(0.0)), F.col("a0") + F.col("a1") + F.col("a2")
    z = [F.when(total > 0, F.col(f"w{i}") * F.col(f"a{i}") / total).otherwise(F.col(f"a{i}") / F.greatest(live, F.lit(1))) for i in range(3)]
    u = uniform("matched", F.col("method"), F.round(F.col("beta") * 100).cast("int"), F.col("seed"), F.col("episode_key"))
    drawn = x.withColumn("u", u).withColumn("sel", F.when(live == 0, 0).when(F.col("u") <= z[0], 0).when(F.col("u") <= z[0] + z[1], 1).otherwise(2)).withColumn("baseline", F.lit("matched_random"))
    cols = ["baseline", *CONFIG, "y", "feature_latency_ms", "sel", *[f"{c}{i}" for i in range(3) for c in "ol"]]
    every = drawn.select(*cols)
    for f in fixed:
        every = every.unionByName(f.select(*cols))
    hit = E.pick([F.col(f"o{i}") for i in range(3)], F.col("sel"))
    ms = F.col("feature_latency_ms") + E.pick([F.col(f"l{i}") for i in range(3)], F.col("sel"))
    of = lambda v: F.avg(F.when(F.col("y") == v, hit))
    return rounded(every.groupBy("baseline", *CONFIG).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(hit).alias("acc"), ((of(1) + of(0)) / 2).alias("bacc"), F.avg(ms).alias("mean_ms")))


TOLERANCE = 0.05
_SHARE_ERROR = "greatest(" + ", ".join(f"abs(rate_{a}-{v}::double)" for a, v in zip(POOL, TARGET_SHARES)) + ")"


@query("target_mix_best", "R17 X15 X16", study_sql(f"""
SELECT method, beta, round(auroc,6) AS auroc, round(bacc,6) AS bacc, round(mean_ms,6) AS mean_ms, {", ".join(f"round(rate_{a},6) AS rate_{a}" for a in POOL)}, round(err,6) AS max_share_error, eligible, CASE WHEN eligible THEN 'eligible' ELSE 'closest_ineligible' END AS selection_status,
 row_number() OVER (ORDER BY eligible DESC, round(auroc,12) DESC, round(mean_ms,9), round(bacc,12) DESC, method)=1 AS overall_best FROM (
 SELECT * FROM (SELECT *, round({_SHARE_ERROR},9) AS err, round({_SHARE_ERROR},9)<={TOLERANCE} AS eligible FROM mixes) QUALIFY row_number() OVER (PARTITION BY method ORDER BY eligible DESC, CASE WHEN eligible THEN 0 ELSE err END, round(auroc,12) DESC, round(mean_ms,9), round(bacc,12) DESC, beta)=1)""", _BY_SEED,
    "seed_auc AS (SELECT method, beta, seed, sum(pos*(below+neg/2.0::double))/(sum(pos)*sum(neg)) AS auroc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY method, beta, seed ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::double AS below FROM (SELECT method, beta, seed, p, sum(y)::double AS pos, sum(1-y)::double AS neg FROM preds GROUP BY ALL)) GROUP BY ALL)",
    "mixes AS (SELECT method, beta, avg(auroc) AS auroc, avg(bacc) AS bacc, avg(mean_ms) AS mean_ms, " + ", ".join(f"avg(rate_{a}) AS rate_{a}" for a in POOL) + " FROM by_seed JOIN seed_auc USING (method, beta, seed) GROUP BY ALL)"))
def target_mix_best(spark, sf):
    """Per method, the discount whose call shares come closest to the wanted mix and, among those close enough, routes best."""
    p = study_predictions(spark, sf)
    g = config_metrics(p, CONFIG).join(M.auroc(p, CONFIG), CONFIG)
    mean = g.groupBy("method", "beta").agg(*[F.avg(c).alias(c) for c in ("auroc", "bacc", "mean_ms", *[f"rate_{a}" for a in POOL])])
    return rounded(P.best_under_shares(settled(mean, "mixes"), {f"rate_{a}": v for a, v in zip(POOL, TARGET_SHARES)}, TOLERANCE))
