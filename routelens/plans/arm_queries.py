"""Pool screen and subset lattices: many routing arms over one pass of the score matrix."""

from __future__ import annotations

from functools import reduce
from math import factorial

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routelens.config import BETA_GRID
from routelens.functions import expr as E
from routelens.operators import arms as A
from routelens.operators import metrics as M
from routelens.operators import reports as P
from routelens.operators import routing as R
from routelens.operators import splits as S
from routelens.operators.neighbours import nearest_mean
from routelens.operators.ordered import quantiles
from routelens.plans.metric_queries import rounded
from routelens.plans.policy_queries import EPS, _SIDES, sides, sql
from routelens.plans.registry import query
from routelens.sources.files import settled
from routelens.plans.views import BANK, IDS, POOL, long_to_wide, scores, scores_sql, table, u_sql, with_sql

SEEDS = (17, 23)
LEAST_SHARE = 0.05
TOP_POOLS = 20
ROTATIONS = 10
FIELDS = ("score", "available", "latency_ms", "cal")
NAMES = tuple(sorted(BANK))
POOLS = A.pools_of(NAMES, 3, 0b11)
PRIOR = 5.0


def bank_rows(spark, sf):
    """The training side of the score matrix of the whole bank, as arrays."""
    w = long_to_wide(scores(spark, sf, BANK), IDS, FIELDS, NAMES).filter("role = 'train'")
    bins = [F.coalesce("dataset_key", F.lit("")), F.col("feature_latency_ms") >= 2.0]
    return settled(A.matrix(w, NAMES, bins, ["episode_key", "content_doc_key", "dataset_key", "label_supported"]), "bank")


def seeded(rows):
    """A copy of the rows per seed, with its fit / val sides; groups never straddle."""
    out = []
    for seed in SEEDS:
        held = S.holdout_groups(rows, seed)
        j = rows.join(held, "content_doc_key").withColumn("side", F.when(F.col("held"), "val").otherwise("fit"))
        out.append(j.drop("held").withColumn("seed", F.lit(seed).cast("bigint")))
    return reduce(lambda a, b: a.unionByName(b), out)


def validation_runs(rows, arms):
    """The validation row of every (seed, arm) at its chosen discount."""
    led = A.arms_ledger(rows, ["seed"], arms, len(NAMES), 2, BETA_GRID, settle=settled)
    s = settled(A.summary(led.filter("side = 'val'"), ["seed", "arm", "beta"], 3), "arm-summary")
    return settled(s.join(A.chosen_discounts(s, ["seed", "arm"], EPS), ["seed", "arm", "beta"]), "arm-runs")


def fixed_reference(rows):
    """Validation AUROC and latency of every verifier on its own, averaged over the seeds."""
    x = rows.filter("side = 'val'").select("seed", "y", F.explode(F.arrays_zip(F.lit(list(NAMES)).alias("verifier"), F.col("cal").alias("p"), "ms")).alias("v")).select("seed", "y", "v.*")
    per = M.auroc(x, ["seed", "verifier"]).join(x.groupBy("seed", "verifier").agg(F.avg("ms").alias("ms")), ["seed", "verifier"])
    return settled(per.groupBy("verifier").agg(F.avg("auroc").alias("auroc"), F.avg("ms").alias("ms")), "fixed-verifiers")


def _screen(spark, sf):
    rows = settled(seeded(bank_rows(spark, sf)), "screen-rows")  # read by the heads, the costs, the cells and the evaluation
    return A.screened(validation_runs(rows, POOLS), fixed_reference(rows), POOLS, LEAST_SHARE)


# ------------------------------------------------------------------------------------ SQL mirror

_AREA = """SELECT {k}, CASE WHEN sum(pos)>0 AND sum(neg)>0 THEN sum(pos*(below+neg/2.0::double))/(sum(pos)*sum(neg)) END AS auroc FROM (
 SELECT *, coalesce(sum(neg) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::double AS below
 FROM (SELECT {k}, p, sum(y)::double AS pos, sum(1-y)::double AS neg FROM {t} WHERE p IS NOT NULL GROUP BY ALL)) GROUP BY {k}"""
_LIST = ",".join(f"'{v}'" for v in NAMES)
_POS = "row_number() OVER (PARTITION BY seed, d, yy ORDER BY {u}, g)-1"
_SEEDED = "(VALUES " + ",".join(f"({s})" for s in SEEDS) + ") s(seed)"
_BANK = [
    scores_sql(BANK),
    """bank AS (SELECT episode_key, any_value(dataset_key) AS dataset_key, any_value(content_doc_key) AS g, any_value(label_supported) AS y, any_value(feature_latency_ms) AS f, list(cal ORDER BY verifier) AS c,
 list(available ORDER BY verifier) AS a, list(latency_ms ORDER BY verifier) AS l, list(CASE WHEN label_supported=1 THEN cal ELSE 1-cal END ORDER BY verifier) AS q,
 coalesce(any_value(dataset_key),'')||(any_value(feature_latency_ms)>=2) AS cell FROM scores WHERE role='train' GROUP BY episode_key)""",
    "bank_strata AS (SELECT g, min(dataset_key) AS d, round_even(avg(y::double),0)::int AS yy FROM bank GROUP BY 1)",
]
_SEED_SIDES = [
    f"held AS (SELECT seed, g, idx < greatest(round_even(n*0.2::double,0),1) AS held FROM (SELECT seed, g, {_POS.format(u=u_sql(chr(39) + 'split' + chr(39), 'seed', 'g'))} AS idx, count(*) OVER (PARTITION BY seed, d, yy) AS n FROM bank_strata, {_SEEDED}))",
    "runs AS (SELECT b.*, h.seed, 0 AS rot, CASE WHEN h.held THEN 'val' ELSE 'fit' END AS side FROM bank b JOIN held h USING (g))",
]
_POOLS = f"""pools AS (SELECT [{_LIST}] AS names, a.i AS i0, b.i AS i1, c.i AS i2, names[a.i]||'+'||names[b.i]||'+'||names[c.i] AS arm FROM range(1,{len(NAMES) + 1}) a(i), range(1,{len(NAMES) + 1}) b(i), range(1,{len(NAMES) + 1}) c(i) WHERE a.i<b.i AND b.i<c.i)"""
_GRID = "(VALUES " + ",".join(f"({b}::double)" for b in BETA_GRID) + ") bg(beta)"


def _routes(pools: str, runs: str, t: str) -> list[str]:
    """Heads, prices, routes and the chosen discount of every pool of ``pools`` in every run of ``runs``; ``t`` tells the names of two uses apart."""
    best = "greatest(q[i0],q[i1],q[i2])"
    pick = lambda x: f"CASE sel WHEN 0 THEN {x}[i0] WHEN 1 THEN {x}[i1] WHEN 2 THEN {x}[i2]"
    return [
        f"heads{t} AS (SELECT seed, rot, arm, cell, avg(y::double) AS rate, " + ", ".join(f"avg(1+(q[i{j}]-{best})) FILTER (a[i{j}]) AS h{j}" for j in range(3)) + f" FROM {runs}, {pools} WHERE side='fit' GROUP BY ALL)",
        f"price{t} AS (SELECT seed, rot, [" + ", ".join(f"avg(l[{i}]) FILTER (a[{i}])" for i in range(1, len(NAMES) + 1)) + f"] AS k FROM {runs} WHERE side='fit' GROUP BY ALL)",
        f"worth{t} AS (SELECT r.seed, r.rot, r.side, p.arm, beta, r.y, r.f, r.c, r.l, i0, i1, i2, coalesce(rate,0.5::double) AS rate, " + ", ".join(
            f"CASE WHEN a[i{j}] THEN coalesce(h{j},0.5::double)*exp(-beta*k[i{j}]/greatest(k[i0],k[i1],k[i2])) END AS u{j}" for j in range(3)) + f"""
 FROM {runs} r JOIN price{t} USING (seed, rot), {pools} p LEFT JOIN heads{t} h ON h.seed=r.seed AND h.rot=r.rot AND h.arm=p.arm AND h.cell=r.cell, {_GRID} WHERE side<>'fit')""",
        f"routes{t} AS (SELECT *, {pick('c')} ELSE rate END AS p, f+{pick('l')} ELSE 0 END AS ms FROM (SELECT *, CASE WHEN u0=greatest(u0,u1,u2) THEN 0 WHEN u1=greatest(u0,u1,u2) THEN 1 WHEN u2=greatest(u0,u1,u2) THEN 2 END AS sel FROM worth{t}))",
        f"ledger{t} AS (SELECT * FROM (" + _AREA.format(k="seed, rot, arm, beta", t=f"(SELECT * FROM routes{t} WHERE side='val')") + ") JOIN (SELECT seed, rot, arm, beta, avg(ms) AS ms, " + ", ".join(
            f"avg(coalesce(sel={j},false)::int) AS sh{j}" for j in range(3)) + f" FROM routes{t} WHERE side='val' GROUP BY ALL) USING (seed, rot, arm, beta))",
        f"chosen{t} AS (SELECT * EXCLUDE (best) FROM (SELECT *, max(auroc) OVER (PARTITION BY seed, rot, arm) AS best FROM ledger{t}) WHERE round(auroc,12)>=round(best-{EPS}::double,12) QUALIFY row_number() OVER (PARTITION BY seed, rot, arm ORDER BY round(ms,9), beta)=1)",
    ]


def _rank(value: str, within: str = "") -> str:
    part = f"PARTITION BY {within}" if within else ""
    same = f"PARTITION BY {within}, {value}" if within else f"PARTITION BY {value}"
    return f"floor(rank() OVER ({part} ORDER BY {value} DESC)+(count(*) OVER ({same})-1)/2.0)::bigint"


_SCREENED = [
    *_BANK, *_SEED_SIDES, _POOLS, *_routes("pools", "runs", "_b"),
    f"each_one AS (SELECT seed, [{_LIST}][v] AS verifier, y, c[v] AS p, l[v] AS ms FROM runs, range(1,{len(NAMES) + 1}) n(v) WHERE side='val')",
    "fixed AS (SELECT verifier, avg(auroc) AS auroc, avg(ms) AS ms FROM (" + _AREA.format(k="seed, verifier", t="each_one") + ") JOIN (SELECT seed, verifier, avg(ms) AS ms FROM each_one GROUP BY ALL) USING (seed, verifier) GROUP BY 1)",
    "modes AS (SELECT arm, arg_max(beta, (n, -beta)) AS beta_mode FROM (SELECT arm, beta, count(*) AS n FROM chosen_b GROUP BY ALL) GROUP BY arm)",
    "pooled AS (SELECT arm, any_value(beta_mode) AS beta_mode, avg(auroc) AS val_auroc, stddev_pop(auroc) AS sd, avg(ms) AS val_ms, avg(sh0) AS share0, avg(sh1) AS share1, avg(sh2) AS share2, least(avg(sh0),avg(sh1),avg(sh2)) AS min_share FROM chosen_b JOIN modes USING (arm) GROUP BY arm)",
    f"judged AS (SELECT p.*, n_dominating, n_dominating=0 AND min_share>={LEAST_SHARE}::double AS eligible FROM pooled p JOIN (SELECT arm, count(*) FILTER (f.auroc>o.val_auroc AND f.ms<o.val_ms) AS n_dominating FROM pooled o, fixed f GROUP BY arm) USING (arm))",
    f"screen AS (SELECT *, {_rank('round(val_auroc,12)')} AS rank_by_auroc, CASE WHEN eligible THEN {_rank('round(val_auroc,12)', 'eligible')} END AS rank_among_eligible FROM judged)",
]


@query("pool_screen", "X12 W3 W9", with_sql("""
SELECT arm, round(val_auroc,6) AS val_auroc, round(sd,6) AS sd, round(val_ms,6) AS val_ms, round(share0,6) AS share0, round(share1,6) AS share1, round(share2,6) AS share2, round(min_share,6) AS min_share,
 n_dominating, beta_mode, eligible, rank_by_auroc, rank_among_eligible FROM screen""", "episodes", *_SCREENED))
def pool_screen(spark, sf):
    """Every pool of three out of the bank, routed on validation rows of two seeds: quality, cost, shares, who dominates it, ranks."""
    return rounded(_screen(spark, sf))


IN_USE = "+".join(sorted(POOL))
_TOP = [
    f"top AS (SELECT arm FROM screen WHERE arm='{IN_USE}' OR (eligible AND arm IN (SELECT arm FROM screen WHERE eligible ORDER BY round(val_auroc,12) DESC, arm LIMIT {TOP_POOLS})))",
    "top_pools AS (SELECT * FROM pools JOIN top USING (arm))",
    f"bank_folds AS (SELECT g, (row_number() OVER (PARTITION BY d, yy ORDER BY {u_sql(chr(39) + 'fold' + chr(39), chr(39) + str(SEEDS[0]) + chr(39), 'g')}, g)-1)%{ROTATIONS} AS fold FROM bank_strata)",
    f"turns AS (SELECT b.*, {SEEDS[0]} AS seed, rot, CASE (fold-rot+{ROTATIONS})%{ROTATIONS} WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'fit' END AS side FROM bank b JOIN bank_folds USING (g), range({ROTATIONS}) t(rot))",
    *_routes("top_pools", "turns", "_a"),
    "held_out AS (SELECT r.* FROM routes_a r JOIN chosen_a c ON r.rot=c.rot AND r.arm=c.arm AND r.beta=c.beta WHERE r.side='test')",
    "a_side AS (SELECT * FROM (" + _AREA.format(k="arm", t="held_out") + ") JOIN (SELECT arm, avg(ms) AS ms, count(*) AS n FROM held_out GROUP BY 1) USING (arm))",
    "confirmed AS (SELECT a.arm, s.val_auroc AS b_val_auroc, s.val_ms AS b_val_ms, min_share, a.auroc AS a_val_auroc, a.ms AS a_val_ms, a.n AS n_rows, (a.auroc+s.val_auroc)/2 AS joint_auroc FROM a_side a JOIN screen s USING (arm))",
]


@query("pool_confirmation", "X12 F4 W3", with_sql(f"""
SELECT arm, round(b_val_auroc,6) AS b_val_auroc, round(b_val_ms,6) AS b_val_ms, round(min_share,6) AS min_share, round(a_val_auroc,6) AS a_val_auroc, round(a_val_ms,6) AS a_val_ms, n_rows, round(joint_auroc,6) AS joint_auroc,
 {_rank('round(a_val_auroc,12)')} AS rank_a, {_rank('round(joint_auroc,12)')} AS rank_joint, arm='{IN_USE}' AS in_use FROM confirmed""", "episodes", *_SCREENED, *_TOP))
def pool_confirmation(spark, sf):
    """The best eligible pools and the one in use, again by rotations of group folds: out-of-fold quality and the joint rank."""
    screen = settled(_screen(spark, sf), "screen")
    best = screen.filter("eligible").orderBy(F.round("val_auroc", 12).desc(), "arm").limit(TOP_POOLS)  # the feature: a short list
    names = {r[0] for r in best.select("arm").collect()} | {IN_USE}
    arms = [p for p in POOLS if p.name in names]
    rows = bank_rows(spark, sf)
    gap = F.pmod(F.col("fold") - F.col("rot"), F.lit(ROTATIONS))
    turned = rows.join(S.fold_groups(rows, SEEDS[0], ROTATIONS), "content_doc_key").withColumn("rot", F.explode(F.sequence(F.lit(0), F.lit(ROTATIONS - 1))))
    turned = settled(turned.withColumn("side", F.when(gap == 0, "test").when(gap == 1, "val").otherwise("fit")).drop("fold"), "turned-rows")
    out = A.summary(A.tested_arms(turned, ["rot"], arms, len(NAMES), 2, BETA_GRID, EPS, settle=settled), ["arm"], 3)
    out = out.select("arm", F.col("auroc").alias("a_val_auroc"), F.col("mean_ms").alias("a_val_ms"), "n_rows")
    j = out.join(screen.select("arm", F.col("val_auroc").alias("b_val_auroc"), F.col("val_ms").alias("b_val_ms"), "min_share"), "arm")
    j = j.withColumn("joint_auroc", (F.col("a_val_auroc") + F.col("b_val_auroc")) / 2).withColumn("ra", F.round("a_val_auroc", 12)).withColumn("rj", F.round("joint_auroc", 12))
    return rounded(j.withColumn("rank_a", A.average_rank("ra")).withColumn("rank_joint", A.average_rank("rj")).withColumn("in_use", F.col("arm") == IN_USE).drop("ra", "rj"))


# ------------------------------------------------------------------------------------ subset lattices

# text statistics of a document, as (name, counted pattern); the first two are lengths
COUNTED = {"years": "(19|20)[0-9]{2}", "numbers": "[0-9]+", "capitals": "[A-Z]", "marks": "[!?;:]"}
TEXT_FEATURES = ("chars", "lines", *COUNTED)


def text_features(spark, sf):
    """(content_doc_key, six statistics) of every document; equal contents share the largest."""
    t = F.coalesce("text", F.lit(""))
    d = table(spark, sf, "documents").select(
        F.sha2(F.lower(F.trim("text")), 256).alias("content_doc_key"), F.length(t).cast("double").alias("chars"), F.size(F.split(t, "\n")).cast("double").alias("lines"),
        *[(F.regexp_count(t, F.lit(p)) / F.greatest(F.length(t), F.lit(1))).alias(n) for n, p in COUNTED.items()])
    return d.groupBy("content_doc_key").agg(*[F.max(f).alias(f) for f in TEXT_FEATURES])


def lattice_rows(spark, sf):
    """The score matrix with every feature in one of three bins, cut at the thirds of the fit side."""
    x = settled(sides(spark, sf).join(text_features(spark, sf), "content_doc_key"), "featured-rows")
    long = x.filter("side = 'fit'").select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in TEXT_FEATURES])).alias("v")).select("v.*")
    cuts = {r["feature"]: (r["lo"], r["hi"]) for r in quantiles(long, ["feature"], "value", (1 / 3, 2 / 3), names=("lo", "hi")).collect()}  # one row a feature
    bins = []
    for f in TEXT_FEATURES:
        at = cuts.get(f, (0.0, 0.0))
        bins.append(reduce(lambda a, b: a + b, [(F.round(f, 9) > F.lit(round(c, 9))).cast("int") for c in at]))
    return A.matrix(x, POOL, bins, ["episode_key", "side"]).withColumn("run", F.lit(0))


def lattice_table(spark, sf):
    """Test quality and cost of all 64 feature subsets and all 8 pool subsets, as (kind, mask) rows."""
    arms = A.lattice_of(POOL, TEXT_FEATURES)
    rows = settled(lattice_rows(spark, sf), "lattice-rows")
    tests = A.tested_arms(rows, ["run"], arms, len(POOL), len(TEXT_FEATURES), BETA_GRID, EPS, PRIOR, settle=settled)
    out = A.summary(tests, ["arm", "beta"], len(POOL))
    return out.select(F.substring_index("arm", ":", 1).alias("kind"), F.substring_index("arm", ":", -1).cast("int").alias("mask"), "beta", "n_rows", "uncovered", "auroc", "mean_ms")


_BINNED = [
    *_SIDES,
    "text_stats AS (SELECT content_doc_key, max(chars) AS chars, max(lines) AS lines, " + ", ".join(f"max({n}) AS {n}" for n in COUNTED) + """ FROM (
 SELECT sha256(lower(trim(text))) AS content_doc_key, length(coalesce(text,''))::double AS chars, len(string_split(coalesce(text,''), chr(10)))::double AS lines, """ + ", ".join(
        f"len(regexp_extract_all(coalesce(text,''),'{p}'))/greatest(length(coalesce(text,'')),1)::double AS {n}" for n, p in COUNTED.items()) + " FROM documents) GROUP BY 1)",
    "lat_rows AS (SELECT s.*, " + ", ".join(TEXT_FEATURES) + " FROM sides s JOIN text_stats USING (content_doc_key))",
    "text_cuts AS (SELECT " + ", ".join(f"quantile_cont({f}, [{1 / 3!r}::double, {2 / 3!r}::double]) AS x_{f}" for f in TEXT_FEATURES) + " FROM lat_rows WHERE side='fit')",
    "binned AS (SELECT r.*, [" + ", ".join(f"((round({f},9)>round(x_{f}[1],9))::int+(round({f},9)>round(x_{f}[2],9))::int)::varchar" for f in TEXT_FEATURES) + "] AS bins FROM lat_rows r, text_cuts)",
    f"""lat_arms AS (SELECT 'feat' AS kind, m::int AS mask, m::int AS fm, {(1 << len(POOL)) - 1} AS pm FROM range({1 << len(TEXT_FEATURES)}) t(m) UNION ALL SELECT 'pool', m::int, {(1 << len(TEXT_FEATURES)) - 1}, m::int FROM range({1 << len(POOL)}) t(m))""",
    "seen AS (SELECT r.*, kind, mask, pm, concat_ws('|', " + ", ".join(f"CASE WHEN fm&{1 << i}>0 THEN bins[{i + 1}] ELSE '*' END" for i in range(len(TEXT_FEATURES))) + ") AS cell, greatest(" + ", ".join(
        f"CASE WHEN pm&{1 << i}>0 THEN q{i} END" for i in range(3)) + ") AS qbest FROM binned r, lat_arms)",
    "lat_sums AS (SELECT kind, mask, cell, sum(label_supported)::double AS sr, count(*) AS nr, " + ", ".join(
        f"sum(1+(q{i}-qbest)) FILTER (pm&{1 << i}>0 AND a{i}) AS s{i}, count(*) FILTER (pm&{1 << i}>0 AND a{i}) AS n{i}" for i in range(3)) + " FROM seen WHERE side='fit' GROUP BY ALL)",
    "lat_heads AS (SELECT kind, mask, cell, " + ", ".join(
        f"(coalesce(s{i},0)+{PRIOR}::double*coalesce(sum(s{i}) OVER w/nullif(sum(n{i}) OVER w,0),0.5::double))/(n{i}+{PRIOR}::double) AS h{i}" for i in ("r", 0, 1, 2)) + " FROM lat_sums WINDOW w AS (PARTITION BY kind, mask))",
    "lat_price AS (SELECT " + ", ".join(f"avg(l{i}) FILTER (a{i}) AS k{i}" for i in range(3)) + " FROM binned WHERE side='fit')",
    "lat_top AS (SELECT kind, mask, greatest(" + ", ".join(f"CASE WHEN pm&{1 << i}>0 THEN k{i} END" for i in range(3)) + ") AS kmax FROM lat_arms, lat_price)",
    "lat_worth AS (SELECT s.*, beta, coalesce(hr,0.5::double) AS rate, " + ", ".join(f"CASE WHEN pm&{1 << i}>0 AND a{i} THEN coalesce(h{i},0.5::double)*exp(-beta*k{i}/kmax) END AS u{i}" for i in range(3)) + f"""
 FROM seen s JOIN lat_top USING (kind, mask) LEFT JOIN lat_heads USING (kind, mask, cell), lat_price, {_GRID} WHERE side<>'fit')""",
    "lat_routes AS (SELECT *, CASE sel WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE rate END AS p, label_supported AS y, feature_latency_ms+CASE sel WHEN 0 THEN l0 WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE 0 END AS ms FROM (SELECT *, CASE WHEN u0=greatest(u0,u1,u2) THEN 0 WHEN u1=greatest(u0,u1,u2) THEN 1 WHEN u2=greatest(u0,u1,u2) THEN 2 END AS sel FROM lat_worth))",
    "lat_ledger AS (SELECT * FROM (" + _AREA.format(k="kind, mask, beta", t="(SELECT * FROM lat_routes WHERE side='val')") + ") JOIN (SELECT kind, mask, beta, avg(ms) AS ms FROM lat_routes WHERE side='val' GROUP BY ALL) USING (kind, mask, beta))",
    f"lat_beta AS (SELECT kind, mask, beta FROM (SELECT *, max(auroc) OVER (PARTITION BY kind, mask) AS best FROM lat_ledger) WHERE round(auroc,12)>=round(best-{EPS}::double,12) QUALIFY row_number() OVER (PARTITION BY kind, mask ORDER BY round(ms,9), beta)=1)",
    "lat_test AS (SELECT * FROM lat_routes JOIN lat_beta USING (kind, mask, beta) WHERE side='test')",
    "lattices AS (SELECT * FROM (" + _AREA.format(k="kind, mask, beta", t="lat_test") + ") JOIN (SELECT kind, mask, beta, count(*) AS n_rows, count(*) FILTER (sel IS NULL) AS uncovered, avg(ms) AS mean_ms FROM lat_test GROUP BY ALL) USING (kind, mask, beta))",
]


@query("feature_and_pool_lattice", "X7", sql("SELECT kind, mask::bigint AS mask, beta, n_rows, uncovered, round(auroc,6) AS auroc, round(mean_ms,6) AS mean_ms FROM lattices", *_BINNED))
def feature_and_pool_lattice(spark, sf):
    return rounded(lattice_table(spark, sf))


def _shapley_sql(kind: str, items: tuple[str, ...]) -> str:
    n = len(items)
    weight = "CASE bit_count(a.mask) " + " ".join(f"WHEN {k} THEN {factorial(k) * factorial(n - k - 1) / factorial(n)!r}::double" for k in range(n)) + " END"
    full = (1 << n) - 1
    return f"""SELECT '{kind}' AS kind, it AS item, sum(({weight})*(b.auroc-a.auroc)) AS sh, max(b.auroc) FILTER (a.mask=0) AS solo, max(a.auroc) FILTER (b.mask={full}) AS loo,
 any_value((SELECT max(auroc) FILTER (mask={full})-max(auroc) FILTER (mask=0) FROM lattices WHERE kind='{kind}')) AS whole
 FROM (SELECT * FROM lattices WHERE kind='{kind}') a JOIN (VALUES {",".join(f"('{f}',{1 << i})" for i, f in enumerate(items))}) x(it,bit) ON a.mask&bit=0 JOIN (SELECT * FROM lattices WHERE kind='{kind}') b ON b.mask=a.mask|bit GROUP BY it"""


@query("lattice_shapley", "X7 X8", sql(f"""
SELECT kind, item, round(sh,6) AS shapley, round(solo,6) AS solo, round(loo,6) AS leave_one_out, abs(sum(sh) OVER (PARTITION BY kind)-whole)<1e-9::double AS efficient FROM ({_shapley_sql('feat', TEXT_FEATURES)} UNION ALL {_shapley_sql('pool', POOL)})""", *_BINNED))
def lattice_shapley(spark, sf):
    """What each feature and each verifier adds to the test AUROC, over all subsets; the parts must add up to the whole."""
    t = settled(lattice_table(spark, sf), "lattice")
    out = []
    for kind, items in (("feat", TEXT_FEATURES), ("pool", POOL)):
        one, full = t.filter(F.col("kind") == kind), (1 << len(items)) - 1
        ends = one.agg(F.max(F.when(F.col("mask") == full, F.col("auroc"))), F.max(F.when(F.col("mask") == 0, F.col("auroc")))).first()
        gap = F.abs(F.sum("shapley").over(W.partitionBy(F.lit(1))) - F.lit(ends[0] - ends[1]))  # one row an item
        out.append(P.shapley(one, items, value="auroc").drop("share").withColumn("efficient", gap < 1e-9).withColumn("kind", F.lit(kind)))
    return rounded(out[0].unionByName(out[1]))


# ------------------------------------------------------------------------------------ nearest-neighbour heads

NEIGHBOURS = 25


@query("knn_router", "H4 X11", sql("""
SELECT 'knn' AS system, any_value(knn_test.beta) AS beta, count(*) AS n_rows, round(any_value(auroc),6) AS auroc, round(avg(ms),6) AS mean_ms, round(avg(((p>=0.5::double)=(y=1))::int),6) AS acc FROM knn_test, (""" + _AREA.format(k="beta", t="knn_test") + """) au WHERE au.beta=knn_test.beta""", *_BINNED[:5],
    "knn_train AS (SELECT episode_key, " + ", ".join(TEXT_FEATURES) + ", unnest([0,1,2]) AS act, unnest([a0,a1,a2]) AS a, unnest([" + ", ".join(f"1+(q{i}-greatest(q0,q1,q2))" for i in range(3)) + "]) AS t FROM lat_rows WHERE side='fit')",
    "knn_near AS (SELECT q.episode_key, act, t, sqrt(" + "+".join(f"(q.{f}-n.{f})*(q.{f}-n.{f})" for f in TEXT_FEATURES) + f") AS dist FROM lat_rows q, knn_train n WHERE q.side<>'fit' AND n.a QUALIFY row_number() OVER (PARTITION BY q.episode_key, act ORDER BY dist, n.episode_key)<={NEIGHBOURS})",
    "knn_heads AS (SELECT episode_key, " + ", ".join(f"max(h) FILTER (act={i}) AS h{i}" for i in range(3)) + " FROM (SELECT episode_key, act, least(greatest(CASE WHEN min(dist)=0 THEN avg(t) FILTER (dist=0) ELSE sum(t/nullif(dist,0))/sum(1/nullif(dist,0)) END,0),1) AS h FROM knn_near GROUP BY ALL) GROUP BY 1)",
    "knn_price AS (SELECT " + ", ".join(f"avg(l{i}) FILTER (a{i}) AS k{i}" for i in range(3)) + " FROM lat_rows WHERE side='fit')",
    f"""knn_routes AS (SELECT *, CASE sel WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 END AS p, label_supported AS y, feature_latency_ms+CASE sel WHEN 0 THEN l0 WHEN 1 THEN l1 WHEN 2 THEN l2 END AS ms FROM (SELECT *, CASE WHEN u0=greatest(u0,u1,u2) THEN 0 WHEN u1=greatest(u0,u1,u2) THEN 1 WHEN u2=greatest(u0,u1,u2) THEN 2 END AS sel FROM (
 SELECT *, """ + ", ".join(f"CASE WHEN a{i} THEN h{i}*exp(-beta*k{i}/greatest(k0,k1,k2)) END AS u{i}" for i in range(3)) + f""" FROM lat_rows JOIN knn_heads USING (episode_key), knn_price, {_GRID})))""",
    "knn_ledger AS (SELECT * FROM (" + _AREA.format(k="beta", t="(SELECT * FROM knn_routes WHERE side='val')") + ") JOIN (SELECT beta, avg(ms) AS m FROM knn_routes WHERE side='val' GROUP BY 1) USING (beta))",
    f"knn_test AS (SELECT * FROM knn_routes WHERE side='test' AND beta=(SELECT arg_min(beta, (round(m,9), beta)) FROM knn_ledger WHERE round(auroc,12)>=round((SELECT max(auroc) FROM knn_ledger)-{EPS}::double,12)))"))
def knn_router(spark, sf):
    """The router with 25-nearest-neighbour heads, weighted by distance, over the six text statistics."""
    x = settled(sides(spark, sf).join(text_features(spark, sf), "content_doc_key"), "knn-rows")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.col(f"available__{a}").alias("av"), t.alias("target")) for a, t in zip(POOL, R.targets(POOL, "regret"))]))
    train = x.filter("side = 'fit'").select("episode_key", *TEXT_FEATURES, each.alias("e")).select("episode_key", *TEXT_FEATURES, "e.*").filter("av")
    ask = x.filter("side <> 'fit'").select(F.col("episode_key").alias("asked"), *TEXT_FEATURES, F.explode(F.lit(list(POOL))).alias("action"))
    got = nearest_mean(train, ask, ["action"], TEXT_FEATURES, "target", "episode_key", "asked", NEIGHBOURS, settled)
    heads = got.groupBy(F.col("asked").alias("episode_key")).agg(*[F.max(F.when(F.col("action") == a, E.clip(F.col("prediction"), 0.0, 1.0))).alias(f"head__{a}") for a in POOL])
    costs = R.one_row(R.mean_costs(x.filter("side = 'fit'"), POOL), POOL)
    d = settled(x.filter("side <> 'fit'").join(heads, "episode_key"), "knn-heads")
    beta = R.choose_beta(R.beta_ledger(d.filter("side = 'val'"), POOL, costs, BETA_GRID), EPS).first()[0]
    t = R.select_action(d.filter("side = 'test'"), POOL, R.utilities(POOL, costs, F.lit(beta))).withColumn("system", F.lit("knn")).withColumn("ms", F.col("verifier_ms") + F.col("feature_latency_ms"))
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("label_supported")).cast("double")
    g = t.groupBy("system").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("ms").alias("mean_ms"), F.avg(hit).alias("acc"))
    return rounded(g.join(M.auroc(t, ["system"], "p", "label_supported"), "system").withColumn("beta", F.lit(beta)))
