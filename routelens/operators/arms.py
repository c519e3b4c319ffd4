"""Many routing arms over one pass of the rows: verifier pools, feature subsets, or both.

An arm names the verifiers it may call and the features its heads may see. Fitting the arms one after the other reads the
rows once per arm; here a row is read once and meets all arms. Heads are means of the regret target in the cells of binned
features (features an arm does not see are blanked, so its cells merge), added up map-side per (arm, cell). Every choice
then depends on (arm, discount, cell, availability) alone, so choices are tabulated before any evaluation row is
read, discounts that choose alike everywhere are evaluated once, and an evaluation row meets one small table row
that holds the choices of all arms for its cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routelens.functions import expr as E
from routelens.operators import metrics as M


class Arm(NamedTuple):
    """``members``: places of the callable verifiers (none: the heads' own label rate is the answer); ``mask``: bits of the visible features."""

    name: str
    members: tuple[int, ...]
    mask: int


def pools_of(names: Sequence[str], size: int, mask: int) -> list[Arm]:
    """Every pool of ``size`` verifiers."""
    return [Arm("+".join(names[i] for i in p), p, mask) for p in combinations(range(len(names)), size)]


def lattice_of(names: Sequence[str], features: Sequence[str]) -> list[Arm]:
    """All subsets of the features with the whole pool, then all subsets of the pool with all features; named by their bitmask."""
    every, full = tuple(range(len(names))), (1 << len(features)) - 1
    of_features = [Arm(f"feat:{m}", every, m) for m in range(full + 1)]
    return of_features + [Arm(f"pool:{m}", tuple(i for i in every if m >> i & 1), full) for m in range(1 << len(names))]


def _literal(arms: Sequence[Arm], width: int) -> Column:
    none = F.lit(None).cast("int")
    return F.array(*[F.struct(F.lit(a.name).alias("arm"), F.lit(a.mask).alias("mask"), *[(F.lit(a.members[j]) if j < len(a.members) else none).alias(f"m{j}") for j in range(width)]) for a in arms])


def _cell(features: int, mask: Column) -> Column:
    """The bins an arm sees, in one text; the others are blanked."""
    seen = [F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.coalesce(F.get("bins", F.lit(i)), F.lit("∅"))).otherwise(F.lit("*")) for i in range(features)]
    return F.concat_ws("|", *seen)


def matrix(rows: DataFrame, verifiers: Sequence[str], bins: Sequence[Column], keep: Sequence[str], label="label_supported", feature_ms="feature_latency_ms") -> DataFrame:
    """(keep, y, feature_ms, bins, cal, av, ms) from a wide score matrix: one array per field, in the order of ``verifiers``."""
    of = lambda field, default: F.array(*[F.coalesce(f"{field}__{v}", F.lit(default)) for v in verifiers])
    return rows.select(
        *keep, F.col(label).alias("y"), F.col(feature_ms).alias("feature_ms"), F.array(*[b.cast("string") for b in bins]).alias("bins"),
        of("cal", 0.5).alias("cal"), of("available", False).alias("av"), of("latency_ms", 0.0).alias("ms"),
    )


def fit_arms(fit: DataFrame, keys: Sequence[str], arms: Sequence[Arm], features: int, prior: float = 0.0) -> DataFrame:
    """(keys, arm, cell, h0.., rate): head values of every arm in every cell.

    ``prior`` rows at the arm's overall mean are mixed into each cell, as a smallest leaf would do.
    """
    width = max(len(a.members) for a in arms)
    x = fit.select(*keys, "y", "bins", "cal", "av", F.explode(_literal(arms, width)).alias("a")).select("*", "a.*")
    right = [F.when(F.col("y") == 1, F.get("cal", F.col(f"m{j}"))).otherwise(1 - F.get("cal", F.col(f"m{j}"))) for j in range(width)]
    best = reduce(lambda a, b: F.greatest(a, b), right) if width > 1 else right[0]
    sums = [F.sum("y").cast("double").alias("s_rate"), F.count("y").alias("n_rate")]
    for j in range(width):
        target = F.when(F.get("av", F.col(f"m{j}")), 1 + (right[j] - best))
        sums += [F.sum(target).alias(f"s{j}"), F.count(target).alias(f"n{j}")]
    t = x.groupBy(*keys, "arm", _cell(features, F.col("mask")).alias("cell")).agg(*sums)
    whole = W.partitionBy(*keys, "arm")  # the cells of an arm: a product of bins, not rows

    def head(s: str, n: str) -> Column:
        mean = F.coalesce(F.sum(s).over(whole) / F.sum(n).over(whole), F.lit(0.5))
        total = F.col(n) + F.lit(float(prior))
        return F.when(total > 0, (F.coalesce(s, F.lit(0.0)) + F.lit(float(prior)) * mean) / total).otherwise(0.5)

    return t.select(*keys, "arm", "cell", *[head(f"s{j}", f"n{j}").alias(f"h{j}") for j in range(width)], head("s_rate", "n_rate").alias("rate"))


def choices(rows: DataFrame, heads: DataFrame, keys: Sequence[str], arms: Sequence[Arm], verifiers: int, features: int, grid: Sequence[float]) -> DataFrame:
    """(keys, bins, plan): for every cell that occurs, the choice of every arm at every discount that matters.

    An entry of the plan holds the arm, its members, the smallest discount of those that choose alike in all cells, and
    ``sels``: the chosen member for each pattern of available members (bit j: member j is available).
    """
    width = max(len(a.members) for a in arms)
    price = [F.avg(F.when(F.get("av", F.lit(i)), F.get("ms", F.lit(i)))) for i in range(verifiers)]
    costs = rows.filter("side = 'fit'").groupBy(*keys).agg(F.array(*price).alias("costs"))
    cells = rows.select(*keys, "bins").distinct().select(*keys, "bins", F.explode(_literal(arms, width)).alias("a")).select(*keys, "bins", "a.*")
    x = cells.withColumn("cell", _cell(features, F.col("mask"))).join(heads, [*keys, "arm", "cell"], "left").join(costs, [*keys])
    x = x.withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in grid])))
    k = [F.get("costs", F.col(f"m{j}")) for j in range(width)]
    top = E.row_max(k)
    worth = [F.coalesce(f"h{j}", F.lit(0.5)) * F.when(top > 0, F.exp(-F.col("beta") * k[j] / top)).otherwise(1.0) for j in range(width)]
    x = x.withColumns({f"u{j}": F.when(F.col(f"m{j}").isNotNull(), w) for j, w in enumerate(worth)})
    u = [F.col(f"u{j}") for j in range(width)]
    sels = [F.lit(None).cast("int")] + [E.first_argmax(u, [F.lit(bool(p >> j & 1)) for j in range(width)]) for p in range(1, 1 << width)]
    x = x.select(*keys, "bins", "arm", *[f"m{j}" for j in range(width)], "beta", F.coalesce("rate", F.lit(0.5)).alias("rate"), F.array(*sels).alias("sels"))
    alike = x.groupBy(*keys, "arm", "beta").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("bins", "sels")))), 256).alias("policy"))
    first = alike.groupBy(*keys, "arm", "policy").agg(F.min("beta").alias("beta")).drop("policy")
    entry = F.struct("arm", *[f"m{j}" for j in range(width)], "beta", "rate", "sels")
    return x.join(first, [*keys, "arm", "beta"]).groupBy(*keys, "bins").agg(F.collect_list(entry).alias("plan"))


def arm_ledger(rows: DataFrame, plan: DataFrame, keys: Sequence[str], arms: Sequence[Arm], digits: int | None = None) -> DataFrame:
    """(keys, side, arm, beta, score, pos, neg, ms, c0..): one row a distinct probability, with its cost and the calls of each member.

    A row without any available member is answered by the label rate of its cell and calls nobody. ``digits`` rounds the scores, which bounds the ledger of
    an arm however many rows there are; the area under the curve is then that of the rounded scores.
    """
    width = max(len(a.members) for a in arms)
    x = rows.filter("side <> 'fit'").join(plan, [*keys, "bins"]).select(*keys, "side", "y", "feature_ms", "cal", "av", "ms", F.explode("plan").alias("a")).select("*", "a.*")
    free = reduce(lambda a, b: a + b, [F.when(F.get("av", F.col(f"m{j}")), F.lit(1 << j)).otherwise(0) for j in range(width)])
    x = x.withColumn("sel", F.get("sels", free))
    member = E.pick([F.col(f"m{j}") for j in range(width)], F.col("sel"))
    x = x.withColumn("member", member)
    p = F.when(F.col("sel").isNotNull(), F.get("cal", F.col("member"))).otherwise(F.col("rate"))
    spent = F.col("feature_ms") + F.when(F.col("sel").isNotNull(), F.get("ms", F.col("member"))).otherwise(0.0)
    score = p if digits is None else F.round(p, digits)
    return x.groupBy(*keys, "side", "arm", "beta", score.alias("score")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), F.sum(spent).alias("ms"), *[F.count_if(F.col("sel") == j).alias(f"c{j}") for j in range(width)]
    )


def summary(ledger: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """(keys, n_rows, uncovered, mean_ms, share0.., auroc): what the ledger says of each key; no row is left out."""
    n = F.sum(F.col("pos") + F.col("neg"))
    calls = [F.sum(f"c{j}") for j in range(width)]
    s = ledger.groupBy(*keys).agg(
        n.alias("n_rows"), (n - reduce(lambda a, b: a + b, calls)).alias("uncovered"), (F.sum("ms") / n).alias("mean_ms"), *[(c / n).alias(f"share{j}") for j, c in enumerate(calls)]
    )
    one = ledger.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return s.join(M.auroc_from_ledger(one, keys).drop("n_scored"), list(keys), "left")


def chosen_discounts(on_validation: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """(keys, beta): the cheapest discount whose AUROC is within ``tolerance`` of the best; the smallest one on ties."""
    best = F.max("auroc").over(W.partitionBy(*keys))  # one row a discount
    near = on_validation.withColumn("best", best).filter(F.round("auroc", 12) >= F.round(F.col("best") - F.lit(tolerance), 12))
    return near.groupBy(*keys).agg(F.min_by("beta", F.struct(F.round("mean_ms", 9), "beta")).alias("beta"))


def arms_ledger(
    rows: DataFrame, keys: Sequence[str], arms: Sequence[Arm], verifiers: int, features: int, grid: Sequence[float], prior: float = 0.0, digits: int | None = None,
    settle: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """The whole chain over ``matrix`` rows with a ``side`` (fit / val / test); ``settle`` may write the tables between its steps."""
    heads = settle(fit_arms(rows.filter("side = 'fit'"), keys, arms, features, prior), "arm-heads")
    plan = settle(choices(rows, heads, keys, arms, verifiers, features, grid), "arm-choices")
    return settle(arm_ledger(rows, plan, keys, arms, digits), "arm-ledger")


def tested_arms(
    rows: DataFrame, keys: Sequence[str], arms: Sequence[Arm], verifiers: int, features: int, grid: Sequence[float], tolerance: float, prior: float = 0.0,
    settle: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """The ledger of the test rows of every (keys, arm) at the discount that its validation rows choose.

    All discounts meet the validation rows only: the test rows meet the plan of the chosen ones, one entry an arm.
    """
    width = max(len(a.members) for a in arms)
    heads = settle(fit_arms(rows.filter("side = 'fit'"), keys, arms, features, prior), "arm-heads")
    plan = settle(choices(rows, heads, keys, arms, verifiers, features, grid), "arm-choices")
    on_validation = settle(arm_ledger(rows.filter("side = 'val'"), plan, keys, arms), "arm-ledger")
    beta = settle(chosen_discounts(summary(on_validation, [*keys, "arm", "beta"], width), [*keys, "arm"], tolerance), "arm-discounts")
    entries = plan.select(*keys, "bins", F.explode("plan").alias("entry")).withColumns({"arm": F.col("entry.arm"), "beta": F.col("entry.beta")})
    kept = entries.join(beta, [*keys, "arm", "beta"]).groupBy(*keys, "bins").agg(F.collect_list("entry").alias("plan"))
    return settle(arm_ledger(rows.filter("side = 'test'"), settle(kept, "arm-chosen"), keys, arms), "arm-tests")


def average_rank(value: str, descending: bool = True) -> Column:
    """Averaged rank over the whole (small) table, cut to an integer; null values have none."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    same = F.count(F.lit(1)).over(W.partitionBy(F.lit(1), value))
    return F.when(F.col(value).isNotNull(), F.floor(F.rank().over(W.partitionBy(F.lit(1)).orderBy(order)) + (same - 1) / 2).cast("bigint"))


def screened(runs: DataFrame, fixed: DataFrame, arms: Sequence[Arm], least_share: float) -> DataFrame:
    """One row per pool from its validation rows per run (``arm, seed, beta, auroc, mean_ms, share0..``) and the fixed verifiers.

    A pool is eligible if no fixed verifier (``verifier, auroc, ms``) is both better and faster and each member is called
    in at least ``least_share`` of the rows.
    """
    width = max(len(a.members) for a in arms)
    mode = runs.groupBy("arm", "beta").agg(F.count(F.lit(1)).alias("n")).groupBy("arm").agg(F.max_by("beta", F.struct("n", -F.col("beta"))).alias("beta_mode"))
    pool = runs.groupBy("arm").agg(
        F.avg("auroc").alias("val_auroc"), F.stddev_pop("auroc").alias("sd"), F.avg("mean_ms").alias("val_ms"), *[F.avg(f"share{j}").alias(f"share{j}") for j in range(width)]
    ).withColumn("min_share", E.row_min([F.col(f"share{j}") for j in range(width)]))
    names = [r["verifier"] for r in fixed.select("verifier").collect()]  # one row a verifier
    met = pool.select("arm", "val_auroc", "val_ms", F.explode(F.lit(names)).alias("verifier")).join(fixed, "verifier")
    beaten = met.groupBy("arm").agg(F.count_if((F.col("auroc") > F.col("val_auroc")) & (F.col("ms") < F.col("val_ms"))).alias("n_dominating"))
    d = pool.join(beaten, "arm").join(mode, "arm").withColumn("eligible", (F.col("n_dominating") == 0) & (F.col("min_share") >= least_share))
    d = d.withColumn("among", F.when(F.col("eligible"), F.round("val_auroc", 12))).withColumn("overall", F.round("val_auroc", 12))
    return d.withColumn("rank_by_auroc", average_rank("overall")).withColumn("rank_among_eligible", average_rank("among")).drop("among", "overall")
