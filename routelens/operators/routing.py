"""Supervision targets, cost discounts, routing and competing call policies.

Rows are wide: ``score__a``, ``available__a``, ``latency_ms__a``, ``cal__a`` and ``head__a``
per action. Everything per row is a plain expression over those columns, so a policy adds no
shuffle; only costs, shares and chosen parameters are aggregates: a few numbers, read back by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions import expr as E
from routelens.functions.hashing import uniform
from routelens.operators import metrics as M
from routelens.operators.ordered import quantile_points, running_totals


def cols(prefix: str, pool: Sequence[str]) -> list[Column]:
    return [F.col(f"{prefix}__{a}") for a in pool]


def latencies(pool) -> list[Column]:
    return [F.coalesce(F.col(f"latency_ms__{a}"), F.lit(0.0)) for a in pool]


def one_row(df: DataFrame, pool: Sequence[str]) -> list[Column]:
    """The fitted values of a one-row frame as literals, one per action (like model coefficients)."""
    row = df.select(*pool).first()
    return [F.lit(row[a]) for a in pool]


# ------------------------------------------------------------------------------ targets

def true_class_mass(pool, label="label_supported") -> list[Column]:
    y = F.col(label) == 1
    return [F.when(y, c).otherwise(F.lit(1.0) - c) for c in cols("cal", pool)]


def targets(pool, kind: str, label="label_supported") -> list[Column]:
    """What each action's head should learn."""
    q = true_class_mass(pool, label)
    best = E.row_max(q)
    y = F.col(label).cast("double")
    if kind == "regret":
        return [F.lit(1.0) + (x - best) for x in q]
    if kind == "prob_quality":
        return q
    if kind == "brier":
        return [F.lit(1.0) - (c - y) * (c - y) for c in cols("cal", pool)]
    if kind == "pairwise_rank":
        k = max(len(pool) - 1, 1)
        return [reduce(add, [(x > o).cast("double") for o in q]) / F.lit(float(k)) for x in q]
    if kind == "correctness":
        return [((F.coalesce(s, F.lit(0.5)) >= 0.5).cast("int") == F.col(label)).cast("double") for s in cols("score", pool)]
    if kind == "is_best":
        return [(x >= best - F.lit(1e-12)).cast("double") for x in q]
    raise ValueError(f"unknown target {kind}")


def pairwise_preferences(df: DataFrame, pool, discount: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """One row per valid action pair i < j: which earns the larger discounted reward, and by how much.

    A row takes part if some available action is correct; a pair needs both actions available
    and a reward gap above 1e-12. The number of pairs per row is fixed by the pool.
    """
    ok, av = targets(pool, "correctness"), cols("available", pool)
    reward = [o * d for o, d in zip(ok, discount)]
    valid = reduce(lambda a, b: a | b, [a & (o > 0) for a, o in zip(av, ok)])
    pairs = [
        F.when(av[i] & av[j] & (F.abs(reward[i] - reward[j]) > 1e-12), F.struct(
            F.lit(pool[i]).alias("first"), F.lit(pool[j]).alias("second"),
            (reward[i] > reward[j]).cast("double").alias("target"), F.abs(reward[i] - reward[j]).alias("gap")))
        for i in range(len(pool)) for j in range(i + 1, len(pool))
    ]
    x = df.filter(valid).select(*keys, F.explode(F.array_compact(F.array(*pairs))).alias("p"))
    return x.select(*keys, "p.*")


def cell_heads(fit: DataFrame, pool, cell: Sequence[str], kind="regret") -> DataFrame:
    """A transparent head: the mean target per cell over the rows where the action is available."""
    t, av = targets(pool, kind), cols("available", pool)
    return fit.groupBy(*cell).agg(*[F.avg(F.when(a, x)).alias(f"head__{n}") for n, x, a in zip(pool, t, av)])


# ------------------------------------------------------------------------------ costs and routing

def mean_costs(fit: DataFrame, pool) -> DataFrame:
    """Mean cost over the rows where the action is available: one row, one column per action."""
    return fit.agg(*[F.avg(F.when(F.col(f"available__{a}"), F.col(f"latency_ms__{a}"))).alias(a) for a in pool])


def utilities(pool, costs: Sequence[Column], beta: Column) -> list[Column]:
    return [h * d for h, d in zip(cols("head", pool), E.discounts(beta, costs))]


def select_action(df: DataFrame, pool, utility: Sequence[Column], blocked: Sequence[str] = (), mask: bool = True) -> DataFrame:
    """Masked argmax, first maximum wins. ``blocked`` actions are removed at serving time.

    Adds sel, selected_action, p, verifier_ms. Rows without any allowed action get NULLs and
    are counted by ``uncovered_rows``.
    """
    av = [a & F.lit(n not in blocked) for a, n in zip(cols("available", pool), pool)] if mask else None
    d = df.withColumn("sel", E.first_argmax(utility, av))
    return outcome(d, pool, F.col("sel"))


def outcome(df: DataFrame, pool, sel: Column, p: Column | None = None, ms: Column | None = None) -> DataFrame:
    names = [F.lit(a) for a in pool]
    return df.select(
        "*", E.pick(names, sel).alias("selected_action"),
        (E.pick(cols("cal", pool), sel) if p is None else p).alias("p"),
        (E.pick(latencies(pool), sel) if ms is None else ms).alias("verifier_ms"),
    )


def uncovered_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("sel").isNull()).alias("uncovered"))


def prediction_frame(df: DataFrame, keys: Sequence[str], feature_ms: Column | None = None, label="label_supported") -> DataFrame:
    """Decision, correctness and the latency parts of routed rows."""
    d = (F.col("p") >= 0.5).cast("int")
    f = F.lit(0.0) if feature_ms is None else feature_ms
    return df.select(
        *keys, F.col(label).alias("y"), "selected_action", "p", d.alias("d"), (d == F.col(label)).cast("int").alias("ok"),
        "verifier_ms", f.alias("feature_ms"), (F.col("verifier_ms") + f).alias("ms"),
    )


def beta_ledger(val: DataFrame, pool, costs, grid: Sequence[float], feature_ms="feature_latency_ms") -> DataFrame:
    """AUROC and mean end-to-end cost at every discount strength."""
    x = val.withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in grid])))
    r = select_action(x, pool, utilities(pool, costs, F.col("beta")))
    r = r.withColumn("ms", F.col("verifier_ms") + F.col(feature_ms))
    return M.auroc(r, ["beta"], "p", "label_supported").join(r.groupBy("beta").agg(F.avg("ms").alias("mean_ms")), "beta")


def choose_beta(ledger: DataFrame, tolerance: float) -> DataFrame:
    """Cheapest beta within the tolerance of the best AUROC; the first one on ties."""
    rows = F.collect_list(F.struct("beta", "auroc", "mean_ms"))  # one row per grid value
    x = ledger.agg(rows.alias("r"))
    best = F.array_max(F.transform("r", lambda v: v["auroc"]))
    near = F.filter("r", lambda v: F.round(v["auroc"], 12) >= F.round(best - F.lit(tolerance), 12))
    return x.select(F.array_min(F.transform(near, lambda v: F.struct(F.round(v["mean_ms"], 9).alias("ms"), v["beta"].alias("beta"))))["beta"].alias("beta"))


def action_aurocs(val: DataFrame, pool, label="label_supported") -> dict[str, float]:
    """AUROC of each action's raw score over the rows where it is available; 0.5 for one class."""
    x = val.select(F.col(label).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(a).alias("action"), F.col(f"score__{a}").alias("p"), F.col(f"available__{a}").alias("av")) for a in pool])).alias("s"))
    got = {r["action"]: r["auroc"] for r in M.auroc(x.select("y", "s.*").filter("av"), ["action"]).collect()}  # one row per action
    return {a: 0.5 if got.get(a) is None else got[a] for a in pool}


def choose_beta_product(ledger: DataFrame, aurocs: dict[str, float], costs: dict[str, float]) -> DataFrame:
    """Earlier rule: largest product of quality gain and speed gain, the first beta on ties.

    Both gains are scaled between the cheapest action and the best other action on validation.
    """
    fast = min(costs, key=lambda a: costs[a])
    good = max((a for a in costs if a != fast), key=lambda a: aurocs[a])
    dq, ds = aurocs[good] - aurocs[fast], costs[good] - costs[fast]
    q = F.greatest((F.col("auroc") - aurocs[fast]) / dq, F.lit(0.0)) if dq > 0 else F.lit(None).cast("double")
    s = F.greatest((F.lit(costs[good]) - F.col("mean_ms")) / ds, F.lit(0.0)) if ds > 0 else F.lit(None).cast("double")
    x = ledger.withColumn("gain", F.round(q * s, 12))
    return x.agg(F.coalesce(F.max_by("beta", F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("beta")))), F.min("beta")).alias("beta"), F.max("gain").alias("gain"))


# ------------------------------------------------------------------------------ baselines and controls

def fixed_action(df: DataFrame, pool, action: str) -> DataFrame:
    """Always the same action, else the first available one."""
    return select_action(df, pool, [F.lit(1.0 if a == action else 0.0) for a in pool])


def cheapest_correct(df: DataFrame, pool, costs) -> DataFrame:
    """Oracle: a correct action, the cheapest of them."""
    top = E.row_max(costs)
    ok = targets(pool, "correctness")
    return select_action(df, pool, [o + (top - c) * F.lit(1e-9) for o, c in zip(ok, costs)])


def action_shares(routed: DataFrame, pool) -> DataFrame:
    return routed.agg(*[F.avg((F.col("selected_action") == a).cast("double")).alias(a) for a in pool])


def _drawn(weights: Sequence[Column], u: Column) -> Column:
    """Number of cumulative weights below the draw, at most the last index."""
    out, run = F.lit(0), F.lit(0.0)
    for w in weights:
        run = run + w
        out = out + (u > run).cast("int")
    return F.least(out, F.lit(len(weights) - 1))


def matched_random(df: DataFrame, pool, shares: Sequence[Column], seed, key="episode_key", renormalise=True) -> DataFrame:
    """One random call with the reference's action shares.

    ``renormalise``: shares over the available actions of the row; a row without any takes the first action.
    Otherwise draw first and fall back to the first available action.
    """
    u = uniform("control", seed, F.col(key))
    av = cols("available", pool)
    if renormalise:
        w = [F.when(a, s).otherwise(F.lit(0.0)) for a, s in zip(av, shares)]
        total = reduce(add, w)
        flat = [F.when(a, F.lit(1.0)).otherwise(F.lit(0.0)) for a in av]
        live = reduce(add, flat)
        d = df.select("*", *[F.when(total > 0, x / total).when(live > 0, f / live).otherwise(F.lit(1.0)).alias(f"_w{i}") for i, (x, f) in enumerate(zip(w, flat))])
        sel = _drawn([F.col(f"_w{i}") for i in range(len(pool))], u)
        return outcome(d.withColumn("sel", sel).drop(*[f"_w{i}" for i in range(len(pool))]), pool, F.col("sel"))
    first = E.first_argmax([F.lit(1.0)] * len(pool), av)
    pickd = _drawn(list(shares), u)
    d = df.withColumn("_pick", pickd)
    d = d.withColumn("sel", F.when(E.pick(av, F.col("_pick")), F.col("_pick")).otherwise(first)).drop("_pick")
    return outcome(d, pool, F.col("sel"))


def chain_cost(pool, sel: Column) -> tuple[Column, Column]:
    """Latency and number of the available calls up to and including the selected level."""
    cost, calls = F.lit(0.0), F.lit(0)
    for i, (a, l) in enumerate(zip(cols("available", pool), latencies(pool))):
        use = a & (sel >= i)
        cost = cost + F.when(use, l).otherwise(F.lit(0.0))
        calls = calls + F.when(use, 1).otherwise(0)
    return cost, calls


def confidence_chain(df: DataFrame, chain: Sequence[str], width: float) -> DataFrame:
    """Call the chain in order until a calibrated probability leaves 0.5 by more than ``width``."""
    n = len(chain)
    av, p, lat = cols("available", chain), cols("cal", chain), latencies(chain)
    going, level, cost, calls = F.lit(True), F.lit(n - 1), F.lit(0.0), F.lit(0)
    d = df
    for i in range(n):
        use = going & av[i]
        d = d.select(
            *[c for c in d.columns if not c.startswith("_s_")],
            F.when(use, F.lit(i)).otherwise(level).alias("_s_level"),
            (cost + F.when(use, lat[i]).otherwise(F.lit(0.0))).alias("_s_cost"),
            (calls + F.when(use, 1).otherwise(0)).alias("_s_calls"),
            (going & ~(av[i] & (F.abs(p[i] - 0.5) > width))).alias("_s_going"),
        )
        going, level, cost, calls = (F.col(f"_s_{c}") for c in ("going", "level", "cost", "calls"))
    d = d.withColumn("sel", level).withColumn("calls", calls).withColumn("_cost", cost)
    out = outcome(d, chain, F.col("sel"), ms=F.col("_cost"))
    return out.drop("_cost", "_s_level", "_s_cost", "_s_calls", "_s_going")


# ------------------------------------------------------------------------------ escalation

def escalation(df: DataFrame, pool, costs, kind: str, beta: Column | None = None, mask: bool = True) -> DataFrame:
    """First and second call of an escalating policy: p1, l1, p2 (result if escalated), l2, conf.

    ``cascade``: the cheapest action, then the best remaining head. ``second_*``: the router's
    choice, then the best remaining head, averaging both; the signal is the distance of the
    probability from 0.5 or the (discounted) head margin. ``mask=False`` lets the second call
    land on an unavailable action.
    """
    heads, cal, lat, av = cols("head", pool), cols("cal", pool), latencies(pool), cols("available", pool)
    if kind == "cascade":
        first = E.first_argmax([-c for c in costs])
    else:
        first = F.col("sel")
    d = df.withColumn("_first", first)
    others = [F.when(F.col("_first") != i, h) for i, h in enumerate(heads)]
    allowed = [F.when(a, o) for a, o in zip(av, others)] if mask else others
    d = d.withColumn("_next", F.coalesce(E.first_argmax(allowed), F.col("_first")))
    p1, pn = E.pick(cal, F.col("_first")), E.pick(cal, F.col("_next"))
    if kind == "second_raw_margin":
        conf = E.top_two_margin(heads)
    elif kind == "second_discounted_margin":
        conf = E.top_two_margin([h * x for h, x in zip(heads, E.discounts(beta, costs))])
    else:
        conf = F.abs(p1 - 0.5)
    p2 = pn if kind == "cascade" else (p1 + pn) * 0.5
    return d.select("*", p1.alias("p1"), p2.alias("p2"), E.pick(lat, F.col("_first")).alias("l1"),
                    E.pick(lat, F.col("_next")).alias("l2"), conf.alias("conf")).drop("_first", "_next")


def latency_ceiling(verifier_ms: Column, feature_ms: Column, factor: float = 1.5) -> Column:
    """Verifier time that keeps a row's whole latency, features included, within ``factor`` of one call's."""
    return factor * (verifier_ms + feature_ms) - feature_ms


def choose_tau(val: DataFrame, ceiling: float, points: int = 25, upper: float = 0.6, label="label_supported") -> DataFrame:
    """Best validation AUROC among the signal quantiles whose mean latency respects the ceiling."""
    probs = [upper * i / (points - 1) for i in range(points)]
    q = quantile_points(val.withColumn("scope", F.lit("ALL")), ["scope"], "conf", probs)
    taus = q.agg(F.array_sort(F.collect_set(F.round("value", 9)))).first()[0]  # at most ``points`` numbers
    x = val.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus])))
    esc = F.col("conf") < F.col("tau")
    x = x.select("tau", label, F.when(esc, F.col("p2")).otherwise(F.col("p1")).alias("p"),
                 (F.col("l1") + F.when(esc, F.col("l2")).otherwise(F.lit(0.0))).alias("ms"))
    led = M.auroc(x, ["tau"], "p", label).join(x.groupBy("tau").agg(F.avg("ms").alias("mean_ms")), "tau")
    ok = led.filter(F.col("mean_ms") <= F.lit(ceiling))
    return ok.agg(F.coalesce(F.max_by("tau", F.struct(F.round("auroc", 12), -F.col("tau"))), F.lit(0.0)).alias("tau"))


def escalate(df: DataFrame, tau: Column) -> DataFrame:
    """Apply a chosen signal threshold: adds p, verifier_ms, calls."""
    esc = F.col("conf") < tau
    return df.drop("p", "verifier_ms").select(
        "*", F.when(esc, F.col("p2")).otherwise(F.col("p1")).alias("p"),
        (F.col("l1") + F.when(esc, F.col("l2")).otherwise(F.lit(0.0))).alias("verifier_ms"),
        (F.lit(1) + esc.cast("int")).alias("calls"))


def disagreement(df: DataFrame, pool, costs) -> DataFrame:
    """The two cheapest actions; the dearest decides when their decisions differ, else their mean."""
    n = len(pool)
    rank = [reduce(add, [((o < c) | ((o == c) & F.lit(j < i))).cast("int") for j, o in enumerate(costs) if j != i]) for i, c in enumerate(costs)]
    at = lambda values, r: reduce(lambda acc, i: F.when(rank[i] == r, values[i]).otherwise(acc), range(n), F.lit(None).cast("double"))
    cal, lat = cols("cal", pool), latencies(pool)
    a, b, c = (at(cal, r) for r in (0, 1, n - 1))
    differ = (a >= 0.5) != (b >= 0.5)
    return df.select(
        "*", F.when(differ, c).otherwise((a + b) * 0.5).alias("p"),
        (at(lat, 0) + at(lat, 1) + F.when(differ, at(lat, n - 1)).otherwise(F.lit(0.0))).alias("verifier_ms"),
        (F.lit(2) + differ.cast("int")).alias("calls"))


# ------------------------------------------------------------------------------ target-mix prices

def log_scores(pool) -> list[Column]:
    return [F.log(E.clip(h, 1e-12, 1.0)) for h in cols("head", pool)]


def priced_selection(df: DataFrame, pool, prices: Sequence[Column]) -> DataFrame:
    return select_action(df, pool, [s - p for s, p in zip(log_scores(pool), prices)])


def calibrate_prices(df: DataFrame, pool: Sequence[str], shares: Sequence[float], bounds=(-40.0, 40.0),
                     fan: int = 8, rounds: int = 6) -> dict[str, float]:
    """Prices of the first and last of three actions that bring the call shares to a target mix.

    For a given last price the first price is a quantile of one slack per row, so only the last
    price is searched: each round scores ``fan`` values at once and narrows the bracket. Only
    one aggregate row per candidate reaches the driver.
    """
    if len(pool) != 3:
        raise ValueError("the mix is defined over three actions")
    av, s = cols("available", pool), log_scores(pool)
    far = F.lit(1e6)
    live = df.select(*[F.when(a, x).otherwise(-far).alias(f"_s{i}") for i, (a, x) in enumerate(zip(av, s))])
    lo, hi = bounds
    best: tuple | None = None
    for _ in range(rounds):
        step = (hi - lo) / (fan + 1)
        grid = [lo + step * (i + 1) for i in range(fan)]
        x = live.withColumn("high", F.explode(F.array(*[F.lit(g) for g in grid])))
        rest = F.greatest(F.col("_s1"), F.col("_s2") - F.col("high"))
        x = x.withColumn("slack", F.least(F.greatest(F.col("_s0") - rest, F.lit(-1e6)), F.lit(1e6)))
        cut = quantile_points(x, ["high"], "slack", [1.0 - shares[0]]).select("high", F.col("value").alias("low"))
        j = x.join(F.broadcast(cut), "high")  # one row per grid value
        first = F.col("_s0") - F.col("low") >= rest
        last = ~first & (F.col("_s2") - F.col("high") > F.col("_s1"))
        rows = j.groupBy("high").agg(F.max("low").alias("low"), F.avg(first.cast("double")).alias("a"), F.avg(last.cast("double")).alias("c")).collect()
        for r in rows:
            b = 1.0 - r.a - r.c
            gap = abs(r.a - shares[0]) + abs(b - shares[1]) + abs(r.c - shares[2])
            cand = (gap, abs(r.c - shares[2]), r.low, r.high, r.a, b, r.c)
            best = cand if best is None or cand < best else best
        below = [r.high for r in rows if r.c > shares[2]]
        above = [r.high for r in rows if r.c <= shares[2]]
        lo, hi = max(below, default=lo), min(above, default=hi)
    return {"low_price": best[2], "high_price": best[3], "l1": best[0], "share_low": best[4], "share_mid": best[5], "share_high": best[6]}


# ------------------------------------------------------------------------------ selective policies

def stop_decision(score: Column, low: float | None, high: float | None) -> Column:
    """0 at or below the low threshold, 1 at or above the high one, NULL between."""
    out = F.lit(None).cast("int")
    if high is not None:
        out = F.when(score >= high, F.lit(1)).otherwise(out)
    if low is not None:
        out = F.when(score <= low, F.lit(0)).otherwise(out)
    return out


def selective_targets(df: DataFrame, pool, bands: dict[str, tuple], costs: dict[str, float], keys, label="label_supported") -> DataFrame:
    """Per action: stop decision, right/wrong stop, cost-to-go; and the cheapest right action."""
    total = float(sum(costs[a] for a in pool))
    y = F.col(label)
    out, right = [], []
    for a in pool:
        d = stop_decision(F.col(f"score__{a}"), *bands[a])
        ok = F.coalesce(d == y, F.lit(False))
        out += [d.alias(f"decision__{a}"), ok.alias(f"correct_stop__{a}"), F.coalesce(d != y, F.lit(False)).alias(f"wrong_stop__{a}"),
                (F.lit(costs[a] / total) + F.when(ok, 0.0).otherwise(1.0)).alias(f"cost_to_go__{a}")]
        right.append(F.when(ok, F.struct(F.lit(costs[a]).alias("c"), F.lit(pool.index(a)).alias("r"), F.lit(a).alias("a"))))
    best = F.array_min(F.array_compact(F.array(*right)))
    return df.select(*keys, y.alias("y"), *out, F.coalesce(best["a"], F.lit("ABSTAIN")).alias("oracle_action"), best.isNotNull().alias("oracle_available"))


def direct_policy(df: DataFrame, pool, bands, costs, action: Column, overhead: float, label="label_supported") -> DataFrame:
    """At most one call: its outcome, or an abstention."""
    dec, price = F.lit(None).cast("int"), F.lit(0.0)
    for a in pool:
        dec = F.when(action == a, stop_decision(F.col(f"score__{a}"), *bands[a])).otherwise(dec)
        price = F.when(action == a, F.lit(costs[a])).otherwise(price)
    called = (action != "ABSTAIN").cast("int")
    return _stops(df.withColumn("_d", dec).withColumn("path_cost_ms", F.lit(overhead) + price).withColumn("call_count", called).withColumn("selected", action), label)


def sequential_policy(df: DataFrame, pool, order, bands, costs, candidate: Column, enabled: Column, overhead: float,
                      label="label_supported") -> DataFrame:
    """The candidate first, then the fixed order, until some action stops."""
    dec, spent, calls = F.lit(None).cast("int"), F.lit(0.0), F.lit(0)
    d = df.withColumn("_cand", candidate).withColumn("_on", enabled)
    steps = [("cand", None)] + [("fixed", a) for a in order]
    for kind, a in steps:
        if kind == "cand":
            dv, cv = F.lit(None).cast("int"), F.lit(0.0)
            for x in pool:
                dv = F.when(F.col("_cand") == x, stop_decision(F.col(f"score__{x}"), *bands[x])).otherwise(dv)
                cv = F.when(F.col("_cand") == x, F.lit(costs[x])).otherwise(cv)
            use = F.col("_on")
        else:
            dv, cv = stop_decision(F.col(f"score__{a}"), *bands[a]), F.lit(costs[a])
            use = F.col("_on") & dec.isNull() & (F.col("_cand") != a)
        d = d.select(*[c for c in d.columns if not c.startswith("_q_")],
                     F.when(use, dv).otherwise(dec).alias("_q_d"), (spent + F.when(use, cv).otherwise(F.lit(0.0))).alias("_q_c"),
                     (calls + F.when(use, 1).otherwise(0)).alias("_q_n"))
        dec, spent, calls = F.col("_q_d"), F.col("_q_c"), F.col("_q_n")
    d = d.withColumn("_d", dec).withColumn("path_cost_ms", F.lit(overhead) + spent).withColumn("call_count", calls)
    d = d.withColumn("selected", F.when(F.col("_on"), F.col("_cand")).otherwise(F.lit("ABSTAIN")))
    return _stops(d.drop("_cand", "_on", "_q_d", "_q_c", "_q_n"), label)


def _stops(d: DataFrame, label: str) -> DataFrame:
    y = F.col(label)
    return d.select("*", F.col("_d").alias("stop_decision"), F.col("_d").isNotNull().alias("stopped"),
                    F.coalesce(F.col("_d") == y, F.lit(False)).alias("stop_correct"),
                    F.coalesce(F.col("_d") != y, F.lit(False)).alias("wrong_stop")).drop("_d")


def operating_points(df: DataFrame, confidence: str, overhead: float, candidates: DataFrame | None = None) -> DataFrame:
    """Policy metrics at every threshold ``confidence >= t`` from one ordered pass.

    Per-row columns stop_correct, wrong_stop, path_cost_ms (with overhead) and call_count describe
    the outcome if the row is active. The last candidate activates nothing.
    """
    one = F.lit(1).cast("bigint")
    c = F.col(confidence)
    led = df.select(F.lit("ALL").alias("scope"), c.alias("threshold"), one.alias("active"),
                    F.col("stop_correct").cast("bigint").alias("right"), F.col("wrong_stop").cast("bigint").alias("wrong"),
                    (F.col("path_cost_ms") - overhead).alias("spent"), F.col("call_count").cast("bigint").alias("calls"),
                    F.lit(0 if candidates is not None else 1).alias("cand"))
    none = df.agg((F.max(c) + F.lit(1e-9)).alias("threshold"))
    extra = none if candidates is None else none.unionByName(candidates.select("threshold"))
    zero = F.lit(0).cast("bigint")
    marks = extra.select(F.lit("ALL").alias("scope"), "threshold", zero.alias("active"), zero.alias("right"), zero.alias("wrong"),
                         F.lit(0.0).alias("spent"), zero.alias("calls"), F.lit(1).alias("cand"))
    sums = ["active", "right", "wrong", "spent", "calls"]
    both = led.unionByName(marks).groupBy("scope", "threshold").agg(*[F.sum(s).alias(s) for s in sums], F.max("cand").alias("cand"))
    run = running_totals(both, ["scope"], "threshold", sums, descending=True).filter("cand = 1")
    n = F.col("tot_active")
    return run.select(
        "threshold", n.alias("n_rows"), (F.col("cum_active") / n).alias("active_rate"), F.col("cum_right").alias("correct_stops"),
        F.col("cum_wrong").alias("wrong_stops"), (F.col("cum_right") / n).alias("correct_stop_rate"), (F.col("cum_wrong") / n).alias("wrong_stop_rate"),
        (F.lit(overhead) + F.col("cum_spent") / n).alias("mean_cost_ms"), (F.col("cum_calls") / n).alias("mean_calls"))


def choose_operating_point(points: DataFrame, risk_budget: float, correct_floor: Column | None = None) -> DataFrame:
    """Ordered choice among the feasible thresholds; if none is feasible, the least risky one."""
    w, r, m, t = F.round("wrong_stop_rate", 12), F.round("correct_stop_rate", 12), F.round("mean_cost_ms", 9), F.col("threshold")
    ok = w <= risk_budget
    if correct_floor is not None:
        ok = ok & (r >= F.round(correct_floor, 12))
        good = F.struct(m, -r, w, -t)
    else:
        good = F.struct(-r, w, m, -t)
    row = F.struct(*[F.col(c) for c in points.columns])
    got = points.agg(F.min_by(row, F.when(ok, good)).alias("g"), F.min_by(row, F.struct(w, -r, m, -t)).alias("f"), F.max(ok).alias("feasible"))
    return got.select("feasible", F.coalesce("g", "f").alias("x")).select("feasible", "x.*")


def policy_metrics(outcomes: DataFrame, keys: Sequence[str] = (), group="content_doc_key") -> DataFrame:
    """Coverage, stop rates, conditional error, cost and calls of a selective policy."""
    n = F.count("*")
    stops, right, wrong = F.count_if("stopped"), F.count_if("stop_correct"), F.count_if("wrong_stop")
    return outcomes.groupBy(*keys).agg(
        n.alias("n_rows"), F.count_distinct(group).alias("documents"), stops.alias("stops"), right.alias("correct_stops"),
        wrong.alias("wrong_stops"), (n - stops).alias("abstains"), (stops / n).alias("coverage"), (right / n).alias("correct_stop_rate"),
        (wrong / n).alias("wrong_stop_rate"), F.when(stops > 0, wrong / stops).alias("conditional_error"),
        F.avg("path_cost_ms").alias("mean_cost_ms"), F.avg("call_count").alias("mean_calls"))
