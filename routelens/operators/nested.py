"""Nested cross-validation of many router configurations from one table of counts.

A study has a row per (method, discount, seed, outer fold). Each picks its candidate by out-of-fold results on inner folds of the
other outer folds, refits it there, and predicts its own fold. Heads are shrunken means per cell of binned features, so all
their fits are sums, and everything a candidate is judged by depends on a row's profile only: its bins, which actions are
available, which of them are right, and its label. The rows are therefore read once, into counts per (seed, outer fold, inner
fold, profile); every training set is a sum of such counts, and every inner result a sum over profiles. Rows are read a second
time for their predictions.

Methods: ``S1`` learns the chance that an action is right and is chosen by the likelihood of these chances, once for all
discounts; ``S2`` learns the same and is chosen by the discounted reward of its calls; ``S3`` learns which action is the
cheapest right one, calls it without a discount, and is chosen like ``S2``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routelens.functions import expr as E
from routelens.functions.hashing import uniform

METHODS = ("S1", "S2", "S3")
FINAL = -1


@dataclass(frozen=True)
class Study:
    """The grid of a study; ``costs`` are the fixed prices of the actions, in the order of the pool."""

    costs: tuple[float, ...]
    betas: tuple[float, ...]
    seeds: tuple[int, ...]
    folds: int
    inner: int
    masks: tuple[int, ...]
    priors: tuple[float, ...]
    methods: tuple[str, ...] = METHODS

    def candidates(self) -> list[tuple[int, float, str]]:
        return [(m, p, json.dumps({"bins": m, "prior": p}, sort_keys=True)) for m, p in product(self.masks, self.priors)]

    def configurations(self) -> list[tuple[str, float]]:
        return [(m, b) for m in self.methods for b in self.betas]


def _rows_of(names: str, values: Sequence[tuple]) -> Column:
    """A literal table to explode."""
    cols = names.split()
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(cols, row, strict=True)]) for row in values]))


def _cell(mask: Column, bins: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.col(b)).otherwise("*") for i, b in enumerate(bins)])


def _flags(pool: Sequence[str], label: str) -> dict[str, Column]:
    """Availability and (available and right) of every action as 0/1."""
    out = {}
    for i, a in enumerate(pool):
        av = F.coalesce(f"available__{a}", F.lit(False))
        right = (F.coalesce(f"score__{a}", F.lit(0.5)) >= 0.5).cast("int") == F.col(label)
        out |= {f"a{i}": av.cast("int"), f"o{i}": (av & right).cast("int")}
    return out


def with_inner_folds(rows: DataFrame, study: Study, group: str) -> DataFrame:
    """A copy of the rows per seed, with an inner fold for the whole group."""
    x = rows.withColumn("seed", F.explode(F.lit(list(study.seeds))))
    return x.withColumn("inner", F.floor(uniform("inner", F.col("seed"), F.col(group)) * study.inner).cast("int"))


def profiles(rows: DataFrame, study: Study, pool: Sequence[str], bins: Sequence[str], group="content_doc_key", label="label_supported") -> DataFrame:
    """(seed, fold, inner, bins, a0.., o0.., y, n, l0..): how many rows of each kind, and their summed latencies."""
    x = with_inner_folds(rows, study, group).withColumns(_flags(pool, label))
    keys = ["seed", "fold", "inner", *bins, *[f"{c}{i}" for i in range(len(pool)) for c in "ao"]]
    return x.groupBy(*keys, F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(f"latency_ms__{a}", F.lit(0.0))).alias(f"l{i}") for i, a in enumerate(pool)])


def fits(prof: DataFrame, study: Study, bins: Sequence[str]) -> DataFrame:
    """(seed, outer, held, mask, prior, cell, p0.., t0..): heads without outer fold ``outer`` and inner fold ``held`` (FINAL: none)."""
    k = len(study.costs)
    outer = F.filter(F.sequence(F.lit(0), F.lit(study.folds - 1)), lambda f: f != F.col("fold"))
    held = F.concat(F.filter(F.sequence(F.lit(0), F.lit(study.inner - 1)), lambda g: g != F.col("inner")), F.array(F.lit(FINAL)))
    x = prof.withColumn("outer", F.explode(outer)).withColumn("held", F.explode(held)).withColumn("mask", F.explode(F.lit(list(study.masks))))
    order = sorted(range(k), key=lambda i: study.costs[i])
    best = F.coalesce(*[F.when(F.col(f"o{i}") == 1, F.lit(i)) for i in order])
    n = F.col("n")
    sums = []
    for i in range(k):
        sums += [F.sum(n * F.col(f"a{i}")).alias(f"n{i}"), F.sum(n * F.col(f"o{i}")).alias(f"s{i}"), F.sum(F.when(best == i, n).otherwise(0)).alias(f"c{i}")]
    keys = ["seed", "outer", "held", "mask"]
    t = x.groupBy(*keys, _cell(F.col("mask"), bins).alias("cell")).agg(*sums).withColumn("prior", F.explode(F.lit([float(p) for p in study.priors])))
    whole = W.partitionBy(*keys, "prior")  # the cells of one fit
    rate = lambda s, i: (F.col(f"{s}{i}") + F.col("prior") * F.coalesce(F.sum(f"{s}{i}").over(whole) / F.sum(f"n{i}").over(whole), F.lit(0.5))) / (F.col(f"n{i}") + F.col("prior"))
    return t.select(*keys, "prior", "cell", *[rate("s", i).alias(f"p{i}") for i in range(k)], *[rate("c", i).alias(f"t{i}") for i in range(k)])


def _chosen(study: Study) -> Column:
    """The called action: the best available one by (discounted) head; a row without any calls the first."""
    k = len(study.costs)
    top = max(study.costs)
    u = [F.when(F.col("method") == "S3", F.coalesce(f"t{i}", F.lit(0.5))).otherwise(F.coalesce(f"p{i}", F.lit(0.5)) * F.exp(-F.col("beta") * study.costs[i] / top)) for i in range(k)]
    return F.coalesce(E.first_argmax(u, [F.col(f"a{i}") == 1 for i in range(k)]), F.lit(0))


def inner_results(prof: DataFrame, heads: DataFrame, study: Study, bins: Sequence[str]) -> DataFrame:
    """(seed, outer, method, trained_beta, mask, prior, parameters, primary, inner_utility, inner_bacc, inner_latency_ms) of every candidate."""
    k, top = len(study.costs), max(study.costs)
    configs = [(m, b) for m, b in study.configurations() if m != "S1"] + ([("S1", 0.0)] if "S1" in study.methods else [])
    outer = F.filter(F.sequence(F.lit(0), F.lit(study.folds - 1)), lambda f: f != F.col("fold"))
    x = prof.withColumn("outer", F.explode(outer)).withColumn("held", F.col("inner")).withColumn("c", _rows_of("mask prior parameters", study.candidates())).select("*", "c.*").drop("c")
    x = x.withColumn("cell", _cell(F.col("mask"), bins)).join(heads, ["seed", "outer", "held", "mask", "prior", "cell"], "left")
    loss, asked = F.lit(0.0), F.lit(0)
    for i in range(k):
        p = E.clip(F.coalesce(f"p{i}", F.lit(0.5)), 1e-7, 1 - 1e-7)
        loss = loss + F.col(f"a{i}") * -(F.col(f"o{i}") * F.log(p) + (1 - F.col(f"o{i}")) * F.log(1 - p))
        asked = asked + F.col(f"a{i}")
    x = x.withColumn("loss", loss).withColumn("asked", asked).withColumn("m", _rows_of("method beta", configs)).select("*", "m.*").drop("m")
    x = x.withColumn("sel", _chosen(study))
    at = lambda c: E.pick([F.col(f"{c}{i}") for i in range(k)], F.col("sel"))
    hit, n = at("o"), F.col("n")
    disc = E.pick([F.exp(-F.col("beta") * c / top) for c in study.costs], F.col("sel"))
    of = lambda y: F.sum(F.when(F.col("y") == y, n * hit)) / F.sum(F.when(F.col("y") == y, n))
    g = x.groupBy("seed", "outer", "method", F.col("beta").alias("trained_beta"), "mask", "prior", "parameters").agg(
        (F.sum(n * hit * disc) / F.sum(n)).alias("inner_utility"), ((F.coalesce(of(1), of(0)) + F.coalesce(of(0), of(1))) / 2).alias("inner_bacc"),
        (F.sum(at("l")) / F.sum(n)).alias("inner_latency_ms"), (-F.sum(n * F.col("loss")) / F.sum(n * F.col("asked"))).alias("likelihood"))
    return g.withColumn("primary", F.when(F.col("method") == "S1", F.col("likelihood")).otherwise(F.col("inner_utility"))).drop("likelihood")


def selected(results: DataFrame) -> DataFrame:
    """The best candidate of each (seed, outer, method, trained_beta): primary, balanced accuracy, lower latency, then the shorter and the later text."""
    order = F.struct(F.round("primary", 12), F.round("inner_bacc", 12), -F.round("inner_latency_ms", 9), -F.length("parameters"), F.col("parameters"))
    keys = ["seed", "outer", "method", "trained_beta"]
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*")


def predictions(rows: DataFrame, heads: DataFrame, chosen: DataFrame, study: Study, pool: Sequence[str], bins: Sequence[str], keep: Sequence[str], label="label_supported", feature_ms="feature_latency_ms", todo: DataFrame | None = None) -> DataFrame:
    """Out-of-fold predictions of every configuration for every row; ``todo`` (method, beta, seed, fold) names the ones to make."""
    k = len(pool)
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(b)).alias("beta"), F.lit(0.0 if m == "S1" else float(b)).alias("trained_beta")) for m, b in study.configurations()]))
    x = rows.withColumns(_flags(pool, label)).withColumn("seed", F.explode(F.lit(list(study.seeds)))).withColumn("g", grid).select("*", "g.*").drop("g")
    if todo is not None:
        x = x.join(todo.select("method", "beta", "seed", "fold").distinct(), ["method", "beta", "seed", "fold"], "left_semi")
    pick = chosen.select("seed", F.col("outer").alias("fold"), "method", "trained_beta", "mask", "prior")
    final = heads.filter(F.col("held") == FINAL).drop("held").withColumnRenamed("outer", "fold")
    x = x.join(pick, ["seed", "fold", "method", "trained_beta"]).withColumn("cell", _cell(F.col("mask"), bins)).join(final, ["seed", "fold", "mask", "prior", "cell"], "left")
    x = x.withColumn("sel", _chosen(study))
    at = lambda cols: E.pick(cols, F.col("sel"))
    hit = at([F.col(f"o{i}") for i in range(k)])
    return x.select(
        "method", "beta", "seed", "fold", *keep, F.col(label).alias("y"), at([F.lit(a) for a in pool]).alias("selected_action"),
        F.when(hit == 1, F.col(label)).otherwise(1 - F.col(label)).alias("d"), hit.alias("correct"), at([F.coalesce(f"score__{a}", F.lit(0.5)) for a in pool]).alias("p"),
        (F.col(feature_ms) + at([F.coalesce(f"latency_ms__{a}", F.lit(0.0)) for a in pool])).alias("ms"),
        *[F.col(f"a{i}") for i in range(k)], *[F.col(f"o{i}") for i in range(k)], *[F.coalesce(f"p{i}", F.lit(0.5)).alias(f"p{i}") for i in range(k)])
