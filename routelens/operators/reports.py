"""Operators over result tables: frontiers, dominance, Shapley values, gates and audits.

A result table has one row per system, arm or subset: its size is fixed by the experiment
grid, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pareto_prefix(df: DataFrame, keys: Sequence[str], cost: str, quality: str) -> DataFrame:
    """Frontier by scanning in cost order and keeping strict quality records."""
    w = W.partitionBy(*keys).orderBy(F.col(cost), F.col(quality).desc()).rowsBetween(W.unboundedPreceding, -1)
    best = F.max(quality).over(w)
    return df.withColumn("frontier", best.isNull() | (F.col(quality) > best))


def dominated_by(df: DataFrame, keys: Sequence[str], name: str, cost: str, quality: str) -> DataFrame:
    """How many other systems are at least as good on both axes and better on one."""
    o = df.select(*keys, F.col(name).alias("_n"), F.col(cost).alias("_c"), F.col(quality).alias("_q"))
    j = df.join(o, list(keys))
    worse = (F.col("_q") >= F.col(quality)) & (F.col("_c") <= F.col(cost)) & ((F.col("_q") > F.col(quality)) | (F.col("_c") < F.col(cost))) & (F.col("_n") != F.col(name))
    return j.groupBy(*df.columns).agg(F.count_if(worse).alias("dominators"))


def shapley(lattice: DataFrame, items: Sequence[str], mask: str = "mask", value: str = "value") -> DataFrame:
    """Exact Shapley values from a full subset lattice keyed by bitmask.

    Joins each subset without the item to the same subset with it; also the solo value, the
    leave-one-out value, and the share of the total.
    """
    from math import factorial

    n = len(items)
    full = (1 << n) - 1
    item = F.explode(F.array(*[F.struct(F.lit(a).alias("item"), F.lit(1 << i).alias("bit")) for i, a in enumerate(items)]))
    base = lattice.select(F.col(mask).cast("int").alias("m"), F.col(value).alias("v"))
    without = base.select("m", "v", item.alias("x")).select("m", "v", "x.*").filter(F.col("m").bitwiseAND(F.col("bit")) == 0)
    withit = base.select(F.col("m").alias("m2"), F.col("v").alias("v2"))
    weights = F.array(*[F.lit(factorial(k) * factorial(n - k - 1) / factorial(n)) for k in range(n)])
    j = without.withColumn("m2", F.col("m").bitwiseOR(F.col("bit"))).join(withit, "m2")
    w = F.get(weights, F.bit_count("m"))
    s = j.groupBy("item").agg(
        F.sum(w * (F.col("v2") - F.col("v"))).alias("shapley"),
        F.max(F.when(F.col("m") == 0, F.col("v2"))).alias("solo"),
        F.max(F.when(F.col("m2") == full, F.col("v"))).alias("leave_one_out"))
    total = F.sum("shapley").over(W.partitionBy(F.lit(1)))  # one row per item
    return s.withColumn("share", F.when(total != 0, F.col("shapley") / total))


def drift_gate(observed: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Observed against recorded values; a missing side fails."""
    j = observed.select(*keys, F.col(value).alias("observed")).join(expected.select(*keys, F.col(value).alias("expected")), list(keys), "full_outer")
    d = F.abs(F.col("observed") - F.col("expected"))
    return j.withColumn("delta", d).withColumn("passes", F.coalesce(d <= tolerance, F.lit(False)))


def completeness(predictions: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that are missing, duplicated or unknown in a finished run."""
    got = predictions.groupBy(*keys).agg(F.count("*").alias("g"))
    want = expected.select(*keys).distinct().withColumn("w", F.lit(1))
    j = got.join(want, list(keys), "full_outer")
    return j.agg(F.count("w").alias("expected"), F.count("g").alias("found"),
                 F.count_if(F.col("g").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("unknown"), F.count_if(F.col("g") > 1).alias("duplicated"))


def rolled_up_status(status: Column) -> Column:
    """One status for all parts of a verifier: finished or skipped only as a whole; work in progress shows first."""
    every = lambda x: F.bool_and(status == x)
    some = lambda x: F.bool_or(status == x)
    return (
        F.when(every("SCORED"), "SCORED").when(every("SKIPPED"), "SKIPPED").when(some("RUNNING"), "RUNNING")
        .when(some("SCORED"), "PARTIAL").when(some("FAILED"), "FAILED").otherwise("PENDING")
    )


def best_under_shares(summary: DataFrame, shares: dict[str, float], tolerance: float, by: str = "method") -> DataFrame:
    """The chosen configuration of every ``by``: of those whose call shares all lie within ``tolerance`` of the wanted ones, the best
    AUROC, then the lower latency, then the better balanced accuracy; where none does, the one with the smallest worst share error.

    ``summary`` has auroc, mean_ms, bacc and one column per key of ``shares``; the result says which case held and which row is best overall.
    """
    gap = F.greatest(*[F.abs(F.col(c) - F.lit(v)) for c, v in shares.items()])
    x = summary.withColumn("max_share_error", F.round(gap, 9)).withColumn("eligible", F.col("max_share_error") <= tolerance)
    near = F.when(F.col("eligible"), F.lit(0.0)).otherwise(F.col("max_share_error"))
    order = [F.col("eligible").desc(), near, F.round("auroc", 12).desc(), F.round("mean_ms", 9), F.round("bacc", 12).desc()]
    first = x.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*order, *[F.col(c) for c in summary.columns]))).filter("_r = 1").drop("_r")
    status = F.when(F.col("eligible"), "eligible").otherwise("closest_ineligible")
    better = [F.col("eligible").desc(), F.round("auroc", 12).desc(), F.round("mean_ms", 9), F.round("bacc", 12).desc(), F.col(by)]
    return first.withColumn("selection_status", status).withColumn("overall_best", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*better)) == 1)  # one row per ``by``
