"""Isotonic recalibration as a mergeable summary: pooled blocks, merged up a tree of partitions.

Pooling adjacent violators commutes with cutting the order: the blocks of two neighbouring stretches, pooled again, are the
blocks of both. So every range partition pools its own stretch, the blocks of a few neighbours are pooled together, and so
on, until a key's blocks lie in one place. What is left there is small whatever the data: block means increase strictly and
are fractions of counts, so n labelled rows leave at most in the order of n^(2/3) blocks. No table of distinct
probabilities and no model reaches the driver, and rows meet only the few end points of blocks around their own cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routelens.functions.expr import EPS, clip
from routelens.operators.thresholds import mcc_threshold

CELLS = 1 << 12
FAN = 16


def pooled(blocks: list[tuple]) -> list[tuple]:
    """Adjacent (lo, hi, weight, positives) blocks pooled until their means increase strictly; counts are compared exactly."""
    out: list[tuple] = []
    for block in blocks:
        lo, hi, w, s = block
        while out and out[-1][3] * w >= s * out[-1][2]:
            lo0, _, w0, s0 = out.pop()
            lo, w, s = lo0, w0 + w, s0 + s
        out.append((lo, hi, w, s))
    return out


def _pool_partitions(keys: Sequence[str]):
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key and place; a key's stretch is pooled as it passes and sent on when it ends."""
        key, held = None, []

        def done() -> pd.DataFrame:
            return pd.DataFrame([(*key, *b) for b in held], columns=[*keys, "lo", "hi", "w", "s"])

        for batch in batches:
            for row in batch[[*keys, "lo", "hi", "w", "s"]].itertuples(index=False, name=None):
                here = tuple(None if isinstance(v, float) and v != v else v for v in row[: len(keys)])
                if here != key:
                    if held:
                        yield done()
                    key, held = here, []
                lo, hi, w, s = float(row[-4]), float(row[-3]), int(row[-2]), int(row[-1])
                while held and held[-1][3] * w >= s * held[-1][2]:
                    lo0, _, w0, s0 = held.pop()
                    lo, w, s = lo0, w0 + w, s0 + s
                held.append((lo, hi, w, s))
        if held:
            yield done()

    return run


def fit_isotonic(df: DataFrame, keys: Sequence[str], p: str = "p", label: str = "y") -> DataFrame:
    """(keys, lo, hi, w, s): the blocks of the increasing map from ``p`` to the label rate ``s / w``; rows without ``p`` take no part."""
    spark, keys = df.sparkSession, list(keys)
    led = df.filter(F.col(p).isNotNull()).groupBy(*keys, F.col(p).cast("double").alias("lo")).agg(F.count(F.lit(1)).alias("w"), F.sum(F.col(label).cast("long")).alias("s"))
    blocks = led.select(*keys, "lo", F.col("lo").alias("hi"), "w", "s")
    schema, run = blocks.schema, _pool_partitions(keys)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while n > FAN:
        blocks = blocks.repartitionByRange(n, *keys, "lo").sortWithinPartitions(*keys, "lo").mapInPandas(run, schema)
        n //= FAN
    return blocks.repartition(*keys).sortWithinPartitions(*keys, "lo").mapInPandas(run, schema)


def apply_isotonic(df: DataFrame, blocks: DataFrame, keys: Sequence[str], p: str = "p", out: str = "q") -> DataFrame:
    """``df`` with the recalibrated probability: linear between the ends of blocks, level beyond the first and the last, and
    clipped away from 0 and 1. Keys are compared null-safely; a key without blocks gets null."""
    keys = list(keys)
    at = lambda x: F.least(F.greatest(F.floor(x * CELLS), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    ends = blocks.select(*keys, F.explode(F.array_distinct(F.array(*[F.struct(F.col(c).alias("x"), (F.col("s") / F.col("w")).alias("v")) for c in ("lo", "hi")]))).alias("e"))
    full = ends.groupBy(*keys, at(F.col("e.x")).alias("_cell")).agg(F.array_sort(F.collect_list("e")).alias("e"))
    # every cell knows the last end below it and the first one above; a key has at most CELLS of them
    w = W.partitionBy(*keys).orderBy("_cell")
    gap = full.select(
        *keys, "_cell", "e", F.element_at(F.last("e").over(w.rowsBetween(W.unboundedPreceding, -1)), -1).alias("before"), F.lead("_cell").over(w).alias("next"),
        F.element_at(F.lead("e").over(w), 1).alias("after"), F.row_number().over(w).alias("_n"),
    )
    some = F.when(F.col("_n") == 1, F.lit(0)).otherwise(F.col("_cell"))  # the first one also serves the cells below it
    cells = gap.select(*keys, "_cell", "e", "before", "after", F.explode(F.sequence(some, F.coalesce(F.col("next"), F.lit(CELLS)) - 1)).alias("cell"))
    here = F.col("cell") == F.col("_cell")
    low = F.when(here, F.concat(F.array_compact(F.array("before")), "e", F.array_compact(F.array("after"))))
    between = F.when(F.col("cell") > F.col("_cell"), F.concat(F.array(F.element_at("e", -1)), F.array_compact(F.array("after")))).otherwise(F.array(F.element_at("e", 1)))
    near = cells.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("cell").alias("_cell"), F.coalesce(low, between).alias("_near"))
    row = df.withColumn("_cell", at(F.col(p)))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    cond = row["_cell"] == near["_cell"]
    for s in same:
        cond = cond & s
    x = row.join(near, cond, "left").drop(near["_cell"]).drop(*[f"_k_{k}" for k in keys])
    v = F.col(p)
    a = F.element_at(F.filter("_near", lambda e: e["x"] <= v), -1)
    b = F.get(F.filter("_near", lambda e: e["x"] >= v), F.lit(0))
    x = x.withColumn("_a", F.when(F.exists("_near", lambda e: e["x"] <= v), a)).withColumn("_b", b)
    lo, hi = F.col("_a"), F.col("_b")
    value = (
        F.when(lo.isNull(), hi["v"]).when(hi.isNull() | (hi["x"] == lo["x"]), lo["v"])
        .otherwise(lo["v"] + (hi["v"] - lo["v"]) * ((v - lo["x"]) / (hi["x"] - lo["x"])))
    )
    return x.withColumn(out, F.when(value.isNotNull(), clip(value, EPS, 1 - EPS))).drop("_near", "_a", "_b", "_cell")


def stage_two(
    df: DataFrame, keys: Sequence[str], side: str = "side", p: str = "p", label: str = "y", settle: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> DataFrame:
    """Recalibration and threshold of already routed rows, both fitted on the validation rows of each key.

    Adds ``q``, ``threshold`` (best MCC) and ``d``, the decision ``q >= threshold``. ``settle`` may write the tables between the steps.
    """
    keys = list(keys)
    val = df.filter(F.col(side) == "val")
    q = settle(apply_isotonic(df, settle(fit_isotonic(val, keys, p, label), "blocks"), keys, p), "recalibrated")
    cut = mcc_threshold(q.filter(F.col(side) == "val"), keys, "q", label).select(*keys, "threshold")
    return q.join(cut, keys, "left").withColumn("d", (F.col("q") >= F.col("threshold")).cast("int"))
