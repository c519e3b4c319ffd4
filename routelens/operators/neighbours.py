"""Exact k-nearest regression by a grid that coarsens: every query meets nine cells at a time, never all training rows.

Rows lie on a grid over the two features of the widest range; a distance in these two never exceeds the whole one. A query
looks at its own cell and the eight around it. If the k-th distance found is at most one cell's width, no row outside can be
nearer and the query is done; the others go on with cells of four times the width. Sparse regions therefore look further and crowded
ones do not, and the number of rounds is the logarithm of the grid. The first width follows the crowds, not the range: it is the largest
at which a training row shares its cell with a few k others on average. Of equal training rows at most k can ever be asked for, so a
vector shared by a third of all rows is k rows; equal queries are one query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routelens.sources.files import settled


LEVELS = 10  # first widths to choose from, each a quarter of the one before


def _grid(train: DataFrame, queries: DataFrame, features: Sequence[str]) -> tuple[list[str], list[float], float, int]:
    """The two widest features, their smallest values, the whole range and the number of training rows: a few numbers."""
    ends = lambda d: d.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    t, q = ends(train), ends(queries)
    lo = {c: min((e[f"lo_{c}"] for e in (t, q) if e[f"lo_{c}"] is not None), default=0.0) for c in features}
    hi = {c: max((e[f"hi_{c}"] for e in (t, q) if e[f"hi_{c}"] is not None), default=0.0) for c in features}
    wide = sorted(features, key=lambda c: (lo[c] - hi[c], c))[:2]
    return wide, [lo[c] for c in wide], max(hi[wide[0]] - lo[wide[0]], 1e-12), t.n


def _first_width(train: DataFrame, keys: Sequence[str], wide: Sequence[str], low: Sequence[float], span: float, n: int, k: int) -> float:
    """The largest width on offer at which the pairs of training rows in one cell are at most 4 k a row; else the smallest."""
    top = span / max(4.0, (n / (4 * k)) ** 0.5)
    widths = [top / 4**i for i in range(LEVELS)]
    at = train.select(*keys, *wide, F.posexplode(F.array(*[F.lit(w) for w in widths])).alias("_level", "_w"))
    cells = at.groupBy(*keys, "_level", *[F.floor((F.col(c) - lo) / F.col("_w")).alias(f"_c{i}") for i, (c, lo) in enumerate(zip(wide, low))]).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    pairs = {r[0]: r[1] for r in cells.groupBy("_level").agg(F.sum(F.col("_n") * F.col("_n"))).collect()}  # one row a level
    return next((w for i, w in enumerate(widths) if pairs.get(i, 0.0) <= 4.0 * k * n), widths[-1])


def nearest_mean(
    train: DataFrame, queries: DataFrame, keys: Sequence[str], features: Sequence[str], value: str, row: str, query: str, k: int = 25, settle: Callable[[DataFrame, str], DataFrame] = settled
) -> DataFrame:
    """(query, keys, prediction): the mean of ``value`` over the k nearest training rows of the same keys, weighted by 1 / distance.

    ``keys`` has at least one column. At distance 0 only the rows at that distance count. Equal distances are ordered by the training ``row`` id; a key with fewer than k
    rows uses them all; rows and queries with a null feature or value take no part. ``settle`` cuts the plan between rounds: every round
    reads what the last one left twice.
    """
    keys, features = list(keys), list(features)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    train, queries = train.filter(whole & F.col(value).isNotNull()), queries.filter(whole)
    wide, low, span, n = _grid(train, queries, features)
    equal = W.partitionBy(*keys, *features).orderBy("_row")
    train = train.select(*keys, *features, F.col(value).alias("_v"), F.col(row).alias("_row")).withColumn("_n", F.row_number().over(equal))
    train = settle(train.filter(F.col("_n") <= k).drop("_n"), "neighbours")
    sizes = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    width = _first_width(train, keys, wide, low, span, n, k)
    spot = F.struct(*features).alias("_spot")
    asked = queries.select(query, *keys, spot).distinct()
    pending = settle(queries.select(*keys, *features, spot).distinct().join(sizes, keys), "pending")
    place = lambda c, i, w: F.floor((F.col(c) - low[i]) / F.lit(w)).cast("long")
    out, last = [], False
    while not last:
        last = width > span
        cells = train.withColumns({f"_c{i}": place(c, i, width) for i, c in enumerate(wide)}).withColumnsRenamed({c: f"_t_{c}" for c in features})
        near = pending
        for i, c in enumerate(wide):
            near = near.withColumn(f"_c{i}", F.explode(F.sequence(place(c, i, width) - 1, place(c, i, width) + 1)))
        on = [*keys, *[f"_c{i}" for i in range(len(wide))]]
        square = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"_t_{c}")) * (F.col(c) - F.col(f"_t_{c}")) for c in features])
        met = near.join(cells, on).select("_spot", *keys, "_all", "_v", "_row", F.sqrt(square).alias("_d"))
        order = W.partitionBy("_spot", *keys).orderBy("_d", "_row")
        top = met.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
        zero = F.min("_d") == 0
        found = top.groupBy("_spot", *keys).agg(
            F.count(F.lit(1)).alias("_got"), F.max("_all").alias("_all"), F.max("_d").alias("_far"),
            F.when(zero, F.avg(F.when(F.col("_d") == 0, F.col("_v")))).otherwise(F.sum(F.col("_v") / F.when(F.col("_d") > 0, F.col("_d"))) / F.sum(1 / F.when(F.col("_d") > 0, F.col("_d")))).alias("prediction"))
        enough = (F.col("_got") >= F.least(F.lit(k), F.col("_all"))) & ((F.col("_far") <= width * (1 - 1e-9)) | (F.col("_got") == F.col("_all")))
        found = settle(found.filter(F.lit(True) if last else enough).select("_spot", *keys, "prediction"), "found")
        out.append(found)
        if not last:
            pending = settle(pending.join(found.select("_spot", *keys), ["_spot", *keys], "left_anti"), "pending")
            last = pending.isEmpty()
        width *= 4
    return asked.join(reduce(lambda a, b: a.union(b), out), ["_spot", *keys]).select(query, *keys, "prediction")
