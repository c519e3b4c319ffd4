"""Order-dependent aggregation that never sends one key's rows to one task.

Running totals, ranks, quantiles and rank-based areas need a global order per key. A plain
window would pull the whole key into a single task, so the values of a key are placed on a grid of
``CELLS`` cells between the key's own smallest and largest position: scores that all lie within a
millionth of 1 spread as well as scores between 0 and 1. One window runs over the distinct values of
a cell, another over the at most ``CELLS`` cell totals of a key. The ends of a grid are exact
aggregates of the data, so a retried task, or a second use of the same rows, gets the same cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 1 << 14
SALTS = 16


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with the other columns of ``right`` on ``keys``; null keys match each other, as they do in a group-by."""
    packed = F.struct(*keys)
    return left.withColumn("_key", packed).join(right.withColumn("_key", packed).drop(*keys), "_key", how).drop("_key")


def squash(x: Column, scale: float = 100.0) -> Column:
    """Monotone map of any real value into (0, 1), for grid placement only."""
    return F.lit(0.5) + F.lit(0.5) * x / (F.abs(x) + F.lit(scale))


def with_grid(df: DataFrame, keys: Sequence[str], position: Column | Sequence[Column], descending: bool = False, cells: int = CELLS) -> DataFrame:
    """Add a cell number that increases in the requested order, from the key's smallest to its largest position.

    Several monotone positions share the cells, so that values are told apart wherever one of them tells them apart.
    """
    at = [p.cast("double") for p in ([position] if isinstance(position, Column) else position)]
    placed = df.withColumns({f"_at{i}": p for i, p in enumerate(at)} | {"_key": F.struct(*keys)})  # one key that is never null
    ends = [f(f"_at{i}").alias(f"_{n}{i}") for i in range(len(at)) for n, f in (("from", F.min), ("to", F.max))]
    # each row meets one of several copies of its key's ends, so a key with most of the rows is spread over the join
    ends = placed.groupBy("_key").agg(*ends).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64("_at0"), F.lit(SALTS)).cast("int")).join(ends, ["_key", "_salt"])
    share = F.lit(0.0)
    for i in range(len(at)):
        width = F.col(f"_to{i}") - F.col(f"_from{i}")
        share = share + F.when(width > 0, (F.col(f"_at{i}") - F.col(f"_from{i}")) / width).otherwise(F.lit(0.0))
    cell = F.least(F.floor(share * (cells / len(at))), F.lit(cells - 1))
    return placed.withColumn("_cell", -cell if descending else cell).drop(*[f"_{n}{i}" for i in range(len(at)) for n in ("at", "from", "to")], "_salt", "_key")


def _before(w, name: str) -> Column:
    """Total of the rows strictly ahead; zero for the first, as DOUBLE when the input is."""
    c = F.col(name)
    return F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)) - c


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    position: Column | Sequence[Column] | None = None,
    descending: bool = False,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running totals ``cum_x`` and key totals ``tot_x`` for every ``x`` in ``sums``.

    ``df`` must already be aggregated to one row per (keys, order, ties).
    """
    keys = list(keys)
    d = with_grid(df, keys, F.col(order) if position is None else position, descending).withColumn("_key", F.struct(*keys))
    cells = d.groupBy("_key", "_cell").agg(*[F.sum(s).alias(s) for s in sums])
    in_key, whole = W.partitionBy("_key").orderBy("_cell"), W.partitionBy("_key")
    offsets = cells.select(
        "_key",
        "_cell",
        *[_before(in_key, s).alias(f"_off_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"tot_{s}") for s in sums],
    )
    direction = F.col(order).desc() if descending else F.col(order).asc()
    w = W.partitionBy("_key", "_cell").orderBy(direction, *ties).rowsBetween(W.unboundedPreceding, 0)
    inner = d.select("*", *[F.sum(s).over(w).alias(f"_cum_{s}") for s in sums])
    joined = inner.join(offsets, ["_key", "_cell"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_cum_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
        *[f"tot_{s}" for s in sums],
    )


def order_area(df: DataFrame, keys: Sequence[str], order: str, pos: str, neg: str, cells: int = CELLS) -> DataFrame:
    """``area`` = sum over pairs of (positive above negative) + half the ties, with class totals.

    The statistic of an ordered concatenation is ``a1 + a2 + pos2 * neg1``, so two small
    aggregations (cell, then key) replace a global sort.
    """
    keys = list(keys)
    in_cell = W.partitionBy(*keys, "_cell").orderBy(order)
    d = with_grid(df, keys, F.col(order), cells=cells).select(
        *keys, "_cell", pos, neg, (F.col(pos) * (_before(in_cell, neg) + F.col(neg) / 2.0)).alias("area")
    )
    total = [F.sum(c).alias(c) for c in (pos, neg, "area")]
    by_cell = d.groupBy(*keys, "_cell").agg(*total)
    in_key = W.partitionBy(*keys).orderBy("_cell")
    by_cell = by_cell.select(*keys, pos, neg, (F.col("area") + F.col(pos) * _before(in_key, neg)).alias("area"))
    return by_cell.groupBy(*keys).agg(*total)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    position: Column | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per probability.

    Values collapse to (value, count) before anything is ordered, so a hot value is one row.
    """
    keys = list(keys)
    names = list(names or [f"q{i}" for i in range(len(probabilities))])
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    run = running_totals(counts, keys, value, ["n"], [F.col(value), squash(F.col(value))] if position is None else position)
    v, cum, tot = F.col(value), F.col("cum_n"), F.col("tot_n")
    aggs = []
    for i, q in enumerate(probabilities):
        rank = F.lit(float(q)) * (tot - 1)
        aggs.append(F.min(F.when(cum > F.floor(rank), v)).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(cum > F.ceil(rank), v)).alias(f"_hi{i}"))
    got = run.groupBy(*keys).agg(F.max("tot_n").alias("_n"), *aggs)
    out = []
    for i, (q, name) in enumerate(zip(probabilities, names)):
        rank = F.lit(float(q)) * (F.col("_n") - 1)
        frac = rank - F.floor(rank)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(name))
    return got.select(*keys, *out)


def quantile_points(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float],
                    position: Column | None = None) -> DataFrame:
    """Same quantiles in long form (keys, prob, value), for grids of many probabilities."""
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    run = running_totals(counts, keys, value, ["n"], [F.col(value), squash(F.col(value))] if position is None else position)
    cum, before, top = F.col("cum_n"), F.col("cum_n") - F.col("n"), F.col("tot_n") - 1

    def touches(q: Column) -> Column:
        lo, hi = F.floor(q * top), F.ceil(q * top)
        return ((lo >= before) & (lo < cum)) | ((hi >= before) & (hi < cum))

    grid = F.array(*[F.lit(float(q)) for q in probabilities])
    hits = run.select(*keys, F.col(value).alias("_v"), "cum_n", "tot_n", F.explode(F.filter(grid, touches)).alias("prob"))
    rank = F.col("prob") * top
    got = hits.groupBy(*keys, "prob").agg(
        F.min(F.when(F.col("cum_n") > F.floor(rank), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("cum_n") > F.ceil(rank), F.col("_v"))).alias("_hi"),
        F.max(rank - F.floor(rank)).alias("_f"),
    )
    return got.select(*keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"))


def dense_index(df: DataFrame, keys: Sequence[str], item: str, slot: Column) -> DataFrame:
    """Number the distinct ``item`` values 0..n-1 inside each key, ordered by a hash slot.

    ``slot`` is a uniform in [0, 1) derived from the item. Adds ``idx`` and ``n``.
    """
    keys = list(keys)
    d = df.select(*keys, item).distinct().withColumn("_slot", slot).withColumn("_one", F.lit(1).cast("bigint"))
    run = running_totals(d, keys, "_slot", ["_one"], ties=[item])
    return run.select(*keys, item, (F.col("cum__one") - 1).alias("idx"), F.col("tot__one").alias("n"))
