"""Row-local expressions over one column per action.

The pool is known when the plan is built, so loops over actions are unrolled into plain
expressions: they stay in generated code, and no array or lambda is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def clip(x: Column, lo: float = EPS, hi: float = 1 - EPS) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def rnd(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def row_max(values: Sequence[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def row_min(values: Sequence[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def masked(values: Sequence[Column], mask: Sequence[Column] | None) -> list[Column]:
    if mask is None:
        return list(values)
    return [F.when(m, v) for v, m in zip(values, mask)]


def first_argmax(values: Sequence[Column], mask: Sequence[Column] | None = None) -> Column:
    """Index of the first maximum among the allowed entries; NULL if none is allowed."""
    allowed = masked(values, mask)
    best = row_max(allowed)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(allowed))):
        out = F.when(allowed[i] == best, F.lit(i)).otherwise(out)
    return out


def pick(values: Sequence[Column], index: Column) -> Column:
    """The entry at a computed position."""
    out = F.when(index == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(index == i, v)
    return out


def top_two_margin(values: Sequence[Column]) -> Column:
    """Largest minus second largest."""
    ordered = F.sort_array(F.array(*values), asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def logit(p: Column) -> Column:
    c = clip(p)
    return F.log(c / (F.lit(1.0) - c))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def platt(score: Column, intercept: Column | float, slope: Column | float) -> Column:
    """Calibrated probability; a missing score counts as 0.5."""
    a = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    b = slope if isinstance(slope, Column) else F.lit(float(slope))
    return sigmoid(a + b * logit(F.coalesce(score, F.lit(0.5))))


def discounts(beta: Column, costs: Sequence[Column]) -> list[Column]:
    """exp(-beta * cost / largest cost) per action; all ones if no cost is positive."""
    top = row_max(costs)
    return [F.when(top > 0, F.exp(-beta * c / top)).otherwise(F.lit(1.0)) for c in costs]


def vector_entropy(values: Sequence[Column]) -> Column:
    """Entropy of a non-negative score vector divided by ln(n); uniform if all are zero."""
    n = len(values)
    if n <= 1:
        return F.lit(0.0)
    import functools
    import math
    import operator

    total = functools.reduce(operator.add, values)
    terms = [F.when(v > 0, (v / total) * F.log(v / total)).otherwise(F.lit(0.0)) for v in values]
    return F.when(total > 0, -functools.reduce(operator.add, terms) / F.lit(math.log(n))).otherwise(F.lit(1.0))


def quality_gain(quality: Column, cost: Column, floor: float, ceiling: float, cheap: float, dear: float) -> Column:
    """Balance score: one minus the scaled distance to (best quality, lowest log cost)."""
    import math

    q = (quality - F.lit(floor)) / F.lit(ceiling - floor)
    c = (F.log(F.greatest(cost, F.lit(1e-6))) - F.lit(math.log(cheap))) / F.lit(math.log(dear) - math.log(cheap))
    one = F.lit(1.0)
    return one - F.sqrt((one - q) * (one - q) + c * c) / F.lit(math.sqrt(2.0))
