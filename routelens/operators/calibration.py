"""Score calibration: Platt scaling with pyspark.ml. Isotonic recalibration is in ``isotonic``."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.functions.expr import logit, platt
from routelens.operators.heads import packed


def fit_platt(df: DataFrame, score: str, label: str = "label_supported", available: str | None = None) -> tuple[float, float]:
    """(intercept, slope) of an L2-penalised logistic fit on the logit of the clipped score.

    Only available rows take part. The penalty equals C = 1 of the summed loss, so it is 1/n of
    the mean loss. A one-class fit gives slope 0 and exactly that class; no rows give one half.
    """
    d = df if available is None else df.filter(F.col(available))
    d = d.filter(F.col(score).isNotNull()).select(F.col(label).cast("double").alias("label"), logit(F.col(score)).alias("z"))
    n, pos = d.agg(F.count("*"), F.sum("label")).first()
    if not n or pos in (0.0, float(n)):
        return (0.0 if not n else float("inf") if pos else float("-inf")), 0.0
    v = VectorAssembler(inputCols=["z"], outputCol="features").transform(d)
    m = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=30, tol=1e-9).fit(v)
    return float(m.intercept), float(m.coefficients[0])


def fit_calibrators(df: DataFrame, pool: Sequence[str], label: str = "label_supported") -> dict[str, tuple[float, float]]:
    """One calibrator per action over the wide score matrix; the small fits run side by side."""
    x = df.select(label, *[f"{f}__{a}" for a in pool for f in ("score", "available")])
    x = packed(x).persist()
    with ThreadPoolExecutor(len(pool)) as ex:
        fits = list(ex.map(lambda a: fit_platt(x, f"score__{a}", label, f"available__{a}"), pool))
    x.unpersist()
    return dict(zip(pool, fits))


def apply_calibrators(df: DataFrame, fitted: dict[str, tuple[float, float]], zero_unavailable: bool = False) -> DataFrame:
    """Add ``cal__a``: a plain sigmoid expression, no model object in the plan."""
    cols = {}
    for a, (b0, b1) in fitted.items():
        p = platt(F.col(f"score__{a}"), b0, b1)
        cols[f"cal__{a}"] = F.when(F.col(f"available__{a}"), p).otherwise(F.lit(0.0)) if zero_unavailable else p
    return df.withColumns(cols)
