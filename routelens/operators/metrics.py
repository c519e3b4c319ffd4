"""Evaluation metrics, all keyed: one output row per value of ``keys``.

Rank metrics are exact under ties. They start from ``score_ledger``, which collapses rows to
(keys, score, positives, negatives) with map-side combining, so their cost follows the number
of distinct scores, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routelens.config import AURC_POINTS, COVERAGE_LEVELS, ECE_BINS
from routelens.operators.ordered import CELLS, join_keys, order_area, quantiles, running_totals, squash


def score_ledger(df: DataFrame, keys: Sequence[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """Distinct scores with (weighted) positive and negative counts."""
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    zero = F.lit(0).cast("bigint")
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(
            F.sum(F.when(F.col(label) == 1, w).otherwise(zero)).alias("pos"),
            F.sum(F.when(F.col(label) == 1, zero).otherwise(w)).alias("neg"),
        )
    )


def auroc_from_ledger(ledger: DataFrame, keys: Sequence[str], name: str = "auroc", cells: int = CELLS) -> DataFrame:
    area = order_area(ledger, keys, "score", "pos", "neg", cells)
    value = F.when(
        (F.col("pos") > 0) & (F.col("neg") > 0), F.col("area") / (F.col("pos").cast("double") * F.col("neg"))
    )
    return area.select(*keys, value.alias(name), (F.col("pos") + F.col("neg")).alias("n_scored"))


def auroc(df, keys, score="p", label="y", weight=None, name="auroc") -> DataFrame:
    """Area under the ROC curve with averaged ties; NULL for one-class keys."""
    return auroc_from_ledger(score_ledger(df, keys, score, label, weight), keys, name).drop("n_scored")


def average_precision_unsupported(df, keys, score="p", label="y", name="auprc_unsup") -> DataFrame:
    """Average precision of the negative class ranked by ``1 - p``."""
    led = score_ledger(df, keys, score, label)
    run = running_totals(led, keys, "score", ["pos", "neg"])
    hit = F.col("neg").cast("double") / F.col("tot_neg")
    precision = F.col("cum_neg").cast("double") / (F.col("cum_neg") + F.col("cum_pos"))
    return run.groupBy(*keys).agg(F.sum(F.when(F.col("tot_neg") > 0, hit * precision)).alias(name))


def confusion_aggs(label: Column, decision: Column) -> list[Column]:
    return [
        F.count_if((label == 1) & (decision == 1)).alias("tp"),
        F.count_if((label == 0) & (decision == 1)).alias("fp"),
        F.count_if((label == 0) & (decision == 0)).alias("tn"),
        F.count_if((label == 1) & (decision == 0)).alias("fn"),
    ]


def _ratio(a: Column, b: Column, empty: Column | None = None) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(None).cast("double") if empty is None else empty)


def decision_columns() -> dict[str, Column]:
    """Closed forms over tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    zero = F.lit(0.0)
    sens, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    f1_pos = _ratio(2 * tp, 2 * tp + fp + fn, zero)
    f1_neg = _ratio(2 * tn, 2 * tn + fp + fn, zero)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)).otherwise(zero)
    return {
        "acc": (tp + tn) / (tp + fp + tn + fn),
        "bacc": (F.coalesce(sens, spec) + F.coalesce(spec, sens)) / 2.0,
        "mcc": mcc,
        "f1_macro": (f1_pos + f1_neg) / 2.0,
        "f1_unsup": f1_neg,
        "prec_unsup": _ratio(tn, tn + fn),
        "rec_unsup": spec,
    }


def decision_metrics(df, keys, label="y", decision="d") -> DataFrame:
    """Accuracy, balanced accuracy, MCC, macro F1 and unsupported precision / recall / F1."""
    counts = df.groupBy(*keys).agg(*confusion_aggs(F.col(label), F.col(decision)))
    return counts.select(*keys, "tp", "fp", "tn", "fn", *[c.alias(n) for n, c in decision_columns().items()])


def calibration_bins(df, keys, score="p", label="y", bins: int = ECE_BINS, right: bool = False) -> DataFrame:
    """Equal-width reliability bins; ``right`` puts an edge value in the lower bin."""
    p = F.col(score)
    raw = (F.ceil(p * bins) - 1) if right else F.floor(p * bins)
    idx = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    return df.groupBy(*keys, idx.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("mean_y")
    )


def calibration_error(df, keys, score="p", label="y", bins: int = ECE_BINS, right: bool = False) -> DataFrame:
    """Expected and maximum calibration error."""
    b = calibration_bins(df, keys, score, label, bins, right)
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    return b.groupBy(*keys).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def proper_scores(df, keys, score="p", label="y", floor: float = 1e-7) -> DataFrame:
    """Brier score and negative log likelihood."""
    p, y = F.col(score), F.col(label).cast("double")
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    nll = -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))
    return df.groupBy(*keys).agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(nll).alias("nll"))


def latency_summary(df, keys, ms="ms") -> DataFrame:
    """Mean, p50 / p95 / p99 (linear interpolation) and single-stream throughput."""
    mean = df.groupBy(*keys).agg(F.avg(ms).alias("mean_ms"), F.count(ms).alias("n"))
    tail = quantiles(df, keys, ms, (0.5, 0.95, 0.99), names=("p50_ms", "p95_ms", "p99_ms"))
    return join_keys(mean, tail, keys, "left").withColumn("qps", F.lit(1000.0) / F.col("mean_ms"))


def _confidence_cells(df, keys, score, ok, tie):
    """Cells of the confidence order: ties in confidence are cut by a hash of the tie key."""
    slot = F.conv(F.substring(F.sha2(F.col(tie), 256), 1, 8), 16, 10).cast("bigint")
    d = df.select(
        *keys, F.abs(F.col(score) - 0.5).alias("conf"), F.col(ok).cast("bigint").alias("ok"), slot.alias("slot"),
        F.col(tie).alias("_tie"),
    ).withColumn("part", F.floor(F.col("slot") / F.lit(4194304)))
    cells = d.groupBy(*keys, "conf", "part").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"))
    run = running_totals(cells, keys, "conf", ["n", "ok"], F.col("conf") * 2.0, descending=True, ties=["part"])
    return d, run


def risk_coverage_points(df, keys, targets, score="p", ok="ok", tie="episode_key") -> DataFrame:
    """Selective accuracy at given coverages, most confident rows first.

    ``targets`` is a list of (name, numerator, denominator): the cut is
    ``max(half_even_round(num * n / den), 1)`` rows. Equal confidences are ordered by the hash
    of the tie key, then the key. Only the cells a cut falls into are ever ranked row by row.
    """
    keys = list(keys)
    d, run = _confidence_cells(df, keys, score, ok, tie)
    cuts = F.explode(
        F.array(*[
            F.struct(
                F.lit(name).alias("point"),
                F.greatest(F.bround(F.lit(float(a)) * F.col("tot_n") / F.lit(float(b)), 0), F.lit(1.0))
                .cast("bigint").alias("cut"),
            )
            for name, a, b in targets
        ])
    )
    before_n, before_ok = F.col("cum_n") - F.col("n"), F.col("cum_ok") - F.col("ok")
    hit = (
        run.select(*keys, "conf", "part", before_n.alias("b_n"), before_ok.alias("b_ok"), "n", cuts.alias("t"))
        .filter((F.col("t.cut") > F.col("b_n")) & (F.col("t.cut") <= F.col("b_n") + F.col("n")))
        .select(*keys, "conf", "part", "b_n", "b_ok", F.col("t.point").alias("point"), F.col("t.cut").alias("cut"))
    )
    cell_keys = [*keys, "conf", "part"]
    inside = join_keys(d, hit.select(*cell_keys).distinct(), cell_keys, "left_semi")
    w = W.partitionBy(*cell_keys).orderBy("slot", "_tie").rowsBetween(W.unboundedPreceding, 0)
    ranked = inside.select(*cell_keys, F.count("*").over(w).alias("r"), F.sum("ok").over(w).alias("c_ok"))
    at = join_keys(hit, ranked, cell_keys).filter(F.col("r") == F.col("cut") - F.col("b_n"))
    return at.select(*keys, "point", "cut", ((F.col("b_ok") + F.col("c_ok")).cast("double") / F.col("cut")).alias("acc"))


def risk_coverage(df, keys, score="p", ok="ok", tie="episode_key") -> DataFrame:
    """Selective error at the fixed coverages and AURC over evenly spaced cuts."""
    keys = list(keys)
    targets = [(f"selerr_{int(c * 100)}", c, 1.0) for c in COVERAGE_LEVELS]
    targets += [(f"dense_{i}", i, AURC_POINTS) for i in range(1, AURC_POINTS + 1)]
    pts = risk_coverage_points(df, keys, targets, score, ok, tie)
    err = F.lit(1.0) - F.col("acc")
    return pts.groupBy(*keys).agg(
        *[F.max(F.when(F.col("point") == n, err)).alias(n) for n, *_ in targets[: len(COVERAGE_LEVELS)]],
        F.avg(F.when(F.col("point").startswith("dense_"), err)).alias("aurc"),
    )


def rank_correlations(df, keys, score="p", label="y") -> DataFrame:
    """Point-biserial, Spearman (averaged ranks) and Kendall tau-b against a binary label."""
    keys = list(keys)
    led = score_ledger(df, keys, score, label).withColumn("n", F.col("pos") + F.col("neg"))
    run = running_totals(led, keys, "score", ["n", "pos", "neg"])
    dbl = lambda c: F.col(c).cast("double")
    n, pos = dbl("n"), dbl("pos")
    # ranks are centred on their known mean to keep the sums small
    r = dbl("cum_n") - n + (n + 1.0) / 2.0 - (dbl("tot_n") + 1.0) / 2.0
    s = F.col("score")
    agg = run.groupBy(*keys).agg(
        F.max("tot_n").cast("double").alias("N"), F.max("tot_pos").cast("double").alias("P"),
        F.sum(n * r * r).alias("rr"), F.sum(pos * r).alias("ry"),
        F.sum(n * s).alias("sx"), F.sum(n * s * s).alias("sxx"), F.sum(pos * s).alias("sxy"),
        F.sum(n * (n - 1.0) / 2.0).alias("tx"),
        F.sum(pos * (dbl("cum_neg") - dbl("neg") + dbl("neg") / 2.0)).alias("area"),
    )
    N, P = F.col("N"), F.col("P")
    yy = P - P * P / N
    Q = N - P
    n0 = N * (N - 1.0) / 2.0
    ty = P * (P - 1.0) / 2.0 + Q * (Q - 1.0) / 2.0
    xx = F.col("sxx") - F.col("sx") * F.col("sx") / N
    ok = (P > 0) & (Q > 0)
    return agg.select(
        *keys,
        F.when(ok & (xx > 0), (F.col("sxy") - F.col("sx") * P / N) / F.sqrt(xx * yy)).alias("point_biserial"),
        F.when(ok & (F.col("rr") > 0), F.col("ry") / F.sqrt(F.col("rr") * yy)).alias("spearman"),
        F.when(ok & (n0 > F.col("tx")), (2.0 * F.col("area") - P * Q) / F.sqrt((n0 - F.col("tx")) * (n0 - ty)))
        .alias("kendall_tau_b"),
    )


def macro_auroc(df, keys, corpus="dataset_key", score="p", label="y") -> DataFrame:
    """Mean, size-weighted mean and worst of the per-corpus AUROCs; one-class corpora are left out."""
    keys = list(keys)
    per = auroc_from_ledger(score_ledger(df, [*keys, corpus], score, label), [*keys, corpus])
    return per.filter(F.col("auroc").isNotNull()).groupBy(*keys).agg(
        F.avg("auroc").alias("macro_auroc"),
        (F.sum(F.col("auroc") * F.col("n_scored")) / F.sum("n_scored")).alias("weighted_auroc"),
        F.min("auroc").alias("worst_auroc"),
        F.min_by(corpus, F.struct("auroc", corpus)).alias("worst_corpus"),
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, position: Column | None = None) -> DataFrame:
    """Distinct values with their averaged rank (ascending) and multiplicity."""
    led = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    run = running_totals(led, keys, value, ["n"], squash(F.col(value)) if position is None else position)
    return run.select(*keys, value, "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))
