"""Decision thresholds and distribution-free risk control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.operators.metrics import score_ledger
from routelens.operators.ordered import quantile_points, running_totals


def cut_table(df: DataFrame, keys: Sequence[str], score="p", label="y") -> DataFrame:
    """Confusion counts of the rule ``score >= t`` at every distinct score ``t``.

    One ordered pass serves every threshold rule: at ``t`` the positives and negatives at or
    above it are the reverse running totals.
    """
    run = running_totals(score_ledger(df, keys, score, label), keys, "score", ["pos", "neg"], descending=True)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return run.select(
        *keys, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        (F.col("tot_neg") - fp).alias("tn"), (F.col("tot_pos") - tp).alias("fn"),
    )


def youden_threshold(df, keys, score="p", label="y") -> DataFrame:
    """First (highest) score that maximises TPR - FPR, clipped to [0, 1]; 0.5 for one class.

    The curve starts above the top score, where the difference is 0: without a gain nothing is flagged and the threshold is 1.
    """
    cuts = cut_table(df, keys, score, label)
    P, N = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    j = F.col("tp") / P - F.col("fp") / N
    best = cuts.groupBy(*keys).agg(
        F.max_by("threshold", F.struct(F.round(F.when((P > 0) & (N > 0), j), 12), F.col("threshold"))).alias("t"),
        F.max(F.round(F.when((P > 0) & (N > 0), j), 12)).alias("gain"),
        F.max((P > 0) & (N > 0)).alias("two"),
    )
    value = F.when(F.col("gain") <= 0, F.lit(1.0)).when(F.col("two"), F.least(F.greatest(F.col("t"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.5))
    return best.select(*keys, value.alias("threshold"))


def bacc_threshold(df, keys, score="p", label="y") -> DataFrame:
    """Best balanced accuracy; ties go to the highest specificity, then the highest threshold."""
    cuts = cut_table(df, keys, score, label)
    sens = F.col("tp") / (F.col("tp") + F.col("fn"))
    spec = F.col("tn") / (F.col("fp") + F.col("tn"))
    order = F.struct(F.round((sens + spec) / 2.0, 9), F.round(spec, 9), F.col("threshold"))
    return cuts.groupBy(*keys).agg(F.max_by("threshold", order).alias("threshold"))


def mcc_threshold(df, keys, score="p", label="y", candidates: int = 97) -> DataFrame:
    """Best MCC over evenly spaced score quantiles; the lowest candidate wins a tie."""
    keys = list(keys)
    step = 0.96 / (candidates - 1)
    probs = [0.02 + step * i for i in range(candidates)]
    cand = quantile_points(df, keys, score, probs, position=F.col(score)).select(*keys, F.col("value").alias("threshold"))
    # counts at a candidate that lies between scores equal those at the next score above it:
    # union candidates into the ledger as empty rows and read the reverse running totals there
    led = score_ledger(df, keys, score, label).withColumn("cand", F.lit(0))
    marks = cand.select(
        *keys, F.col("threshold").alias("score"), F.lit(0).cast("bigint").alias("pos"),
        F.lit(0).cast("bigint").alias("neg"), F.lit(1).alias("cand"),
    )
    both = led.unionByName(marks).groupBy(*keys, "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("cand").alias("cand")
    )
    run = running_totals(both, keys, "score", ["pos", "neg"], descending=True).filter(F.col("cand") == 1)
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    fn, tn = F.col("tot_pos") - tp, F.col("tot_neg") - fp
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)).otherwise(F.lit(0.0))
    return run.groupBy(*keys).agg(
        F.max_by("score", F.struct(F.round(mcc, 12), -F.col("score"))).alias("threshold"),
        F.max(F.round(mcc, 12)).alias("mcc"),
    )


def conformal_threshold(df, keys, score="p", label="y", delta=0.1, group: str | None = None) -> DataFrame:
    """Finite-sample upper quantile of the unsupported scores for the rule ``p <= tau``.

    With ``group`` the unit is the worst unsupported score of each source group. The order
    statistic is number ceil((n + 1)(1 - delta)); NULL stands for an unbounded threshold.
    """
    keys = list(keys)
    bad = df.filter((F.col(label) == 0) & F.col(score).isNotNull())
    if group is not None:
        bad = bad.groupBy(*keys, group).agg(F.max(score).alias(score))
    counts = bad.groupBy(*keys, score).agg(F.count("*").alias("n"))
    run = running_totals(counts, keys, score, ["n"])
    k = F.ceil((F.col("tot_n") + 1) * F.lit(1.0 - delta))
    return run.groupBy(*keys).agg(
        F.max("tot_n").alias("n_units"), F.min(F.when(F.col("cum_n") >= k, F.col(score))).alias("tau")
    )


def gamma_curve(sentences: DataFrame, floor: float = 0.0) -> DataFrame:
    """Acceptance risk at every candidate gamma, from one ordered pass.

    A sentence is accepted when its base decision accepts and its confidence is strictly above
    gamma; a summary is lost when any of its accepted sentences is unsupported; a document's
    loss is the mean over its summaries. Each loss is a step that ends at one confidence value,
    so every curve is a reverse running total of step heights: no copy of the data per gamma.

    Input columns: doc_group_key, summary_id, generator_id, confidence, base_accept,
    label_supported. The candidates are the floor, 1 and every confidence not below the floor.
    """
    live = F.col("base_accept")
    wrong = live & (F.col("label_supported") == 0)
    summary = sentences.groupBy("doc_group_key", "summary_id", "generator_id").agg(
        F.max(F.when(live, F.col("confidence"))).alias("top_accept"),
        F.max(F.when(wrong, F.col("confidence"))).alias("top_wrong"),
    )
    size = summary.groupBy("doc_group_key").agg(F.count("*").alias("size"), F.max("top_wrong").alias("doc_wrong"))
    sized = summary.join(size.select("doc_group_key", "size"), "doc_group_key")
    names = ["accept", "wrong", "kept", "lost", "lost_w", "doc_lost", "active", "sentences", "summaries", "documents"]

    def steps(df: DataFrame, at, **heights) -> DataFrame:
        cols = [F.coalesce(heights.get(n, F.lit(0.0)).cast("double"), F.lit(0.0)).alias(n) for n in names]
        return df.select(F.coalesce(at, F.lit(0.0)).alias("gamma"), *cols)

    one = F.lit(1.0)
    has = lambda c: F.when(F.col(c).isNotNull(), one)
    events = (
        steps(sentences, F.col("confidence"), accept=F.when(live, one), wrong=F.when(wrong, one), active=one, sentences=one)
        .unionByName(steps(sized, F.col("top_accept"), kept=has("top_accept"), summaries=one))
        .unionByName(steps(sized, F.col("top_wrong"), lost=has("top_wrong"),
                           lost_w=F.when(F.col("top_wrong").isNotNull(), one / F.col("size"))))
        .unionByName(steps(size, F.col("doc_wrong"), doc_lost=has("doc_wrong"), documents=one))
        .withColumn("cand", F.lit(0))
    )
    marks = sentences.select(F.col("confidence").alias("gamma")).filter(F.col("gamma") >= floor).distinct()
    ends = sentences.sparkSession.range(2).select((F.lit(floor) + F.col("id") * F.lit(1.0 - floor)).alias("gamma"))
    cand = marks.unionByName(ends).select("gamma", *[F.lit(0.0).alias(n) for n in names], F.lit(1).alias("cand"))
    led = events.unionByName(cand).groupBy(F.lit("ALL").alias("scope"), "gamma").agg(
        *[F.sum(n).alias(n) for n in names], F.max("cand").alias("cand")
    )
    run = running_totals(led, ["scope"], "gamma", names, descending=True).filter(F.col("cand") == 1)
    above = lambda n: F.col(f"cum_{n}") - F.col(n)
    D, S, M = F.col("tot_documents"), F.col("tot_sentences"), F.col("tot_summaries")
    risk = above("lost_w") / D
    return run.select(
        "gamma",
        above("active").cast("bigint").alias("sentence_activate_n"),
        above("accept").cast("bigint").alias("sentence_accept_n"),
        above("wrong").cast("bigint").alias("sentence_wrong_n"),
        (above("accept") / S).alias("sentence_coverage"),
        (above("kept") / M).alias("summary_coverage"),
        (above("lost") / M).alias("summary_risk"),
        risk.alias("document_risk"),
        (above("doc_lost") / D).alias("document_max_rate"),
        ((D * risk + 1.0) / (D + 1.0)).alias("crc_bound"),
    )


def gamma_choice(curve: DataFrame, alpha: float) -> DataFrame:
    """Smallest feasible gamma; the no-accept fallback is gamma = 1 with bound 0."""
    ok = F.round(F.col("crc_bound"), 12) <= alpha
    first = F.struct("gamma", "sentence_accept_n", "crc_bound", "document_risk")
    got = curve.agg(F.min(F.when(ok, first)).alias("s"))
    good = F.coalesce(F.col("s.sentence_accept_n") > 0, F.lit(False))
    return got.select(
        F.when(good, F.col("s.gamma")).otherwise(F.lit(1.0)).alias("gamma"),
        F.when(good, F.col("s.crc_bound")).otherwise(F.lit(0.0)).alias("bound"),
        F.when(good, F.col("s.document_risk")).otherwise(F.lit(0.0)).alias("document_risk"),
        F.when(good, F.lit("CALIBRATED")).otherwise(F.lit("FALLBACK_NO_ACCEPT")).alias("status"),
    )


def gamma_by_generator(sentences: DataFrame, gamma: float) -> DataFrame:
    """Wrong-accept rate of summaries per generator at one acceptance level."""
    hit = F.col("base_accept") & (F.col("confidence") > gamma)
    s = sentences.groupBy("doc_group_key", "summary_id", "generator_id").agg(
        F.bool_or(hit).alias("any_accept"), F.bool_or(hit & (F.col("label_supported") == 0)).alias("wrong")
    )
    return s.groupBy("generator_id").agg(
        F.count("*").alias("summaries"), F.avg(F.col("any_accept").cast("double")).alias("coverage"),
        F.avg(F.col("wrong").cast("double")).alias("risk"),
    )
