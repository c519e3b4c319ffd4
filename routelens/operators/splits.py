"""Group-safe splits: a source group is never divided between the sides of a split.

Groups are numbered inside their stratum by ``ordered.dense_index``, so a stratum that holds
a third of all groups is still numbered in parallel. Orders come from hashes of the seed and
the group, never from row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions.hashing import uniform
from routelens.operators.ordered import dense_index


def group_strata(df: DataFrame, group="content_doc_key", corpus="dataset_key", label="label_supported") -> DataFrame:
    """One row per group: its corpus and majority label (a mean of exactly 0.5 counts as 0)."""
    return df.groupBy(group).agg(
        F.min(corpus).alias("stratum_corpus"),
        F.bround(F.avg(F.col(label).cast("double")), 0).cast("int").alias("stratum_label"),
    )


def ordered_groups(groups: DataFrame, strata: Sequence[str], seed: int, group="content_doc_key", tag="split") -> DataFrame:
    """Groups with their position ``idx`` and size ``n`` inside the stratum."""
    return dense_index(groups, strata, group, uniform(tag, seed, F.col(group)))


def take(n: Column, fraction: Column | float, least: int) -> Column:
    """Half-even rounded share of ``n``, at least ``least``."""
    frac = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return F.greatest(F.bround(n * frac, 0), F.lit(float(least)))


def holdout_groups(df, seed: int, fraction: float = 0.2, group="content_doc_key") -> DataFrame:
    """Stratified group hold-out: (group, held)."""
    g = ordered_groups(group_strata(df, group), ["stratum_corpus", "stratum_label"], seed, group)
    return g.select(group, (F.col("idx") < take(F.col("n"), fraction, 1)).alias("held"))


def fold_groups(df, seed: int, k: int, group="content_doc_key", strata=("stratum_corpus", "stratum_label"),
                tag="fold") -> DataFrame:
    """Stratified group k-fold: groups are dealt round-robin inside each stratum."""
    g = ordered_groups(group_strata(df, group), list(strata), seed, group, tag)
    return g.select(group, (F.col("idx") % k).alias("fold"))


def rotations(folds: DataFrame, k: int) -> DataFrame:
    """Every rotation t: fold t tests, fold t+1 (mod k) validates, the rest train."""
    gap = F.pmod(F.col("fold") - F.col("rotation"), F.lit(k))
    x = folds.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return x.withColumn("side", F.when(gap == 0, "test").when(gap == 1, "validation").otherwise("train"))


def leave_one_corpus_out(df: DataFrame, corpora: Sequence[str], corpus="dataset_key") -> DataFrame:
    """One copy per held-out corpus with its side."""
    x = df.withColumn("heldout", F.explode(F.array(*[F.lit(c) for c in corpora])))
    return x.withColumn("side", F.when(F.col(corpus) == F.col("heldout"), "test").otherwise("train"))


def validation_ladder(df: DataFrame, seed: int, fractions=(0.2, 0.3, 0.4), minority: int = 5,
                      group="content_doc_key", corpus="dataset_key", label="label_supported") -> DataFrame:
    """Per corpus: the first fraction whose held part has both classes and enough of the rarer one."""
    groups = df.select(corpus, group).distinct()
    pos = dense_index(groups, [corpus], group, uniform("ladder", seed, F.col(group)))
    counts = df.groupBy(corpus, group).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    steps = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    x = pos.join(counts, [corpus, group]).withColumn("fraction", steps)
    held = x.filter(F.col("idx") < take(F.col("n"), F.col("fraction"), 1))
    tally = held.groupBy(corpus, "fraction").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    valid = F.least("pos", "neg") >= minority
    return tally.groupBy(corpus).agg(
        F.min(F.when(valid, F.col("fraction"))).alias("fraction"),
        F.min_by(F.least("pos", "neg"), F.when(valid, F.col("fraction"))).alias("minority"),
    )


def subsample_groups(df: DataFrame, seed: int, fraction: float, group="content_doc_key") -> DataFrame:
    """The first share of all groups in hash order (at least two); larger shares contain smaller ones."""
    g = df.select(F.lit("ALL").alias("scope"), group).distinct()
    pos = dense_index(g, ["scope"], group, uniform("curve", seed, F.col(group)))
    return pos.filter(F.col("idx") < take(F.col("n"), fraction, 2)).select(group)


def ordered_rows(df: DataFrame, corpus: str, key: str, seed: int, tag: str) -> DataFrame:
    """Rows with their position in hash order inside the corpus."""
    pos = dense_index(df, [corpus], key, uniform(tag, seed, F.col(key)))
    return df.join(pos, [corpus, key])


def few_shot(df: DataFrame, target: str, k: int, seed: int, corpus="dataset_key", key="episode_key") -> DataFrame:
    """All other corpora plus the first k rows of the target corpus in hash order."""
    base = df.filter(F.col(corpus) != target)
    shots = ordered_rows(df.filter(F.col(corpus) == target), corpus, key, seed, "fewshot")
    return base.unionByName(shots.filter(F.col("idx") < k).drop("idx", "n"))


def shot_counts(rows: int, counts: Sequence[int], fractions: Sequence[float]) -> list[tuple]:
    """(curve, fraction, k) of every point for a target of so many rows: counts up to all of them, and rounded shares."""
    by_count = [("count", None, k) for k in sorted({min(k, rows) for k in (*counts, rows)})]
    return by_count + [("fraction", f, round(f * rows)) for f in fractions]


def balanced_sample(df: DataFrame, total: int, corpora: int, seed: int, corpus="dataset_key", key="episode_key") -> DataFrame:
    """``total // corpora`` rows of every corpus in hash order."""
    rows = ordered_rows(df, corpus, key, seed, "rerun")
    return rows.filter(F.col("idx") < total // corpora).drop("idx", "n")
