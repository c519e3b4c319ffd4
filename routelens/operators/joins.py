"""Joins with their cardinality stated and checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    """First row per key in the given order, by a mergeable aggregate (no per-key sort)."""
    rest = [c for c in df.columns if c not in keys]
    # absent entries must not hide the chosen row, so the whole row travels as one struct
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    """Last row per key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def overlay(base: DataFrame, update: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that lets a non-null new value replace the old one."""
    new = update.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    j = base.join(new, list(keys), "left")
    keep = [c for c in base.columns if c not in columns]
    return j.select(*keep, *[
        (F.coalesce(f"_new_{c}", c) if c in base.columns else F.col(f"_new_{c}")).alias(c) for c in columns
    ])


def join_audit(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, matches, left-only, right-only and duplicated keys of a join that must be one to one."""
    l = left.groupBy(*keys).agg(F.count("*").alias("l"))
    r = right.groupBy(*keys).agg(F.count("*").alias("r"))
    j = l.join(r, list(keys), "full_outer").select(F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    n, m = F.col("l"), F.col("r")
    return j.agg(
        F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.count_if((n > 0) & (m > 0)).alias("matched_keys"),
        F.count_if(m == 0).alias("left_only"), F.count_if(n == 0).alias("right_only"),
        F.count_if(n > 1).alias("left_duplicated"), F.count_if(m > 1).alias("right_duplicated"),
    )


def span_overlap_labels(sentences: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Sentence label = no unsupported span overlaps it (half-open character intervals).

    Spans are grouped per response and the overlap test runs inside the row, so a response
    with many sentences and spans does not multiply into pairs.
    """
    per = spans.groupBy(key).agg(F.collect_list(F.struct("span_start", "span_end")).alias("_spans"))
    j = sentences.join(per, key, "left")
    hit = F.filter(
        F.coalesce("_spans", F.array().cast("array<struct<span_start:int,span_end:int>>")),
        lambda s: (s["span_start"] < F.col("sent_end")) & (s["span_end"] > F.col("sent_start")),
    )
    return j.withColumn("overlaps", F.size(hit)).withColumn(
        "label_supported", (F.col("overlaps") == 0).cast("int")).drop("_spans")


def shared_content_pairs(df: DataFrame, content: str, corpus: str) -> DataFrame:
    """Number of contents shared by each pair of corpora.

    Only distinct (content, corpus) cells take part and a content's corpora are a bounded
    dimension, so the pairs of one content number at most corpora squared.
    """
    sets = df.groupBy(content).agg(F.array_sort(F.collect_set(corpus)).alias("c")).filter(F.size("c") > 1)
    left = sets.select("c", F.posexplode("c").alias("i", "corpus_a"))
    both = left.select("corpus_a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("corpus_b"))
    return both.groupBy("corpus_a", "corpus_b").agg(F.count("*").alias("shared"))


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Paired comparison of two runs on the shared keys."""
    j = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys))
    d = F.col("a") - F.col("b")
    return j.agg(
        F.count("*").alias("shared"), F.max(F.abs(d)).alias("max_abs_delta"), F.avg(d).alias("mean_delta"),
        F.corr("a", "b").alias("correlation"), F.bool_and(d == 0).alias("identical"),
    )


def gated_labels(frame: DataFrame, labels: DataFrame, keys: Sequence[str], columns: Sequence[str], with_labels: bool) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with its labels if the gate is open, and the rules a writer has to check: then no row may lack one.

    Behind a closed gate the frame must not hold a label column at all.
    """
    held = [c for c in columns if c in frame.columns]
    if held:
        raise ValueError(f"the frame already holds {held}")
    if not with_labels:
        return frame, {}
    joined = frame.join(labels.select(*keys, *columns), list(keys), "left")
    return joined, {f"hole_in_{c}": F.col(c).isNotNull() for c in columns}
