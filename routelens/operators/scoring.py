"""Resumable batch scoring with any scorer.

A scorer is a factory called once per task; it returns ``score_batch(frame) -> frame`` over
Arrow batches with columns episode_key, source, summary. Model loading thus happens once per
task, and rows spread evenly over tasks by key, whatever their source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelens.operators.joins import latest_per_key

RESULT = T.StructType([
    T.StructField("episode_key", T.StringType()), T.StructField("verifier", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("parse_ok", T.BooleanType()), T.StructField("available", T.BooleanType()), T.StructField("reason", T.StringType()),
])


def pending(inputs: DataFrame, cached: DataFrame) -> DataFrame:
    """Inputs without a usable cached result; parse failures are retried."""
    done = cached.filter("parse_ok").select("episode_key", "verifier").distinct()
    return inputs.join(done, ["episode_key", "verifier"], "left_anti")


IDENTITY = ("model_revision", "protocol_version", "input_sha256", "harness_sha256")


def pending_identified(inputs: DataFrame, cached: DataFrame, keys: Sequence[str] = ("episode_key", "verifier"), identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Inputs whose latest parsed result was made by another model, protocol, input or harness, or that have none.

    ``inputs`` carry the identity they would be scored with now; a result counts only if all of it is the same (nulls match nulls).
    ``why`` says ``missing`` or names the first part that has changed.
    """
    last = latest_per_key(cached.filter("parse_ok"), list(keys), F.col("attempt"))
    old = last.select(*keys, *[F.col(c).alias(f"_was_{c}") for c in identity], F.lit(True).alias("_known"))
    j = inputs.join(old, list(keys), "left")
    why = F.when(F.col("_known").isNull(), "missing")
    for c in identity:
        why = why.when(~F.col(c).eqNullSafe(F.col(f"_was_{c}")), c)
    return j.withColumn("why", why).filter("why is not null").drop("_known", *[f"_was_{c}" for c in identity])


def call_plan(routes: DataFrame, row: str = "episode_key", seed: str = "seed", action: str = "selected_action") -> tuple[DataFrame, DataFrame]:
    """(plan, calls): which verifier each (row, seed) asks, and every different (row, verifier) once.

    Seeds that route a row alike share one call; rows without a call are in the plan with a null verifier.
    """
    plan = routes.select(row, seed, F.col(action).alias("verifier"))
    return plan, plan.filter("verifier is not null").select(row, "verifier").distinct()


def executed(plan: DataFrame, results: DataFrame, row: str = "episode_key") -> DataFrame:
    """The plan with its results; a call that was planned and not made is an unavailable result, never a lost row."""
    j = plan.join(results.select(row, "verifier", "score", "available"), [row, "verifier"], "left")
    return j.withColumn("available", F.coalesce("available", F.lit(False))).withColumn("score", F.coalesce("score", F.lit(0.5)))


OVERFLOW, FAILURE, UNPARSED = "context_overflow", "scorer_error", "parse_failure"


def _outcomes(score: Callable, batch: pd.DataFrame) -> pd.DataFrame:
    """(score, parse_ok, reason) of a batch; a batch that raises is scored row by row, so only the failing rows are lost."""
    try:
        got = score(batch)
    except Exception as e:
        if len(batch) == 1:
            return pd.DataFrame({"score": [None], "parse_ok": [False], "reason": [f"{FAILURE}: {type(e).__name__}"]}, index=batch.index)
        return pd.concat([_outcomes(score, batch.iloc[[i]]) for i in range(len(batch))])
    if isinstance(got, pd.Series):  # a missing score is an input that did not fit
        got = pd.DataFrame({"score": got, "parse_ok": True, "reason": None}, index=batch.index)
    missing = got["score"].isna()
    reason = got["reason"].where(got["reason"].notna(), None)
    return got.assign(reason=[None if not m else r or (OVERFLOW if ok else UNPARSED) for m, ok, r in zip(missing, got["parse_ok"], reason, strict=True)])


def score_rows(rows: DataFrame, factory: Callable, verifier: str) -> DataFrame:
    """Run one scorer over its rows; a failing row becomes an unavailable result with a reason, not a failed job.

    The scorer returns a series of scores, or a frame with score, parse_ok and reason. Rows that failed or could not be
    parsed are not ``parse_ok`` and are pending again in the next run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for b in batches:
            got = _outcomes(score, b)
            ok = got["score"].notna()
            yield pd.DataFrame({
                "episode_key": b["episode_key"], "verifier": verifier, "score": got["score"].astype("float64").fillna(0.5),
                "parse_ok": got["parse_ok"].astype(bool), "available": ok, "reason": got["reason"],
            })

    return rows.select("episode_key", "source", "summary").repartition("episode_key").mapInPandas(run, RESULT)


def latest_results(cache: DataFrame) -> DataFrame:
    """The last parsed attempt per (episode, verifier)."""
    return latest_per_key(cache.filter("parse_ok"), ["episode_key", "verifier"], F.struct("attempt", "score"))


def append_results(spark: SparkSession, inputs: DataFrame, path: str, factory: Callable, verifier: str, attempt: int) -> int:
    """Score what is pending and append it to the cache; returns the number of rows scored."""
    try:
        cached = spark.read.schema(T.StructType([*RESULT.fields, T.StructField("attempt", T.IntegerType())])).parquet(path)
    except Exception as e:  # a cache that does not exist yet is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cached = None
    todo = inputs if cached is None else pending(inputs, cached)
    n = todo.count()
    if n:
        score_rows(todo, factory, verifier).withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(path)
    return n
