"""Contracts: schema and content rules checked with aggregates, reported as counts.

A check returns a small DataFrame of violation counts; ``require_clean`` turns non-zero counts
into an error when a run must stop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A label-free table may hold no column whose name contains one of these.
GOLD_TOKENS = ("label", "gold", "correct", "quality", "unsupported", "error_type", "annotation", "target")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the schema; absent columns become typed NULLs."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def gold_columns(columns: Sequence[str], tokens: Sequence[str] = GOLD_TOKENS) -> list[str]:
    return [c for c in columns if any(t in c.lower() for t in tokens)]


def label_free(df: DataFrame, tokens: Sequence[str] = GOLD_TOKENS) -> DataFrame:
    """Drop every gold-bearing column."""
    out = df.drop(*gold_columns(df.columns, tokens))
    left = gold_columns(out.columns, tokens)
    if left:
        raise ValueError(f"gold columns left: {left}")
    return out


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule; NULL counts as broken. One pass."""
    return df.agg(F.count("*").alias("rows"), *[
        F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()
    ])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their multiplicity."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def require_clean(report: DataFrame, ignore: Sequence[str] = ("rows",)) -> None:
    """Raise if any counter of a one-row report is not zero."""
    row = report.first().asDict()
    bad = {k: v for k, v in row.items() if k not in ignore and v}
    if bad:
        raise ValueError(f"contract broken: {bad}")


def isolation(df: DataFrame, group: str, side: str) -> DataFrame:
    """Groups that occur on more than one side."""
    g = df.groupBy(group).agg(F.count_distinct(side).alias("sides"))
    return g.filter("sides > 1")


def count_contract(observed: DataFrame, expected: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer comparison of observed and expected counts."""
    e = expected.select(*keys, *[F.col(v).alias(f"expected_{v}") for v in values])
    j = observed.select(*keys, *values).join(e, list(keys), "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.coalesce(F.col(v) == F.col(f"expected_{v}"), F.lit(False))
    return j.withColumn("matches", same)


def numeric_features(df: DataFrame, skip_prefixes: Sequence[str] = (), skip: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns that are finite in every row."""
    names = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip and not f.name.startswith(tuple(skip_prefixes))
    ]
    if not names:
        return []
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")))
    row = df.agg(*[bad(c).alias(c) for c in names]).first()
    return [c for c in names if row[c] == 0]


def ledger_violations(ledger: DataFrame) -> DataFrame:
    """Rule breaks of a dataset ledger: sealed but touched, burned but reported as headline."""
    rules = F.array(
        F.when((F.col("status") == "sealed") & (F.col("touches") > 0), F.lit("sealed_but_touched")),
        F.when((F.col("status") == "burned") & F.col("headline"), F.lit("burned_but_headline")),
    )
    return ledger.withColumn("violation", F.explode(F.array_compact(rules)))
