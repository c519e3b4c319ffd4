"""Sharding by sampled splitters: equal bytes by ranges of a key.

The key of a row is (hash of its text, hash of its doc_id), so equal texts lie side by side and the order says nothing
about the content. Rows are drawn with a chance proportional to their size; the drawn text hashes cut the key space
into many ranges of about equal bytes. Ranges that turn out to hold more than ``1 / FINE`` of a shard are subdivided by
further draws among their own rows, and a group of equal texts only where it holds more than ``1 / GROUP`` of a shard
alone. Ranges are then dealt in order to the shards by their exact bytes, so a shard is off by about one range, and
equal texts share a shard unless their group is that large.

Only draws and ranges reach the driver: about ``FINE`` a shard, whatever the number of rows. Rows are numbered inside
their range and shifted by the rows of the ranges before, so no task ever holds a whole shard or group.

Defined cases: a null text has no bytes and CRC 0 and is a group with the other null texts; equal keys (repeated rows)
share a range and are numbered in any order; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelens.llm.tables import table, written

SHARDS = 40
FINE = 64
GROUP = 16
OVERHEAD = 16
DRAWS = 4
ROUNDS = 12

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _range_of(bounds: list[tuple[int, int]]):
    """A column function: how many bounds are at or below the key."""
    by_text = np.array([b[0] for b in bounds], np.int64)
    inner: dict[int, list[int]] = defaultdict(list)
    for h, d in bounds:
        inner[h].append(d)
    split = {h: np.array(d, np.int64) for h, d in inner.items() if len(d) > 1 or d[0] != _LEAST}
    hot = np.array(sorted(split), np.int64)

    @F.pandas_udf("long")
    def locate(h: pd.Series, d: pd.Series) -> pd.Series:
        key, rest = h.to_numpy(np.int64), d.to_numpy(np.int64)
        out = np.searchsorted(by_text, key, side="right")
        if len(hot):
            for i in np.flatnonzero(np.isin(key, hot)):
                x = int(key[i])
                out[i] = np.searchsorted(by_text, x, side="left") + np.searchsorted(split[x], rest[i], side="right")
        return pd.Series(out)

    return locate


def _draw(rows: DataFrame, expected: Column, seed: int) -> list:
    """(range, h, d, n) of the rows drawn when each is expected ``expected`` times."""
    chance = (F.xxhash64("d", "h", F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))).cast("double")
    return rows.withColumn("n", F.floor(expected + chance)).where("n >= 1").select("range", "h", "d", "n").collect()


def _new_bounds(draws: list, alone: set[int]) -> set[tuple[int, int]]:
    """Bounds before and behind each drawn group; at the drawn rows in ranges that are ``alone``, one large group."""
    out = set()
    for r in draws:
        if r.range in alone:
            out.add((r.h, r.d))
        else:
            out.add((r.h, _LEAST))
            if r.h < _MOST:
                out.add((r.h + 1, _LEAST))
    return out


def splitters(keyed: DataFrame, shards: int) -> tuple[list[tuple[int, int]], pd.DataFrame]:
    """Bounds of the ranges, and (range, bytes, rows) of those that hold rows."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [], pd.DataFrame({"range": [], "bytes": [], "rows": []}, dtype="int64")
    limit = total / (shards * FINE)
    first = _draw(keyed.withColumn("range", F.lit(0)), F.col("size") * F.lit(1.0 / limit), 0)
    bounds = sorted({(r.h, _LEAST) for r in first})
    for turn in range(1, ROUNDS + 1):
        placed = keyed.withColumn("range", _range_of(bounds)("h", "d"))
        stats = placed.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), (F.min("h") == F.max("h")).alias("alone"), (F.min("d") == F.max("d")).alias("same")
        ).toPandas()
        large = stats["alone"] & ~stats["same"] & (stats["bytes"] > total / (shards * GROUP))
        over = stats[(~stats["alone"] & (stats["bytes"] > limit)) | large]
        if not len(over) or turn == ROUNDS:
            break
        spark = keyed.sparkSession
        wanted = spark.createDataFrame(over[["range", "bytes"]].astype("int64").rename(columns={"bytes": "range_bytes"}))
        draws = _draw(placed.join(F.broadcast(wanted), "range"), F.col("size") * F.greatest(F.lit(DRAWS / limit), 2.0 / F.col("range_bytes")), turn)
        more = _new_bounds(draws, set(stats["range"][large])) - set(bounds)
        if more:
            bounds = sorted(set(bounds) | more)
    return bounds, stats[["range", "bytes", "rows"]].sort_values("range").reset_index(drop=True)


def deal(stats: pd.DataFrame, shards: int) -> pd.DataFrame:
    """(range, shard, before): ranges in order by the middle of their bytes, and the rows of the shard's earlier ranges."""
    size = stats["bytes"].to_numpy(float)
    total = size.sum()
    middle = np.cumsum(size) - size / 2
    shard = np.minimum((middle * shards / max(total, 1)).astype(int), shards - 1)
    out = pd.DataFrame({"range": stats["range"].astype("int64"), "shard": shard, "rows": stats["rows"].astype("int64")})
    out["before"] = out.groupby("shard")["rows"].cumsum() - out["rows"]
    return out[["range", "shard", "before"]]


def sharded(docs: DataFrame, shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row with size, text_crc32, shard and slot.

    A column of ``keep`` that has one of these four names is returned as ``doc_<name>``.
    """
    keep = docs.columns if keep is None else keep
    own = docs.select(
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)],
        size_of(F.col("text")).alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("d"),
    )
    narrow = written(own.select("size", "h", "d"), "keys")
    bounds, stats = splitters(narrow, shards)
    dealt = docs.sparkSession.createDataFrame(deal(stats, shards), "range long, shard int, before long")
    placed = own.withColumn("range", _range_of(bounds)("h", "d")).join(F.broadcast(dealt), "range")
    order = Window.partitionBy("range").orderBy("h", "d")
    placed = placed.withColumn("slot", (F.col("before") + F.row_number().over(order) - 1).cast("long"))
    made = ("size", "text_crc32", "shard", "slot")
    return placed.select(*[F.col(f"_{i}").alias(f"doc_{c}" if c in made else c) for i, c in enumerate(keep)], *made)


def op6_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    out = sharded(table(spark, sf_dir, "documents"), SHARDS, ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
