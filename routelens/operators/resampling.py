"""Bootstrap over source groups with one shared set of draws.

A draw is a multinomial resample of the groups built from hashes: every group contributes one slot per draw, and the slot
picks a group number. How often the draws take a group is one packed vector with an entry per draw, so predictions, collapsed
to (system, group, score, positives, negatives), meet one row per group whatever the number of draws. The areas of all draws
are added up together, cell by cell of the score range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions.hashing import SEPARATOR, uniform
from routelens.operators.ordered import dense_index, quantiles, with_grid

try:
    from _sha2 import sha256  # the same digests with less to set up for each of very many short messages
except ImportError:
    from hashlib import sha256

# cells of a system's score range; the vectors of one cell meet in one task
DRAW_CELLS = 256
# group numbers whose vectors are put together at a time, slots hashed at a time, vectors unpacked at a time
BLOCK, SLOTS, VECTORS = 1024, 1024, 256


def pack(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, Huffman-coded; the first byte is the width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or counts.max(initial=0) < 1 << 8 * w)
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return bytes([width]) + coder.compress(counts.astype(f"<u{width}").tobytes()) + coder.flush()


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:], -15), f"<u{packed[0]}")


def _tasks(df: DataFrame) -> int:
    """Tasks for steps whose work is far more than their bytes, which would be put into one."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _picks(draws: int, seed: int, tag: str):
    """Slots to the groups they pick: per block of group numbers the sorted places (number in the block, draw) as differences."""
    heads = [SEPARATOR.join((str(tag), str(seed), str(d), "")).encode() for d in range(draws)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strata = np.array(batch.column("_st").to_pylist(), dtype=object)
            idx, n = batch.column("idx").to_numpy(), batch.column("n").to_numpy()
            for st in dict.fromkeys(strata):
                own = np.flatnonzero(strata == st)
                for at in (own[i:i + SLOTS] for i in range(0, len(own), SLOTS)):
                    pick = np.empty((len(at), draws), "int64")
                    for row, i, groups in zip(pick, idx[at], n[at]):
                        tail = f"{st}{SEPARATOR}{i}".encode()
                        words = np.frombuffer(b"".join([sha256(h + tail).digest() for h in heads]), ">u4")[::8]
                        row[:] = np.floor(words / 4294967296.0 * groups)
                    place = np.sort((pick * draws + np.arange(draws)).ravel())
                    block = place // (BLOCK * draws)
                    cuts = np.flatnonzero(np.diff(block, prepend=-1))
                    step = np.diff(place, prepend=0)
                    step[cuts] = place[cuts] - block[cuts] * (BLOCK * draws)
                    widths = np.where(np.maximum.reduceat(step, cuts) < 1 << 16, 2, 4).tolist()
                    steps = {w: step.astype(f"<u{w}").tobytes() for w in set(widths)}
                    ends = [*cuts[1:].tolist(), len(step)]
                    out = [bytes([w]) + steps[w][w * lo:w * hi] for w, lo, hi in zip(widths, cuts.tolist(), ends)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([st] * len(cuts), pa.string()), pa.array(block[cuts], pa.int64()), pa.array(out, pa.binary())], ["_st", "_block", "picks"])

    return run


def _vectors(draws: int):
    """The vectors of one block of group numbers; numbers that no draw takes have none."""

    def run(table: pa.Table) -> pa.Table:
        # pieces are counted once there are as many places as counts: the more groups, the smaller is a piece
        m, held, places = np.zeros(BLOCK * draws, "int64"), [], 0
        for picks in table.column("picks").to_pylist():
            held.append(np.cumsum(np.frombuffer(picks, f"<u{picks[0]}", offset=1), dtype="int64"))
            places += len(held[-1])
            if places >= len(m):
                m += np.bincount(np.concatenate(held), minlength=len(m))
                held, places = [], 0
        if held:
            m += np.bincount(np.concatenate(held), minlength=len(m))
        m = m.reshape(BLOCK, draws)
        taken = np.flatnonzero(m.any(axis=1))
        st, block = table.column("_st")[0].as_py(), table.column("_block")[0].as_py()
        return pa.table({"_st": pa.array([st] * len(taken), pa.string()), "idx": pa.array(block * BLOCK + taken, pa.int64()),
                         "m": pa.array([pack(m[i]) for i in taken], pa.binary())})

    return run


def draw_table(rows: DataFrame, group: str, draws: int, seed: int, stratum: Column | None = None, tag="boot") -> DataFrame:
    """(group, m): how often each draw takes each group, packed; groups stay inside their stratum."""
    g = rows.select((F.lit("ALL") if stratum is None else stratum).cast("string").alias("_st"), F.col(group).alias("_g")).distinct()
    pos = dense_index(g, ["_st"], "_g", uniform(tag, seed, F.col("_g"))).filter(F.col("_st").isNotNull())
    tasks = _tasks(pos)
    picks = pos.select("_st", "idx", "n").repartition(tasks, "_st", "idx").mapInArrow(_picks(draws, seed, tag), "_st string, _block long, picks binary")
    m = picks.repartition(tasks, "_st", "_block").groupBy("_st", "_block").applyInArrow(_vectors(draws), "_st string, idx long, m binary")
    return m.join(pos.select("_st", "idx", "_g"), ["_st", "idx"]).select(F.col("_g").alias(group), "m").persist()  # one row a group, read by every system


def _collapsed(keys: Sequence[str], on: str | None, place: dict):
    """Rows of one score in a batch become two, so that a score shared by very many rows stays few rows; ``on`` keeps its draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if on is not None:
                batch = batch.filter(pc.is_in(batch.column(on), value_set=pa.array([*place], batch.schema.field(on).type)))
                few, last, counts = [], None, None
                for v, m in zip(batch.column(on).to_pylist(), batch.column("m").to_pylist()):
                    if m != last:  # rows of a group come one after another
                        last, counts = m, unpack(m)
                    few.append(pack(counts[place[v]]))
                batch = batch.set_column(batch.schema.get_field_index("m"), batch.schema.field("m"), pa.array(few, pa.binary()))
            t = batch.to_pandas()
            code = t.groupby([*keys, "_cell", "score"], dropna=False, sort=False).ngroup().to_numpy()
            many = np.flatnonzero(np.bincount(code) > 2) if len(t) else []
            yield batch.filter(pa.array(~np.isin(code, many)))
            more = []
            for c in many:
                tied = t[code == c]
                for side in ("pos", "neg"):
                    total = sum(unpack(m).astype("int64") * w for m, w in zip(tied["m"], tied[side]) if w)
                    if not np.isscalar(total):
                        more.append({**tied.iloc[0].to_dict(), "pos": 0, "neg": 0, side: 1, "m": pack(total)})
            if more:
                yield pa.RecordBatch.from_pylist(more, batch.schema)

    return run


def _cell_area(keys: Sequence[str]):
    """Of one cell, for all draws: both class totals and the pairs in order, ties half."""

    def run(table: pa.Table) -> pa.Table:
        score = table.column("score").to_numpy().astype("float64")
        score[np.isnan(score)] = np.inf
        order = np.argsort(score, kind="stable")
        weights = [table.column(c).to_numpy().astype("float64") for c in ("pos", "neg")]
        packed = table.column("m").to_pylist()
        pos = below = area = run_pos = run_neg = 0.0
        run_score = None
        for at in (order[i:i + VECTORS] for i in range(0, len(order), VECTORS)):
            m = np.stack([unpack(packed[i]) for i in at]).astype("float64")
            s = score[at]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            p, n = (np.add.reduceat(w[at][:, None] * m, starts, axis=0) for w in weights)
            if s[0] == run_score:
                p[0] += run_pos
                n[0] += run_neg
            else:
                area, below, pos = area + run_pos * (below + run_neg / 2.0), below + run_neg, pos + run_pos
            before = below + np.cumsum(n, axis=0) - n / 2.0
            area, below, pos = area + (p[:-1] * before[:-1]).sum(axis=0), below + n[:-1].sum(axis=0), pos + p[:-1].sum(axis=0)
            run_pos, run_neg, run_score = p[-1], n[-1], s[-1]
        area, below, pos = area + run_pos * (below + run_neg / 2.0), below + run_neg, pos + run_pos
        first = table.slice(0, 1).select([*keys, "_cell"])
        for name, v in (("pos", pos), ("neg", below), ("area", area)):
            first = first.append_column(name, pa.array([v.astype("<f8").tobytes()], pa.binary()))
        return first

    return run


def _whole_area(keys: Sequence[str], on: str | None, place: dict):
    """Cells in order: the area of a concatenation is ``a1 + a2 + pos2 * neg1``."""

    def run(table: pa.Table) -> pa.Table:
        pos = neg = area = 0.0
        for row in table.sort_by("_cell").select(["pos", "neg", "area"]).to_pylist():
            p, n, a = (np.frombuffer(row[c], "<f8") for c in ("pos", "neg", "area"))
            pos, neg, area = pos + p, neg + n, area + a + p * neg
        draw = np.arange(len(pos)) if on is None else place[table.column(on)[0].as_py()]
        both = (pos > 0) & (neg > 0)
        value = np.divide(area, pos * neg, out=np.zeros(len(pos)), where=both)
        out = table.select([k for k in keys if k != on]).take(pa.array(np.zeros(len(pos), "int64")))
        return out.append_column("draw", pa.array(draw.astype("int32"))).append_column("auroc", pa.array(value, mask=~both))

    return run


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def draw_aurocs(rows: DataFrame, draws: DataFrame, systems: Sequence[str], group: str, score="p", label="y", on: tuple[str, Sequence] | None = None) -> DataFrame:
    """AUROC of every system on every draw; one-class draws give NULL.

    ``on`` names a column of ``rows`` and gives its value for each draw: the draw then reads only the rows of that value.
    """
    name, place = None, {}
    if on is not None:
        name, place = on[0], {v: np.flatnonzero(np.array([w == v for w in on[1]])) for v in set(on[1])}
    keys = [*systems, *([] if name is None else [name])]
    led = rows.groupBy(*keys, group, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).filter("pos + neg > 0")
    placed = with_grid(led, keys, F.col("score"), cells=DRAW_CELLS)
    met = placed.join(draws, group).select(*keys, "_cell", "score", "pos", "neg", "m")
    few = met.mapInArrow(_collapsed(keys, name, place), met.schema)
    cells = few.repartition(_tasks(rows), *keys, "_cell").groupBy(*keys, "_cell").applyInArrow(
        _cell_area(keys), f"{_fields(met, [*keys, '_cell'])}, pos binary, neg binary, area binary")
    out = cells.groupBy(*keys).applyInArrow(_whole_area(keys, name, place), f"{_fields(met, systems)}, draw int, auroc double")
    return out.persist()  # systems x draws rows, read by every comparison


def intervals(deltas: DataFrame, keys: Sequence[str], value: str = "delta", level: float = 0.05) -> DataFrame:
    """Mean, percentile interval and two-sided bootstrap p over the valid draws."""
    d = deltas.filter(F.col(value).isNotNull())
    x = F.round(F.col(value), 12)
    base = d.groupBy(*keys).agg(
        F.count("*").alias("draws"), F.avg(value).alias("mean"),
        F.least(F.lit(1.0), 2.0 * F.least(F.count_if(x <= 0), F.count_if(x >= 0)) / F.count("*")).alias("p_value"))
    q = quantiles(d, keys, value, (level / 2, 1 - level / 2), F.lit(0.5) + F.col(value) / 2.0, ("ci_low", "ci_high"))
    return base.join(q, list(keys))


def paired_delta(aurocs: DataFrame, system: str, reference: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per draw: each other system minus the reference on the same draw."""
    ref = aurocs.filter(F.col(system) == reference).select(*keys, "draw", F.col("auroc").alias("_ref"))
    return aurocs.filter(F.col(system) != reference).join(ref, [*keys, "draw"]).withColumn("delta", F.col("auroc") - F.col("_ref")).drop("_ref")


def _summed(systems: Sequence[str], sums: Sequence[str]):
    """Totals of a task's rows by system and draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        types = {}
        for batch in batches:
            types = {s: batch.schema.field(s).type for s in systems}
            met = batch.to_pandas()
            for _, own in met.groupby(systems, dropna=False, sort=False):
                key = tuple(batch.column(s)[int(own.index[0])].as_py() for s in systems)
                for i in range(0, len(own), VECTORS):
                    some = own.iloc[i:i + VECTORS]
                    m = np.stack([unpack(v) for v in some["m"]]).astype("float64")
                    totals[key] = totals.get(key, 0.0) + some[sums].to_numpy("float64").T @ m
        for key, total in totals.items():
            n = total.shape[1]
            columns = [pa.array([v] * n, types[s]) for s, v in zip(systems, key)] + [pa.array(np.arange(n, dtype="int32"))] + [pa.array(x) for x in total]
            yield pa.RecordBatch.from_arrays(columns, [*systems, "draw", *sums])

    return run


def additive_draws(rows: DataFrame, draws: DataFrame, systems: Sequence[str], group: str, sums: dict[str, Column]) -> DataFrame:
    """Resampled totals of per-group sums; no row is replayed."""
    systems, names = list(systems), list(sums)
    per = rows.groupBy(*systems, group).agg(*[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])
    met = per.join(draws, group).select(*systems, *names, "m")
    part = met.mapInArrow(_summed(systems, names), f"{_fields(met, systems)}, draw int, " + ", ".join(f"`{n}` double" for n in names))
    return part.groupBy(*systems, "draw").agg(*[F.sum(n).alias(n) for n in names])
