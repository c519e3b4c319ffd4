"""Bootstraps against draws made one by one."""

import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routelens.operators import resampling as B

DRAWS = 40


def _u(*parts):
    return int(sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def _multiplicities(groups, seed):
    """{group: counts by draw} for the groups of one stratum each."""
    out = {}
    for st in {s for _, s in groups if s is not None}:
        own = sorted((g for g, s in groups if s == st), key=lambda g: (_u("boot", seed, g), g))
        for i in range(len(own)):
            for d in range(DRAWS):
                out.setdefault(own[int(_u("boot", seed, d, st, i) * len(own))], np.zeros(DRAWS, int))[d] += 1
    return out


def _auroc(rows, m, d):
    w = [(p, y, m[g][d]) for g, p, y in rows if g in m]
    pos, neg = sum(k for _, y, k in w if y), sum(k for _, y, k in w if not y)
    if not pos or not neg:
        return None
    return sum(a * b * ((p > q) + (p == q) / 2) for p, y, a in w if y for q, z, b in w if not z) / (pos * neg)


def _rows(n, seed):
    r = random.Random(seed)
    strata = {f"g{i}": r.choice(["de", "en", None]) for i in range(n)}
    return strata, [(s, f"g{r.randrange(n)}", r.choice([0.0, 0.0, 1.0, round(r.random(), 3)]), r.randrange(2)) for s in "ab" for _ in range(4 * n)]


def test_one_row_a_group_whatever_the_draws(spark):
    strata, rows = _rows(30, 1)
    df = spark.createDataFrame([(g, s) for g, s in strata.items()], "g string, st string")
    got = {r.g: B.unpack(r.m).tolist() for r in B.draw_table(df, "g", DRAWS, 3, F.col("st")).collect()}
    assert got == {g: m.tolist() for g, m in _multiplicities(list(strata.items()), 3).items()}


@pytest.mark.parametrize("batch", [7, 10_000])
def test_areas_and_totals_of_every_draw(spark, batch):
    strata, rows = _rows(25, 2)
    df = spark.createDataFrame([(s, g, strata[g], p, y) for s, g, p, y in rows], "system string, g string, st string, p double, y int")
    m = _multiplicities([(g, strata[g]) for g in {g for _, g, _, _ in rows}], 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        draws = B.draw_table(df, "g", DRAWS, 5, F.col("st"))
        areas = {(r.system, r.draw): r.auroc for r in B.draw_aurocs(df, draws, ["system"], "g").collect()}
        sums = {(r.system, r.draw): r.n for r in B.additive_draws(df, draws, ["system"], "g", {"n": F.col("y")}).collect()}
        half = [d % 2 for d in range(DRAWS)]
        odd = df.withColumn("j", (F.col("p") > 0).cast("int"))
        kept = {(r.system, r.draw): r.auroc for r in B.draw_aurocs(odd, draws, ["system"], "g", on=("j", half)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in "ab":
        own = [(g, p, y) for t, g, p, y in rows if t == s]
        for d in range(DRAWS):
            assert areas[s, d] == pytest.approx(_auroc(own, m, d))
            assert sums[s, d] == sum(y * m[g][d] for g, _, y in own if g in m)
            assert kept[s, d] == pytest.approx(_auroc([x for x in own if (x[1] > 0) == half[d]], m, d))


def test_places_of_many_pieces_are_counted_at_once(spark, monkeypatch):
    """A block's pieces grow with the number of groups, each of them fewer places: counting piece by piece grows with the square."""
    rows = pa.RecordBatch.from_arrays([pa.array(["ALL"] * 300), pa.array(range(300), pa.int64()), pa.array([300] * 300, pa.int64())], ["_st", "idx", "n"])
    whole = pa.Table.from_batches(B._picks(DRAWS, 3, "boot")([rows]))
    monkeypatch.setattr(B, "SLOTS", 3)
    pieces = pa.Table.from_batches(B._picks(DRAWS, 3, "boot")([rows]))
    assert (len(whole), len(pieces)) == (1, 100)
    want = [np.zeros(300, int) for _ in range(DRAWS)]
    for d in range(DRAWS):
        for i in range(300):
            want[d][int(_u("boot", 3, d, "ALL", i) * 300)] += 1
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(len(a[0])) or count(*a, **k))
    for table in (whole, pieces):
        got = B._vectors(DRAWS)(table)
        vectors = {i: B.unpack(m).tolist() for i, m in zip(got.column("idx").to_pylist(), got.column("m").to_pylist())}
        assert vectors == {i: [int(w[i]) for w in want] for i in range(300) if any(w[i] for w in want)}
    assert calls == [300 * DRAWS] * 2
