"""Operators without a SQL counterpart, checked against brute force on small fixtures."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelens.functions import judge as G
from routelens.functions import text as X
from routelens.operators import calibration as K
from routelens.operators import isotonic as I
from routelens.operators import contracts as C
from routelens.operators import features as FT
from routelens.operators import reports as P
from routelens.operators import routing as R
from routelens.operators import scoring as V
from routelens.operators import splits as S
from routelens.session import scratch_path

PAIRS = [
    ("p1", "Acme Corp sold 12 units in 2019. Mary Jones left. Profit was $3,400 million!", "Acme Corp sold 15 units. Mary Jones stayed in 2019."),
    ("p2", "Nothing here matches\nsecond line", "Other words entirely."),
    ("p3", "", "Solo."),
    ("p4", "a b c d. b c d e. c d e f.", "b c d. e f"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "pair_id string, source string, summary string").withColumn("doc_key", F.sha2("source", 256)).cache()


def py_sentences(x):
    v = x.strip()
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", v) if s.strip()] or [v]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_rouge_l_against_table(pairs):
    got = {(r.pair_id, r.sidx): r.score for r in FT.rouge_scores(pairs, stems=False).collect()}
    words = lambda s: re.findall("[a-z0-9]+", s.lower())
    for pid, src, summ in PAIRS:
        for i, s in enumerate(py_sentences(src)):
            a, b = words(summ), words(s)
            n = lcs(a, b)
            assert got.get((pid, i), 0.0) == pytest.approx(2 * n / (len(a) + len(b)) if n else 0.0)


def test_bm25_against_loop(pairs):
    got = {r.pair_id: r for r in FT.bm25_features(pairs).collect()}
    tok = lambda s: re.findall(r"[a-z0-9']+", s.lower())
    for pid, src, summ in PAIRS:
        sents = [tok(s) for s in py_sentences(src)]
        avg = max(np.mean([len(s) for s in sents]), 1.0)
        scores = []
        for s in sents:
            total = 0.0
            for t in set(tok(summ)):
                tf, df = s.count(t), sum(t in z for z in sents)
                if tf:
                    total += tok(summ).count(t) * math.log(1 + (len(sents) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(s) / avg))
            scores.append(total)
        top = sorted(scores, reverse=True)
        assert got[pid].bm25_top1 == pytest.approx(top[0])
        assert got[pid].bm25_mean3 == pytest.approx(np.mean(top[:3]))


def test_feature_frames_are_complete_and_finite(pairs):
    for frame, n in ((FT.cheap_features(pairs), 27), (FT.compact_features(pairs), 16)):
        rows = frame.collect()
        assert len(rows) == len(PAIRS) and len(frame.columns) == n + 1
        assert all(math.isfinite(r[c]) for r in rows for c in frame.columns if c != "pair_id")


def test_conflicts_and_colocation(pairs):
    got = {r.pair_id: r for r in FT.conflict_features(pairs, FT.evidence_table(pairs)).collect()}
    # (Acme Corp, 15): the source names Acme Corp with other values; (mary jones, 2019): never together
    assert got["p1"].entity_value_colocation == 0.0 and got["p1"].conflicting_value_rate > 0
    assert got["p2"].entity_value_colocation == 1.0 and got["p2"].conflicting_value_rate == 0.0


def test_spans(spark):
    x = spark.createDataFrame([("In May 12, 2020 Acme Widget Co paid $3,400 million to NASA and Bob.",)], "s string")
    r = x.select(X.value_spans(F.col("s")).alias("v"), X.entity_spans(F.col("s")).alias("e")).first()
    assert {"$3400million", "may12,2020"} <= set(r.v)
    assert {"acme widget co", "nasa", "bob"} <= set(r.e)


@pytest.mark.parametrize("sizes", [[], [5], [60, 50, 10, 200, 1, 99], [100, 1, 99, 1]])
def test_packing(spark, sizes):
    want, chunk, used = [], 0, 0
    for s in sizes:
        if used and used + s > 100:
            chunk, used = chunk + 1, 0
        used += s
        want.append(chunk)
    df = spark.createDataFrame([(sizes,)], "s array<int>")
    assert df.select(FT.packed_chunks(F.col("s"), 100).alias("c")).first().c == want


def test_evidence_selection(pairs):
    got = {r.pair_id: r for r in FT.select_evidence(pairs, 9).collect()}
    # room 9 - 5 = 4 tokens: the second and third sentence share most terms, one of them fits
    assert got["p4"].picked == [1] and got["p4"].selected_tokens == 4


def test_token_windows_cover_everything(spark):
    df = spark.createDataFrame([(i, list(map(str, range(i)))) for i in (0, 1, 8, 9, 23)], "id int, t array<string>")
    got = FT.token_windows(df, F.col("t"), F.lit(8), ["id"], overlap=64).collect()
    for n in (0, 1, 8, 9, 23):
        w = sorted((r.window, r.start, r.tokens) for r in got if r.id == n)
        assert {int(t) for _, _, ts in w for t in ts} == set(range(n))
        assert [s for _, s, _ in w] == [6 * i for i in range(len(w))]


def test_even_groups_count_as_negative(spark):
    df = spark.createDataFrame([("g", "c", 1), ("g", "c", 0), ("h", "c", 1)], "content_doc_key string, dataset_key string, label_supported int")
    got = {r.content_doc_key: r.stratum_label for r in S.group_strata(df).collect()}
    assert got == {"g": 0, "h": 1}


def test_uncovered_rows_and_ties(spark):
    pool = ("a", "b")
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "available__a boolean, available__b boolean")
    df = df.withColumns({f"{f}__{a}": F.lit(0.5) for f in ("cal", "latency_ms") for a in pool})
    r = R.select_action(df, pool, [F.lit(0.3), F.lit(0.3)])
    assert [x.selected_action for x in r.collect()] == ["a", "b", None]
    assert R.uncovered_rows(r).first().uncovered == 1


def test_price_calibration_hits_the_mix(spark):
    rng = np.random.default_rng(0)
    pool = ("a", "b", "c")
    df = spark.createDataFrame([tuple(map(float, rng.random(3) * 0.9 + 0.1)) for _ in range(2000)], ", ".join(f"head__{a} double" for a in pool))
    df = df.withColumns({f"available__{a}": F.lit(True) for a in pool}).cache()
    got = R.calibrate_prices(df, pool, (0.6, 0.3, 0.1))
    assert abs(got["share_low"] - 0.6) < 0.01 and abs(got["share_mid"] - 0.3) < 0.01 and abs(got["share_high"] - 0.1) < 0.01


def test_platt_equals_newton(spark):
    rng = np.random.default_rng(1)
    s = rng.random(300)
    y = (rng.random(300) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label_supported int")
    b0, b1 = K.fit_platt(df, "score")
    z = np.log(s / (1 - s))
    x, w = np.c_[np.ones(300), z], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([0, 1.0]), x.T @ (p - y) + np.array([0, w[1]]))
    assert (b0, b1) == pytest.approx(tuple(w), abs=1e-4)
    assert K.fit_platt(df.withColumn("label_supported", F.lit(1)), "score")[1] == 0.0


def test_isotonic_is_monotone_and_clipped(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.8, 1), (0.8, 1)], "p double, y int")
    df = df.withColumn("k", F.lit(0))
    q = I.apply_isotonic(df, I.fit_isotonic(df, ["k"]), ["k"]).orderBy("p").collect()
    assert [round(r.q, 6) for r in q] == [1e-6, 0.5, 0.5, 1 - 1e-6, 1 - 1e-6]


def test_shapley_is_efficient(spark):
    vals = [0.0, 0.2, 0.1, 0.45, 0.3, 0.6, 0.5, 0.9]
    df = spark.createDataFrame(list(enumerate(vals)), "mask int, value double")
    got = {r.item: r for r in P.shapley(df, ("a", "b", "c")).collect()}
    assert sum(r.shapley for r in got.values()) == pytest.approx(0.9)
    assert got["a"].solo == 0.2 and got["a"].leave_one_out == 0.5


def test_judge_rules(spark):
    row = lambda **k: {"label": "SUPPORTED", "support_probability": 0.9, "evidence_ids": [0], "unsupported_spans": [], "error_type": "NONE", **k}
    import json

    cases = {
        "ok": row(), "bad_label": row(label="X"), "bad_probability": row(support_probability=1.5), "bad_evidence": row(evidence_ids=[0, 1, 2, 3]),
        "ungrounded_span": row(label="UNSUPPORTED", error_type="MIXED", unsupported_spans=["zzz"]), "label_error_mismatch": row(error_type="MIXED"),
        "supported_with_span": row(unsupported_spans=["cat"]), "unsupported_without_span": row(label="UNSUPPORTED", error_type="MIXED"),
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()], "k string, j string")
    p = F.from_json("j", G.PAYLOAD)
    for r in df.select("k", G.payload_status(p, F.lit("the cat sat"), F.lit(5)).alias("s"), G.score_status(p, F.lit("the cat sat"), F.lit(5)).alias("t")).collect():
        assert r.s == r.k
        assert r.t == ("span_fallback" if r.k == "ungrounded_span" else r.k)
    empty = json.dumps(row(label="UNSUPPORTED", support_probability=0.0, evidence_ids=[], unsupported_spans=[""]))
    e = spark.createDataFrame([(empty,)], "j string").select(G.score_status(F.from_json("j", G.PAYLOAD), F.lit("x"), F.lit(5)).alias("t"))
    assert e.first().t == "empty_span_fallback"


def test_span_grounding(spark):
    df = spark.createDataFrame([("The Cat, sat", "Cat"), ("The Cat, sat", "cat SAT"), ("aXa", "A"), ("abc", "zz")], "c string, s string")
    got = [tuple(r.g) for r in df.select(G.ground_span("c", "s").alias("g")).collect()]
    assert got == [(4, 7), (4, 12), (None, None), (None, None)]


def test_second_scoring_run_has_nothing_to_do(spark, pairs):
    from routelens.plans.io_queries import overlap_scorer

    x = pairs.select(F.col("pair_id").alias("episode_key"), F.lit("o").alias("verifier"), "source", "summary")
    path = scratch_path(spark, "resume")
    assert V.append_results(spark, x, path, overlap_scorer, "o", 0) == len(PAIRS)
    assert V.append_results(spark, x, path, overlap_scorer, "o", 1) == 0


def test_streamed_scoring_matches_batch(spark, pairs):
    from routelens.plans.io_queries import overlap_scorer
    from routelens.streaming.incremental import score_stream

    x = pairs.select(F.col("pair_id").alias("episode_key"), F.lit("o").alias("verifier"), "source", "summary")
    src, cache = scratch_path(spark, "in"), scratch_path(spark, "out")
    x.write.parquet(src)
    score_stream(spark, src, x.schema, cache, scratch_path(spark, "cp"), overlap_scorer, "o").awaitTermination()
    assert spark.read.parquet(cache).count() == len(PAIRS)


def test_contracts(spark):
    df = spark.createDataFrame([(1, 0.5, "x"), (2, float("nan"), "y")], "id int, f double, gold_note string")
    assert C.label_free(df).columns == ["id", "f"]
    assert C.numeric_features(df) == ["id"]
    report = C.rule_counts(df, {"positive": F.col("id") > 0, "is_one": F.col("id") == 1})
    with pytest.raises(ValueError):
        C.require_clean(report)
