"""Rules that a review found broken: grounding, failing scorers, atomic writes, inventories, statuses, ties, end points."""

import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from routelens.functions import judge as G
from routelens.functions import text as X
from routelens.operators import calibration as K
from routelens.operators import features as T
from routelens.operators import reports as P
from routelens.operators import scoring as V
from routelens.operators import thresholds as Q
from routelens.sources import files as IO


@pytest.mark.parametrize("claim, span, want", [
    ("the cat sat", "cat", (4, 7)), ("the cat sat", "THE CAT", (0, 7)), ("a-b a b", "AB", None), ("x Straße y", "STRASSE", (2, 8)),
    ("the cat", "", None), ("the cat", "dog", None), (None, "x", None), ("aaa", "aa", (0, 2)), ("Aa a-A", "aA a", None), ("ﬁne print", "FINE", (0, 3)),
])
def test_locate_span(claim, span, want):
    assert G.locate_span(claim, span) == want


def test_payloads_accept_folded_and_object_spans(spark):
    rows = [('["THE CAT"]',), ('[{"text": "cat sat"}]',), ('["dog"]',), ('[""]',), ("null",)]
    df = spark.createDataFrame(rows, "spans string").withColumn("claim", F.lit("the cat sat"))
    json = F.concat(F.lit('{"label":"UNSUPPORTED","support_probability":0.2,"evidence_ids":[0],"error_type":"MIXED","unsupported_spans":'), "spans", F.lit("}"))
    got = [r[0] for r in df.select(G.payload_status(F.from_json(json, G.PAYLOAD), F.col("claim"), F.lit(3))).collect()]
    assert got == ["ok", "ok", "ungrounded_span", "ungrounded_span", "unsupported_without_span"]


def test_label_and_probability(spark):
    rows = [('{"label":"supported","support_probability":0.7}', None), ('{"label":"UNSUPPORTED"}', 0.3), ("Yes, it is wrong", None), ("No.", None), ("cannot say", 0.4)]
    df = spark.createDataFrame(rows, "t string, lp double")
    got = [tuple(r[0]) for r in df.select(G.label_and_probability(F.col("t"), F.col("lp"))).collect()]
    assert got == [("SUPPORTED", 0.7), ("UNSUPPORTED", 0.3), ("UNSUPPORTED", 0.0), ("SUPPORTED", 1.0), (None, None)]


def test_a_failing_row_is_not_a_failed_job_and_is_retried(spark, tmp_path):
    def factory():
        def score(b):
            if (b["summary"] == "boom").any():
                raise ValueError("no")
            ok = b["summary"] != "noise"
            return pd.DataFrame({"score": b["summary"].str.len().where(ok & (b["summary"] != "long")).astype(float), "parse_ok": ok, "reason": None})

        return score

    rows = spark.createDataFrame([("a", "s", "boom"), ("b", "s", "fine"), ("c", "s", "noise"), ("d", "s", "long")], "episode_key string, source string, summary string").withColumn("verifier", F.lit("v"))
    got = {r.episode_key: (r.score, r.parse_ok, r.available, r.reason) for r in V.score_rows(rows.coalesce(1), factory, "v").collect()}
    assert got == {"a": (0.5, False, False, "scorer_error: ValueError"), "b": (4.0, True, True, None), "c": (0.5, False, False, "parse_failure"), "d": (0.5, True, False, "context_overflow")}
    path = str(tmp_path / "cache")
    assert V.append_results(spark, rows, path, factory, "v", 0) == 4
    assert V.append_results(spark, rows, path, factory, "v", 1) == 2


def test_write_table_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    IO.write_table(spark.range(5), path)
    broken = spark.range(5).withColumn("x", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        IO.write_table(broken, path)
    assert spark.read.parquet(path).count() == 5
    IO.write_table(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    parts = str(tmp_path / "p")
    IO.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string"), parts, ["k"])
    IO.write_table(spark.createDataFrame([(3, "b"), (4, "c")], "x int, k string"), parts, ["k"])
    assert sorted(map(tuple, spark.read.parquet(parts).collect())) == [(1, "a"), (3, "b"), (4, "c")]
    assert not [n for n in os.listdir(tmp_path) if "_staged" in n and os.listdir(tmp_path / n)]


def test_unfinished_counts_rows_and_repeats(spark):
    want = spark.createDataFrame([(k, i) for k in "abcd" for i in range(3)], "k string, row long")
    done = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0), ("c", 1), ("c", 2), ("c", 2)], "k string, row long")
    assert sorted(r.k for r in IO.unfinished(want, done, ["k"], "row").collect()) == ["b", "c", "d"]


def test_inventory_keys_by_path_below_the_root(spark, tmp_path):
    for name, text in (("x/part-0.txt", "1"), ("y/part-0.txt", "2")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    before = IO.file_inventory(spark, str(tmp_path)).collect()
    assert sorted(r.file for r in before) == ["x/part-0.txt", "y/part-0.txt"]
    recorded = spark.createDataFrame(before)
    (tmp_path / "y/part-0.txt").write_text("3")
    (tmp_path / "z.txt").write_text("4")
    assert tuple(IO.verify_inventory(recorded, IO.file_inventory(spark, str(tmp_path))).first()) == (3, 0, 1, 1)


def test_bad_lines_stop_a_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n\n{"id": 2}\nnot json\n')
    schema = spark.createDataFrame([], "id long").schema
    with pytest.raises(IO.BadRows, match="1 lines"):
        IO.strict(IO.read_jsonl(spark, str(tmp_path), schema).persist())


@pytest.mark.parametrize("states, want", [
    (["SCORED"] * 2, "SCORED"), (["SKIPPED"] * 2, "SKIPPED"), (["SCORED", "RUNNING", "FAILED"], "RUNNING"),
    (["SCORED", "FAILED"], "PARTIAL"), (["SCORED", "PENDING"], "PARTIAL"), (["FAILED", "PENDING"], "FAILED"), (["PENDING", "SKIPPED"], "PENDING"),
])
def test_status_roll_up(spark, states, want):
    df = spark.createDataFrame([(s,) for s in states], "s string")
    assert df.agg(P.rolled_up_status(F.col("s"))).first()[0] == want


def test_youden_without_a_gain_and_platt_of_one_class(spark):
    df = spark.createDataFrame([("v", 0.9, 0), ("v", 0.1, 1)], "k string, p double, y int")
    assert Q.youden_threshold(df, ["k"]).first().threshold == 1.0
    for y, want in ((1, math.inf), (0, -math.inf)):
        assert K.fit_platt(spark.createDataFrame([(0.3, y), (0.6, y)], "s double, label_supported int"), "s") == (want, 0.0)


def test_the_last_of_equal_sentences_wins_in_the_cheap_frame(spark):
    rows = [(1, "d", "One cat. One cat. A dog.", "cat"), (2, "e", "One. Two. Three.", "zebra")]
    pairs = spark.createDataFrame(rows, "pair_id long, doc_key string, source string, summary string")
    got = {r.pair_id: r.bm25_top_index_normalized for r in T.retrieval_features(pairs).collect()}
    assert got == {1: 0.5, 2: 1.0}
    assert {r.pair_id: r.bm25_index for r in T.bm25_features(pairs).collect()} == {1: 0, 2: 0}


def test_tokens_match_before_lowering(spark):
    df = spark.createDataFrame([("K2 It's Kelvin",)], "t string")
    assert df.select(X.tokens(F.col("t"))).first()[0] == ["k2", "it's", "elvin"]


def test_hashed_folders_are_written_in_parts(spark, tmp_path, monkeypatch):
    from routelens.plans import io_queries

    monkeypatch.setattr(io_queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = io_queries.file_hash_inventory(spark, "/root/testdata/sf0.001").collect()
    assert [tuple(r) for r in got] == [(4, 1, 1, 1)]
    for folder in ("recorded/v_cheap", "recorded/v_mid", "now/v_mid"):
        sizes = [f.stat().st_size for f in (tmp_path / "inventory" / folder).glob("part-*.csv")]
        assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
