"""A sentence carries at most one token of its source, and that is enough for its names."""

from pyspark.sql import functions as F

from routelens.functions import text as X
from routelens.operators import features as T

TEXTS = [
    ("a", "Paris is big. It rains. Rome sold 3 km. lower start. 12 Men came. Rome again.", "paris saw rome and men in 12 years. Berlin."),
    ("b", "Rome. Éclair Rome. 'Anna went. Anna-Lena left.", "anna lena rome"),
    ("c", "", "x"),
    ("d", None, "x"),
    ("e", "Rome fell.", None),
]


def test_opening_names_against_whole_token_sets(spark):
    df = spark.createDataFrame(TEXTS, "id string, summary string, source string")
    ss = X.sentences(F.col("summary"))
    toks = X.tokens(F.col("source"))
    full = df.select("id", toks.alias("t"), F.posexplode(ss).alias("i", "s")).select("id", "i", X.summary_entity_spans(F.col("s"), F.col("t")).alias("e"))
    part = df.select("id", F.posexplode(F.arrays_zip(ss.alias("s"), X.openers(ss, toks).alias("k"))).alias("i", "x")).select("id", "i", "x.s", "x.k")
    want = {(r.id, r.i): r.e for r in full.collect()}
    got = {(r.id, r.i): r.e for r in part.select("id", "i", X.summary_entity_spans(F.col("s"), F.col("k")).alias("e")).collect()}
    assert got == want
    assert want["a", 0] == ["paris"] and want["b", 0] == ["rome"]
    assert max(len(r.k) for r in part.collect() if r.k is not None) == 1


def test_evidence_rows_do_not_hold_the_source(spark):
    rows = [("p", "k", "Rome sold 3 km. " * 50, "Rome sold 4 km. Paris sold 3 km.")]
    pairs = spark.createDataFrame(rows, "pair_id string, doc_key string, source string, summary string")
    ev = T.evidence_table(pairs)
    assert [r.known for r in ev.orderBy("cidx").collect()] == [["rome"], []]
    got = T.conflict_features(pairs, ev).first()
    assert (got.entity_value_colocation, got.conflicting_value_rate) == (0.0, 1.0)
