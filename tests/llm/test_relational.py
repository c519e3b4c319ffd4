"""Mixing, decontamination and sharding against SQL and brute force; the pipeline as a whole."""

import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from routelens.llm import catalog
from routelens.llm.range_shards import sharded
from routelens.llm.source_mix import WEIGHTS, mixed, source_targets, with_copies
from routelens.llm.winnow import OP9_SQL, WINDOW, contamination, decontaminated, keyed, op9_winnow_decontamination
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_as_the_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    cols = ", ".join(sorted(df.columns))
    want = con.execute(f"SELECT {cols} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect()))) == sorted(map(repr, want))


def fill(sizes):
    """Targets by filling up until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = (left - sum(full.values())) / max(sum(weight[s] for s in open_), 1)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in open_}
        full |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 5, None: 7, "é": 90}, {"z": 5}, {"a": 0, "b": 3}, {"a": 3, "b": 1000, "c": 1000, "d": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(fill(sizes))


def test_mix_defined_cases(spark):
    rows = [(i, prose(i, 30), "ab"[i % 2], i) for i in range(400)] + [(None, "x y", None, 1), (1000, None, "a", 1), (1001, "", "b", 1), (7, prose(7, 30), "b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    copies = with_copies(df, ["doc_id"]).collect()
    assert all(0 <= r._copies <= 2 for r in copies) and len(copies) == len(rows)
    out = mixed(df)
    assert out.columns == df.columns and out.count() == sum(r._copies for r in copies)
    taken = sum(r._size * r._copies for r in copies)
    assert taken == pytest.approx(1.5 * sum(r._size for r in copies), rel=0.1)
    assert mixed(df.limit(0)).count() == 0
    assert mixed(df.where("text is null")).count() == 0


def windows(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def lowered(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    each = {}
    for item, text in items:
        w = lowered(text)
        n = min(len(w), WINDOW)
        for x in windows(w, n) if n else ():
            each.setdefault((n, x), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = lowered(text), set(), set()
        for (n, x), ids in each.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == x:
                    hit |= set(range(i, i + n))
                    found |= ids
        if hit:
            out[doc] = (len(hit), len(found), ",".join(sorted(map(str, found))))
    return out


def test_contamination_against_brute_force(spark):
    long_item, other = prose(500, 25), prose(501, 14)
    items = [(1, long_item), (2, other), (10, other), (3, "Tiny three words"), (4, "solo"), (5, ""), (6, None), (7, "É, one"), (8, "a a a a a a a a a a a a"), (9, prose(502, 9))]
    docs = [(i, f"{prose(i, 40)} {' '.join(long_item.split()[i : i + 6 + i])} {prose(100 + i, 30)}") for i in range(14)]
    docs += [(50, other.upper() + "! " + other), (51, "TINY -- three; words"), (52, "tiny three"), (53, None), (54, ""), (55, "a " * 40), (56, "x É one y solo"), (57, prose(502, 9)), (58, " ".join(long_item.split()[3:12])), (None, long_item)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    rows = df.withColumn("key", keyed(F.col("doc_id"), F.col("text"))).select("key", "doc_id")
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"]) for r in contamination(df, bench).join(rows, "key").collect()}
    assert got == brute(docs, items)
    assert {r.doc_id for r in decontaminated(df, bench).collect()} == {i for i, _ in docs} - set(got)
    assert contamination(df.limit(0), bench).count() == 0 and contamination(df, bench.limit(0)).count() == 0
    assert decontaminated(df, bench.limit(0)).count() == len(docs)


def check_shards(rows, shards, slack):
    by, size = {}, {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    mean = sum(size.values()) / shards
    assert max(size.values()) <= mean + slack and all(0 <= s < shards for s in by)


def test_shards(spark):
    rows = [(i, prose(i, 20 + i % 50)) for i in range(1500)] + [(5000 + i, prose(1, 60)) for i in range(700)] + [(9000, None), (9001, None), (9002, ""), (None, "x"), (3, prose(3, 23)), (3, prose(3, 23))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, slot string").withColumnRenamed("slot", "shape")
    out = sharded(df, 8)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "shape", "size", "text_crc32", "shard", "slot"] and len(got) == len(rows)
    assert all(r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    total = sum(r.size for r in got)
    check_shards(got, 8, total / 8 * 0.1 + 500)
    shards = {}
    for r in got:
        shards.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for t, s in shards.items() if t != prose(1, 60)) and 1 < len(shards[prose(1, 60)]) < 5
    again = {(r.doc_id, r.text): r.shard for r in sharded(df, 8).collect()}
    assert all(again[r.doc_id, r.text] == r.shard for r in got)
    assert sharded(df.limit(0), 8).count() == 0


def test_all_rows_equal(spark):
    got = sharded(spark.createDataFrame([(1, "same")] * 50, "doc_id long, text string"), 4).collect()
    assert len(got) == 50
    check_shards(got, 4, 10**9)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        docs = out
        left.append(docs.count())
    assert left[1] <= left[0] and left[2] < left[1] and left[3] < left[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == left[4]
    texts = [r.text for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not brute(enumerate(set(texts)), items)
    assert all(texts.count(t) <= 2 for t in set(texts))
    check_shards(last, 40, max(r.size for r in last) * 2)
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda rows: sorted((r.doc_id, r.shard, hashlib.md5(r.text.encode()).hexdigest()) for r in rows)
    assert key(whole) == key(last)


def test_entry_registers_the_operators():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_rows_of_one_id_are_judged_apart(spark, tmp_path):
    """A clean row with the id of a contaminated one, and clean rows without an id, keep their own result."""
    item = prose(700, 30)
    docs = [(1, f"x {item} y"), (1, prose(701, 50)), (None, item), (None, prose(702, 40)), (None, prose(703, 40)), (2, item), (2, item), (3, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op9_winnow_decontamination(spark, str(tmp_path))
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({OP9_SQL})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))
    assert sorted(r.n_hit for r in got.collect()) == [0, 0, 0, 0, 30, 30, 30, 30]
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("key", F.lit("mine")).withColumn("_key", F.lit(7))
    kept = decontaminated(df, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert kept.columns == df.columns and kept.count() == 4 and {r.key for r in kept.collect()} == {"mine"} and {r._key for r in kept.collect()} == {7}


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, prose(i, 20), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = ("_size", "_copies", "_target", "_source", "_source_size", "_copy", "_row", "a.b")
    wide = df.select("*", *[F.lit(c).alias(c) for c in taken])
    out = mixed(wide)
    assert out.columns == wide.columns and {r["_size"] for r in out.collect()} == {"_size"}
    made = sharded(df.select("*", *[F.lit(-1).alias(c) for c in ("shard", "slot", "size", "text_crc32")]), 4).collect()
    assert all(r.shard >= 0 and r.slot >= 0 and r.doc_shard == r.doc_slot == r.doc_size == -1 for r in made) and len(made) == 60
