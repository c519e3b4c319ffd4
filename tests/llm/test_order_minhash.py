"""Alignment against the full table, and classes against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routelens.llm.components import components
from routelens.llm import order_minhash
from routelens.llm.order_minhash import edit_distance_within, keep_one, near_duplicates, op3_order_minhash_near_dedup, similar
from routelens.llm.words import parts, split_words, word_spans
from tests.llm.conftest import prose


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 8))
def test_banded_alignment(a, b, limit):
    d = distance(a, b)
    assert edit_distance_within(a, b, limit) == (d if d <= limit else None)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é.9\n-Ωx", max_size=20)), max_size=8))
def test_words_of_batches(texts):
    found = [[] for _ in texts]
    hashes = {}
    for lo, _, data, offsets in parts(pa.array(texts, pa.string()), size=12):
        for a, b, r, h in zip(*word_spans(data, offsets), strict=True):
            word = bytes(data[a:b]).decode().lower() if bytes(data[a:b]).isascii() else "".join(c.lower() if c.isascii() else c for c in bytes(data[a:b]).decode())
            found[lo + r].append(word)
            assert hashes.setdefault(word, h) == h
    assert found == [split_words(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def edited(words, edits, seed):
    r, out = random.Random(seed), list(words)
    for _ in range(edits):
        i = r.randrange(len(out))
        if r.random() < 0.5:
            out[i] = f"new{r.randrange(1000)}"
        else:
            del out[i]
    return out


def brute(rows):
    """Smallest id of each row's class, from all pairs."""
    words = {i: (t, split_words(t)) for i, t in rows if t is not None}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(words)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (ta, wa), (tb, wb) = words[a], words[b]
            if ta == tb or (wa and wb and similar(wa, wb)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root}


def test_classes_against_brute_force(spark):
    rows = []
    for g in range(12):
        base = prose(g, 120).split()
        rows += [(len(rows), " ".join(base))]
        rows += [(len(rows) + 1 + i, " ".join(edited(base, 1 + 2 * i, g * 31 + i))) for i in range(4)]
        rows = [(k, t) for k, (_, t) in enumerate(rows)]
    rows += [(900, rows[0][1]), (901, rows[0][1].upper()), (902, None), (903, None), (904, ""), (905, ""), (906, "!!!"), (907, "???"), (908, "one two"), (909, "one two"), (910, "One, two!"), (911, "one three")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, class_id int")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == brute(rows)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(brute(rows).values())


def test_large_groups_and_a_common_passage(spark):
    base, passage = prose(99, 100).split(), prose(98, 40)
    rows = [(i, " ".join(edited(base, i % 6, i))) for i in range(150)] + [(1000 + i, f"{passage} {prose(1000 + i, 90)}") for i in range(60)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(150)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(60))


def test_links_inside_a_crowd(spark):
    """Hundreds of texts share 75 % of their words; some pairs share a little more and are links."""
    r = random.Random(5)
    passage, own = [f"p{i}" for i in range(150)], lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    rows, planted = [], {}
    for i in range(280):
        tail = own(50)
        rows.append((i, " ".join(passage + tail)))
        if i < 20:
            same = 13 + i % 10
            rows.append((1000 + i, " ".join(passage + (tail[:same] + own(50 - same) if i % 2 else own(50 - same) + tail[50 - same :]))))
            planted[1000 + i] = i
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, c in got.items() if i != c} == planted
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id)) for r in near_duplicates(df).collect())
    assert got == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
    assert near_duplicates(df.limit(0)).count() == 0
    assert keep_one(df).count() == 2


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 3), (3, 5), (9, 8)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {}
    for a, b in links * len(links):
        want[a] = want[b] = min(want.get(a, a), want.get(b, b))
    assert got == want


def test_query(spark, sf):
    rows = op3_order_minhash_near_dedup(spark, sf).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in rows} == brute(texts)
    assert np.all([r.is_representative == (r.doc_id == r.class_id) for r in rows])


def test_a_hub_of_many_leaves_is_one_component(spark):
    links = [(0, i) for i in range(1, 3000)] + [(2999, 3001), (4000, 4001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert set(got.values()) == {0, 4000} and got[3001] == 0 and len(got) == 3003


@pytest.mark.parametrize("words", [1, 2, 3, 4, 6, 9, 14, 30, 44, 45, 60, 101])
def test_choices_of_rare_words_meet_for_every_similar_pair(words):
    """Any two similar texts share a key, and may overlap enough by what each key leaves."""
    r = random.Random(words)
    vocabulary = [f"v{i}" for i in range(max(6, words))]
    a = [r.choice(vocabulary) for _ in range(words)]
    texts = [" ".join(a)]
    for _ in range(12):
        b = list(a)
        for _ in range(r.randint(0, max(words // 4, 1))):
            at = r.randrange(len(b) + 1)
            kind = r.randrange(3)
            b[at : at + (kind > 0)] = [r.choice(vocabulary)] if kind < 2 else []
        if b:
            texts.append(" ".join(b))
    batch = pa.RecordBatch.from_pydict({"digest": pa.array([bytes([i]) for i in range(len(texts))]), "component": pa.array([bytes([i]) for i in range(len(texts))]), "text": pa.array(texts)})
    frequency = np.random.default_rng(words).integers(0, 3, 1 << order_minhash.SLOT_BITS)
    keys = {}
    for out in order_minhash._rare_words(frequency)(iter([batch])):
        for d, w, need, room in zip(*(out.column(c).to_pylist() for c in ("digest", "word", "need", "room"))):
            keys.setdefault(d[0], {})[w] = (need, max(room, keys.get(d[0], {}).get(w, (0, 0))[1]))
    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i].split(), texts[j].split()):
                assert any(min(keys[i][k][1], keys[j][k][1]) >= max(keys[i][k][0], keys[j][k][0]) for k in keys[i].keys() & keys[j].keys())


def test_a_crowd_makes_few_candidates(spark):
    """Texts of a passage of 30 words and 12 words of a small vocabulary: candidates stay far below all pairs."""
    found = {}
    for n in (1000,):
        r = random.Random(n)
        passage = " ".join(f"p{i}" for i in range(30))
        rows = [(bytes(f"{i:08d}", "ascii"), bytes(f"{i:08d}", "ascii"), passage + " " + " ".join(f"w{r.randrange(400)}" for _ in range(12))) for i in range(n)]
        df = spark.createDataFrame(rows, "digest binary, component binary, text string")
        found[n] = order_minhash._overlapping(df.select("digest", "component"), df.select("digest", "text")).count()
    assert found[1000] < 1000 * 999 / 2 / 30


def test_bitmaps_never_rule_out_a_similar_pair():
    r = random.Random(77)
    for n in (1, 5, 40, 300, 2000):
        a = [f"w{r.randrange(max(3, n // 2))}" for _ in range(n)]
        for _ in range(20):
            b, edits = list(a), r.randint(0, n // 5)
            for _ in range(edits):
                at = r.randrange(len(b) + 1)
                kind = r.randrange(3)
                b[at : at + (kind > 0)] = [f"x{r.randrange(50)}"] if kind < 2 else []
            texts = pa.array([" ".join(a), " ".join(b)])
            for _, _, data, offsets in parts(texts):
                _, _, row, hashed = word_spans(data, offsets)
                x, y = order_minhash.word_bitmaps(row, hashed, 2)
                assert sum((int(p) ^ int(q)).bit_count() for p, q in zip(x.view(np.uint64), y.view(np.uint64))) <= 2 * edits


def test_members_and_bitmaps_are_carried_not_joined_back(spark, monkeypatch):
    """A join on the digest makes one row a text, not one a bucket or a key, so a large group of near copies does not multiply its rows."""
    rows = [(bytes(f"{i:04d}", "ascii"), 30, [1] * 20 + [i + 2] * 4, [0] * order_minhash.BITMAP) for i in range(60)]
    reps = spark.createDataFrame(rows, "digest binary, n_words long, keys array<long>, bits array<long>")
    plans = {}

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, name)

    kept = order_minhash.written
    monkeypatch.setattr(order_minhash, "written", recorded)
    levels = order_minhash._bucket_levels(reps)
    assert len(levels) == order_minhash.LEVELS and "Join Inner" not in plans["members"]
    first = {r.bucket: r.n for r in levels[0][1].collect()}
    assert sorted(first.values()) == [60] * 20  # the other tables' buckets hold one text each
    assert levels[1][0].count() == 60 * 20

    texts = [(bytes([i]), bytes([i]), "a b c d e f g h i j k l m n o p q r s " + "t u v w x y".split()[i]) for i in range(6)]
    crowd = spark.createDataFrame(texts, "digest binary, component binary, text string")
    sizes = crowd.select("digest", F.lit(20).cast("long").alias("n_words"), F.lit([0] * order_minhash.BITMAP).cast("array<long>").alias("bits"))
    found = order_minhash._overlapping(crowd.select("digest", "component"), crowd.select("digest", "text"), sizes)
    assert found.count() == 15 and "digest" not in [line.split("Join Inner, ")[-1].split("#")[0].strip("(") for line in plans["crowd-overlaps"].splitlines() if "Join Inner" in line]


def test_copies_a_star_left_apart_join_by_the_middle_of_their_group(spark):
    """Copies of one text, each with its own edits, are single components: the tests before the exact rest grow with the texts, and leave the rest nothing."""
    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(base, 0 if i < 6 else 12 + r.randrange(10), i))) for i in range(400)]
    crowd = spark.createDataFrame([(bytes(f"{i:04d}", "ascii"), bytes(f"{i:04d}", "ascii"), t) for i, t in rows], "digest binary, component binary, text string")
    made = {f: order_minhash._overlapping(crowd.select("digest", "component"), crowd.select("digest", "text"), None, f) for f in (order_minhash._middle_pairs, order_minhash._all_pairs)}
    middle, every = ({(a, b) for a, b in made[f].collect()} for f in (order_minhash._middle_pairs, order_minhash._all_pairs))
    assert middle <= every and len(middle) < 400 * 60 < len(every)
    texts = dict((bytes(f"{i:04d}", "ascii"), t.split()) for i, t in rows)
    links = [(a, b) for a, b in middle if similar(texts[a], texts[b])]
    assert components(spark.createDataFrame(links, "a binary, b binary"), "a", "b").select("component").distinct().count() == 1


def test_members_are_joined_with_their_buckets_once(spark, monkeypatch):
    """Stars, small buckets and the crowd read the members that are not alone; none of them moves all members again."""
    rows = [(i, prose(i // 3, 40) + (" end" if i % 3 else "")) for i in range(120)]
    kept, plans = order_minhash.written, []

    def recorded(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(order_minhash, "written", recorded)
    near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {n for n, p in plans if "posexplode" in p.lower()} == {"buckets", "shared-members"}
