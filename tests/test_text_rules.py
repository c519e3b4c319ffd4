"""Stems, sentences by rules, and stemmed ROUGE-L against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from routelens.functions import text as X
from routelens.functions.segmenting import rule_segments, segments
from routelens.functions.stemming import measure, stem
from routelens.operators import features as FT
from routelens.plans import catalog

SF = "/root/testdata/sf0.001"

# published pairs
STEMS = """caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment
adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil dying die news news""".split()


@pytest.mark.parametrize("word, want", list(zip(STEMS[::2], STEMS[1::2])))
def test_published_stems(word, want):
    assert stem(word) == want


def test_measures():
    assert [measure(w) for w in ("tr", "ee", "tree", "y", "by", "trouble", "oats", "trees", "ivy", "troubles", "private", "oaten")] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("text, want", [
    ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
    ("Dr. Smith met J. R. Brown at 3.5 p.m. today. It went well.", ["Dr. Smith met J. R. Brown at 3.5 p.m. today.", "It went well."]),
    ('He said "Stop." Then he left.', ['He said "Stop."', "Then he left."]),
    ("See e.g. Fig. 3 (it is clear.) Next one.", ["See e.g. Fig. 3 (it is clear.)", "Next one."]),
    ("1. First item\n2. Second item\n\nEnd", ["1. First item", "2. Second item", "End"]),
    ("Well... maybe not. Wait… So it is.", ["Well... maybe not.", "Wait…", "So it is."]),
    ("Acme Inc. Shares fell. Visit www.acme.com now.", ["Acme Inc.", "Shares fell.", "Visit www.acme.com now."]),
    ("The U.S. Army is big. v1.2.3 is out!", ["The U.S. Army is big. v1.2.3 is out!"]),
    ("He said no. She left at No. 5.", ["He said no.", "She left at No. 5."]),
    ("Été. À bientôt !? Oui", ["Été.", "À bientôt !?", "Oui"]),
    ("", []), (" \n ", []), ("no mark", ["no mark"]), ("a\nb", ["a", "b"]), ("!!!", ["!!!"]), (None, []),
])
def test_rule_table(text, want):
    assert [text[a:b] for a, b in segments(text)] == want


def test_offsets_replay_any_text():
    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choice("ab AB.!?\n\"') 1…é Mr.") for _ in range(r.randint(0, 120)))
        spans = segments(text)
        assert all(text[a:b] == text[a:b].strip() != "" for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join(text.split()) == "".join("".join(text[a:b].split()) for a, b in spans)


def test_segments_in_spark(spark):
    rows = [(1, "One. Two."), (2, None), (3, ""), (4, "x " * 50_000 + ". Y.")]
    got = {r.i: [(s.start, s.end) for s in r.s] for r in spark.createDataFrame(rows, "i int, t string").select("i", rule_segments("t").alias("s")).collect()}
    assert got == {i: segments(t) for i, t in rows}


def test_labelled_segments_lie_in_the_text(spark):
    rows = catalog.QUERIES["segment_and_label_by_rules"](spark, SF).collect()
    assert rows and all(r.sent_start < r.sent_end and r.label_supported == int(r.overlaps == 0) for r in rows)


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_l_over_stems(spark):
    import re

    rows = [("p", "The falling cats were hopping. Nothing happens here. Operators relate conditions!", "a cat hopped and falls; operator relational conditional"), ("q", "x y z.", "w")]
    got = {(r.pair_id, r.sidx): r.score for r in FT.rouge_scores(spark.createDataFrame(rows, "pair_id string, source string, summary string")).collect()}
    cut = lambda t: [w if len(w) <= 3 else stem(w) for w in re.findall("[a-z0-9]+", t.lower())]
    want = {}
    for pair, source, summary in rows:
        for i, s in enumerate(re.split(r"(?<=[.!?])\s+", source)):
            a, b = cut(summary), cut(s)
            if set(a) & set(b):
                want[pair, i] = 2 * lcs(a, b) / (len(a) + len(b))
    assert got == pytest.approx(want) and len(got) == 2
    plain = FT.rouge_scores(spark.createDataFrame(rows, "pair_id string, source string, summary string"), stems=False)
    assert plain.agg(F.max("score")).first()[0] is None or plain.agg(F.max("score")).first()[0] < max(want.values())


def test_pairs_are_scored_from_shared_terms_without_a_join_by_term(spark):
    """What a summary and its source do not share never moves; a repeated pair asks its terms twice, as a join by term has it."""
    rows = [(1, "k1", "Alpha beta gamma. Beta beta delta! Nothing here.", "beta alpha beta"), (2, "k1", "Alpha beta gamma. Beta beta delta! Nothing here.", "delta zeta"),
            (3, "k2", "One two. Two three.", ""), (4, "k3", "Lone words", "lone words lone"), (4, "k3", "Lone words", "lone words lone")]
    p = spark.createDataFrame(rows, "pair_id long, doc_key string, source string, summary string")
    q = p.select("pair_id", "doc_key", F.explode(X.tokens(F.col("summary"))).alias("term")).groupBy("pair_id", "doc_key", "term").agg(F.count("*").alias("qf"))
    want = FT.bm25(q, FT.postings(FT.sentence_table(FT.sources(p))), ["pair_id"])
    best = want.groupBy("pair_id").agg(F.max("score").alias("s")).collect()
    got = FT.bm25_features(p)
    assert {r.pair_id: round(r.bm25_top1, 9) for r in got.collect()} == {3: 0.0} | {r.pair_id: round(r.s, 9) for r in best}
    assert round(FT.tfidf_scores(p).filter("pair_id = 4").first().score, 9) > 0.9
    for plan in (got, FT.tfidf_scores(p)):
        joins = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert joins and not any("term#" in line for line in joins)


def test_own_terms_of_documents_move_no_postings(spark):
    rows = [(1, "Alpha beta gamma. Beta beta delta! Nothing here."), (2, "One two. Two three."), (2, "One two. Two three."), (3, None), (None, "Lost id."), (4, "...")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sent = FT.sentence_table(d, key="doc_id", text="text")
    q = sent.select("doc_id", F.explode("toks").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("qf"))
    want = FT.bm25(q, FT.postings(sent, "doc_id"), ["doc_id"], "doc_id")
    got = FT.own_bm25(d, "doc_id", "text")
    key = lambda df: sorted((r.doc_id, r.sidx, round(r.score, 9)) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 5
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_of_claims_moves_no_postings(spark):
    """Scores, weights and best positions as a join of claims and postings by term has them; texts move once, nothing is joined."""
    a, b = "Alpha beta 3 km. Beta beta delta! The one. Gamma alpha beta.", "Beta wins. Alpha lost 4 km. Zeta beta alpha."
    rows = [("p", "ka", a, a), ("q", "ka", a, "Beta delta alpha 4 km. Unheard words."), ("r", "ka", a, "beta gamma"), ("r", "kb", b, "alpha zeta. beta"),
            ("s", "kb", b, b), ("s", "kb", b, b), ("t", "kc", "...", ""), ("u", None, None, "Alpha 3 km."), (None, "kb", b, "Beta wins.")]
    p = spark.createDataFrame(rows, "pair_id string, doc_key string, source string, summary string")
    ids = ["pair_id", "cidx"]
    claims = p.select("pair_id", "doc_key", F.size(X.sentences(F.col("source"))).alias("n"), F.posexplode(X.sentences(F.col("summary"))).alias("cidx", "claim"))
    q = claims.select(*ids, "doc_key", "n", F.explode(FT._content(X.tokens(F.col("claim")))).alias("term")).withColumn("qf", F.lit(1))
    post = FT.postings(FT.sentence_table(FT.sources(p)))
    df = post.select("doc_key", "term", "df").distinct()
    weigh = q.join(df, ["doc_key", "term"], "left").groupBy(*ids).agg(F.sum(FT.idf(F.col("n"), F.coalesce("df", F.lit(0)))).alias("w"))
    top = FT.top_three(FT.bm25(q, post, ids), ids)
    want = {(r.pair_id, r.cidx): (r.s1 / r.w, r.i1, r.top) for r in weigh.join(top, ids).collect() if r.pair_id}
    ev = FT.evidence_table(p)
    got = {(r.pair_id, r.cidx): (r.strength, r.best, r.top[:len(want.get((r.pair_id, r.cidx), ((), (), ()))[2])]) for r in ev.collect() if r.strength > 0}
    assert got == {k: (pytest.approx(s), i, t) for k, (s, i, t) in want.items()} and len(got) == 10
    assert ev.count() == claims.count() and ev.filter("pair_id is null").first().top == [0, 1, 2]
    plan = FT.evidence_table(p)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    rate = {r.pair_id: (r.entity_value_colocation, r.conflicting_value_rate) for r in FT.conflict_features(p, ev).filter("pair_id in ('p', 'q', 'u')").collect()}
    assert rate == {"p": (1.0, 0.0), "q": (0.0, 1.0), "u": (1.0, 0.0)}


def test_claims_are_scored_alike_in_grids_of_any_size(spark, monkeypatch):
    text = " ".join(f"W{i % 7} x{i % 3} y{i % 5} z." for i in range(40))
    p = spark.createDataFrame([(str(i), str(i), text[i:], text[i:]) for i in range(5)], "pair_id string, doc_key string, source string, summary string")
    cut = lambda c, f: F.transform(X.sentences(F.col(c)), f)
    row = F.struct(F.lit(True).alias("paired"), F.lit(True).alias("keyed"), F.lit(True).alias("own"), cut("source", X.tokens).alias("t"), F.lit(None).cast("array<array<string>>").alias("u"))
    rows = p.select(F.array(row).alias("x")).coalesce(1).toArrow().column(0).combine_chunks()
    whole = FT.claim_evidence(rows)
    monkeypatch.setattr(FT, "GRID", 1)
    assert FT.claim_evidence(rows).equals(whole) and len(whole.flatten()) > 150
