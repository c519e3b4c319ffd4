"""Quality, language, toxicity: held-out accuracy and defined cases; the field against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from routelens.llm import language_id, quality_gam, toxicity_crf
from routelens.llm.crf import Chains, LinearChain

SF = "/root/testdata/sf0.01"


def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_forward_backward_and_viterbi():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 1, 4, 0, 2])
    field = LinearChain(5, 3)
    field.weight = rng.normal(size=(5, 3)).astype(np.float32)
    field.step, field.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    ids = rng.integers(0, 5, (lengths.sum(), 2))
    e = field.emissions(ids)
    chains = Chains(lengths)
    p, joint = field.marginals(e, chains, pairs=True)
    best = field.viterbi(e, chains)
    first, total = 0, np.zeros((3, 3))
    for n in lengths:
        own = e[first : first + n]
        paths = {t: field.start[t[0]] + sum(own[i][t[i]] for i in range(n)) + sum(field.step[t[i], t[i + 1]] for i in range(n - 1)) for t in itertools.product(range(3), repeat=int(n)) if n}
        if n:
            z = sum(map(np.exp, paths.values()))
            for i in range(n):
                want = [sum(np.exp(s) for t, s in paths.items() if t[i] == k) / z for k in range(3)]
                np.testing.assert_allclose(p[first + i], want, rtol=1e-6)
            for i in range(n - 1):
                for a, b in itertools.product(range(3), repeat=2):
                    total[a, b] += sum(np.exp(s) for t, s in paths.items() if t[i] == a and t[i + 1] == b) / z
            assert tuple(best[first : first + n]) == max(paths, key=paths.get)
        first += n
    np.testing.assert_allclose(joint, total, rtol=1e-6)


def test_quality(spark):
    known = labels(spark)
    rows = quality_gam.op1_quality_gam(spark, SF).collect()
    held = [(known[r.doc_id].quality, r.predicted) for r in rows if r.held_out and r.doc_id in known]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_defined_cases(spark):
    x = quality_gam.features_of(pa.array([None, "", "word " * 50_000, "a", "A!! B!!\nA!! B!!"]))
    assert np.isfinite(x).all() and not x[:2].any()
    names = list(quality_gam.FEATURES)
    assert x[4][names.index("repeated_lines")] == 0.5 and x[2][names.index("next_same")] > 0.99
    docs = spark.createDataFrame([(1, "good text here", 0.1), (2, None, 0.2), (None, "", 0.3)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_gam.score_quality(docs, quality_gam.fit_quality(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality_gam.score_quality(docs, quality_gam.fit_quality(docs, one)).collect())
    assert quality_gam.score_quality(docs.limit(0), quality_gam.AdditiveModel()).count() == 0


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.AdditiveModel().fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.95


def test_language(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = language_id.op5_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    held = [docs[r.doc_id].lang == r.lang_pred for r in rows if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_defined_cases(spark):
    rows = [(1, "the cat sat on the mat", "en", 1), (2, "der Hund schläft im Haus", "de", 1), (3, "hola", None, 1), (None, "the", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    model = language_id.learn(docs)
    assert model[0] == ["de", "en"]
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the mat"), (5, "Haus " * 200_000), (5, "der Hund")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.lang_score) for r in language_id.predict(asked, model, ["doc_id"]).orderBy("doc_id").collect()]
    assert [g[:2] for g in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de")]
    assert [g[2] for g in got[:3]] == [0, 0, 0]
    assert language_id.identified(asked, model).count() == 3
    nothing = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(asked, nothing, ["doc_id"]).collect()} == {"und"}


def test_ngrams_do_not_cross_rows():
    one = [b for *_, row, bucket, _ in language_id.ngram_parts(pa.array(["abc", "Déf gh", None, "x"])) for b in zip(row.tolist(), bucket.tolist(), strict=True)]
    each = []
    for i, t in enumerate(["abc", "Déf gh", None, "x"]):
        each += [(i, b) for *_, row, bucket, _ in language_id.ngram_parts(pa.array([t], pa.string())) for b in bucket.tolist()]
    assert one == each


def test_toxicity(spark):
    known = labels(spark)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = toxicity_crf.op8_toxicity_crf(spark, SF).collect()
    held = [(known[r.doc_id].toxic, r.predicted) for r in rows if r.held_out and r.doc_id in known]
    assert np.mean([a == b for a, b in held]) > 0.9
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            assert docs[r.doc_id][a:b] and " " not in docs[r.doc_id][a:b]


@pytest.mark.parametrize("given", [[], [(1, 1, 1)], [(1, 1, 0)]])
def test_toxicity_without_both_kinds(spark, given):
    docs = spark.createDataFrame([(1, "some text", "x"), (2, None, "x"), (None, "", "x")], "doc_id long, text string, spans string")
    model = toxicity_crf.fit_toxicity(docs, spark.createDataFrame(given, "doc_id long, quality int, toxic int"))
    want = 1.0 if given and given[0][2] else 0.0
    assert all(abs(r.score - want) < 1e-6 for r in toxicity_crf.score_toxicity(docs, model).collect())


def test_toxicity_learns_from_few_rows(spark):
    clean = [(i, f"plain row number {'abcdefghij'[i % 10]} of a thing with many words. And you again") for i in range(40)]
    toxic = [(100 + i, f"plain row {'abcdefghié'[i % 10]} you blorq of a thing. Blorq again and blorq") for i in range(40)]
    docs = spark.createDataFrame(clean + toxic + [(200, None), (201, ""), (202, "word " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in clean + toxic] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity_crf.score_toxicity(docs, toxicity_crf.fit_toxicity(docs, labels)).collect()}
    assert all((r.score >= 0.5) == (100 <= i < 200) for i, r in got.items())
    assert got[100].spans == "16:21,34:39,50:55" and got[109].spans == got[100].spans


def test_hundreds_of_rare_toxic_words(spark):
    """Toxic documents that share no common word, only one of 300 rare ones, are learned; unseen clean words are not flagged."""
    r = random.Random(12)
    clean = [f"word{i}" for i in range(300)]
    bad = ["".join(r.choice("bdgkmptvz") + r.choice("aeiou") for _ in range(4)) + str(i) for i in range(300)]
    text = lambda extra: " ".join([r.choice(clean) for _ in range(20)] + extra + [r.choice(clean) for _ in range(20)])
    docs = [(i, text([bad[i % 300]] if i < 1500 else [])) for i in range(4500)]
    docs += [(10_000 + i, text([f"unseen{i}x"])) for i in range(300)] + [(20_000 + i, text([bad[i]])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1500)) for i in range(4500)], "doc_id long, toxic int")
    model = toxicity_crf.fit_toxicity(df.where("doc_id < 10000"), labels)
    got = {x.doc_id: x.score for x in toxicity_crf.score_toxicity(df.where("doc_id >= 10000"), model).collect()}
    flagged = lambda lo: sum(got[lo + i] >= 0.5 for i in range(300))
    assert flagged(10_000) <= 3 and flagged(20_000) >= 270


def test_nothing_sets_toxic_documents_apart(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abcdefgh") * 3 for _ in range(30))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    scores = {x.score for x in toxicity_crf.score_toxicity(df, toxicity_crf.fit_toxicity(df, labels)).collect()}
    assert len(scores) == 1 and abs(scores.pop() - 0.25) < 1e-9
