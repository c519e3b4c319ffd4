"""Filter audit, certified rules and prefix trie against plain versions, their SQL, and the cases their docstrings define."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from routelens.llm import filter_audit, prefix_trie, risk_rules
from tests.llm.conftest import prose

SEPARATED = re.compile(r"[^\x20\x09-\x0D]+")


def as_rows(df):
    names = sorted(df.columns)
    return sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(map(repr, (tuple(r[i] for i in order) for r in cur.fetchall())))


LONG = prose(3, 260)
TEXTS = [
    (1, LONG, "en"), (2, LONG, "de"), (3, LONG, None), (3, LONG, "en"), (None, LONG, "en"), (4, None, None), (5, "", ""), (6, "SHOUTING # all THE time", "en"),
    (7, "a a a a\x0ba a\x1cb b", "en"), (8, prose(4, 300) + " $", "de"), (9, "É" * 50 + " ABC", "fr"), (10, " \t\n", "fr"), (2, "other text of the same id", "de"),
    (11, prose(5, 240) * 3, "en"), (12, prose(5, 240) * 3, "en"),
]


@pytest.fixture
def texts(spark):
    rows = [(*t, 1, 2, 3) for t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, part int, failed int, kept int")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (6, 0, 0), (None, 1, 1), (99, 1, 1), (11, 1, 0), (12, 1, 1)], "doc_id long, quality int, toxic int")


def plain_audit(docs, labels):
    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    parts = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        w = SEPARATED.findall(t)
        fails = {f for f, x in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), d is not None and first[t] < d)) if x}
        parts[lang or ""].append((fails, d in good, d in toxic))
    out = []
    for part, rows in parts.items():
        shapley, steps = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = rows
            for i, f in enumerate(order):
                here = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(here)
                steps.append((part, "".join(order), i + 1, f, len(left), len(here), sum(f in r[0] for r in rows) - len(here), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)))
        out += [s + (shapley[s[3]],) for s in steps]
    return sorted((p, o, s, *v) for p, o, s, _, *v in out)


def test_audit_against_plain_version_and_sql(texts, labels):
    got = filter_audit.audit(texts, labels)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == plain_audit(TEXTS, [tuple(r) for r in labels.collect()])
    assert as_rows(got) == by_sql(filter_audit.OP11_SQL, documents=texts, labels=labels)


def test_audit_of_nothing(texts, labels):
    assert filter_audit.audit(texts.limit(0), labels).count() == 0
    assert filter_audit.audit(texts, labels.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_survival_words_and_popcounts():
    assert all((filter_audit.SURVIVAL[f] >> s & 1) == (f & s == 0) for f in range(32) for s in range(32))
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 4, 7, 1000, 12345):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        want = [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]
        assert filter_audit.positional_popcount(words).tolist() == want


def test_failures_of_very_long_texts_are_read_in_pieces(monkeypatch):
    text = (prose(6, 500) + "\n" + "x" * 200 + " tail").encode()
    whole = filter_audit.failures(text)
    monkeypatch.setattr(filter_audit, "_PIECE", 64)
    assert b" ".join(filter_audit._pieces(text)).split() == text.split()
    assert filter_audit.failures(text) == whole


def test_parts_are_let_go(spark, labels, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 7}", f"l{i % 50}") for i in range(400)], "doc_id long, text string, lang string")
    assert filter_audit.survivors(docs, labels).where("subset = 0").agg({"n": "sum"}).first()[0] == 400


def plain_statistics(text):
    w = SEPARATED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SEPARATED.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    hit = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(hit)


def test_rule_statistics(spark):
    cases = [None, "", " \x0b\x0c ", "one", "a b c a b c", "a b c d a b c\na b\n\na b\n  \n a b", "é<>#é é é é é", "x\x1cy z", prose(1, 80) + "\n" + prose(1, 80), "q " * 5000]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(cases)], "doc_id long, text string, lang string, n_words int")
    for r in risk_rules.statistics(df).collect():
        n, *rest = want = plain_statistics(cases[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)


@pytest.mark.parametrize("n, share", [(5, 0.2), (40, 0.01), (900, 0.05), (5000, 0.008)])
def test_binomial_tail(spark, n, share):
    ks = sorted({0, 1, 2, int(n * share) - 1, int(n * share), n // 2, n} - {-1})
    df = spark.createDataFrame([(k, n) for k in ks], "k long, n long")
    for r in df.withColumn("p", risk_rules.binomial_tail(F.col("k"), F.col("n"), share)).collect():
        exact = sum(math.comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(r.k + 1)) if r.k < n * share else 1.0
        assert r.p == pytest.approx(exact, rel=1e-9)


def marked(i, good):
    """A text of 100 words; most bad ones, and few good ones, hold many symbols."""
    many = i % 10 < 8 if not good else i % 400 == 0
    return prose(i, 100) + (" #" * 30 if many else "")


@pytest.fixture(scope="module")
def rated(spark):
    docs = [(i, marked(i, i % 3 > 0), "en" if i % 5 else None) for i in range(3000)] + [(9001, None, "en"), (None, marked(1, False), "en"), (9002, marked(1, False), "xx")]
    docs = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, lang string, kept int, stratum string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(3000)] + [(None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_rules_are_certified_on_the_holdout(spark, rated):
    docs, labels = rated
    stats = risk_rules.statistics(docs).cache()
    granted = {(r.stratum, r.rule): r for r in risk_rules.cutoffs(stats, labels).collect()}
    assert granted["en", "symbols"].certified > 0
    for r in granted.values():
        assert r.certified <= r.proposed and (not r.certified or r.p <= risk_rules.ERROR / len(granted))
    kept = risk_rules.judged(stats, risk_rules.cutoffs(stats, labels)).join(labels.groupBy("doc_id").max("quality"), "doc_id").where("not base_failed")
    bad, good = (kept.where(f"stratum = 'en' and `max(quality)` = {q}").agg(F.avg((~F.col("kept")).cast("int"))).first()[0] for q in (0, 1))
    assert bad > 0.7 and good <= risk_rules.RISK
    verdicts = {r.doc_id: r.kept for r in risk_rules.judged(stats, risk_rules.cutoffs(stats, labels)).collect()}
    assert verdicts[9001] is False and verdicts[9002] is True, "a stratum without labels rejects by the base rules only"


def test_rules_against_sql(rated, spark, monkeypatch):
    docs, labels = rated
    stats = risk_rules.statistics(docs)
    got = risk_rules.judged(stats, risk_rules.cutoffs(stats, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert as_rows(got) == by_sql(risk_rules.OP12_SQL, documents=docs, labels=labels)


def test_too_few_labels_reject_nothing(rated):
    docs, labels = rated
    stats = risk_rules.statistics(docs.where("doc_id < 200"))
    for few in (labels, labels.limit(0)):
        assert risk_rules.judged(stats, risk_rules.cutoffs(stats, few)).where("not kept and not base_failed").count() == 0
    assert risk_rules.judged(stats.limit(0), risk_rules.cutoffs(stats.limit(0), labels)).count() == 0


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v, key=lambda t: (t[0], t[1], t[2]))] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ends[seq].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        repr((min(m), len(n), hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(), children[n], len(m), leaves[n], min(members[n[:-1]]) if n else None, saved[n]))
        for n, m in members.items()
    )


SCHEMA = "conv_id long, turn long, role string, text string, depth int, key int, part int"


def talk(n, seed):
    rows = []
    for c in range(n):
        for t in range((c * seed) % 11):
            rows.append((c, t if t else None, "user" if t % 2 else None, None if (c + t) % 17 == 0 else prose((c // 10 + t) % 6, 3), 1, 2, 3))
    return rows


@pytest.mark.parametrize("rows", [talk(60, 7), talk(23, 1) + talk(7, 3), talk(40, 3) + [(None, 1, "user", "x", 1, 1, 1), (100, None, None, None, 0, 0, 0), (103, 2, "é", "ü", 0, 0, 0)]])
def test_trie_against_plain_version_and_sql(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_rows(prefix_trie.trie(df))
    assert got == plain_trie([r[:4] for r in rows])
    assert got == by_sql(prefix_trie.OP13_SQL, conversations=df)


def test_trie_of_one_long_conversation_over_several_levels_of_bands(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BAND", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 10)
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [(c, t, "user", f"turn {t} {c if t > cut else ''}", 0, 0, 0) for c, cut in ((5, 99), (6, 40), (7, 11), (15, 99), (20, 70)) for t in range(95)]
    rows += [(c, 0, "user", "turn 0 ", 0, 0, 0) for c in range(200, 300)]
    assert as_rows(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie([r[:4] for r in rows])


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", 0, 0, 0)], SCHEMA)).count() == 0
