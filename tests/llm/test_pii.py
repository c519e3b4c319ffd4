"""Base spans against the plain patterns, decoding by cuts against decoding whole lines, and added spans."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routelens.llm import pii_crf as C

FIELD = C.train_field()
TAGGER = C.ShapeTagger(FIELD)
PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and C.luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.one_of(
    st.text(alphabet="a@.-+ 1290()é", max_size=40),
    st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "256.1.1.1", "a.b@c.d-e.f", "@", "x@y", "+1 (255) 555-8013", "+49", " ", ".", "\n", "007.08.09.1", "é"]), max_size=8).map("".join),
))
def test_base_spans(text):
    assert C.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "@" * 50_000, "+1" * 50_000, "a@" * 50_000, "1." * 100_000, "1 " * 100_000, "a." * 50_000 + "@"])
def test_long_runs_are_linear(text):
    C.base_spans(text)
    TAGGER.added(pa.array([text]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", "word,", "\n", "call", "(415)", "555-0133", "4012.8888.8888.1881", "v1.2", "10", "@", "8.8.4.4", "é!", "a@b.c", "+1", "000"]), max_size=30))
def test_cut_chains_decode_as_whole_lines(words):
    raw = " ".join(words).encode()
    _, _, _, line, shape, edges = C.token_shapes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert TAGGER.cut
    np.testing.assert_array_equal(TAGGER.tags(line, shape, edges), TAGGER.tags(line, shape, edges, cut=False))


@pytest.mark.parametrize("text, kind, value", [
    ("Please dial (415) 555-0177 soon", 3, "(415) 555-0177"), ("mail kim(at)example.org now", 0, "kim(at)example.org"),
    ("é host 10[.]0[.]0[.]9 down", 1, "10[.]0[.]0[.]9"), ("card 6011/1111/1111/1117 ok", 2, "6011/1111/1111/1117"),
])
def test_added_spans(text, kind, value):
    base, every = C.spans_of(text, TAGGER.added(pa.array([text]))[0])
    assert not base and [(k, text[a:b]) for a, k, b in every] == [(kind, value)]


@pytest.mark.parametrize("text", ["In 2024, version 2.0. of 12,500 words (page 3).", "AKIAPPKKDB7LEKU7L password=e3b3ed3c", "a | b | c", "WORD!! OTHER!!", ""])
def test_clean_texts_stay_clean(text):
    assert C.spans_of(text, TAGGER.added(pa.array([text]))[0]) == ([], [])


@pytest.mark.parametrize("kind, values, between", [
    (3, ["415-555-0176", "415-555-0177"], ", "), (3, ["415-555-0176", "415-555-0177", "415-555-0178"], ", "), (3, ["(415) 555-0133", "(415) 555-0177"], " "),
    (3, ["+1 (255) 555-8013", "(415) 555-0133"], " "), (3, ["+49 30 1234567", "0171/555 0199"], ", "), (3, ["020 7946 0958", "020 7946 0959"], ", "),
    (2, ["4012.8888.8888.1881", "6011/1111/1111/1117"], " "), (2, ["4012.8888.8888.1881", "4012.8888.8888.1881", "6011/1111/1111/1117"], ", "),
    (1, ["172[.]16[.]0[.]9", "10[.]0[.]0[.]9", "10[.]0[.]0[.]7"], " "), (1, ["8.8.4.4", "172[.]16[.]0[.]9"], " "),
    (0, ["kim(at)example.org", "info(at)example.net"], ", "), (0, ["sales[at]example.co.uk", "info(at)example.net", "bo[at]example.com"], " "),
])
def test_finds_side_by_side(kind, values, between):
    text = between.join(values)
    _, every = C.spans_of(text, TAGGER.added(pa.array([text]))[0])
    assert [(k, text[a:b]) for a, k, b in every] == [(kind, v) for v in values]


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "x a@b.cd y"), (3, "x a@b.cd y"), (None, "é +1 (255) 555-8013")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted((str(r.doc_id), r.n_email, r.n_phone, r.spans, r.base_sha256) for r in C.find_personal_data(df).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [("1", 0, 0, "", sha("")), ("2", 0, 0, "", sha("")), *[("3", 1, 0, "email:2:8", sha("email:2:8"))] * 2, ("None", 0, 1, "phone:2:19", sha("phone:2:19"))]
    assert C.find_personal_data(df.limit(0)).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in C.op7_pii_crf(spark, sf).collect():
        base = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{C.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in base) for k in range(4)]


def test_very_long_numbers_beside_dots():
    for zeros in (5000, 100_000):
        text = "0" * zeros + ".1.2.3 and 0" + "0" * zeros + "1.2.3.4 and 9" + "9" * zeros + ".1.2.3"
        assert [text[a:b].strip("0") for a, k, b in C.base_spans(text) if k == 1] == [".1.2.3", "1.2.3.4"]
