"""The merging against the library that owns the vocabulary."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from routelens.llm.token_counts import PairMerger, load_vocabulary, op10_token_counts, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
MERGER = PairMerger(load_vocabulary(PATH), remembered=50)
ODD = "Σσς Áé İIı ẞﬁ Ⅷ½²١ 中文 \U0001f600 'ʼs 'S 'Re \x1c\x1d\x85\xa0 ​﻿ <|endoftext|> <|ENDOFTEXT|>"


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", " ", "a", "Hello, world's end!", "x" * 3000, ODD, "<|endoftext|><|startoftext|>a", "1234.5", "don't DON'T", "Σ" * 3 + " ΟΣ"])
def test_as_the_library(text):
    assert MERGER.count(text) == library(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aetionsh'.,!? \n19" + ODD)), st.characters(max_codepoint=0x24FF, exclude_categories=["Cs"])), max_size=60))
def test_as_the_library_for_any_text(text):
    assert MERGER.count(text) == library(text)


def test_every_code_point_as_the_library():
    """Case, class and composition of every assigned plane, beside letters and digits."""
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b 1{chr(c)}" for c in points]
    want = LIBRARY.encode_batch(texts, add_special_tokens=False)
    assert [hex(c) for c, t, w in zip(points, texts, want) if MERGER.count(t) != len(w.ids)] == []


def test_null_empty_repeated_and_extra(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the the", "x"), (3, "the the", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(df, PATH).collect()))
    assert got == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 7, 2), (3, 7, 2)]
    assert token_counts(df.limit(0), PATH).count() == 0


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op10_token_counts(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert (got[i].n_bytes, got[i].n_tokens) == (len(text.encode()), library(text))
        assert got[i].over_limit == (got[i].n_tokens > 2048)
