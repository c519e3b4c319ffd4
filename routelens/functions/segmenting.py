"""A rule-based sentence segmenter with character offsets: one pass over the marks that may end a sentence.

A mark ends a sentence unless a rule keeps it: a known abbreviation, an initial, a decimal or a dotted name, a list number at the
start of a line, or a small letter after it. Closing quotes and brackets stay with the sentence they close. Line breaks always end
one. Sentences are spans of the text as it is, without the blanks around them, so ``text[start:end]`` is the sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# common abbreviations that are followed by a name or a number, and such that may also end a sentence
BEFORE_NAME = frozenset("mr mrs ms dr prof rev hon st gen col capt lt sgt maj sen rep gov pres supt mt no nos vs fig figs eq sec ch vol pp art al approx dept est ed eds".split())
MAY_END = frozenset("inc ltd co corp jr sr etc bros a.m p.m e.g i.e u.s u.k u.n d.c ph.d b.a m.a jan feb mar apr jun jul aug sep sept oct nov dec".split())
NEVER_END = frozenset(["e.g", "i.e"])

_MARK = re.compile("[.!?…]+|\n+")
_CLOSING = "\"'”’)]}»"
_WORD_BEFORE = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]+$")
_LIST_NUMBER = re.compile(r"(?:^|\n)[ \t]*(?:[0-9]{1,3}|[A-Za-z])$")
_OPENING = "\"'“‘([{«"
LOOK_BACK = 40


def _ends(text: str, mark: re.Match, after: int) -> bool:
    """Does this mark, with its closing signs up to ``after``, end a sentence?"""
    if after < len(text) and not text[after].isspace():
        return False  # a decimal, a dotted name, a mark inside a word
    rest = after
    while rest < len(text) and text[rest].isspace():
        if text[rest] == "\n":
            return True
        rest += 1
    if rest == len(text):
        return True
    first = text[rest + 1] if text[rest] in _OPENING and rest + 1 < len(text) else text[rest]
    sign = mark[0]
    if "!" in sign or "?" in sign:
        return not first.islower()
    if first.islower():
        return False
    if len(sign) > 1 or sign == "…":
        return True  # an ellipsis before a capital
    back = text[max(0, mark.start() - LOOK_BACK) : mark.start()]
    if _LIST_NUMBER.search(back) and (len(back) < LOOK_BACK or "\n" in back):
        return False
    word = _WORD_BEFORE.search(back)
    if not word:
        return True
    name = word[0].lower()
    if name in NEVER_END or name in BEFORE_NAME:
        return name == "no" and not first.isdigit()
    if len(name) == 1 and word[0].isupper() and name != "i":
        return False  # an initial
    return name not in MAY_END or first.isupper() and name not in ("u.s", "u.k", "u.n", "ph.d") or not first.isalnum()


def segments(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence; none for a blank text."""
    if not text:
        return []
    cuts, at = [], 0
    for mark in _MARK.finditer(text):
        if mark.start() < at:
            continue
        end = mark.end()
        if mark[0][0] != "\n":
            while end < len(text) and text[end] in _CLOSING:
                end += 1
            if not _ends(text, mark, end):
                continue
        cuts.append((at, end))
        at = end
    cuts.append((at, len(text)))
    out = []
    for a, b in cuts:
        inside = text[a:b]
        lead = len(inside) - len(inside.lstrip())
        trimmed = inside.strip()
        if trimmed:
            out.append((a + lead, a + lead + len(trimmed)))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def rule_segments(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sentence spans in code points; an empty array for null and blank texts."""
    for batch in texts:
        yield batch.map(lambda t: [{"start": a, "end": b} for a, b in segments(t)])
