"""Text expressions: tokens, sentences, numbers, entities, markers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and word lists that define the features.
TOKEN = r"[A-Za-z0-9']+"
WORD = r"[\p{L}\p{N}_]+"
NUMBER = r"(?U)(?<!\w)\d[\d,]*(?:\.\d+)?(?!\w)"
YEAR = r"(?U)\b(?:19|20)\d{2}\b"
ENTITY = r"(?U)\b[A-Z][A-Za-z0-9'-]+\b"
DISPLAY = r"[A-Za-z][A-Za-z0-9'-]*|\d[\d,]*(?:\.\d+)?"
VALUE = (r"(?i)(?U)(?<!\w)(?:[$£€]\s*)?\d[\d,]*(?:\.\d+)?(?:\s*(?:%|percent|million|billion|thousand|km|kg|miles?|"
         r"years?|months?|days?|hours?|minutes?))?(?!\w)")
DATE = (r"(?i)(?U)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|"
        r"sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2}(?:,\s*\d{4})?\b")
NAME_RUN = r"(?U)\b(?:[A-Z][A-Za-z0-9'-]+)(?:\s+(?:of|the|and|&)?\s*[A-Z][A-Za-z0-9'-]+)+\b"
ACRONYM = r"(?U)\b[A-Z][A-Z0-9-]{1,}\b"
STRUCTURED_LINE = r"^\s*(?:[-*•]|\d+[.)]|[A-Za-z][.)])\s+|\t|\|.*\||^\s*[^:]{1,40}:\s*\S"
NEGATIONS = ("no", "not", "never", "none", "neither", "nor", "without")
STOPWORDS = tuple(
    "a an and are as at be been being by for from had has have he her hers him his i in into is it its me my of on "
    "or our ours she that the their theirs them they this those to was we were what when where which who will with "
    "you your".split()
)
LOGIC_WORDS = tuple(
    "no not never none neither nor without less least more most than every all any some only if unless because "
    "therefore thus hence so although though however but yet whereas while despite unlike before after may might "
    "could would should must cannot can't won't isn't wasn't aren't weren't".split()
)
LOGIC_PHRASES = ("even though", "rather than", "as a result", "due to", "in contrast", "on the other hand")
ATTRIBUTION_WORDS = tuple(
    "said says say reported reports report claimed claims claim stated states state told tells according announced "
    "announces wrote writes noted notes alleged alleges".split()
)
ATTRIBUTION_PHRASES = ("according to", "was quoted", "were quoted")
PRONOUNS = tuple(
    "he she it they him her them his hers its their theirs this that these those himself herself itself themselves "
    "such former latter".split()
)
ENTITY_EXCLUSIONS = tuple(
    "a an and as at but by for from he her his i in it its no not of on or she that the their they this those to we "
    "what when where which who you".split()
)
BLANKS = " \t\n\r\f\u000b"


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def found(x: Column, pattern: str) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def tokens(x: Column) -> Column:
    """ASCII word tokens, matched first and lower-cased then: letters that fold into ASCII do not become tokens."""
    return F.transform(found(x, TOKEN), F.lower)


def unicode_words(x: Column) -> Column:
    return found(F.lower(x), WORD)


def sentences(x: Column) -> Column:
    """Split after . ! ? plus blanks and at line breaks; a blank text gives one empty sentence."""
    parts = F.filter(F.transform(F.split(strip(x), r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(F.coalesce(x, F.lit("")))))


def bigrams(t: Column, sep: str = "\u001f") -> Column:
    """Adjacent token pairs."""
    n = F.size(t)
    return F.when(n > 1, F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1), lambda a, b: F.concat(a, F.lit(sep), b))) \
        .otherwise(F.array().cast("array<string>"))


def numbers(x: Column) -> Column:
    return F.transform(found(x, NUMBER), lambda v: F.replace(v, F.lit(","), F.lit("")))


def years(x: Column) -> Column:
    return found(x, YEAR)


def entities(x: Column) -> Column:
    return F.transform(found(x, ENTITY), F.lower)


def coverage(items: Column, source: Column) -> Column:
    """Share of the items that occur in the source set; 1 when there are none."""
    hit = F.size(F.filter(items, lambda v: F.array_contains(source, v)))
    return F.when(F.size(items) > 0, hit.cast("double") / F.size(items)).otherwise(F.lit(1.0))


def value_spans(x: Column) -> Column:
    """Distinct amounts and month-day dates, lower-cased, without commas (amounts) and blanks."""
    plain = F.transform(found(x, VALUE), lambda v: F.regexp_replace(F.replace(F.lower(v), F.lit(","), F.lit("")), r"\s+", ""))
    dates = F.transform(found(x, DATE), lambda v: F.regexp_replace(F.lower(v), r"\s+", ""))
    return F.array_union(plain, dates)


def _proper(t: Column) -> Column:
    """Capital first letter, the rest cased letters in lower case, and not a function word."""
    rest = F.substr(t, F.lit(2))
    lower_rest = (rest == F.lower(rest)) & rest.rlike("[a-z]")
    return F.substr(t, F.lit(1), F.lit(1)).rlike("[A-Z]") & lower_rest & ~F.lower(t).isin(*ENTITY_EXCLUSIONS)


def entity_spans(x: Column) -> Column:
    """Names of several tokens, acronyms, and capitalised tokens that do not open the sentence."""
    runs = F.transform(found(x, NAME_RUN), lambda v: F.lower(F.regexp_replace(v, r"\s+", " ")))
    acronyms = F.transform(found(x, ACRONYM), F.lower)
    inner = F.transform(F.filter(found(x, DISPLAY), lambda t, i: (i > 0) & _proper(t)), F.lower)
    return F.array_union(F.array_union(runs, acronyms), inner)


def summary_entity_spans(x: Column, source_tokens: Column) -> Column:
    """Also the opening token when it occurs in the source."""
    opener = F.filter(found(x, DISPLAY), lambda t, i: (i == 0) & _proper(t) & F.array_contains(source_tokens, F.lower(t)))
    return F.array_union(entity_spans(x), F.transform(opener, F.lower))


def openers(s: Column, source_tokens: Column) -> Column:
    """For each sentence the one source token that its opening name can be, or none: all of the source that ``summary_entity_spans`` asks for.

    The names found are bound by an outer one-element transform, so that they are looked up once a text and not once a sentence.
    """
    opening = F.transform(s, lambda x: F.regexp_extract(x, DISPLAY, 0))
    first = F.transform(opening, lambda t: F.when(_proper(t), F.lower(t)))
    hits = lambda known: F.transform(first, lambda t: F.filter(known, lambda k: k == t))
    return F.get(F.transform(F.array(F.array_intersect(first, source_tokens)), hits), F.lit(0))


def phrase_count(x: Column, phrase: str) -> Column:
    """Non-overlapping occurrences in the lower-cased text."""
    low = F.lower(x)
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def word_count(t: Column, vocabulary) -> Column:
    return F.size(F.filter(t, lambda w: w.isin(*vocabulary)))


def structured_line_ratio(x: Column) -> Column:
    """Share of non-blank lines that are list items, table rows, key-value lines or short headers."""
    lines = F.filter(F.split(x, r"\R"), lambda l: strip(l) != "")

    def marked(l: Column) -> Column:
        s = strip(l)
        short = F.size(tokens(s)) <= 8
        header = short & (s.endswith(":") | (s.rlike(r"\p{L}") & (F.upper(s) == s)))
        return l.rlike(STRUCTURED_LINE) | header

    return F.when(F.size(lines) > 0, F.size(F.filter(lines, marked)).cast("double") / F.size(lines)).otherwise(F.lit(0.0))


@F.pandas_udf(T.StringType())
def normalized_text(values: pd.Series) -> pd.Series:
    """NFKC, case folding, blank collapsing: no SQL function does the first two."""
    return values.map(lambda v: " ".join(unicodedata.normalize("NFKC", v).casefold().split()) if v is not None else None)


def normalized_key(x: Column) -> Column:
    return F.sha2(normalized_text(x), 256)


def numbered(s: Column) -> Column:
    """Sentences as numbered lines."""
    return F.array_join(F.transform(s, lambda v, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), v)), "\n")
