"""Quality rules whose cutoffs are certified on labelled holdouts, in DataFrame operations only.

Every rule of ``RULES`` compares one statistic of a text with a cutoff from a fixed grid that runs from lenient to strict.
Labelled documents that pass the base rules are halved by a hash of their id. One half proposes, for each stratum (lang)
and rule, the cutoff that best separates bad from good documents, if any does. The other half certifies it: walking from
the most lenient cutoff to the proposed one, a cutoff holds while the exact binomial chance of seeing so few good
documents rejected, were the true share ``RISK`` / number of rules, is at most ``ERROR`` / number of proposals. The walk
is a fixed sequence, so it costs no further correction; the proposals of all strata and rules are corrected together.
With a chance of at least ``1 - ERROR``, no stratum loses more than ``RISK`` of its good documents to the rules. Too few
labels certify nothing, and then nothing is rejected.

Scale. Texts are read once: the statistics are written, a few numbers a document, and read for the labelled counts and
again for the verdict. Counts combine map-side; a stratum is left with one number a rule, cutoff, half and label.

Defined cases: a null text has no words; a null lang is the stratum ``''``; a document without an id is never labelled;
several label rows of an id are good if one of them is; rows that repeat count each; an empty table gives no rows; extra
columns are ignored. Words are compared by 64-bit hashes of three in a row within one text, so its count of repeated words is
off with a chance of about n^2 / 2^65 for n words.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelens.llm.tables import sized_broadcast, table, written
from routelens.llm.winnow import _combined, let

RISK = 0.05
ERROR = 0.05
LIFT = 5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# fixed values of the contract
SPACES = r"[\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
IN_WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


class Rule(NamedTuple):
    """Rejects where ``top`` times ``scale`` is above ``cutoff`` times ``bottom`` (below it, if ``below``); lenient cutoffs first."""

    name: str
    top: str
    scale: int
    bottom: str | None
    below: bool
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", 100, "n_words", False, (50, 40, 30, 25, 20, 15, 10, 8, 6, 4, 2, 1)),
    Rule("dup_lines", "n_dup_lines", 100, "n_lines", False, (80, 60, 50, 40, 30, 25, 20, 15, 10, 5)),
    Rule("repeat_words", "n_repeat_words", 100, "n_words", False, (45, 40, 35, 30, 25, 20, 15, 10, 5)),
    Rule("long_words", "word_chars", 10, "n_words", False, (200, 150, 120, 110, 100, 95, 90, 85, 80, 75, 70)),
    Rule("short_words", "word_chars", 10, "n_words", True, (15, 20, 25, 30, 33, 36, 40)),
    Rule("few_words", "n_words", 1, None, True, (55, 60, 75, 100, 125, 150, 200)),
)


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the text."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    two = let(hashed, lambda h: F.struct(h.alias("h"), _combined(h, 1, h, lambda a, b: F.xxhash64(a, b)).alias("two")))
    three = let(two, lambda t: F.slice(_combined(t["two"], 2, t["h"], lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(t["h"]) - 2, F.lit(0))))
    placed = F.sort_array(F.transform(three, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    again = let(placed, lambda s: F.filter(s, lambda x, i: F.get(s, i - 1)["g"].eqNullSafe(x["g"]) | F.get(s, i + 1)["g"].eqNullSafe(x["g"])))
    return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed) of every row."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("stratum"),
        text.alias("text"),
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(IN_WORD)).alias("lines"),
    )
    n = F.size("words").cast("long")
    counted = cut.select(
        "doc_id",
        "stratum",
        n.alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def strictness(rule: Rule) -> Column:
    """Place (from 1) of the first cutoff that rejects a row; one beyond the last if none does."""
    left = F.col(rule.top) * rule.scale
    right = (lambda c: F.lit(c).cast("long")) if rule.bottom is None else (lambda c: F.col(rule.bottom) * c)
    passed = [(left >= right(c) if rule.below else left <= right(c)).cast("int") for c in rule.cutoffs]
    return reduce(lambda a, b: a + b, passed) + 1


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, and by a table below 16."""
    x = F.greatest(n.cast("double"), F.lit(16.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 16, F.get(F.lit([math.lgamma(i + 1) for i in range(16)]), n.cast("int"))).otherwise(series)


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(X <= k) for X binomial of ``n`` draws: the term of k times the sum of the falling ratios below it; 1 from the mean on."""
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(share) + (n - k) * math.log1p(-share)
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * j / (n - j + 1) * ((1 - share) / share)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    down = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * share, F.lit(1.0)).otherwise(F.exp(top) * F.aggregate(down, state, add, lambda s: s["sum"]))


def half(doc_id: Column) -> Column:
    """0: certifies, 1: proposes."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 8), 16, 10).cast("long") % 2


def cutoffs(stats: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, place, certified, n, k, p) for every proposal: ``place`` is the proposed, ``certified`` the granted
    place in the rule's grid (0: none); n good documents certify it, of which the granted cutoff rejects k, with the chance p."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality in (0, 1)")
    rated = stats.where("not base_failed").join(good, "doc_id").select("stratum", "quality", half(F.col("doc_id")).alias("half"), *[strictness(r).alias(r.name) for r in rules])
    flat = rated.select("stratum", "quality", "half", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(len(r.cutoffs)).alias("last"), F.col(r.name).alias("place")) for r in rules])).alias("r"))
    flat = flat.select("stratum", "quality", "half", "r.rule", "r.last", "r.place")
    tally = flat.groupBy("stratum", "rule", "last", "place").agg(
        *[F.sum(F.when((F.col("quality") == q) & (F.col("half") == h), 1).otherwise(0)).alias(name) for name, q, h in (("good", 1, 1), ("bad", 0, 1), ("held", 1, 0))]
    )
    # from here on a stratum has one row a rule and cutoff
    every = tally.groupBy("stratum", "rule", "last").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.sum("held").alias("n"))
    grid = every.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("last"))))
    upto = Window.partitionBy("stratum", "rule").orderBy("place")
    ran = grid.join(tally, ["stratum", "rule", "last", "place"], "left").select(
        "stratum", "rule", "place", "all_good", "all_bad", "n", *[F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(a) for c, a in (("good", "g"), ("bad", "b"), ("held", "k"))]
    )
    gain = F.col("b") * F.col("all_good") - LIFT * F.col("g") * F.col("all_bad")
    best = ran.withColumn("gain", gain).where("gain > 0").groupBy("stratum", "rule").agg(F.max_by("place", F.struct("gain", -F.col("place"))).alias("proposed"))
    best = written(best, "proposals")
    tests = max(best.count(), 1)
    tried = ran.join(best, ["stratum", "rule"]).where("place <= proposed").withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk / len(rules)))
    held = F.col("p") <= error / tests
    return tried.groupBy("stratum", "rule").agg(
        F.first("proposed").alias("proposed"), F.coalesce(F.max(F.when(held, F.col("place"))), F.lit(0)).alias("certified"), F.first("n").alias("n"),
        F.max(F.when(held, F.col("k"))).alias("k"), F.max(F.when(held, F.col("p"))).alias("p"),
    )


def judged(stats: DataFrame, granted: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``stats`` with ``kept``: not failed by the base rules nor by a certified cutoff of the stratum."""
    by = written(granted.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("certified"))).alias(f"at_{r.name}") for r in rules]), "cutoffs")
    rejected = reduce(lambda a, b: a | b, [strictness(r) <= F.coalesce(f"at_{r.name}", F.lit(0)) for r in rules])
    return stats.join(sized_broadcast(by), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)


def op12_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of every document and whether the certified rules keep it."""
    stats = written(statistics(table(spark, sf_dir, "documents")), "statistics")
    found = judged(stats, cutoffs(stats, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rules() -> str:
    """The rules as SQL: one column of strictness each."""
    columns = []
    for r in RULES:
        right = (lambda c: str(c)) if r.bottom is None else (lambda c, b=r.bottom: f"{c} * {b}")
        sign = ">=" if r.below else "<="
        columns.append(f"1 + {' + '.join(f'({r.scale} * {r.top} {sign} {right(c)})::INT' for c in r.cutoffs)} AS {r.name}")
    return ",\n    ".join(columns)


OP12_SQL = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS row, doc_id, COALESCE(lang, '') AS stratum, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT row, unnest(range(1, len(words) - 1)) AS i, words FROM cut WHERE len(words) >= 3
), repeated AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS times FROM windows) WHERE times > 1
), covered AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY row
), counted AS (
  SELECT doc_id, stratum, len(words) AS n_words, list_sum([0] || list_transform(words, lambda w: length(w))) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, COALESCE(n, 0) AS n_repeat_words
  FROM cut LEFT JOIN covered ON cut.row = covered.row
), stats AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    {_sql_rules()}
  FROM counted
), good AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) IN (0, 1)
), rated AS (
  UNPIVOT (SELECT stratum, quality, ('0x' || substr(md5(s.doc_id::VARCHAR), 1, 8))::BIGINT % 2 AS half, {', '.join(r.name for r in RULES)}
    FROM stats s JOIN good g ON s.doc_id = g.doc_id WHERE NOT base_failed) ON {', '.join(r.name for r in RULES)} INTO NAME rule VALUE place
), places AS (
  SELECT rule, unnest(range(1, last + 1)) AS place FROM (VALUES {', '.join(f"('{r.name}', {len(r.cutoffs)})" for r in RULES)}) t(rule, last)
), ran AS (
  SELECT r.stratum, p.rule, p.place, count(*) FILTER (WHERE quality = 1 AND half = 1) AS all_good, count(*) FILTER (WHERE quality = 0 AND half = 1) AS all_bad,
    count(*) FILTER (WHERE quality = 1 AND half = 0) AS n, count(*) FILTER (WHERE quality = 1 AND half = 1 AND r.place <= p.place) AS g,
    count(*) FILTER (WHERE quality = 0 AND half = 1 AND r.place <= p.place) AS b, count(*) FILTER (WHERE quality = 1 AND half = 0 AND r.place <= p.place) AS k
  FROM places p JOIN rated r ON p.rule = r.rule GROUP BY ALL
), proposed AS (
  SELECT stratum, rule, place AS proposed FROM ran WHERE b * all_good > {LIFT} * g * all_bad
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY b * all_good - {LIFT} * g * all_bad DESC, place) = 1
), tried AS (
  SELECT r.stratum, r.rule, r.place, CASE WHEN k >= n * ({RISK} / {len(RULES)}) THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK} / {len(RULES)}) + (n - j) * ln(1 - {RISK} / {len(RULES)})))) END AS p
  FROM ran r JOIN proposed q ON r.stratum = q.stratum AND r.rule = q.rule WHERE r.place <= q.proposed
), granted AS (
  SELECT stratum, {', '.join(f"max(place) FILTER (WHERE rule = '{r.name}') AS at_{r.name}" for r in RULES)}
  FROM tried WHERE p <= {ERROR} / (SELECT greatest(count(*), 1) FROM proposed) GROUP BY stratum
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(f'{r.name} <= COALESCE(at_{r.name}, 0)' for r in RULES)}) AS kept
FROM stats s LEFT JOIN granted g ON s.stratum = g.stratum
"""
