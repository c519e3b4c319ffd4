"""Filter interaction audit by truth-table survival words.

Five filters give every document a set of failures, and the set gives a 32-bit word: bit ``s`` says whether the document
survives the subset ``s`` of filters. Words are counted by positional popcounts with carry-save adders: of three words,
one holds the bitwise sums and one the carries, so a part's words shrink to a few per power of two, whose bits are then
counted. The survivors of all 32 subsets, by part and label, answer every question about any order of the filters:
what each step keeps and removes, what it would have removed alone, what only it removes, and its Shapley value.

The filters of ``FILTERS`` (a failing document is removed): ``A`` under 200 words; ``B`` fewer than half of the words
different; ``C`` over 3 % capital letters ``A-Z``; ``D`` any of ``#$%&*|``; ``E`` the text of a smaller doc_id. A word
is a longest run of ``[^\\x20\\x09-\\x0D]``.

Scale. Texts are read once; what moves is one short row a document (id, digest, part, failures). Copies are found
without bringing them together: the smallest id of a digest comes from a combined group-by, and whether a document is
that one is a join by digest *and* id, so a text with millions of copies is spread over as many keys. Each task emits the
counts of its own documents; 32 numbers a part and label are left to add.

Defined cases: a null text is the empty text (and equal to it); a null lang is the part ``''``; a document without an id
is no copy of anything, and nothing is a copy of it; rows that share an id and a text are both its first; several label
rows of an id count as 1 if any of them does; an empty table gives no rows; extra columns are ignored; words and their
set are taken piece by piece from very long texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelens.llm.tables import bounded_batches, table, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3

# fixed values of the contract: what separates words (the same as bytes.split), and the symbols of filter D
SPACE = re.compile(rb"[\x20\x09-\x0D]")
SYMBOLS = re.compile(rb"[#$%&*|]")

_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_FOLLOWING = bytes(range(0x80, 0xC0))
_PIECE = 1 << 20
_HELD = 4096

#: the survival word of every set of failures
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not f & s) for f in range(SUBSETS)], np.uint32)


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about ``_PIECE`` bytes that end between words."""
    lo = 0
    while len(data) - lo > _PIECE:
        cut = SPACE.search(data, lo + _PIECE)
        if not cut:
            break
        yield data[lo : cut.start()]
        lo = cut.end()
    yield data[lo:] if lo else data


def failures(data: bytes) -> int:
    """The failed ones of filters A to D of a text in UTF-8, as bits."""
    n, different = 0, set()
    for piece in _pieces(data):
        words = piece.split()
        n += len(words)
        different.update(words)
    points = len(data.translate(None, _FOLLOWING))
    capitals = len(data.translate(None, _NOT_CAPITAL))
    return (
        (n < MIN_WORDS)
        | (100 * len(different) < MIN_DISTINCT_PERCENT * n) << 1
        | (100 * capitals > MAX_CAPITAL_PERCENT * points) << 2
        | (SYMBOLS.search(data) is not None) << 3
    )


def _audit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        digests, masks = [], []
        for text in texts:
            data = text.as_py() or b""
            digests.append(hashlib.md5(data, usedforsecurity=False).digest())
            masks.append(int(failures(data)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.binary()), batch.column("part"), pa.array(masks, pa.int32())], names=["doc_id", "digest", "part", "failed"]
        )


def _bits(words: np.ndarray) -> np.ndarray:
    return (words[:, None] >> np.arange(SUBSETS, dtype=np.uint32) & np.uint32(1)).sum(axis=0, dtype=np.int64)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set, by layers of carry-save adders."""
    counts, weight, layer = np.zeros(SUBSETS, np.int64), 1, words
    while len(layer) > 2:
        carries = []
        while len(layer) > 2:
            n = len(layer) // 3
            a, b, c = layer[:n], layer[n : 2 * n], layer[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            layer = np.concatenate((half ^ c, layer[3 * n :]))
        counts += weight * _bits(layer)
        layer, weight = np.concatenate(carries), 2 * weight
    return counts + weight * _bits(layer)


def _survivor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The survivors of a task's rows by part and label; parts are let go when ``_HELD`` of them are held."""
    held: dict = {}

    def out() -> pa.RecordBatch:
        keys = list(held)
        rows = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys for _ in range(SUBSETS)], pa.string()), pa.array([k[1] for k in keys for _ in range(SUBSETS)], pa.int32()),
             pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(keys))), pa.array(np.concatenate([held[k] for k in keys]))],
            names=["part", "label", "subset", "n"],
        )
        held.clear()
        return rows

    for batch in batches:
        part = batch.column("part").dictionary_encode()
        names = part.dictionary.to_pylist()
        label = batch.column("label").to_numpy(zero_copy_only=False)
        words = SURVIVAL[batch.column("failed").to_numpy(zero_copy_only=False)]
        key = part.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + label
        order = np.argsort(key, kind="stable")
        which, start = np.unique(key[order], return_index=True)
        for k, run in zip(which, np.split(words[order], start[1:])):
            at = (names[k // 4], int(k % 4))
            held[at] = held.get(at, 0) + positional_popcount(run)
            if len(held) >= _HELD:
                yield out()
    if held:
        yield out()


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents that fail no filter of the subset, for every part and all 32 subsets."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    rows = written(rows.mapInArrow(_audit_batches, "doc_id long, digest binary, part string, failed int"), "failures")
    named = rows.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    of = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    label = F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    named = named.join(of, "doc_id", "left").join(first, ["digest", "doc_id"], "left")
    each = named.select("part", (F.col("failed") + copy).alias("failed"), label.alias("label"))
    each = each.union(rows.where("doc_id is null").select("part", "failed", F.lit(0)))
    counted = each.mapInArrow(_survivor_batches, "part string, label int, subset int, n long")
    having = lambda bit: F.sum(F.when(F.col("label").bitwiseAND(bit) > 0, F.col("n")).otherwise(0))
    return counted.groupBy("part", "subset").agg(F.sum("n").alias("n"), having(1).alias("good"), having(2).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of every order of the filters, by part."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bits = [[1 << FILTERS.index(f) for f in order] for order in orders]
    after = F.lit([sum(row[: i + 1]) for row in bits for i in range(len(FILTERS))])
    own = F.lit([b for row in bits for b in row])
    # 32 subsets a part, whatever the input
    part = survivors(docs, labels).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("of"))
    steps = part.select("part", "of", F.explode(F.sequence(F.lit(0), F.lit(len(orders) * len(FILTERS) - 1))).alias("i"))
    steps = steps.select("part", "of", "i", F.get(after, F.col("i")).alias("to"), F.get(own, F.col("i")).alias("bit"))
    on = lambda subset: F.get("of", subset)
    was, now, none, alone = on(F.col("to") - F.col("bit")), on(F.col("to")), on(F.lit(0)), on(F.col("bit"))
    removed = was["n"] - now["n"]
    return steps.select(
        "part",
        F.get(F.lit(orders), F.floor(F.col("i") / len(FILTERS)).cast("int")).alias("filter_order"),
        (F.col("i") % len(FILTERS) + 1).cast("int").alias("step"),
        now["n"].alias("kept"),
        removed.alias("removed"),
        (none["n"] - alone["n"] - removed).alias("redundant"),
        (on(F.lit(SUBSETS - 1) - F.col("bit"))["n"] - on(F.lit(SUBSETS - 1))["n"]).alias("unique_fails"),
        (was["good"] - now["good"]).alias("good_lost"),
        (was["toxic"] - now["toxic"]).alias("toxic_lost"),
        F.sum(removed).over(Window.partitionBy("part", "bit")).alias("shapley"),  # 120 rows a part and filter
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every filter keeps, removes, repeats and costs, in all 120 orders, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS text,
    regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), labelled AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), tested AS (
  SELECT t.part, COALESCE(l.good, 0) AS good, COALESCE(l.toxic, 0) AS toxic,
    {
      'A': len(words) < 200,
      'B': 100 * len(list_distinct(words)) < 50 * len(words),
      'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'),
      'E': COALESCE(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), FALSE)
    } AS fails
  FROM texts t LEFT JOIN labelled l ON t.doc_id = l.doc_id
), grouped AS (
  SELECT part, concat(CASE WHEN fails.A THEN 'A' ELSE '' END, CASE WHEN fails.B THEN 'B' ELSE '' END, CASE WHEN fails.C THEN 'C' ELSE '' END,
    CASE WHEN fails.D THEN 'D' ELSE '' END, CASE WHEN fails.E THEN 'E' ELSE '' END) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM tested GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s
), applied AS (
  SELECT g.part, s.filter_order, s.step, s.f, g.n, g.good, g.toxic, g.failed, contains(g.failed, s.f) AS here,
    len(translate(g.failed, s.before, '')) < len(g.failed) AS earlier
  FROM grouped g, steps s
), counted AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN here OR earlier THEN 0 ELSE n END) AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM applied GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
