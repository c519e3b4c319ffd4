"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; letters stay, everything else becomes one kind of gap. Every three characters in a row that
hold a letter are hashed to one of ``BUCKETS``. Learning counts buckets by language over *all* learning rows: each
task adds up its own table, the tables are summed by a group-by, and the driver gets at most
``BUCKETS x languages`` sums, whatever the corpus size. The log-probability matrix (the same bound) is shipped with the
scoring function; scoring gathers its rows for a part of a batch at once and adds them up by document.

The score is the posterior of the predicted language when the evidence of a text counts as at most ``EVIDENCE``
n-grams: n-grams overlap and repeat, and their plain product would make every score 0 or 1.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no learning rows every text is
``und``; equal posteriors go to the language that sorts first; null languages teach nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.llm.tables import bounded_batches, fold, table
from routelens.llm.words import mix

BUCKETS = 1 << 15
SMOOTHING = 0.5
EVIDENCE = 60
PART_CHARS = 1 << 19
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """Is the code point a letter? One table for each worker."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_parts(texts: pa.Array, size: int = PART_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each n-gram, its bucket, rows that have a letter) for runs of rows."""
    rows, lo, chars = [], 0, 0
    n = len(texts)
    for i in range(n):
        text = texts[i].as_py()
        rows.append(text.lower() if text else "")
        chars += len(rows[-1])
        if chars >= size or i == n - 1:
            yield lo, i + 1, *_ngrams(rows)
            rows, lo, chars = [], i + 1, 0


def _ngrams(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.frombuffer("".join(f" {r} " for r in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(r) + 2 for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    letter = _letters()[code]
    keep = letter.copy()  # of several gaps in a row the first one stays
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    code = np.where(letter, code, 0)[keep].astype(np.uint64)
    owner, letter = owner[keep], letter[keep]
    if len(code) < 3:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(rows), bool)
    one = (owner[2:] == owner[:-2]) & (letter[1:-1] | letter[:-2] | letter[2:])
    gram = (code[:-2] << np.uint64(42)) ^ (code[1:-1] << np.uint64(21)) ^ code[2:]
    bucket = (mix(gram[one]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return owner[2:][one], bucket, np.bincount(owner[letter], minlength=len(rows)) > 0


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lo, hi, row, bucket, _ in ngram_parts(batch.column("text")):
            own = langs[lo:hi]
            for lang in set(own):
                mask = own == lang
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket[mask[row]], minlength=BUCKETS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the ``BUCKETS`` x languages matrix of log probabilities, from (text, lang) rows."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("text", "lang").where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count_batches, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    sums = np.full((BUCKETS, len(langs)), SMOOTHING)
    sums[counts["bucket"].to_numpy(int), np.searchsorted(langs, counts["lang"].to_numpy(str)) if len(langs) else []] += counts["n"].to_numpy(float)
    return langs, np.log(sums / sums.sum(axis=0)) if langs else sums


def score_texts(texts: pa.Array, langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text."""
    best, score = [], np.zeros(len(texts))
    for lo, hi, row, bucket, lettered in ngram_parts(texts):
        n = np.bincount(row, minlength=hi - lo)
        if not langs:
            best += [UNDETERMINED] * (hi - lo)
            continue
        total = np.stack([np.bincount(row, weights=logp[bucket, k], minlength=hi - lo) for k in range(len(langs))], axis=1).astype(float)
        total *= np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
        total = np.exp(total - total.max(axis=1, keepdims=True))
        total /= total.sum(axis=1, keepdims=True)
        top = total.argmax(axis=1)
        score[lo:hi] = np.where(lettered, total[np.arange(hi - lo), top], 0.0)
        best += [langs[t] if ok else UNDETERMINED for t, ok in zip(top, lettered, strict=True)]
    return best, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with ``lang_pred`` and ``lang_score``."""
    bounded_batches(docs.sparkSession)
    langs, logp = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = score_texts(batch.column("_text"), langs, logp)
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "lang_score"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("lang_score", "double")
    return rows.mapInArrow(run, schema)


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a determined language and a score of at least ``least``."""
    bounded_batches(docs.sparkSession)
    langs, logp = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = score_texts(batch.column("text"), langs, logp)
            yield batch.filter(pa.array([b != UNDETERMINED and s >= least for b, s in zip(best, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(F.col(doc_id), 3) == 1


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
