"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, the field needs labelled tokens. So first, on at most ``FIT_ROWS`` labelled documents of each
label (chosen by a hash of doc_id), words and word beginnings far likelier in toxic than in clean documents become candidates,
and expectation-maximisation shares every toxic document out among its candidates: words that merely travel along with
a family of copies lose their share to words that explain many different documents, and are not picked. A word is picked
when its share (a word and its beginnings divide theirs) is at least ``MIN_EXPLAINED`` documents, copies counted once, and when its counts in toxic and clean
documents would differ so by chance in 1 % of words (``MIN_G``, a likelihood-ratio test); neither bound grows with the
sample, so hundreds of rare toxic words are picked side by side. Occurrences of picked
words in toxic documents are the toxic tokens of the training sentences (at most ``FIT_SENTENCES`` of each kind). The
field has hashed word, word-beginning and neighbour-word features and two tags; forward-backward marginals of every token of
every whole text give a document's expected number of toxic tokens (from marginals of at least ``FLOOR``, so that
long texts do not add up traces) and its largest marginal, and a logistic curve over
these two, fitted on the same bounded sample, is the score. Tokens with a marginal of at least one half are reported as
spans of code points.

Only bounded tables reach the driver (sample rows, candidates, sentences); scoring needs no shuffle. A sentence ends
at ``.``, ``!``, ``?``, a line break or ``SENTENCE`` words, so memory and steps stay bounded for texts without stops.

Defined cases: null and empty texts have no tokens and get the score of no evidence; without toxic or without clean
labels, or when no word sets them apart, every score is the share of toxic labels (0 if there are none); rows that repeat count
once for the words; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.llm.crf import Chains, LinearChain
from routelens.llm.tables import bounded_batches, fold, table
from routelens.llm.words import mix, parts, word_spans

FIT_ROWS = 4_000
FIT_SENTENCES = 6_000
CANDIDATES = 2_000
MIN_DOCS = 3
MIN_EXPLAINED = 1.0
MIN_RATIO = 12.0
MIN_G = 6.63  # the 1 % point of chi-squared with one degree of freedom
SENTENCE = 256
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
ACCEPT = 0.5
FLOOR = 0.2

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


def sentences(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of words of each sentence, in order; every word belongs to one."""
    if not len(start):
        return np.zeros(0, np.int64)
    stops = np.cumsum(_ENDS[data])[start]
    new = np.append(True, (stops[1:] != stops[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    first = np.flatnonzero(new | (place % SENTENCE == 0))
    return np.diff(np.append(first, len(start)))


def word_features(units: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Feature ids of each word: two hashes of it and one of each prefix, of its neighbours in the sentence, a constant.

    A chance collision hits one of these slots and is outvoted by the others. Nothing here tells an unseen word from another one.
    """
    n = len(units)
    follows = np.ones(n, bool)
    if n:
        follows[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = False
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:] = np.where(follows[1:], units[:-1, 0], np.uint64(0))
    after[:-1] = np.where(follows[1:], units[1:, 0], np.uint64(0))
    slots = [units[:, 0], *units.T, before, after]
    ids = np.empty((n, len(slots) + 1), np.int32)
    for slot, x in enumerate(slots):
        ids[:, slot] = (mix(x + np.uint64(slot)) & np.uint64(BUCKETS - 1)).astype(np.int32)
    ids[:, -1] = BUCKETS
    return ids


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, and the hashes of the word and its prefixes (words x units)."""
    start, end, row, *hashes = word_spans(data, offsets, PREFIXES)
    return start, end, row, np.stack(hashes, axis=1)


def _distinct_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each text as an array."""
    for batch in batches:
        found = []
        for lo, hi, data, offsets in parts(batch.column("text")):
            _, _, row, units = word_units(data, offsets)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            found += [np.unique(units[a:b]).view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "y", "words"])


def pick_units(rows: pd.DataFrame, rounds: int = 60) -> set[int]:
    """Words and beginnings that explain toxic documents. Expectation-maximisation shares each document out among its candidates by how
    much each explains elsewhere, so words that only travel along with copies of a text lose their share."""
    first = rows[rows["y"] == 1].drop_duplicates("text")
    docs = [list(w) for w in first["words"] if len(w)]
    if not docs:
        return set()
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    names, word = np.unique(np.concatenate([np.asarray(d, np.int64) for d in docs]), return_inverse=True)
    share = np.bincount(word).astype(float)
    for _ in range(rounds):
        part = share[word]
        part /= np.bincount(doc, part)[doc]
        share = np.bincount(word, part, len(names))
    return set(names[share >= MIN_EXPLAINED].tolist())


def likelihood_ratio(toxic: int, clean: int) -> Column:
    """Twice the gain in log-likelihood from letting a word's rate differ between ``toxic`` and ``clean`` documents (columns n1, n0)."""

    def part(seen: Column, size: int) -> Column:
        rate = (F.col("n1") + F.col("n0")) / F.lit(float(toxic + clean))
        return F.when(seen > 0, seen * F.log(seen / (size * rate))).otherwise(0.0)

    n1, n0 = F.col("n1"), F.col("n0")
    return 2 * (part(n1, toxic) + part(n0, clean))  # for rare words; absences add next to nothing


def _sentence_batches(picked: set[int]):
    known = np.array(sorted(picked), np.int64).view(np.uint64) if picked else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column("y"))
            ids = np.asarray(batch.column("doc_id"))
            for lo, _, data, offsets in parts(batch.column("text")):
                start, end, row, units = word_units(data, offsets)
                size = sentences(data, offsets, start, row)
                if not len(size):
                    continue
                first = np.concatenate(([0], np.cumsum(size)[:-1]))
                tag = np.isin(units, known).any(axis=1) & (y[lo + row] == 1)
                kind = np.maximum.reduceat(tag, first).astype(np.int32)
                cuts = pa.array(np.append(first, len(tag)).astype(np.int32))
                wide = pa.array(np.append(first, len(tag)).astype(np.int32) * units.shape[1])
                columns = {"doc_id": pa.array(ids[lo + row[first]]), "place": pa.array(first), "kind": pa.array(kind)}
                for name, x, at in (("words", units.ravel().view(np.int64), wide), ("tags", tag.astype(np.int64), cuts)):
                    columns[name] = pa.ListArray.from_arrays(at, pa.array(x))
                yield pa.RecordBatch.from_pydict(columns)

    return run


class ToxicityModel:
    """The field and the logistic curve from a document's marginals to its score."""

    def __init__(self, field: LinearChain | None, curve: np.ndarray):
        self.field, self.curve = field, curve

    def document_evidence(self, texts: pa.Array, spans: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """(expected toxic tokens, largest marginal) of each text and, on demand, its spans of code points."""
        out, found = np.zeros((len(texts), 2)), [[] for _ in range(len(texts))] if spans else []
        for lo, hi, data, offsets in parts(texts):
            start, end, row, units = word_units(data, offsets)
            if not len(start) or self.field is None:
                continue
            size = sentences(data, offsets, start, row)
            p = self.field.marginals(self.field.emissions(word_features(units, size)), Chains(size))[0][:, 1]
            out[lo:hi, 0] = np.bincount(row, np.where(p >= FLOOR, p, 0.0), hi - lo)
            np.maximum.at(out[lo:hi, 1], row, p)
            if spans and (p >= 0.5).any():
                point = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
                base = np.concatenate(([0], point))[offsets[:-1]]
                for i in np.flatnonzero(p >= 0.5):
                    r = row[i]
                    found[lo + r].append((int(point[start[i]] - 1 - base[r]), int(point[end[i] - 1] - base[r])))
        return out, found

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * np.log1p(evidence[:, 0]) + self.curve[2] * evidence[:, 1]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _curve(evidence: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(y)), np.log1p(evidence[:, 0]), evidence[:, 1]])
    w = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-6, 1e-2, 1e-2])
        w += np.linalg.solve(hess, x.T @ (y - q) - np.array([0, 1e-2, 1e-2]) * w)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, fit_sentences: int = FIT_SENTENCES) -> ToxicityModel:
    """A model of ``labels.toxic`` from the texts of ``docs``; both without held-out rows."""
    bounded_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    by_kind = [known.where(F.col("y") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for kind in (0, 1)]
    chosen = by_kind[0].unionByName(by_kind[1])
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").cache()
    counts = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != {0, 1}:
        sample.unpersist()
        sure = 40.0 if counts.get(1) else -40.0
        return ToxicityModel(None, np.array([sure, 0.0, 0.0]))
    words = sample.mapInArrow(_distinct_batches, "doc_id long, y int, words array<long>")
    each = words.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    ratio = F.log(((F.col("n1") + 0.1) / (counts[1] + 1)) / ((F.col("n0") + 0.1) / (counts[0] + 1)))
    best = each.where(F.col("n1") >= MIN_DOCS).withColumn("score", ratio).where((F.col("score") >= float(np.log(MIN_RATIO))) & (likelihood_ratio(counts[1], counts[0]) >= MIN_G))
    scores = {r.w: r.score for r in best.orderBy(F.desc(F.col("score") * F.col("n1")), "w").limit(CANDIDATES).collect()}
    listed = F.array(*[F.lit(w).cast("long") for w in sorted(scores)]) if scores else F.array().cast("array<long>")
    rows_with = words.where("y = 1").select("doc_id", "y", F.xxhash64("words").alias("text"), F.array_intersect("words", listed).alias("words")).toPandas()
    picked = pick_units(rows_with.sort_values("doc_id"))
    if not picked:
        sample.unpersist()
        toxic, clean = known.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
        return ToxicityModel(None, np.array([np.log(toxic / clean), 0.0, 0.0]))
    drawn = sample.mapInArrow(_sentence_batches(picked), "doc_id long, place long, kind int, words array<long>, tags array<long>")
    train = [drawn.where(F.col("kind") == kind).orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(fit_sentences) for kind in (0, 1)]
    train = train[0].unionByName(train[1]).toPandas()
    size = train["tags"].map(len).to_numpy(int)
    joined = {c: np.concatenate([np.asarray(x, np.int64) for x in train[c]]) if len(train) else np.zeros(0, np.int64) for c in ("words", "tags")}
    field = LinearChain(BUCKETS + 1, 2).fit(word_features(joined["words"].view(np.uint64).reshape(-1, len(PREFIXES) + 1), size), joined["tags"], size)
    model = ToxicityModel(field, np.zeros(3))
    seen = _evidence(sample, model, ["doc_id", "y"]).toPandas().sort_values("doc_id")
    sample.unpersist()
    model.curve = _curve(seen[["expected", "largest"]].to_numpy(float), seen["y"].to_numpy(float))
    return model


def _evidence(rows: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence, _ = model.document_evidence(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(evidence[:, 0]), pa.array(evidence[:, 1])], names=[*keep, "expected", "largest"])

    return rows.select(*keep, "text").mapInArrow(run, rows.select(*keep).schema.add("expected", "double").add("largest", "double"))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, n_spans, spans) of every row; spans are ``start:end`` in code points, end exclusive."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence, spans = model.document_evidence(batch.column("text"), spans=True)
            text = [",".join(f"{a}:{b}" for a, b in s) for s in spans]
            columns = [batch.column("doc_id"), pa.array(model.score(evidence)), pa.array([len(s) for s in spans], pa.int64()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "n_spans", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_spans long, spans string")


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity and offending spans of every document, learned from the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit_toxicity(docs.where(~held_out), labels.where(~held_out))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"), "n_spans", "spans")
