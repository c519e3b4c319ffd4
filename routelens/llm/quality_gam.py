"""Quality scores by a generalised additive model with pairwise interactions.

Each text becomes ``FEATURES`` numbers (lengths, character classes, repetition). Every feature has a lookup table over
quantile bins, learned by cyclic boosting: in turn for each feature a shallow tree is fitted to the log-loss gradient
of all others and added, at a small rate, to that feature's table. The strongest pairs of features, by the gain of a
two-cut tree on the residual, then get two-dimensional tables in the same way. A score is the logistic of an intercept
plus one table entry for each feature and pair, looked up for whole batches.

Learning uses at most ``FIT_ROWS`` labelled rows, chosen by a hash of doc_id; this bound is a parameter, and it also
bounds the broadcast of their ids and what reaches the driver. Features and scores cover every row and whole text and
need no shuffle.

Defined cases: null and empty texts have all features 0 and are scored as such; several labels of one doc_id count as
the largest; without labelled rows every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from routelens.llm.tables import bounded_batches, fold, table
from routelens.llm.words import mix, parts, word_spans

FIT_ROWS = 20_000
BINS = 48
PAIR_BINS = 12
PAIRS = 6
ROUNDS = 120
RATE = 0.12
LEAVES = 4
PENALTY = 2.0
ACCEPT = 0.7

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "space", "comma_stop", "other_symbol", "bang", "non_ascii",
    "symbol_run", "distinct_words", "top_word", "next_same", "distinct_pairs", "line_words", "repeated_lines", "short_words",
)


def _byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_UPPER = _byte_class(bytes(range(65, 91)))
_DIGIT = _byte_class(bytes(range(48, 58)))
_SPACE = _byte_class(b" \t\n\r\x0b\x0c")
_STOP = _byte_class(b".,;:?'\"-")
_BANG = _byte_class(b"!")
_WIDE = _byte_class(bytes(range(128, 256)))
_SYMBOL = ~(_byte_class(bytes(range(97, 123))) | _UPPER | _DIGIT | _SPACE | _STOP | _BANG | _WIDE)


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often its commonest one occurs."""
    order = np.argsort(value + mix(row.astype(np.uint64)), kind="stable")
    a, r = value[order], row[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(fresh)
    times = np.diff(np.append(start, len(a)))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, r[start], times)
    return np.bincount(r[start], minlength=rows), most


def features_of(texts: pa.Array) -> np.ndarray:
    """rows x features."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi, data, offsets in parts(texts):
        n = hi - lo
        size = np.diff(offsets)
        if not len(data):
            continue
        owner = np.repeat(np.arange(n), size)
        start, end, row, hashed = word_spans(data, offsets)
        count = np.bincount(row, minlength=n)
        length = end - start
        per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)

        def share(member: np.ndarray, owner=owner, data=data, n=n, per_byte=per_byte) -> np.ndarray:
            return np.bincount(owner[member[data]], minlength=n) * per_byte

        f = {name: np.zeros(n) for name in FEATURES}
        f["log_bytes"], f["log_words"] = np.log1p(size), np.log1p(count)
        f["word_length"] = np.bincount(row, weights=length, minlength=n) * per_word
        longest = np.zeros(n)
        np.maximum.at(longest, row, length)
        f["longest_word"] = np.log1p(longest)
        for name, member in (("upper", _UPPER), ("digit", _DIGIT), ("space", _SPACE), ("comma_stop", _STOP), ("other_symbol", _SYMBOL), ("bang", _BANG), ("non_ascii", _WIDE)):
            f[name] = share(member)
        odd = _SYMBOL[data] | _BANG[data]
        run = odd[1:] & odd[:-1] & (owner[1:] == owner[:-1])
        f["symbol_run"] = np.bincount(owner[1:][run], minlength=n) * per_byte
        if len(row):
            distinct, most = _distinct(row, hashed, n)
            f["distinct_words"], f["top_word"] = distinct * per_word, most * per_word
            near = row[1:] == row[:-1]
            same = near & (hashed[1:] == hashed[:-1])
            f["next_same"] = np.bincount(row[1:][same], minlength=n) * per_word
            couple = mix(hashed[1:] * np.uint64(3) + hashed[:-1])[near]
            f["distinct_pairs"] = _distinct(row[1:][near], couple, n)[0] / np.maximum(count - 1, 1)
            f["short_words"] = np.bincount(row[length <= 3], minlength=n) * per_word
            line = np.cumsum(data == 10)[start] + row  # a new row is a new line as well
            first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
            order = (np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))).astype(np.uint64)
            whole = np.add.reduceat(mix(hashed + order), first)
            lines = np.bincount(row[first], minlength=n)
            f["line_words"] = np.log1p(count / np.maximum(lines, 1))
            f["repeated_lines"] = np.where(lines > 0, 1 - _distinct(row[first], whole, n)[0] / np.maximum(lines, 1), 0)
        out[lo:hi] = np.stack([f[name] for name in FEATURES], axis=1)
    out[~np.isfinite(out)] = 0
    return out


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree with at most ``leaves`` leaves, best gain first."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        at = np.arange(lo + 1, hi)
        lg, lh = cg[at] - cg[lo], ch[at] - ch[lo]
        rg, rh = cg[hi] - cg[at], ch[hi] - ch[at]
        gain = lg**2 / (lh + PENALTY) + rg**2 / (rh + PENALTY) - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + PENALTY)
        k = int(gain.argmax())
        return float(gain[k]), int(at[k])

    spans = [(*best(0, len(g)), 0, len(g))]
    while len(spans) < leaves:
        spans.sort(key=lambda s: s[0])
        gain, at, lo, hi = spans[-1]
        if gain <= 1e-9:
            break
        spans[-1:] = [(*best(lo, at), lo, at), (*best(at, hi), at, hi)]
    out = np.zeros(len(g))
    for _, _, lo, hi in spans:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + PENALTY)
    return out


def _two_cuts(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values by cell of the best tree that cuts the first feature once and the second once."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = np.arange(1, g.shape[0]), np.arange(1, g.shape[1])
    quarters = []
    for c in (cg, ch):
        low = c[np.ix_(a, b)]
        left, right = c[a, -1][:, None], c[-1, b][None, :]
        quarters.append(np.stack([low, left - low, right - low, c[-1, -1] - left - right + low]))
    gain = (quarters[0] ** 2 / (quarters[1] + PENALTY)).sum(0) - cg[-1, -1] ** 2 / (ch[-1, -1] + PENALTY)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = quarters[0][:, i, j] / (quarters[1][:, i, j] + PENALTY)
    out = np.empty(g.shape)
    x, y = int(a[i]), int(b[j])
    out[:x, :y], out[:x, y:], out[x:, :y], out[x:, y:] = value[0], value[1], value[2], value[3]
    return float(gain[i, j]), out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


class AdditiveModel:
    """Tables over bins of features and of pairs of features."""

    def __init__(self, bins: int = BINS, pair_bins: int = PAIR_BINS, pairs: int = PAIRS, rounds: int = ROUNDS):
        self.bins, self.pair_bins, self.n_pairs, self.rounds = bins, pair_bins, pairs, rounds
        self.intercept = 0.0
        self.edges, self.tables, self.coarse, self.pairs, self.pair_tables = [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(y):
            return self
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.intercept = float(np.log(p / (1 - p)))
        self.edges = [_edges(x[:, f], self.bins) for f in range(x.shape[1])]
        self.coarse = [_edges(x[:, f], self.pair_bins) for f in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        fine = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]
        total = np.full(len(y), self.intercept)

        def gradients() -> tuple[np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-total))
            return y - q, np.maximum(q * (1 - q), 1e-6)

        for _ in range(self.rounds):
            for f, b in enumerate(fine):
                g, h = gradients()
                size = len(self.tables[f])
                step = RATE * _tree(np.bincount(b, g, size), np.bincount(b, h, size), LEAVES)
                self.tables[f] += step
                total += step[b]
        g, h = gradients()
        cells = {}
        for u, v in combinations(range(x.shape[1]), 2):
            shape = (len(self.coarse[u]) + 1, len(self.coarse[v]) + 1)
            if min(shape) > 1:
                cell = coarse[u] * shape[1] + coarse[v]
                gain, _ = _two_cuts(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape))
                cells[u, v] = (gain, cell, shape)
        self.pairs = sorted(cells, key=lambda k: (-cells[k][0], k))[: self.n_pairs]
        self.pair_tables = [np.zeros(cells[k][2]) for k in self.pairs]
        for _ in range(self.rounds // 2):
            for k, pair in enumerate(self.pairs):
                _, cell, shape = cells[pair]
                g, h = gradients()
                _, step = _two_cuts(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape))
                self.pair_tables[k] += RATE * step
                total += RATE * step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], side="right")]
        for (u, v), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.coarse[u], x[:, u], side="right"), np.searchsorted(self.coarse[v], x[:, v], side="right")]
        return 1 / (1 + np.exp(-total))


def with_features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row and its features as an array."""
    bounded_batches(rows.sparkSession)
    rows = rows.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features_of(batch.column("_text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], flat], names=[*keep, "features"])

    return rows.mapInArrow(run, rows.select(*keep).schema.add("features", ArrayType(DoubleType())))


def labelled_sample(labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` doc_ids with their label, the first by a hash of doc_id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> AdditiveModel:
    """A model of ``labels.quality`` from the texts of ``docs``; both without held-out rows."""
    chosen = labelled_sample(labels, "quality", rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = with_features(found, ["doc_id", "y"]).groupBy("doc_id").agg(F.first("y").alias("y"), F.min("features").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return AdditiveModel().fit(x, got["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(features_of(batch.column("text"))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit_quality(docs.where(~held_out), labels.where(~held_out))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
