"""Pair features as relational plans.

Each distinct source is split and tokenised once. Terms become postings (document, sentence,
term), queries become (pair, term) rows, and BM25 / TF-IDF / coverage are a join on
(document, term) followed by sums. A popular document is spread over its terms, and no text
is processed in a Python loop; only the stems, the LCS of ROUGE-L and the evidence of claims,
which is found inside a pair's row, need Arrow functions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from routelens.functions import text as X
from routelens.functions.stemming import stem

K1, B = 1.5, 0.75


def sources(pairs: DataFrame) -> DataFrame:
    """Distinct source documents."""
    return pairs.select("doc_key", "source").dropDuplicates(["doc_key"])


def sentence_table(docs: DataFrame, tokenizer=X.tokens, key: str = "doc_key", text: str = "source") -> DataFrame:
    """One row per source sentence with its tokens and the document's sentence statistics."""
    s = docs.select(key, X.sentences(F.col(text)).alias("_s"))
    s = s.select(key, "_s", F.transform("_s", tokenizer).alias("_t"))
    total = F.aggregate(F.transform("_t", F.size), F.lit(0), lambda a, x: a + x)
    n = F.size("_s")
    s = s.select(key, n.alias("n_sent"), F.greatest(total / n, F.lit(1.0)).alias("avg_len"), F.posexplode(F.arrays_zip("_s", "_t")).alias("sidx", "x"))
    return s.select(key, "n_sent", "avg_len", "sidx", F.col("x._s").alias("sentence"), F.col("x._t").alias("toks"))


def postings(sent: DataFrame, key: str = "doc_key", terms: Column | None = None) -> DataFrame:
    """Term frequency per sentence and document frequency over the document's sentences."""
    t = sent.select(key, "n_sent", "avg_len", "sidx", F.size("toks").alias("slen"), F.explode(F.col("toks") if terms is None else terms).alias("term"))
    p = t.groupBy(key, "term", "sidx").agg(F.count("*").alias("tf"), F.first("slen").alias("slen"), F.first("n_sent").alias("n_sent"), F.first("avg_len").alias("avg_len"))
    return p.withColumn("df", F.count("*").over(W.partitionBy(key, "term")))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def bm25(queries: DataFrame, post: DataFrame, ids: Sequence[str], key: str = "doc_key") -> DataFrame:
    """BM25 of each query against each sentence of its document; zero scores are left out.

    ``queries``: ids, key, term, qf.
    """
    j = queries.join(post, [key, "term"])
    return j.groupBy(*ids, "sidx").agg(F.sum(_bm25_part()).alias("score"))


def top_three(scores: DataFrame, ids: Sequence[str], last_wins: bool = False) -> DataFrame:
    """The three best sentences folded into one row per query; of equal scores the first position wins, or the last."""
    w = W.partitionBy(*ids).orderBy(F.round("score", 12).desc(), F.desc("sidx") if last_wins else F.asc("sidx"))
    r = scores.withColumn("_r", F.row_number().over(w)).filter("_r <= 3")
    at = lambda c, i: F.max(F.when(F.col("_r") == i, F.col(c)))
    return r.groupBy(*ids).agg(
        at("score", 1).alias("s1"), at("score", 2).alias("s2"), F.sum("score").alias("s_sum"), at("sidx", 1).alias("i1"),
        F.array_sort(F.collect_list(F.struct("_r", "sidx"))).alias("_top"),
    ).withColumn("top", F.transform("_top", lambda x: x["sidx"])).drop("_top")


def top_columns(name: str, n: Column, last_wins: bool = False) -> list[Column]:
    """Top-1, mean of top-3, gap and position; sentences without a score count as zero, so without any all of them tie."""
    z = F.lit(0.0)
    return [
        F.coalesce("s1", z).alias(f"{name}_top1"),
        (F.coalesce("s_sum", z) / F.least(n, F.lit(3))).alias(f"{name}_mean3"),
        (F.coalesce("s1", z) - F.coalesce("s2", z)).alias(f"{name}_gap12"),
        F.coalesce("i1", n - 1 if last_wins else F.lit(0)).alias(f"{name}_index"),
    ]


def shared_terms(pairs: DataFrame, tokenizer) -> DataFrame:
    """(pair_id, doc_key, sidx, term, tf, qf, df, slen, n_sent, avg_len) of the summary's terms that a source sentence has.

    A pair's row holds both texts, so terms that only one of them has are left out before any row moves, and one exchange by
    pair serves every step up to the best sentences. Sentences with a term all share it, so ``df`` is over the whole source.
    """
    x = pairs.select("pair_id", "doc_key", tokenizer(F.col("summary")).alias("_q"), X.sentences(F.col("source")).alias("_s"))
    x = x.select("pair_id", "doc_key", "_q", F.transform("_s", tokenizer).alias("_t"))
    total = F.aggregate(F.transform("_t", F.size), F.lit(0), lambda a, t: a + t)
    n = F.size("_t")
    x = x.select("pair_id", "doc_key", "_q", n.alias("n_sent"), F.greatest(total / n, F.lit(1.0)).alias("avg_len"), F.posexplode("_t").alias("sidx", "_t"))
    times = lambda terms, t: F.size(F.filter(terms, lambda y: y == t)).cast("long")
    both = F.transform(F.array_intersect("_q", "_t"), lambda t: F.struct(t.alias("term"), times("_t", t).alias("tf"), times("_q", t).alias("qf")))
    x = x.select("pair_id", "doc_key", "n_sent", "avg_len", "sidx", F.size("_t").alias("slen"), F.explode(both).alias("_b"))
    x = x.select("pair_id", "doc_key", "n_sent", "avg_len", "sidx", "slen", "_b.*").repartition("pair_id")
    # a repeated pair asks its terms as often as it comes; its source is still one
    once = [F.first(c).alias(c) for c in ("tf", "slen", "n_sent", "avg_len")]
    x = x.groupBy("pair_id", "doc_key", "sidx", "term").agg(F.sum("qf").alias("qf"), *once)
    return x.withColumn("df", F.count("*").over(W.partitionBy("pair_id", "doc_key", "term")))


def own_postings(rows: list) -> Iterator[tuple]:
    """(sidx, tf, slen, n_sent, avg_len, qf, df) of each term and sentence of a document; ``qf`` counts the term in the whole document.

    A document is the list of its rows' sentences, each a list of tokens; rows that repeat it add up their counts, sentence by sentence.
    """
    times: dict = {}
    for sentences in rows:
        n = len(sentences)
        avg_len = max(sum(map(len, sentences)) / n, 1.0) if n else 1.0
        for sidx, toks in enumerate(sentences):
            for t in toks:
                at = times.setdefault(t, {})
                if sidx in at:
                    at[sidx][0] += 1
                else:
                    at[sidx] = [1, len(toks), n, avg_len]
    for at in times.values():
        qf = sum(y[0] for y in at.values())
        for sidx, x in at.items():
            yield sidx, *x, qf, len(at)


OWN = {"sidx": pa.int32(), "tf": pa.int64(), "slen": pa.int32(), "n_sent": pa.int32(), "avg_len": pa.float64(), "qf": pa.int64(), "df": pa.int64()}


def _own_posting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 128):
            batch = whole.slice(lo, 128)
            found = [(i, p) for i, rows in enumerate(batch.column(1).to_pylist()) for p in own_postings(rows)]
            keys = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([p[j] for _, p in found], t) for j, t in enumerate(OWN.values())]], names=[batch.schema.names[0], *OWN])


def own_bm25(docs: DataFrame, key: str = "doc_key", text: str = "source") -> DataFrame:
    """BM25 of all terms of each document against its sentences, as ``bm25`` with the documents as queries has it.

    Only texts move, to bring rows of one key together, and then one sum a sentence; no posting does.
    """
    x = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(text).alias("_x"))
    x = x.select(key, F.transform("_x", lambda t: F.transform(X.sentences(t), X.tokens)).alias("_t"))
    x = x.mapInArrow(_own_posting_batches, f"`{key}` {dict(x.dtypes)[key]}, sidx int, tf long, slen int, n_sent int, avg_len double, qf long, df long")
    return x.groupBy(key, "sidx").agg(F.sum(_bm25_part()).alias("score"))


def _bm25_part() -> Column:
    norm = F.col("tf") + K1 * (1.0 - B + B * F.col("slen") / F.col("avg_len"))
    return F.col("qf") * idf(F.col("n_sent"), F.col("df")) * F.col("tf") * (K1 + 1.0) / norm


def bm25_features(pairs: DataFrame, last_wins: bool = False) -> DataFrame:
    """The whole summary as one query against the source's sentences."""
    scores = shared_terms(pairs, X.tokens).groupBy("pair_id", "sidx").agg(F.sum(_bm25_part()).alias("score"))
    top = top_three(scores, ["pair_id"], last_wins)
    n = F.size(X.sentences(F.col("source")))
    base = pairs.select("pair_id", n.alias("n_sent"))
    return base.join(top, "pair_id", "left").select("pair_id", "n_sent", *top_columns("bm25", F.col("n_sent"), last_wins))


def ngrams(x: Column) -> Column:
    """Unicode words and adjacent word pairs."""
    w = X.unicode_words(x)
    return F.concat(w, X.bigrams(w, " "))


def _tfidf(times: str) -> Column:
    return F.col(times) * (F.log((F.lit(1.0) + F.col("n_sent")) / (F.lit(1.0) + F.col("df"))) + 1.0)


def tfidf_scores(pairs: DataFrame) -> DataFrame:
    """Cosine of smooth-idf, L2-normalised 1-2-gram vectors fitted on the source's own sentences."""
    post = postings(sentence_table(sources(pairs), ngrams)).withColumn("w", _tfidf("tf"))
    norm = post.groupBy("doc_key", "sidx").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    x = shared_terms(pairs, ngrams).withColumns({"w": _tfidf("tf"), "qw": _tfidf("qf")})
    # a term of the query is on df rows, so each of them has that share of its square
    dot = x.groupBy("pair_id", "doc_key", "sidx").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"), F.sum(F.col("qw") * F.col("qw") / F.col("df")).alias("_qq"))
    dot = dot.withColumn("qnorm", F.sqrt(F.sum("_qq").over(W.partitionBy("pair_id"))))
    return dot.join(norm, ["doc_key", "sidx"]).select("pair_id", "sidx", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))


@F.pandas_udf(DoubleType())
def rouge_l(target: pd.Series, prediction: pd.Series) -> pd.Series:
    """LCS F-measure of two token lists; the LCS row is kept as bits of one integer."""

    def f(a, b):
        if len(a) == 0 or len(b) == 0:
            return 0.0
        where: dict = {}
        for i, t in enumerate(a):
            where[t] = where.get(t, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for t in b:
            m = where.get(t, 0)
            u = row & m
            row = ((row + u) | (row - u)) & full
        lcs = len(a) - bin(row).count("1")
        return 2.0 * lcs / (len(a) + len(b)) if lcs else 0.0

    return pd.Series([f(a, b) for a, b in zip(target, prediction)])


def rouge_words(x: Column) -> Column:
    return X.found(F.lower(x), "[a-z0-9]+")


REMEMBERED = 200_000


@F.pandas_udf(ArrayType(StringType()))
def stemmed(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of tokens of more than three letters; each different token of a task is stemmed once, up to ``REMEMBERED`` of them."""
    known: dict[str, str] = {}

    def one(t: str) -> str:
        if len(t) <= 3:
            return t
        if t not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[t] = stem(t)
        return known[t]

    for batch in tokens:
        yield batch.map(lambda ts: None if ts is None else [one(t) for t in ts])


def rouge_scores(pairs: DataFrame, stems: bool = True) -> DataFrame:
    """ROUGE-L F of the (stemmed) summary against every source sentence sharing a token."""
    as_is = lambda x: x
    cut = stemmed if stems else as_is
    q = pairs.select("pair_id", cut(rouge_words(F.col("summary"))).alias("q"), X.sentences(F.col("source")).alias("_s"))
    s = q.select("pair_id", "q", F.posexplode("_s").alias("sidx", "sentence")).withColumn("t", cut(rouge_words(F.col("sentence"))))
    return s.filter(F.arrays_overlap("q", "t")).select("pair_id", "sidx", rouge_l("q", "t").alias("score"))


def local_features(pairs: DataFrame) -> DataFrame:
    """Counts, coverages and negation: one projection, no shuffle."""
    c, s = F.col("summary"), F.col("source")
    base = pairs.select(
        "pair_id", X.tokens(c).alias("ct"), X.tokens(s).alias("st"), X.numbers(c).alias("cn"), X.numbers(s).alias("sn"),
        X.years(c).alias("cy"), X.years(s).alias("sy"), X.entities(c).alias("ce"), X.entities(s).alias("se"), F.size(X.sentences(s)).alias("n_sent"))
    neg = X.words(X.NEGATIONS)
    cneg, sneg = F.arrays_overlap("ct", neg), F.arrays_overlap("st", neg)
    dbl = lambda x: x.cast("double")
    return base.select(
        "pair_id", dbl(F.size("ct")).alias("claim_token_count"), dbl(F.size("st")).alias("source_token_count"), dbl(F.col("n_sent")).alias("sentence_count"),
        (F.size("ct") / F.greatest(F.size("st"), F.lit(1))).alias("claim_source_length_ratio"),
        X.coverage(F.col("ct"), F.array_distinct("st")).alias("word_coverage"),
        X.coverage(X.bigrams(F.col("ct")), F.array_distinct(X.bigrams(F.col("st")))).alias("bigram_coverage"),
        dbl(F.size("cn")).alias("number_count"), X.coverage(F.col("cn"), F.col("sn")).alias("number_coverage"),
        dbl(F.size("cy")).alias("year_count"), X.coverage(F.col("cy"), F.col("sy")).alias("year_coverage"),
        dbl(F.size("ce")).alias("entity_count"), X.coverage(F.col("ce"), F.array_distinct("se")).alias("entity_coverage"),
        dbl(cneg).alias("claim_has_negation"), dbl(cneg == sneg).alias("negation_match"))


def retrieval_features(pairs: DataFrame) -> DataFrame:
    """Top-1 / top-3 / gap of the three retrievers, their agreement and normalised positions; the last of equal sentences wins."""
    out = bm25_features(pairs, last_wins=True)
    for name, scores in (("tfidf", tfidf_scores(pairs)), ("rougeL", rouge_scores(pairs))):
        top = top_three(scores, ["pair_id"], last_wins=True)
        out = out.join(top, "pair_id", "left").select(*out.columns, *top_columns(name, F.col("n_sent"), last_wins=True))
    names = ("bm25", "tfidf", "rougeL")
    b, t, r = (F.col(f"{n}_index") for n in names)
    last = F.greatest(F.col("n_sent") - 1, F.lit(1))
    agree = ((b == t).cast("int") + (b == r).cast("int") + (t == r).cast("int")) / F.lit(3.0)
    keep = [c for c in out.columns if not c.endswith("_index") and c != "n_sent"]
    return out.select(*keep, agree.alias("retrieval_top_agreement"), *[(F.col(f"{n}_index") / last).alias(f"{n}_top_index_normalized") for n in names])


def cheap_features(pairs: DataFrame) -> DataFrame:
    """The 27 retrieval and overlap features of a pair."""
    return local_features(pairs).join(retrieval_features(pairs), "pair_id")


# ------------------------------------------------------------------------------ compact features

def _content(t: Column) -> Column:
    return F.array_distinct(F.filter(t, lambda w: ~w.isin(*X.STOPWORDS)))


def marker_features(pairs: DataFrame) -> DataFrame:
    """Lengths and marker densities of the summary, structure of the source: no shuffle."""
    c, s = F.col("summary"), F.col("source")
    base = pairs.select("pair_id", "summary", "source", X.tokens(c).alias("t"), X.sentences(c).alias("ss"), X.openers(X.sentences(c), X.tokens(s)).alias("known"))
    t = F.col("t")
    n = F.greatest(F.size(t), F.lit(1))
    logic = X.word_count(t, X.LOGIC_WORDS)
    for p in X.LOGIC_PHRASES:
        logic = logic + X.phrase_count(c, p)
    said = X.word_count(t, X.ATTRIBUTION_WORDS) + F.floor(F.size(X.found(c, "[\"“”‘’']")) / 2)
    for p in X.ATTRIBUTION_PHRASES:
        said = said + X.phrase_count(c, p)
    total = lambda f: F.aggregate(F.transform("ss", f), F.lit(0), lambda a, x: a + x)
    names = F.zip_with("ss", "known", lambda x, k: F.size(X.summary_entity_spans(x, k)))
    facts = F.aggregate(names, F.lit(0), lambda a, x: a + x) + total(lambda x: F.size(X.value_spans(x)))
    return base.select(
        "pair_id", F.log1p(F.size(X.tokens(s)).cast("double")).alias("log_source_token_count"), F.size("ss").cast("double").alias("summary_sentence_count"),
        F.array_max(F.transform("ss", lambda x: F.size(X.tokens(x)))).cast("double").alias("max_summary_sentence_tokens"),
        (facts / n).alias("fact_mention_density"), (logic / n).alias("logic_marker_density"), (said / n).alias("attribution_marker_density"),
        (X.word_count(t, X.PRONOUNS) / n).alias("pronoun_reference_density"), X.structured_line_ratio(s).alias("structured_source_line_ratio"))


def lexical_entropy(docs: DataFrame, key: str = "doc_key", text: str = "source") -> DataFrame:
    """Entropy of the non-stopword tokens over ln(vocabulary size); 0 for at most one term."""
    t = docs.select(key, F.explode(F.filter(X.tokens(F.col(text)), lambda w: ~w.isin(*X.STOPWORDS))).alias("term"))
    c = t.groupBy(key, "term").agg(F.count("*").cast("double").alias("n"))
    g = c.groupBy(key).agg(F.sum("n").alias("N"), F.count("*").alias("k"), F.sum(F.col("n") * F.log("n")).alias("nl"))
    e = F.when(F.col("k") > 1, (F.log("N") - F.col("nl") / F.col("N")) / F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0))
    return docs.select(key).join(g.select(key, e.alias("e")), key, "left").select(key, F.coalesce("e", F.lit(0.0)).alias("source_lexical_entropy"))


#: cells of the (claim, source sentence) grid filled at a time, and the shared terms put into them; groups of rows taken from a batch
GRID, GROUPS = 1 << 21, 64
CLAIM = pa.struct([("row", pa.int32()), ("cidx", pa.int32()), ("n_src", pa.int32()), ("coverage", pa.float64()), ("strength", pa.float64()),
                   ("ambiguity", pa.float64()), ("best", pa.int32()), ("top", pa.list_(pa.int32()))])
CLAIM_TYPE = "array<struct<row:int,cidx:int,n_src:int,coverage:double,strength:double,ambiguity:double,best:int,top:array<int>>>"


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")


def _idf(n: np.ndarray, df: np.ndarray) -> np.ndarray:
    return np.log(1.0 + (n - df + 0.5) / (df + 0.5))


def _best_three(m: np.ndarray, term: np.ndarray, cells: np.ndarray, start: np.ndarray, df: np.ndarray, sidx: np.ndarray, part: np.ndarray) -> tuple:
    """BM25 of claims against source sentences: per claim the sum of its scores, of score times log score, the best score and the three best positions.

    Entry i says that claim ``m[i]`` (ascending) has term ``term[i]``, whose postings are ``df`` ones from ``start``, each with the
    position ``sidx`` of its sentence and its ``part`` of the score. As many claims are scored together as fill ``GRID`` cells.
    """
    claims = len(cells)
    mass, mass_log, best, top = np.zeros(claims), np.zeros(claims), np.zeros(claims), np.full((claims, 3), -1, "int64")
    cost = np.cumsum(cells + np.bincount(m, df[term], claims).astype("int64"))
    lo = 0
    while lo < claims:
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + GRID, "right")))
        e = slice(*np.searchsorted(m, (lo, hi)))
        times, off = df[term[e]], _starts(cells[lo:hi])
        at = np.arange(times.sum()) + np.repeat(start[term[e]] - _starts(times), times)
        grid = np.bincount(np.repeat(off[m[e] - lo], times) + sidx[at], part[at], cells[lo:hi].sum())
        met = np.flatnonzero(grid)
        score = grid[met]
        counts = np.diff(np.searchsorted(met, np.append(off, len(grid))))
        some = np.flatnonzero(counts)
        if len(some):
            first, who = _starts(counts[some]), np.repeat(np.arange(len(some)), counts[some])
            mass[lo + some], mass_log[lo + some] = np.add.reduceat(score, first), np.add.reduceat(score * np.log(score), first)
            left = np.round(score, 12)  # of equal scores the first position wins
            for k in range(3):
                hit = np.flatnonzero((left == np.maximum.reduceat(left, first)[who]) & (left >= 0))
                hit = hit[np.flatnonzero(np.diff(who[hit], prepend=-1))]
                claim = some[who[hit]]
                top[lo + claim, k] = met[hit] - off[claim]
                if k == 0:
                    best[lo + claim] = score[hit]
                left[hit] = -1.0
        lo = hi
    return mass, mass_log, best, top


def claim_evidence(rows: pa.Array) -> pa.Array:
    """For each group of rows with one pair_id, its claims in order with what ``evidence_table`` tells of them.

    A row has (paired, keyed, own, t, u): whether its pair and its source have a key, whether its summary is its source, the tokens of
    the source's sentences and those of the summary's, which an own row leaves out. Claims of one position in a group add up their terms.
    """
    in_group = _sizes(rows)
    paired, keyed, own, t, u = rows.flatten().flatten()
    paired, keyed, own = (x.to_numpy(zero_copy_only=False).astype(bool) for x in (paired, keyed, own))
    n, n_own = _sizes(t), _sizes(u)
    t, u = t.flatten(), u.flatten()
    slen, ulen = _sizes(t), _sizes(u)
    both = pa.concat_arrays([t.flatten(), u.flatten()]).dictionary_encode()
    code, width = both.indices.to_numpy(zero_copy_only=False).astype("int64"), max(len(both.dictionary), 1)
    plain = ~pc.is_in(both.dictionary, value_set=pa.array(X.STOPWORDS, both.dictionary.type)).to_numpy(zero_copy_only=False)[code]

    def term_counts(sizes, code, plain):
        """(sentence, term, count) without stop words."""
        found, count = np.unique((np.repeat(np.arange(len(sizes)), sizes) * width + code)[plain], return_counts=True)
        return found // width, found % width, count

    row_of = np.repeat(np.arange(len(n)), n)
    sent, word, tf = term_counts(slen, code[:slen.sum()], plain[:slen.sum()])
    row = row_of[sent]
    position = sent - _starts(n)[row]
    # postings of the sources, term by term
    order = np.argsort(row * width + word, kind="stable")
    order = order[keyed[row[order]]]
    terms, start, df = np.unique((row * width + word)[order], return_index=True, return_counts=True)
    avg_len = np.maximum(np.bincount(row_of, slen, len(n)) / np.maximum(n, 1), 1.0)
    norm = tf + K1 * (1.0 - B + B * slen[sent] / avg_len[row])
    weight = np.repeat(_idf(n[terms // width], df), df) * (tf * (K1 + 1.0) / norm)[order]
    # claims and the terms they ask
    n_claims = np.where(own, n, n_own)
    first = _starts(n_claims)
    claim_row = np.repeat(np.arange(len(n)), n_claims)
    cidx = np.arange(len(claim_row)) - first[claim_row]
    asked, asked_word, _ = term_counts(ulen, code[slen.sum():], plain[slen.sum():])
    asked_row = np.repeat(np.arange(len(n)), n_own)[asked]
    self_asked = own[row]
    entry_row = np.concatenate([row[self_asked], asked_row])
    claim = np.concatenate([(first[row] + position)[self_asked], first[asked_row] + asked - _starts(n_own)[asked_row]])
    term_key = entry_row * width + np.concatenate([word[self_asked], asked_word])
    group = np.repeat(np.arange(len(in_group)), in_group)
    if len(group) == len(in_group):
        merged = np.arange(len(claim_row))
    else:
        merged = np.unique(group[claim_row] * (n_claims.max(initial=0) + 1) + cidx, return_inverse=True)[1]
    kept = np.flatnonzero(paired[entry_row])
    kept = kept[np.argsort(merged[claim[kept]], kind="stable")]
    entry_row, term_key, m = entry_row[kept], term_key[kept], merged[claim[kept]]
    cells = np.zeros(merged.max(initial=-1) + 1, "int64")
    np.maximum.at(cells, merged, n[claim_row])
    term = np.searchsorted(terms, term_key)
    known = np.append(terms, -1)[term] == term_key
    w = _idf(n[entry_row], np.where(known, np.append(df, 0)[term], 0))
    total, hit = np.bincount(m, w, len(cells))[merged], np.bincount(m[known], w[known], len(cells))[merged]
    mass, mass_log, s1, top = (x[merged] for x in _best_three(m[known], term[known], cells, start, df, position[order], weight))
    n_src = n[claim_row]
    with np.errstate(divide="ignore", invalid="ignore"):
        coverage = np.where(total > 0, hit / total, 1.0)
        strength = np.where(total > 0, s1 / total, 0.0)
        ambiguity = np.where(n_src <= 1, 0.0, np.where(mass > 0, (np.log(mass) - mass_log / mass) / np.log(n_src), 1.0))
    # the best positions, filled up with the first ones
    fill = np.arange(3)
    free = (fill < n_src[:, None]) & ~(top[:, :, None] == fill).any(axis=1)
    choice = np.concatenate([top, np.broadcast_to(fill, top.shape)], axis=1)
    valid = np.concatenate([top >= 0, free], axis=1)
    valid &= np.cumsum(valid, axis=1) <= 3
    tops = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(valid.sum(axis=1))), pa.int32()), pa.array(choice[valid], pa.int32()))
    flat = [claim_row - _starts(in_group)[group[claim_row]], cidx, n_src, coverage, strength, ambiguity, np.maximum(top[:, 0], 0)]
    out = pa.StructArray.from_arrays([*[pa.array(x, f.type) for x, f in zip(flat, CLAIM)], tops], fields=list(CLAIM))
    ends = np.cumsum(np.bincount(group[claim_row], minlength=len(in_group)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), out)


def _claim_evidence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, GROUPS):
            batch = whole.slice(lo, GROUPS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), claim_evidence(batch.column(2))], names=["pair_id", "_x", "_ev"])


def evidence_table(pairs: DataFrame) -> DataFrame:
    """Per summary sentence: idf coverage, best evidence, ambiguity, the top three positions with their sentences, and its opening name if the source has it.

    A pair's row holds both texts, so no posting and no score moves: texts do once, to bring rows of one pair_id together, whose
    sentences of one position ask their terms together. Rows without a pair_id stay alone and find nothing.
    """
    own = F.col("summary").eqNullSafe(F.col("source"))
    text = F.struct("doc_key", own.alias("own"), "source", F.when(~own, F.col("summary")).alias("summary"))
    x = pairs.groupBy("pair_id", F.when(F.col("pair_id").isNull(), F.xxhash64("source", "summary")).alias("_lone")).agg(F.collect_list(text).alias("_x"))
    split = lambda r: F.struct(r["doc_key"].alias("doc_key"), r["own"].alias("own"), X.sentences(r["source"]).alias("s"), F.when(~r["own"], X.sentences(r["summary"])).alias("c"))
    cut = lambda r: F.struct(r["doc_key"].alias("doc_key"), r["own"].alias("own"), r["s"].alias("s"), r["c"].alias("c"), F.transform(r["s"], X.tokens).alias("t"), F.transform(r["c"], X.tokens).alias("u"))
    x = x.select("pair_id", F.transform(F.transform("_x", split), cut).alias("_x"))
    known = lambda r: X.openers(F.when(r["own"], r["s"]).otherwise(r["c"]), F.flatten(r["t"]))
    texts = F.transform("_x", lambda r: F.struct(r["doc_key"].alias("doc_key"), r["s"].alias("s"), r["c"].alias("c"), known(r).alias("known")))
    toks = F.transform("_x", lambda r: F.struct(F.col("pair_id").isNotNull().alias("paired"), r["doc_key"].isNotNull().alias("keyed"), r["own"].alias("own"), r["t"].alias("t"), r["u"].alias("u")))
    dtypes = dict(pairs.dtypes)
    x = x.select("pair_id", texts.alias("_x"), toks.alias("_t")).mapInArrow(
        _claim_evidence_batches, f"pair_id {dtypes['pair_id']}, _x array<struct<doc_key:{dtypes['doc_key']},s:array<string>,c:array<string>,known:array<array<string>>>>, _ev {CLAIM_TYPE}")

    def claim(e):
        r = F.get("_x", e["row"])
        sentences = F.filter(F.transform(e["top"], lambda i: F.get(r["s"], i)), lambda z: z.isNotNull())
        return F.struct(
            e["cidx"].alias("cidx"), r["doc_key"].alias("doc_key"), F.get(F.coalesce(r["c"], r["s"]), e["cidx"]).alias("claim"), F.get(r["known"], e["cidx"]).alias("known"),
            *[e[c].alias(c) for c in ("n_src", "coverage", "strength", "ambiguity", "best", "top")], F.when(r["doc_key"].isNotNull(), sentences).otherwise(F.array().cast("array<string>")).alias("evidence"))

    return x.select("pair_id", F.inline(F.transform("_ev", claim)))


def evidence_features(ev: DataFrame) -> DataFrame:
    """Coverage mean, weakest strength, ambiguity mean, evidence span and distinct-evidence ratio."""
    last = F.greatest(F.max("n_src") - 1, F.lit(1))
    return ev.groupBy("pair_id").agg(
        F.avg("coverage").alias("idf_weighted_coverage_mean"), F.min("strength").alias("weakest_sentence_bm25"), F.avg("ambiguity").alias("evidence_ambiguity"),
        ((F.max("best") - F.min("best")) / last).alias("evidence_span_normalized"), (F.count_distinct("best") / F.count("*")).alias("distinct_evidence_ratio"))


def conflict_features(pairs: DataFrame, ev: DataFrame) -> DataFrame:
    """Entity-value pairs found together in, or contradicted by, the top evidence sentences.

    A summary sentence's row holds its at most three evidence sentences, so its entity-value pairs are tested inside the row. A value
    has a digit: a sentence without one states none and contradicts none. Rows of one pair_id with the same spans are tested together.
    """
    digit = lambda x: x.rlike(r"(?U)\d")
    c = ev.filter(digit(F.col("claim")) & (F.size("evidence") > 0)).select(
        "pair_id", "cidx", X.summary_entity_spans(F.col("claim"), F.col("known")).alias("es"), X.value_spans(F.col("claim")).alias("vs"), "evidence")
    c = c.filter((F.size("es") > 0) & (F.size("vs") > 0))
    spans = F.transform(F.filter("evidence", digit), lambda d: F.struct(F.lower(d).alias("low"), X.entity_spans(d).alias("ents"), X.value_spans(d).alias("vals")))

    def tests(evd):
        def one(e, v):
            holds = F.filter(evd, lambda d: F.contains(d["low"], e) | F.array_contains(d["ents"], e))
            return F.struct(F.exists(holds, lambda d: F.array_contains(d["vals"], v)).alias("same"), F.exists(holds, lambda d: F.size(F.array_except(d["vals"], F.array(v))) > 0).alias("other"))

        return F.flatten(F.transform("es", lambda e: F.transform("vs", lambda v: one(e, v))))

    # the spans are bound by an outer one-element transform, so that they are looked up once a row
    g = c.select("pair_id", "cidx", "es", "vs", F.get(F.transform(F.array(spans), tests), F.lit(0)).alias("tests"))
    g = g.groupBy("pair_id", "cidx", "es", "vs").agg(F.collect_list("tests").alias("tests"))
    at = F.sequence(F.lit(0), F.size("es") * F.size("vs") - 1)
    any_of = lambda i, name: F.exists("tests", lambda t: F.get(t, i)[name])
    count = lambda test: F.size(F.filter(at, test))
    t = g.select("pair_id", (F.size("es") * F.size("vs")).alias("n"), count(lambda i: any_of(i, "same")).alias("same"), count(lambda i: ~any_of(i, "same") & any_of(i, "other")).alias("conf"))
    t = t.groupBy("pair_id").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("conf").alias("conf"))
    return pairs.select("pair_id").join(t, "pair_id", "left").select(
        "pair_id", F.coalesce(F.col("same") / F.col("n"), F.lit(1.0)).alias("entity_value_colocation"), F.coalesce(F.col("conf") / F.col("n"), F.lit(0.0)).alias("conflicting_value_rate"))


def compact_features(pairs: DataFrame) -> DataFrame:
    """The 16 compact features of a pair."""
    ev = evidence_table(pairs)
    ent = pairs.select("pair_id", "doc_key").join(lexical_entropy(sources(pairs)), "doc_key").drop("doc_key")
    return marker_features(pairs).join(ent, "pair_id").join(evidence_features(ev), "pair_id").join(conflict_features(pairs, ev), "pair_id")


# ------------------------------------------------------------------------------ windows and chunks

def token_windows(rows: DataFrame, tokens: Column, budget: Column, keys: Sequence[str], overlap: int = 64) -> DataFrame:
    """Overlapping token windows; the overlap is at most a quarter of the budget."""
    b = F.greatest(budget, F.lit(1))
    o = F.least(F.lit(overlap), F.floor(b / 4).cast("int"))
    x = rows.select(*keys, tokens.alias("_t"), b.cast("int").alias("_b"), o.alias("_o"))
    n, step = F.size("_t"), F.col("_b") - F.col("_o")
    starts = F.sequence(F.lit(0), F.greatest(n - F.col("_b") + step - 1, F.lit(0)), step)
    x = x.select(*keys, "_t", "_b", F.posexplode(starts).alias("window", "start"))
    return x.select(*keys, "window", "start", F.slice("_t", F.col("start") + 1, F.col("_b")).alias("tokens"))


def packed_chunks(sizes: Column, limit: int) -> Column:
    """Chunk number of each sentence when sentences are packed greedily up to ``limit`` words."""
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("chunk"), F.lit(0).alias("used"))

    def step(acc, size):
        fresh = (acc["used"] > 0) & (acc["used"] + size > limit)
        chunk = F.when(fresh, acc["chunk"] + 1).otherwise(acc["chunk"])
        used = F.when(fresh, size).otherwise(acc["used"] + size)
        return F.struct(F.concat(acc["ids"], F.array(chunk)).alias("ids"), chunk.alias("chunk"), used.alias("used"))

    return F.aggregate(sizes, start, step, lambda a: a["ids"])


def select_evidence(pairs: DataFrame, budget: int) -> DataFrame:
    """Source sentences by shared terms with the summary, added while they fit, in source order."""
    terms = lambda x: F.array_distinct(X.found(F.lower(x), "[a-z0-9]+"))
    q = terms(F.col("summary"))
    s = X.sentences(F.col("source"))
    ranked = F.array_sort(F.transform(s, lambda x, i: F.struct((-F.size(F.array_intersect(terms(x), q))).alias("k"), i.alias("i"), F.size(X.tokens(x)).alias("n"))))
    room = F.greatest(F.lit(budget) - F.size(X.tokens(F.col("summary"))), F.lit(0))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("ids"))

    def step(acc, r):
        fits = acc["used"] + r["n"] <= room
        return F.struct(F.when(fits, acc["used"] + r["n"]).otherwise(acc["used"]).alias("used"),
                        F.when(fits, F.concat(acc["ids"], F.array(r["i"]))).otherwise(acc["ids"]).alias("ids"))

    got = F.aggregate(ranked, start, step)
    return pairs.select("pair_id", F.size(s).alias("source_sentence_count"), F.array_sort(got["ids"]).alias("picked"), got["used"].alias("selected_tokens"))
