"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts become words; every ``GRAM`` words in a row are hashed, and of every ``WINDOW - GRAM + 1`` hashes in a row the
smallest is kept as a fingerprint. A shared passage of at least ``WINDOW`` words therefore always shares a fingerprint.
Fingerprints of documents meet those of the benchmark; a hit is extended to every window of ``WINDOW`` words that holds
the fingerprint's words, and only these windows are compared, word for word, with the windows of the items. Items
shorter than a window are one window of their own; for them the anchor is their rarest word (by a hash), which meets
the different words of the documents, and only in the documents so found their windows are looked up.

Scale. Fingerprints are made and matched in the scan of the documents: per document only the distinct fingerprints
(about two in seven words) are exploded, as hash and position in one number, and they meet a table whose size is checked
before it is broadcast; beyond the bound Spark joins by shuffle. Texts are read again only for documents with a hit.

Defined cases: null texts have no words; items without words are no items; several items with equal windows count each;
every row is judged by its own text, whatever other rows share its doc_id or lack one (rows are joined by a digest of id and text, so
only equal rows share a result); extra columns are ignored, whatever their names; a text of any length is one row of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.llm.tables import sized_broadcast, table, written

GRAM = 5
WINDOW = 10
_PLACE_BITS = 30

# fixed values of the contract: what separates words, and the letters that are lowered
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text; ASCII texts take the cheaper lower(), which is the same for them."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often (and in whatever lambda) it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _combined(values: Column, by: int, other: Column, fn) -> Column:
    """``fn`` of each value and the one ``by`` places on in ``other``; the last ``by`` results mean nothing."""
    return F.zip_with(values, F.slice(other, by + 1, F.greatest(F.size(other) - by, F.lit(0))), fn)


def _grams(hashes: Column) -> Column:
    """Hash of every ``GRAM`` = 5 word hashes in a row: pairs, pairs of pairs, and one more."""
    two = _combined(hashes, 1, hashes, lambda a, b: F.xxhash64(a, b))
    four = let(two, lambda g: _combined(g, 2, g, lambda a, b: F.xxhash64(a, b)))
    five = let(four, lambda g: _combined(g, 4, hashes, lambda a, b: F.xxhash64(a, b)))
    five = F.slice(five, 1, F.size(hashes) - GRAM + 1)
    return F.transform(five, lambda g, i: F.shiftleft(g, _PLACE_BITS).bitwiseOR(i.cast("long")))


def _least(grams: Column) -> Column:
    """Smallest of every ``WINDOW - GRAM + 1`` = 6 values in a row: of two, of two twos, and of a four with the two behind it."""
    two = _combined(grams, 1, grams, lambda a, b: F.least(a, b))
    four = let(two, lambda m: _combined(m, 2, m, lambda a, b: F.least(a, b)))
    six = let(four, lambda m: _combined(m, 2, m, lambda a, b: F.least(a, b)))
    return F.slice(six, 1, F.size(grams) - (WINDOW - GRAM))


def fingerprints(words: Column) -> Column:
    """Distinct (hash, place) of the winnowed k-grams, the place (from 0) in the low ``_PLACE_BITS`` bits."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.when(F.size(h) >= WINDOW, F.array_distinct(let(let(h, _grams), _least))))


def _place(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")


def _windows(words: Column, starts: Column, size: int | Column) -> Column:
    """(start, the window's words joined) for each start."""
    return let(words, lambda w: F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(w, s + 1, size), " ").alias("window"))))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, n, window) of every window of every item."""
    worded = items.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    starts = F.sequence(F.lit(0), F.size("words") - F.col("n"))
    return worded.where("n > 0").select("item_id", "n", F.explode(_windows(F.col("words"), starts, F.col("n"))).alias("w")).select("item_id", "n", "w.window").distinct()


def keyed(doc_id: Column, text: Column) -> Column:
    """A digest of id and text, by which rows are joined: equal rows share it."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))))


def window_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (key, start, n, window) of documents, and (item_id, n, window)."""
    windows = written(item_windows(items), "item-windows")
    known = written(windows.select("n", "window").distinct(), "windows")
    long_items = items.select(words_of(F.col("text")).alias("words"))
    wanted = long_items.select(F.explode(fingerprints(F.col("words"))).alias("fp")).select(F.shiftright("fp", _PLACE_BITS).alias("hash")).distinct()
    wanted = written(wanted, "wanted")
    rows = docs.select(keyed(F.col("doc_id"), F.col("text")).alias("key"), "text")
    words = words_of(F.col("text")).alias("words")
    worded = rows.select("key", words)
    found = worded.select("key", F.explode(fingerprints(F.col("words"))).alias("fp"))
    found = found.select("key", F.shiftright("fp", _PLACE_BITS).alias("hash"), _place(F.col("fp")).alias("place"))
    found = found.join(sized_broadcast(wanted), "hash", "left_semi").select("key", "place").distinct()
    starts = found.groupBy("key").agg(F.collect_set("place").alias("places"))
    starts = written(starts, "fingerprint-hits")
    again = rows.join(sized_broadcast(starts.select("key"), 500_000), "key", "left_semi").select("key", words).join(starts, "key")
    reach = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(p - (WINDOW - GRAM), F.lit(0)), F.least(p, F.size("words") - WINDOW)))))
    near = again.where(F.size("words") >= WINDOW).select("key", F.explode(_windows(F.col("words"), reach, WINDOW)).alias("w"))
    near = near.select("key", "w.start", F.lit(WINDOW).alias("n"), "w.window")
    hits = near.join(sized_broadcast(known.where(F.col("n") == WINDOW)), ["n", "window"], "left_semi")

    short = known.where(F.col("n") < WINDOW)
    sizes = sorted(r.n for r in short.select("n").distinct().collect())  # at most WINDOW - 1 numbers
    if sizes:
        anchor = F.array_min(F.transform(F.split("window", " "), lambda w: F.xxhash64(w)))
        anchors = short.select("n", anchor.alias("word")).distinct()
        candidates = worded.select("key", F.explode(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))).alias("word"))
        candidates = candidates.join(sized_broadcast(anchors), "word").groupBy("key").agg(F.collect_set("n").alias("sizes"))
        candidates = written(candidates, "anchor-hits")
        again = rows.join(sized_broadcast(candidates.select("key"), 500_000), "key", "left_semi").select("key", words).join(candidates, "key")
        each = again.select("key", "words", F.explode("sizes").alias("n")).where(F.size("words") >= F.col("n"))
        every = F.sequence(F.lit(0), F.size("words") - F.col("n"))
        near = each.select("key", "n", F.explode(_windows(F.col("words"), every, F.col("n"))).alias("w")).select("key", "w.start", "n", "w.window")
        hits = hits.unionByName(near.join(sized_broadcast(short), ["n", "window"], "left_semi"))
    return written(hits.select("key", "start", "n", "window").distinct(), "window-hits"), windows


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, n_hit, n_items, items) of the rows with a hit; items are the ids, sorted as text, joined by commas."""
    hits, windows = window_hits(docs, items)
    spans = hits.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    covered = spans.select("key", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    pairs = hits.select("key", "n", "window").distinct().join(sized_broadcast(windows, 500_000), ["n", "window"]).select("key", "item_id").distinct()
    listed = pairs.groupBy("key").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    listed = listed.select("key", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("items"))
    return covered.join(listed, "key")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` none of whose words lie in a window of an item; its columns may have any names."""
    hit = window_hits(docs, items)[0].select("key").distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), keyed(F.col("doc_id"), F.col("text")).alias("key"))
    return packed.join(sized_broadcast(hit, 500_000), "key", "left_anti").select("row.*")


def op9_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document occurs in benchmark items, and in which."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = contamination(docs, items).select("key", "n_hit", "n_items", F.sha2("items", 256).alias("digest"))
    counted = docs.select("doc_id", keyed(F.col("doc_id"), F.col("text")).alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    both = counted.join(sized_broadcast(found, 500_000), "key", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.sha2(F.lit(""), 256)
    return both.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("digest", none).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP9_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), item_starts AS (
  SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS s FROM items WHERE len(words) > 0
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[s : s + n - 1], ' ') AS win FROM item_starts
), doc_starts AS (
  SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM item_windows) sizes WHERE len(words) >= n
), hits AS (
  SELECT d.rid, d.s, d.n, d.win FROM (SELECT rid, s, n, array_to_string(words[s : s + n - 1], ' ') AS win FROM doc_starts) d
  WHERE (d.n, d.win) IN (SELECT (n, win) FROM item_windows)
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT h.rid, i.item_id::VARCHAR AS item FROM hits h JOIN item_windows i ON h.n = i.n AND h.win = i.win) GROUP BY rid
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, COALESCE(c.n_hit, 0)::BIGINT AS n_hit, COALESCE(m.n_items, 0)::BIGINT AS n_items,
  sha256(COALESCE(m.items, '')) AS items_sha256, COALESCE(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.rid = c.rid LEFT JOIN named m ON d.rid = m.rid
"""
