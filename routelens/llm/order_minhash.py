"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Every text becomes the sequence of its words; a k-mer is five words in a row, labelled with how often it has
occurred before in that text. Each of ``TABLES`` hash functions keeps the ``MINIMA`` smallest labelled k-mers in
*text order*, so the sketch agrees for texts that share k-mers in the same order, which is what edit similarity asks.
Texts that agree in one table are candidates; two texts are linked when the word-level edit distance is at most
``(1 - SIMILARITY)`` of the longer text. Classes are the connected components of the links.

Scale. Exact copies collapse to one representative by a map-side combined group-by before anything else. A bucket
never emits all its pairs: everyone meets the bucket's first member (a star), which joins large groups of near
copies in one linear step; only buckets of at most ``SMALL`` members then try the pairs the star left apart. Larger
buckets are split by the keys of the following tables, and each split part gets its own star, so a passage shared
by thousands of otherwise different texts costs one test a member and level. Large buckets that are then not yet one
component get an exact rest: all pairs of their texts in different components that share one of their rarest words
are tested, by a prefix filter that no similar pair fails (``_overlapping``). Before it, every text meets the texts of its
words that are closest to the middle of the crowd, a few for each word, so the copies a star left apart join the rest of their
group by a number of tests that grows with the texts, not with the group's pairs. Before any text moves, pairs are dropped whose
lengths or word bitmaps already rule out the allowed edits (``_possible``). With 24 tables and two minima a pair
whose 5-mers overlap 0.8 misses all tables with a chance below 1e-9, at 0.5 about 0.1 %; texts without two common
5-mers meet in no table.

Defined cases: a null text is a class of its own; equal texts are one class, the empty text included; a text of
fewer than five words has one k-mer, all its words; texts without words are alike only when equal. Rows may repeat;
a repeated doc_id gets the class of the smallest of its texts' classes. Extra columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.llm.components import components
from routelens.llm.tables import bounded_batches, forget, sized_broadcast, table, written
from routelens.llm.words import mix, parts, powers, split_words, word_spans

K = 5
TABLES = 24
MINIMA = 2
SIMILARITY = 0.8
SMALL = 24
LEVELS = 4
MIDDLE = 4
SLOT_BITS = 20
BITMAP = 8
#: longest text and how many common words its keys hold
CHOICES = ((44, 3), (100, 2))

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def labelled_kmers(row: np.ndarray, hashed: np.ndarray, rows: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every occurrence-labelled k-mer in text order; a shorter text has one k-mer, all its words."""
    n = len(row)
    count = np.bincount(row, minlength=rows)
    base = powers(k)
    km = np.zeros(n, np.uint64)
    for j in range(k):
        same = np.zeros(n, bool)
        same[: n - j] = row[j:] == row[: n - j] if j else True
        shifted = np.zeros(n, np.uint64)
        shifted[: n - j] = hashed[j:]
        km += np.where(same, shifted * base[j], np.uint64(0))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    place = np.arange(n) - first[row]
    keep = place <= np.maximum(count[row] - k, 0)
    km, row = mix(km[keep]), row[keep]
    order = np.argsort(km + mix(row.astype(np.uint64)), kind="stable")
    a, r = km[order], row[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(fresh)
    label = np.empty(len(a), np.uint64)
    label[order] = (np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))).astype(np.uint64)
    return row, mix(km ^ (label * np.uint64(0xD6E8FEB86659FD93)))


def sketches(row: np.ndarray, kmers: np.ndarray, rows: int, tables: int = TABLES, minima: int = MINIMA) -> np.ndarray:
    """rows x tables keys; rows without k-mers are all zero."""
    out = np.zeros((rows, tables), np.int64)
    if not len(row):
        return out
    count = np.bincount(row, minlength=rows)
    have = np.flatnonzero(count)
    size = count[have]
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    base = np.repeat(start, size)
    for t in range(tables):
        value = mix(kmers ^ np.uint64((0xA24BAED4963EE407 * (t + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = np.full((len(have), minima), np.iinfo(np.int64).max)
        key = np.zeros((len(have), minima), np.uint64)
        for m in range(minima):
            least = np.minimum.reduceat(value, start)
            hit = np.flatnonzero(value == np.repeat(least, size))
            owner, where = np.unique(base[hit], return_index=True)
            found = hit[where]
            real = least != _TOP
            at[real, m] = found[real]
            key[real, m] = kmers[found[real]]
            value[found] = _TOP
        order = np.argsort(at, axis=1, kind="stable")
        key = np.take_along_axis(key, order, axis=1)
        folded = np.full(len(have), np.uint64(t + 1))
        for m in range(minima):
            folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + key[:, m])
        out[have, t] = folded.view(np.int64)
    return out


def word_bitmaps(row: np.ndarray, hashed: np.ndarray, rows: int) -> np.ndarray:
    """rows x ``BITMAP`` longs: one bit for each labelled word. An edit adds and takes at most one word, so it flips at most two bits."""
    row, word = labelled_kmers(row, hashed, rows, 1)
    bits = np.zeros((rows, 64 * BITMAP), bool)
    bits[row, (word & np.uint64(64 * BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.zeros((batch.num_rows, TABLES), np.int64)
        bits = np.zeros((batch.num_rows, BITMAP), np.int64)
        words = np.zeros(batch.num_rows, np.int64)
        for lo, hi, data, offsets in parts(batch.column("text")):
            _, _, row, hashed = word_spans(data, offsets)
            words[lo:hi] = np.bincount(row, minlength=hi - lo)
            keys[lo:hi] = sketches(*labelled_kmers(row, hashed, hi - lo), hi - lo)
            bits[lo:hi] = word_bitmaps(row, hashed, hi - lo)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (keys, bits)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(words), *lists], names=["doc_id", "digest", "n_words", "keys", "bits"]
        )


def edit_distance_within(a: list, b: list, limit: int) -> int | None:
    """Word-level edit distance by an alignment in a band of ``limit`` around the diagonal, or None beyond it.

    The band's column is two bit vectors (rises and falls of the vertical differences) that slide one row down with
    each column, so a column costs a few operations on integers of ``2 * limit + 1`` bits.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    a, b = a[lo:x], b[lo:y]
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    if not n or not m:
        return max(n, m)
    seen: dict = {}
    for i, word in enumerate(a):
        seen[word] = seen.get(word, 0) | (1 << i)
    width = 2 * limit + 1
    full = (1 << width) - 1
    # bit r before column j is the step from row j - limit + r - 1 to the next row in column j - 1; rows below 1 are level
    rises, falls = full & ~((1 << limit) - 1), 0
    value = limit  # distance at the lowest cell of the band: row j + limit
    for j in range(1, m + 1):
        shift = j - limit - 1
        eq = seen.get(b[j - 1], 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = ((((eq & rises) + rises) ^ rises) | eq | falls) & full
        up = (falls | ~(d0 | rises)) & full
        down = d0 & rises
        if not d0 >> (width - 1) & 1:
            value += 1
        half = d0 >> 1
        rises = (down | ~(half | up)) & full
        falls = half & up
    # the band's lowest cell is row m + limit: take back the vertical steps below row n
    below = ((1 << (m + limit - n)) - 1) << (n - m + limit)
    value += (falls & below).bit_count() - (rises & below).bit_count()
    return value if value <= limit else None


def similar(a: list, b: list, threshold: float = SIMILARITY) -> bool:
    """Is the edit distance at most ``1 - threshold`` of the longer text?"""
    longest = max(len(a), len(b))
    limit = int((1 - threshold) * longest + 1e-9)
    if longest - min(len(a), len(b)) > limit:
        return False
    return edit_distance_within(a, b, limit) is not None


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose texts are similar; a text that comes again and again is split once."""
    kept: OrderedDict = OrderedDict()

    def words(key: bytes, text: str) -> list[str]:
        if key not in kept:
            if len(kept) >= 64:
                kept.popitem(last=False)
            kept[key] = split_words(text)
        kept.move_to_end(key)
        return kept[key]

    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, right = batch.column("text_a"), batch.column("text_b")
        same = [similar(words(a[i], left[i].as_py()), words(b[i], right[i].as_py())) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))


def _alike(a: str, b: str) -> Column:
    """May two texts with ``n_words`` and ``bits`` (columns ending in ``a`` and ``b``) be similar? ``limit`` edits flip at most twice as many bits."""
    longest, least = F.greatest(f"n_{a}", f"n_{b}"), F.least(f"n_{a}", f"n_{b}")
    limit = F.floor((1 - SIMILARITY) * longest + 1e-9)
    flipped = reduce(lambda x, y: x + y, [F.bit_count(F.get(f"bits_{a}", F.lit(i)).bitwiseXOR(F.get(f"bits_{b}", F.lit(i)))) for i in range(BITMAP)])
    return (longest - least <= limit) & (flipped <= 2 * limit)


def _side(reps: DataFrame, c: str) -> DataFrame:
    return reps.select(F.col("digest").alias(c), F.col("n_words").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))


def _possible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that may be similar by their lengths and word bitmaps. No similar pair is lost."""
    both = pairs.join(_side(reps, "b"), "b").join(_side(reps, "a"), "a")
    return both.where(_alike("a", "b")).select("a", "b")


def _links(pairs: DataFrame, docs: DataFrame, reps: DataFrame, name: str) -> DataFrame:
    """The similar ones of (a, b); only texts of pairs that may be similar move, each once, with its digest as key."""
    pairs = written(_possible(pairs, reps), f"{name}-pairs")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), f"{name}-wanted")
    texts = docs.join(sized_broadcast(wanted), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    # the texts are not written: both joins read the one exchange of this aggregate
    both = pairs.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    links = written(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify_batches, "a binary, b binary"), f"{name}-links")
    forget(pairs, wanted)
    return links


def _bucket_levels(reps: DataFrame) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """(members (bucket, digest), counts (bucket, n, leader), shared (bucket, digest, n, leader)) of each level; a level splits the
    large buckets of the one before. ``shared`` are the members that are not alone, so later steps neither move nor join the others."""
    # a member carries the keys of its next levels along, so no level joins its members with the sketches again
    further = [f"next_{level}" for level in range(1, LEVELS)]
    members = reps.select("digest", "keys", F.posexplode("keys").alias("t", "key"))
    following = [F.element_at("keys", (F.col("t") + level) % TABLES + 1).alias(name) for level, name in enumerate(further, 1)]
    members = members.select("digest", F.xxhash64("t", "key").alias("bucket"), *following)
    levels = []
    for level in range(1, LEVELS + 1):
        counts = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("leader")).where("n > 1"), "buckets")
        shared = written(members.join(counts, "bucket"), "shared-members")
        levels.append((members.select("bucket", "digest"), counts, shared.select("bucket", "digest", "n", "leader")))
        crowd = shared.where(F.col("n") > SMALL)
        if level == LEVELS or crowd.isEmpty():
            break
        members = written(crowd.select("digest", F.xxhash64("bucket", further[level - 1]).alias("bucket"), *further[level:]), "members")
    return levels


def _edits(n):
    """The number of edits that ``similar`` allows when the longer text has ``n`` words."""
    return ((1 - SIMILARITY) * n + 1e-9).astype(np.int64)


def _labelled_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words of each row, row, hash) of parts of a batch; a word is labelled with how often it came before."""
    for lo, hi, data, offsets in parts(texts):
        _, _, row, hashed = word_spans(data, offsets)
        row, word = labelled_kmers(row, hashed, hi - lo, 1)
        yield lo, np.bincount(row, minlength=hi - lo), row, word


def _slot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many labelled words fall into each slot of the frequency table."""
    n = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        for _, _, _, word in _labelled_words(batch.column("text")):
            n += np.bincount((word >> np.uint64(64 - SLOT_BITS)).view(np.int64), minlength=len(n))
    slot = np.flatnonzero(n)
    for lo in range(0, len(slot), 1 << 16):
        at = slot[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])


def _asked(n: int) -> int:
    """How many common words the texts of a pair, the longer one of ``n`` words, are asked for at once: as many as keep a text's
    choices from its rarest words to a few hundred."""
    many = next((k for longest, k in CHOICES if n <= longest), 1)
    return max(min(many, n - int(_edits(np.int64(n)))), 1)


_CHOSEN: dict[tuple[int, int], np.ndarray] = {}


def _choices(size: int, many: int) -> np.ndarray:
    if (size, many) not in _CHOSEN:
        _CHOSEN[size, many] = np.array(list(combinations(range(size), many)), np.int64).reshape(-1, many)
    return _CHOSEN[size, many]


def _rare_words(frequency: np.ndarray, carried: Sequence[str] = ()):
    """Choices of a text's rarest labelled words as keys, with the overlap the text needs and the most it can reach with that choice,
    how close the text is to the middle (how often its words come in the crowd, in the mean), and the columns ``carried`` of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, row, word in _labelled_words(batch.column("text")):
                often = frequency[(word >> np.uint64(64 - SLOT_BITS)).view(np.int64)]
                central = np.bincount(row, often, len(n)) / np.maximum(n, 1)
                order = np.lexsort((word, often, row))
                word = word[order]
                at, keys, room = [], [], []
                for r, (first, size) in enumerate(zip(np.cumsum(n) - n, n)):
                    size = int(size)
                    limit = int(_edits(np.int64(size)))
                    for many in {_asked(size), _asked(int(size / SIMILARITY) + 1)} if size else ():
                        pick = _choices(min(limit + many, size), many)
                        if not len(pick):
                            continue
                        key = np.full(len(pick), np.uint64(many))
                        for j in range(many):
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word[first + pick[:, j]])
                        keys.append(key.view(np.int64))
                        room.append(many + size - 1 - pick[:, -1])
                        at.append(np.full(len(pick), lo + r))
                if not at:
                    continue
                at, keys, room = (np.concatenate(x) for x in (at, keys, room))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest").take(rows), batch.column("component").take(rows), pa.array(keys), pa.array((n - _edits(n))[at - lo]), pa.array(room), pa.array(central[at - lo]),
                     *[batch.column(c).take(rows) for c in carried]],
                    names=["digest", "component", "word", "need", "room", "central", *carried],
                )

    return run


def _fits(shared: DataFrame) -> Column:
    """May two texts ``a`` and ``b`` that share a word be similar, by the overlap that is left and, if carried, by ``_alike``?"""
    fits = F.expr("ca <> cb and least(room_a, room_b) >= greatest(need_a, need_b)")
    return fits & _alike("a", "b") if "bits" in shared.columns else fits


def _word_side(shared: DataFrame, c: str) -> DataFrame:
    names = {"digest": "{}", "component": "c{}", "need": "need_{}", "room": "room_{}", "n_words": "n_{}", "bits": "bits_{}"}
    return shared.select("word", "most", *[F.col(x).alias(y.format(c)) for x, y in names.items() if x in shared.columns])


def _all_pairs(shared: DataFrame) -> DataFrame:
    """All pairs of different components of a word; its largest component never meets itself."""
    left, right = _word_side(shared, "a").where("ca <> most").drop("most"), _word_side(shared, "b")
    return left.join(right, "word").where(_fits(shared) & F.expr("cb = most or a < b"))


def _middle_pairs(shared: DataFrame) -> DataFrame:
    """Every text of a word meets its middle: the word's texts fall into ``MIDDLE`` parts, and each part gives its most central one."""
    row = F.struct("central", *[c for c in shared.columns if c not in ("word", "central")])
    middle = shared.groupBy("word", F.pmod(F.xxhash64("digest"), F.lit(MIDDLE)).alias("part")).agg(F.max(row).alias("row")).select("word", "row.*")
    return _word_side(shared, "a").drop("most").join(_word_side(middle, "b"), "word").where(_fits(shared))


def _overlapping(crowd: DataFrame, docs: DataFrame, reps: DataFrame | None = None, pairs_of: Callable[[DataFrame], DataFrame] = _all_pairs) -> DataFrame:
    """Pairs (a, b) of different components of ``crowd`` (digest, component) whose words may overlap enough for a link: all, or those of ``pairs_of``.

    Similar texts have at least ``longest - limit`` labelled words in common. With the words of every text in one
    common order, their first k common words are among the first ``limit + k`` of each, and after the k-th both have enough
    words left. So every choice of k among these is a key, and similar texts meet in one; k is three for texts of up to 44
    words, two up to 100, then one (``_asked``). The order is by frequency, so a passage that many texts share comes last, and
    texts that have little but the passage in common do not meet; slots that several words share only change the order, not the result.
    With ``reps`` (digest, n_words, bits) the join itself leaves out what ``_alike`` rules out.
    """
    texts = docs.join(sized_broadcast(crowd), "digest")
    slots = texts.select("text").mapInArrow(_slot_batches, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(1 << SLOT_BITS, np.int64)
    frequency[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
    once = texts.groupBy("digest").agg(F.first("component").alias("component"), F.first("text").alias("text"))
    # one row a text meets its bitmap, not one row a key
    carried = {} if reps is None else {"n_words": "long", "bits": "array<long>"}
    once = once if reps is None else once.join(reps.select("digest", *carried), "digest")
    schema = ", ".join(["digest binary, component binary, word long, need long, room long, central double", *[f"{c} {t}" for c, t in carried.items()]])
    words = written(once.mapInArrow(_rare_words(frequency, tuple(carried)), schema), "rare-words")
    sizes = words.groupBy("word", "component").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("word").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    shared = written(words.join(most, "word"), "shared-words")
    found = pairs_of(shared).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = written(found, "crowd-overlaps")
    forget(words, shared)
    return found


def _apart(members: DataFrame, linked: DataFrame, name: str) -> DataFrame:
    """(bucket, digest, component) of the buckets whose members are not yet all in one component."""
    rest = members.join(linked.withColumnRenamed("node", "digest"), "digest", "left").select("bucket", "digest", F.coalesce("component", "digest").alias("component"))
    apart = rest.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    return written(rest.join(apart, "bucket", "left_semi"), name)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, class_id, class_digest) of every row of ``docs``.

    ``class_id`` is the smallest doc_id of the class, ``class_digest`` the digest of that document's text. A null text
    has a null digest and its own doc_id as class.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("digest"))
    named = docs.where("text is not null")
    sketched = written(named.mapInArrow(_sketch_batches, "doc_id long, digest binary, n_words long, keys array<long>, bits array<long>"), "sketches")
    texts = sketched.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    texts = written(texts, "texts")
    reps = texts.where("n_words > 0")
    levels = _bucket_levels(reps)

    pairs = None
    for _, _, shared in levels:
        star = shared.where("digest <> leader").select(F.col("leader").alias("a"), F.col("digest").alias("b"))
        pairs = star if pairs is None else pairs.union(star)
    tested = pairs.distinct()
    links = _links(tested, named, reps, "star")
    linked = components(links, "a", "b")

    rest = None
    for _, _, shared in levels:
        few = shared.where((F.col("n") > 2) & (F.col("n") <= SMALL)).select("bucket", "digest")
        rest = few if rest is None else rest.union(few)
    rest = _apart(rest, linked, "apart")
    left = rest.select("bucket", F.col("digest").alias("a"), F.col("component").alias("ca"))
    right = rest.select("bucket", F.col("digest").alias("b"), F.col("component").alias("cb"))
    others = left.join(right, "bucket").where("a < b and ca <> cb").select("a", "b").distinct()
    if not others.isEmpty():
        links = links.union(_links(others, named, reps, "rest"))
        linked = components(links, "a", "b")

    large = levels[0][2].where(F.col("n") > SMALL).select("bucket", "digest")
    for name, pairs_of in (("middle", _middle_pairs), ("crowd", _all_pairs)):
        crowd = written(_apart(large, linked, name).select("digest", "component").distinct(), f"{name}-texts")
        if crowd.isEmpty():
            break
        others = _overlapping(crowd, named, reps, pairs_of)
        if not others.isEmpty():
            links = links.union(_links(others, named, reps, name))
            linked = components(links, "a", "b")

    classed = texts.select("digest", "first_id").join(linked.withColumnRenamed("node", "digest"), "digest", "left")
    classed = written(classed.withColumn("component", F.coalesce("component", "digest")), "classed")
    heads = classed.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "digest")).alias("head"))
    heads = heads.select("component", F.col("head.first_id").alias("class_id"), F.col("head.digest").alias("class_digest"))
    by_text = classed.select("digest", "component").join(heads, "component").select("digest", "class_id", "class_digest")
    named_rows = sketched.select("doc_id", "digest").join(by_text, "digest").select("doc_id", "digest", "class_id", "class_digest")
    null_rows = docs.where("text is null").select("doc_id", "digest", F.col("doc_id").alias("class_id"), F.col("digest").alias("class_digest"))
    return named_rows.union(null_rows)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each class: the one with the smallest doc_id. Null texts stay.

    Equal texts are folded map-side before any row moves, so copies of one text never meet in a task.
    """
    classes = near_duplicates(docs.select("doc_id", "text"))
    heads = classes.where("digest is not null").select(F.col("class_digest").alias("digest")).distinct()
    cols = docs.columns
    row = F.struct(F.col("doc_id").isNull().alias("_no_id"), F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)])
    one = docs.where("text is not null").groupBy(F.unhex(F.md5("text")).alias("digest")).agg(F.min(row).alias("_row"))
    kept = one.join(heads, "digest", "left_semi").select(*[F.col(f"_row._{i}").alias(c) for i, c in enumerate(cols)])
    return kept.unionByName(docs.where("text is null"))


def op3_order_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    classes = near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_representative"))
