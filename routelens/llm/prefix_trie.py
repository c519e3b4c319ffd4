"""The prefix trie of rebuilt conversations, rolled up in depth bands.

Every conversation ``c`` is rebuilt: the first ``h`` turns of conversation ``c - c % 5``, then its own turns after its first
``h``; ``h`` is the crc32 of the id modulo 9. A node of the trie is a different sequence of first ``d`` turns. Its key is
the xor of two 64-bit hashes of each turn and its place, so the key of a node gives that of its parent, and a long
conversation can be cut in pieces whose keys combine.

Sums over subtrees come from a depth-band rollup. Depths fall into bands of ``BAND``; a node carries the keys of its
ancestors in its band, at most ``BAND``, and its values explode to these only. That completes the sums inside the bands.
The top nodes of the bands form a trie ``BAND`` times as flat, which is summed by the same rule; the finished sum of a band's
top is then sent to its parent, the bottom of the band above, and from there to the ancestors that this node carries.
Rounds grow with the logarithm of the longest conversation, and no row explodes to more than ``BAND``.

Scale. Texts are read once, as digests and lengths. Turns are numbered after a range partitioning by conversation, turn
and digest, so one conversation with a third of all turns is numbered by many tasks. Members of a node meet in combined
group-bys only, and hot nodes (the root, a common first turn) never receive their children by a join: the few nodes with
more than a thousandth of all children are sent to everyone (at most ``HOT`` rows), the others are joined by key.
The ids that end at a node are joined in blocks of ``BLOCK`` neighbouring ids; SHA-256 runs in a stream over the blocks.

Defined cases: null turns come first, equal turns are ordered by the digest of role and text, rows that repeat count each; a null
role or text is empty; rows without a conv_id belong to no conversation; an empty table has no node, not even a root;
conversations without turns (after rebuilding) are members, and ends, of the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelens.llm.tables import bounded_batches, table, written

BAND = 8
CHUNK = 4096
HOT = 1000
BLOCK = 4096
MAX_BORROWED = 8


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the one it continues."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MAX_BORROWED + 1)).cast("int")


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, place, lo, hi, size) of every turn, places from 1, and (conv_id, n)."""
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", half(1).alias("lo"), half(17).alias("hi"), F.octet_length(text).cast("long").alias("size"))
    rows = written(rows, "turns")
    order = ["turn", "lo", "hi", "size"]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "dealt-turns")
    cells = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    # a conversation has at most one row here for each range
    starts = cells.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("start"))
    inside = dealt.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    placed = inside.join(starts, ["conv_id", "part"]).select("conv_id", "part", (F.col("place") + F.col("start")).alias("place"), "lo", "hi", "size")
    return written(placed, "placed-turns"), written(cells.groupBy("conv_id").agg(F.sum("n").alias("n")), "conversations")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, lo, hi, size) of every rebuilt turn, depths from 1, and (conv_id, length)."""
    placed, convs = numbered(turns)
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.withColumn("h", borrowed(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "n", "taken"), "rebuilt-conversations")
    cells = placed.groupBy("conv_id", "part").agg(F.max("place").alias("last")).join(convs.select("conv_id", "h", "taken"), "conv_id")
    cells = cells.where("last > h").drop("last")
    own = placed.join(cells, ["conv_id", "part"]).where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "lo", "hi", "size")
    first = placed.where(F.col("place") <= MAX_BORROWED).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "lo", "hi", "size")
    taken = first.join(convs.select("conv_id", "base", "h"), "base").where("depth <= h").select("conv_id", "depth", "lo", "hi", "size")
    return own.union(taken), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, size) of every node on the way of each conversation, the root included."""
    chunk = F.floor(F.col("depth") / CHUNK)
    turn = turns.withColumn("chunk", chunk).withColumn("a", F.xxhash64("lo", "hi", "depth")).withColumn("b", F.xxhash64("depth", "hi", "lo"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    inside = turn.select("*", F.bit_xor("a").over(upto).alias("xa"), F.bit_xor("b").over(upto).alias("xb"))
    whole = turn.groupBy("conv_id", "chunk").agg(F.bit_xor("a").alias("wa"), F.bit_xor("b").alias("wb"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(w).over(before), F.lit(0)).alias(b) for w, b in (("wa", "ba"), ("wb", "bb"))])
    way = inside.join(base, ["conv_id", "chunk"])
    a, b = F.col("xa").bitwiseXOR(F.col("ba")), F.col("xb").bitwiseXOR(F.col("bb"))
    key, parent = F.struct(a.alias("a"), b.alias("b")), F.struct(a.bitwiseXOR(F.col("a")).alias("a"), b.bitwiseXOR(F.col("b")).alias("b"))
    return way.select("conv_id", F.col("depth").cast("long").alias("depth"), key.alias("key"), parent.alias("parent"), "size")


def _with_ancestors(way: DataFrame, step: int) -> DataFrame:
    """(conv_id, depth, key, up): the keys of the nodes above at depths that ``step`` divides, in the same band, and of the node."""
    here = way.where(F.col("depth") % step == 0)
    band = Window.partitionBy("conv_id", F.floor(F.col("depth") / (step * BAND))).orderBy("depth")
    return here.select("conv_id", "depth", "key", F.collect_list("key").over(band).alias("up"))


def _added(rows: DataFrame, values: list[str]) -> DataFrame:
    return rows.groupBy("key").agg(*[F.sum(v).alias(v) for v in values])


def subtree_sums(nodes: DataFrame, way: DataFrame, values: list[str], deepest: int, step: int = 1) -> DataFrame:
    """(key, values summed over the subtree) of every node of ``nodes`` (key, conv_id, depth, values).

    ``nodes`` has the nodes at depths that ``step`` divides; ``conv_id`` is any member. ``way`` has their ways.
    """
    carried = nodes.join(_with_ancestors(way, step).drop("key"), ["conv_id", "depth"])
    carried = written(carried, "carried")
    inside = _added(carried.select(F.explode("up").alias("key"), *values), values)
    wide = step * BAND
    if deepest < wide:
        return inside
    inside = written(inside, "band-sums")
    tops = nodes.where(F.col("depth") % wide == 0).select("key", "conv_id", "depth").join(inside, "key")
    tops = written(tops, "band-tops")
    done = subtree_sums(tops, way, values, deepest, wide)
    # the finished sum of a band's top goes to the node ``step`` above it, and from there to the ancestors this one carries
    bottom = way.select("conv_id", (F.col("depth") + step).alias("depth"), F.col("key").alias("bottom"))
    sent = tops.where("depth > 0").select("key", "conv_id", "depth").join(done, "key").join(bottom, ["conv_id", "depth"])
    sent = _added(sent.select(F.col("bottom").alias("key"), *values), values)
    below = _added(sent.join(carried.select("key", "up"), "key").select(F.explode("up").alias("key"), *values), values)
    return _added(inside.union(below), values)


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come one after the other; a key never leaves its partition."""
    key, state, out = None, None, []

    def rows() -> pa.RecordBatch:
        done = pa.RecordBatch.from_pylist([{"a": k[0], "b": k[1], "ends_sha256": s.hexdigest()} for k, s in out], schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())]))
        out.clear()
        return done

    for batch in batches:
        for a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "piece"))):
            if (a, b) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((key, state))
                key, state = (a, b), hashlib.sha256()
            state.update(piece.encode())
        if len(out) >= 4096:
            yield rows()
    if key is not None:
        out.append((key, state))
    if out:
        yield rows()


def ends(last: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end, from (key, conv_id)."""
    blocks = last.groupBy("key", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("key", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("piece"))
    blocks = written(blocks, "ends")
    many = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("piece").alias("piece"))
    one = many.where("n = 1").select("key", F.sha2("piece", 256).alias("ends_sha256"))
    rest = blocks.join(many.where("n > 1").select("key"), "key", "left_semi").select("key.a", "key.b", "block", "piece")
    n = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = rest.repartition(n, "a", "b").sortWithinPartitions("a", "b", "block").mapInArrow(_stream_hashes, "a long, b long, ends_sha256 string")
    return one.union(streamed.select(F.struct("a", "b").alias("key"), "ends_sha256"))


def trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    bounded_batches(turns.sparkSession)
    made, convs = rebuilt(turns)
    convs = written(convs, "lengths")
    root = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(None).cast("struct<a:long,b:long>").alias("parent"), F.lit(0).cast("long").alias("size"))
    way = written(paths(made).union(top), "ways")
    nodes = way.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n_convs")
    )
    nodes = written(nodes, "nodes")
    deepest, total = nodes.agg(F.max("depth"), F.count(F.lit(1))).first()
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size"))
    nodes = written(nodes, "valued-nodes")
    sums = subtree_sums(nodes.select("key", "conv_id", "depth", "n_leaves", "saved_tokens"), way, ["n_leaves", "saved_tokens"], deepest or 0)

    crowded = F.col("n_children") > (total or 0) / HOT
    parent = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), crowded.alias("hot"))
    hot = F.broadcast(parent.where("hot").select("parent", F.col("parent_conv_id").alias("hot_conv_id")))  # fewer than HOT rows, by counting
    named = nodes.select("key", "conv_id", "depth", "parent", "n_convs", "n_children").join(hot, "parent", "left")
    named = written(named, "named-nodes")
    cool = named.where("hot_conv_id is null and parent is not null").join(parent.where("not hot").drop("hot"), "parent", "left")
    named = cool.drop("hot_conv_id").unionByName(named.where("hot_conv_id is not null or parent is null").withColumnRenamed("hot_conv_id", "parent_conv_id"))

    last = way.join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select("key", "conv_id")
    full = named.join(sums, "key").join(ends(last), "key", "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared beginning of the rebuilt conversations, with what its subtree holds and saves."""
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), turns AS (
  SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(COALESCE(role, '')), ':', COALESCE(role, ''), COALESCE(text, '')))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), pieces AS (
  SELECT c.conv_id, 0 AS side, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, p) AS depth, text, md5(concat(length(role), ':', role, text)) AS d FROM pieces
), way AS (
  SELECT conv_id, depth, strlen(text) AS size, md5(string_agg(d, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved FROM way GROUP BY ALL
), parents AS (
  SELECT DISTINCT w.key, u.key AS parent FROM way w JOIN way u ON w.conv_id = u.conv_id AND u.depth = w.depth - 1
), children AS (
  SELECT parent AS key, count(*) AS n FROM parents GROUP BY ALL
), pairs AS (
  SELECT DISTINCT u.key AS above, w.key AS key FROM way w JOIN way u ON w.conv_id = u.conv_id AND u.depth <= w.depth
), sums AS (
  SELECT above AS key, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves
  FROM pairs p JOIN nodes n ON p.key = n.key LEFT JOIN children c ON p.key = c.key GROUP BY ALL
), ended AS (
  SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM way QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY ALL
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, COALESCE(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(COALESCE(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN parents p ON n.key = p.key LEFT JOIN nodes u ON p.parent = u.key LEFT JOIN children c ON n.key = c.key JOIN sums s ON n.key = s.key LEFT JOIN ended e ON n.key = e.key
"""
