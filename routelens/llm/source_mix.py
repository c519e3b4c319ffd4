"""Mixing sources to target weights, in DataFrame operations only.

Tokens are added up by source; a source's target is its weight's share of ``SHARE`` times all tokens, but at most
``MOST`` times its own tokens, the excess going to the others by weight until none is above its limit. The repetition
rate is target / tokens; a document is emitted floor(rate) times, plus one copy with probability equal to the
fraction, decided by a hash of its doc_id, so reruns agree and no document is emitted more than ``MOST`` times.

The only shuffle is the sum by source, combined before it moves, so a source with a third of all rows is a few partial
sums. The table of sources has one row each; it is joined back by its (checked) small size or by Spark's own choice.

Filling up to the limits needs no loop: in order of limit / weight the sources that reach their limit come first, so
running sums over the table of sources give the common level of the others.

Defined cases: a null text has size 0; the null source is a source of its own and sorts last; a source without tokens
has target 0; without tokens every target and copy count is 0; a null doc_id hashes as the empty text; a repeated
doc_id gets the same decision each time; extra columns stay (``mixed``) or are ignored (the query).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelens.llm.tables import sized_broadcast, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """Number of runs of characters other than the space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size) rows."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sources.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1))
    ranked = ranked.withColumn("limit", MOST * F.col("source_size"))
    first = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, everyone = first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ranked.withColumn("filled", F.coalesce(F.sum("limit").over(before), F.lit(0)))
    level = level.withColumn("open_weight", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = level.withColumn("level", (F.lit(SHARE) * F.sum("source_size").over(everyone) - F.col("filled")) / F.col("open_weight"))
    # the level at the first source that stays below its limit holds for all that follow
    level = level.withColumn("common", F.min(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct("filled", "level"))).over(everyone))
    target = F.when(F.col("common").isNull() | (F.col("filled") < F.col("common.filled")), F.col("limit").cast("double"))
    target = target.otherwise(F.least(F.col("common.level") * F.col("weight"), F.col("limit").cast("double")))
    return level.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a hash of the seed and the id: the first 32 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with _size, _source_size, _target and _copies."""
    sized = docs.select(*keep, F.col("source").alias("_source"), F.col("doc_id").alias("_doc_id"), size_of(F.col("text")).alias("_size"))
    totals = source_targets(docs.select("source", size_of(F.col("text")).alias("size")))
    totals = totals.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    both = sized.join(sized_broadcast(totals, 100_000), F.col("_source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(uniform(F.col("_doc_id")) < rate - F.floor(rate), 1).otherwise(0)
    return both.withColumn("_copies", copies.cast("long")).drop("_s", "_source", "_doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; its columns may have any names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", "text")
    copies = with_copies(packed, ["_row"])
    return copies.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    copies = with_copies(table(spark, sf_dir, "documents"), ["doc_id"])
    return copies.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), ordered AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source IS NULL, encode(source)) AS place FROM ranked
), level AS (
  SELECT a.*, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE - COALESCE((SELECT sum(b.cap) FROM ordered b WHERE b.place < a.place), 0)::DOUBLE)
    / (SELECT sum(b.weight) FROM ordered b WHERE b.place >= a.place)::DOUBLE AS level FROM ordered a
), common AS (
  SELECT min(place) AS place FROM level WHERE level * weight < cap
), targets AS (
  SELECT source, source_size, CASE WHEN common.place IS NULL OR l.place < common.place THEN cap::DOUBLE
    ELSE least((SELECT level FROM level x WHERE x.place = common.place) * weight, cap::DOUBLE) END AS target FROM level l, common
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1:' || COALESCE(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
