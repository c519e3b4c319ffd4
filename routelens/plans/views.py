"""Views over the driver tables that every registered query starts from.

``episodes``  one row per (document, variant) with a binary label
``scores``    one row per (episode, verifier)
``pairs``     one row per user turn and the assistant turn that answers it
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.functions.expr import clip, platt
from routelens.functions.hashing import uniform

POOL = ("v_cheap", "v_mid", "v_high")

# Fixed values of the synthetic verifiers: informativeness, base ms, ms per character, and the
# calibration (intercept, slope) that stands in for a fitted one in SQL-checked queries.
VERIFIERS = {
    "v_cheap": (0.30, 20.0, 0.001, 0.05, 0.6),
    "v_mid": (0.55, 60.0, 0.004, 0.0, 0.8),
    "v_high": (0.80, 250.0, 0.010, -0.05, 1.1),
}

# A wider bank for pool screens: the pool's verifiers and six more.
BANK = {
    **VERIFIERS,
    "v_fast": (0.20, 8.0, 0.0005, 0.0, 0.5),
    "v_rule": (0.25, 12.0, 0.002, 0.1, 0.5),
    "v_nli": (0.45, 40.0, 0.002, 0.02, 0.7),
    "v_span": (0.60, 120.0, 0.001, 0.0, 0.9),
    "v_judge": (0.90, 400.0, 0.020, -0.1, 1.2),
    "v_slow": (0.70, 600.0, 0.050, 0.0, 1.0),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for CPU-heavy text work: a scan with fewer splits than cores is spread out first.

    Large inputs arrive with enough splits and are left alone, so they pay no shuffle.
    """
    df = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def episodes(spark: SparkSession, sf: str, text: bool = False) -> DataFrame:
    """Labelled documents times three candidate variants."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    key = F.sha2(F.lower(F.trim("text")), 256)
    base = docs.select(
        "doc_id", F.col("lang").alias("dataset_key"), F.col("source").alias("generator_id"), "n_chars",
        key.alias("content_doc_key"), *(["text"] if text else []),
    ).join(labels.select("doc_id", "quality", "toxic"), "doc_id")
    out = base.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    doc = F.col("doc_id").cast("string")
    k = F.col("k").cast("string")
    return out.select(
        F.concat_ws("::", F.lit("doc"), doc, k).alias("episode_key"),
        "doc_id", "k", "dataset_key", "generator_id", "content_doc_key", "n_chars", "quality", "toxic",
        F.when(uniform("label", doc, k) < F.lit(0.2) + F.lit(0.6) * F.col("quality"), 1).otherwise(0)
        .alias("label_supported"),
        F.when(uniform("role", F.col("content_doc_key")) < 0.6, F.lit("train")).otherwise(F.lit("test"))
        .alias("role"),
        (F.lit(1.0) + F.col("n_chars") * F.lit(0.0005)).alias("feature_latency_ms"),
        *(["text"] if text else []),
    )


def scores(spark: SparkSession, sf: str, verifiers: dict = VERIFIERS) -> DataFrame:
    """Long score table with the calibrated probability attached."""
    e = episodes(spark, sf)
    rows = [
        F.struct(
            F.lit(v).alias("verifier"), F.lit(s).alias("s"), F.lit(b).alias("b"), F.lit(c).alias("c"),
            F.lit(a0).alias("a0"), F.lit(a1).alias("a1"),
        )
        for v, (s, b, c, a0, a1) in verifiers.items()
    ]
    x = e.withColumn("v", F.explode(F.array(*rows)))
    key, v = F.col("episode_key"), F.col("v.verifier")
    raw = F.lit(0.5) + F.col("v.s") * (F.col("label_supported") - F.lit(0.5)) + F.lit(0.9) * (
        uniform("score", key, v) - F.lit(0.5)
    )
    return x.select(
        "episode_key", "dataset_key", "generator_id", "content_doc_key", "role", "label_supported",
        "feature_latency_ms", "n_chars", v.alias("verifier"),
        F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)).alias("score"),
        (uniform("avail", key, v) >= 0.02).alias("available"),
        (F.col("v.b") + F.col("v.c") * F.col("n_chars")).alias("latency_ms"),
        F.col("v.a0").alias("a0"), F.col("v.a1").alias("a1"),
    ).withColumn("cal", platt(F.col("score"), F.col("a0"), F.col("a1"))).drop("a0", "a1")


def long_to_wide(long: DataFrame, ids, fields, pool=POOL) -> DataFrame:
    """One row per episode with ``field__verifier`` columns (single shuffle on the key)."""
    aggs = [
        F.max(F.when(F.col("verifier") == v, F.col(f))).alias(f"{f}__{v}") for v in pool for f in fields
    ]
    return long.groupBy(*ids).agg(*aggs)


IDS = ("episode_key", "dataset_key", "content_doc_key", "role", "label_supported", "feature_latency_ms")


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """The score matrix."""
    return long_to_wide(scores(spark, sf), IDS, ("score", "available", "latency_ms", "cal"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive user -> assistant turns: source = user text, summary = assistant text."""
    c = text_table(spark, sf, "conversations")
    user = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("source"))
    reply = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("summary")
    )
    return user.join(reply, ["conv_id", "turn"]).select(
        F.concat_ws("::", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("pair_id"),
        F.sha2(F.col("source"), 256).alias("doc_key"), "source", "summary", "conv_id", "turn",
    )


# ---------------------------------------------------------------------------------- SQL side

def u_sql(*parts: str) -> str:
    """SQL uniform over already-rendered string expressions."""
    joined = "||'|'||".join(parts)
    return f"(('0x'||substr(sha256({joined}),1,8))::bigint/4294967296.0::double)"


EPISODES_SQL = f"""episodes AS (
 SELECT 'doc::'||d.doc_id||'::'||v.k AS episode_key, d.doc_id, v.k, d.lang AS dataset_key, d.source AS generator_id,
  sha256(lower(trim(d.text))) AS content_doc_key, d.n_chars, l.quality, l.toxic, d.text,
  CASE WHEN {u_sql("'label'", "d.doc_id", "v.k")} < 0.2::double+0.6::double*l.quality THEN 1 ELSE 0 END AS label_supported,
  CASE WHEN {u_sql("'role'", "sha256(lower(trim(d.text)))")} < 0.6::double THEN 'train' ELSE 'test' END AS role,
  1.0::double + d.n_chars*0.0005::double AS feature_latency_ms
 FROM documents d JOIN labels l ON d.doc_id=l.doc_id, (VALUES (0),(1),(2)) v(k))"""

def scores_sql(verifiers: dict) -> str:
    values = ",".join(f"('{v}',{s}::double,{b}::double,{c}::double,{a0}::double,{a1}::double)" for v, (s, b, c, a0, a1) in verifiers.items())
    raw = f"0.5::double+vp.s*(e.label_supported-0.5::double)+0.9::double*({u_sql(chr(39)+'score'+chr(39), 'e.episode_key', 'vp.verifier')}-0.5::double)"
    return f"""scores0 AS (
 SELECT e.*, vp.verifier, least(greatest({raw},0.0::double),1.0::double) AS score,
  {u_sql("'avail'", "e.episode_key", "vp.verifier")} >= 0.02::double AS available,
  vp.b + vp.c*e.n_chars AS latency_ms, vp.a0, vp.a1
 FROM episodes e, (VALUES {values}) vp(verifier,s,b,c,a0,a1)),
scores AS (SELECT *, 1.0::double/(1.0::double+exp(-(a0+a1*ln(least(greatest(score,1e-6::double),1-1e-6::double)/(1.0::double-least(greatest(score,1e-6::double),1-1e-6::double)))))) AS cal FROM scores0)"""


SCORES_SQL = scores_sql(VERIFIERS)

WIDE_SQL = "wide AS (SELECT episode_key, dataset_key, content_doc_key, role, label_supported, feature_latency_ms, " + ", ".join(
    f"max(score) FILTER (verifier='{v}') AS s{i}, bool_or(available) FILTER (verifier='{v}') AS a{i}, "
    f"max(latency_ms) FILTER (verifier='{v}') AS l{i}, max(cal) FILTER (verifier='{v}') AS c{i}"
    for i, v in enumerate(POOL)
) + " FROM scores GROUP BY ALL)"

PAIRS_SQL = """pairs AS (
 SELECT 'conv::'||u.conv_id||'::'||u.turn AS pair_id, sha256(u.text) AS doc_key, u.text AS source, r.text AS summary, u.conv_id, u.turn
 FROM conversations u JOIN conversations r ON u.conv_id=r.conv_id AND r.turn=u.turn+1
 WHERE u.role='user' AND r.role='assistant')"""


def with_sql(body: str, *views: str) -> str:
    """Prefix a query with the views it reads."""
    parts = {"episodes": EPISODES_SQL, "scores": SCORES_SQL, "wide": WIDE_SQL, "pairs": PAIRS_SQL}
    order = ["episodes", "scores", "wide", "pairs"]
    need = set(views)
    if "wide" in need:
        need |= {"scores"}
    if "scores" in need:
        need |= {"episodes"}
    heads = [parts[v] for v in order if v in need]
    extra = [v for v in views if v not in parts]
    return "WITH " + ",\n".join(heads + extra) + "\n" + body
