"""Projections, contracts, joins, splits and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelens.functions import text as X
from routelens.functions.hashing import hash32, stable_seed, uniform
from routelens.operators import contracts as C
from routelens.operators import joins as J
from routelens.operators import splits as S
from routelens.plans.metric_queries import rounded
from routelens.plans.registry import query
from routelens.plans.views import IDS, POOL, episodes, long_to_wide, pairs, scores, table, u_sql, with_sql

Q = "'"


def lit(s: str) -> str:
    return f"'{s}'"


# ------------------------------------------------------------------------------ projections

COMMON = T.StructType([
    T.StructField("episode_key", T.StringType()), T.StructField("dataset_key", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("content_doc_key", T.StringType()),
    T.StructField("label_supported", T.IntegerType()), T.StructField("num_sentences", T.LongType()),
    T.StructField("summary_model", T.StringType()),
])


def corpora(d) -> list:
    """The corpora that occur (null last); they are a handful of names."""
    return sorted((r[0] for r in d.select("dataset_key").distinct().collect()), key=lambda c: (c is None, c or ""))


@query("conform_common_schema", "P1", with_sql("""
SELECT episode_key, dataset_key, role, content_doc_key, label_supported, NULL::bigint AS num_sentences, NULL::varchar AS summary_model FROM episodes""", "episodes"))
def conform_common_schema(spark, sf):
    return C.conform(episodes(spark, sf), COMMON)


@query("label_free_projection", "P2", with_sql("""
SELECT episode_key, doc_id, k, dataset_key, generator_id, content_doc_key, n_chars, role, round(feature_latency_ms,6) AS feature_latency_ms FROM episodes""", "episodes"))
def label_free_projection(spark, sf):
    e = C.label_free(episodes(spark, sf)).drop("toxic")
    return rounded(e).withColumn("k", F.col("k").cast("int"))


@query("scoring_frame_contract", "P3 P18", with_sql("""
SELECT count(*) AS rows, count(*) FILTER (episode_key IS NULL) AS key_missing, count(*) FILTER (score IS NULL OR score<0 OR score>1) AS score_range,
 count(*) FILTER (available AND latency_ms IS NULL) AS available_without_latency, count(*) FILTER (role NOT IN ('train','test')) AS bad_role,
 count(*) FILTER (abs(latency_ms+feature_latency_ms-(feature_latency_ms+latency_ms))>1e-6) AS not_additive,
 count(*)-count(DISTINCT episode_key||verifier) AS duplicates, sum(CASE WHEN n_av=0 THEN 1 ELSE 0 END)::bigint AS rows_of_uncovered_episodes
FROM (SELECT *, count(*) FILTER (available) OVER (PARTITION BY episode_key) AS n_av FROM scores)""", "scores"))
def scoring_frame_contract(spark, sf):
    s = scores(spark, sf)
    per = s.groupBy("episode_key", "verifier").agg(
        F.count("*").alias("copies"), F.count_if("available").alias("n_av"),
        F.count_if(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1)).alias("score_range"),
        F.count_if(F.col("available") & F.col("latency_ms").isNull()).alias("nolat"),
        F.count_if(~F.col("role").isin("train", "test")).alias("bad_role"),
        F.count_if(F.abs(F.col("latency_ms") + F.col("feature_latency_ms") - (F.col("feature_latency_ms") + F.col("latency_ms"))) > 1e-6).alias("nadd"))
    ep = per.groupBy("episode_key").agg(
        F.sum("copies").alias("n"), F.sum(F.col("copies") - 1).alias("dup"), F.sum("n_av").alias("n_av"),
        F.sum("score_range").alias("score_range"), F.sum("nolat").alias("nolat"), F.sum("bad_role").alias("bad_role"), F.sum("nadd").alias("nadd"))
    return ep.agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("episode_key").isNull(), F.col("n")).otherwise(0)).alias("key_missing"),
        F.sum("score_range").alias("score_range"), F.sum("nolat").alias("available_without_latency"), F.sum("bad_role").alias("bad_role"),
        F.sum("nadd").alias("not_additive"), F.sum("dup").alias("duplicates"),
        F.sum(F.when(F.col("n_av") == 0, F.col("n")).otherwise(0)).alias("rows_of_uncovered_episodes"))


@query("gold_free_counts", "P4 T12", with_sql("""
SELECT pair_id, length(source) AS source_chars, length(summary) AS summary_chars,
 len(string_split_regex(trim(source,' \t\n\r\f'),'\\s+')) AS source_words, len(string_split_regex(trim(summary,' \t\n\r\f'),'\\s+')) AS summary_words FROM pairs""", "pairs"))
def gold_free_counts(spark, sf):
    p = pairs(spark, sf)
    n = lambda c: F.size(F.split(X.strip(F.col(c)), r"\s+")).cast("bigint")
    return p.select("pair_id", F.length("source").cast("bigint").alias("source_chars"), F.length("summary").cast("bigint").alias("summary_chars"),
                    n("source").alias("source_words"), n("summary").alias("summary_words"))


@query("rows_missing_a_score", "P5", with_sql("""
SELECT episode_key, count(*) FILTER (NOT available) AS missing, string_agg(verifier, ',' ORDER BY verifier) FILTER (NOT available) AS which
FROM scores GROUP BY episode_key HAVING count(*) FILTER (NOT available)>0""", "scores"))
def rows_missing_a_score(spark, sf):
    miss = scores(spark, sf).filter(~F.col("available"))
    return miss.groupBy("episode_key").agg(F.count("*").alias("missing"), F.array_join(F.array_sort(F.collect_set("verifier")), ",").alias("which"))


@query("token_fill", "P6", with_sql("""
SELECT pair_id, st AS summary_tokens, st+ct AS semantic_tokens FROM (SELECT pair_id, len(regexp_extract_all(lower(summary),'[a-z0-9'']+')) AS st,
 len(regexp_extract_all(lower(source),'[a-z0-9'']+')) AS ct FROM pairs)""", "pairs"))
def token_fill(spark, sf):
    p = pairs(spark, sf)
    st, ct = F.size(X.tokens(F.col("summary"))), F.size(X.tokens(F.col("source")))
    return p.select("pair_id", st.cast("bigint").alias("summary_tokens"), (st + ct).cast("bigint").alias("semantic_tokens"))


@query("declared_exclusion", "P7", with_sql("""
SELECT dataset_key, count(*) AS rows, count(*) FILTER (tox) AS excluded, count(*) FILTER (NOT tox) AS kept FROM (
 SELECT dataset_key, content_doc_key IN (SELECT content_doc_key FROM episodes WHERE toxic=1) AS tox FROM episodes) GROUP BY 1""", "episodes"))
def declared_exclusion(spark, sf):
    e = episodes(spark, sf)
    listed = e.filter("toxic = 1").select("content_doc_key").distinct().withColumn("listed", F.lit(True))
    x = e.join(listed, "content_doc_key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return x.groupBy("dataset_key").agg(F.count("*").alias("rows"), F.count_if("listed").alias("excluded"), F.count_if(~F.col("listed")).alias("kept"))


@query("split_override_by_mode", "P8", with_sql("""
SELECT episode_key, mode_split, CASE WHEN dataset_key='en' AND mode_split<>generator_id THEN 'en_moved' ELSE dataset_key END AS corpus,
 CASE WHEN role='train' THEN 'train' ELSE 'test' END AS side FROM episodes JOIN m USING (content_doc_key)""", "episodes", """m AS (SELECT content_doc_key, g AS mode_split FROM (SELECT content_doc_key, generator_id AS g, count(*) AS n FROM episodes GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY content_doc_key ORDER BY n DESC, g)=1)"""))
def split_override_by_mode(spark, sf):
    e = episodes(spark, sf)
    tally = e.groupBy("content_doc_key", "generator_id").agg(F.count("*").alias("n"))
    mode = tally.groupBy("content_doc_key").agg(F.min_by("generator_id", F.struct(-F.col("n"), F.col("generator_id"))).alias("mode_split"))
    moved = (F.col("dataset_key") == "en") & (F.col("mode_split") != F.col("generator_id"))
    return e.join(mode, "content_doc_key").select(
        "episode_key", "mode_split", F.when(moved, "en_moved").otherwise(F.col("dataset_key")).alias("corpus"), F.col("role").alias("side"))


@query("parse_episode_ids", "P9 S5", with_sql("""
SELECT episode_key, regexp_extract(episode_key,'^([a-z]+)::',1) AS prefix, regexp_extract(episode_key,'::(\\d+)::',1)::bigint AS doc, regexp_extract(episode_key,'(\\d+)$',1)::int AS variant
FROM episodes""", "episodes"))
def parse_episode_ids(spark, sf):
    k = F.col("episode_key")
    return episodes(spark, sf).select(
        "episode_key", F.regexp_extract(k, r"^([a-z]+)::", 1).alias("prefix"),
        F.regexp_extract(k, r"::(\d+)::", 1).cast("bigint").alias("doc"), F.regexp_extract(k, r"(\d+)$", 1).cast("int").alias("variant"))


@query("summary_label_conjunction", "P10", with_sql("""
SELECT doc_id, bool_and(label_supported=1) AS all_supported, CASE WHEN bool_and(label_supported=1) THEN 'Correct' ELSE 'Incorrect' END AS verdict, count(*) AS parts
FROM episodes GROUP BY doc_id""", "episodes"))
def summary_label_conjunction(spark, sf):
    g = episodes(spark, sf).groupBy("doc_id").agg(F.bool_and(F.col("label_supported") == 1).alias("all_supported"), F.count("*").alias("parts"))
    return g.withColumn("verdict", F.when(F.col("all_supported"), "Correct").otherwise("Incorrect"))


@query("edit_label", "P11", with_sql("""
SELECT pair_id, CASE WHEN a=b THEN 'SUPPORTED' WHEN b='' THEN 'DELETE' ELSE 'EDIT' END AS edit_label FROM (
 SELECT pair_id, regexp_replace(trim(lower(summary),' \t\n\r\f'),'\\s+',' ','g') AS a,
  regexp_replace(trim(lower(CASE WHEN turn%3=0 THEN summary||' ' WHEN turn%3=1 THEN '' ELSE replace(summary,'.','!') END),' \t\n\r\f'),'\\s+',' ','g') AS b FROM pairs)""", "pairs"))
def edit_label(spark, sf):
    norm = lambda c: F.regexp_replace(X.strip(F.lower(c)), r"\s+", " ")
    s = F.col("summary")
    edited = F.when(F.col("turn") % 3 == 0, F.concat(s, F.lit(" "))).when(F.col("turn") % 3 == 1, F.lit("")).otherwise(F.replace(s, F.lit("."), F.lit("!")))
    a, b = norm(s), norm(edited)
    return pairs(spark, sf).select("pair_id", F.when(a == b, "SUPPORTED").when(b == "", "DELETE").otherwise("EDIT").alias("edit_label"))


@query("normalized_content_keys", "P12", """
SELECT doc_id, sha256(regexp_replace(trim(replace(lower(text),'ß','ss'),' \t\n\r\f'),'\\s+',' ','g')) AS content_key FROM documents""")
def normalized_content_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalized_key(F.col("text")).alias("content_key"))


@query("availability_and_decision", "P13", with_sql("""
SELECT episode_key, verifier, available AND score IS NOT NULL AS usable, CASE WHEN coalesce(score,0.5::double)>=0.5::double THEN 1 ELSE 0 END AS decision FROM scores""", "scores"))
def availability_and_decision(spark, sf):
    return scores(spark, sf).select("episode_key", "verifier", (F.col("available") & F.col("score").isNotNull()).alias("usable"),
                                    (F.coalesce("score", F.lit(0.5)) >= 0.5).cast("int").alias("decision"))


@query("finite_feature_columns", "P14")
def finite_feature_columns(spark, sf):
    e = episodes(spark, sf)
    names = C.numeric_features(e, skip_prefixes=("label_",), skip=("doc_id", "k"))
    return e.agg(*[F.avg(c).alias(c) for c in names]).unpivot([], names, "feature", "mean")


@query("corpus_one_hot", "P15", with_sql("""
SELECT episode_key, string_agg((dataset_key IS NOT DISTINCT FROM c)::int::varchar, '' ORDER BY c NULLS LAST) AS hot, 1.0::double AS constant FROM episodes, (SELECT DISTINCT dataset_key AS c FROM episodes) GROUP BY episode_key""", "episodes"))
def corpus_one_hot(spark, sf):
    """One digit per corpus that occurs, in the order of their names."""
    e = episodes(spark, sf)
    head = F.substring_index("dataset_key", "_", 1)
    return e.select("episode_key", F.concat(*[head.eqNullSafe(c).cast("int").cast("string") for c in corpora(e)]).alias("hot"), F.lit(1.0).alias("constant"))


@query("native_aux_columns", "P16", """
SELECT event_id, (props::json->>'k')::bigint AS k, event_type AS native_label, CASE WHEN (props::json->>'k')::bigint>=50 THEN true ELSE false END AS available FROM events""")
def native_aux_columns(spark, sf):
    e = table(spark, sf, "events")
    aux = F.from_json("props", "k BIGINT")
    return e.select("event_id", aux["k"].alias("k"), F.col("event_type").alias("native_label"), (aux["k"] >= 50).alias("available"))


@query("contamination_flags", "P20", with_sql("""
SELECT verifier, dataset_key, CASE WHEN (verifier='v_cheap' AND dataset_key='de') OR (verifier='v_mid' AND dataset_key='en') THEN 'CONFIRMED_TRAIN'
 WHEN verifier='v_high' THEN 'DEV_EXPOSED' ELSE 'clean' END AS flag, count(*) AS n_rows FROM scores GROUP BY ALL""", "scores"))
def contamination_flags(spark, sf):
    v, d = F.col("verifier"), F.col("dataset_key")
    flag = F.when(((v == "v_cheap") & (d == "de")) | ((v == "v_mid") & (d == "en")), "CONFIRMED_TRAIN").when(v == "v_high", "DEV_EXPOSED").otherwise("clean")
    return scores(spark, sf).groupBy("verifier", "dataset_key").agg(F.count("*").alias("n_rows")).withColumn("flag", flag)


@query("ledger_rule_breaks", "P21", with_sql("""
SELECT dataset_key, generator_id, v AS violation FROM led, (VALUES ('sealed_but_touched'),('burned_but_headline')) t(v)
WHERE (v='sealed_but_touched' AND status='sealed' AND touches>0) OR (v='burned_but_headline' AND status='burned' AND headline)""", "episodes", """led AS (SELECT dataset_key, generator_id, count(*) AS touches, CASE WHEN count(*)%3=0 THEN 'sealed' WHEN count(*)%2=0 THEN 'burned' ELSE 'open' END AS status, avg(quality)>0.8::double AS headline FROM episodes GROUP BY ALL)"""))
def ledger_rule_breaks(spark, sf):
    led = episodes(spark, sf).groupBy("dataset_key", "generator_id").agg(F.count("*").alias("touches"), (F.avg("quality") > 0.8).alias("headline"))
    led = led.withColumn("status", F.when(F.col("touches") % 3 == 0, "sealed").when(F.col("touches") % 2 == 0, "burned").otherwise("open"))
    return C.ledger_violations(led).select("dataset_key", "generator_id", "violation")


@query("count_contract", "P19 J10", with_sql("""
SELECT dataset_key, o.n_rows, o.groups, e.n_rows AS expected_n_rows, e.groups AS expected_groups, coalesce(o.n_rows=e.n_rows AND o.groups=e.groups, false) AS matches
FROM (SELECT dataset_key, count(*) AS n_rows, count(DISTINCT content_doc_key) AS groups FROM episodes GROUP BY 1) o
FULL JOIN (SELECT lang AS dataset_key, 3*count(*) AS n_rows, count(DISTINCT sha256(text)) AS groups FROM documents JOIN labels USING (doc_id) GROUP BY 1) e USING (dataset_key)""", "episodes"))
def count_contract(spark, sf):
    o = episodes(spark, sf).groupBy("dataset_key").agg(F.count("*").alias("n_rows"), F.countDistinct("content_doc_key").alias("groups"))
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy(F.col("lang").alias("dataset_key")).agg(
        (3 * F.count("*")).alias("n_rows"), F.countDistinct(F.sha2("text", 256)).alias("groups"))
    return C.count_contract(o, d, ["dataset_key"], ["n_rows", "groups"])


# ------------------------------------------------------------------------------ joins

@query("one_to_one_join_audit", "J1 J5 U3", with_sql("""
SELECT sum(l)::bigint AS left_rows, sum(r)::bigint AS right_rows, count(*) FILTER (l>0 AND r>0) AS matched_keys, count(*) FILTER (r=0) AS left_only, count(*) FILTER (l=0) AS right_only,
 count(*) FILTER (l>1) AS left_duplicated, count(*) FILTER (r>1) AS right_duplicated FROM (
 SELECT coalesce(l,0) AS l, coalesce(r,0) AS r FROM (SELECT doc_id, count(*) AS l FROM documents GROUP BY 1) a FULL JOIN (SELECT doc_id, count(*) AS r FROM labels GROUP BY 1) b USING (doc_id))""", "episodes"))
def one_to_one_join_audit(spark, sf):
    return J.join_audit(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), ["doc_id"])


@query("score_overlay", "J2", with_sql(f"""
SELECT episode_key, verifier, round(coalesce(CASE WHEN {u_sql(lit('over'), 'episode_key', 'verifier')}<0.3::double THEN round(score*0.5::double,6) END, score),6) AS score FROM scores""", "scores"))
def score_overlay(spark, sf):
    s = scores(spark, sf).select("episode_key", "verifier", "score")
    fresh = s.select("episode_key", "verifier", F.when(uniform("over", F.col("episode_key"), F.col("verifier")) < 0.3, F.round(F.col("score") * 0.5, 6)).alias("score"))
    fresh = fresh.unionByName(fresh).withColumn("ord", F.lit(1))
    fresh = J.one_per_key(fresh, ["episode_key", "verifier"], F.col("ord")).drop("ord")
    return rounded(J.overlay(s, fresh, ["episode_key", "verifier"], ["score"]))


@query("gated_label_join", "J3 J4", with_sql("""
SELECT s.episode_key, s.verifier, e.label_supported, e.generator_id FROM scores s LEFT JOIN episodes e USING (episode_key)""", "scores"))
def gated_label_join(spark, sf):
    gold = episodes(spark, sf).select("episode_key", "label_supported", "generator_id")
    free = C.label_free(scores(spark, sf)).select("episode_key", "verifier")
    return free.join(gold, "episode_key", "left")


@query("cross_corpus_overlap", "J6 U2", with_sql("""
SELECT a.dataset_key AS corpus_a, b.dataset_key AS corpus_b, count(*) AS shared FROM (SELECT DISTINCT generator_id AS dataset_key, content_doc_key FROM episodes) a
JOIN (SELECT DISTINCT generator_id AS dataset_key, content_doc_key FROM episodes) b ON a.content_doc_key=b.content_doc_key AND a.dataset_key<b.dataset_key GROUP BY ALL""", "episodes"))
def cross_corpus_overlap(spark, sf):
    return J.shared_content_pairs(episodes(spark, sf), "content_doc_key", "generator_id")


@query("pending_scores", "J7 U3", with_sql(f"""
SELECT episode_key, verifier FROM scores WHERE NOT ({u_sql(lit('cached'), 'episode_key', 'verifier')}<0.7::double)""", "scores"))
def pending_scores(spark, sf):
    s = scores(spark, sf).select("episode_key", "verifier")
    cached = s.filter(uniform("cached", F.col("episode_key"), F.col("verifier")) < 0.7)
    return s.join(cached, ["episode_key", "verifier"], "left_anti")


@query("treatment_vs_control", "J9", with_sql("""
SELECT count(*) AS shared, round(max(abs(d)),6) AS max_abs_delta, round(avg(d),6) AS mean_delta, round(corr(a,b),6) AS correlation, bool_and(d=0) AS identical FROM (
 SELECT x.score AS a, y.score AS b, x.score-y.score AS d FROM scores x JOIN scores y USING (episode_key) WHERE x.verifier='v_mid' AND y.verifier='v_high')""", "scores"))
def treatment_vs_control(spark, sf):
    s = scores(spark, sf)
    return rounded(J.compare_runs(s.filter("verifier='v_mid'"), s.filter("verifier='v_high'"), ["episode_key"], "score"))


@query("reuse_id_and_hash_check", "J10", """
SELECT count(*) FILTER (a IS NULL OR b IS NULL) AS id_mismatch, count(*) FILTER (a<>b) AS hash_mismatch, count(*) AS ids FROM (
 SELECT doc_id, sha256(text) AS a, sha256(trim(text)) AS b FROM documents)""")
def reuse_id_and_hash_check(spark, sf):
    d = table(spark, sf, "documents")
    a = d.select("doc_id", F.sha2("text", 256).alias("a"))
    b = d.select("doc_id", F.sha2(F.trim("text"), 256).alias("b"))
    j = a.join(b, "doc_id", "full_outer")
    return j.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("id_mismatch"), F.count_if(F.col("a") != F.col("b")).alias("hash_mismatch"), F.count("*").alias("ids"))


@query("score_matrix_pivot", "J11", with_sql("SELECT episode_key, " + ", ".join(
    f"round(max(score) FILTER (verifier='{v}'),6) AS score__{v}, bool_or(available) FILTER (verifier='{v}') AS available__{v}, round(max(latency_ms) FILTER (verifier='{v}'),6) AS latency_ms__{v}" for v in POOL)
    + " FROM scores GROUP BY episode_key", "scores"))
def score_matrix_pivot(spark, sf):
    return rounded(long_to_wide(scores(spark, sf), ["episode_key"], ["score", "available", "latency_ms"]))


@query("four_way_comparison", "J12 J13", with_sql("""
SELECT dataset_key, a.m AS cheap, b.m AS mid, c.m AS high, e.r AS base_rate FROM
 (SELECT dataset_key, round(avg(score),6) AS m FROM scores WHERE verifier='v_cheap' GROUP BY 1) a JOIN (SELECT dataset_key, round(avg(score),6) AS m FROM scores WHERE verifier='v_mid' GROUP BY 1) b USING (dataset_key)
 JOIN (SELECT dataset_key, round(avg(score),6) AS m FROM scores WHERE verifier='v_high' GROUP BY 1) c USING (dataset_key) JOIN (SELECT dataset_key, round(avg(label_supported::double),6) AS r FROM episodes GROUP BY 1) e USING (dataset_key)""", "scores"))
def four_way_comparison(spark, sf):
    s = scores(spark, sf)
    per = s.groupBy("dataset_key").agg(*[F.avg(F.when(F.col("verifier") == v, F.col("score"))).alias(v[2:]) for v in POOL])
    base = episodes(spark, sf).groupBy("dataset_key").agg(F.avg(F.col("label_supported").cast("double")).alias("base_rate"))
    return rounded(per.join(base, "dataset_key"))


@query("configuration_grid", "J14", with_sql("""
SELECT dataset_key, method, beta, seed, fold, n FROM (SELECT dataset_key, count(*) AS n FROM episodes GROUP BY 1), (VALUES ('LR'),('GBT')) m(method), (VALUES (0.0::double),(0.4::double),(1.6::double)) b(beta), (VALUES (7),(17)) s(seed), range(5) f(fold)""", "episodes"))
def configuration_grid(spark, sf):
    n = episodes(spark, sf).groupBy("dataset_key").agg(F.count("*").alias("n"))
    arr = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    g = n.withColumn("method", arr(["LR", "GBT"])).withColumn("beta", arr([0.0, 0.4, 1.6])).withColumn("seed", arr([7, 17]))
    return g.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("fold", F.col("fold").cast("bigint"))


# ------------------------------------------------------------------------------ splits

_STRATA = "strata AS (SELECT content_doc_key AS g, min(dataset_key) AS d, round_even(avg(label_supported::double),0)::int AS y FROM episodes GROUP BY 1)"


def _pos(tag: str, seed: int, part: str) -> str:
    return f"row_number() OVER (PARTITION BY {part} ORDER BY {u_sql(lit(tag), lit(str(seed)), 'g')}, g)-1"


@query("stratified_group_holdout", "F1", with_sql(f"""
SELECT g AS content_doc_key, idx < greatest(round_even(n*0.2::double,0),1) AS held FROM (SELECT g, {_pos('split', 17, 'd, y')} AS idx, count(*) OVER (PARTITION BY d, y) AS n FROM strata)""", "episodes", _STRATA))
def stratified_group_holdout(spark, sf):
    return S.holdout_groups(episodes(spark, sf), 17)


@query("stratified_group_folds", "F2", with_sql(f"SELECT g AS content_doc_key, ({_pos('fold', 17, 'd, y')})%10 AS fold FROM strata", "episodes", _STRATA))
def stratified_group_folds(spark, sf):
    return S.fold_groups(episodes(spark, sf), 17, 10)


@query("label_stratified_folds_valid", "F3", with_sql(f"""
SELECT fold, count(*) AS n_rows, count(DISTINCT content_doc_key) AS groups, sum(label_supported)::bigint AS positives, 0::bigint AS crossing_groups
FROM episodes JOIN (SELECT g AS content_doc_key, ({_pos('label', 29, 'y')})%5 AS fold FROM strata) USING (content_doc_key) GROUP BY fold""", "episodes", _STRATA))
def label_stratified_folds_valid(spark, sf):
    e = episodes(spark, sf)
    f = S.fold_groups(e, 29, 5, strata=("stratum_label",), tag="label")
    j = e.join(f, "content_doc_key")
    per = j.groupBy("fold", "content_doc_key").agg(F.count("*").alias("n"), F.sum("label_supported").alias("p"))
    crossing = per.groupBy("content_doc_key").agg(F.count("*").alias("folds"))
    x = per.join(crossing, "content_doc_key")
    return x.groupBy("fold").agg(F.sum("n").alias("n_rows"), F.count("*").alias("groups"), F.sum("p").alias("positives"), F.count_if(F.col("folds") > 1).alias("crossing_groups"))


@query("fold_rotations", "F4", with_sql(f"""
SELECT rotation, CASE (fold-rotation+10)%10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS side, count(*) AS groups
FROM (SELECT ({_pos('fold', 17, 'd, y')})%10 AS fold FROM strata), (SELECT range::int AS rotation FROM range(10)) GROUP BY ALL""", "episodes", _STRATA))
def fold_rotations(spark, sf):
    return S.rotations(S.fold_groups(episodes(spark, sf), 17, 10), 10).groupBy("rotation", "side").agg(F.count("*").alias("groups"))


@query("within_corpus_folds", "F5", with_sql(f"SELECT g AS content_doc_key, ({_pos('perdataset', 7, 'd')})%5 AS fold FROM strata", "episodes", _STRATA))
def within_corpus_folds(spark, sf):
    return S.fold_groups(episodes(spark, sf), 7, 5, strata=("stratum_corpus",), tag="perdataset")


@query("leave_one_corpus_out", "F6", with_sql("""
SELECT h AS heldout, CASE WHEN dataset_key=h THEN 'test' ELSE 'train' END AS side, count(*) AS n_rows, count(DISTINCT content_doc_key) AS groups
FROM episodes, (SELECT DISTINCT dataset_key AS h FROM episodes WHERE dataset_key IS NOT NULL) v GROUP BY ALL""", "episodes"))
def leave_one_corpus_out(spark, sf):
    e = episodes(spark, sf)
    return S.leave_one_corpus_out(e, [c for c in corpora(e) if c is not None]).groupBy("heldout", "side").agg(
        F.count("*").alias("n_rows"), F.countDistinct("content_doc_key").alias("groups"))


@query("validation_fraction_ladder", "F7", with_sql(f"""
SELECT dataset_key, min(f) FILTER (least(p,q)>=5) AS fraction, arg_min(least(p,q), f) FILTER (least(p,q)>=5) AS minority FROM (
 SELECT dataset_key, f, count(*) FILTER (label_supported=1) AS p, count(*) FILTER (label_supported=0) AS q FROM episodes e JOIN (
  SELECT dataset_key, g, {_pos('ladder', 11, 'dataset_key')} AS idx, count(*) OVER (PARTITION BY dataset_key) AS n FROM (SELECT DISTINCT dataset_key, content_doc_key AS g FROM episodes)) i
  ON e.dataset_key=i.dataset_key AND e.content_doc_key=i.g, (VALUES (0.2::double),(0.3::double),(0.4::double)) v(f)
 WHERE idx < greatest(round_even(n*f,0),1) GROUP BY e.dataset_key, f) GROUP BY dataset_key""".replace("SELECT dataset_key, f, count", "SELECT e.dataset_key, f, count"), "episodes"))
def validation_fraction_ladder(spark, sf):
    return S.validation_ladder(episodes(spark, sf), 11)


@query("learning_curve_groups", "F8", with_sql(f"""
SELECT f AS fraction, count(*) AS groups, sum(n)::bigint AS n_rows FROM (SELECT g, n, {_pos('curve', 23, '1')} AS idx, count(*) OVER () AS total FROM (
 SELECT content_doc_key AS g, count(*) AS n FROM episodes GROUP BY 1)), (VALUES (0.1::double),(0.25::double),(0.5::double),(1.0::double)) v(f)
WHERE idx < greatest(round_even(total*f,0),2) GROUP BY f""", "episodes"))
def learning_curve_groups(spark, sf):
    e = episodes(spark, sf)
    g = e.groupBy("content_doc_key").agg(F.count("*").alias("n_rows"))
    parts = [S.subsample_groups(e, 23, f).join(g, "content_doc_key").agg(F.count("*").alias("groups"), F.sum("n_rows").alias("n_rows")).withColumn("fraction", F.lit(f)) for f in (0.1, 0.25, 0.5, 1.0)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("few_shot_union", "F9 U1", with_sql(f"""
SELECT episode_key FROM episodes WHERE dataset_key<>'de' UNION ALL
SELECT g FROM (SELECT g, {_pos('fewshot', 31, '1')} AS idx FROM (SELECT episode_key AS g FROM episodes WHERE dataset_key='de')) WHERE idx<20""", "episodes"))
def few_shot_union(spark, sf):
    return S.few_shot(episodes(spark, sf), "de", 20, 31).select("episode_key")


@query("stable_seeds", "F10", with_sql("""
SELECT episode_key, ('0x'||substr(sha256('17'||chr(31)||dataset_key||chr(31)||episode_key),1,8))::bigint AS seed FROM episodes""", "episodes"))
def stable_seeds(spark, sf):
    return episodes(spark, sf).select("episode_key", stable_seed(17, F.col("dataset_key"), F.col("episode_key")).alias("seed"))


@query("rerun_sample", "F11", with_sql(f"""
SELECT g AS episode_key FROM (SELECT g, {_pos('rerun', 20260701, 'd')} AS idx FROM (SELECT dataset_key AS d, episode_key AS g FROM episodes)) WHERE idx<30""", "episodes"))
def rerun_sample(spark, sf):
    return S.balanced_sample(episodes(spark, sf), 120, 4, 20260701).select("episode_key")


# ------------------------------------------------------------------------------ sets

@query("side_union", "U1", with_sql("SELECT episode_key, 'TRAIN' AS side FROM episodes WHERE role='train' UNION ALL SELECT episode_key, 'TEST' FROM episodes WHERE role='test'", "episodes"))
def side_union(spark, sf):
    e = episodes(spark, sf)
    part = lambda r: e.filter(F.col("role") == r).select("episode_key").withColumn("side", F.lit(r.upper()))
    return part("train").unionByName(part("test"))


@query("straddling_groups", "U2 J6", with_sql("SELECT content_doc_key, count(DISTINCT dataset_key) AS sides FROM episodes GROUP BY 1 HAVING count(DISTINCT dataset_key)>1 UNION ALL SELECT 'none', count(*) FROM (SELECT content_doc_key FROM episodes GROUP BY 1 HAVING count(DISTINCT role)>1)", "episodes"))
def straddling_groups(spark, sf):
    e = episodes(spark, sf)
    n = C.isolation(e, "content_doc_key", "role").agg(F.lit("none").alias("content_doc_key"), F.count("*").alias("sides"))
    return C.isolation(e, "content_doc_key", "dataset_key").unionByName(n.select("content_doc_key", "sides"))


@query("missing_and_extra_ids", "U3", """
SELECT 'unlabelled' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL
SELECT 'undocumented', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def missing_and_extra_ids(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    tag = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return tag(d.join(l, "doc_id", "left_anti"), "unlabelled").unionByName(tag(l.join(d, "doc_id", "left_anti"), "undocumented"))


@query("duplicate_contents", "U4", "SELECT sha256(lower(trim(text))) AS content_doc_key, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*)>1")
def duplicate_contents(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2(F.lower(F.trim("text")), 256).alias("content_doc_key"))
    return C.duplicate_keys(d, ["content_doc_key"])
