"""Readers, writers, judge parsing and the scoring job, fed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelens.functions import judge as G
from routelens.functions import text as X
from routelens.functions.hashing import uniform
from routelens.operators import features as FT
from routelens.operators import joins as J
from routelens.operators import routing as R
from routelens.operators import scoring as V
from routelens.plans.metric_queries import rounded
from routelens.plans.registry import query
from routelens.plans.views import POOL, episodes, pairs, scores, table, u_sql, wide, with_sql
from routelens.session import scratch_path
from routelens.sources import files as IO

CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

#: rows of a hashed part file, some tens of MB
PART_ROWS = 500_000
#: ids of documents in one archive file
ARCHIVE_DOCS = 50


@query("jsonl_scan", "S1 S4", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def jsonl_scan(spark, sf):
    path = scratch_path(spark, "jsonl")
    table(spark, sf, "conversations").write.json(path)
    return IO.strict(IO.read_jsonl(spark, path, CONV).persist()).select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))


@query("keyed_archive_scan", "S2", "SELECT conv_id::varchar AS doc_key, 'L'||(count(*)%2) AS label, count(*)::int AS n_sentences, sha256(string_agg(text,' ' ORDER BY turn)) AS text_hash FROM conversations GROUP BY conv_id")
def keyed_archive_scan(spark, sf):
    c = table(spark, sf, "conversations")
    sents = F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), F.struct(F.col("text").alias("text")))))
    docs = c.groupBy("conv_id").agg(sents.alias("sents"), F.concat(F.lit("L"), (F.count("*") % 2).cast("string")).alias("label"))
    path = scratch_path(spark, "archives")
    one = F.map_from_entries(F.collect_list(F.struct(F.col("conv_id").cast("string"), F.struct("label", "sents"))))
    docs.groupBy(F.floor(F.col("conv_id") / ARCHIVE_DOCS).alias("file")).agg(F.to_json(one, {"pretty": "true"}).alias("json")).write.partitionBy("file").text(path)
    files = IO.read_archives(spark, path)
    return files.select("doc_key", "label", "n_sentences", F.sha2("text", 256).alias("text_hash"))


@query("edit_annotation_scan", "S3", with_sql("SELECT pair_id AS id, 0 AS position, length(summary) AS pre_chars, length(source) AS post_chars, turn%5<1 AS evidence_ok FROM pairs", "pairs"))
def edit_annotation_scan(spark, sf):
    p = pairs(spark, sf)
    d = F.struct(F.col("pair_id").alias("id"), F.array(F.struct(F.col("source").alias("txt"))).alias("source"),
                 F.array(F.struct(F.col("summary").alias("pre_edit"), F.col("source").alias("post_edit"), F.array((F.col("turn") % 5).cast("int")).alias("evidence"))).alias("summary"))
    path = scratch_path(spark, "edits")
    lists = p.groupBy(F.floor(F.col("conv_id") / ARCHIVE_DOCS).alias("file")).agg(F.to_json(F.collect_list(d), {"pretty": "true"}).alias("json"))
    lists.write.partitionBy("file").text(path)
    e = IO.read_edits(spark, path)
    return e.select("id", "position", F.length("pre").cast("bigint").alias("pre_chars"), F.length("post").cast("bigint").alias("post_chars"), "evidence_ok")


@query("result_csv_scan", "S6 S8", with_sql("SELECT dataset_key, verifier, round(avg(latency_ms),6) AS ms FROM scores GROUP BY ALL", "scores"))
def result_csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    scores(spark, sf).groupBy("dataset_key", "verifier").agg(F.avg("latency_ms").alias("ms")).write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("dataset_key", T.StringType()), T.StructField("verifier", T.StringType()), T.StructField("ms", T.DoubleType())])
    return rounded(IO.read_csv(spark, path, schema))


@query("prediction_store_resume", "S7 S8 S9 X16 X19", with_sql("SELECT verifier, dataset_key, count(*) AS n_rows FROM scores GROUP BY ALL", "scores"))
def prediction_store_resume(spark, sf):
    """Parts written in two runs: the second writes the configurations that the first left out or broke off."""
    path = scratch_path(spark, "predictions")
    s = scores(spark, sf).select("verifier", "dataset_key", "episode_key", "score")
    keys = ["verifier", "dataset_key"]
    IO.write_table(s.filter("dataset_key in ('de', 'en')").filter(~((F.col("dataset_key") == "de") & (uniform("lost", F.col("episode_key")) < 0.5))), path, keys)
    todo = IO.unfinished(s, spark.read.parquet(path), keys, "episode_key")
    IO.write_table(s.join(todo, keys), path, keys)
    return spark.read.parquet(path).groupBy(*keys).agg(F.count("*").alias("n_rows"))


@query("file_hash_inventory", "S11", with_sql("SELECT count(DISTINCT verifier)+1 AS files, 1::bigint AS missing, 1::bigint AS added, 1::bigint AS changed FROM scores", "scores"))
def file_hash_inventory(spark, sf):
    """One folder of parts a verifier is hashed; then one is lost, one is new and one has other rows."""
    path = scratch_path(spark, "inventory")
    rows = scores(spark, sf).select("verifier", "episode_key", "score").persist()
    parts = max(4, -(-rows.count() // PART_ROWS))  # the same for both inventories, so equal rows make equal parts
    for step in ("recorded", "now"):
        changed = F.col("verifier").eqNullSafe("v_high") & F.lit(step == "now")
        kept = rows.withColumn("score", F.when(changed, F.col("score") + 1).otherwise(F.col("score")))
        names = {"recorded": ["v_cheap", "v_high", "v_mid"], "now": ["v_high", "v_mid", "v_new"]}[step]
        for name in names:
            kept.filter(F.col("verifier") == name.replace("v_new", "v_cheap")).repartition(parts, "episode_key").sortWithinPartitions("episode_key", "score").write.csv(f"{path}/{step}/{name}")
    return IO.verify_inventory(*[IO.folder_inventory(spark, f"{path}/{step}") for step in ("recorded", "now")])


@query("score_manifest", "S12", with_sql("""
SELECT verifier, dataset_key, count(*) AS n_rows, count(*) FILTER (available) AS available_rows, round(avg(latency_ms) FILTER (available),6) AS mean_ms, round(1000*count(*) FILTER (available)/sum(latency_ms) FILTER (available),6) AS rows_per_sec FROM scores GROUP BY ALL""", "scores"))
def score_manifest(spark, sf):
    av, ms = F.col("available"), F.col("latency_ms")
    return rounded(scores(spark, sf).groupBy("verifier", "dataset_key").agg(F.count("*").alias("n_rows"), F.count_if(av).alias("available_rows"), F.avg(F.when(av, ms)).alias("mean_ms"), (1000.0 * F.count_if(av) / F.sum(F.when(av, ms))).alias("rows_per_sec")))


# ------------------------------------------------------------------------------ judge output

@query("support_from_logprobs", "T32", """
SELECT event_id, round((exp(-k/50.0::double)+exp(-value))/(exp(-k/50.0::double)+exp(-value)+exp(-1.0::double)),6) AS support FROM (SELECT event_id, value, (props::json->>'k')::bigint AS k FROM events)""")
def support_from_logprobs(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    first = F.create_map(F.lit("maybe"), F.lit(-0.1))
    second = F.create_map(F.lit(" No"), -F.col("k") / 50.0, F.lit("Supported"), -F.col("value"), F.lit("YES"), F.lit(-1.0))
    return rounded(e.select("event_id", G.support_from_logprobs(F.array(first, second)).alias("support")))


@query("label_from_completion", "T33", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'SUPPORTED' WHEN 'view' THEN 'UNSUPPORTED' WHEN 'error' THEN 'UNSUPPORTED' END AS label FROM events""")
def label_from_completion(spark, sf):
    t = F.col("event_type")
    txt = F.when(t == "click", "Answer: No, it is").when(t == "view", "YES.").when(t == "error", "unsupported, not supported").otherwise("cannot say")
    return table(spark, sf, "events").select("event_id", G.label_from_text(txt).alias("label"))


_JU = lambda tag: u_sql(f"'{tag}'", "event_id")


def payloads(spark, sf):
    """A judge payload per event, with every rule broken by some of them."""
    e = table(spark, sf, "events")
    u = lambda t: uniform(t, F.col("event_id"))
    label = F.when(u("lab") < 0.45, "SUPPORTED").when(u("lab") < 0.95, "UNSUPPORTED").otherwise("MAYBE")
    err = F.when(u("err") < 0.5, "NONE").when(u("err") < 0.95, "MIXED").otherwise("STRANGE")
    spans = F.when(u("span") < 0.4, F.array().cast("array<string>")).when(u("span") < 0.8, F.array(F.upper("event_type"))).otherwise(F.array(F.lit("absent")))
    pay = F.to_json(F.struct(label.alias("label"), (u("prob") * 1.05).alias("support_probability"), F.array(F.floor(u("ev") * 11).cast("int")).alias("evidence_ids"), spans.alias("unsupported_spans"), err.alias("error_type")))
    return e.select("event_id", F.concat(F.lit("an event of type "), "event_type").alias("claim"), pay.alias("json"))


_STATUS = f"""st AS (SELECT event_id, CASE WHEN {_JU('lab')}>=0.95::double THEN 'bad_label' WHEN {_JU('prob')}*1.05::double>1 THEN 'bad_probability' WHEN floor({_JU('ev')}*11)>=10 THEN 'bad_evidence'
 WHEN {{loose}} {_JU('span')}>=0.8::double THEN 'ungrounded_span' WHEN {_JU('err')}>=0.95::double THEN 'bad_error_type' WHEN ({_JU('lab')}<0.45::double)<>({_JU('err')}<0.5::double) THEN 'label_error_mismatch'
 WHEN {_JU('lab')}<0.45::double AND {_JU('span')}>=0.4::double THEN 'supported_with_span' WHEN {_JU('lab')}>=0.45::double AND {_JU('span')}<0.4::double THEN 'unsupported_without_span' ELSE 'ok' END AS status FROM events)"""


@query("payload_validation", "T34 P16", "WITH " + _STATUS.format(loose="") + " SELECT event_id, status FROM st")
def payload_validation(spark, sf):
    p = payloads(spark, sf)
    return p.select("event_id", G.payload_status(F.from_json("json", G.PAYLOAD), F.col("claim"), F.lit(10)).alias("status"))


@query("payload_score_status", "T34", "WITH " + _STATUS.format(loose="") + ", " + _STATUS.format(loose="false AND").replace("st AS", "so AS") +
       " SELECT event_id, CASE WHEN st.status<>'ungrounded_span' THEN st.status WHEN so.status='ok' THEN 'span_fallback' ELSE so.status END AS status FROM st JOIN so USING (event_id)")
def payload_score_status(spark, sf):
    p = payloads(spark, sf)
    return p.select("event_id", G.score_status(F.from_json("json", G.PAYLOAD), F.col("claim"), F.lit(10)).alias("status"))


@query("ground_claim_spans", "T35")
def ground_claim_spans(spark, sf):
    """The summary's opening sentence, upper-cased and stripped of blanks, located in the summary."""
    p = pairs(spark, sf).withColumn("span", F.upper(F.regexp_replace(F.get(X.sentences(F.col("summary")), F.lit(0)), r"\s+", "")))
    return p.select("pair_id", G.ground_span("summary", "span").alias("g")).select("pair_id", "g.start", "g.end")


@query("window_score_aggregation", "T37", with_sql("""
SELECT content_doc_key, verifier, round(max(score),6) AS max_support, round(1-max(1-score),6) AS span_support, arg_max(episode_key, (score, episode_key)) AS best_window, round((max(score-0.3::double)+1)/2,6) AS entail_minus_contradict, round(least(greatest((avg(2*score-1)+1)/2,0),1),6) AS rescaled
FROM scores GROUP BY ALL""", "scores"))
def window_score_aggregation(spark, sf):
    s = F.col("score")
    return rounded(scores(spark, sf).groupBy("content_doc_key", "verifier").agg(
        F.max(s).alias("max_support"), (1.0 - F.max(1.0 - s)).alias("span_support"), F.max_by("episode_key", F.struct("score", "episode_key")).alias("best_window"),
        ((F.max(s - 0.3) + 1.0) / 2.0).alias("entail_minus_contradict"), F.least(F.greatest((F.avg(2 * s - 1) + 1) / 2, F.lit(0.0)), F.lit(1.0)).alias("rescaled")))


# ------------------------------------------------------------------------------ scoring job

def overlap_scorer():
    """Share of the summary's words that occur in the source; absent for an empty summary."""
    import pandas as pd

    def score(b: pd.DataFrame) -> pd.Series:
        def one(src, summ):
            w = summ.lower().split()
            have = set(src.lower().split())
            return sum(x in have for x in w) / len(w) if w else None

        return pd.Series([one(a, c) for a, c in zip(b["source"], b["summary"])], index=b.index, dtype="float64")

    return score


def scoring_inputs(spark, sf):
    return pairs(spark, sf).select(F.col("pair_id").alias("episode_key"), F.lit("overlap").alias("verifier"), "source", "summary")


@query("resumable_scoring", "V1 V2 J7 S10", with_sql("""
SELECT pair_id AS episode_key, round(len(list_filter(w, lambda z: list_contains(h, z)))/len(w)::double,6) AS score, true AS available FROM (
 SELECT pair_id, list_filter(string_split_regex(lower(summary),'\\s+'), lambda z: z<>'') AS w, string_split_regex(lower(source),'\\s+') AS h FROM pairs)""", "pairs"))
def resumable_scoring(spark, sf):
    """Half the inputs first, then the rest; the second run only scores what is pending."""
    path = scratch_path(spark, "cache")
    x = scoring_inputs(spark, sf)
    V.append_results(spark, x.filter(uniform("first", F.col("episode_key")) < 0.5), path, overlap_scorer, "overlap", 0)
    V.append_results(spark, x, path, overlap_scorer, "overlap", 1)
    return rounded(V.latest_results(spark.read.parquet(path)).select("episode_key", "score", "available"))


@query("scoring_input_index", "V5 P2 P4", with_sql("SELECT pair_id AS episode_key, sha256(source||chr(31)||summary) AS input_sha256, length(source) AS source_chars FROM pairs", "pairs"))
def scoring_input_index(spark, sf):
    return pairs(spark, sf).select(F.col("pair_id").alias("episode_key"), F.sha2(F.concat_ws("\u001f", "source", "summary"), 256).alias("input_sha256"), F.length("source").cast("bigint").alias("source_chars"))


@query("routed_only_scoring", "V3 R3")
def routed_only_scoring(spark, sf):
    """Plan, execute, finish: only pairs whose cheap evidence is weak reach the scorer."""
    p = pairs(spark, sf)
    weak = FT.bm25_features(p).filter("bm25_top1 < 5").select("pair_id")
    x = p.join(weak, "pair_id", "left_semi").select(F.col("pair_id").alias("episode_key"), "source", "summary")
    return rounded(V.score_rows(x, overlap_scorer, "overlap").select("episode_key", "score", "available"))


@query("checked_write", "P3 J3 S8 P18", with_sql("SELECT count(*) AS rows_written, true AS hole_refused, true AS duplicate_refused, true AS schema_refused, false AS refused_table_exists, 'hole_in_label_supported' AS named FROM scores", "scores"))
def checked_write(spark, sf):
    """Scores are joined to labels behind an open gate and written under a contract; tables that break it raise and leave nothing."""
    s = scores(spark, sf).select("episode_key", "verifier", "role", "score", "available", "latency_ms")
    gold = episodes(spark, sf).select("episode_key", "label_supported")
    rules = {
        "key": F.col("episode_key").isNotNull(), "score_range": F.col("score").between(0, 1), "role": F.col("role").isin("train", "test"),
        "latency": ~F.col("available") | F.col("latency_ms").isNotNull(),
    }
    full, holes = J.gated_labels(s, gold, ["episode_key"], ["label_supported"], True)
    keys = ["episode_key", "verifier"]
    good, bad = scratch_path(spark, "checked"), scratch_path(spark, "refused")
    IO.write_table(full, good, rules=rules | holes, unique=keys, schema=full.schema)

    def refused(df, **contract) -> str:
        try:
            IO.write_table(df, bad, **contract)
        except IO.BrokenContract as e:
            return str(e)
        return ""

    some = gold.filter(uniform("lost", F.col("episode_key")) < 0.9)
    hole = refused(J.gated_labels(s, some, ["episode_key"], ["label_supported"], True)[0], rules=rules | holes)
    twice = refused(full.unionByName(full), rules=rules, unique=keys)
    other = refused(full.drop("role"), schema=full.schema)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(bad)
    there = fs.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(fs)
    back = spark.read.schema(full.schema).parquet(good)
    named = next((n for n in holes if n in hole), "")
    return back.agg(F.count(F.lit(1)).alias("rows_written")).select("rows_written", *[F.lit(v).alias(n) for n, v in (
        ("hole_refused", bool(hole)), ("duplicate_refused", "duplicate_keys" in twice), ("schema_refused", other.startswith("schema")), ("refused_table_exists", bool(there)), ("named", named))])


_ID = {"model_revision": ("'r1'", "'r2'", 0.2), "protocol_version": ("'p1'", "'p2'", 0.1), "input_sha256": ("sha256(episode_key)", "sha256(episode_key||'!')", 0.15), "harness_sha256": ("'h'", "'h2'", 0.05)}


@query("identity_checked_cache", "S10 J7 V1", with_sql(f"""
SELECT why, count(*) AS n_rows, count(DISTINCT episode_key) AS episodes FROM (SELECT *, CASE WHEN NOT cached THEN 'missing' {' '.join(f"WHEN change_{c} THEN '{c}'" for c in _ID)} END AS why FROM (
 SELECT episode_key, verifier, {u_sql("'kept'", 'episode_key', 'verifier')}<0.8::double AS cached, {', '.join(f"{u_sql(chr(39) + c + chr(39), 'episode_key', 'verifier')}<{share}::double AS change_{c}" for c, (_, _, share) in _ID.items())} FROM scores)) WHERE why IS NOT NULL GROUP BY why""", "scores"))
def identity_checked_cache(spark, sf):
    """A cache made by other models, protocols, inputs or harnesses: only what still fits is reused, and the rest says why."""
    s = scores(spark, sf).select("episode_key", "verifier", "score")
    u = lambda tag: uniform(tag, F.col("episode_key"), F.col("verifier"))
    now = s.select("episode_key", "verifier", F.lit("r2").alias("model_revision"), F.lit("p2").alias("protocol_version"), F.sha2(F.concat("episode_key", F.lit("!")), 256).alias("input_sha256"), F.lit("h2").alias("harness_sha256"))
    was = {"model_revision": F.lit("r1"), "protocol_version": F.lit("p1"), "input_sha256": F.sha2("episode_key", 256), "harness_sha256": F.lit("h")}
    kept = now.join(s, ["episode_key", "verifier"]).filter(u("kept") < 0.8)
    stored = kept.select("episode_key", "verifier", "score", *[F.when(u(c) < _ID[c][2], was[c]).otherwise(F.col(c)).alias(c) for c in V.IDENTITY], F.lit(True).alias("parse_ok"), F.lit(0).alias("attempt"))
    path = scratch_path(spark, "identified-cache")
    IO.write_table(stored, path, unique=["episode_key", "verifier"])
    todo = V.pending_identified(now, spark.read.schema(stored.schema).parquet(path))
    return todo.groupBy("why").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("episode_key").alias("episodes"))


_CALL_SEEDS = (1, 2, 3)
_PICK = [f"max(CASE WHEN available AND verifier='{v}' THEN {u_sql(chr(39) + 'live' + chr(39), 'seed', 'episode_key', 'verifier')} END)" for v in POOL]


@query("routed_call_plan", "V3 R3 R23", with_sql(f"""
SELECT seed::bigint AS seed, count(*) AS n_rows, count(verifier) AS planned, any_value(n_calls) AS calls_made, round(avg(coalesce(score,0.5::double)),6) AS mean_score FROM (
 SELECT p.seed, p.episode_key, p.verifier, s.score FROM picked p LEFT JOIN scores s ON s.episode_key=p.episode_key AND s.verifier=p.verifier), (SELECT count(*) AS n_calls FROM (SELECT DISTINCT episode_key, verifier FROM picked WHERE verifier IS NOT NULL)) GROUP BY seed""", "scores",
    f"""picked AS (SELECT seed, episode_key, CASE WHEN u0=g THEN '{POOL[0]}' WHEN u1=g THEN '{POOL[1]}' WHEN u2=g THEN '{POOL[2]}' END AS verifier FROM (SELECT *, greatest(u0,u1,u2) AS g FROM (
 SELECT seed, episode_key, {', '.join(f'{x} AS u{i}' for i, x in enumerate(_PICK))} FROM scores, (VALUES {','.join(f'({s})' for s in _CALL_SEEDS)}) sd(seed) WHERE role='test' GROUP BY ALL)))"""))
def routed_call_plan(spark, sf):
    """Routes of three seeds make one plan; each different call is made once, whoever asked for it, and joined back."""
    w = wide(spark, sf).filter("role = 'test'").withColumn("seed", F.explode(F.lit(list(_CALL_SEEDS))))
    r = R.select_action(w, POOL, [uniform("live", F.col("seed"), F.col("episode_key"), v) for v in POOL])
    plan, calls = V.call_plan(r)
    path = scratch_path(spark, "call-plan")
    IO.write_table(plan, path, unique=["episode_key", "seed"])
    plan = spark.read.schema(plan.schema).parquet(path)
    calls = V.call_plan(plan, action="verifier")[1]
    results = IO.settled(scores(spark, sf).join(calls, ["episode_key", "verifier"], "left_semi").select("episode_key", "verifier", "score", F.lit(True).alias("available")), "calls")
    done = V.executed(plan, results)
    made = results.agg(F.count(F.lit(1)).alias("n")).first()[0]
    return rounded(done.groupBy("seed").agg(F.count(F.lit(1)).alias("n_rows"), F.count("verifier").alias("planned"), F.lit(made).alias("calls_made"), F.avg("score").alias("mean_score")))
