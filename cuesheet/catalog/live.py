"""Queries over the event stream, and sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.catalog.base import RENDERS_SQL, long, renders, table
from cuesheet.catalog.logs import _VOICES, voices
from cuesheet.operators import renders as R
from cuesheet.session import scratch_dir
from cuesheet.sources import tables as S
from cuesheet.streaming import live as L

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def stream_of(spark, batch, name):
    """The given rows as a file stream: written once, then read as they arrive."""
    path = scratch_dir(spark, f"feed-{name}")
    batch.write.parquet(path)
    return spark.readStream.schema(batch.schema).parquet(path)


def _now(spark, batch, make, name, mode):
    return L.run_available(make(stream_of(spark, batch, name)), scratch_dir(spark, name), mode)


W = f"WITH {RENDERS_SQL}"


@query("live_metrics", f"{W} SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, count(*) AS generations, count(*) FILTER (WHERE status = 'Error') AS failures, round_even(sum(gen_sec) / sum(audio_sec), 4) AS rtf_overall FROM renders GROUP BY 1")
def live_metrics(spark, sf):
    rows = renders(spark, sf).select("ts", "status", "gen_sec", "audio_sec")
    out = L.latest(_now(spark, rows, L.live_metrics, "metrics", "update"), ["window_start"])
    return out.withColumn("window_start", long("window_start"))


@query("live_voice_rates", f"{W}, x AS (SELECT *, unnest([0, 1]) AS back FROM renders) SELECT voice_id, (epoch(date_trunc('day', ts)) - back * 86400)::BIGINT AS window_start, count(*) AS clips, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(redone) AS BIGINT) AS regenerated, round_even(sum(redone) / CAST(sum(chunks) AS DOUBLE), 4) AS regeneration_rate FROM x GROUP BY ALL")
def live_voice_rates(spark, sf):
    rows = renders(spark, sf).select("ts", "voice_id", "chunks", "regen_chunks")
    out = L.latest(_now(spark, rows, L.live_voice_rates, "rates", "update"), ["window_start", "voice_id"])
    return out.withColumn("window_start", long("window_start"))


@query("job_state", "SELECT user_id AS job_id, arg_max(event_type, ts) AS status FROM events GROUP BY 1")
def job_state(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return L.latest(_now(spark, rows, L.job_state, "jobs", "update"), ["job_id"]).select("job_id", "status")


@query("readiness_age", f"{W} SELECT host, arg_max(event_type <> 'error', ts) AS ok, round(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)), 1) AS age_s FROM renders GROUP BY host")
def readiness_age(spark, sf):
    rows = renders(spark, sf).select("ts", "host", (F.col("event_type") != "error").alias("ok"))
    out = L.latest(_now(spark, rows, L.readiness_age, "ready", "update"), ["host"])
    age = F.lit("2024-01-31 00:00:00").cast("timestamp").cast("double") - F.col("tested_at").cast("double")
    return out.select("host", "ok", F.round(age, 1).alias("age_s"))


@query(
    "busy_sessions",
    f"""{W}, g AS (SELECT host, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY host ORDER BY ts) < INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS fresh FROM renders),
s AS (SELECT host, ts, sum(fresh) OVER (PARTITION BY host ORDER BY ts) AS n FROM g)
SELECT host, round(epoch(min(ts)), 3) AS session_start, count(*) AS events FROM s GROUP BY host, n""",
)
def busy_sessions(spark, sf):
    """Sessions over the whole log; the batch form reconciles late events."""
    out = L.busy_sessions(renders(spark, sf).select("ts", "host"), 7200)
    return out.select("host", F.round(F.col("session_start").cast("double"), 3).alias("session_start"), "events")


def _alert_rows(spark, sf):
    r = renders(spark, sf)
    return r.withColumns(
        {
            "wpm": R.wpm(F.col("words") * 3, F.col("audio_sec")),
            "out_lufs": -20.0 + (F.col("k") % 9 - 4) / 2.0,
            "met_target": F.abs((F.col("k") % 9 - 4) / 2.0) < 1.5,
            "limited_by": F.lit("peak_ceiling"),
        }
    )


@query("alerts", f"{W} SELECT tenant, count(*) AS renders FROM renders WHERE NOT abs((k % 9 - 4) / 2.0) < 1.5 GROUP BY tenant")
def alerts(spark, sf):
    """Renders with a loudness alert, by tenant."""
    rows = _alert_rows(spark, sf)
    v = voices(spark, sf)
    out = _now(spark, rows, lambda s: L.alerts(s, v), "alerts", "append").filter(F.col("alerts").contains("loudness came out"))
    return out.join(rows.select("clip_id", "tenant"), "clip_id").groupBy("tenant").agg(F.count(F.lit(1)).alias("renders"))


def _replay_events(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "request").when(F.col("event_type") == "error", "failed").otherwise("done")
    return e.select(F.concat(F.lit("k"), "user_id").alias("key"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))


@query("first_requests", "SELECT count(DISTINCT user_id) AS keys FROM events WHERE event_type IN ('view', 'click')")
def first_requests(spark, sf):
    """A time to live longer than the log leaves one request per key."""
    rows = _replay_events(spark, sf).filter("kind = 'request'")
    out = _now(spark, rows, lambda s: L.first_requests(s, "60 days"), "first", "append")
    return out.agg(F.count(F.lit(1)).alias("keys"))


@query("classify_replays", """
WITH RECURSIVE e AS MATERIALIZED (SELECT 'k' || user_id AS key, epoch(ts) AS said,
    CASE WHEN event_type IN ('view', 'click') THEN 'request' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT DISTINCT key, 0::BIGINT AS rn, NULL::VARCHAR AS state, 0::DOUBLE AS since, NULL::VARCHAR AS verdict FROM e
  UNION ALL
  SELECT key, rn, CASE kind WHEN 'request' THEN coalesce(live, 'running') WHEN 'done' THEN 'done' ELSE nullif(live, 'running') END,
    CASE WHEN kind = 'done' OR (kind = 'request' AND live IS NULL) THEN said ELSE since END,
    CASE WHEN kind = 'request' THEN CASE live WHEN 'running' THEN 'busy' WHEN 'done' THEN 'replay' ELSE 'new' END END
  FROM (SELECT e.key, e.rn, e.kind, e.said, w.since, CASE WHEN e.said - w.since > 86400 THEN NULL ELSE w.state END AS live
    FROM w JOIN e ON e.key = w.key AND e.rn = w.rn + 1))
SELECT key, count(*) FILTER (WHERE verdict = 'new') AS new, count(*) FILTER (WHERE verdict = 'busy') AS busy,
  count(*) FILTER (WHERE verdict = 'replay') AS replay FROM w GROUP BY key""")
def classify_replays(spark, sf):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = _now(spark, _replay_events(spark, sf), L.classify_replays, "replays", "append")
    finally:
        spark.conf.set(store, before)
    return out.groupBy("key").agg(
        F.count_if(F.col("verdict") == "new").alias("new"), F.count_if(F.col("verdict") == "busy").alias("busy"), F.count_if(F.col("verdict") == "replay").alias("replay")
    )


@query("manifest_source", "SELECT count(*) AS clips, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations")
def manifest_source(spark, sf):
    """A manifest written as CSV and read back through the source."""
    rows = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("file"), "text")
    path = scratch_dir(spark, "manifest") + "/m.csv"
    rows.write.option("header", True).option("escape", '"').csv(path)
    return S.read_manifest(spark, path).agg(F.count(F.lit(1)).alias("clips"), F.sum(F.length("text")).alias("n_chars"))


@query("audit_log", "SELECT event_type AS event, count(*) AS lines, CAST(sum(length(event_type)) AS BIGINT) AS text_chars, 0::BIGINT AS broken FROM events GROUP BY 1")
def audit_log(spark, sf):
    """Written by the sink without the text, read by the source."""
    rows = renders(spark, sf).select("ts", F.col("event_type").alias("event"), "voice_id", "tenant", F.col("event_type").alias("text"), "rtf")
    path = scratch_dir(spark, "audit")
    S.write_audit(rows, path)
    back = S.read_audit(spark, path).filter("text is null")
    return back.groupBy("event").agg(F.count(F.lit(1)).alias("lines"), long(F.sum("text_chars")).alias("text_chars"), F.count("_corrupt_record").alias("broken"))


@query("overlay_lexicon", "SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'Nation' ELSE lower(n_name) END AS spoken FROM nation WHERE n_nationkey % 5 > 0")
def overlay_lexicon(spark, sf):
    n = table(spark, sf, "nation")
    base = n.select(F.col("n_name").alias("key"), F.lower("n_name").alias("spoken"))
    k = F.col("n_nationkey")
    mine = n.filter((k % 3 == 0) | (k % 5 == 0)).select(F.col("n_name").alias("key"), F.when(k % 5 == 0, "").otherwise("Nation").alias("spoken"))
    return S.overlay_lexicon(base, mine)


@query("voice_registry", f"WITH {_VOICES} SELECT owner, count(*) AS voices FROM voices v JOIN (SELECT c_name FROM customer WHERE c_custkey % 2 = 0) f ON f.c_name = v.path GROUP BY owner")
def voice_registry(spark, sf):
    """The registry as a table of records against a file listing."""
    v = voices(spark, sf)
    files = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_name").alias("path"))
    path = scratch_dir(spark, "voices")
    S.write_voices(v, path)
    back = spark.read.schema("voice_id string, " + S.VOICE_FIELDS).json(path)
    return back.join(files, "path", "left_semi").groupBy("owner").agg(F.count(F.lit(1)).alias("voices"))


@query(
    "bulk_scripts",
    """WITH r AS (SELECT source AS submission_id, CASE WHEN doc_id % 4 = 0 THEN 'NaN' ELSE trim(lang) END AS script0, n_chars FROM documents),
c AS (SELECT submission_id, CASE WHEN lower(script0) = 'nan' THEN '' ELSE script0 END AS script FROM r)
SELECT submission_id, count(*) AS scripts, TRUE AS accepted FROM c WHERE script <> '' GROUP BY submission_id""",
)
def bulk_scripts(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source", "lang")
    script = F.when(F.col("doc_id") % 4 == 0, " NaN ").otherwise(F.concat(F.lit(" "), F.col("lang"), F.lit("\t")))
    rows = d.select(F.col("source").alias("submission_id"), F.col("lang").alias("project"), script.alias("script"))
    out = S.load_bulk_scripts(rows)
    return out.groupBy("submission_id").agg(F.count(F.lit(1)).alias("scripts"), F.bool_and("accepted").alias("accepted"))


@query("report_sink", f"{W} SELECT voice_id, count(*) AS clips FROM renders GROUP BY voice_id")
def report_sink(spark, sf):
    path = scratch_dir(spark, "report")
    S.write_report(R.voice_stats(renders(spark, sf)), path)
    return spark.read.parquet(path).select("voice_id", "clips")


@query("rule_order", "SELECT n_name AS key, r_name AS spoken, length(n_name) AS n_chars FROM nation JOIN region ON r_regionkey = n_regionkey ORDER BY n_chars DESC, key")
def rule_order(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    lex = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("spoken"))
    return S.rule_order(lex).withColumn("n_chars", long("n_chars"))
