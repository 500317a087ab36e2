"""Queries over render, job, voice and memory logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.catalog.base import RENDERS_SQL, long, renders, table
from cuesheet.functions import text as X
from cuesheet.operators import health as H
from cuesheet.operators import jobs as J
from cuesheet.operators import renders as R
from cuesheet.operators import voices as VO

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


W = f"WITH {RENDERS_SQL}"


@query("overall_rtf", f"{W} SELECT tenant, round(sum(gen_sec), 4) AS gen_sec, round(sum(audio_sec), 4) AS audio_sec, round_even(sum(gen_sec) / sum(audio_sec), 4) AS rtf_overall FROM renders GROUP BY tenant")
def overall_rtf(spark, sf):
    out = R.overall_rtf(renders(spark, sf), "tenant")
    return out.withColumns({c: F.round(c, 4) for c in ("gen_sec", "audio_sec")})


@query("voice_stats", f"{W} SELECT voice_id, count(*) AS clips, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(redone) AS BIGINT) AS regenerated, round_even(sum(redone) / CAST(greatest(sum(chunks), 1) AS DOUBLE), 4) AS regeneration_rate FROM renders GROUP BY voice_id")
def voice_stats(spark, sf):
    return R.voice_stats(renders(spark, sf))


_CAUSES = """list_filter([
  CASE WHEN redone > 0 THEN redone || ' of ' || chunks || ' chunk(s) had to be generated again (' ||
    concat_ws(', ', CASE WHEN dropped_words > 0 THEN 'dropped words x' || dropped_words END, CASE WHEN extra_words > 0 THEN 'extra words x' || extra_words END)
    || '), costing ' || printf('%.1f', regen_sec) || 's' END,
  CASE WHEN verify_s > 0 AND gen_sec > 0 AND verify_s > 0.35::DOUBLE * gen_sec THEN 'verification took ' || printf('%.1f', round_even(verify_s, 1)) || 's against ' || printf('%.1f', round_even(gen_sec, 1)) || 's of generation' END,
  CASE WHEN vram_free_mb < 1400 THEN 'the card had only ' || printf('%.0f', vram_free_mb::DOUBLE) || ' MB free when this clip started, so allocation was under pressure' END,
  CASE WHEN reserved_mb > total_mb::DOUBLE * 1.02::DOUBLE THEN 'VRAM has spilled into system memory — restart the server' END,
  CASE WHEN audio_sec > 0 AND audio_sec < 8 THEN 'the clip is only ' || printf('%.1f', round_even(audio_sec, 1)) || 's long, so the fixed per-request cost dominates the ratio' END,
  CASE WHEN voice_prompt_s > 1 THEN 'the voice prompt was built from scratch (' || printf('%.1f', voice_prompt_s) || 's) — pre-warm the voice to skip this' END
], lambda x: x IS NOT NULL)"""


@query("explain_rtf", f"{W}, c AS (SELECT clip_id, rtf, {_CAUSES} AS causes FROM renders) SELECT clip_id, len(causes) AS n_causes, rtf <= 0.26 AND len(causes) = 0 AS normal, CASE WHEN rtf <= 0.26 AND len(causes) = 0 THEN 'normal' WHEN len(causes) > 0 THEN 'higher than usual: ' || array_to_string(causes, '; ') ELSE 'higher than usual, with no single cause identified' END AS rtf_summary FROM c")
def explain_rtf(spark, sf):
    out = R.explain_rtf(renders(spark, sf))
    return out.select("clip_id", long(F.size("causes")).alias("n_causes"), "normal", "rtf_summary")


_VOICES = """voices AS (SELECT 'v' || c_custkey AS voice_id, CASE WHEN c_custkey % 3 > 0 THEN 't' || (c_custkey % 3) END AS owner,
  CASE WHEN c_custkey % 4 > 0 THEN 100.0 + c_nationkey * 2 END AS baseline_wpm, c_name AS path, '0.' || (c_custkey % 3) AS prompt_version,
  c_acctbal > 0 AS consent FROM customer)"""


def voices(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("v"), k).alias("voice_id"),
        F.when(k % 3 > 0, F.concat(F.lit("t"), k % 3)).alias("owner"),
        F.when(k % 4 > 0, 100.0 + F.col("c_nationkey") * 2).alias("baseline_wpm"),
        F.col("c_name").alias("path"),
        F.concat(F.lit("0."), k % 3).alias("prompt_version"),
        (F.col("c_acctbal") > 0).alias("consent"),
    )


def _rated(spark, sf):
    r = renders(spark, sf)
    return r.withColumn("wpm", R.wpm(F.col("words") * 3, F.col("audio_sec")))


@query("wpm", f"{W} SELECT clip_id, round_even(words * 3 / (audio_sec / 60.0), 1) AS wpm FROM renders")
def wpm(spark, sf):
    return _rated(spark, sf).select("clip_id", "wpm")


@query("baseline_wpm", f"{W} SELECT voice_id, round_even(sum(words) / (sum(audio_sec) / 60.0), 1) AS baseline_wpm FROM renders GROUP BY voice_id")
def baseline_wpm(spark, sf):
    g = renders(spark, sf).groupBy("voice_id").agg(F.sum(F.col("words").cast("long")).alias("w"), F.sum("audio_sec").alias("s"))
    return g.select("voice_id", R.baseline_wpm(F.col("w"), F.col("s")).alias("baseline_wpm"))


@query(
    "rate_warning",
    f"""{W}, {_VOICES}, x AS (SELECT clip_id, coalesce(round_even(words * 3 / (audio_sec / 60.0), 1), 0) AS wpm, CAST(baseline_wpm AS DOUBLE) AS b FROM renders LEFT JOIN voices USING (voice_id))
SELECT clip_id, CASE WHEN wpm = 0 THEN NULL
  WHEN b IS NOT NULL THEN CASE WHEN wpm NOT BETWEEN b * 0.75 AND b * 1.4::DOUBLE THEN 'speaking rate ' || printf('%.0f', round_even(wpm, 0)) || ' wpm is outside this voice''s usual ' || printf('%.0f', round_even(b * 0.75, 0)) || '-' || printf('%.0f', round_even(b * 1.4::DOUBLE, 0)) || ' wpm' END
  WHEN wpm < 50 THEN 'speaking rate ' || printf('%.0f', round_even(wpm, 0)) || ' wpm is implausibly slow'
  WHEN wpm > 280 THEN 'speaking rate ' || printf('%.0f', round_even(wpm, 0)) || ' wpm is implausibly fast — the clip may be cut short' END AS rate_warning FROM x""",
)
def rate_warning(spark, sf):
    return R.with_rate_warning(_rated(spark, sf), voices(spark, sf)).select("clip_id", "rate_warning")


@query("attach_baseline", f"{W}, {_VOICES} SELECT voice_id, CAST(max(baseline_wpm) AS DOUBLE) AS baseline_wpm, count(*) AS renders FROM renders LEFT JOIN voices USING (voice_id) GROUP BY voice_id")
def attach_baseline(spark, sf):
    out = R.attach_baseline(renders(spark, sf), voices(spark, sf))
    return out.groupBy("voice_id").agg(F.max("baseline_wpm").alias("baseline_wpm"), F.count(F.lit(1)).alias("renders"))


def _loud(spark, sf):
    r = renders(spark, sf)
    return r.select(
        "clip_id",
        (-20.0 + (F.col("k") % 9 - 4) / 2.0).alias("out_lufs"),
        (F.abs((F.col("k") % 9 - 4) / 2.0) < 1.5).alias("met_target"),
        F.element_at(F.array(F.lit("peak_ceiling"), F.lit("gain_cap"), F.lit("silence"), F.lit(None)), (F.col("k") % 4 + 1).cast("int")).alias("limited_by"),
    )


@query(
    "loudness_warning",
    f"""{W} SELECT clip_id, CASE WHEN NOT abs((k % 9 - 4) / 2.0) < 1.5 THEN 'loudness came out at ' || printf('%.1f', (-20.0 + (k % 9 - 4) / 2.0)::DOUBLE) || ' LUFS instead of -20 — ' ||
  CASE k % 4 WHEN 0 THEN 'the peak ceiling was reached first' WHEN 1 THEN 'the source was too quiet to lift safely without raising its background noise'
  WHEN 2 THEN 'there was almost no signal to measure' ELSE 'the target could not be reached' END END AS loudness_warning FROM renders""",
)
def loudness_warning(spark, sf):
    return R.loudness_warning(_loud(spark, sf)).select("clip_id", "loudness_warning")


@query("batch_summary", f"{W} SELECT count(*) FILTER (WHERE status = 'Done') AS ok, count(*) AS total, round(avg(rtf) FILTER (WHERE status = 'Done'), 6) AS avg_rtf, min(rtf) FILTER (WHERE status = 'Done') AS best_rtf, max(rtf) FILTER (WHERE status = 'Done') AS worst_rtf, count(*) FILTER (WHERE status = 'Done' AND redone > 0) AS with_warning FROM renders")
def batch_summary(spark, sf):
    r = renders(spark, sf).withColumn("warning", F.when(F.size("regen_chunks") > 0, "redone").otherwise(""))
    return R.batch_summary(r).withColumn("avg_rtf", F.round("avg_rtf", 6))


_EVENT = "CASE event_type WHEN 'error' THEN 'oom' WHEN 'view' THEN 'generation' WHEN 'click' THEN 'regeneration' WHEN 'signup' THEN 'replay' ELSE CASE WHEN k % 3 = 0 THEN 'verify_failure' WHEN k % 3 = 1 THEN 'verify_skipped' ELSE 'tail_trim' END END"


@query(
    "counters",
    f"""{W}, l AS (SELECT *, {_EVENT} AS event FROM renders) SELECT tenant, {", ".join(f"count(*) FILTER (WHERE event = '{e}') AS {n}" for n, e in
    (("generations", "generation"), ("verify_failures", "verify_failure"), ("verify_skipped", "verify_skipped"), ("tail_trims", "tail_trim"), ("regenerations", "regeneration"), ("oom", "oom"), ("idempotent_replays", "replay")))},
  round(sum(audio_sec), 3) AS audio_sec_total, round(sum(gen_sec), 3) AS gen_sec_total FROM l GROUP BY tenant""",
)
def counters(spark, sf):
    log = renders(spark, sf).withColumn("event", F.expr(_EVENT))
    return R.counters(log, "tenant").withColumns({c: F.round(c, 3) for c in ("audio_sec_total", "gen_sec_total")})


@query("verify_cost", f"{W} SELECT redone > 0 AS regenerated, count(*) AS clips, CAST(sum(chunks) AS BIGINT) AS chunks, round(sum(verify_s), 3) AS verify_s, round(sum(verify_s) / sum(chunks), 6) AS per_chunk FROM renders GROUP BY 1")
def verify_cost(spark, sf):
    return R.verify_cost(renders(spark, sf)).withColumns({"verify_s": F.round("verify_s", 3), "per_chunk": F.round("per_chunk", 6)})


@query(
    "verify_coverage",
    f"""{W}, l AS (SELECT CASE WHEN status = 'Error' THEN 'failed' WHEN verify_s > 45 THEN 'skipped' ELSE 'verified' END AS o FROM renders),
t AS (SELECT count(*) FILTER (WHERE o = 'verified') AS verified, count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'failed') AS failed FROM l)
SELECT *, round_even(skipped / CAST(verified + skipped + failed AS DOUBLE), 4) AS skipped_share, round_even(skipped / CAST(verified + skipped + failed AS DOUBLE), 4) > 0.05 AS flagged FROM t""",
)
def verify_coverage(spark, sf):
    """Over the 45 s budget counts as skipped."""
    outcome = F.when(F.col("status") == "Error", "failed").when(F.col("verify_s") > 45, "skipped").otherwise("verified")
    return R.verify_coverage(renders(spark, sf).withColumn("outcome", outcome))


ALLOWED = ["text", "voice_id", "format", "k1", "k2"]


@query(
    "unknown_params",
    "WITH p AS (SELECT unnest(['text', 'k' || (event_id % 5), event_type]) AS param FROM events) SELECT param, count(*) AS times FROM p WHERE param NOT IN ('text', 'voice_id', 'format', 'k1', 'k2') GROUP BY param",
)
def unknown_params(spark, sf):
    keys = F.array(F.lit("text"), F.concat(F.lit("k"), F.col("event_id") % 5), F.col("event_type"))
    return R.unknown_param_counts(table(spark, sf, "events").select("event_id", keys.alias("keys")), ALLOWED)


@query("distinct_chunks", "SELECT l_orderkey AS clip_id, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS chunk_nos FROM lineitem GROUP BY l_orderkey")
def distinct_chunks(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").alias("chunk_no"))
    return R.distinct_chunks(li).select("clip_id", F.array_join("chunk_nos", ",").alias("chunk_nos"))


@query(
    "regen_reasons",
    """WITH a AS (SELECT l_orderkey AS clip_id, l_linenumber AS chunk_no, CASE l_returnflag WHEN 'A' THEN 'dropped_words' WHEN 'R' THEN 'extra_words' ELSE 'unclear' END AS reason FROM lineitem),
r AS (SELECT clip_id, reason, count(*) AS n FROM a GROUP BY ALL)
SELECT r.clip_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons, any_value(c.chunks) AS chunks
FROM r JOIN (SELECT clip_id, array_to_string(list_sort(list_distinct(list(chunk_no))), ',') AS chunks FROM a GROUP BY clip_id) c ON c.clip_id = r.clip_id GROUP BY r.clip_id""",
)
def regen_reasons(spark, sf):
    from cuesheet.operators import audit as A

    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("clip_id"),
        F.col("l_linenumber").alias("chunk_no"),
        F.when(F.col("l_returnflag") == "A", "dropped_words").when(F.col("l_returnflag") == "R", "extra_words").otherwise("unclear").alias("reason"),
    )
    out = A.regen_reasons(li)
    pairs = F.transform(F.map_entries("regen_reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("clip_id", F.array_join(pairs, ",").alias("reasons"), F.array_join("regen_chunks", ",").alias("chunks"))


@query("union_runs", "SELECT 'orders' AS run, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1 UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem")
def union_runs(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("orders").alias("run"), F.col("o_orderkey").alias("key"), "o_totalprice")
    li = table(spark, sf, "lineitem").select(F.lit("lineitem").alias("run"), F.col("l_orderkey").alias("key"))
    return R.union_runs(o, li).groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.sum("key").alias("keys"))


@query("render_fields", f"{W} SELECT clip_id, CAST(redone AS BIGINT) AS regenerated, CASE WHEN k % 2 = 0 THEN rtf END AS rtf, CASE WHEN redone > 0 THEN regen_sec::DOUBLE ELSE 0.0 END AS regenerate_s FROM renders")
def render_fields(spark, sf):
    r = renders(spark, sf)
    report = F.to_json(
        F.struct(
            F.when(F.col("k") % 2 == 0, F.col("rtf")).alias("rtf"),
            F.when(F.size("regen_chunks") > 0, F.col("regen_chunks")).alias("regen_chunks"),
            F.when(F.size("regen_chunks") > 0, F.col("regen_sec")).alias("regen_sec"),
        )
    )
    out = R.render_fields(r.select("clip_id", report.alias("report")))
    return out.select("clip_id", long("chunks_regenerated").alias("regenerated"), "rtf", "regenerate_s")


@query("log_scraping", "SELECT event_id AS clip_id, CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE 0 END AS levelled, CASE WHEN event_id % 2 = 0 THEN value ELSE 0.0 END AS max_db, CASE WHEN event_id % 3 = 0 THEN '8,4' ELSE '' END AS halvings FROM events")
def log_scraping(spark, sf):
    ev = table(spark, sf, "events")
    e = F.col("event_id")
    info = F.when(e % 2 == 0, F.concat(F.lit("levelled "), e % 7, F.lit(" chunk(s) (max "), F.col("value"), F.lit(" dB)"))).otherwise("ok")
    log = F.when(e % 3 == 0, "CUDA OOM -> reducing batch size to 8; CUDA OOM -> reducing batch size to 4").otherwise("")
    lv = R.scrape_levels(info)
    return ev.select(e.alias("clip_id"), long(lv["n"]).alias("levelled"), lv["max_db"].alias("max_db"), F.array_join(R.scrape_halvings(log), ",").alias("halvings"))


_JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_orderpriority AS project, o_orderdate AS ts,
  CASE o_orderstatus WHEN 'O' THEN 'Queued' WHEN 'F' THEN 'Done' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Processing' ELSE 'Cancelling…' END END AS status,
  round(o_totalprice / 1000000, 3) AS rtf, CASE WHEN o_orderstatus = 'F' THEN 'x.wav' END AS file FROM orders)"""


def jobs(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "O", "Queued").when(F.col("o_orderstatus") == "F", "Done").when(k % 2 == 0, "Processing").otherwise("Cancelling…")
    )
    return o.select(
        k.alias("job_id"), F.col("o_orderpriority").alias("project"), F.col("o_orderdate").alias("ts"), status.alias("status"),
        F.round(F.col("o_totalprice") / 1000000, 3).alias("rtf"), F.when(F.col("o_orderstatus") == "F", "x.wav").alias("file"),
    )


@query("queue_board", f"WITH {_JOBS} SELECT s AS status, count(job_id) AS jobs, round(avg(CASE WHEN s = 'Done' AND rtf > 0 THEN rtf END), 6) AS avg_rtf, min(CASE WHEN s = 'Done' AND rtf > 0 THEN rtf END) AS best_rtf FROM (VALUES ('Queued'), ('Processing'), ('Done'), ('Error'), ('Cancelled')) v(s) LEFT JOIN jobs ON status = s GROUP BY s")
def queue_board(spark, sf):
    return J.queue_board(jobs(spark, sf)).withColumn("avg_rtf", F.round("avg_rtf", 6))


@query("queue_depth", f"WITH {_JOBS} SELECT count(*) FILTER (WHERE status IN ('Queued', 'Processing')) AS queue_depth FROM jobs")
def queue_depth(spark, sf):
    return J.queue_depth(jobs(spark, sf))


@query("last_jobs", f"WITH {_JOBS} SELECT job_id, status FROM jobs ORDER BY job_id DESC LIMIT 50")
def last_jobs(spark, sf):
    return J.last_jobs(jobs(spark, sf).select("job_id", "status"), 50)


@query("live_replays", "SELECT event_id AS key, value FROM events WHERE epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(ts) <= 86400 ORDER BY ts DESC, key DESC LIMIT 200")
def live_replays(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("at"), "value")
    return J.live_replays(e, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("key", "value")


@query("clear_finished", f"WITH {_JOBS} SELECT status, count(*) AS jobs FROM jobs WHERE status <> 'Done' GROUP BY status")
def clear_finished(spark, sf):
    return J.clear_finished(jobs(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


@query("cancel_queued", f"WITH {_JOBS} SELECT CASE WHEN status = 'Queued' THEN 'Cancelled' ELSE status END AS status, count(*) AS jobs, count(*) FILTER (WHERE status = 'Queued') AS cancelled FROM jobs GROUP BY 1")
def cancel_queued(spark, sf):
    return J.cancel_queued(jobs(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.count_if("cancelled_now").alias("cancelled"))


@query("jobs_with_reports", f"WITH {_JOBS}, l AS (SELECT l_orderkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1) SELECT job_id, status, CASE WHEN status = 'Done' THEN q END AS audio_sec FROM jobs LEFT JOIN l ON l_orderkey = job_id")
def jobs_with_reports(spark, sf):
    per = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.round(F.sum("l_quantity"), 2).alias("audio_sec"), F.max("l_tax").alias("rtf"))
    return J.jobs_with_reports(jobs(spark, sf).drop("rtf"), per).select("job_id", "status", "audio_sec")


@query("public_jobs", f"WITH {_JOBS} SELECT job_id, project, regexp_replace(lower(status), '…+$', '') AS status, FALSE AS verified, rtf, CASE WHEN file IS NOT NULL THEN '/api/jobs/' || job_id || '/download' END AS download_url FROM jobs")
def public_jobs(spark, sf):
    return J.public_jobs(jobs(spark, sf).withColumn("verified", F.lit(None).cast("boolean")))


@query(
    "assign_unique_names",
    """WITH j AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'voiceover' ELSE replace(o_orderpriority, ' ', '_') END AS base FROM orders),
taken AS (SELECT 'voiceover' AS base, 1 AS i UNION ALL SELECT 'voiceover', n_nationkey FROM nation WHERE n_nationkey > 5 AND n_nationkey % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS r FROM j),
g AS (SELECT base, i - row_number() OVER (PARTITION BY base ORDER BY i) AS g FROM taken),
s AS (SELECT r.base, r.o_orderkey, r.r + count(g.g) AS i FROM r LEFT JOIN g ON g.base = r.base AND g.g < r.r GROUP BY r.base, r.o_orderkey, r.r)
SELECT o_orderkey, CASE WHEN i = 1 THEN base ELSE base || '_' || i END AS unique_name FROM s""",
)
def assign_unique(spark, sf):
    """A third of the jobs ask for the same name."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "voiceover").otherwise(F.col("o_orderpriority")).alias("p"))
    base = o.select("o_orderkey", X.safe_name(F.col("p")).alias("base"))
    n = table(spark, sf, "nation")
    have = n.filter("n_nationkey > 5 and n_nationkey % 2 = 0").select(F.concat(F.lit("voiceover_"), "n_nationkey").alias("name"))
    have = have.unionByName(n.filter("n_nationkey = 0").select(F.lit("voiceover").alias("name")))
    return J.assign_unique(base, have, "base", "o_orderkey").select("o_orderkey", "unique_name")


@query(
    "failure_streak",
    f"""{W}, c AS (SELECT clip_id, ts, host, event_type <> 'error' AS ok, k % 10 = 0 AS sticky FROM renders),
e AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, clip_id) AS ep FROM c),
s AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS streak, sum(CASE WHEN NOT ok AND sticky THEN 1 ELSE 0 END) OVER w AS stuck FROM e
  WINDOW w AS (PARTITION BY host, ep ORDER BY ts, clip_id))
SELECT host, clip_id, CAST(streak AS BIGINT) AS streak, streak < 2 AND stuck = 0 AS healthy FROM s""",
)
def failure_streak(spark, sf):
    calls = renders(spark, sf).select(
        F.col("clip_id").alias("event_id"), "ts", "host", (F.col("event_type") != "error").alias("ok"), (F.col("k") % 10 == 0).alias("sticky")
    )
    return J.failure_streak(calls).select("host", F.col("event_id").alias("clip_id"), "streak", "healthy")


@query("visible_voices", f"WITH {_VOICES} SELECT owner, count(*) AS voices FROM voices WHERE owner IS NULL OR owner = 't1' GROUP BY owner")
def visible_voices(spark, sf):
    return VO.visible_voices(voices(spark, sf), "t1").groupBy("owner").agg(F.count(F.lit(1)).alias("voices"))


@query("list_voices", f"WITH {_VOICES} SELECT voice_id FROM voices WHERE owner IS NULL OR owner = 't2'")
def list_voices(spark, sf):
    return VO.list_voices(voices(spark, sf), "t2")


@query("public_voices", f"WITH {_VOICES} SELECT voice_id, owner, CAST(baseline_wpm AS DOUBLE) AS baseline_wpm, prompt_version, consent FROM voices")
def public_voices(spark, sf):
    return VO.public_voices(voices(spark, sf))


@query(
    "tenant_keys",
    """SELECT 'key' || c_custkey AS api_key, CASE WHEN c_custkey % 4 = 0 THEN 'default' ELSE c_mktsegment END AS tenant FROM customer WHERE c_custkey % 5 > 0""",
)
def tenant_keys(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    key = F.when(k % 5 > 0, F.concat(F.lit(" key"), k, F.lit(" "))).otherwise(" ")
    pair = F.concat(key, F.lit(":"), F.when(k % 4 == 0, " ").otherwise(F.col("c_mktsegment")))
    return VO.tenant_keys(c.select(F.concat(pair, F.lit(", junk,")).alias("conf")))


@query("attach_voice", f"{W}, {_VOICES} SELECT r.tenant, count(*) FILTER (WHERE v.voice_id IS NOT NULL) AS found, count(*) FILTER (WHERE v.voice_id IS NULL) AS rejected FROM renders r LEFT JOIN voices v ON v.voice_id = r.voice_id AND (r.tenant IS NULL OR v.owner IS NULL OR v.owner = r.tenant) GROUP BY r.tenant")
def attach_voice(spark, sf):
    found, rejected = VO.attach_voice(renders(spark, sf).select("clip_id", "voice_id", "tenant"), voices(spark, sf))
    both = found.select("tenant", F.lit(True).alias("ok")).unionByName(rejected.select("tenant", F.lit(False).alias("ok")))
    return both.groupBy("tenant").agg(F.count_if("ok").alias("found"), F.count_if(~F.col("ok")).alias("rejected"))


@query("gate_consent", f"WITH {_VOICES} SELECT consent AS accepted, count(*) AS voices FROM voices GROUP BY consent")
def gate_consent(spark, sf):
    return VO.gate_consent(voices(spark, sf), True).groupBy("accepted").agg(F.count(F.lit(1)).alias("voices"))


@query(
    "decide_reference",
    """WITH d AS (SELECT CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS ref_text, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS heard, doc_id % 3 = 0 AS trimmed, n_chars % 100 / 100.0 AS acc FROM documents),
x AS (SELECT CASE WHEN ref_text = '' THEN 'heard' WHEN trimmed THEN 'replaced_trimmed' WHEN heard = '' THEN 'supplied' WHEN acc >= 0.9 THEN 'supplied' ELSE 'rejected' END AS decision, ref_text, heard FROM d)
SELECT decision, CASE WHEN decision = 'supplied' THEN ref_text WHEN decision <> 'rejected' THEN heard END AS used_text, count(*) AS voices FROM x GROUP BY 1, 2""",
)
def decide_reference(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source", "lang", "n_chars").select(
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")).alias("ref_text"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang")).alias("heard"),
        (F.col("doc_id") % 3 == 0).alias("trimmed"),
        (F.col("n_chars") % 100 / 100.0).alias("word_accuracy"),
    )
    out = VO.decide_reference(d, strict=True)
    return out.groupBy("decision", "used_text").agg(F.count(F.lit(1)).alias("voices"))


@query("stale_voices", f"WITH {_VOICES} SELECT prompt_version, count(*) AS voices FROM voices WHERE prompt_version <> '0.1' GROUP BY 1")
def stale_voices(spark, sf):
    return VO.stale_voices(voices(spark, sf), "0.1").groupBy("prompt_version").agg(F.count(F.lit(1)).alias("voices"))


@query(
    "merge_warnings",
    """SELECT c_custkey, array_to_string(list_concat(CASE WHEN c_custkey % 2 = 0 THEN [c_mktsegment] ELSE [c_mktsegment, 'reference ends without a pause — it may be cut mid-word'] END, ['cut back']), '|') AS merged FROM customer""",
)
def merge_warnings(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.array("c_mktsegment", F.lit("reference ends without a pause — it may be cut mid-word")).alias("warnings"),
        (F.col("c_custkey") % 2 == 0).alias("repaired_mid_word"),
        F.array(F.lit("cut back")).alias("trim_warnings"),
    )
    return VO.merge_warnings(c).select("c_custkey", F.array_join("merged", "|").alias("merged"))


_MSGS = ("CUDA out of memory. Tried to allocate 2 MB", "CUDA error: device-side assert", "cublas_status_alloc_failed", "ValueError: bad text")


@query(
    "classify_error",
    """WITH m AS (SELECT lower(CASE event_id % 4 WHEN 0 THEN 'CUDA out of memory. Tried to allocate 2 MB' WHEN 1 THEN 'CUDA error: device-side assert' WHEN 2 THEN 'cublas_status_alloc_failed' ELSE 'ValueError: bad text' END) AS m FROM events WHERE event_type = 'error')
SELECT m LIKE '%out of memory%' OR m LIKE '%cuda error%' AS is_oom, m LIKE '%out of memory%' OR m LIKE '%cuda error%' OR m LIKE '%alloc_failed%' AS is_allocation,
  m LIKE '%cuda error%' AND NOT m LIKE '%tried to allocate%' AS is_sticky, count(*) AS failures FROM m GROUP BY ALL""",
)
def classify_error(spark, sf):
    ev = table(spark, sf, "events").filter("event_type = 'error'")
    msg = F.element_at(F.array(*[F.lit(m) for m in _MSGS]), (F.col("event_id") % 4 + 1).cast("int"))
    out = H.classify_error(ev.withColumn("message", msg))
    return out.groupBy("is_oom", "is_allocation", "is_sticky").agg(F.count(F.lit(1)).alias("failures"))


def _samples(spark, sf):
    r = renders(spark, sf)
    return r.select(
        F.col("voice_id").alias("run_id"), F.col("clip_id").alias("seq"), "ts", "host", F.lit("cuda").alias("device"),
        (F.col("reserved_mb") - F.col("k")).alias("allocated_mb"), "reserved_mb", F.col("vram_free_mb").alias("free_mb"), "total_mb",
    )


@query("memory_flags", f"{W} SELECT clip_id AS seq, reserved_mb > 8192 * 1.02::DOUBLE AS spilled, round(k::DOUBLE, 1) AS fragmentation_mb FROM renders")
def memory_flags(spark, sf):
    return H.with_memory_flags(_samples(spark, sf)).select("seq", "spilled", "fragmentation_mb")


@query("soak_growth", f"{W} SELECT voice_id AS run_id, arg_max(reserved_mb, clip_id)::DOUBLE - arg_min(reserved_mb, clip_id)::DOUBLE AS grew_mb, min(vram_free_mb)::DOUBLE AS lowest_free_mb, arg_max(reserved_mb, clip_id) - arg_min(reserved_mb, clip_id) > 200 AS leak FROM renders GROUP BY 1")
def soak_growth(spark, sf):
    return H.soak_growth(_samples(spark, sf)).select("run_id", "grew_mb", "lowest_free_mb", "leak")


_NOW = "2024-01-31 00:00:00"


@query(
    "readiness",
    f"""{W}, s AS (SELECT host, arg_max(vram_free_mb, ts) AS free, arg_max(reserved_mb, ts) AS res FROM renders GROUP BY host),
t AS (SELECT host, arg_max(event_type <> 'error', ts) AS ok, max(ts) AS tested FROM renders GROUP BY host)
SELECT s.host, ok AND epoch(TIMESTAMP '{_NOW}') - epoch(tested) <= 3600 AND free >= 700 AND res <= 8192 * 1.02 AS ready, round(epoch(TIMESTAMP '{_NOW}') - epoch(tested), 1) AS age_s,
  CASE WHEN res > 8192 * 1.02 THEN 'VRAM has spilled into system memory; restart the server' ELSE '' END AS reason FROM s JOIN t ON s.host = t.host""",
)
def readiness(spark, sf):
    r = renders(spark, sf)
    tests = r.select("host", "ts", (F.col("event_type") != "error").alias("ok"))
    return H.readiness(_samples(spark, sf), tests, F.lit(_NOW).cast("timestamp"), stale_s=3600.0)


@query(
    "check_expectations",
    "SELECT source AS probe, count(*) FILTER (WHERE contains(lower(text), 'the')) AS passed, count(*) AS texts FROM documents GROUP BY source",
)
def check_expectations(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("probe"), "text")
    rules = docs.select("probe").distinct().withColumn("expected", F.array(F.lit("THE")))
    out = H.check_expectations(docs, rules)
    return out.groupBy("probe").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("texts"))


@query("loudness_spread", f"{W} SELECT voice_id, (max(-20.0 + (k % 9 - 4) / 2.0) - min(-20.0 + (k % 9 - 4) / 2.0))::DOUBLE AS spread, count(*) AS n, CASE WHEN count(*) >= 2 THEN max(-20.0 + (k % 9 - 4) / 2.0) - min(-20.0 + (k % 9 - 4) / 2.0) < 1.5 END AS passed FROM renders GROUP BY 1")
def loudness_spread(spark, sf):
    loud = _loud(spark, sf).join(renders(spark, sf).select("clip_id", "voice_id"), "clip_id")
    return H.spread_check(loud, "out_lufs", 1.5, "voice_id")


@query("memory_checks", f"{W}, f AS (SELECT voice_id AS run_id, arg_min({{'a': reserved_mb - k, 'r': reserved_mb, 'k': k}}, clip_id) AS b, arg_max({{'a': reserved_mb - k, 'r': reserved_mb, 'k': k}}, clip_id) AS e FROM renders GROUP BY 1) SELECT run_id, e.a - b.a < 100 AS no_accumulation, e.r - b.r < 400 AS no_hoarding, e.k < 800 AS not_fragmenting FROM f")
def memory_checks(spark, sf):
    s = H.with_memory_flags(_samples(spark, sf))
    row = F.struct("allocated_mb", "reserved_mb", "fragmentation_mb")
    both = s.groupBy("run_id").agg(F.min_by(row, "seq").alias("b"), F.max_by(row, "seq").alias("e"))
    return H.memory_checks(both.select("run_id", "b.*"), both.select("run_id", "e.*"))


@query("seed_checks", f"""{W}, c AS (SELECT event_type AS script_id, k % 5 AS seed, CASE WHEN k % 5 = 0 THEN k::VARCHAR ELSE 'seed' || k % 5 END AS sha FROM renders),
p AS (SELECT script_id, seed, min(sha) AS lo, max(sha) AS hi FROM c GROUP BY ALL)
SELECT script_id, bool_and(lo = hi) AS same_seed_same_audio, count(DISTINCT lo) = count(*) AS seeds_differ FROM p GROUP BY 1""")
def seed_checks(spark, sf):
    k = F.col("k")
    clips = renders(spark, sf).select(
        F.col("event_type").alias("script_id"), (k % 5).alias("seed"),
        F.when(k % 5 == 0, k.cast("string")).otherwise(F.concat(F.lit("seed"), k % 5)).alias("audio_sha256"),
    )
    return H.seed_checks(clips)


@query("check_tally", f"{W} SELECT count(*) FILTER (WHERE redone = 0) AS passed, count(*) FILTER (WHERE redone = 1 AND k > 50) AS failed, count(*) FILTER (WHERE redone > 1) AS skipped FROM renders")
def check_tally(spark, sf):
    redone = F.size("regen_chunks")
    res = renders(spark, sf).select(F.when(redone == 0, "PASS").when(redone == 1, "FAIL").otherwise("SKIP").alias("outcome"), (F.col("k") > 50).alias("required"))
    return H.check_tally(res)
