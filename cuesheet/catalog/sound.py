"""Queries over sample blocks and timbre vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.catalog.base import RENDERS_SQL, long, renders, spread, table
from cuesheet.functions import audio as A
from cuesheet.operators import edits as E
from cuesheet.operators import frames as FR
from cuesheet.operators import lab as L
from cuesheet.session import materialize

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


# Four vectors make one clip of 256 samples at 400 Hz: a frame is 8 samples, a
# block 8 frames.  Part of every clip is digital silence, across blocks in the
# even clips.
BLOCK, FRAMES_PER_BLOCK = 64, 8


def blocks(spark, sf):
    e = spread(table(spark, sf, "embeddings"))
    clip, block = F.floor(F.col("vec_id") / 4), (F.col("vec_id") % 4).cast("int")
    even = F.col("vec_id") % 8 < 4

    def sample(x, i):
        wide = even & (((block == 1) & (i >= 24)) | ((block == 2) & (i < 16)))
        narrow = ~even & (block == 1) & (i >= 24) & (i < 40)
        return F.when(wide | narrow, F.lit(0.0).cast("float")).otherwise(x)

    return e.select(
        clip.alias("clip_id"),
        F.concat(F.lit("v"), F.col("label")).alias("voice_id"),
        F.lit(400).alias("sr"),
        block.alias("block_no"),
        F.transform("embedding", sample).alias("samples"),
    )


SOUND = """s0 AS (SELECT vec_id // 4 AS clip_id, vec_id % 4 AS b, vec_id % 8 < 4 AS even, i - 1 AS i, embedding[i]::DOUBLE AS x
  FROM embeddings, range(1, 65) r(i)),
s AS (SELECT clip_id, b, b * 64 + i AS pos, CASE WHEN (even AND ((b = 1 AND i >= 24) OR (b = 2 AND i < 16))) OR (NOT even AND b = 1 AND i >= 24 AND i < 40) THEN 0 ELSE x END AS x FROM s0),
fr AS (SELECT clip_id, pos // 8 AS f, sum(x * x) AS ss, 20 * log10(greatest(sqrt(sum(x * x) / 8), 1e-12)) AS db FROM s GROUP BY ALL),
thr AS (SELECT clip_id, greatest(-60, quantile_cont(db, 0.95) - 35) AS thr FROM fr GROUP BY clip_id),
ft AS (SELECT fr.*, thr, db <= thr AS quiet FROM fr JOIN thr USING (clip_id)),
runs AS (SELECT clip_id, min(f) AS a, max(f) + 1 AS e FROM (SELECT clip_id, f, f - row_number() OVER (PARTITION BY clip_id ORDER BY f) AS g FROM ft WHERE quiet) GROUP BY clip_id, g)"""
WS = f"WITH {SOUND}"


def _frames(spark, sf):
    """Written once: thresholds, runs and sums all read the frames again."""
    return materialize(FR.frames(blocks(spark, sf), block_frames=FRAMES_PER_BLOCK), "frames")


def _rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query("frames", f"{WS} SELECT clip_id, f AS frame_no, round(db, 6) AS db, round(ss, 6) AS sumsq FROM fr")
def frames(spark, sf):
    fr = FR.frames(blocks(spark, sf), block_frames=FRAMES_PER_BLOCK)
    return _rounded(fr.select("clip_id", "frame_no", "db", "sumsq"), "db", "sumsq")


@query("conform_samples", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE * 20000) / 32768)), 4) AS total,
  round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE + x::DOUBLE * 0.5) / 2)), 3) AS mono_total FROM embeddings""")
def conform(spark, sf):
    """int16 samples to floats, and two channels to one."""
    e = spread(table(spark, sf, "embeddings", "vec_id", "embedding"))
    ints = e.withColumn("left", F.transform("embedding", lambda x: F.round(x.cast("double") * 20000).cast("smallint")))
    half = F.transform("embedding", lambda x: x.cast("double") * 0.5)
    both = FR.to_mono_float(ints, "int16").withColumnRenamed("samples", "ints").withColumn("l", F.transform("embedding", lambda x: x.cast("double"))).withColumn("r", half)
    out = FR.to_mono_float(both, "float", "l", "r")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("vec_id", F.round(total("ints"), 4).alias("total"), F.round(total("samples"), 3).alias("mono_total"))


@query("to_int16", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: trunc(greatest(least(x * 3::FLOAT, 1::FLOAT), -1::FLOAT) * 32767::FLOAT)::BIGINT)) AS BIGINT) AS total FROM embeddings")
def to_int16(spark, sf):
    e = spread(table(spark, sf, "embeddings", "vec_id", "embedding"))
    loud = F.transform("embedding", lambda x: x * F.lit(3.0).cast("float"))
    return e.select("vec_id", F.aggregate(A.to_int16(loud), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total"))


@query("silence_threshold", f"{WS} SELECT clip_id, round(thr, 6) AS thr FROM thr")
def silence_threshold(spark, sf):
    return _rounded(FR.silence_threshold(_frames(spark, sf)), "thr")


@query("speech_rms", f"{WS} SELECT clip_id, round(20 * log10(greatest(sqrt(coalesce(sum(ss) FILTER (WHERE db > thr) / (8 * count(*) FILTER (WHERE db > thr)), sum(ss) / (8 * count(*)))), 1e-12)), 6) AS speech_db FROM ft GROUP BY clip_id")
def speech_rms(spark, sf):
    fr = _frames(spark, sf)
    return _rounded(FR.speech_rms(fr, FR.silence_threshold(fr)), "speech_db")


@query("clip_levels", f"{WS} SELECT clip_id, count(*) AS samples_n, count(*) / 400.0::DOUBLE AS duration_sec, round(20 * log10(greatest(max(abs(x)), 1e-12)), 6) AS peak_db, count(*) FILTER (WHERE abs(x) > 0.99) / count(*) AS clipping_ratio FROM s GROUP BY clip_id")
def clip_levels(spark, sf):
    out = FR.clip_levels(blocks(spark, sf))
    return _rounded(out.select("clip_id", "samples_n", "duration_sec", "peak_db", "clipping_ratio"), "peak_db")


@query("clip_duration", f"{WS} SELECT clip_id, count(*) / 400.0::DOUBLE AS duration_sec, round(count(*) / 400.0::DOUBLE - 0.3, 6) AS speech_sec FROM s GROUP BY clip_id")
def clip_duration(spark, sf):
    return _rounded(FR.clip_duration(blocks(spark, sf), 0.3), "speech_sec")


@query("snr", f"{WS} SELECT clip_id, round_even(quantile_cont(db, 0.9) - quantile_cont(db, 0.1), 1) AS snr_db FROM fr GROUP BY clip_id")
def snr(spark, sf):
    return FR.snr(_frames(spark, sf))


@query("silent_runs", f"{WS} SELECT clip_id, a AS start_frame, e AS end_frame FROM runs")
def silent_runs(spark, sf):
    fr = _frames(spark, sf)
    return FR.silent_runs(fr, FR.silence_threshold(fr))


@query("edge_silence", f"{WS} SELECT clip_id, round(min(f) FILTER (WHERE NOT quiet) * 0.02::DOUBLE, 6) AS leading_sec, round((max(f) - max(f) FILTER (WHERE NOT quiet)) * 0.02::DOUBLE, 6) AS trailing_sec FROM ft GROUP BY clip_id")
def edge_silence(spark, sf):
    fr = _frames(spark, sf)
    return _rounded(FR.edge_silence(fr, FR.silence_threshold(fr)).select("clip_id", "leading_sec", "trailing_sec"), "leading_sec", "trailing_sec")


_ZERO = """z AS (SELECT clip_id, min(pos) AS a, max(pos) + 1 AS b FROM (SELECT clip_id, pos, pos - row_number() OVER (PARTITION BY clip_id ORDER BY pos) AS g FROM s WHERE x = 0) GROUP BY clip_id, g)"""


@query("zero_runs", f"{WS}, {_ZERO} SELECT clip_id, a AS start_sample, b AS end_sample FROM z")
def zero_runs(spark, sf):
    return FR.zero_runs(blocks(spark, sf), BLOCK).select("clip_id", "start_sample", "end_sample")


@query(
    "split_on_zeros",
    f"""{WS}, {_ZERO}, n AS (SELECT clip_id, count(*) AS n FROM s GROUP BY clip_id),
stops AS (SELECT clip_id, a AS stop, b AS nxt FROM z WHERE b - a >= floor(0.8 * 0.15 * 400) UNION ALL SELECT clip_id, n, n FROM n),
sp AS (SELECT clip_id, coalesce(lag(nxt) OVER (PARTITION BY clip_id ORDER BY stop, nxt), 0) AS start_sample, stop AS end_sample FROM stops)
SELECT clip_id, start_sample, end_sample FROM sp WHERE end_sample - start_sample > 20""",
)
def split_on_zeros(spark, sf):
    return FR.split_on_zeros(blocks(spark, sf), BLOCK).select("clip_id", "start_sample", "end_sample")


_LUFS = """hop AS (SELECT clip_id, f // 5 AS h, sum(ss) AS ss, count(*) AS c FROM fr GROUP BY ALL HAVING count(*) = 5),
blk AS (SELECT clip_id, h, sum(ss) OVER w / 160 AS z, count(*) OVER w AS c FROM hop WINDOW w AS (PARTITION BY clip_id ORDER BY h ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
zz AS (SELECT clip_id, z, -0.691 + 10 * log10(greatest(z, 1e-12)) AS l FROM blk WHERE c = 4),
gate AS (SELECT clip_id, -0.691 + 10 * log10(greatest(avg(z), 1e-12)) - 10 AS g FROM zz WHERE l > -70 GROUP BY clip_id),
lufs AS (SELECT zz.clip_id, -0.691 + 10 * log10(greatest(avg(z), 1e-12)) AS lufs FROM zz JOIN gate USING (clip_id) WHERE l > -70 AND l > g GROUP BY zz.clip_id)"""


@query("gated_loudness", f"{WS}, {_LUFS} SELECT clip_id, round(lufs, 6) AS lufs FROM lufs")
def gated_loudness(spark, sf):
    return _rounded(FR.gated_loudness(_frames(spark, sf)), "lufs")


@query("ends_abruptly", f"{WS} SELECT clip_id, 20 * log10(greatest(sqrt(sum(x * x) / 100), 1e-12)) > -35 AS ends_abruptly FROM s WHERE pos >= 156 GROUP BY clip_id")
def ends_abruptly(spark, sf):
    return FR.ends_abruptly(blocks(spark, sf), BLOCK)


@query("quality_report", f"""{WS}, st AS (SELECT clip_id, round_even(quantile_cont(db, 0.9) - quantile_cont(db, 0.1), 1) AS snr,
  round_even((max(f) - max(f) FILTER (WHERE NOT quiet)) * 0.02, 3) AS tail FROM ft GROUP BY clip_id)
SELECT clip_id, CAST(1 + CASE WHEN snr < 15 THEN 1 ELSE 0 END + CASE WHEN tail < 0.05 THEN 1 ELSE 0 END AS BIGINT) AS n_warnings,
  round_even(1.0::DOUBLE - 0.25 - CASE WHEN snr < 15 THEN 0.25 ELSE 0 END - CASE WHEN tail < 0.05 THEN 0.15::DOUBLE ELSE 0 END, 2) AS quality_score FROM st""")
def quality_report(spark, sf):
    out = FR.quality_report(FR.clip_stats(blocks(spark, sf), FRAMES_PER_BLOCK))
    return out.select("clip_id", long(F.size("warnings")).alias("n_warnings"), "quality_score")


@query("last_pause", f"{WS} SELECT clip_id, max(a) AS cut_frame FROM runs WHERE e - a >= 5 AND a > 0 AND a >= 4 GROUP BY clip_id")
def last_pause(spark, sf):
    fr = _frames(spark, sf)
    return FR.last_pause(FR.silent_runs(fr, FR.silence_threshold(fr)), 4, 5)


@query("first_pause", f"{WS} SELECT clip_id, min(e) AS lead_frame FROM runs WHERE e - a >= 2 AND a > 0 AND e <= 30 AND e < 32 GROUP BY clip_id")
def first_pause(spark, sf):
    fr = _frames(spark, sf)
    ends = fr.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"))
    return FR.first_pause(FR.silent_runs(fr, FR.silence_threshold(fr)), ends, 30, 2)


@query("nearest_pause", f"{WS} SELECT clip_id, arg_min(a, CASE WHEN a <= 13 THEN 13 - a ELSE (a - 13) * 1.25 END * 1000 + a) AS cut_frame FROM runs WHERE e - a >= 2 AND a > 0 AND a >= 3 GROUP BY clip_id")
def nearest_pause(spark, sf):
    fr = _frames(spark, sf)
    return FR.nearest_pause(FR.silent_runs(fr, FR.silence_threshold(fr)), 13, 3, 2)


@query("gain_plan", f"""{WS}, {_LUFS}, p AS (SELECT clip_id, 20 * log10(greatest(max(abs(x)), 1e-12)) AS peak FROM s GROUP BY clip_id),
g AS (SELECT clip_id, lufs, peak, -6 - lufs AS want, least(greatest(-6 - lufs, -24), 24) AS g FROM lufs JOIN p USING (clip_id)),
o AS (SELECT *, greatest(peak + g + 1, 0) AS over FROM g)
SELECT clip_id, round_even(lufs, 2) AS in_lufs, round_even(g - over, 2) AS gain_db, abs(lufs + g - over + 6) < 1.5 AS met_target,
  CASE WHEN over > 0 THEN 'peak_ceiling' WHEN abs(g - want) > 0.05 THEN 'gain_cap' END AS limited_by FROM o""")
def gain_plan(spark, sf):
    b = blocks(spark, sf)
    out = E.gain_plan(FR.gated_loudness(FR.frames(b, block_frames=FRAMES_PER_BLOCK)), FR.clip_levels(b), target=-6.0)
    return out.select("clip_id", "in_lufs", "gain_db", "met_target", "limited_by")


@query("tail_segment")
def tail_segment(spark, sf):
    return E.tail_segment(_frames(spark, sf), min_gap_frames=2, min_keep_sec=0.1)


@query("reference_cut_plan")
def reference_cut_plan(spark, sf):
    plan = E.reference_cut_plan(blocks(spark, sf), max_sec=0.3, hard_max_sec=0.6, min_keep_sec=0.1, block_frames=FRAMES_PER_BLOCK)
    return plan.select("clip_id", "start_sample", "end_sample", "trimmed", "cut_at_pause", "ends_mid_word", "cut_sec")


@query("apply_cut")
def apply_cut(spark, sf):
    b = blocks(spark, sf)
    plan = E.reference_cut_plan(b, max_sec=0.3, hard_max_sec=0.6, min_keep_sec=0.1, block_frames=FRAMES_PER_BLOCK)
    out = E.apply_cut(b, plan, BLOCK)
    return _rounded(out.groupBy("clip_id").agg(F.sum(F.size("samples")).alias("samples_n"), F.sum(A.sum_squares(F.col("samples"))).alias("energy")), "energy", places=5)


def _levels(spark, sf):
    """Voices as clips and their four-block clips as chunks."""
    b = blocks(spark, sf)
    fr = FR.frames(b, block_frames=FRAMES_PER_BLOCK)
    lv = FR.speech_rms(fr, FR.silence_threshold(fr))
    return lv.select(F.col("clip_id").alias("chunk_no"), (F.col("clip_id") % 10).alias("clip_id"), (F.col("speech_db") + F.col("clip_id") % 7).alias("speech_db"))


@query("match_levels", f"""{WS}, lv AS (SELECT clip_id AS chunk_no, clip_id % 10 AS clip_id, 20 * log10(greatest(sqrt(sum(ss) FILTER (WHERE NOT quiet) / (8 * count(*) FILTER (WHERE NOT quiet))), 1e-12)) + clip_id % 7 AS db FROM ft GROUP BY clip_id),
m AS (SELECT clip_id, quantile_cont(db, 0.5) AS mid FROM lv GROUP BY clip_id)
SELECT lv.clip_id, chunk_no, CASE WHEN abs(mid - db) <= 1.5 THEN 0 ELSE round_even(sign(mid - db) * least(abs(mid - db) - 1.5, 6), 2) END AS correction_db FROM lv JOIN m USING (clip_id)""")
def match_levels(spark, sf):
    return E.match_levels(_levels(spark, sf)).select("clip_id", "chunk_no", "correction_db")


@query("join_timeline", """WITH c AS (SELECT l_orderkey AS clip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS chunk_no, CAST(l_quantity * 1000 AS BIGINT) AS n FROM lineitem),
t AS (SELECT *, sum(n + 3600) OVER (PARTITION BY clip_id ORDER BY chunk_no) - n - 3600 AS start_sample, sum(n + 3600) OVER (PARTITION BY clip_id) - 3600 AS total FROM c)
SELECT clip_id, chunk_no, CAST(start_sample AS BIGINT) AS start_sample, round_even(total / 24000.0::DOUBLE, 3) AS speech_sec, round_even((total + 7200) / 24000.0::DOUBLE, 3) AS total_sec FROM t""")
def join_timeline(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("clip_id"), (F.row_number().over(w) - 1).cast("long").alias("chunk_no"), F.lit(24000).alias("sr"), (F.col("l_quantity") * 1000).cast("long").alias("n_samples")
    )
    return E.join_timeline(li)


def _requests(spark, sf):
    clips = blocks(spark, sf).groupBy("clip_id").agg(F.first("voice_id").alias("voice_id"))
    k = F.col("clip_id")
    return clips.select(
        "clip_id", F.when(k % 3 == 0, "Narrator").otherwise(F.col("voice_id")).alias("name"),
        F.when(k % 2 == 0, "the words").alias("ref_text"), F.when(k % 5 > 0, "heard words").alias("heard"),
        (k % 11 / 10.0).alias("word_accuracy"), (k % 9).alias("words"), F.lit(None).cast("string").alias("owner"), (k % 4 > 0).alias("consent"),
    )


@query("prepare_references")
def prepare_references(spark, sf):
    out = E.prepare_references(blocks(spark, sf), BLOCK, FRAMES_PER_BLOCK)
    return out.select("clip_id", "kept_sec", "quality_score", "out_lufs", "gain_db", F.array_join("warnings", "|").alias("warnings"))


@query("register_voices")
def register_voices(spark, sf):
    have = table(spark, sf, "nation").filter("n_nationkey < 2").select(F.concat(F.lit("Narrator_"), F.col("n_nationkey") + 2).alias("name"))
    out = E.register_voices(blocks(spark, sf), _requests(spark, sf), have, BLOCK, True, True, FRAMES_PER_BLOCK)
    return out.select("clip_id", "voice_id", "accepted", "decision", "baseline_wpm", "quality_score")


def vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    k = F.col("vec_id")
    return v.select((F.floor(k / 40)).alias("rung"), (k % 4).alias("seed"), (F.floor(k / 4) % 10).alias("chunk"), F.col("embedding").alias("vec"))


_VEC = """v AS (SELECT vec_id // 40 AS rung, vec_id % 4 AS seed, vec_id // 4 % 10 AS chunk, embedding AS vec FROM embeddings),
nd AS (SELECT a.chunk, a.seed AS seed_a, b.seed AS seed_b, 1 - list_sum(list_transform(a.vec, lambda x, i: x::DOUBLE * b.vec[i]::DOUBLE)) AS d FROM v a JOIN v b ON a.rung = 0 AND b.rung = 0 AND a.chunk = b.chunk AND a.seed < b.seed),
nn AS (SELECT rung, seed, count(*) AS n FROM v GROUP BY ALL),
rd AS (SELECT a.rung, a.seed, a.chunk, 1 - list_sum(list_transform(a.vec, lambda x, i: x::DOUBLE * b.vec[i]::DOUBLE)) AS d FROM v a JOIN v b ON b.rung = 0 AND a.rung <> 0 AND a.seed = b.seed AND a.chunk = b.chunk
  JOIN nn x ON x.rung = a.rung AND x.seed = a.seed JOIN nn y ON y.rung = 0 AND y.seed = a.seed AND x.n = y.n)"""


@query("null_distances", f"WITH {_VEC} SELECT chunk, seed_a, seed_b, round(d, 6) AS distance FROM nd")
def null_distances(spark, sf):
    out = L.null_distances(vectors(spark, sf), [0, 1, 2, 3])
    return out.select("chunk", long("seed_a").alias("seed_a"), long("seed_b").alias("seed_b"), F.round("distance", 6).alias("distance"))


@query("rung_distances", f"WITH {_VEC} SELECT rung, seed, chunk, round(d, 6) AS distance FROM rd")
def rung_distances(spark, sf):
    return _rounded(L.rung_distances(vectors(spark, sf)), "distance")


def sweep_rows(spark, sf):
    r = renders(spark, sf)
    rung, seed = F.col("clip_id") % 6, F.floor(F.col("clip_id") / 6) % 4
    return r.groupBy(rung.alias("rung"), seed.alias("seed")).agg(
        F.max(F.when(rung.isin(0, 5), 1).otherwise(2 ** rung)).cast("long").alias("batch"),
        F.round(F.avg("gen_sec"), 4).alias("gen_s"),
        F.round(F.avg("k"), 4).alias("wpm"),
        F.round(F.avg("audio_sec"), 4).alias("dur"),
        F.max(F.when((rung == 1) & (F.col("k") == 7), 1).otherwise(0)).cast("long").alias("added"),
        F.lit(0).cast("long").alias("dropped"),
        F.max(F.when((rung == 2) & (F.col("k") == 9), 1).otherwise(0)).cast("long").alias("dead_segments"),
        F.lit(True).alias("finite"),
        F.lit(10).cast("long").alias("n_segments"),
        F.lit(10).cast("long").alias("chunks"),
        F.lit(1.0).alias("word_accuracy"),
        F.round(F.max("k") / 50.0, 4).alias("levelled_max_db"),
    )


_SWEEP = f"""{RENDERS_SQL},
sw AS (SELECT clip_id % 6 AS rung, clip_id // 6 % 4 AS seed, max(CASE WHEN clip_id % 6 IN (0, 5) THEN 1 ELSE 2 ** (clip_id % 6) END)::BIGINT AS batch,
  round(avg(gen_sec), 4) AS gen_s, round(avg(k), 4) AS wpm, round(avg(audio_sec), 4) AS dur, max(CASE WHEN clip_id % 6 = 1 AND k = 7 THEN 1 ELSE 0 END) AS added,
  max(CASE WHEN clip_id % 6 = 2 AND k = 9 THEN 1 ELSE 0 END) AS dead, round(max(k) / 50.0, 4) AS level FROM renders GROUP BY 1, 2)"""


@query("null_stats", f"WITH {_VEC}, {_SWEEP}, b AS (SELECT max(wpm) - min(wpm) AS w, max(dur) - min(dur) AS u FROM sw WHERE rung = 0) SELECT count(*) AS pairs, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS dmax, round(any_value(w), 4) AS wpm_spread, round(any_value(u), 4) AS dur_spread FROM nd, b")
def null_stats(spark, sf):
    out = L.null_stats(L.null_distances(vectors(spark, sf), [0, 1, 2, 3]), sweep_rows(spark, sf).filter("rung = 0"))
    return _rounded(_rounded(out, "p95", "dmax"), "wpm_spread", "dur_spread", places=4)





def _snapshots(spark, sf):
    r = renders(spark, sf)
    rung = (F.col("clip_id") % 6).alias("rung")
    before = r.filter("k < 50").groupBy(rung).agg(F.count_if(F.col("status") == "Error").alias("oom"), F.lit(None).cast("long").alias("reload"))
    after = r.groupBy(rung).agg(F.count_if(F.col("status") == "Error").alias("oom"), F.lit(0).cast("long").alias("reload"))
    return before, after


@query("snapshot_deltas", f"WITH {RENDERS_SQL} SELECT clip_id % 6 AS rung, count(*) FILTER (WHERE status = 'Error' AND k >= 50) AS oom_delta, 0::BIGINT AS reload_delta FROM renders GROUP BY 1")
def snapshot_deltas(spark, sf):
    return L.snapshot_deltas(*_snapshots(spark, sf), ["oom", "reload"])


@query(
    "rung_verdicts",
    f"""WITH {_VEC}, {_SWEEP}, nu AS (SELECT quantile_cont(d, 0.95) AS p95, max(d) AS dmax FROM nd), ws AS (SELECT max(wpm) - min(wpm) AS w, quantile_cont(gen_s, 0.5) AS g, max(level) AS lv FROM sw WHERE rung = 0),
dd AS (SELECT rung, quantile_cont(d, 0.95) AS d95, max(d) AS dm FROM rd GROUP BY rung),
sn AS (SELECT clip_id % 6 AS rung, count(*) FILTER (WHERE status = 'Error' AND clip_id % 6 = 3) AS oom FROM renders GROUP BY 1),
pr AS (SELECT a.rung, max(a.batch) AS batch, sum(a.added) AS added, max(a.dead) AS dead, max(abs(a.wpm - b.wpm)) AS shift, max(a.level) AS level, quantile_cont(a.gen_s, 0.5) AS gen FROM sw a LEFT JOIN sw b ON b.rung = 0 AND b.seed = a.seed GROUP BY a.rung),
f AS (SELECT pr.rung, batch, gen, list_filter([CASE WHEN oom <> 0 THEN 'oom/masked' END, CASE WHEN pr.rung = 4 THEN 'vram' END, CASE WHEN added > 0 THEN 'words' END, CASE WHEN dead > 0 THEN 'dead-chunk' END,
  CASE WHEN batch > 1 AND d95 IS NULL THEN 'no-audio-comparison' END, CASE WHEN batch > 1 AND d95 > p95 THEN 'timbre-p95' END, CASE WHEN batch > 1 AND dm > nu.dmax THEN 'timbre-max' END,
  CASE WHEN batch > 1 AND shift > w THEN 'wpm' END, CASE WHEN batch > 1 AND level > lv + 1.5 THEN 'level' END, CASE WHEN batch > 1 AND g / gen < 1.05 THEN 'no-win' END], lambda x: x IS NOT NULL) AS fails
  FROM pr LEFT JOIN dd USING (rung) LEFT JOIN sn USING (rung), nu, ws)
SELECT rung, round(gen, 4) AS gen_s, array_to_string(fails, ',') AS fails, CASE WHEN len(fails) > 0 THEN 'REJECT' WHEN batch = 1 THEN 'baseline' ELSE 'ADOPT' END AS verdict FROM f""",
)
def rung_verdicts(spark, sf):
    rows, vecs = sweep_rows(spark, sf), vectors(spark, sf)
    nulls = L.null_stats(L.null_distances(vecs, [0, 1, 2, 3]), rows.filter("rung = 0"))
    rung = F.col("clip_id") % 6
    snaps = renders(spark, sf).groupBy(rung.alias("rung")).agg(
        F.count_if((F.col("status") == "Error") & (rung == 3)).alias("oom_delta"), F.lit(0).alias("reload_delta"), F.lit(True).alias("generation_ok"),
        F.max(F.when(rung == 4, 6000.0).otherwise(3000.0)).alias("peak_mb"), F.lit(8192.0).alias("total_mb"),
    )
    out = L.rung_verdicts(rows, L.rung_distances(vecs), nulls, snaps)
    return out.select("rung", F.round("gen_s", 4).alias("gen_s"), F.array_join("fails", ",").alias("fails"), "verdict")


@query("drift_check", f"WITH {_SWEEP}, m AS (SELECT quantile_cont(gen_s, 0.5) FILTER (WHERE rung = 0) AS a, quantile_cont(gen_s, 0.5) FILTER (WHERE rung = 5) AS b FROM sw) SELECT round(a, 5) AS first_s, round(b, 5) AS last_s, round(abs(b - a) / a, 5) AS drift, abs(b - a) / a > 0.03 AS unstable FROM m")
def drift_check(spark, sf):
    return _rounded(L.drift_check(sweep_rows(spark, sf), 0, 5), "first_s", "last_s", "drift", places=5)


@query("rtf_ladder", f"""WITH {RENDERS_SQL}, r AS (SELECT CASE k % 5 WHEN 0 THEN 12 WHEN 1 THEN 30 WHEN 2 THEN 60 WHEN 3 THEN 120 ELSE 240 END AS words, audio_sec, gen_sec FROM renders WHERE status = 'Done'),
g AS (SELECT words::VARCHAR AS rung, * FROM r UNION ALL SELECT 'all', * FROM r UNION ALL SELECT '60+', * FROM r WHERE words >= 60)
SELECT rung, count(*) AS runs, round(sum(audio_sec), 3) AS audio_sec, round_even(sum(gen_sec) / sum(audio_sec), 3) AS rtf FROM g GROUP BY rung""")
def rtf_ladder(spark, sf):
    words = F.element_at(F.array(*[F.lit(w) for w in L.RUNGS]), F.col("k") % 5 + 1)
    done = F.col("status") == "Done"
    rows = renders(spark, sf).select(words.alias("words"), F.when(done, F.col("audio_sec")).alias("audio_sec"), "gen_sec")
    return _rounded(L.rtf_ladder(rows), "audio_sec", places=3).select("rung", "runs", "audio_sec", "rtf")


@query("segment_health", f"""{WS}, g AS (SELECT clip_id, b, round_even(20 * log10(greatest(sqrt(sum(x * x) / 64), 1e-9)), 1) AS db FROM s GROUP BY ALL)
SELECT clip_id, count(*) AS n_segments, count(*) FILTER (WHERE db < -60) AS dead_segments, TRUE AS finite, min(db) AS quietest_db, count(*) = 4 AS count_ok FROM g GROUP BY clip_id""")
def segment_health(spark, sf):
    b = blocks(spark, sf)
    want = b.select("clip_id").distinct().withColumn("chunks", F.lit(4))
    out = L.segment_health(b.withColumnRenamed("block_no", "segment_no"), want)
    return out.drop("chunks")


@query("cosine_distance", "WITH c AS (SELECT label, any_value(embedding ORDER BY vec_id) AS base FROM embeddings GROUP BY label) SELECT e.vec_id, round(1 - list_sum(list_transform(e.embedding, lambda x, i: x::DOUBLE * c.base[i]::DOUBLE)), 6) + 0.0::DOUBLE AS distance FROM embeddings e JOIN c USING (label)")
def cosine_distance(spark, sf):
    e = table(spark, sf, "embeddings")
    base = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    return e.join(base, "label").select("vec_id", (F.round(A.cosine_distance(F.col("embedding"), F.col("base")), 6) + F.lit(0.0)).alias("distance"))
