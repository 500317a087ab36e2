"""Frame analytics over sample blocks.

A clip is many block rows ``(clip_id, sr, block_no, samples)``; every block but
the last holds the same whole number of frames.  No step gathers a clip: frame
energies are made inside the block row, percentiles and runs go through the
ranged helpers of :mod:`cuesheet.plans.ordered`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions import audio as A
from cuesheet.plans.ordered import by_range, grouped_percentiles, islands, prefix_sum
from cuesheet.session import materialize

KEY = ["clip_id"]
BLOCK_FRAMES = 50


def to_mono_float(df: DataFrame, kind: str = "float", left: str = "left", right: str | None = None) -> DataFrame:
    """Add ``samples``: mono, within ±1, from float, int16 or int32 channels."""
    scale = {"float": lambda c: F.transform(c, lambda x: x.cast("float")), "int16": A.int16_to_float, "int32": A.int32_to_float}
    raw = F.col(left) if right is None else A.mono(F.col(left), F.col(right))
    return df.withColumn("samples", scale[kind](raw))


def frames(blocks: DataFrame, frame_ms: float = 20.0, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """``(clip_id, frame_no, db, sumsq, n)``; a ragged tail is left out.

    A clip of less than one frame is one frame of its ``n`` samples.
    """
    staged = blocks.withColumn("__f", A.frame_len(F.col("sr"), frame_ms))
    count = F.floor(F.size("samples") / F.col("__f")).cast("int")
    cut = lambda i: A.sum_squares(F.slice("samples", i * F.col("__f") + 1, F.col("__f")))
    # only the first block can be shorter than a frame without being a ragged tail
    sums = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), cut)).when(F.col("block_no") == 0, F.array(A.sum_squares(F.col("samples"))))
    used = F.when(count > 0, F.col("__f")).otherwise(F.size("samples")).alias("__n")
    rows = staged.select("clip_id", "sr", "block_no", used, F.posexplode(sums).alias("i", "sumsq"))
    return rows.select(
        "clip_id",
        "sr",
        (F.col("block_no") * block_frames + F.col("i")).cast("long").alias("frame_no"),
        A.db(F.sqrt(F.col("sumsq") / F.greatest("__n", F.lit(1)))).alias("db"),
        "sumsq",
        F.col("__n").alias("n"),
    )


def silence_threshold(fr: DataFrame, drop: float = 35.0, floor: float = -60.0) -> DataFrame:
    """Speech-relative threshold per clip from the 95th percentile."""
    top = grouped_percentiles(fr, KEY, "db", {"top": 0.95})
    return top.select("clip_id", F.greatest(F.lit(floor), F.col("top") - drop).alias("thr"))


def with_threshold(fr: DataFrame, drop: float = 35.0) -> DataFrame:
    return fr.join(silence_threshold(fr, drop), "clip_id")


def speech_rms(fr: DataFrame, thresholds: DataFrame) -> DataFrame:
    """RMS over speech frames; over the whole clip when there are none."""
    loud = F.col("db") > F.col("thr")
    sums = fr.join(thresholds, "clip_id").groupBy("clip_id").agg(
        F.sum(F.when(loud, F.col("sumsq"))).alias("s"), F.sum(F.when(loud, F.col("n"))).alias("n"),
        F.sum("sumsq").alias("s_all"), F.sum("n").alias("n_all"),
    )
    mean = F.coalesce(F.col("s") / F.col("n"), F.col("s_all") / F.col("n_all"))
    return sums.select("clip_id", A.db(F.sqrt(mean)).alias("speech_db"))


def clip_levels(blocks: DataFrame) -> DataFrame:
    """Duration, peak in dB and share of clipped samples."""
    size = F.transform("samples", lambda x: F.abs(x.cast("double")))
    per = blocks.select("clip_id", "sr", size.alias("a")).select(
        "clip_id", "sr", F.size("a").cast("long").alias("n"), F.array_max("a").alias("peak"),
        F.size(F.filter("a", lambda x: x > 0.99)).alias("hot"),
    )
    out = per.groupBy("clip_id").agg(
        F.first("sr").alias("sr"), F.sum("n").alias("samples_n"), F.max("peak").alias("peak"), F.sum("hot").alias("hot")
    )
    return out.select(
        "clip_id",
        "sr",
        "samples_n",
        (F.col("samples_n") / F.col("sr")).alias("duration_sec"),
        A.db(F.col("peak")).alias("peak_db"),
        (F.col("hot") / F.col("samples_n")).alias("clipping_ratio"),
    )


def clip_duration(blocks: DataFrame, pad_sec: float = 0.0) -> DataFrame:
    """Seconds of audio, and of speech without the tail padding."""
    out = blocks.groupBy("clip_id").agg((F.sum(F.size("samples")) / F.first("sr")).alias("duration_sec"))
    return out.withColumn("speech_sec", F.greatest(F.col("duration_sec") - pad_sec, F.lit(0.0)))


def snr(fr: DataFrame) -> DataFrame:
    """Spread between loud and quiet frames; 99 for very short clips."""
    spread = grouped_percentiles(fr, KEY, "db", {"noise": 0.10, "speech": 0.90})
    size = fr.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), (F.sum("n") / F.first("sr")).alias("sec"))
    short = (F.col("sec") < 0.25) | (F.col("frames") < 5)
    value = F.when(short, 99.0).otherwise(F.bround(F.col("speech") - F.col("noise"), 1))
    return spread.join(size, "clip_id").select("clip_id", value.alias("snr_db"))


def silent_runs(fr: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Maximal runs of frames at or below the threshold."""
    return islands(fr.join(thresholds, "clip_id"), KEY, "frame_no", F.col("db") <= F.col("thr"))


def edge_silence(fr: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Silent frames before the first and after the last speech frame."""
    loud = F.when(F.col("db") > F.col("thr"), F.col("frame_no"))
    out = fr.join(thresholds, "clip_id").groupBy("clip_id").agg(
        F.min("frame_no").alias("lo"), (F.max("frame_no") + 1).alias("hi"), F.min(loud).alias("first"), F.max(loud).alias("last"),
        F.first("n").alias("n"), F.first("sr").alias("sr"),
    )
    seconds = lambda fs: fs * F.col("n") / F.col("sr")
    return out.select(
        "clip_id",
        F.col("first").alias("first_speech"),
        F.col("last").alias("last_speech"),
        seconds(F.coalesce(F.col("first"), F.col("hi")) - F.col("lo")).alias("leading_sec"),
        seconds(F.col("hi") - F.coalesce(F.col("last") + 1, F.col("lo"))).alias("trailing_sec"),
    )


def zero_runs(blocks: DataFrame, block_len: int) -> DataFrame:
    """Maximal runs of exact zeros, in samples, joined across blocks.

    Runs are cut inside each block row first.  Touching runs of neighbouring
    blocks share ``start - samples of the runs before``, which names the run.
    """
    zero = lambda i: F.coalesce(F.get("samples", i) == 0, F.lit(False))
    at = F.sequence(F.lit(0), F.size("samples") - 1)
    starts = F.filter(at, lambda i: zero(i) & ~(zero(i - 1) & (i > 0)))
    ends = F.transform(F.filter(at, lambda i: zero(i) & ~zero(i + 1)), lambda i: i + 1)
    local = blocks.filter(F.size("samples") > 0).select(
        "clip_id", "sr", (F.col("block_no") * block_len).cast("long").alias("base"), F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("r")
    )
    runs = local.select("clip_id", "sr", (F.col("base") + F.col("r.a")).alias("a"), (F.col("base") + F.col("r.b")).alias("b"))
    length = F.col("b") - F.col("a")
    summed = prefix_sum(runs, KEY, "a", length, "__upto", by_range("a", 16_777_216))
    return summed.groupBy("clip_id", (F.col("b") - F.col("__upto")).alias("__run")).agg(
        F.first("sr").alias("sr"), F.min("a").alias("start_sample"), F.max("b").alias("end_sample")
    ).drop("__run")


def split_on_zeros(blocks: DataFrame, block_len: int, gap: float = 0.15, min_sec: float = 0.05) -> DataFrame:
    """Segments of a joined clip between long enough runs of digital zero."""
    cuts = zero_runs(blocks, block_len).filter(
        F.col("end_sample") - F.col("start_sample") >= F.floor(F.lit(0.80 * gap) * F.col("sr"))
    )
    total = blocks.groupBy("clip_id").agg(F.first("sr").alias("sr"), F.sum(F.size("samples")).cast("long").alias("n"))
    stops = cuts.select("clip_id", "sr", F.col("start_sample").alias("stop"), F.col("end_sample").alias("next"))
    stops = stops.unionByName(total.select("clip_id", "sr", F.col("n").alias("stop"), F.col("n").alias("next")))
    order = Window.partitionBy("clip_id").orderBy("stop", "next")
    spans = stops.withColumn("start_sample", F.coalesce(F.lag("next").over(order), F.lit(0)))
    kept = spans.filter(F.col("stop") - F.col("start_sample") > F.floor(F.lit(min_sec) * F.col("sr")))
    return kept.select("clip_id", "sr", "start_sample", F.col("stop").alias("end_sample"))


def loudness_blocks(fr: DataFrame) -> DataFrame:
    """Mean square of every full 400 ms block, one each 100 ms.

    A hop of five frames belongs to up to four blocks; adding it to each keeps
    the grouping spread over ``(clip, block)``.
    """
    hops = fr.groupBy("clip_id", F.floor(F.col("frame_no") / 5).alias("hop")).agg(
        F.sum("sumsq").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")
    ).filter("c = 5")
    shared = hops.select("clip_id", "s", "n", F.explode(F.sequence(F.greatest(F.col("hop") - 3, F.lit(0)), F.col("hop"))).alias("block"))
    full = shared.groupBy("clip_id", "block").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    return full.filter("c = 4").select("clip_id", "block", (F.col("s") / F.col("n")).alias("z"))


def gated_loudness(fr: DataFrame) -> DataFrame:
    """Integrated loudness with the absolute and the relative gate.

    Samples count as already weighted; the recursive weighting filter is a
    per-sample solver and stays outside.
    """
    z = loudness_blocks(fr).filter(A.power_db(F.col("z")) > -70.0)
    gate = z.groupBy("clip_id").agg((A.power_db(F.avg("z")) - 10.0).alias("gate"))
    kept = z.join(gate, "clip_id").filter(A.power_db(F.col("z")) > F.col("gate"))
    gated = kept.groupBy("clip_id").agg(A.power_db(F.avg("z")).alias("gated"))
    whole = fr.groupBy("clip_id").agg(
        A.power_db(F.sum("sumsq") / F.sum("n")).alias("whole"), F.count(F.lit(1)).alias("frames")
    )
    lufs = F.when(F.col("frames") < 20, F.col("whole")).otherwise(F.coalesce("gated", F.lit(-120.0)))
    return whole.join(gated, "clip_id", "left").select("clip_id", lufs.alias("lufs"))


def ends_abruptly(blocks: DataFrame, block_len: int, tail_sec: float = 0.25, limit_db: float = -35.0) -> DataFrame:
    """The last quarter second is still loud; shorter clips are never flagged."""
    size = blocks.groupBy("clip_id").agg(F.sum(F.size("samples")).cast("long").alias("n"))
    tail = F.floor(F.lit(tail_sec) * F.col("sr"))
    rows = blocks.join(size, "clip_id").withColumn("base", (F.col("block_no") * block_len).cast("long"))
    rows = rows.withColumn("skip", F.greatest(F.col("n") - tail - F.col("base"), F.lit(0)).cast("int"))
    used = rows.filter(F.col("skip") < F.size("samples"))
    sums = used.groupBy("clip_id", "n").agg(
        F.sum(A.sum_squares(F.slice("samples", F.col("skip") + 1, F.size("samples")))).alias("s"), F.first(tail).alias("tail")
    )
    loud = A.db(F.sqrt(F.col("s") / F.col("tail"))) > limit_db
    return sums.select("clip_id", F.when(F.col("n") < F.col("tail"), False).otherwise(loud).alias("ends_abruptly"))


def clip_stats(blocks: DataFrame, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Everything the quality report needs, one row per clip."""
    # Frames are about a hundredth of the samples and every part reads them.
    fr = materialize(frames(blocks, block_frames=block_frames), "frames")
    thr = silence_threshold(fr)
    out = clip_levels(blocks)
    for part in (gated_loudness(fr), snr(fr), edge_silence(fr, thr).select("clip_id", "trailing_sec")):
        out = out.join(part, "clip_id", "left")
    return out


def quality_report(stats: DataFrame, min_sec: float = 3.0, max_sec: float = 30.0) -> DataFrame:
    """Warnings and an advisory score between 0 and 1."""
    dur, ratio, tail = F.col("duration_sec"), F.bround("clipping_ratio", 5), F.bround("trailing_sec", 3)
    sec = lambda places: F.format_string(f"%.{places}f", F.bround(dur, places))
    tests = (
        (
            dur < min_sec,
            0.25,
            F.concat(F.lit("reference is "), sec(1), F.lit(f"s — under {min_sec:.0f}s clones poorly; 6-10s is the sweet spot")),
        ),
        (
            dur > max_sec,
            0.10,
            F.concat(
                F.lit("reference is "), sec(0),
                F.lit(f"s — only the first {max_sec:.0f}s matter, and a long clip raises the risk of leftover words leaking into your clips"),
            ),
        ),
        (
            F.col("snr_db") < 15,
            0.25,
            F.concat(
                F.lit("reference is noisy (SNR "), F.format_string("%.0f", F.bround("snr_db", 0)),
                F.lit(" dB) — the cloned voice will carry that noise"),
            ),
        ),
        (ratio > 0.001, 0.15, F.lit("reference is clipping — re-record a little further from the mic")),
        (tail < 0.05, 0.15, F.lit("reference ends without a pause — it may be cut mid-word")),
    )
    score = F.lit(1.0)
    for cond, weight, _ in tests:
        score = score - F.when(cond, weight).otherwise(0.0)
    return stats.withColumns(
        {
            "warnings": F.array_compact(F.array(*[F.when(c, text) for c, _, text in tests])),
            "quality_score": F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2),
        }
    )


def pauses(runs: DataFrame, min_frames: int) -> Column:
    return (F.col("end_frame") - F.col("start_frame") >= min_frames) & (F.col("start_frame") > 0)


def last_pause(runs: DataFrame, min_keep: Column | int = 0, min_frames: int = 7) -> DataFrame:
    """Frame where speech last stopped, keeping at least ``min_keep`` frames."""
    ok = pauses(runs, min_frames) & (F.col("start_frame") >= min_keep)
    return runs.filter(ok).groupBy("clip_id").agg(F.max("start_frame").alias("cut_frame"))


def first_pause(runs: DataFrame, ends: DataFrame, scan_frames: int, min_frames: int = 7) -> DataFrame:
    """Frame where speech first resumes early on; ``ends`` has ``frames`` per clip."""
    ok = pauses(runs, min_frames) & (F.col("end_frame") <= scan_frames)
    return runs.filter(ok).join(ends, "clip_id").filter(F.col("end_frame") < F.col("frames")).groupBy("clip_id").agg(
        F.min("end_frame").alias("lead_frame")
    )


def nearest_pause(runs: DataFrame, target: int, floor: int, min_frames: int = 7, penalty: float = 1.25) -> DataFrame:
    """The pause nearest to the target frame; overshooting costs a quarter more."""
    cut = F.col("start_frame")
    cost = F.when(cut <= target, (F.lit(target) - cut).cast("double")).otherwise((cut - target) * penalty)
    ok = pauses(runs, min_frames) & (cut >= floor)
    return runs.filter(ok).groupBy("clip_id").agg(F.min_by("start_frame", F.struct(cost, cut)).alias("cut_frame"))
