"""Reports over the render log: one row per finished or failed clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import fixed as V


def overall_rtf(renders: DataFrame, *by: str) -> DataFrame:
    """Compute seconds over audio seconds, pooled; never a mean of ratios."""
    out = renders.groupBy(*by).agg(F.sum("gen_sec").alias("gen_sec"), F.sum("audio_sec").alias("audio_sec"))
    return out.withColumn("rtf_overall", F.when(F.col("audio_sec") > 0, F.bround(F.col("gen_sec") / F.col("audio_sec"), 4)))


def voice_stats(renders: DataFrame) -> DataFrame:
    """Regeneration rate per voice; renders without a voice are skipped."""
    chunks = F.when(F.coalesce("chunks", F.lit(0)) == 0, 1).otherwise(F.col("chunks"))
    out = renders.filter(F.col("voice_id").isNotNull()).groupBy("voice_id").agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum(chunks.cast("long")).alias("chunks"),
        F.sum(F.coalesce(F.size("regen_chunks"), F.lit(0)).cast("long")).alias("regenerated"),
    )
    rate = F.bround(F.col("regenerated") / F.greatest("chunks", F.lit(1)), 4)
    return out.withColumn("regeneration_rate", rate)


def _fixed(col: Column, places: int) -> Column:
    """Number text without thousands separators."""
    return F.format_string(f"%.{places}f", F.bround(col.cast("double"), places))


def explain_rtf(renders: DataFrame) -> DataFrame:
    """Why a clip was slow: the causes that apply, and a one-line summary."""
    col = F.col
    reasons = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("regen_reasons")),
            lambda e: F.concat(F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit(" x"), e["value"].cast("string")),
        ),
        ", ",
    )
    free, verify, gen = col("vram_free_mb"), col("verify_s"), col("gen_sec")
    causes = F.array_compact(
        F.array(
            F.when(
                F.size("regen_chunks") > 0,
                F.concat(
                    F.size("regen_chunks").cast("string"), F.lit(" of "), col("chunks").cast("string"),
                    F.lit(" chunk(s) had to be generated again ("), reasons, F.lit("), costing "),
                    _fixed(col("regen_sec"), 1), F.lit("s"),
                ),
            ),
            F.when(
                (verify > 0) & (gen > 0) & (verify > 0.35 * gen),
                F.concat(F.lit("verification took "), _fixed(verify, 1), F.lit("s against "), _fixed(gen, 1), F.lit("s of generation")),
            ),
            F.when(
                free < V.MIN_FREE_MB * 2,
                F.concat(F.lit("the card had only "), _fixed(free, 0), F.lit(" MB free when this clip started, so allocation was under pressure")),
            ),
            F.when(col("reserved_mb") > col("total_mb") * 1.02, F.lit("VRAM has spilled into system memory — restart the server")),
            F.when(
                (col("audio_sec") > 0) & (col("audio_sec") < 8.0),
                F.concat(F.lit("the clip is only "), _fixed(col("audio_sec"), 1), F.lit("s long, so the fixed per-request cost dominates the ratio")),
            ),
            F.when(
                col("voice_prompt_s") > 1.0,
                F.concat(F.lit("the voice prompt was built from scratch ("), _fixed(col("voice_prompt_s"), 1), F.lit("s) — pre-warm the voice to skip this")),
            ),
        )
    )
    out = renders.withColumn("causes", causes)
    normal = (col("rtf") <= V.RTF_NORMAL_MAX) & (F.size("causes") == 0)
    return out.withColumns(
        {
            "normal": normal,
            "rtf_summary": F.when(normal, "normal")
            .when(F.size("causes") > 0, F.concat(F.lit("higher than usual: "), F.array_join("causes", "; ")))
            .otherwise("higher than usual, with no single cause identified"),
        }
    )


def attach_baseline(renders: DataFrame, voices: DataFrame) -> DataFrame:
    """The voice's own rate beside the measured one."""
    return renders.join(voices.select("voice_id", "baseline_wpm"), "voice_id", "left")


def rate_warning(measured: Column, baseline: Column, low: float = V.RATE_LOW, high: float = V.RATE_HIGH) -> Column:
    speed = F.concat(F.lit("speaking rate "), _fixed(measured, 0), F.lit(" wpm is "))
    lo, hi = baseline * low, baseline * high
    own = F.when(
        ~measured.between(lo, hi),
        F.concat(speed, F.lit("outside this voice's usual "), _fixed(lo, 0), F.lit("-"), _fixed(hi, 0), F.lit(" wpm")),
    )
    any_voice = F.when(measured < V.WPM_FLOOR, F.concat(speed, F.lit("implausibly slow"))).when(
        measured > V.WPM_CEILING, F.concat(speed, F.lit("implausibly fast — the clip may be cut short"))
    )
    return F.when(F.coalesce(measured, F.lit(0)) == 0, None).when(F.coalesce(baseline, F.lit(0)) != 0, own).otherwise(any_voice)


def with_rate_warning(renders: DataFrame, voices: DataFrame) -> DataFrame:
    rated = attach_baseline(renders, voices)
    return rated.withColumn("rate_warning", rate_warning(F.col("wpm"), F.col("baseline_wpm")))


def wpm(words: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.bround(words / (seconds / 60.0), 1)).otherwise(0.0)


def baseline_wpm(words: Column, seconds: Column) -> Column:
    return F.when((words > 0) & (seconds > 0), F.bround(words / (seconds / 60.0), 1))


def loudness_warning(renders: DataFrame, target: float = -20.0) -> DataFrame:
    """A sentence when the loudness target was missed."""
    why = (
        F.when(F.col("limited_by") == "peak_ceiling", "the peak ceiling was reached first")
        .when(
            F.col("limited_by") == "gain_cap",
            "the source was too quiet to lift safely without raising its background noise",
        )
        .when(F.col("limited_by") == "silence", "there was almost no signal to measure")
        .otherwise("the target could not be reached")
    )
    text = F.concat(F.lit("loudness came out at "), _fixed(F.col("out_lufs"), 1), F.lit(f" LUFS instead of {target:.0f} — "), why)
    return renders.withColumn("loudness_warning", F.when(~F.col("met_target"), text))


def batch_summary(renders: DataFrame) -> DataFrame:
    done = F.col("status") == "Done"
    rtf = F.when(done, F.col("rtf"))
    return renders.agg(
        F.count_if(done).alias("ok"),
        F.count(F.lit(1)).alias("total"),
        F.avg(rtf).alias("avg_rtf"),
        F.min(rtf).alias("best_rtf"),
        F.max(rtf).alias("worst_rtf"),
        F.count_if(done & F.col("warning").isNotNull() & (F.col("warning") != "")).alias("with_warning"),
    )


def counters(log: DataFrame, *by: str) -> DataFrame:
    """Event counts and the two running sums."""
    names = {
        "generations": "generation",
        "verify_failures": "verify_failure",
        "verify_skipped": "verify_skipped",
        "tail_trims": "tail_trim",
        "regenerations": "regeneration",
        "oom": "oom",
        "idempotent_replays": "replay",
    }
    hits = [F.count_if(F.col("event") == e).alias(n) for n, e in names.items()]
    sums = [F.sum("audio_sec").alias("audio_sec_total"), F.sum("gen_sec").alias("gen_sec_total")]
    return log.groupBy(*by).agg(*hits, *sums)


def verify_cost(renders: DataFrame) -> DataFrame:
    """Check seconds per chunk, with and without a regeneration."""
    out = renders.groupBy((F.size("regen_chunks") > 0).alias("regenerated")).agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum(F.col("chunks").cast("long")).alias("chunks"),
        F.sum("verify_s").alias("verify_s"),
    )
    return out.withColumn("per_chunk", F.try_divide("verify_s", "chunks"))


def verify_coverage(log: DataFrame, limit: float = 0.05) -> DataFrame:
    """Share of checks that were skipped; more than 5 % is flagged."""
    out = log.agg(
        F.count_if(F.col("outcome") == "verified").alias("verified"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    total = F.col("verified") + F.col("skipped") + F.col("failed")
    share = F.bround(F.try_divide(F.col("skipped"), total), 4)
    return out.withColumns({"skipped_share": share, "flagged": F.coalesce(share > limit, F.lit(False))})


def unknown_params(requests: DataFrame, allowed: list[str], keys: str = "keys") -> DataFrame:
    """Keys sent minus keys allowed, sorted."""
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(a) for a in allowed])))
    return requests.withColumn("unknown", extra).withColumn("rejected_if_strict", F.size("unknown") > 0)


def unknown_param_counts(requests: DataFrame, allowed: list[str], keys: str = "keys") -> DataFrame:
    out = unknown_params(requests, allowed, keys).select(F.explode(F.array_compact("unknown")).alias("param"))
    return out.groupBy("param").agg(F.count(F.lit(1)).alias("times"))


def distinct_chunks(attempts: DataFrame, key: str = "clip_id") -> DataFrame:
    """Sorted set of the chunk numbers seen per clip."""
    return attempts.groupBy(key).agg(F.array_sort(F.collect_set("chunk_no")).alias("chunk_nos"))


def union_runs(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Append the rows of several runs; missing columns become null."""
    for df in others:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def render_fields(df: DataFrame, col: str = "report") -> DataFrame:
    """Typed fields of a JSON render report, with the documented defaults."""
    schema = (
        "verified boolean, rtf double, gen_sec double, wpm double, chunks int, regen_chunks array<int>, "
        "regen_reasons map<string,int>, regen_sec double, warnings array<string>, "
        "loudness struct<in_lufs:double,out_lufs:double,met_target:boolean,limited_by:string>"
    )
    r = df.withColumn("__r", F.from_json(col, schema))
    empty = F.array().cast("array<int>")
    return r.withColumns(
        {
            "verified": F.coalesce("__r.verified", F.lit(False)),
            "rtf": F.col("__r.rtf"),
            "out_lufs": F.col("__r.loudness.out_lufs"),
            "chunks_total": F.col("__r.chunks"),
            "chunks_which": F.coalesce("__r.regen_chunks", empty),
            "chunks_regenerated": F.size(F.coalesce("__r.regen_chunks", empty)),
            "regenerate_s": F.coalesce("__r.regen_sec", F.lit(0.0)),
            "warnings": F.coalesce("__r.warnings", F.array().cast("array<string>")),
        }
    ).drop("__r")


def scrape_levels(info: Column) -> Column:
    """``levelled n chunk(s) (max x dB)`` of a status note."""
    pattern = r"levelled (\d+) chunk\(s\) \(max ([\d.]+) dB\)"
    pick = lambda g, kind, zero: F.coalesce(F.nullif(F.regexp_extract(info, pattern, g), F.lit("")).cast(kind), F.lit(zero))
    return F.struct(pick(1, "int", 0).alias("n"), pick(2, "double", 0.0).alias("max_db"))


def scrape_halvings(log: Column) -> Column:
    """Batch sizes a log says were fallen back to."""
    found = F.regexp_extract_all(log, F.lit(r"CUDA OOM -> reducing batch size to (\d+)"), F.lit(1))
    return F.transform(found, lambda n: n.cast("int"))
