"""Experiment analytics: ladders, sweeps and their null distribution."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import audio as A
from cuesheet.plans.ordered import grouped_percentiles

RUNGS = (12, 30, 60, 120, 240)
REALISTIC_WORDS = 60


def rtf_ladder(rows: DataFrame) -> DataFrame:
    """Pooled RTF per word rung, over all rungs and over the realistic ones.

    Failed requests (no audio) do not count.  Every row is counted into its
    groups in one pass.
    """
    groups = F.array_compact(
        F.array(F.col("words").cast("string"), F.lit("all"), F.when(F.col("words") >= REALISTIC_WORDS, F.lit(f"{REALISTIC_WORDS}+")))
    )
    good = rows.filter(F.col("audio_sec") > 0).select(F.explode(groups).alias("rung"), "audio_sec", "gen_sec")
    out = good.groupBy("rung").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("audio_sec").alias("audio_sec"), F.sum("gen_sec").alias("gen_sec")
    )
    return out.withColumn("rtf", F.bround(F.col("gen_sec") / F.greatest("audio_sec", F.lit(1e-9)), 3))


def _segment_counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("rung", "seed").agg(F.count(F.lit(1)).alias("segments"))


def null_distances(vectors: DataFrame, seeds: list[int], baseline_rung: int = 0) -> DataFrame:
    """Distance of every unordered pair of seeds on the same baseline chunk.

    The seeds are a fixed list of the experiment, so each vector goes to
    ``len(seeds) - 1`` pairs and no chunk is joined with itself.
    """
    pairs = list(combinations(sorted(seeds), 2))
    literal = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    base = vectors.filter(F.col("rung") == baseline_rung)
    counted = base.join(_segment_counts(base), ["rung", "seed"])
    mine = F.filter(literal, lambda p: (p["a"] == F.col("seed")) | (p["b"] == F.col("seed")))
    rows = counted.select("chunk", "seed", "vec", "segments", F.explode(mine).alias("p"))
    side = lambda c, s: F.first(F.when(F.col("seed") == F.col(f"p.{s}"), F.col(c)), ignorenulls=True)
    both = rows.groupBy("chunk", F.col("p.a").alias("seed_a"), F.col("p.b").alias("seed_b"), "p").agg(
        side("vec", "a").alias("va"), side("vec", "b").alias("vb"), side("segments", "a").alias("na"), side("segments", "b").alias("nb")
    )
    return both.filter("na = nb").select("chunk", "seed_a", "seed_b", A.cosine_distance(F.col("va"), F.col("vb")).alias("distance"))


def rung_distances(vectors: DataFrame, baseline_rung: int = 0) -> DataFrame:
    """Each rung's chunk against the same seed and chunk at the baseline."""
    counted = vectors.join(_segment_counts(vectors), ["rung", "seed"])
    base = counted.filter(F.col("rung") == baseline_rung).select("seed", "chunk", F.col("vec").alias("base"), F.col("segments").alias("base_n"))
    rows = counted.filter(F.col("rung") != baseline_rung).join(base, ["seed", "chunk"]).filter(F.col("segments") == F.col("base_n"))
    return rows.select("rung", "seed", "chunk", A.cosine_distance(F.col("vec"), F.col("base")).alias("distance"))


def null_stats(distances: DataFrame, baseline_rows: DataFrame) -> DataFrame:
    """95th percentile and maximum of the null distances, and rate spreads."""
    p95 = grouped_percentiles(distances, [], "distance", {"p95": 0.95}, width=0.01)
    top = distances.agg(F.count(F.lit(1)).alias("pairs"), F.max("distance").alias("dmax"))
    spread = baseline_rows.agg(
        (F.max("wpm") - F.min("wpm")).alias("wpm_spread"), (F.max("dur") - F.min("dur")).alias("dur_spread")
    )
    return top.select(
        "pairs",
        p95.scalar().alias("p95"),
        "dmax",
        spread.select("wpm_spread").scalar().alias("wpm_spread"),
        spread.select("dur_spread").scalar().alias("dur_spread"),
    )


def snapshot_deltas(before: DataFrame, after: DataFrame, counters: list[str], key: str = "rung") -> DataFrame:
    """Counters after minus before; missing ones count as zero."""
    b, a = before.alias("b"), after.alias("a")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    deltas = [(zero(f"a.{c}") - zero(f"b.{c}")).alias(f"{c}_delta") for c in counters]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").select(F.col(f"a.{key}"), *deltas)


def rung_verdicts(rows: DataFrame, distances: DataFrame, nulls: DataFrame, snapshots: DataFrame, baseline_rung: int = 0) -> DataFrame:
    """Adopt a rung only if nothing about it got worse than the baseline's own spread.

    ``snapshots`` has the deltas ``oom_delta, reload_delta``, ``generation_ok``,
    ``peak_mb`` and ``total_mb`` per rung.  The baseline is never adopted.
    """
    at = lambda c: nulls.select(c).scalar()
    base_rows = rows.filter(F.col("rung") == baseline_rung)
    gen = grouped_percentiles(rows, ["rung"], "gen_s", {"gen_s": 0.5, })
    base_gen = grouped_percentiles(base_rows, [], "gen_s", {"m": 0.5}).scalar()
    base_level = base_rows.agg(F.max("levelled_max_db")).scalar()
    own = rows.join(base_rows.groupBy("seed").agg(F.max("wpm").alias("base_wpm")), "seed", "left")
    per = own.groupBy("rung").agg(
        F.max("batch").alias("batch"),
        F.sum("added").alias("added"),
        F.sum("dropped").alias("dropped"),
        F.max("dead_segments").alias("dead"),
        F.bool_and("finite").alias("finite"),
        F.bool_or(F.col("n_segments") != F.col("chunks")).alias("uneven"),
        F.min("word_accuracy").alias("accuracy"),
        F.max(F.abs(F.col("wpm") - F.col("base_wpm"))).alias("wpm_shift"),
        F.max("levelled_max_db").alias("level"),
    )
    dist = grouped_percentiles(distances, ["rung"], "distance", {"d95": 0.95}, width=0.01)
    dist = dist.join(distances.groupBy("rung").agg(F.max("distance").alias("dmax")), "rung")
    out = per.join(gen, "rung").join(dist, "rung", "left").join(snapshots, "rung", "left")
    out = out.withColumns({
        "speedup": base_gen / F.col("gen_s"), "null_p95": at("p95"), "null_max": at("dmax"),
        "null_wpm": at("wpm_spread"), "base_level": base_level,
    })
    trial = F.col("batch") > 1
    tests = (
        ("oom/masked", F.col("oom_delta") != 0),
        ("model-reload", F.col("reload_delta") != 0),
        ("unhealthy", ~F.coalesce("generation_ok", F.lit(True))),
        ("vram", F.col("peak_mb") > 0.60 * F.col("total_mb")),
        ("words", (F.col("added") > 0) | (F.col("dropped") > 0)),
        ("dead-chunk", F.col("dead") > 0),
        ("nonfinite", ~F.col("finite")),
        ("segment-count", F.col("uneven")),
        ("accuracy", F.col("accuracy") < 0.995),
        ("no-audio-comparison", trial & F.col("d95").isNull()),
        ("timbre-p95", trial & (F.col("d95") > F.col("null_p95"))),
        ("timbre-max", trial & (F.col("dmax") > F.col("null_max"))),
        ("wpm", trial & (F.coalesce("wpm_shift", F.lit(0.0)) > F.col("null_wpm"))),
        ("level", trial & (F.col("level") > F.coalesce("base_level", F.lit(0.0)) + 1.5)),
        ("no-win", trial & (F.col("speedup") < 1.05)),
    )
    fails = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))
    out = out.withColumn("fails", fails)
    verdict = F.when(F.size("fails") > 0, "REJECT").when(~trial, "baseline").otherwise("ADOPT")
    return out.withColumn("verdict", verdict)


def drift_check(rows: DataFrame, first_rung: int, last_rung: int, limit: float = 0.03) -> DataFrame:
    """The baseline measured first and last: how far the box itself moved."""
    both = grouped_percentiles(rows.filter(F.col("rung").isin(first_rung, last_rung)), ["rung"], "gen_s", {"m": 0.5})
    pick = lambda r: F.max(F.when(F.col("rung") == r, F.col("m")))
    out = both.agg(pick(first_rung).alias("first_s"), pick(last_rung).alias("last_s"))
    return out.withColumn("drift", F.abs(F.col("last_s") - F.col("first_s")) / F.col("first_s")).withColumn(
        "unstable", F.col("drift") > limit
    )


def segment_health(segments: DataFrame, expected: DataFrame) -> DataFrame:
    """Dead segments, non-finite samples and a segment count that is off.

    ``segments`` holds ``(clip_id, segment_no, samples)`` pieces.
    """
    bad = F.exists("samples", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    per = segments.groupBy("clip_id", "segment_no").agg(
        F.sum(A.sum_squares(F.col("samples"))).alias("s"), F.sum(F.size("samples")).alias("n"), F.bool_or(bad).alias("bad")
    )
    rms = F.bround(20.0 * F.log10(F.greatest(F.sqrt(F.col("s") / F.col("n")), F.lit(1e-9))), 1)
    per = per.withColumn("rms_db", rms)
    out = per.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count_if(F.col("rms_db") < -60.0).alias("dead_segments"),
        (~F.bool_or("bad")).alias("finite"),
        F.min("rms_db").alias("quietest_db"),
    )
    return out.join(expected, "clip_id").withColumn("count_ok", F.col("n_segments") == F.col("chunks"))
