"""Memory, failures and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import fixed as V

# Phrases of failure messages.
OOM_PHRASES = ("out of memory", "cuda error")
ALLOCATION_PHRASES = (
    "cudaerrormemoryallocation", "cuda_error_out_of_memory", "cublas_status_alloc_failed",
    "cudnn_status_alloc_failed", "failed to allocate", "insufficient", "no kernel image",
)


def _mentions(msg: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | msg.contains(p)
    return out


def classify_error(df: DataFrame, message: str = "message") -> DataFrame:
    """Flags ``is_oom``, ``is_allocation`` (any shape) and ``is_sticky``."""
    msg = F.lower(F.coalesce(message, F.lit("")))
    oom = _mentions(msg, OOM_PHRASES)
    return df.withColumns(
        {
            "is_oom": oom,
            "is_allocation": oom | _mentions(msg, ALLOCATION_PHRASES),
            "is_sticky": msg.contains("cuda error") & ~msg.contains("tried to allocate"),
        }
    )


def with_memory_flags(samples: DataFrame) -> DataFrame:
    total = F.coalesce("total_mb", F.lit(0.0))
    return samples.withColumns(
        {
            "spilled": (total > 0) & (F.col("reserved_mb") > total * 1.02),
            "fragmentation_mb": F.round(F.col("reserved_mb") - F.col("allocated_mb"), 1),
        }
    )


def soak_growth(samples: DataFrame, limit_mb: float = 200.0) -> DataFrame:
    """Reserved memory last minus first per run, lowest free, leak flag."""
    out = samples.groupBy("run_id").agg(
        F.min_by("reserved_mb", "seq").alias("first_mb"),
        F.max_by("reserved_mb", "seq").alias("last_mb"),
        F.min("free_mb").alias("lowest_free_mb"),
    )
    return out.withColumn("grew_mb", F.col("last_mb") - F.col("first_mb")).withColumn("leak", F.col("grew_mb") > limit_mb)


def readiness(samples: DataFrame, selftests: DataFrame, now: Column, stale_s: float = 600.0) -> DataFrame:
    """Ready when the last self-test passed and is fresh and memory allows work."""
    latest = samples.groupBy("host").agg(
        F.max_by(F.struct("device", "free_mb", "reserved_mb", "total_mb"), "ts").alias("m")
    )
    last = selftests.groupBy("host").agg(F.max_by("ok", "ts").alias("ok"), F.max("ts").alias("tested_at"))
    both = latest.join(last, "host", "full")
    age = now.cast("double") - F.col("tested_at").cast("double")
    fresh = F.coalesce(F.col("ok") & (age <= stale_s), F.lit(False))
    free = F.col("m.free_mb")
    reasons = F.array_compact(
        F.array(
            F.when(
                (F.col("m.device") == "cuda") & (free < V.MIN_FREE_MB),
                F.concat(F.lit("only "), F.format_string("%.0f", free), F.lit(f" MB of VRAM free (need {V.MIN_FREE_MB:.0f} MB to start work)")),
            ),
            F.when(F.col("m.reserved_mb") > F.col("m.total_mb") * 1.02, F.lit("VRAM has spilled into system memory; restart the server")),
        )
    )
    return both.select(
        "host", (fresh & (F.size(reasons) == 0)).alias("ready"), F.round(age, 1).alias("age_s"), F.array_join(reasons, "; ").alias("reason")
    )


def check_expectations(df: DataFrame, rules: DataFrame, key: str = "probe") -> DataFrame:
    """Every expected phrase of a probe occurs in its text, in any case."""
    joined = df.join(rules, key)
    missing = F.filter("expected", lambda e: ~F.contains(F.lower(F.col("text")), F.lower(e)))
    return joined.withColumn("missing", missing).withColumn("passed", F.size("missing") == 0)


def spread_check(df: DataFrame, value: str, limit: float, *by: str) -> DataFrame:
    """Largest minus smallest value stays under the limit."""
    out = df.groupBy(*by).agg((F.max(value) - F.min(value)).alias("spread"), F.count(value).alias("n"))
    return out.withColumn("passed", F.when(F.col("n") >= 2, F.col("spread") < limit))


def memory_checks(before: DataFrame, after: DataFrame, key: str = "run_id") -> DataFrame:
    """Growth of live and reserved memory, and fragmentation afterwards."""
    b, a = before.alias("b"), after.alias("a")
    d = lambda c: F.col(f"a.{c}") - F.col(f"b.{c}")
    return b.join(a, F.col(f"a.{key}") == F.col(f"b.{key}")).select(
        F.col(f"a.{key}"),
        (d("allocated_mb") < 100).alias("no_accumulation"),
        (d("reserved_mb") < 400).alias("no_hoarding"),
        (F.col("a.fragmentation_mb") < 800).alias("not_fragmenting"),
    )


def seed_checks(clips: DataFrame, key: str = "script_id") -> DataFrame:
    """The same seed gives the same audio, another seed another one."""
    per_seed = clips.groupBy(key, "seed").agg(
        F.min("audio_sha256").alias("lo"), F.max("audio_sha256").alias("hi")
    )
    return per_seed.groupBy(key).agg(
        F.bool_and(F.col("lo") == F.col("hi")).alias("same_seed_same_audio"),
        (F.count_distinct("lo") == F.count(F.lit(1))).alias("seeds_differ"),
    )


def check_tally(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("outcome") == "PASS").alias("passed"),
        F.count_if((F.col("outcome") == "FAIL") & F.col("required")).alias("failed"),
        F.count_if(F.col("outcome") == "SKIP").alias("skipped"),
    )


def failed_checks(results: DataFrame) -> DataFrame:
    return results.filter((F.col("outcome") == "FAIL") & F.col("required"))
