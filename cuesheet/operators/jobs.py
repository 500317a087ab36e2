"""Queue and job reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.plans.ordered import by_range, prefix_sum, row_numbers

STATUSES = ("Queued", "Processing", "Done", "Error", "Cancelled")
UNFINISHED = ("Queued", "Processing", "Cancelling…")
REPLAY_TTL_S, REPLAY_KEEP = 86400, 200


def queue_board(jobs: DataFrame) -> DataFrame:
    """Jobs per status, empty statuses included; rtf over finished jobs."""
    counts = jobs.groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.avg(F.when((F.col("status") == "Done") & (F.col("rtf") > 0), F.col("rtf"))).alias("avg_rtf"),
        F.min(F.when((F.col("status") == "Done") & (F.col("rtf") > 0), F.col("rtf"))).alias("best_rtf"),
    )
    board = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return board.join(counts, "status", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0).cast("long")))


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin("Queued", "Processing")).alias("queue_depth"))


def last_jobs(jobs: DataFrame, n: int = 50) -> DataFrame:
    """The newest n jobs (at least one)."""
    return jobs.orderBy(F.desc("job_id")).limit(max(1, n))


def live_replays(entries: DataFrame, now: Column, ttl: int = REPLAY_TTL_S, keep: int = REPLAY_KEEP) -> DataFrame:
    """Entries younger than the time to live, the newest ``keep`` of them."""
    age = now.cast("double") - F.col("at").cast("double")
    return entries.filter(age <= ttl).orderBy(F.desc("at"), F.desc("key")).limit(keep)


def clear_finished(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(*UNFINISHED))


def cancel_queued(jobs: DataFrame) -> DataFrame:
    hit = F.col("status") == "Queued"
    return jobs.withColumns({"cancelled_now": hit, "status": F.when(hit, "Cancelled").otherwise(F.col("status"))})


def jobs_with_reports(jobs: DataFrame, renders: DataFrame) -> DataFrame:
    """Finished jobs carry their report fields, others null."""
    fields = renders.select("job_id", "rtf", "audio_sec")
    is_done = F.coalesce(F.col("status") == "Done", F.lit(False))
    # jobs that are not done are not joined at all: as null keys they would share one task
    rest = jobs.filter(~is_done).select("*", *(F.lit(None).cast(fields.schema[c].dataType).alias(c) for c in ("rtf", "audio_sec")))
    return jobs.filter(is_done).join(fields, "job_id", "left").select(rest.columns).unionByName(rest)


def public_jobs(jobs: DataFrame) -> DataFrame:
    """What a caller may see of a job."""
    return jobs.select(
        "job_id",
        "project",
        F.regexp_replace(F.lower("status"), "…+$", "").alias("status"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
        "rtf",
        F.when(F.col("file").isNotNull(), F.concat(F.lit("/api/jobs/"), F.col("job_id").cast("string"), F.lit("/download"))).alias("download_url"),
    )


def assign_unique(df: DataFrame, existing: DataFrame, base: str, order: str, width: int = 65536) -> DataFrame:
    """A free name for every row: ``x``, ``x_2``, ``x_3`` … in row order.

    ``existing`` holds the taken names.  The r-th row of a base gets the r-th
    free suffix, found by merging rows and taken suffixes into one running
    count, so one popular name is not held in one task.  A base that other rows
    ask for literally is never handed out as somebody's suffix.
    """
    ranked = row_numbers(df, [base], order, "__r", by_range(order, width))
    pattern = r"^(.*)_([1-9][0-9]*)$"
    names = existing.select(F.col(existing.columns[0]).alias("name"), F.lit(True).alias("first"))
    asked = df.select(F.col(base).alias("name"), F.lit(False).alias("first"))
    pool = names.unionByName(asked).groupBy("name").agg(F.max("first").alias("first"))
    suffixed = pool.filter(F.col("name").rlike(pattern)).select(
        F.regexp_extract("name", pattern, 1).alias(base), F.regexp_extract("name", pattern, 2).cast("long").alias("i")
    ).filter("i >= 2")
    taken = pool.filter("first").select(F.col("name").alias(base), F.lit(1).cast("long").alias("i")).unionByName(suffixed)
    taken = taken.join(df.select(base).distinct(), base, "left_semi")
    before = row_numbers(taken, [base], "i", "__j", by_range("i", width)).select(
        base, (F.col("i") - F.col("__j")).alias("__at"), F.lit(1).alias("__taken"), F.lit(None).cast("long").alias(order)
    )
    rows = ranked.select(base, F.col("__r").alias("__at"), F.lit(0).alias("__taken"), F.col(order).cast("long").alias(order))
    merged = prefix_sum(
        before.unionByName(rows), [base], [F.col("__at"), F.col("__taken")], F.col("__taken").cast("long"), "__skip", by_range("__at", width)
    )
    suffix = merged.filter("__taken = 0").select(F.col(base), F.col(order), (F.col("__at") + F.col("__skip")).alias("__i"))
    named = F.when(F.col("__i") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.col("__i").cast("string")))
    return suffix.select(base, order, named.alias("unique_name"))


def failure_streak(calls: DataFrame, host: str = "host", seconds: float = 86400.0) -> DataFrame:
    """Failures in a row since the last success, and health after each call.

    ``calls`` has ``ts``, ``event_id``, ``ok`` and ``sticky``.  Both counts run
    over time ranges of each host, so a busy host is spread over tasks.
    """
    when = [F.col("ts"), F.col("event_id")]
    bucket = by_range(F.col("ts").cast("double"), seconds)
    epoch = prefix_sum(calls, [host], when, F.col("ok").cast("long"), "__epoch", bucket)
    fails = prefix_sum(epoch, [host, "__epoch"], when, (~F.col("ok")).cast("long"), "streak", bucket)
    stuck = prefix_sum(fails, [host, "__epoch"], when, (~F.col("ok") & F.col("sticky")).cast("long"), "__stuck", bucket)
    return stuck.withColumn("healthy", (F.col("streak") < 2) & (F.col("__stuck") == 0)).drop("__epoch", "__stuck")
