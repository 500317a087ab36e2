"""Live reports over streams of render and job events.

Event time is ``ts``.  Every function takes a streaming DataFrame and returns
one; the same functions work on a batch DataFrame, which gives the reconciled
answer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuesheet.operators import renders as R
from cuesheet.plans.ordered import by_range, prefix_sum

DELAY = "10 minutes"


def with_lateness(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events older than the watermark are dropped by stateful steps."""
    return stream.withWatermark("ts", delay)


def live_metrics(stream: DataFrame, window: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Counters and pooled RTF per tumbling window."""
    out = with_lateness(stream, delay).groupBy(F.window("ts", window)).agg(
        F.count(F.lit(1)).alias("generations"),
        F.count_if(F.col("status") == "Error").alias("failures"),
        F.sum("gen_sec").alias("gen_sec"),
        F.sum("audio_sec").alias("audio_sec"),
    )
    return out.select(
        F.col("window.start").alias("window_start"), "generations", "failures",
        F.when(F.col("audio_sec") > 0, F.bround(F.col("gen_sec") / F.col("audio_sec"), 4)).alias("rtf_overall"),
    )


def live_voice_rates(stream: DataFrame, window: str = "2 days", slide: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Regeneration rate per voice over a sliding window."""
    out = with_lateness(stream, delay).filter("voice_id is not null").groupBy(F.window("ts", window, slide), "voice_id").agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum(F.col("chunks").cast("long")).alias("chunks"),
        F.sum(F.size("regen_chunks").cast("long")).alias("regenerated"),
    )
    rate = F.bround(F.col("regenerated") / F.greatest("chunks", F.lit(1)), 4)
    return out.select(F.col("window.start").alias("window_start"), "voice_id", "clips", "chunks", "regenerated", rate.alias("regeneration_rate"))


class ReplayState(StatefulProcessor):
    """new, busy or replay per key; a finished run answers until it is too old."""

    def __init__(self, ttl_s: float):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "state string, at double")

    def handleInputRows(self, key, rows, timerValues):
        entry = self.entry.get() if self.entry.exists() else None
        state, at = entry if entry else (None, 0.0)
        answers = []
        batch = pd.concat(rows).sort_values(["at", "seq"])
        for seq, at_now, kind in zip(batch["seq"], batch["at"], batch["kind"], strict=True):
            if state is not None and at_now - at > self.ttl_s:
                state = None
            if kind == "request":
                verdict = {None: "new", "running": "busy", "done": "replay"}[state]
                if verdict == "new":
                    state, at = "running", at_now
                answers.append((key[0], seq, verdict))
            elif kind == "done":
                state, at = "done", at_now
            elif kind == "failed" and state == "running":
                state = None
        if state is None:
            self.entry.clear()
        else:
            self.entry.update((state, float(at)))
        yield pd.DataFrame(answers, columns=["key", "seq", "verdict"])

    def close(self) -> None:
        pass


def classify_replays(stream: DataFrame, ttl_s: float = 86400.0) -> DataFrame:
    """Verdict of every request of ``(key, ts, seq, kind)`` events.

    Needs the RocksDB state store; state is partitioned by key.  The events of
    one key are put in order per micro-batch, so bound the micro-batch at the
    source (``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``).
    """
    rows = stream.select("key", "seq", F.col("ts").cast("double").alias("at"), "kind")
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=ReplayState(ttl_s),
        outputStructType="key string, seq long, verdict string",
        outputMode="Append",
        timeMode="None",
    )


def first_requests(stream: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Simple form: one event per key within the time to live."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])


def job_state(stream: DataFrame) -> DataFrame:
    """Current status per job: the latest event wins."""
    latest = F.max_by("status", F.struct("ts", "seq"))
    return stream.groupBy("job_id").agg(latest.alias("status"), F.max("ts").alias("ts"))


def readiness_age(stream: DataFrame) -> DataFrame:
    """Last self-test per host; freshness is judged when it is read."""
    return stream.groupBy("host").agg(F.max_by("ok", "ts").alias("ok"), F.max("ts").alias("tested_at"))


def busy_sessions(events: DataFrame, gap_s: int = 120, delay: str = DELAY) -> DataFrame:
    """Runs of activity between idle gaps, per host, of a stream or a log."""
    if not events.isStreaming:
        return _logged_sessions(events, gap_s)
    session = F.session_window("ts", f"{gap_s} seconds")
    out = with_lateness(events, delay).groupBy("host", session.alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return out.select("host", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def _logged_sessions(events: DataFrame, gap_s: int, range_s: float = 86400.0) -> DataFrame:
    """The same sessions of a whole log, with every host cut into time ranges.

    The first event of a range looks back at the latest event of the ranges
    before it, so a host with a third of all events is not one task.
    """
    rows = events.select("host", "ts", F.col("ts").cast("double").alias("__s"))
    rows = rows.withColumn("__r", by_range("__s", range_s))
    before = Window.partitionBy("host").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("host", "__r").agg(F.max("__s").alias("__top"))
    tops = tops.select("host", "__r", F.max("__top").over(before).alias("__last"))
    inside = Window.partitionBy("host", "__r").orderBy("__s")
    linked = rows.join(tops, ["host", "__r"]).withColumn("__prev", F.coalesce(F.lag("__s").over(inside), F.col("__last")))
    fresh = F.when(F.col("__s") - F.col("__prev") < gap_s, 0).otherwise(1).cast("long")
    named = prefix_sum(linked, ["host"], [F.col("__s"), fresh.desc()], fresh, "__session", F.col("__r"))
    out = named.groupBy("host", "__session").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("events")
    )
    ends = F.timestamp_micros(F.unix_micros("session_end") + gap_s * 1_000_000)
    return out.select("host", "session_start", ends.alias("session_end"), "events")


def alerts(stream: DataFrame, voices: DataFrame) -> DataFrame:
    """Rate, cause and loudness warnings of each new render."""
    rated = R.loudness_warning(R.explain_rtf(R.with_rate_warning(stream, voices)))
    slow = F.when(~F.col("normal"), F.col("rtf_summary"))
    lines = F.array_compact(F.array("rate_warning", "loudness_warning", slow))
    return rated.withColumn("alerts", lines).filter(F.size("alerts") > 0).select("clip_id", "voice_id", "ts", F.array_join("alerts", " | ").alias("alerts"))


def run_available(result: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there, write every batch to ``path``, read it back.

    Batches are numbered by ``epoch``; in update mode the highest epoch of a key
    is its current row.  A batch that is run again overwrites its own folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    query = (
        result.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    spark: SparkSession = result.sparkSession
    return spark.read.schema(_with_epoch(result)).parquet(f"{path}/out")


def _with_epoch(result: DataFrame):
    from pyspark.sql.types import LongType, StructType

    return StructType([*result.schema.fields]).add("epoch", LongType())


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows of an update-mode result."""
    rest = [c for c in written.columns if c not in (*keys, "epoch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")
