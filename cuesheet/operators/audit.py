"""Batch reports over word diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.operators import diff as D


def real_errors(diffs: DataFrame) -> DataFrame:
    """Add ``real_dropped`` and ``real_added``: no word that is half of a misheard pair."""
    own_way = F.flatten(F.transform("misheard", lambda p: F.array(p["sent"], p["heard"])))
    staged = diffs.withColumn("__own", own_way)
    keep = lambda c: F.filter(c, lambda w: ~F.array_contains(F.col("__own"), w))
    return staged.withColumns({"real_dropped": keep("hard_dropped"), "real_added": keep("hard_inserted")}).drop("__own")


def audit_rows(diffs: DataFrame) -> DataFrame:
    """One report row per clip."""
    return real_errors(diffs).withColumns({"added": F.size("real_added"), "dropped_n": F.size("real_dropped")})


def audit_totals(diffs: DataFrame, *by: str) -> DataFrame:
    """Words added and dropped over a batch; ``exit_code`` 0 means none."""
    rows = audit_rows(diffs)
    tail = F.count_if(F.size("tail_inserted") > 0)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum(F.col("sent_words").cast("long")).alias("sent_words"),
        F.sum(F.col("spoken_words").cast("long")).alias("spoken_words"),
        F.sum(F.col("added").cast("long")).alias("added"),
        F.sum(F.col("dropped_n").cast("long")).alias("dropped"),
        tail.alias("clips_with_tail"),
        F.count_if((F.col("added") == 0) & (F.col("dropped_n") == 0)).alias("clean_clips"),
    )
    return out.withColumns(
        {
            "tail_share": F.round(F.col("clips_with_tail") / F.greatest("clips", F.lit(1)), 4),
            "exit_code": F.when((F.col("added") == 0) & (F.col("dropped") == 0), 0).otherwise(1),
        }
    )


def top_words(diffs: DataFrame, col: str, n: int = 8) -> DataFrame:
    """The n most common words of a list column; ties in word order."""
    counts = diffs.select(F.explode(F.array_compact(col)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    return counts.orderBy(F.desc("times"), "word").limit(n)


def top_misheard(diffs: DataFrame, n: int = 8) -> DataFrame:
    pairs = diffs.select(F.explode(F.array_compact("misheard")).alias("p")).groupBy("p.sent", "p.heard")
    return pairs.agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "sent", "heard").limit(n)


def compare_transcribers(a: DataFrame, b: DataFrame, key: str = "clip_id") -> DataFrame:
    """Two diffs of the same clips side by side."""
    side = lambda df, p: df.select(
        key,
        F.col("word_accuracy").alias(f"{p}_accuracy"),
        ((F.size("missing") == 0) & (F.size("extra") == 0)).alias(f"{p}_clean"),
    )
    return side(a, "a").join(side(b, "b"), key).withColumn("agree", F.col("a_clean") == F.col("b_clean"))


def agreement_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("clips"),
        F.count_if("a_clean").alias("a_clean"),
        F.count_if("b_clean").alias("b_clean"),
        F.avg("a_accuracy").alias("a_accuracy"),
        F.avg("b_accuracy").alias("b_accuracy"),
        F.count_if("agree").alias("agree"),
    )


def plan_actions(diffs: DataFrame, tails: DataFrame, key: str = "clip_id") -> DataFrame:
    """trim, regenerate (with the reason) or ship, per clip or chunk.

    ``tails`` holds the clips that have a removable tail segment.
    """
    judged = D.with_verdicts(diffs).join(tails.select(key).distinct().withColumn("has_tail", F.lit(True)), key, "left")
    trim = F.col("only_tail_is_wrong") & F.coalesce("has_tail", F.lit(False))
    reason = (
        F.when(F.size("missing") > 0, "dropped_words").when(F.size("extra") > 0, "extra_words").otherwise("unclear")
    )
    return judged.withColumn(
        "action", F.when(trim, "trim").when(F.col("worth_regenerating"), "regenerate").otherwise("ship")
    ).withColumn("reason", F.when(F.col("action") == "regenerate", reason))


def choose_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The attempt with the fewest missing and extra words; the earliest wins ties."""
    errors = F.size("missing") + F.size("extra")
    return attempts.groupBy(*keys).agg(
        F.min_by("attempt", F.struct(errors, "attempt")).alias("attempt"), F.min(errors).alias("errors")
    )


def regen_reasons(attempts: DataFrame, key: str = "clip_id") -> DataFrame:
    """``map<reason, count>`` and the sorted chunk numbers that were redone."""
    per = attempts.groupBy(key, "reason").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("chunk_no").alias("chunks")
    )
    return per.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("regen_reasons"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("regen_chunks"),
    )


def staged_verify(clips: DataFrame, chunks: DataFrame, spoken_form: bool = True) -> DataFrame:
    """Whole clips first; only failing clips of several chunks are looked at by chunk.

    ``clips`` holds ``(clip_id, sent, spoken)``, ``chunks`` adds ``chunk_no``.
    ``passes`` is 1, or 1 plus the number of chunks.
    """
    whole = D.with_verdicts(D.word_diff(clips, spoken_form))
    counts = chunks.groupBy("clip_id").agg(F.count(F.lit(1)).alias("chunks"))
    screened = whole.select("clip_id", "clean", "word_accuracy").join(counts, "clip_id", "left")
    failing = screened.filter(~F.col("clean") & (F.col("chunks") > 1)).select("clip_id")
    deep = chunks.join(failing, "clip_id", "left_semi").select(
        F.struct("clip_id", "chunk_no").alias("chunk_id"), "sent", "spoken"
    )
    bad = D.with_verdicts(D.word_diff(deep, spoken_form, "chunk_id")).groupBy(F.col("chunk_id.clip_id").alias("clip_id")).agg(
        F.count_if(~F.col("clean")).alias("bad_chunks")
    )
    out = screened.join(bad, "clip_id", "left")
    drilled = F.col("bad_chunks").isNotNull()
    return out.select(
        "clip_id",
        F.when(F.col("clean"), "whole-clip").otherwise("per-chunk").alias("verify_mode"),
        F.when(drilled, F.col("chunks") + 1).otherwise(F.lit(1)).cast("long").alias("passes"),
        F.coalesce("bad_chunks", F.when(F.col("clean"), 0).otherwise(1)).cast("long").alias("bad_chunks"),
        "word_accuracy",
    )
