"""Reading the test tables in the roles the operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    df = df.withColumns(plain) if plain else df
    return df.select(*columns) if columns else df


def spread(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """Use every core, and keep tasks small, when the input has few splits.

    Parquet splits no finer than its row groups, and the test tables are one row
    group each.  A split of more than ``rows`` rows is dealt over more tasks, so
    a task does not grow with the input; inputs of smaller splits stay as they
    are, without a shuffle.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    parts = max(cores, -(-df.count() // rows))
    return df.repartition(parts) if splits < parts else df


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("script_id"), F.col("source").alias("project"), F.col("lang").alias("language"), "text"
        ),
        rows=2_000,
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), rows=2_000)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn t is what was sent, turn t + 1 what was heard; the role is the voice."""
    turns = table(spark, sf_dir, "conversations")
    heard = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("spoken"))
    return turns.join(heard, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("clip_id"),
        F.col("role").alias("voice_id"),
        F.col("text").alias("sent"),
        "spoken",
    )


PAIRS_SQL = """pairs AS (
  SELECT a.conv_id * 100 + a.turn AS clip_id, a.role AS voice_id, a.text AS sent, b.text AS spoken
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


def renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log in the role of a render log.

    ``user_id`` is the voice, ``value`` the audio seconds, ``props.k`` the chunk
    count; an ``error`` event is a failed run.
    """
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    redone = k % 4
    return ev.withColumn("k", k).select(
        F.col("event_id").alias("clip_id"),
        "ts",
        F.concat(F.lit("v"), F.col("user_id")).alias("voice_id"),
        F.concat(F.lit("host"), (F.col("user_id") % 7)).alias("host"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("t"), F.col("user_id") % 3)).alias("tenant"),
        F.col("event_type"),
        F.when(F.col("event_type") == "error", "Error").otherwise("Done").alias("status"),
        F.col("value").alias("audio_sec"),
        (F.col("value") * (k + 20) / 400.0).alias("gen_sec"),
        F.round((k + 20) / 400, 3).alias("rtf"),
        (F.col("value") * k / 1000.0).alias("verify_s"),
        F.round((k % 10) / 5, 2).alias("voice_prompt_s"),
        F.greatest(k, F.lit(1)).alias("chunks"),
        F.when(redone > 0, F.sequence(F.lit(1), F.greatest(redone, F.lit(1)))).otherwise(F.array().cast("array<int>")).alias("regen_chunks"),
        F.map_filter(
            F.create_map(F.lit("dropped_words"), (k % 4).cast("int"), F.lit("extra_words"), F.when(k % 4 > 0, k % 3).otherwise(0).cast("int")),
            lambda _, v: v > 0,
        ).alias("regen_reasons"),
        F.round(redone * F.lit(1.5), 1).alias("regen_sec"),
        (F.lit(900.0) + k * 40).alias("vram_free_mb"),
        (8000.0 + k * 5).alias("reserved_mb"),
        F.lit(8192.0).alias("total_mb"),
        (k * 3).alias("words"),
        "k",
    )


RENDERS_SQL = """renders AS (
  SELECT event_id AS clip_id, ts, 'v' || user_id AS voice_id, 'host' || (user_id % 7) AS host,
         CASE WHEN user_id % 5 <> 0 THEN 't' || (user_id % 3) END AS tenant, event_type,
         CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Done' END AS status,
         value AS audio_sec, value * (k + 20) / 400.0 AS gen_sec, round((k + 20) / 400.0, 3) AS rtf,
         value * k / 1000.0 AS verify_s, round((k % 10) / 5.0, 2) AS voice_prompt_s,
         greatest(k, 1) AS chunks, k % 4 AS redone,
         k % 4 AS dropped_words, CASE WHEN k % 4 > 0 THEN k % 3 ELSE 0 END AS extra_words,
         round((k % 4) * 1.5, 1) AS regen_sec, 900.0 + k * 40 AS vram_free_mb, 8000.0 + k * 5 AS reserved_mb,
         8192.0 AS total_mb, k * 3 AS words, k
  FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events))"""


def long(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("long")


def joined(col: str, sep: str = "|") -> Column:
    return F.array_join(F.col(col), sep).alias(col)
