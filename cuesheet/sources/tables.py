"""Sources and sinks: manifests, lexicons, voices, audit logs, bulk scripts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import fixed as V
from cuesheet.functions.text import safe_name, sha32, strip, word_count

MANIFEST = "file string, text string"
VOICE_FIELDS = (
    "path string, ref_text string, prompt_version string, baseline_wpm double, quality_score double, "
    "warnings array<string>, owner string, created timestamp, duration_sec double, lufs double, snr_db double, "
    "speaker_name string, consent boolean, consent_ref string"
)
AUDIT = (
    "ts timestamp, event string, source string, tenant string, voice_id string, project string, "
    "text_sha256 string, text_chars int, text string, audio_sha256 string, duration_sec double, wpm double, "
    "verified boolean, warnings array<string>, watermarked boolean, rtf double, seed int, rtf_reason string, "
    "timing map<string,double>, chunks int, chunks_regenerated int, vram_free_mb double, "
    "speaker_name string, consent boolean, consent_ref string, quality_score double, _corrupt_record string"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, text)`` rows of a JSON array, or of a CSV file with a header."""
    reader = spark.read.schema(MANIFEST)
    if path.lower().endswith(".csv"):
        return reader.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return reader.option("multiLine", True).json(path)


def lexicon_table(spark: SparkSession, values: dict[str, str] | None = None) -> DataFrame:
    """The built-in lexicon, or any dict, as ``(key, spoken)`` rows."""
    rows = list((V.DEFAULT_LEXICON if values is None else values).items())
    return spark.createDataFrame(rows, "key string, spoken string")


def read_lexicon(spark: SparkSession, path: str | None, defaults: DataFrame | None = None) -> DataFrame:
    """Defaults overlaid by a user file: one JSON object, ``_`` keys are comments."""
    base = lexicon_table(spark) if defaults is None else defaults
    if not path:
        return base
    text = spark.read.option("wholetext", True).text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "spoken"))
    return overlay_lexicon(base, pairs.filter(~F.col("key").startswith("_")))


def overlay_lexicon(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """The user's value wins; an empty one removes the entry."""
    mine = user.select("key", F.coalesce("spoken", F.lit("")).alias("mine"))
    both = defaults.join(mine, "key", "full").select("key", F.coalesce("mine", "spoken").alias("spoken"))
    return both.filter(F.col("spoken") != "")


def rule_order(lexicon: DataFrame) -> DataFrame:
    """Longer keys first, so that a phrase wins over its first word."""
    return lexicon.withColumn("n_chars", F.length("key")).orderBy(F.desc("n_chars"), "key")


def read_voices(spark: SparkSession, index: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Voices whose clip file exists, and the skipped ones.

    ``index`` is one JSON object from name to record; ``files`` lists ``path``.
    """
    text = spark.read.option("wholetext", True).text(index)
    rows = text.select(F.explode(F.from_json("value", f"map<string,struct<{_as_struct(VOICE_FIELDS)}>>")).alias("voice_id", "v"))
    voices = rows.select("voice_id", "v.*").withColumn("ref_text", F.coalesce("ref_text", F.lit("")))
    have = files.select("path").distinct()
    return voices.join(have, "path", "left_semi"), voices.join(have, "path", "left_anti")


def _as_struct(fields: str) -> str:
    return ", ".join(":".join(f.strip().split(" ", 1)) for f in fields.split(", "))


def write_voices(df: DataFrame, path: str) -> None:
    """Only the listed fields are kept; always to a new path."""
    names = ["voice_id"] + [f.split()[0] for f in VOICE_FIELDS.split(", ")]
    df.select(*[n for n in names if n in df.columns]).write.mode("errorifexists").json(path, ignoreNullFields=True)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Newline JSON; broken lines are kept in ``_corrupt_record``."""
    return spark.read.schema(AUDIT).json(path)


def stream_audit(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(AUDIT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def audit_rows(df: DataFrame, keep_text: bool = False) -> DataFrame:
    """Log rows: the text becomes its hash and length unless kept on purpose."""
    out = df.withColumns(
        {"text_sha256": sha32(F.col("text")), "text_chars": F.length(F.coalesce("text", F.lit("")))}
    )
    return out if keep_text else out.drop("text")


def write_audit(df: DataFrame, path: str, keep_text: bool = False) -> None:
    audit_rows(df, keep_text).write.mode("append").json(path, ignoreNullFields=True)


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Per-clip, comparison, ladder or sweep rows."""
    df.write.mode("errorifexists").format(fmt).save(path)


def table_cell(col: Column) -> Column:
    text = strip(F.coalesce(col.cast("string"), F.lit("")))
    return F.when(F.lower(text) == "nan", "").otherwise(text)


def load_bulk_scripts(df: DataFrame, submission: str = "submission_id") -> DataFrame:
    """Clean project and script cells; one oversize script rejects its submission.

    Rows without a script are dropped.  ``accepted`` is the same for every row
    of a submission; the flag is counted per submission before it is joined
    back, so one large submission is not gathered.
    """
    rows = df.withColumns({"project": table_cell(F.col("project")), "script": table_cell(F.col("script"))}).filter("script <> ''")
    rows = rows.withColumn("project", F.when(F.col("project") == "", "").otherwise(safe_name(F.col("project"))))
    big = (F.length("script") > V.QUEUED_CHARS) | (word_count(F.col("script")) > V.QUEUED_WORDS)
    bad = rows.filter(big).select(submission).distinct().withColumn("__bad", F.lit(True))
    return rows.join(bad, submission, "left").withColumn("accepted", F.col("__bad").isNull()).drop("__bad")
