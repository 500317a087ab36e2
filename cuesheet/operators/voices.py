"""Voice registry: visibility, lookup, reference decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import fixed as V


def visible_voices(voices: DataFrame, tenant: str | None) -> DataFrame:
    """Voices without an owner, or owned by the tenant; no tenant sees all."""
    if tenant is None:
        return voices
    return voices.filter(F.col("owner").isNull() | (F.col("owner") == tenant))


def list_voices(voices: DataFrame, tenant: str | None = None) -> DataFrame:
    return visible_voices(voices, tenant).select("voice_id").orderBy("voice_id")


def public_voices(voices: DataFrame) -> DataFrame:
    return voices.drop("path", "prompt")


def tenant_keys(conf: DataFrame, col: str = "conf") -> DataFrame:
    """``k1:acme,k2:globex`` to rows; a blank tenant is ``default``, the last entry of a key wins."""
    parts = F.filter(F.transform(F.split(col, ","), F.trim), lambda p: p.contains(":"))
    rows = conf.select(F.posexplode(F.array_compact(parts)).alias("n", "part"))
    split = rows.select(
        "n",
        F.trim(F.substring_index("part", ":", 1)).alias("api_key"),
        F.trim(F.expr("substring(part, instr(part, ':') + 1)")).alias("tenant"),
    ).filter("api_key <> ''")
    named = split.withColumn("tenant", F.when(F.col("tenant") == "", "default").otherwise(F.col("tenant")))
    return named.groupBy("api_key").agg(F.max_by("tenant", "n").alias("tenant"))


def authenticate(requests: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their tenant, and the ones whose key nobody owns."""
    trimmed = requests.withColumn("api_key", F.trim(F.coalesce("api_key", F.lit(""))))
    return trimmed.join(keys, "api_key"), trimmed.join(keys, "api_key", "left_anti")


def attach_voice(requests: DataFrame, voices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Found requests, and rejected ones; another voice is never substituted."""
    own = F.col("r.tenant").isNull() | F.col("v.owner").isNull() | (F.col("v.owner") == F.col("r.tenant"))
    cond = (F.col("r.voice_id") == F.col("v.voice_id")) & own
    r, v = requests.alias("r"), voices.select("voice_id", "owner", "baseline_wpm").alias("v")
    return r.join(v, cond).select("r.*", "v.baseline_wpm"), r.join(v, cond, "left_anti")


def gate_consent(df: DataFrame, required: bool) -> DataFrame:
    ok = F.coalesce("consent", F.lit(False)) if required else F.lit(True)
    return df.withColumn("accepted", ok)


def decide_reference(df: DataFrame, strict: bool = False) -> DataFrame:
    """Which reference text to keep: ``supplied``, ``heard``, or a rejection.

    Needs ``ref_text``, ``heard``, ``trimmed`` and ``word_accuracy`` (of the
    supplied against the heard text).
    """
    supplied = F.trim(F.coalesce("ref_text", F.lit("")))
    heard = F.coalesce("heard", F.lit(""))
    accurate = F.col("word_accuracy") >= V.REFERENCE_ACCURACY
    decision = (
        F.when(supplied == "", "heard")
        .when(F.col("trimmed"), "replaced_trimmed")
        .when(heard == "", "supplied")
        .when(accurate, "supplied")
        .otherwise("rejected" if strict else "replaced_mismatch")
    )
    out = df.withColumn("decision", decision)
    used = F.when(F.col("decision") == "supplied", supplied).when(F.col("decision") != "rejected", heard)
    return out.withColumn("used_text", used)


def stale_voices(voices: DataFrame, version: str) -> DataFrame:
    """Voices built by another version; voices without one are not judged."""
    stored = F.coalesce("prompt_version", F.lit(""))
    return voices.filter((stored != "") & ~F.col("prompt_version").eqNullSafe(F.lit(version)))


def version_key(col: Column) -> Column:
    """Sortable numbers of a dotted version."""
    return F.transform(F.split(col, r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^\d+", 0), F.lit("")).cast("int"), F.lit(0)))


def merge_warnings(df: DataFrame) -> DataFrame:
    """Report warnings without what the trim repaired, then the trim's own."""
    kept = F.filter(
        F.coalesce("warnings", F.array().cast("array<string>")),
        lambda w: ~(F.coalesce("repaired_mid_word", F.lit(False)) & w.contains("ends without a pause")),
    )
    return df.withColumn("merged", F.concat(kept, F.coalesce("trim_warnings", F.array().cast("array<string>"))))
