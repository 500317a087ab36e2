"""Exact dedup: 128-bit content hash, byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import LOWER, UPPER, narrow, table
from cuesheet.session import materialize


def content_hash(text: Column) -> Column:
    """16 bytes of MD5."""
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  Copies collapse
    inside each task before the shuffle (hash and text are the grouping key, so
    bytes are compared and a copied text travels once per task); a hash shared
    by different texts is told apart by a second join on the text.  Null counts
    as empty; all empty texts are one group.  Rows that repeat an id with the
    same text are members of one group and are all kept or all dropped by that
    id.  ``keep`` is ``smallest`` or ``largest`` id.  Null ids group, and stay
    only if no row of the group has an id.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    base = narrow(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("norm")
    )
    hashed = base.withColumn("h", hash_fn(F.col("norm")))
    variants = hashed.groupBy("h", "norm").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(
        variants.groupBy("h").agg(
            F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")
        ),
        "exact-groups",
    )
    members = hashed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    plain = members.join(groups.where("texts = 1").drop("texts"), "h").drop("h")
    clash = groups.where("texts > 1").select("h")
    if not clash.isEmpty():
        mixed = hashed.join(clash, "h", "left_semi")
        told = mixed.groupBy("h", "norm").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        plain = plain.unionByName(
            mixed.join(told, ["h", "norm"]).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
        )
    return plain.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {"op8_exact_dedup": op8_exact_dedup}

ORACLE = {
    "op8_exact_dedup": f"""
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM n
    """
}
