"""Ordered computations that stay spread out when one key is huge.

A plain window over ``partitionBy(key)`` puts the whole key in one task.  The
functions here cut every key into ranges of the order column first.  Only one
small total per range is ever brought together per key; the rows themselves
stay in ``(key, range)`` partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 65536


def key_cols(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys] or [F.lit(0)]


def dealt(df: DataFrame, key: str, rows: int = 2_000) -> DataFrame:
    """Rows of one key together, over tasks of about ``rows`` rows; groupings and windows over the key need no other shuffle."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, key)


def by_range(order: str | Column, width: float = RANGE_ROWS) -> Column:
    """Range number of a numeric order column; larger values, later ranges."""
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(width)).cast("long")


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[Column],
    value: Column,
    out: str,
    bucket: Column,
    total: str | None = None,
) -> DataFrame:
    """Running sum of ``value`` up to and including each row, per key.

    ``bucket`` must not fall when the order rises.  With ``total`` the sum over
    the whole key is added as well, from the same small table.
    """
    order_cols = [F.col(order)] if isinstance(order, str) else list(order)
    keys = list(keys)
    parts = keys + ["__b"]
    rows = df.withColumn("__b", bucket).withColumn("__v", value)
    before = Window.partitionBy(*key_cols(keys)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key_cols(keys))
    offsets = rows.groupBy(*parts).agg(F.sum("__v").alias("__t"))
    offsets = offsets.select(
        *[F.col(p).alias(f"__off_{p}") for p in parts],
        F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"),
        *([F.sum("__t").over(whole).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*parts).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    same = F.lit(True)
    for p in parts:
        same = same & F.col(p).eqNullSafe(F.col(f"__off_{p}"))
    joined = rows.join(offsets, same, "left").drop(*[f"__off_{p}" for p in parts])
    return joined.withColumn(out, F.col("__off") + F.sum("__v").over(inside)).drop("__b", "__v", "__off")


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[Column], out: str, bucket: Column
) -> DataFrame:
    """Dense 1-based number of each row in its key."""
    return prefix_sum(df, keys, order, F.lit(1).cast("long"), out, bucket)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    flag: Column,
    start: str = "start_frame",
    end: str = "end_frame",
    width: int = RANGE_ROWS,
) -> DataFrame:
    """Maximal runs of consecutive positions where ``flag`` holds.

    Inside one run the position and the rank among flagged rows rise together,
    so their difference names the run.
    """
    hits = df.filter(flag).select(*keys, pos)
    ranked = row_numbers(hits, keys, pos, "__rank", by_range(pos, width))
    return (
        ranked.withColumn("__run", F.col(pos) - F.col("__rank"))
        .groupBy(*keys, "__run")
        .agg(F.min(pos).alias(start), (F.max(pos) + 1).alias(end))
        .drop("__run")
    )


def grouped_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], width: float = 1.0
) -> DataFrame:
    """Exact percentiles per key with linear interpolation.

    Equal values are counted before the shuffle, then ranks come from
    :func:`prefix_sum` over ranges of ``width``; no key is held in one task.
    """
    keys = list(keys)
    key_list = keys or ["__all"]
    rows = df if keys else df.withColumn("__all", F.lit(0))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*key_list, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = prefix_sum(counts, key_list, value, F.col("__n"), "__end", by_range(value, width), total="__total")
    aggs = []
    for name, p in points.items():
        h = (F.col("__total") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        first = F.col("__end") - F.col("__n")
        at = lambda r: F.max(F.when((first <= r) & (r < F.col("__end")), F.col(value)))
        frac = F.max(h - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    out = ranked.groupBy(*key_list).agg(*aggs)
    return out if keys else out.drop("__all")


def bind(value: Column, body) -> Column:
    """Name an expression once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]
