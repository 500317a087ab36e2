"""Shared helpers: words, sorted runs, pruning by ids, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def _word_bytes() -> bytes:
    """Maps UTF-8 bytes: A-Z to a-z, separators to a blank, word bytes to themselves."""
    table = bytearray(b" " * 256)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            table[b] = b
        elif 0x41 <= b <= 0x5A:
            table[b] = b + 32
    return bytes(table)


WORD_BYTES = _word_bytes()


def words(text: str | None) -> list[bytes]:
    """Lower-cased words (ASCII letters and digits, everything beyond ASCII); null has none."""
    return encode(text).translate(WORD_BYTES).split()


def encode(text: str | None) -> bytes:
    """UTF-8 bytes; lone surrogates, which Spark strings cannot hold, are replaced."""
    return b"" if text is None else text.encode("utf-8", "replace")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python process keeps from task to task: by name, the function that drops it.
KEPT: dict[str, Callable[[], None]] = {}


def drop_kept(but: str | None = None) -> None:
    for name, drop in KEPT.items():
        if name != but:
            drop()


def lean(
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow``, giving its memory back when a task ends: workers are used again by later stages.

    What earlier tasks of the process have kept goes at the start, but for ``keeps``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return run


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; extra columns cannot clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def arrow_schema(batch: pa.RecordBatch | None, fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema(fields)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole runs of equal ``key``, with the offsets of the runs.

    The input partition is sorted by ``key``; the last run of a batch waits
    for the next batch.
    """
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        k = t.column(key).to_numpy()
        return np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if held[0].column(held[0].schema.get_field_index(key))[0].as_py() == k[-1]:
            continue
        t = pa.Table.from_batches(held)
        starts = cut(t)
        yield t.slice(0, int(starts[-1])), starts
        held = t.slice(int(starts[-1])).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        starts = cut(t)
        yield t, np.append(starts, t.num_rows)


def slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``most`` bytes: what is made of a run is small, however long the texts."""
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def run_parts(t: pa.Table, starts: np.ndarray, column: str, most: int = 4_000_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A table of ``whole_runs`` in parts of whole runs with about ``most`` bytes of ``column`` (one run at least)."""
    size = np.concatenate(([0], np.cumsum(pc.binary_length(t.column(column)).to_numpy())))[starts]
    lo = 0
    while lo < len(starts) - 1:
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most, side="right")) - 1)
        yield t.slice(int(starts[lo]), int(starts[hi] - starts[lo])), starts[lo : hi + 1] - starts[lo]
        lo = hi


def prune_by_ids(df: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows whose id may be in ``ids`` (one column): a bit filter of fixed size.

    The filter has at most ``bits`` / 64 rows (131,072, about 3 MB), whatever
    the input, so it is broadcast.  False positives stay; an exact join follows.
    """
    (name,) = ids.columns
    slot = F.pmod(F.xxhash64(F.col(name)), F.lit(bits))
    words64 = (
        ids.select(slot.alias("s"))
        .groupBy(F.expr("s div 64").alias("__slot"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("__bits"))
    )
    mine = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    joined = df.withColumn("__at", mine).join(F.broadcast(words64), F.expr("__at div 64 = __slot"))
    return joined.where("(shiftright(__bits, cast(__at % 64 as int)) & 1) = 1").drop("__at", "__slot", "__bits")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): root is the smallest id of its component.

    Alternates large and small stars; every round is two shuffles of the links,
    written to the shared folder, and nothing but two numbers reaches the driver.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = materialize(
            large.join(small, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct(),
            name,
        )
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b"), F.col("b")).distinct())
