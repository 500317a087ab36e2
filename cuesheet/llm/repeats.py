"""Removal of long repeated byte strings by content-defined parsing of the corpus.

A rolling hash cuts every text into phrases (the start positions that share
their minimum); phrases are compared as wholes first, so that text copied many
times costs one comparison a phrase, and byte by byte only at the edges of
repeated stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import encode, prune_by_ids, table
from cuesheet.llm.line_dedup import _BYTE_VALUE, Powers
from cuesheet.llm.minhash import mix
from cuesheet.session import materialize

TRIGGER = 16

PHRASE = [("core", pa.int64()), ("hood", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("first", pa.int32()), ("past", pa.int32()), ("anchor", pa.int32())]
PHRASE_DDL = "core long, hood long, doc_id long, version long, first int, past int, anchor int"
MARK_DDL = "doc_id long, version long, lo int, hi int"


class Rolling:
    """Hashes of all substrings of a byte array, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, powers: Powers):
        self.up, self.down = powers.get(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[data] * self.up[: len(data)])))

    def at(self, lo: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[lo + size] - self.sums[lo]) * self.down[lo])

    def everywhere(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def phrases(texts: list[bytes], length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """The text, and of each phrase the first and past-the-last start in it, the anchor, the core and the hood.

    Start i has as anchor the place of the smallest trigger hash in the half of
    its ``length``-byte window that begins at i (the first of equal ones), which
    depends on the window alone; a phrase is a run of starts with one anchor.
    All windows of a phrase hold the core: half a window from the anchor on.
    The hood is all that they hold together, and the place of the anchor in it.
    """
    half = length // 2
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) > 1 << 24:
        raise ValueError("places have 24 bits: cut longer texts into stretches")
    rolling = Rolling(data, powers)
    hashes = rolling.everywhere(TRIGGER)
    low = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= half:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < half:
        low = np.minimum(low[: -(half - span)], low[half - span :])
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    begin = np.cumsum(n) - n
    some = np.flatnonzero(n >= length)
    count = n[some] - length + 1
    starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[some], count)
    owner = np.repeat(some, count)
    anchors = place[starts]
    cut = np.flatnonzero((np.diff(anchors, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    first, last = starts[cut], starts[np.append(cut[1:], len(starts)) - 1] if len(cut) else starts[:0]
    owner, anchor = owner[cut], anchors[cut]
    core = rolling.at(anchor, half)
    extent = last - first + length
    hood = mix(rolling.at(first, extent) + mix((extent * 4096 + anchor - first).astype(np.uint64)))
    base = begin[owner]
    return owner, first - base, last + 1 - base, anchor - base, core, hood


def chunks(batches: Iterator[pa.RecordBatch], size: int = 1_500_000) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Rows (all columns but the text, which is the last) and texts, up to about ``size`` bytes or one longer text."""
    rows, texts, total = [], [], 0
    for b in batches:
        others = [c.to_pylist() for c in b.columns[:-1]]
        for *row, text in zip(*others, b.column(b.num_columns - 1)):
            raw = encode(text.as_py())
            if texts and total + len(raw) > 2 * size:
                yield rows, texts
                rows, texts, total = [], [], 0
            rows.append(tuple(row))
            texts.append(raw)
            total += len(raw)
            if total > size:
                yield rows, texts
                rows, texts, total = [], [], 0
    if texts:
        yield rows, texts


def stretches(texts: list[bytes], length: int, size: int = 1 << 22) -> Iterator[tuple[np.ndarray, int, list[bytes]]]:
    """Parts of the texts for ``phrases``: number of the text of each, offset in it, the parts.

    Texts of up to ``size`` window starts go together as they are, longer ones
    in stretches of ``size`` starts each, which overlap by ``length`` - 1 bytes:
    every window of a text is in exactly one part.  A phrase that is cut keeps
    its anchor, and with it the core.
    """
    short = [k for k, t in enumerate(texts) if len(t) < size + length]
    if short:
        yield np.array(short), 0, [texts[k] for k in short]
    for k, t in enumerate(texts):
        if len(t) >= size + length:
            for at in range(0, len(t) - length + 1, size):
                yield np.array([k]), at, [t[at : at + size + length - 1]]


def repeated_ranges(docs: DataFrame, length: int = 400) -> DataFrame:
    """Byte ranges (doc_id, version, lo, hi) covered by repeated strings; docs are (doc_id, version, text).

    1. Phrases of all texts, sorted by core and hood: phrases with equal hoods
       are repeated as wholes.  Only neighbours are compared, so a phrase that
       occurs in a third of all texts needs no group in memory.
    2. Where a core has several hoods, one phrase of each is spelled out into
       its windows, which are sorted by hash; equal neighbours are repeated.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, texts in chunks(batches):
            for number, offset, parts in stretches(texts, length):
                owner, *places, core, hood = phrases(parts, length, powers)
                owner = number[owner]
                ids = pa.array([r[0] for r in rows], pa.int64()).take(pa.array(owner))
                versions = np.array([r[1] for r in rows], np.int64)[owner]
                cols = [pa.array(core.view(np.int64)), pa.array(hood.view(np.int64)), ids, pa.array(versions), *(pa.array((x + offset).astype(np.int32)) for x in places)]
                yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in PHRASE])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, inner in with_neighbours(batches):
            core, hood = t.column("core").to_numpy(), t.column("hood").to_numpy()
            same_core = core[1:] == core[:-1]
            same_hood = same_core & (hood[1:] == hood[:-1])
            whole = np.append(False, same_hood) | np.append(same_hood, False)
            other = same_core & ~same_hood
            # every run of equal hoods touches another hood of its core, if there is one, with one of its end rows
            speaks = np.append(False, other) | np.append(other, False)
            keep = (whole | speaks) & inner
            t = t.append_column("whole", pa.array(whole)).append_column("spell", pa.array(speaks))
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    found = docs.mapInArrow(parse, PHRASE_DDL).repartition("core").sortWithinPartitions("core", "hood").mapInArrow(compare, f"{PHRASE_DDL}, whole boolean, spell boolean")
    found = materialize(found, "phrases")
    marks = found.where("whole").select("doc_id", "version", F.col("first").alias("lo"), (F.col("past") + (length - 1)).alias("hi"))

    # a phrase that has equals speaks for them in the second step, but needs no marks of its own there
    spelled = found.where("spell").groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "past", "whole")).alias("parts"))
    texts = prune_by_ids(docs, "version", found.where("spell").select("version").distinct())

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, raw in chunks(batches):
            for (doc, version, parts), text in zip(rows, raw):
                rolling = Rolling(np.frombuffer(text, np.uint8), powers)
                first, past, whole = (np.array([p[k] for p in parts]) for k in ("first", "past", "whole"))
                size = past - first
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                keys = rolling.at(at, length)
                n = len(at)
                cols = [pa.array(keys.view(np.int64)), pa.array([doc] * n, pa.int64()), pa.array(np.full(n, version)), pa.array(at.astype(np.int32)), pa.array(np.repeat(whole, size))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "version", "at", "whole"])

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, inner in with_neighbours(batches):
            key = t.column("key").to_numpy()
            same = key[1:] == key[:-1]
            ok = (np.append(False, same) | np.append(same, False)) & ~t.column("whole").to_numpy(zero_copy_only=False) & inner
            t = t.filter(pa.array(ok))
            lo = t.column("at").to_numpy()
            marks = pa.table([t.column("doc_id"), t.column("version"), pa.array(lo), pa.array((lo + length).astype(np.int32))], names=["doc_id", "version", "lo", "hi"])
            yield from marks.combine_chunks().to_batches()

    both = texts.join(spelled, [texts["doc_id"].eqNullSafe(spelled["doc_id"]), texts["version"] == spelled["version"]]).select(
        texts["doc_id"], texts["version"], "parts", "text"
    )
    windows = both.mapInArrow(spell, "key long, doc_id long, version long, at int, whole boolean")
    edges = windows.repartition("key").sortWithinPartitions("key").mapInArrow(equal, MARK_DDL)
    return marks.unionByName(edges)


def with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted rows with one row of context at either end, and which rows are not context."""
    before: pa.RecordBatch | None = None
    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            parts = [*([before] if before is not None else []), held, b.slice(0, 1)]
            inner = np.ones(sum(p.num_rows for p in parts), bool)
            inner[-1] = False
            if before is not None:
                inner[0] = False
            yield pa.Table.from_batches(parts), inner
            before = held.slice(held.num_rows - 1)
        held = b
    if held is not None:
        parts = [*([before] if before is not None else []), held]
        inner = np.ones(sum(p.num_rows for p in parts), bool)
        if before is not None:
            inner[0] = False
        yield pa.Table.from_batches(parts), inner


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes) and spans.

    Every byte covered by a ``length``-byte string that also starts elsewhere,
    in this or another text, is removed; strings are those of the input and
    never cross texts.  Null counts as empty; shorter texts lose nothing; rows
    that repeat an id and a text are separate texts and remove each other.
    Extra columns are ignored.  Strings are compared by 64-bit hashes of the
    core and of the whole together.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    marks = repeated_ranges(base, length).groupBy("doc_id", "version").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    if with_text:
        fields += [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in fields]
            for doc, ranges, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = encode(text.as_py())
                kept, removed, spans, at = [], 0, [], 0
                if ranges.is_valid:
                    lo, hi = (ranges.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi"))
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                    gone = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
                    flips = np.flatnonzero(gone[1:] != gone[:-1])
                    for x, y in zip(flips[::2].tolist(), flips[1::2].tolist()):
                        kept.append(raw[at:x])
                        removed += y - x
                        spans.append({"lo": x, "hi": y})
                        at = y
                kept.append(raw[at:])
                rest = b"".join(kept)
                row = (doc, len(raw), removed, len(spans), hashlib.sha256(rest).hexdigest(), rest, spans)
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])

    joined = base.join(marks, [base["doc_id"].eqNullSafe(marks["doc_id"]), base["version"] == marks["version"]], "left").select(
        base["doc_id"], "marks", "text"
    )
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<lo:long,hi:long>>" * with_text
    return joined.mapInArrow(cut, ddl)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op7_repeats": op7_repeats}
