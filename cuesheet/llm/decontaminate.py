"""Benchmark decontamination: a stored positional inverted index, phrase and proximity search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import lean, narrow, table, words
from cuesheet.session import materialize

INDEX_DDL = "block long, docs array<long>, n_words array<int>, terms binary, counts binary, postings binary"
HITS = [("block", pa.int64()), ("doc_no", pa.int32()), ("item_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]
HITS_DDL = "block long, doc_no int, item_id long, kind string, start int, stop int"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = 250_000) -> DataFrame:
    """The positional index, written to the shared folder.

    One row per block of documents (about ``block_words`` words, or one longer
    document): the ids and word counts of its documents, its terms, how often
    each occurs, and the word positions of each term in the block, in order.
    All words of all whole texts are posted; null texts have none.
    """
    names = ["block", "docs", "n_words", "terms", "counts", "postings"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        sizes: list[int] = []
        held: list[bytes] = []

        def block():
            slots = {t: i for i, t in enumerate(dict.fromkeys(held))}
            at = np.fromiter(map(slots.__getitem__, held), np.int32, len(held))
            counts = np.bincount(at, minlength=len(slots)).astype("<i4")
            postings = np.argsort(at, kind="stable").astype("<i4")
            row = [number, ids, sizes, b" ".join(slots), counts.tobytes(), postings.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ws = words(text.as_py())
                ids.append(doc)
                sizes.append(len(ws))
                held += ws
                if len(held) >= block_words or len(ids) >= block_words:
                    yield block()
                    number += 1
                    ids, sizes, held = [], [], []
        if ids:
            yield block()

    source = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return materialize(source.mapInArrow(lean(post), INDEX_DDL), "positional-index")


@dataclass
class QuerySet:
    """Windows of the items as rows of term numbers; shorter items are padded with -1."""

    window: int
    terms: dict[bytes, int] = field(default_factory=dict)
    items: list[int] = field(default_factory=list)
    rows: list[list[int]] = field(default_factory=list)

    def add(self, item_id: int, text: str | None) -> None:
        ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
        n = min(self.window, len(ids))
        for at in range(len(ids) - n + 1 if n else 0):
            self.items.append(item_id)
            self.rows.append(ids[at : at + n] + [-1] * (self.window - n))

    def matrix(self) -> np.ndarray:
        return np.array(self.rows, np.int64).reshape(len(self.rows), self.window)


class Block:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict, terms: dict[bytes, int]):
        self.ends = np.cumsum(np.array(row["n_words"], np.int64))
        counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        stops = np.cumsum(counts)
        postings = np.frombuffer(row["postings"], "<i4")
        self.count = np.zeros(len(terms), np.int64)
        self.lists: dict[int, np.ndarray] = {}
        for slot, word in enumerate(row["terms"].split(b" ")):
            t = terms.get(word)
            if t is not None and slot < len(counts):
                self.lists[t] = postings[stops[slot] - counts[slot] : stops[slot]]
                self.count[t] = counts[slot]

    def live(self, windows: np.ndarray) -> np.ndarray:
        """Windows all of whose terms occur in the block."""
        return np.flatnonzero(((self.count[windows] > 0) | (windows < 0)).all(axis=1))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def phrase(self, window: list[int]) -> np.ndarray:
        """Positions where the window starts: lists shifted by their offsets, intersected from the rarest term on."""
        order = sorted(range(len(window)), key=lambda k: self.count[window[k]])
        at = self.lists[window[order[0]]].astype(np.int64) - order[0]
        for k in order[1:]:
            other = self.lists[window[k]]
            found = np.searchsorted(other, at + k)
            at = at[(found < len(other)) & (other[np.minimum(found, len(other) - 1)] == at + k)]
            if not len(at):
                return at
        at = at[at >= 0]
        return at[self.doc_of(at) == self.doc_of(at + len(window) - 1)]

    def near(self, window: list[int], span: int) -> np.ndarray:
        """Starts of the shortest stretches of at most ``span`` words, inside a document, that hold all terms of the window."""
        terms = sorted(set(window), key=lambda t: self.count[t])
        out = []
        for p in self.lists[terms[0]].tolist():
            lo, hi = p - span + 1, p + span
            near = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in map(self.lists.__getitem__, terms)]
            if min(map(len, near)) == 0:
                continue
            for start in np.unique(np.concatenate(near)).tolist():
                firsts = [x[np.searchsorted(x, start)] if x[-1] >= start else None for x in near]
                if None in firsts:
                    break
                stop = int(max(firsts)) + 1
                if stop - start <= span and start <= p < stop and self.doc_of(np.array([start]))[0] == self.doc_of(np.array([stop - 1]))[0]:
                    out.append((start, stop))
        return np.array(sorted(set(out)), np.int64).reshape(-1, 2)


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(zip(starts.tolist(), stops.tolist())):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def search(index: DataFrame, items: DataFrame, window: int = 10, slop: int | None = None, block_bytes: int = 8_000_000) -> DataFrame:
    """Hits (block, doc_no, item_id, kind, start, stop) of the items' windows; ranges count words of the document.

    ``exact`` hits are occurrences of ``window`` consecutive item words (of the
    whole item, if it has fewer), merged for each document and item.  With
    ``slop``, ``near`` hits are stretches of up to ``window + slop`` words that
    hold all words of a window in any order.  The items are a stated query set:
    they are sent to the tasks in blocks of about ``block_bytes``, and each
    block searches the whole index.
    """
    spark = index.sparkSession
    asked = narrow(items, item_id="item_id", text="text").where("item_id is not null and text is not null")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = None
    for k in range(blocks):
        queries = QuerySet(window)
        for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator():
            queries.add(r["item_id"], r["text"])
        held = spark.sparkContext.broadcast((queries.terms, np.array(queries.items, np.int64), queries.matrix()))

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            terms, owners, windows = held.value
            lengths = (windows >= 0).sum(axis=1)
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row, terms)
                    found: dict[tuple, list] = {}
                    for w in block.live(windows).tolist():
                        n = int(lengths[w])
                        at = block.phrase(windows[w, :n].tolist())
                        ranges = [("exact", np.stack((at, at + n), axis=1))]
                        if slop is not None:
                            ranges.append(("near", block.near(windows[w, :n].tolist(), n + slop)))
                        for kind, spans in ranges:
                            for doc, span in zip(block.doc_of(spans[:, 0]).tolist(), spans.tolist()):
                                found.setdefault((doc, int(owners[w]), kind), []).append(span)
                    cols: list[list] = [[] for _ in HITS]
                    for (doc, item, kind), spans in found.items():
                        base = int(block.ends[doc - 1]) if doc else 0
                        both = np.array(spans)
                        for lo, hi in merged(both[:, 0], both[:, 1]):
                            for col, v in zip(cols, (row["block"], doc, item, kind, lo - base, hi - base)):
                                col.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, HITS)], names=[n for n, _ in HITS])

        hits = index.mapInArrow(lean(find), HITS_DDL)
        out = hits if out is None else out.unionByName(hits)
    return out


def contamination(index: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per indexed document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, from the exact hits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for row in b.to_pylist():
                spans = merged(np.array([s["start"] for s in row["spans"]]), np.array([s["stop"] for s in row["spans"]]))
                items = sorted({str(s["item_id"]) for s in row["spans"]})
                digest = hashlib.sha256(",".join(items).encode()).hexdigest()
                for c, v in zip(cols, (row["block"], row["doc_no"], sum(hi - lo for lo, hi in spans), len(items), digest)):
                    c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["block", "doc_no", "n_hit", "n_items", "items_sha256"])

    per_doc = hits.where("kind = 'exact'").groupBy("block", "doc_no").agg(F.collect_list(F.struct("start", "stop", "item_id")).alias("spans"))
    counted = per_doc.mapInArrow(lean(count), "block long, doc_no int, n_hit long, n_items long, items_sha256 string")
    directory = index.select("block", F.posexplode(F.arrays_zip("docs", "n_words")).alias("doc_no", "d")).select(
        "block", "doc_no", F.col("d.docs").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words")
    )
    return directory.join(counted, ["block", "doc_no"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per document, clean ones too; documents and items without words have no hits.

    Rows that repeat a doc_id are counted each; null ids stay; extra columns
    are ignored; without items nothing is contaminated.
    """
    index = build_index(docs)
    return contamination(index, materialize(search(index, items, window), "hits"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
