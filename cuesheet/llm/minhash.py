"""Near-duplicates: BagMinHash signatures of word shingle multisets, banding, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import lean, narrow, prune_by_ids, table, words
from cuesheet.llm.linking import histogram, link, with_texts
from cuesheet.session import materialize

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(ws: list[bytes], hashes: WordHash, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of all runs of ``size`` words, repeats kept; a shorter text is one run."""
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = out * _A + h[k : len(h) - n + 1 + k]
    return np.sort(mix(out))


def multiset(sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs."""
    if not len(sorted_hashes):
        return sorted_hashes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1])))
    return sorted_hashes[first], np.diff(np.append(first, len(sorted_hashes)))


def numbered(sorted_hashes: np.ndarray) -> np.ndarray:
    """The multiset as a set: repeats are told apart by their number."""
    n = multiset(sorted_hashes)[1]
    nth = np.arange(len(sorted_hashes)) - np.repeat(np.cumsum(n) - n, n)
    return mix(sorted_hashes + nth.astype(np.uint64) * _A)


def weighted_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Shared over joint size of two multisets, given as sorted hashes; two empty ones share nothing."""
    (xv, xn), (yv, yn) = multiset(x), multiset(y)
    if not len(xv) or not len(yv):
        return 0.0
    at = np.searchsorted(yv, xv)
    same = np.flatnonzero(yv[np.minimum(at, len(yv) - 1)] == xv)
    shared = int(np.minimum(xn[same], yn[at[same]]).sum())
    return shared / (len(x) + len(y) - shared)


def bag_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, m: int) -> np.ndarray:
    """Signatures (sets x m, 64-bit) of weighted sets; equal registers estimate the weighted Jaccard similarity.

    The weight axis is cut at 0, 1, 2, 4, 8, ...; every element owns one Poisson
    process for each piece, of a rate equal to the length of the piece, whose
    points carry a place inside the piece and a register.  A set sees the points
    of its elements below their weights; a register keeps the earliest.  A
    process is followed only while its time is below the latest register of its
    set, so the work hardly grows with the number of elements beyond one point each.
    """
    reg = np.full(sets * m, np.inf)
    levels = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))), 0).astype(np.int64)
    level = np.concatenate([np.full(int((levels >= j).sum()), j) for j in range(int(levels.max(initial=0)) + 1)])
    at = np.concatenate([np.flatnonzero(levels >= j) for j in range(int(levels.max(initial=0)) + 1)])
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    length = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    seed = mix(elements[at] + level.astype(np.uint64) * _A)
    weight, home = weights[at], owner[at]
    time = np.zeros(len(at))
    step = 0
    while len(at):
        step += 1
        r = mix(seed + np.uint64(step * int(_A) % 2**64))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        r = mix(r ^ _C)
        slot = home * m + (r % np.uint64(m)).astype(np.int64)
        place = low + length * ((r >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        seen = place < weight
        np.minimum.at(reg, slot[seen], time[seen])
        latest = reg.reshape(sets, m).max(axis=1)
        go = time < latest[home]
        at, seed, weight, home, time, low, length = (x[go] for x in (at, seed, weight, home, time, low, length))
    return reg.view(np.uint64).reshape(sets, m)


def sign(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(doc_id, content, bands, sig): content is 16 bytes over the words (null: no words), sig a byte per register."""
    m = bands * rows
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def signed(ids, contents, bags) -> pa.RecordBatch:
        sets = [multiset(b) for b in bags]
        n = np.array([len(v) for v, _ in sets])
        some = np.flatnonzero(n)
        prints: list = [None] * len(ids)
        bytes_: list = [None] * len(ids)
        if len(some):
            reg = bag_minhash(
                np.concatenate([sets[i][0] for i in some]),
                np.concatenate([sets[i][1] for i in some]).astype(np.float64),
                np.repeat(np.arange(len(some)), n[some]),
                len(some),
                m,
            )
            key = np.arange(1, bands + 1, dtype=np.uint64) * _C + np.zeros((len(some), 1), np.uint64)
            for k in range(rows):
                key = mix(key * _A + reg[:, k::rows])
            small = (mix(reg) >> np.uint64(56)).astype(np.uint8)
            for j, i in enumerate(some.tolist()):
                prints[i], bytes_[i] = key[j].view(np.int64).tolist(), small[j].tobytes()
        cols = [ids, contents, prints, bytes_]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "content", "bands", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        ids, contents, bags, total = [], [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ws = words(text.as_py())
                ids.append(doc)
                contents.append(hashlib.blake2b(b" ".join(ws), digest_size=16).digest() if ws else None)
                bags.append(shingles(ws, hashes, size))
                total += len(bags[-1])
                if total > 100_000 or len(ids) >= 4000:
                    yield signed(ids, contents, bags)
                    ids, contents, bags, total = [], [], [], 0
        if ids:
            yield signed(ids, contents, bags)

    return docs.mapInArrow(lean(run), "doc_id long, content binary, bands array<long>, sig binary")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bands: int = 24, rows: int = 5, size: int = 5
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    Documents whose multisets of ``size``-word shingles reach the weighted
    Jaccard ``similarity`` are linked; classes are the components; class_id is
    the smallest doc_id and that document is kept.  Documents with the same
    words are one node from the start, so copies are never paired.  Candidates
    share a band (24 bands of 5 registers miss a pair at 0.8 with probability
    7e-5, a pair at 0.85 with 3e-6); every link is verified on the whole texts.
    Pairs whose shingle histograms rule ``similarity`` out are left out before
    that.
    Null texts and texts without words are in no class but their own; texts of
    fewer than ``size`` words are one shingle.  doc_id is the key: rows that
    repeat it are one node (all kept or none); rows without id stay alone.
    """
    m = bands * rows
    enough = m * (similarity - 5 * (similarity * (1 - similarity) / m) ** 0.5)
    base = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = materialize(sign(base, bands, rows, size), "signatures")
    classes = materialize(
        signed.where("content is not null and doc_id is not null")
        .groupBy("content")
        .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")),
        "classes",
    )
    keyed = classes.select("id", F.posexplode("bands").alias("band", "key")).select("key", F.lit(0).alias("role"), "id")
    sigs = classes.select("id", "sig").dropDuplicates(["id"])

    def equal_registers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x == y).sum(axis=-1)

    def texts_of(ids: DataFrame) -> DataFrame:
        # an inner join: a semi join would be pushed below the pruning
        texts = prune_by_ids(base, "doc_id", ids).join(ids.withColumnRenamed("id", "doc_id"), "doc_id")
        return texts.groupBy(F.col("doc_id").alias("id")).agg(F.max("text").alias("text"))

    def bags(ids: DataFrame) -> DataFrame:
        """Number of shingles and their histogram, of each text."""

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHash()
            for b in batches:
                found = [numbered(shingles(words(t.as_py()), hashes, size)) for t in b.column(1)]
                cols = [b.column(0), pa.array(map(len, found), pa.int64()), pa.array(map(histogram, found), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "size", "bag"])

        return texts_of(ids).mapInArrow(lean(spell), "id long, size long, bag binary")

    def verify(pairs: DataFrame) -> DataFrame:
        one = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHash()
            for b in batches:
                ok, last = [], (None, None)
                for a, ta, tb in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                    if last[0] != a:
                        last = (a, shingles(words(ta.as_py()), hashes, size))
                    ok.append(weighted_jaccard(last[1], shingles(words(tb.as_py()), hashes, size)) >= similarity)
                yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        return with_texts(pairs, one).mapInArrow(lean(check), "a long, b long")

    _, roots = link(keyed, sigs, equal_registers, enough, m, verify, "minhash", bags, similarity)
    nodes = signed.select("doc_id", "content").join(classes.select("content", "id"), "content", "left")
    rooted = materialize(
        nodes.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id", "doc_id").alias("class_id")), "near-classes"
    )
    sizes = rooted.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return rooted.join(sizes, "class_id", "left").select(
        "doc_id",
        "class_id",
        F.when(F.col("class_id").isNull(), 1).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"),
    )


def op3_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_bag_minhash": op3_bag_minhash}
