"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import lean, narrow, table, words
from cuesheet.session import materialize

#: Lengths in bytes of the word beginnings that are terms beside the whole word.
STEMS = (4, 5, 6)
#: How much better (share of pairs in the right order) a ranking with more terms must be.
GAIN = 0.002
#: Where most blocks have at least this share of the largest upper bound, none is likely to be left out.
ALIKE = 0.5


def terms_of(word: bytes) -> list[bytes]:
    """The word and its beginnings, marked by a trailing ``*``."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(words(text)).items():
        for t in terms_of(w):
            out[t] += n
    return out


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = ends - starts
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


@dataclass
class Index:
    """Postings of unit TF-IDF vectors, term by term; an entry is the postings of a term in one block of examples, with their largest weight."""

    terms: dict[bytes, int]
    idf: np.ndarray  # times how much the term tells the classes apart
    toxic: np.ndarray
    ids: np.ndarray
    first: np.ndarray = None  # term: its first entry
    blocks: np.ndarray = None  # entry: its block
    most: np.ndarray = None  # entry: largest weight
    start: np.ndarray = None  # entry: its first posting
    at: np.ndarray = None  # posting: example
    weight: np.ndarray = None
    block: int = 128

    def fill(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Stores the vectors (term numbers, weights) of the examples."""
        sizes = np.fromiter((len(v[0]) for v in vectors), np.int64, len(vectors))
        term = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0, np.float32)])
        at = np.repeat(np.arange(len(vectors)), sizes)
        order = np.lexsort((at, term))
        term, self.at, self.weight = term[order], at[order], weight[order]
        block = self.at // self.block
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
        self.blocks, self.start = block[new].astype(np.int64), np.append(new, len(term))
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0, np.float32)
        self.first = np.searchsorted(term[new], np.arange(len(self.idf) + 1))

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit weights; a text without weighted terms has none."""
        ids = np.array(sorted(counts), np.int64)
        if not len(ids):
            return ids, np.zeros(0, np.float32)
        w = (1 + np.log([counts[i] for i in ids.tolist()])) * self.idf[ids]
        return ids, (w / max(np.sqrt((w * w).sum()), 1e-30)).astype(np.float32)

    def nearest(self, ids: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine and their cosines, exactly; ties by position.

        The blocks of the largest upper bounds are scored first, then, in one go,
        the others whose bound reaches the k-th best cosine found.  Where those are
        most blocks, or seem to be as their bounds are alike, the postings of each
        term are read as a whole.
        """
        lo, hi = self.first[ids], self.first[ids + 1]
        entries, mine = spans(lo, hi), np.repeat(w.astype(np.float64), hi - lo)
        block = self.blocks[entries]
        bounds = np.bincount(block, mine * self.most[entries], -(-len(self.ids) // self.block))
        if 2 * (bounds > ALIKE * bounds.max(initial=0)).sum() > len(bounds):
            return self._all(ids, w, k, skip)
        wanted = bounds > 0
        wanted[np.argsort(-bounds, kind="stable")[4:]] = False
        left = (bounds > 0) & ~wanted
        some = np.flatnonzero(wanted[block])
        a, b = self.start[entries[some]], self.start[entries[some] + 1]
        best_at, best = self._top(spans(a, b), mine[some], b - a, k, skip)
        if len(best) >= k:
            left &= bounds * (1 + 1e-9) >= best[-1]
        if 2 * left.sum() > len(left):
            return self._all(ids, w, k, skip)
        if left.any():
            some = np.flatnonzero(left[block])
            a, b = self.start[entries[some]], self.start[entries[some] + 1]
            more_at, more = self._top(spans(a, b), mine[some], b - a, k, skip)
            best_at, best = np.concatenate((best_at, more_at)), np.concatenate((best, more))
            top = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[top], best[top]
        return best_at, best

    def _all(self, ids: np.ndarray, w: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[self.first[ids]], self.start[self.first[ids + 1]]
        return self._top([slice(x, y) for x, y in zip(a.tolist(), b.tolist())], w.astype(np.float64), b - a, k, skip)

    def _top(self, where: np.ndarray | list[slice], mine: np.ndarray, sizes: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best examples by the postings at ``where``: runs of ``sizes``, each times the weight in ``mine``."""
        at, weight = (np.concatenate([c[:0], *(c[r] for r in where)]) if isinstance(where, list) else c[where] for c in (self.at, self.weight))
        cos = np.bincount(at, np.repeat(mine, sizes) * weight, len(self.ids))
        if 0 <= skip:
            cos[skip] = 0
        found = np.flatnonzero(cos > 0)
        if len(found) > k:
            found = found[cos[found] >= np.partition(cos[found], -k)[-k]]
        top = np.lexsort((found, -cos[found]))[:k]
        return found[top], cos[found[top]]

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        """Distance-weighted share of toxic neighbours."""
        near = 1 / (1.02 - np.minimum(cos, 1))
        return float((near * self.toxic[at]).sum() / near.sum()) if len(at) else 0.0


def rising(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit (pool adjacent violators, one prior observation a pool): knots and values."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for x, y in zip(votes[order].tolist(), labels[order].tolist()):
        if pools and pools[-1][0] == x:
            pools[-1][1] += y
            pools[-1][2] += 1
        else:
            pools.append([x, y, 1])
    merged: list[list[float]] = []
    for x, y, n in pools:
        merged.append([x, y, n, x])
        while len(merged) > 1 and merged[-2][1] / merged[-2][2] >= merged[-1][1] / merged[-1][2]:
            x2, y2, n2, hi = merged.pop()
            merged[-1][1] += y2
            merged[-1][2] += n2
            merged[-1][3] = hi
    knots, values = [], []
    rate = float(labels.mean()) if len(labels) else 0.0
    for x, y, n, hi in merged:
        v = (y + rate) / (n + 1)
        knots += [x, hi] if hi > x else [x]
        values += [v, v] if hi > x else [v]
    return np.array(knots), np.array(values)


@dataclass
class Model:
    index: Index
    knots: np.ndarray
    values: np.ndarray
    empty_score: float
    k: int

    def score(self, counts: dict[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
        ids, w = self.index.vector(counts)
        at, cos = self.index.nearest(ids, w, self.k) if len(ids) else (np.zeros(0, np.int64), np.zeros(0, np.float32))
        if not len(at) or not len(self.knots):
            return self.empty_score, at, cos
        return float(np.interp(self.index.vote(at, cos), self.knots, self.values)), at, cos


def class_counts(examples: DataFrame) -> DataFrame:
    """(term, pos, neg): labelled texts of either class that hold the term, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, list[bytes]] = {}
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            both = list(sums[0].keys() | sums[1].keys())
            for at in range(0, len(both), 50_000):
                part = both[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), *(pa.array([c[t] for t in part], pa.int64()) for c in (sums[1], sums[0]))],
                    names=["term", "pos", "neg"],
                )
            sums[0].clear()
            sums[1].clear()

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                found = set()
                for w in set(words(text.as_py())):
                    ts = memo.get(w)
                    if ts is None:
                        if len(memo) > 50_000:
                            memo.clear()
                        ts = memo[w] = terms_of(w)
                    found.update(ts)
                sums[1 if toxic else 0].update(found)
                if len(sums[0]) + len(sums[1]) > 300_000:
                    yield from flush()
        yield from flush()

    partial = examples.select("text", "toxic").mapInArrow(lean(count), "term binary, pos long, neg long")
    return partial.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def ranking(votes: np.ndarray, labels: np.ndarray) -> float:
    """Share of (toxic, other) pairs in the right order; ties count half."""
    _, at, n = np.unique(votes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    pos = labels.sum()
    return float((rank[labels > 0].sum() - pos * (pos + 1) / 2) / max(1.0, pos * (len(labels) - pos)))


def fit(
    examples: DataFrame, max_examples: int = 4096, k: int = 15, powers: tuple[int, ...] = (1, 2, 3), floors: tuple[float, ...] = (3.0, 1.5)
) -> Model:
    """The index and its calibration from labelled texts (doc_id, text, toxic).

    The weight of a term is its TF-IDF times a power of z, where z is by how many
    standard errors its shares of toxic and of other texts differ, in either
    direction, after the continuity correction (half a text of each class).
    Terms up to a floor of z weigh nothing, and neither do those whose difference the
    correction covers (such as those of a single text of the larger class).  Power
    and floor are those of ``powers`` and ``floors`` that rank the examples best,
    each left out in turn; a lower floor must gain ``GAIN``.  Where no
    term of either class is above a floor, all terms are weighed.
    Counts and inverse document frequencies cover all labelled texts given; their
    bound (see ``labelled_texts``) bounds the number of terms too.  The index
    holds at most ``max_examples`` of the texts that have a weighted term,
    chosen by a hash of text and id.  Scores are calibrated on the
    examples, each left out in turn.
    """
    total = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    empty = Index({}, np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
    prior = pos / (pos + neg) if pos + neg else 0.0
    if not pos or not neg:
        return Model(empty, np.zeros(0), np.zeros(0), prior, k)
    rate = (F.col("pos") + F.col("neg")) / F.lit(float(pos + neg))
    error = F.sqrt(rate * (1 - rate) * (1 / pos + 1 / neg))
    z = (F.col("pos") / F.lit(float(pos)) - F.col("neg") / F.lit(float(neg))) / error
    half = 0.5 * (1 / pos + 1 / neg) / error
    weighed = materialize(class_counts(examples).withColumn("z", F.abs(z) - half).where("z > 0"), "weighed-terms")
    above = weighed.where(F.col("z") > min(floors))
    chosen = (weighed if above.isEmpty() else above).orderBy(F.desc("z"), "term").toArrow()
    terms = {t: i for i, t in enumerate(chosen.column("term").to_pylist())}
    plain = np.log((1 + pos + neg) / (1.0 + chosen.column("pos").to_numpy() + chosen.column("neg").to_numpy()))
    z_of = chosen.column("z").to_numpy()
    held_terms = examples.sparkSession.sparkContext.broadcast(terms)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Selected(held_terms.value)
        for b in batches:
            counts = [counter.counts(t.as_py()) for t in b.column(1)]
            keep = [i for i, c in enumerate(counts) if c]
            rows = [b.column(0).take(pa.array(keep, pa.int64())), b.column(2).take(pa.array(keep, pa.int64()))]
            lists = [pa.array([list(f(counts[i])) for i in keep], pa.list_(pa.int64())) for f in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([*rows, *lists], names=["doc_id", "toxic", "t", "n"])

    with_terms = materialize(
        examples.select("doc_id", "text", "toxic").mapInArrow(lean(vectors), "doc_id long, toxic int, t array<long>, n array<long>"), "examples"
    )
    held = {r["toxic"]: r["n"] for r in with_terms.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    found = with_terms.orderBy(F.xxhash64("t", "n", "doc_id"), "doc_id").limit(max_examples).toArrow()
    held_terms.unpersist()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("doc_id", "toxic", "t", "n"))), key=lambda r: (min(r[2]), r[0]))
    none_pos, none_neg = pos - held.get(1, 0), neg - held.get(0, 0)
    empty_score = (none_pos + prior) / (none_pos + none_neg + 1)
    if not rows:
        return Model(empty, np.zeros(0), np.zeros(0), empty_score, k)
    best = None
    for floor in (*floors, 0.0):
        if best is not None and floor == 0.0:
            break
        found_best = None
        used = {t: i for t, i in terms.items() if z_of[i] > floor}
        if not used:
            continue
        for power in powers:
            index = Index(used, plain * z_of**power * (z_of > floor), np.array([r[1] for r in rows], float), np.array([r[0] for r in rows], np.int64))
            vectors_of = [index.vector({i: c for i, c in zip(t, n) if z_of[i] > floor}) for _, _, t, n in rows]
            index.fill(vectors_of)
            votes = np.array([index.vote(*index.nearest(*v, k, skip=j)) for j, v in enumerate(vectors_of)])
            good = ranking(votes, index.toxic)
            if found_best is None or good > found_best[0]:
                found_best = (good, index, votes)
        if best is None or found_best[0] > best[0] + GAIN:
            best = found_best
    _, index, votes = best
    knots, values = rising(votes, index.toxic)
    # no neighbour is a vote of 0: what that says stands in for the prior
    empty_score = (none_pos + float(np.interp(0.0, knots, values))) / (none_pos + none_neg + 1)
    return Model(index, knots, values, empty_score, k)


class Selected:
    """Counts of the weighted terms in a text; distinct words are looked up once."""

    def __init__(self, terms: dict[bytes, int]):
        self.terms = terms
        self.memo: dict[bytes, tuple] = {}

    def counts(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        memo = self.memo
        if len(memo) > 100_000:
            memo.clear()
        for w, n in Counter(words(text)).items():
            found = memo.get(w)
            if found is None:
                found = memo[w] = tuple(self.terms[t] for t in terms_of(w) if t in self.terms)
            for t in found:
                out[t] = out.get(t, 0) + n
        return out


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """doc_id, score and evidence (doc_id, cosine, toxic of the nearest examples) of every whole text.

    Null and empty texts, and texts without a weighted term, have no neighbours
    and get the share of toxic labels among labelled texts of that kind (with
    one prior observation: the calibrated score of a vote of 0).
    Repeated rows are scored each; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        counter = Selected(m.index.terms)
        for b in batches:
            scores, why = [], []
            for text in b.column(1):
                s, at, cos = m.score(counter.counts(text.as_py()))
                scores.append(min(1.0, max(0.0, s)))
                near = zip(m.index.ids[at[:evidence]].tolist(), cos[:evidence].tolist(), m.index.toxic[at[:evidence]].tolist())
                why.append([{"doc_id": d, "cosine": c, "toxic": int(t)} for d, c, t in near])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(why, kind)], names=["doc_id", "score", "evidence"])

    source = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(lean(score), "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        counter = Selected(m.index.terms)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            yield b.filter(pa.array([m.score(counter.counts(t.as_py()))[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def third(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def labelled_texts(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Training rows (doc_id, text, toxic): labelled, and not in the held-out third.  The higher of several labels counts.

    The classifier is fitted on about ``max_rows`` labelled ids at most (fewer
    labels are taken whole), drawn by a hash of the id, so the labels can be
    broadcast whatever the input and no text is shuffled.
    """
    known = labels.where("toxic is not null").where(third(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialize(known, "known-labels")
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    texts = narrow(docs, doc_id="doc_id", text="text").where(third(F.col("doc_id")) != 1)
    return materialize(texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic"), "labelled")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, fit(labelled_texts(docs, labels)))
    return scored.select(
        "doc_id",
        (third(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "evidence",
    )


QUERIES = {"op10_toxicity": op10_toxicity}
