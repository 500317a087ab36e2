"""From buckets of candidates to verified links, without writing out the pairs of a bucket.

Two rounds give the same components as all verified pairs of all buckets:
first every member of a bucket against its most central member, then only pairs
that the first round has left in different components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.common import components, lean, slices, whole_runs
from cuesheet.session import materialize

PAIRS = "a long, b long"

#: (signatures, signatures) -> closeness (higher: more alike), row by row; shapes broadcast, the last axis is the signature.
Close = Callable[[np.ndarray, np.ndarray], np.ndarray]


def fixed_bytes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A column of equally long byte strings as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    both = np.unique(np.stack((lo, hi), axis=1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], names=["a", "b"])


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(key, id) of buckets with two ids or more; rows are (key, role, id).

    Role 0 is an entry of the index, role 1 a probe; buckets without an entry
    fall away.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, "key"):
            key, role, ids = (t.column(c).to_numpy() for c in ("key", "role", "id"))
            run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            other = np.zeros(len(starts) - 1, bool)
            np.logical_or.at(other, run, ids != ids[starts[:-1]][run])
            ok = (other & (role[starts[:-1]] == 0))[run]
            yield pa.RecordBatch.from_arrays([pa.array(x[ok], pa.int64()) for x in (key, ids)], names=["key", "id"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "role", "id")
    return dealt.mapInArrow(lean(keep), "key long, id long").distinct()


def star_pairs(rows: DataFrame, close: Close, least: float, width: int, sample: int = 64) -> DataFrame:
    """Pairs of the members of a bucket with its centre that may be similar; rows are (key, id, sig).

    The centre is the member with the highest closeness to ``sample`` members
    spread over the bucket: the original, where a bucket holds its variants.
    Which member is taken decides only how much is left for the second round.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, "key"):
            ids, sig = t.column("id").to_numpy(), fixed_bytes(t.column("sig"), width)
            run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            centre = starts[:-1].copy()
            for r in np.flatnonzero(np.diff(starts) > 2).tolist():
                lo, hi = int(starts[r]), int(starts[r + 1])
                some = sig[np.unique(np.linspace(lo, hi - 1, min(sample, hi - lo)).astype(np.int64))]
                total = np.concatenate([close(sig[at : min(hi, at + 512), None], some[None]).sum(axis=1) for at in range(lo, hi, 512)])
                centre[r] = lo + int(np.argmax(total))
            mid = centre[run]
            i = np.flatnonzero(mid != np.arange(len(run)))
            i = i[close(sig[i], sig[mid[i]]) >= least]
            yield _pairs(ids[i], ids[mid[i]])

    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(lean(pair), PAIRS).distinct()


def histogram(hashes: np.ndarray, bins: int = 512) -> bytes:
    """How many elements of a multiset fall into each of ``bins`` bins (a power of two), a byte each; 255: that many or more."""
    return np.minimum(np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def may_reach(similarity: float, size: np.ndarray, bag: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of multisets, given by size and histogram, can have that Jaccard similarity.

    Equal elements share a bin, so two multisets have at most the sum of the
    smaller counts of each bin in common.  Pairs that are full in the same bin
    have no bound and stay.
    """
    least = np.minimum(bag[i], bag[j])
    common = least.sum(axis=1, dtype=np.int64)
    return (common >= similarity * (size[i] + size[j] - common) - 1e-6) | (least == 255).any(axis=1)


def cross_pairs(rows: DataFrame, close: Close, least: float, width: int, similarity: float | None = None) -> DataFrame:
    """Pairs (a < b) of a bucket that lie in different components and may be similar.

    Rows are (key, comp, id, sig), and with ``similarity`` also (size, bag): the
    number of elements and their ``histogram``.  Pairs whose histograms rule the
    Jaccard ``similarity`` out are not written.
    """
    numbers = ["size", "bag"] if similarity is not None else []

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, "key"):
            comp, ids = t.column("comp").to_numpy(), t.column("id").to_numpy()
            sig = fixed_bytes(t.column("sig"), width)
            if numbers:
                size = t.column("size").to_numpy()
                bag = np.frombuffer(b"".join(t.column("bag").to_pylist()), np.uint8).reshape(len(size), -1)

            def near(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
                ok = close(sig[i], sig[j]) >= least
                i, j = i[ok], j[ok]
                if numbers and len(i):
                    ok = may_reach(similarity, size, bag, i, j)
                    i, j = i[ok], j[ok]
                if len(i):
                    yield _pairs(ids[i], ids[j])

            run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            sizes = np.diff(starts)
            small = sizes[run] <= 32
            for d in range(1, min(32, int(sizes.max()))):
                i = np.flatnonzero((run[:-d] == run[d:]) & (comp[:-d] != comp[d:]) & small[:-d])
                for at in range(0, len(i), 65536):
                    yield from near(i[at : at + 65536], i[at : at + 65536] + d)
            for r in np.flatnonzero(sizes > 32).tolist():
                lo, hi = int(starts[r]), int(starts[r + 1])
                for at in range(lo, hi, 64):
                    x = np.arange(at, min(hi, at + 64))
                    # rows are sorted by component: only later components are new
                    first = lo + int(np.searchsorted(comp[lo:hi], comp[at], side="right"))
                    for col in range(first, hi, 1024):
                        y = np.arange(col, min(hi, col + 1024))
                        i, j = np.nonzero(comp[x, None] < comp[None, y])
                        yield from near(x[i], y[j])

    columns = ["key", "comp", "id", "sig", *numbers]
    return rows.select(columns).repartition("key").sortWithinPartitions("key", "comp", "id").mapInArrow(lean(pair), PAIRS).distinct()


def link(
    rows: DataFrame,
    sigs: DataFrame,
    close: Close,
    least: float,
    width: int,
    verify: Callable[[DataFrame], DataFrame],
    name: str,
    bags: Callable[[DataFrame], DataFrame] | None = None,
    similarity: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) and components (id, root) of ids that share a bucket and are similar.

    ``rows`` are (key, role, id), ``sigs`` (id, sig) with one row per id.  Every
    pair of a bucket whose closeness is ``least`` or more either lies in one
    component after the first round or is verified in the second, so the
    components are those of all verified pairs.  ``bags`` gives (id, size, bag) of
    the ids it is given; with it the second round leaves out pairs that cannot
    reach the Jaccard ``similarity`` (see ``cross_pairs``).
    """
    buckets = materialize(shared_buckets(rows), f"{name}-buckets")
    stars = materialize(star_pairs(buckets.join(sigs, "id"), close, least, width), f"{name}-stars")
    first = materialize(verify(stars), f"{name}-links")
    roots = components(first, f"{name}-first")
    placed = buckets.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rest = placed.join(mixed, "key")
    if bags is not None:
        rest = materialize(rest, f"{name}-rest")
        rest = rest.join(materialize(bags(rest.select("id").distinct()), f"{name}-bags"), "id")
    pairs = materialize(cross_pairs(rest.join(sigs, "id"), close, least, width, similarity if bags else None).join(stars, ["a", "b"], "left_anti"), f"{name}-pairs")
    if pairs.isEmpty():
        return first, roots
    links = materialize(first.unionByName(verify(pairs)), f"{name}-links")
    return links, components(links, f"{name}-all")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, ta, tb): one exchange of the texts (id, text; one row per id), one of the pairs."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a", "b")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain.from_iterable(map(slices, batches)):
            out: list[list] = [[], [], [], []]
            for a, c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if held is not None and held[:2] == (a, c):
                    for col, v in zip(out, (a, c, held[2].as_py(), text.as_py())):
                        col.append(v)
                    held = None
                else:
                    held = (a, c, text)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["a", "b", "ta", "tb"])

    dealt = need.join(texts, "id").repartition("a", "b").sortWithinPartitions("a", "b", "id")
    return dealt.select("a", "b", "text").mapInArrow(lean(join), "a long, b long, ta string, tb string")
