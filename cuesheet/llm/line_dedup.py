"""Line dedup: segment-partition edit join of lines, verified with banded bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import components, encode, lean, narrow, prune_by_ids, run_parts, slices, table, whole_runs, words
from cuesheet.llm.linking import shared_buckets, with_texts
from cuesheet.llm.minhash import WordHash, mix, shingles, weighted_jaccard
from cuesheet.session import materialize

CLASSES = 16
#: Bytes of a line's signature: how often each class of bytes occurs (modulo 256), and the length (modulo 65,536).
SIG = CLASSES + 2
#: Bytes of lines whose keys are made at a time; the arrays for it take about 50 times that.
KEY_BYTES = 1 << 18
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 2**64)
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE_CLASS = (_BYTE_VALUE >> np.uint64(33)).astype(np.int64) % CLASSES


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift) of the substrings of a line that are looked up; the first edits + 1 are its own segments.

    A line of length l that is within ``edits`` of a line of length l - d holds
    one of the edits + 1 segments of that line at most ``shift`` places away,
    where the shift is bounded from both ends of the line (segment i: at most
    i - 1 edits before it and edits + 1 - i after it).
    """
    own = [(0, i, 0) for i in range(edits + 1)]
    more = [
        (d, i, shift)
        for d in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)
    ]
    return own + [p for p in more if p not in own]


def segments(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of the given lengths; the last segments take the remainder."""
    parts = edits + 1
    base, rest = length // parts, length % parts
    longer = np.maximum(0, i - (parts - rest))
    return i * base + longer, base + (i >= parts - rest)


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            up, down = np.full(size, np.uint64(_M)), np.full(size, np.uint64(_INVERSE))
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


def line_keys(lines: list[bytes], edits: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Keys (lines x probes, 64-bit) and signatures (lines x SIG bytes), made for about ``KEY_BYTES`` of lines at a time."""
    keys, sig = np.zeros((len(lines), len(probes(edits))), np.uint64), np.zeros((len(lines), SIG), np.uint8)
    block = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines))) // KEY_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lines)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        keys[lo:hi], sig[lo:hi] = _line_keys(lines[lo:hi], edits, powers)
    return keys, sig


def _line_keys(lines: list[bytes], edits: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(lines), np.uint8)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(n) - n
    up, down = powers.get(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[data] * up[: len(data)])))
    keys = np.zeros((len(lines), len(probes(edits))), np.uint64)
    for k, (d, i, shift) in enumerate(probes(edits)):
        at, size = segments(n - d, i, edits)
        at = at + shift
        ok = (at >= 0) & (at + size <= n) & (size > 0)
        lo = np.where(ok, start + at, 0)
        part = (sums[lo + np.where(ok, size, 0)] - sums[lo]) * down[lo]
        tag = ((n - d).astype(np.uint64) * np.uint64(64) + np.uint64(i)) * np.uint64(_M)
        # a probe that does not fit gets a key of its own line's first segment, which is there already
        keys[:, k] = np.where(ok, mix(part + mix(tag)), keys[:, 0])
    line = np.repeat(np.arange(len(lines)), n)
    bag = np.bincount(line * CLASSES + _BYTE_CLASS[data], minlength=len(lines) * CLASSES).reshape(-1, CLASSES)
    sig = np.concatenate((bag % 256, (n % 65536)[:, None] // 256, n[:, None] % 256), axis=1).astype(np.uint8)
    return keys, sig


def closeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Minus a lower bound of the edits: byte counts differ by at most two for each edit, lengths by one (both around their modulus)."""
    gap = (x[..., :CLASSES] - y[..., :CLASSES]).view(np.int8).astype(np.int16)
    size = [z[..., CLASSES].astype(np.int32) * 256 + z[..., CLASSES + 1] for z in (x, y)]
    apart = np.abs(size[0] - size[1])
    return -np.maximum((np.abs(gap).sum(axis=-1) + 1) // 2, np.minimum(apart, 65536 - apart))


def may_be_near(x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
    return closeness(x, y) >= -edits


def within_edits(xs: list[bytes], ys: list[bytes], edits: int) -> np.ndarray:
    """Whether each pair of byte strings is within ``edits``; 64-bit words hold the band of one pair.

    The band of the edit matrix slides along the diagonal, one bit for each of
    its 2 * edits + 1 rows at the top of the word; all pairs advance together.
    """
    n, m = (np.fromiter(map(len, z), np.int64, len(z)) for z in (xs, ys))
    result = np.zeros(len(xs), bool)
    todo = np.flatnonzero(np.abs(n - m) <= edits)
    short = todo[np.minimum(n, m)[todo] <= 2 * edits]
    for p in short.tolist():
        result[p] = _plain_distance(xs[p], ys[p]) <= edits
    todo = np.setdiff1d(todo, short)
    todo = todo[np.argsort(m[todo], kind="stable")]
    lo = 0
    while lo < len(todo):
        # pairs are sorted by length: so many that both matrices stay near 16 MB, whatever the length
        part = todo[lo : lo + 4096]
        width = np.maximum(n[part], m[part]).cumsum() / np.arange(1, len(part) + 1)
        part = part[: max(1, int(np.searchsorted(np.arange(1, len(part) + 1) * width, 4_000_000)))]
        result[part] = _band([xs[p] for p in part], [ys[p] for p in part], n[part], m[part], edits)
        lo += len(part)
    return result


def _plain_distance(x: bytes, y: bytes) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def _band(xs: list[bytes], ys: list[bytes], n: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    width = int(max(n.max(), m.max())) + 2 * k + 2
    a, b = np.full((width, len(xs)), 256, np.int16), np.full((width, len(xs)), 257, np.int16)
    for p, (x, y) in enumerate(zip(xs, ys)):
        a[k : k + len(x), p] = np.frombuffer(x, np.uint8)
        b[: len(y), p] = np.frombuffer(y, np.uint8)
    one = np.uint64(1)
    top = one << np.uint64(63)
    vp = np.full(len(xs), ((1 << (k + 1)) - 1) << (63 - k), np.uint64)
    vn = np.zeros(len(xs), np.uint64)
    dist = np.full(len(xs), k, np.int64)
    for i in range(int(m.max())):
        eq = np.zeros(len(xs), np.uint64)
        for j in range(2 * k + 1):  # bit 63 - j: row i + k - j, kept k places further on
            eq |= (a[i + 2 * k - j] == b[i]).astype(np.uint64) << np.uint64(63 - j)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        diagonal = i < n - k
        last = np.uint64(62) - np.maximum(i - np.maximum(n - k, 0), 0).clip(0, 62).astype(np.uint64)
        across = ((hp >> last) & one).astype(np.int64) - ((hn >> last) & one).astype(np.int64)
        change = np.where(diagonal, (d0 & top == 0).astype(np.int64), across)
        dist += np.where(i < m, change, 0)
        vp = hn | ~((d0 >> one) | hp)
        vn = (d0 >> one) & hp
    return dist <= k


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def line_id(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def line_rows(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(doc_id, th, line_no, id, n_chars, keys) of each line that is not blank.

    Keys come once for each task and line, and only for lines of ``min_chars`` or more.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    names = ["doc_id", "th", "line_no", "id", "n_chars", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()

        def out(rows, new):
            keys = line_keys([line for _, line in new], edits, powers)[0] if new else None
            cols = [list(c) for c in zip(*rows)]
            lists: list = [None] * len(rows)
            for j, (at, _) in enumerate(new):
                lists[at] = keys[j].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*cols, lists], kinds)], names=names)

        rows, new, size = [], [], 0
        for b in batches:
            for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for no, line in enumerate(split_lines(text.as_py())):
                    if not line.strip():
                        continue
                    raw = encode(line)
                    i = line_id(raw)
                    if len(line) >= min_chars and i not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(i)
                        new.append((len(rows), raw))
                        size += len(raw)
                    rows.append((doc, th, no, i, len(line)))
                    if size > 2_000_000 or len(rows) > 50_000:
                        yield out(rows, new)
                        rows, new, size = [], [], 0
        if rows:
            yield out(rows, new)

    return docs.select("doc_id", "th", "text").mapInArrow(lean(run), "doc_id long, th long, line_no int, id long, n_chars int, keys array<long>")


def texts_of(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """(id, text) of the wanted lines: a bit filter goes to the tasks (16 bits for each id, 16 MB at most), an exact join follows."""
    bits = 1 << 20
    while bits < min(1 << 27, 16 * n_ids):
        bits *= 2
    # the ids are hashes already: their low bits are the slot
    slot = F.col("id").bitwiseAND(F.lit(bits - 1))
    found = ids.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("b")).toArrow()
    mask = np.zeros(bits // 64, np.int64)
    mask[found.column("w").to_numpy()] = found.column("b").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(mask.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, seen = held.value, set()
        for b in chain.from_iterable(map(slices, batches)):
            out: list[list] = [[], []]
            for text in b.column(0):
                for line in split_lines(text.as_py()):
                    raw = encode(line)
                    i = line_id(raw)
                    at = i & bits - 1
                    if flags[at >> 3] >> (at & 7) & 1 and i not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(i)
                        out[0].append(i)
                        out[1].append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["id", "text"])

    return docs.select("text").mapInArrow(lean(run), "id long, text binary").join(ids, "id", "left_semi").dropDuplicates(["id"])


def shared_key(x: np.ndarray, y: np.ndarray, own: int) -> np.ndarray:
    """The smallest key that two lines have in common as a segment of one and a probe of the other, pair by pair."""
    best = np.full(len(x), np.iinfo(np.uint64).max, np.uint64)
    for a, b in ((x, y), (y, x)):
        for i in range(own):
            for k in range(a.shape[1]):
                same = np.flatnonzero(a[:, i] == b[:, k])
                best[same] = np.minimum(best[same], a[same, i])
    return best


def close_pairs(rows: DataFrame, edits: int) -> DataFrame:
    """Links inside buckets, without writing them: (a, b, null) a spanning forest, (a, null, n) how many lines are linked with a.

    Rows are (grp, key, slice, cross, id, text, n): a group is one slice of a
    bucket (``cross`` false) or two of them, whose members are then compared across.
    Byte counts and lengths leave few pairs; a pair that meets in several
    buckets is verified in that of its smallest shared key only.
    """
    own = edits + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for t, starts in chain.from_iterable(run_parts(*found, "text") for found in whole_runs(batches, "grp")):
            ids, n, part = (t.column(c).to_numpy() for c in ("id", "n", "slice"))
            bucket, cross = t.column("key").to_numpy().view(np.uint64), t.column("cross").to_numpy(zero_copy_only=False)
            texts = t.column("text").to_pylist()
            keys, sig = line_keys(texts, edits, powers)
            links = np.zeros(len(ids), np.int64)
            parent = list(range(len(ids)))
            edges: list[tuple[int, int]] = []

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            def verify(i: np.ndarray, j: np.ndarray) -> None:
                ok = (bucket[i] == bucket[j]) & (~cross[i] | (part[i] != part[j]))
                i, j = i[ok], j[ok]
                ok = may_be_near(sig[i], sig[j], edits)
                i, j = i[ok], j[ok]
                ok = shared_key(keys[i], keys[j], own) == bucket[i]
                i, j = i[ok], j[ok]
                ok = within_edits([texts[p] for p in i.tolist()], [texts[p] for p in j.tolist()], edits)
                i, j = i[ok], j[ok]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                for a, b in zip(i.tolist(), j.tolist()):
                    ra, rb = root(a), root(b)
                    if ra != rb:
                        parent[max(ra, rb)] = min(ra, rb)
                        edges.append((a, b))

            sizes = np.diff(starts)
            run = np.repeat(np.arange(len(sizes)), sizes)
            small = sizes[run] <= 32
            for d in range(1, min(32, int(sizes.max(initial=0)))):
                i = np.flatnonzero((run[:-d] == run[d:]) & small[:-d])
                for at in range(0, len(i), 65536):
                    verify(i[at : at + 65536], i[at : at + 65536] + d)
            for r in np.flatnonzero(sizes > 32).tolist():
                lo, hi = int(starts[r]), int(starts[r + 1])
                for at in range(lo, hi, 64):
                    x = np.arange(at, min(hi, at + 64))
                    for col in range(at, hi, 1024):
                        y = np.arange(col, min(hi, col + 1024))
                        i, j = np.nonzero(x[:, None] < y[None])
                        verify(x[i], y[j])
            some = np.flatnonzero(links)
            a = [ids[i] for i, _ in edges] + ids[some].tolist()
            b = [ids[j] for _, j in edges] + [None] * len(some)
            c = [None] * len(edges) + links[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, c)], names=["a", "b", "n"])

    columns = ["grp", "key", "slice", "cross", "id", "text", "n"]
    return rows.select(columns).repartition("grp").sortWithinPartitions("grp", "id").mapInArrow(lean(work), "a long, b long, n long")


def edit_links(docs: DataFrame, rows: DataFrame, edits: int, slice_rows: int = 1024, slice_bytes: int = 8_000_000) -> DataFrame:
    """(a, b, null) and (a, null, n) as ``close_pairs``, over all buckets of the lines with keys.

    A bucket is cut into slices of about ``slice_rows`` lines or ``slice_bytes``
    bytes, and every two of them meet in a task of their own, so no task holds
    a whole large bucket.
    """
    own = edits + 1
    keyed = rows.where("keys is not null").select("id", F.posexplode("keys").alias("k", "key"))
    buckets = materialize(shared_buckets(keyed.select("key", (F.col("k") >= own).cast("int").alias("role"), "id")), "line-buckets")
    ids = materialize(buckets.select("id").distinct(), "line-ids")
    weights = rows.join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    lines = materialize(texts_of(docs, ids, ids.count()).join(weights, "id"), "line-texts")
    members = buckets.join(lines, "id")
    sizes = buckets.join(lines.select("id", F.octet_length("text").alias("size")), "id").groupBy("key").agg(
        F.ceil(F.greatest(F.count("*") / slice_rows, F.sum("size") / slice_bytes)).cast("int").alias("parts")
    )
    cut = members.join(sizes, "key").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = [F.least("slice", "other"), F.greatest("slice", "other")]
    return close_pairs(dealt.withColumns({"grp": F.xxhash64("key", *pair), "cross": F.col("slice") != F.col("other")}), edits)


def line_classes(docs: DataFrame, edits: int = 2, min_chars: int = 24) -> DataFrame:
    """(doc_id, th, line_no, n_chars, root, first, source, links): lines in a class of two or more.

    ``docs`` are (doc_id, th, text), ``th`` a hash of the text, so that rows
    that repeat an id are told apart.  Lines of ``min_chars`` code points or more
    are linked within ``edits`` insertions, deletions or substitutions of UTF-8
    bytes, shorter ones when they are equal, blank ones never.  Classes are the
    components; ``first`` says whether the line comes first in its class (smallest
    doc_id, th, line_no), ``source`` is the document of the first, ``links`` counts
    the other lines that this one is linked with.  Equal lines are one node (64-bit hash), sent
    once by each task.
    """
    rows = materialize(line_rows(docs, edits, min_chars), "lines")
    found = materialize(edit_links(docs, rows, edits), "line-links")
    roots = components(found.where("b is not null").select("a", "b"), "line-roots")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("edit_links"))
    at = rows.select("doc_id", "th", "line_no", "n_chars", "id")
    nodes = at.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "line_no")).alias("f"))
    nodes = nodes.join(roots, "id", "left").join(links, "id", "left")
    # classes of a single line go before anything is sent back to the rows
    nodes = materialize(nodes.where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "id")), "line-nodes")
    firsts = nodes.groupBy("root").agg(F.min("f").alias("f"))
    known = nodes.select("id", "root", (F.col("n") - 1 + F.coalesce("edit_links", F.lit(0))).alias("links")).join(firsts, "root")
    mine = F.struct("doc_id", "th", "line_no") == F.col("f")
    return at.join(known, "id").select("doc_id", "th", "line_no", "n_chars", "root", mine.alias("first"), F.col("f.doc_id").alias("source"), "links")


def whole_copies(base: DataFrame, linked: DataFrame, max_share: float, similarity: float) -> DataFrame:
    """(copy) ids of documents that document dedup removes as they are.

    Asked are documents whose repeated lines hold more than ``max_share`` of
    their characters.  Such a document is compared, as a whole, with what stays
    of the earlier document that most of these characters come first in: the
    multisets of their word shingles must reach the weighted Jaccard
    ``similarity``.  An earlier document that is asked itself speaks for none, as
    what stays of it is not known yet; ids with several rows are never copies.
    """
    repeated = linked.where("not first")
    by_source = repeated.groupBy("doc_id", "source").agg(F.sum("n_chars").alias("chars"))
    other = F.when(F.col("source") != F.col("doc_id"), F.struct("chars", (-F.col("source")).alias("back")))
    best = by_source.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.max(other).alias("best"))
    sizes = base.select("doc_id", F.length("text").alias("size"))
    asked = materialize(
        best.join(sizes, "doc_id").where(F.col("chars") > max_share * F.col("size"))
        .select((-F.col("best.back")).alias("a"), F.col("doc_id").alias("b")).distinct(),
        "asked",
    )
    pairs = asked.where("a is not null").join(asked.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # an inner join: a semi join would be pushed below the pruning
    texts = prune_by_ids(base, "doc_id", ids).join(ids, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.count("*").alias("n"))
    gone = repeated.join(pairs.select(F.col("a").alias("doc_id")).distinct(), "doc_id").groupBy("doc_id").agg(F.collect_list("line_no").alias("gone"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            rest = []
            for text, lines in zip(b.column(1), b.column(2).to_pylist()):
                drop = set(lines or ())
                rest.append("\n".join(x for no, x in enumerate(split_lines(text.as_py())) if no not in drop))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rest, pa.string())], names=["id", "text"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            ok = [
                weighted_jaccard(shingles(words(x.as_py()), hashes), shingles(words(y.as_py()), hashes)) >= similarity
                for x, y in zip(b.column(2), b.column(3))
            ]
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(ok, pa.bool_()))], names=["copy"])

    # the source has the smaller id, so its text comes first in the pair
    left = texts.where("n = 1").join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(lean(strip), "id long, text string")
    return with_texts(pairs, left).mapInArrow(lean(check), "copy long")


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    edits: int = 2,
    min_chars: int = 24,
    max_share: float = 0.5,
    similarity: float = 0.8,
) -> DataFrame:
    """One row per document: doc_id, text without its repeated lines, n_lines, n_repeated, n_dropped, n_links, class_ids.

    A line is repeated if an earlier line (smaller doc_id, then line number) is
    in its class.  Repeated lines are dropped, whatever they hold of the
    document.  Only a document that is shown to be a copy as a whole is left
    whole for document dedup: its repeated lines hold more than ``max_share`` of
    its characters, and it reaches the shingle ``similarity`` with what stays of
    one earlier document (see ``whole_copies``).  ``class_ids`` are the classes of its lines
    that have company, in line order; ``n_links`` counts the other lines that they
    are linked with.  Null text stays null and has one empty line; rows that repeat an
    id with another text are documents of their own, in the order of a hash of their
    text; rows that repeat id and text are one document; rows without id are left alone;
    an empty table gives no rows.
    """
    base = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    lists = _lists(base, edits, min_chars, max_share, similarity)
    names = ["doc_id", "text", "n_lines", "n_repeated", "n_dropped", "n_links", "class_ids"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            cols: list[list] = [[] for _ in names]
            for doc, text, lines, whole in zip(*(c.to_pylist() for c in b.columns)):
                kept, n, repeated, dropped, known = _cut(text, lines, whole)
                links = sum(x["links"] for x in known.values())
                for c, v in zip(cols, (doc, kept, n, repeated, dropped, links, [known[no]["root"] for no in sorted(known)])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    ddl = "doc_id long, text string, n_lines long, n_repeated long, n_dropped long, n_links long, class_ids array<long>"
    return base.join(lists, (base["doc_id"] == lists["__id"]) & (F.xxhash64(base["text"]) == lists["__th"]), "left").select("doc_id", "text", "__lines", "__whole").mapInArrow(lean(cut), ddl)


def _lists(base: DataFrame, edits: int, min_chars: int, max_share: float, similarity: float) -> DataFrame:
    """(__id, __th, __lines, __whole): the lines of a document that have company, and whether it is left whole."""
    named = base.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    linked = materialize(line_classes(named, edits, min_chars), "linked")
    row = F.struct("line_no", "root", "first", "links")
    # rows that repeat id and text have the same lines
    lists = linked.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set(row).alias("__lines"))
    copies = whole_copies(named, linked, max_share, similarity)
    return lists.join(copies, lists["__id"] == copies["copy"], "left").select("__id", "__th", "__lines", F.col("copy").isNotNull().alias("__whole"))


def _cut(text: str | None, lines: list[dict] | None, whole: bool | None) -> tuple[str | None, int, int, int, dict]:
    """The text that stays; numbers of lines, repeated and dropped lines; the lines with company by number."""
    all_lines = split_lines(text)
    known = {x["line_no"]: x for x in lines or [] if x["line_no"] < len(all_lines)}
    repeated = {no for no, x in known.items() if not x["first"]}
    drop = set() if whole else repeated
    kept = text if not drop else "\n".join(x for no, x in enumerate(all_lines) if no not in drop)
    return kept, len(all_lines), len(repeated), len(drop), known


def drop_repeated_lines(docs: DataFrame, edits: int = 2, min_chars: int = 24, max_share: float = 0.5, similarity: float = 0.8) -> DataFrame:
    """The rows of documents (doc_id, text, n_chars and any other columns) without their repeated lines."""
    base = narrow(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    lists = _lists(base, edits, min_chars, max_share, similarity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            at = {n: i for i, n in enumerate(b.schema.names)}
            lines, whole = b.column(at["__lines"]), b.column(at["__whole"]).to_pylist()
            b = b.select([n for n in b.schema.names if n not in ("__lines", "__whole")])
            texts = b.column(at["text"]).to_pylist()
            kept = [_cut(t, x.as_py(), w)[0] for t, x, w in zip(texts, lines, whole)]
            b = b.set_column(at["text"], b.schema.field(at["text"]), pa.array(kept, b.schema.field(at["text"]).type))
            if "n_chars" in at:
                old = b.schema.field(at["n_chars"])
                sizes = [n if k == t else len(k) for k, t, n in zip(kept, texts, b.column(at["n_chars"]).to_pylist())]
                b = b.set_column(at["n_chars"], old, pa.array(sizes, old.type))
            yield b

    joined = docs.join(lists, (docs["doc_id"] == lists["__id"]) & (F.xxhash64(docs["text"]) == lists["__th"]), "left")
    return joined.select(*docs.columns, "__lines", "__whole").mapInArrow(lean(cut), docs.schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_repeated", "n_dropped", "n_links", "class_ids", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
