"""Phrase mining per language: exact counts by hash tries, spilled as sorted runs and merged per prefix."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import LOWER, UPPER, lean, narrow, table
from cuesheet.session import materialize

LONGEST = 5
#: A byte that UTF-8 never has: the end of a piece.
STOP = b"\xff"
#: A-Z to a-z, the marks that end pieces to STOP, tab to blank.
BYTES = bytes.maketrans((UPPER + ".,;:!?\n\x0b\x0c\r\t").encode(), LOWER.encode() + STOP * 10 + b" ")
#: Prefix partitions that runs are dealt into; few bits, since they travel with every row.
PARTS = 1 << 20
PAIR_MASK = np.uint64((1 << 40) - 1)
BITS_LEAST, BITS_MOST = 1 << 16, 1 << 27
_MASK = (1 << 64) - 1
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def pieces(texts: list[bytes]) -> list[bytes]:
    """Words of all texts in order, STOP after each piece and each text."""
    return STOP.join([*texts, b""]).translate(BYTES).replace(STOP, b" \xff ").split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def mix(h, word):
    """Hash of a sequence and one more word's hash: Python integers or arrays of uint64 (these wrap by themselves)."""
    if isinstance(h, int) and isinstance(word, int):
        x = ((h * _M1) & _MASK ^ word) * _M2 & _MASK
        return x ^ x >> 29
    x = (np.asarray(h, np.uint64) * np.uint64(_M1) ^ word) * np.uint64(_M2)
    return x ^ (x >> np.uint64(29))


def term(word: bytes) -> bytes:
    """A word in a key: ends with a zero byte, and keys sort as lists of words do."""
    return word.replace(b"\x01", b"\x01\x02").replace(b"\0", b"\x01\x01") + b"\0"


def phrase_of(key: bytes) -> bytes:
    words = key.split(b"\0")[:-1]
    return b" ".join(words).replace(b"\x01\x01", b"\0").replace(b"\x01\x02", b"\x01")


class Node:
    """A trie node: next word id to node or container."""

    __slots__ = ("below",)

    def __init__(self):
        self.below: dict[bytes, Node | dict[bytes, int]] = {}


class HatTrie:
    """Counts of id sequences: nodes by word id on top, hash containers of the rest of the sequence below.

    Keys are ``depth`` ids of four bytes (0: no more words).  A container with
    more than ``burst`` entries becomes a node with a container for each next id.
    """

    def __init__(self, depth: int, burst: int = 4096):
        self.depth, self.burst = depth, burst
        self.root = Node()
        self.sizes: dict[bytes, int] = defaultdict(int)

    def add(self, keys: list[bytes], counts: list[int]) -> None:
        root, sizes, burst = self.root.below, self.sizes, self.burst
        for key, n in zip(keys, counts):
            top, rest = key[:4], key[4:]
            holder, name = root, top
            box = root.get(top)
            if box is None:
                box = root[top] = {}
            while type(box) is Node:
                holder, name, rest = box.below, rest[:4], rest[4:]
                box = holder.get(name)
                if box is None:
                    box = holder[name] = {}
            old = box.get(rest)
            if old is not None:
                box[rest] = old + n
                continue
            box[rest] = n
            sizes[top] += 1
            if len(box) > burst and len(rest) > 4:
                node = Node()
                for k, v in box.items():
                    node.below.setdefault(k[:4], {})[k[4:]] = v
                holder[name] = node

    def entries(self) -> int:
        return sum(self.sizes.values())

    def take(self, least: int) -> tuple[bytes, list[int]]:
        """Removes whole subtrees of first words, the largest first, until ``least`` entries are gone: keys (joined) and counts."""
        keys: list[bytes] = []
        counts: list[int] = []

        def walk(prefix: bytes, box: Node | dict) -> None:
            if type(box) is Node:
                for name, below in box.below.items():
                    walk(prefix + name, below)
            else:
                keys.extend(prefix + k for k in box)
                counts.extend(box.values())

        for top in sorted(self.sizes, key=self.sizes.__getitem__, reverse=True):
            if len(counts) >= least:
                break
            walk(top, self.root.below.pop(top))
            del self.sizes[top]
        return b"".join(keys), counts


class Filter:
    """Which hashes may belong to frequent sequences: a bit each, a power of two of them."""

    def __init__(self, bits: bytes):
        self.words = np.frombuffer(bits, np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(64 * len(self.words) - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class Counter:
    """Counts of one language in one task: its word ids, and a trie of the sequences that start at each word."""

    def __init__(self, lang: str, depth: int, word_filter: Filter | None, pair_filter: Filter | None):
        self.lang, self.depth = lang, depth
        self.words_ok, self.pairs_ok = word_filter, pair_filter
        self.seed = word_hash(lang.encode("utf-8", "replace"))
        self.total = 0
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {STOP: 0}
        self.words: list[bytes] = [b""]
        self.hashes = np.zeros(1, np.uint64)
        self.trie = HatTrie(self.depth)
        self.single = np.zeros(1, np.int64)  # counts of single words, by id

    def _learn(self, tokens: list[bytes]) -> np.ndarray:
        """Ids of tokens; 0 for the end of a piece and for words that cannot be frequent."""
        found = np.fromiter(map(self.ids.get, tokens, repeat(-1)), np.int64, len(tokens))
        unknown = np.flatnonzero(found < 0).tolist()
        new = list({tokens[i] for i in unknown})
        if new:
            h = np.fromiter(map(word_hash, new), np.uint64, len(new))
            ok = np.ones(len(new), bool) if self.words_ok is None else self.words_ok.has(mix(np.uint64(self.seed), h))
            at = np.where(ok, len(self.words) - 1 + np.cumsum(ok), 0)
            self.ids.update(zip(new, at.tolist()))
            self.words += [w for w, good in zip(new, ok.tolist()) if good]
            self.hashes = np.concatenate((self.hashes, h[ok]))
            found[unknown] = [self.ids[tokens[i]] for i in unknown]
        return found

    def feed(self, texts: list[bytes]) -> None:
        tokens = pieces(texts)
        self.total += len(tokens) - tokens.count(STOP)
        ids = np.concatenate((self._learn(tokens), np.zeros(self.depth, np.int64)))
        n = len(tokens)
        if self.depth == 1:
            counts = np.bincount(ids[:n], minlength=len(self.words))
            counts[: len(self.single)] += self.single
            counts[0] = 0
            self.single = counts
            return
        at = np.flatnonzero(ids[:n] > 0)
        columns = [ids[at]]
        alive = np.ones(len(at), bool)
        for d in range(1, self.depth):
            alive &= ids[at + d] > 0
            if self.pairs_ok is not None:
                pair = mix(mix(np.uint64(self.seed), self.hashes[ids[at + d - 1]]), self.hashes[ids[at + d]])
                alive &= self.pairs_ok.has(pair)
            columns.append(np.where(alive, ids[at + d], 0))
        rows = np.stack(columns, axis=1).astype(">u4")
        # single words were counted in an earlier pass
        rows = rows[rows[:, 1] > 0]
        if not len(rows):
            return
        width = 4 * self.depth
        uniq, counts = np.unique(np.ascontiguousarray(rows).view(f"V{width}").ravel(), return_counts=True)
        raw = uniq.tobytes()
        self.trie.add([raw[i : i + width] for i in range(0, len(raw), width)], counts.tolist())

    def pair_hashes(self, texts: list[bytes]) -> np.ndarray:
        """Hashes of all pairs of neighbours that both may be frequent."""
        ids = self._learn(pieces(texts))
        both = (ids[1:] > 0) & (ids[:-1] > 0)
        left = mix(np.uint64(self.seed), self.hashes[ids[:-1][both]])
        return mix(left, self.hashes[ids[1:][both]]) & PAIR_MASK

    def run(self, least: int) -> Iterator[pa.RecordBatch]:
        """Whole subtrees with ``least`` entries or more as one sorted run: (part, lang, key, n)."""
        if self.depth == 1:
            ids = np.flatnonzero(self.single)[:, None]
            counts = self.single[ids[:, 0]]
            self.single = np.zeros(1, np.int64)
        else:
            raw, counts = self.trie.take(least)
            ids = np.frombuffer(raw, ">u4").astype(np.int64).reshape(-1, self.depth)
        rank = np.zeros(len(self.words), np.int64)
        rank[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        order = np.lexsort([rank[ids[:, d]] for d in reversed(range(self.depth))])
        ids, n = ids[order], np.array(counts, np.int64)[order]
        part = mix(np.uint64(self.seed), self.hashes[ids[:, 0]])
        if self.depth > 1:
            part = mix(part, self.hashes[ids[:, 1]])
        part &= np.uint64(PARTS - 1)
        ends = [b"", *map(term, self.words[1:])]
        for lo in range(0, len(ids), 20_000):
            keys = [b"".join([ends[i] for i in row]) for row in ids[lo : lo + 20_000].tolist()]
            yield _runs(part[lo : lo + 20_000].view(np.int64), self.lang, keys, n[lo : lo + 20_000])


def _runs(part: np.ndarray, lang: str, keys: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(part, pa.int64()), pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "lang", "key", "n"])


def by_language(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language at a time, about ``chunk`` bytes or the rest of a batch."""
    for b in batches:
        waiting: dict[str, list[bytes]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        for lang, value in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
            text = value.as_py() or b""
            waiting[lang].append(text)
            sizes[lang] += len(text)
            if sizes[lang] > chunk:
                yield lang, waiting.pop(lang)
                del sizes[lang]
        yield from waiting.items()


def count_pair_hashes(docs: DataFrame, word_bits, max_pairs: int = 3_000_000, max_words: int = 500_000, chunk: int = 2_000_000) -> DataFrame:
    """(hash, n): 40-bit hashes of pairs of words that may be frequent, counted in the task; docs are (lang, text).

    Equal hashes only add up, so a pair occurs no more often than its hash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Filter(word_bits.value)
        counters: dict[str, Counter] = {}
        hashes, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []

        def fold() -> None:
            nonlocal hashes, n
            new, times = np.unique(np.concatenate(fresh or [hashes[:0]]), return_counts=True)
            both = np.concatenate((hashes, new))
            hashes, at = np.unique(both, return_inverse=True)
            n = np.bincount(at, np.concatenate((n, times)), len(hashes)).astype(np.int64)
            fresh.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(n), 100_000):
                columns = [pa.array(hashes[lo : lo + 100_000].astype(np.int64)), pa.array(n[lo : lo + 100_000])]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "n"])

        for lang, held in by_language(batches, chunk):
            if lang not in counters:
                counters[lang] = Counter(lang, 2, words, None)
            fresh.append(counters[lang].pair_hashes(held))
            if sum(map(len, fresh)) > max_pairs // 2:
                fold()
                if len(n) > max_pairs:
                    yield from out()
                    hashes, n = hashes[:0], n[:0]
            if sum(len(c.ids) for c in counters.values()) > max_words:
                for c in counters.values():
                    c.clear()
        fold()
        yield from out()

    return docs.mapInArrow(lean(count), "hash long, n long")


def count_runs(docs: DataFrame, depth: int, word_bits=None, pair_bits=None, max_entries: int = 800_000, max_words: int = 500_000, chunk: int = 2_000_000) -> DataFrame:
    """Sorted runs (part, lang, key, n) of sequences of up to ``depth`` words; docs are (lang, text).

    A task holds at most about ``max_entries`` trie entries and ``max_words``
    words; beyond that it spills whole subtrees.  The word count of
    each language has the empty key.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [b and Filter(b.value) for b in (word_bits, pair_bits)]
        counters: dict[str, Counter] = {}

        def spill(least_of) -> Iterator[pa.RecordBatch]:
            for c in counters.values():
                if c.depth == 1 or c.trie.sizes:
                    yield from c.run(least_of(c))

        def feed(lang: str, held: list[bytes]) -> Iterator[pa.RecordBatch]:
            if lang not in counters:
                counters[lang] = Counter(lang, depth, *filters)
            counters[lang].feed(held)
            entries = {k: c.trie.entries() for k, c in counters.items()}
            if sum(entries.values()) > max_entries:
                yield from spill(lambda c: (entries[c.lang] + 1) // 2)
            if sum(len(c.ids) for c in counters.values()) > max_words:
                yield from spill(lambda c: 1 << 62)
                for c in counters.values():
                    c.clear()

        for lang, held in by_language(batches, chunk):
            yield from feed(lang, held)
        yield from spill(lambda c: 1 << 62)
        for c in counters.values():
            yield _runs(np.array([c.seed % PARTS], np.int64), c.lang, [b""], np.array([c.total]))

    return docs.mapInArrow(lean(count), "part long, lang string, key binary, n long")


def merge_runs(runs: DataFrame, at_least: int, shortest: int) -> DataFrame:
    """(lang, phrase, size, f, hash) of sequences of ``shortest`` words or more that occur ``at_least`` times.

    Runs are merged per prefix partition (language and first two words).  A
    sequence sorts right before those that go on from it, so its count is the
    sum of one stretch of rows: one pass, one counter for each length.
    """
    names = ["lang", "phrase", "size", "f", "hash"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, words, sums = None, [], []
        out: list[tuple] = []

        def close(depth: int) -> None:
            while len(words) > depth:
                size, f = len(words), sums.pop()
                if f >= at_least and size >= shortest:
                    h = word_hash(lang.encode("utf-8", "replace"))
                    plain = phrase_of(b"".join(w + b"\0" for w in words))
                    for w in plain.split(b" "):
                        h = mix(h, word_hash(w))
                    out.append((lang, plain.decode("utf-8", "replace"), size, f, h - (h >> 63 << 64)))
                words.pop()

        for b in batches:
            for mine, key, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if mine != lang:
                    close(0)
                    lang = mine
                if not key:
                    out.append((lang, "", 0, n, 0))
                    continue
                now = key.split(b"\0")[:-1]
                same = 0
                for x, y in zip(words, now):
                    if x != y:
                        break
                    same += 1
                close(same)
                for w in now[same:]:
                    words.append(w)
                    sums.append(0)
                for d in range(len(now)):
                    sums[d] += n
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out.clear()
        close(0)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    dealt = runs.repartition("part").sortWithinPartitions("lang", "key")
    return dealt.mapInArrow(lean(merge), "lang string, phrase string, size int, f long, hash long")


def frequent_bits(grams: DataFrame):
    """Broadcast filter of the hashes of ``grams``: 16 bits or more for each, BITS_MOST (16 MB) in all at most."""
    bits = BITS_LEAST
    n = grams.count()
    while bits < min(BITS_MOST, 16 * n):
        bits *= 2
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    rows = grams.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("word"))
    words = np.zeros(bits // 64, np.int64)
    found = rows.toArrow()
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return grams.sparkSession.sparkContext.broadcast(words.tobytes())


def frequent_phrases(docs: DataFrame, at_least: int = 100, longest: int = LONGEST, **limits: int) -> DataFrame:
    """(lang, phrase, size, f): all phrases that occur ``at_least`` times, and the empty one with the number of words.

    Three passes over the texts: words; hashes of pairs of words that may be
    frequent; sequences of 2 words or more all of whose pairs may be.  A phrase
    occurs no more often than any part of it, so none is lost; the filters (16 MB at
    most) only save rows.
    """
    few = {k: v for k, v in limits.items() if k != "max_entries"}
    words = materialize(merge_runs(count_runs(docs, 1, **limits), at_least, 1), "words")
    word_bits = frequent_bits(words.where("size = 1"))
    pairs = count_pair_hashes(docs, word_bits, **few).groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)
    pair_bits = frequent_bits(materialize(pairs.select("hash"), "pairs"))
    longer = materialize(merge_runs(count_runs(docs, longest, word_bits, pair_bits, **limits).where("key <> X''"), at_least, 2), "longer")
    for b in (word_bits, pair_bits):
        b.unpersist()
    return words.unionByName(longer).drop("hash")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    at_least: int = 100,
    top: int = 2000,
    longest: int = LONGEST,
    **limits: int,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are what blanks and tabs separate inside pieces (texts cut at
    ``.,;:!?`` and line ends), A-Z lower-cased.  A phrase of 2 to ``longest``
    words that occurs ``at_least`` times scores floor(1000 a n / (l r)) at its
    lowest-scoring cut (the first of equal ones); l and r count its parts.
    Phrases inside a phrase one word longer that occurs as often are dropped; one inside a
    longer one still is inside one of these, which then occurs as often too.
    Null texts are empty, null languages ``und``; repeated rows count each; an
    empty table gives no rows.
    """
    source = narrow(docs, lang=lang_col, text=text_col).select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    grams = frequent_phrases(source, at_least, longest, **limits)
    counts = grams.where("size > 0").select("lang", "phrase", "size", "f")
    totals = grams.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    cand = counts.where("size > 1").withColumnRenamed("f", "a")
    w = F.split("phrase", " ", -1)
    inside = (
        cand.where("size > 2")
        .select("lang", F.explode(F.array(*(F.array_join(F.slice(w, at, F.col("size") - 1), " ") for at in (1, 2)))).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    left = cand.join(inside, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a").drop("longer")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(w, F.col("k") + 1, F.col("size")), " ").alias("rest")
    )
    parts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    parts = parts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    big = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(1000 * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    best = parts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    rows = materialize(best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each slice of a language first: no task sorts a whole language
    slices = max(1, -(-rows.count() // 50_000))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    ahead = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op13_collocations": op13_collocations}

_NEXT = ", ".join(f"lead(w, {d}) OVER piece AS w{d}" for d in range(1, LONGEST))
_GRAMS = "\n      UNION ALL ".join(
    f"SELECT lang, {size} AS size, {' || '.join(['w', *(chr(39) + ' ' + chr(39) + f' || w{d}' for d in range(1, size))])} AS phrase FROM seq" + (f" WHERE w{size - 1} IS NOT NULL" if size > 1 else "")
    for size in range(1, LONGEST + 1)
)

ORACLE = {
    "op13_collocations": rf"""
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
             unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    q AS (SELECT lang, row_number() OVER () AS piece_id, string_split_regex(piece, '[\x20\x09]+') AS ws FROM p),
    t AS (SELECT lang, piece_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM q),
    seq AS (SELECT lang, w, {_NEXT} FROM (SELECT * FROM t WHERE w <> '') WINDOW piece AS (PARTITION BY piece_id ORDER BY pos)),
    total AS (SELECT lang, count(*)::HUGEINT AS n FROM seq GROUP BY lang),
    g AS (
      SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM (
      {_GRAMS})
      GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE size > 1),
    dropped AS (
      SELECT DISTINCT c.lang, c.phrase FROM c
      JOIN c longer ON c.lang = longer.lang AND longer.size > c.size AND 100 * longer.a >= 100 * c.a
        AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' ')),
    cuts AS (
      SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest
      FROM (SELECT *, unnest(range(1, size)) AS k FROM c ANTI JOIN dropped USING (lang, phrase))),
    s AS (
      SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, e.f AS r, n, 1000 * a * n // (h.f * e.f) AS score
      FROM cuts JOIN g h ON h.lang = cuts.lang AND h.phrase = head JOIN g e ON e.lang = cuts.lang AND e.phrase = rest
      JOIN total ON total.lang = cuts.lang),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
           a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM b QUALIFY rank <= 2000
    """
}
