"""Best-fit packing of tokenised documents into sequences, with certified bin counts."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import KEPT, lean, narrow, table, whole_runs
from cuesheet.session import materialize

CAPACITY = 2048


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A run of these behind a letter is a piece of its own (no apostrophe, nothing of a special token's ends).
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


def _head(w: bytes) -> bytes:
    """The word without the marks behind it, which are then a piece of their own: the byte before is a letter; else the whole word."""
    head = w.rstrip(MARKS)
    if not head or len(head) == len(w):
        return w
    c = head[-1]
    return head if 97 <= c <= 122 or len(head) > 1 and head[-2] == 0xC3 and 0x80 <= c <= 0xBF and c not in (0x97, 0xB7) else w


def _is_plain(w: bytes) -> bool:
    """Nothing but letters that are their own normal form, each lower-cased to one letter."""
    if w.isascii():
        return w.isalpha()
    t = w.decode("utf-8")
    return t.isalpha() and max(t) < "\u0180" and "\u0130" not in t


class WordTokens:
    """Ids of whole texts, put together from the ids of their words.

    The tokenizer drops white space, never merges across it and ignores case,
    so each text is lower-cased (A-Z), split at ASCII white space, and each
    distinct word is encoded once; a word with marks behind it is the word and
    the run of marks.  Words of plain letters need no normalising and no
    splitting and take the same model without those steps, many in one call.  About
    ``limit`` distinct words (some 70 MB) are remembered from one chunk of texts to the
    next; beyond that the half of them that occurred most stays.  That changes no result.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # every word is new to it, so it needs no memory of its own
        bare = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **{k: model[k] for k in options if model.get(k) is not None})
        self.letters = Tokenizer(bare)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(max(model["vocab"].values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.seen = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, new: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, n, total = len(self.slot), len(new), len(ids)
        while at + n > len(self.starts):
            self.starts, self.sizes, self.seen = (np.resize(a, 2 * len(a)) for a in (self.starts, self.sizes, self.seen))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = ids
        self.starts[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at : at + n] = sizes
        self.seen[at : at + n] = 0
        self.used += total
        self.slot.update(zip(new, range(at, at + n)))

    def _letters(self, run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of words of plain letters; a word's last token, and no other, ends a word."""
        text = b" ".join(run).decode("utf-8").lower()
        ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(run) and ends[-1] == len(ids):
            return ids, np.diff(ends, prepend=0)
        found = self.letters.encode(text, add_special_tokens=False)  # another kind of model
        return np.array(found.ids, np.int64), np.bincount(np.array(found.word_ids, np.int64), minlength=len(run))

    def _encode(self, new: list[bytes]) -> None:
        some = [w for w in new if _is_plain(w)]
        for at in range(0, len(some), 2000):
            run = some[at : at + 2000]
            self._add(run, *self._letters(run))
        rest = list(set(new).difference(some)) if len(some) < len(new) else []
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in rest], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(rest, np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes)

    def _slots(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these slots, one after the other, and where each word's ids end."""
        starts, sizes = self.starts[slots], self.sizes[slots]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(starts - ends + sizes, sizes)], ends

    def _learn(self, new: set[bytes]) -> None:
        """Encodes words that are not known yet."""
        heads = [(w, h) for w, h in zip(new, map(_head, new)) if len(h) < len(w)]
        marked, simple = [w for w, _ in heads], {h for _, h in heads}
        simple.update(w[len(h) :] for w, h in heads)
        self._encode(list((new.difference(marked) | simple).difference(self.slot)))
        # a word's ids are those of its head and those of its marks
        parts = np.column_stack((self._slots([h for _, h in heads]), self._slots([w[len(h) :] for w, h in heads])))
        ids, ends = self._gather(parts.ravel())
        self._add(marked, ids, np.diff(ends[1::2], prepend=0))

    def _forget(self) -> None:
        """Beyond the limit the half that occurred most stays; its counts are halved, so words of long ago go in time."""
        if len(self.slot) <= self.limit:
            return
        seen = self.seen[: len(self.slot)]
        stay = np.sort(np.argsort(-seen, kind="stable")[: self.limit // 2])
        words = list(self.slot)
        kept, counts = [words[k] for k in stay.tolist()], seen[stay] // 2
        ids, sizes = self._gather(stay)[0], self.sizes[stay]
        self._clear()
        self._add(kept, ids, sizes)
        self.seen[: len(kept)] = counts

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        lowered = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        # white space at the start or end of a text makes empty words, which have no ids
        split = pc.ascii_split_whitespace(lowered)
        counts = pc.list_value_length(split).to_numpy()
        # few words are new to a run of texts: Arrow tells them apart, and each is looked up once
        coded = pc.dictionary_encode(split.flatten())
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(known < 0).tolist()
        if unknown:
            others = [words[k] for k in unknown]
            self._learn(set(others))
            known[unknown] = self._slots(others)
        slots = known[coded.indices.to_numpy()]
        ids, ends = self._gather(slots)
        self.seen[: len(self.slot)] += np.bincount(slots, minlength=len(self.slot))
        self._forget()
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(bounds)


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """The encoder of this Python process: later tasks find the words of earlier ones."""
    return WordTokens(path)


KEPT["words"] = word_tokens.cache_clear


def chunks(column: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts (UTF-8, null: empty) of runs of rows with about ``size`` bytes."""
    first, held, total = 0, [], 0
    for i, value in enumerate(column.cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column):
        text = value.as_py() or b""
        held.append(text)
        total += len(text)
        if total >= size:
            yield first, held
            first, held, total = i + 1, [], 0
    if held:
        yield first, held


def tokenize_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: uid, doc_id, piece, start, length, ids_crc32 and, if asked for, ids (uint32 bytes).

    A document is the ids of its whole text and one ``end_id``; only documents
    longer than ``capacity`` are cut.  Null counts as empty.  ``uid`` numbers
    the pieces, so repeated rows stay apart.
    """
    path = tokenizer or default_tokenizer()
    fields = [("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.binary()))
    schema = pa.schema(fields)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(path)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            docs_of = b.column(0).to_pylist()
            for first, texts in chunks(b.column(1)):
                all_ids, counts = encoder.ids(texts)
                out: list[list] = [[] for _ in fields]
                ends = np.cumsum(counts)
                for doc, lo, hi in zip(docs_of[first:], (ends - counts).tolist(), ends.tolist()):
                    ids = np.append(all_ids[lo:hi], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        raw = ids[at : at + capacity].tobytes()
                        row = (uid, doc, k, at, len(raw) // 4, zlib.crc32(raw), raw)
                        uid += 1
                        for col, value in zip(out, row):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    ddl = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    source = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(lean(pieces, "words"), ddl)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; items come longest first."""
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i, size in enumerate(sizes.tolist()):
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int, steps: int = 40) -> int:
    """The best bound on the number of bins from two families of dual feasible functions.

    For each threshold e up to half a bin: sizes over capacity - e count as a
    whole bin, sizes under e as nothing.  For each k: sizes are rounded down to
    multiples of 1/k of a bin unless (k + 1) times the size is a whole number of bins.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    number, mass = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * x)))
    e = np.arange(0, capacity // 2 + 1)
    whole = number[-1] - number[capacity - e + 1]
    between = mass[capacity - e + 1] - mass[e]
    best = int((whole * capacity + between + capacity - 1).max() // capacity)
    for k in range(1, steps + 1):
        exact = (k + 1) * x % capacity == 0
        scaled = np.where(exact, k * x, (k + 1) * x // capacity * capacity)  # times k
        best = max(best, -int(-(scaled * count).sum() // (k * capacity)))
    return best


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = 20_000, rounds: int = 4) -> DataFrame:
    """Adds sequence_id, offset, round and the certificate of the partition: bins, bound.

    Every round deals the open pieces into partitions of about ``group`` pieces
    by a hash, packs each by best-fit decreasing and bounds its bin count from
    below.  A partition that meets its bound is certified and closed.  One that
    does not keeps its full bins and hands the pieces of the others to the next
    round, where they meet the pieces of other partitions.  The last round
    closes whatever is left.  All pieces are placed, in every round gaplessly.
    """
    spark = pieces.sparkSession
    extra = [("sequence_id", pa.int64()), ("offset", pa.int64()), ("round", pa.int32()), ("bins", pa.int64()), ("bound", pa.int64()), ("open", pa.bool_())]
    ddl_extra = "sequence_id long, offset long, round int, bins long, bound long, open boolean"
    columns = pieces.columns
    left = materialize(pieces, "pieces")
    schema_in = left.schema
    closed = []
    for r in range(rounds):
        n = left.count()
        if r and not n:
            break
        parts = max(1, -(-n // group))
        last = r == rounds - 1 or r > 0 and parts == 1

        def place(batches: Iterator[pa.RecordBatch], r=r, last=last) -> Iterator[pa.RecordBatch]:
            for t, starts in whole_runs(batches, "part"):
                for lo, hi in zip(starts[:-1], starts[1:]):
                    run = t.slice(int(lo), int(hi - lo))
                    size, uid = run.column("length").to_numpy(), run.column("uid").to_numpy()
                    order = np.lexsort((uid, -size))
                    run, size = run.take(pa.array(order)), size[order]
                    bins, offsets, fill = best_fit_decreasing(size, capacity)
                    bound = lower_bound(size, capacity)
                    gap = len(fill) > bound and not last
                    opened = np.zeros(len(size), bool) if not gap else fill[bins] < capacity
                    base = ((r << 52) | (int(run.column("part")[0].as_py()) << 24)) + bins
                    new = [base, offsets, np.full(len(size), r), np.full(len(size), len(fill)), np.full(len(size), bound), opened]
                    out = run.drop_columns(["part"])
                    for (name, kind), values in zip(extra, new):
                        out = out.append_column(name, pa.array(values, kind))
                    yield from out.combine_chunks().to_batches()

        dealt = left.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(parts)))
        schema_text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema_in.fields)
        placed = materialize(
            dealt.repartition("part").sortWithinPartitions("part").mapInArrow(lean(place, "words"), f"{schema_text}, {ddl_extra}"), "packed"
        )
        closed.append(placed.where("not open"))
        left = placed.where("open").select(*columns)
        if last:
            break
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out.drop("open", "uid")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents to packed pieces: tokenises whole texts, then packs them."""
    return pack_pieces(tokenize_pieces(docs, **options), capacity=options.get("capacity", CAPACITY))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
