"""Token counts of whole texts; huge texts are encoded as overlapping chunks and spliced where both agree."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import lean, narrow, table
from cuesheet.session import materialize

#: The end of a chunk can hide what follows from this many code points before it: two of
#: the splitting pattern's look-ahead, and a special token with one blank before it.
GUARD = 32


#: A piece always starts at a blank behind a character that is no white space (here: those that surely are none).
UNIT = re.compile("(?<=[!-~\u00a1-\u024f]) ")
#: Marks that are a piece and a token of their own behind a word.
MARKS = (".", ",", ";", ":", "!", "?")
MAX_UNITS = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokens:
    """A byte-level BPE with offsets, and its merges alone (no splitting, no special tokens)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        self.whole = Tokenizer.from_file(path)
        self.whole.post_processor = processors.ByteLevel(trim_offsets=False)
        with open(path) as f:
            plain = json.load(f)
        plain |= {"added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}}
        self._plain, self._merges = plain, None
        self._known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of tokens: texts are cut at UNIT, and each distinct unit is encoded once.

        A word of ASCII letters with one mark behind it is the word and the mark.
        At most about MAX_UNITS units (some 60 MB) are remembered from one call
        to the next; that changes no result.
        """
        split = [UNIT.split(t) for t in texts]
        known = self._known
        new = set(chain.from_iterable(u[1:] for u in split)).difference(known)
        marked = [u for u in new if u[-1:] in MARKS and len(u) > 1 and u.isascii() and u[:-1].isalpha()]
        plain = list(new.difference(marked).union(u[:-1] for u in marked).difference(known))
        known.update(zip(plain, map(len, self.whole.encode_batch_fast([" " + u for u in plain], add_special_tokens=False))))
        known.update((u, known[u[:-1]] + 1) for u in marked)
        heads = map(len, self.whole.encode_batch_fast([u[0] for u in split], add_special_tokens=False))
        out = [h + sum(map(known.__getitem__, u[1:])) for h, u in zip(heads, split)]
        if len(known) > MAX_UNITS:
            self._known = {}
        return out

    def encode(self, text: str) -> np.ndarray:
        """Rows (start, end, id, piece) of the tokens; offsets in code points."""
        e = self.whole.encode(text, add_special_tokens=False)
        if not len(e):
            return np.zeros((0, 4), np.int64)
        return np.column_stack((np.array(e.offsets, np.int64), e.ids, e.word_ids)).astype(np.int64)

    def merged(self, text: str) -> list[int]:
        """Ids of one piece."""
        from tokenizers import Tokenizer

        if self._merges is None:
            self._merges = Tokenizer.from_str(json.dumps(self._plain))
        return self._merges.encode(text, add_special_tokens=False).ids

    def one_piece(self, text: str) -> bool:
        return len(self.whole.pre_tokenizer.pre_tokenize_str(text)) == 1


def borders(tokens: np.ndarray) -> dict[int, int]:
    """Position to index of the token that starts there, where one token ends and the next starts (not inside a character)."""
    inner = np.flatnonzero(tokens[1:, 0] == tokens[:-1, 1]) + 1
    return dict(zip(tokens[inner, 0].tolist(), inner.tolist()))


def joins(tok: ByteTokens, text: str, at: int, left: np.ndarray, right: np.ndarray, i: int, j: int) -> bool:
    """Whether tokens of one piece up to ``left[i]`` and from ``right[j]`` on are the encoding of both together.

    A sequence of tokens is the encoding of its bytes if and only if every
    adjacent pair is, so only the pair at the seam has to be encoded again.  The
    characters at the seam may be several tokens; they go along.
    """
    lb, rb = sorted(borders(left[:i]).values()), sorted(k for k in borders(right).values() if k > j)
    lo, hi = lb[-1] if lb else 0, rb[0] if rb else len(right)
    seam = text[int(left[lo, 0]) - at : int(right[hi - 1, 1]) - at]
    return tok.merged(seam) == [*left[lo:i, 2].tolist(), *right[j:hi, 2].tolist()]


def splice(tok: ByteTokens, text: str, at: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int] | None:
    """Indexes (i, j): the left tokens before i, then the right ones from j on, are the tokens of the whole text; None: no proof.

    ``text`` is what both chunks saw around the cut (it starts at ``at``, where the right
    chunk starts too, and ends where the left one ends).  A position is proven
    if both have a piece border there, since splitting goes on from a border
    whatever came before, or if it lies in one run of characters that is a single
    piece on both sides and the pair of tokens at the seam is its own encoding.
    Either way the left end's GUARD is kept.
    """
    lb, rb = borders(left), borders(right)
    end, mid = at + len(text), at + len(text) // 2
    common = sorted((p for p in lb.keys() & rb.keys() if at < p <= end - GUARD), key=lambda p: (abs(p - mid), p))
    inside = []
    for p in common:
        i, j = lb[p], rb[p]
        if left[i - 1, 3] != left[i, 3] and right[j - 1, 3] != right[j, 3]:
            return i, j
        if left[i - 1, 3] == left[i, 3] and right[j - 1, 3] == right[j, 3]:
            inside.append((p, i, j))
    for p, i, j in inside:
        mine, other = left[left[:, 3] == left[i, 3]], right[right[:, 3] == right[j, 3]]
        lo, hi = int(max(at, mine[0, 0], other[0, 0])), int(min(end, mine[-1, 1], other[-1, 1]))
        run = text[lo - at : hi - at]
        if lo < p < hi and run[0] != "'" and text[p - at] != "'" and tok.one_piece(run) and joins(tok, text, at, left, right, i, j):
            return i, j
    return None


def parse(tok: ByteTokens, feed: Iterator[str], width: int, keep: int) -> tuple[int, np.ndarray, np.ndarray, int]:
    """Tokens of a text that arrives in parts: their number, those of the first and of the last ``keep`` code points, and its length.

    Positions count from the start of the text.  The text is encoded in windows of
    ``width``; a window ends at its last piece border, or, where a piece is
    longer than the window, at a token border that is proven together with the
    next window.  Without one, the window doubles.
    """
    buffer, base, done, total = "", 0, False, 0
    head: list[np.ndarray] = []
    size, ready = width, None
    while True:
        while not done and len(buffer) < 2 * size + keep:
            part = next(feed, None)
            done = part is None
            buffer += part or ""
        last = done and len(buffer) <= size + keep
        view = buffer if last else buffer[:size]
        tokens = tok.encode(view) if ready is None or last else ready
        ready = None
        if last:
            cut = len(tokens)
        else:
            b = {p: i for p, i in borders(tokens).items() if 0 < p <= len(view) - GUARD}
            whole = [i for i in b.values() if tokens[i - 1, 3] != tokens[i, 3]]
            cut = max(whole, default=0)
            for p, i in () if cut else sorted(b.items(), reverse=True):
                if view[p] == "'" or p < 2:
                    continue
                following = tok.encode(buffer[p : p + size])
                shifted = following + np.array([p, p, 0, 0])
                if len(following) and joins(tok, buffer, 0, tokens, shifted, i, 0):
                    cut, ready = i, following if size == width else None
                    break
            if not cut:
                size *= 2
                continue
        kept = tokens[:cut] + np.array([base, base, 0, 0])
        if base < keep:
            head.append(kept[kept[:, 0] < keep])
        total += cut
        if last:
            length = base + len(buffer)
            return total, np.concatenate(head) if head else kept[:0], kept[kept[:, 1] > length - keep], length
        step = int(tokens[cut, 0])
        buffer, base, size = buffer[step:], base + step, width


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_CHUNKS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("k", pa.int32()), ("start", pa.int64()), ("core", pa.int32()), ("text", pa.string())])
_SIDES = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("cut", pa.int32()), ("side", pa.int32()), ("start", pa.int64())]
    + [("text", pa.string()), ("first", pa.int64()), ("tokens", pa.binary())]
)
_SEAMS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("cut", pa.int32()), ("ok", pa.bool_()), ("n_tokens", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column.cast(pa.large_binary()):
        yield (value.as_py() or b"").decode("utf-8", "replace")


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def count_short(docs: DataFrame, path: str, batch_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts that are encoded whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ByteTokens(path)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1).cast(pa.large_binary())), 0)
            counts: list[int] = []
            held, chars = [], 0
            for text in _texts(b.column(1)):
                held.append(text)
                chars += len(text)
                if chars > batch_chars:
                    counts += tok.counts(held)
                    held, chars = [], 0
            counts += tok.counts(held)
            yield pa.RecordBatch.from_arrays([b.column(0), sizes.cast(pa.int64()), pa.array(counts, pa.int64())], schema=_COUNTS)

    return docs.mapInArrow(lean(count), _ddl(_COUNTS))


def cut_chunks(docs: DataFrame, step: int, overlap: int) -> DataFrame:
    """Chunks of texts: ``step`` code points each (the last up to twice that), with ``overlap`` more on both sides.

    ``start`` is where the chunk's text begins in the document, ``core`` how
    many code points of it belong to the chunk before.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                size = len(text.encode("utf-8", "replace"))
                cuts = [*range(0, max(1, len(text) - step + 1), step), len(text)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    begin = max(0, lo - overlap)
                    end = hi + overlap if hi < len(text) else hi
                    yield _batch(_CHUNKS, [(uid, doc, size, k, begin, lo - begin, text[begin:end])])
                uid += 1

    return docs.mapInArrow(lean(cut), _ddl(_CHUNKS))


def encode_chunks(chunks: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """The tokens around both cuts of every group of chunks; the last group of a text gives its number of tokens.

    Rows come sorted by (uid, grp, k); a group is encoded as one text, streamed.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ByteTokens(path)
        rows = ((r, t) for b in batches for r, t in zip(b.drop_columns(["text"]).to_pylist(), _texts(b.column(b.schema.get_field_index("text")))))
        ahead = next(rows, None)
        while ahead is not None:
            first = last = ahead[0]
            edge = {"head": "", "tail": ""}

            def feed() -> Iterator[str]:
                nonlocal ahead, last
                waiting = None
                while ahead is not None and (ahead[0]["uid"], ahead[0]["grp"]) == (first["uid"], first["grp"]):
                    last, text = ahead
                    ahead = next(rows, None)
                    if waiting is None:
                        edge["head"] = text[: 2 * overlap]
                        waiting = text
                    else:
                        # the part before had the overlap already; what it does not have starts after both overlaps
                        yield waiting
                        waiting = text[last["core"] + overlap :]
                    edge["tail"] = text[-2 * overlap :]
                yield waiting

            n, head, tail, length = parse(tok, feed(), 2 * step, 2 * overlap)
            begin, more = first["start"], last["more"]
            move = np.array([begin, begin, 0, 0])
            key = (first["uid"], first["doc_id"], first["n_bytes"])
            out = []
            if first["k"]:
                out.append((*key, first["k"], 1, begin, edge["head"], 0, (head + move).tobytes()))
            if more:
                out.append((*key, last["k"] + 1, 0, begin + length - 2 * overlap, edge["tail"], n - len(tail), (tail + move).tobytes()))
            else:
                out.append((*key, last["k"] + 1, 2, begin + length, "", n, b""))
            yield _batch(_SIDES, out)

    return chunks.select("uid", "doc_id", "n_bytes", "grp", "k", "start", "core", "more", "text").mapInArrow(lean(encode), _ddl(_SIDES))


def seams(sides: DataFrame, path: str) -> DataFrame:
    """One row per cut: whether a splice was proven, and what it adds to the number of tokens of the text.

    Tokens of a text are those of its last chunk and, for each cut, those that
    the left chunk has before the splice less those that the right one has.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, left = None, None
        for b in batches:
            out = []
            for r, text in zip(b.drop_columns(["text"]).to_pylist(), _texts(b.column(b.schema.get_field_index("text")))):
                key = (r["uid"], r["doc_id"], r["n_bytes"], r["cut"])
                tokens = np.frombuffer(r["tokens"], np.int64).reshape(-1, 4)
                if r["side"] == 2:
                    out.append((*key, True, r["first"]))
                elif r["side"] == 0:
                    left = (tokens, r["first"])
                else:
                    tok = tok or ByteTokens(path)
                    found = splice(tok, text, r["start"], left[0], tokens)
                    ok = found is not None
                    out.append((*key, ok, left[1] + found[0] - found[1] if ok else 0))
            yield _batch(_SEAMS, out)

    return sides.repartition("uid", "cut").sortWithinPartitions("uid", "cut", "side").mapInArrow(lean(pair), _ddl(_SEAMS))


def count_long(docs: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts that are dealt out as chunks.

    Every cut is spliced for itself.  Texts with a cut that has no proven splice
    go into another round, where the chunks on both sides of such a cut are encoded as one
    (their overlap is all of them); a text that never agrees ends as one group,
    encoded window by window.
    """
    chunks = materialize(cut_chunks(docs, step, overlap).repartition("uid", "k"), "token-chunks")
    ends = chunks.groupBy("uid").agg(F.max("k").alias("last"))
    chunks = chunks.join(ends, "uid").withColumn("more", F.col("k") < F.col("last")).drop("last")
    groups, open_docs, cuts, out = None, chunks.withColumn("grp", F.col("k")), None, None
    while True:
        if groups is not None:
            open_docs = chunks.join(groups, ["uid", "k"]).repartition("uid", "grp").sortWithinPartitions("uid", "grp", "k")
        cuts = materialize(seams(encode_chunks(open_docs, path, step, overlap), path), "token-seams")
        counted = cuts.groupBy("uid").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.bool_and("ok").alias("ok")
        )
        good = counted.where("ok").select("doc_id", "n_bytes", "n_tokens")
        out = good if out is None else out.unionByName(good)
        failed = counted.where("not ok").select("uid")
        if failed.isEmpty():
            return out
        # chunk k goes with the group of the last cut at or before k that holds; cut 0 always does
        holds = cuts.where("ok").select("uid", F.col("cut").alias("k"), F.col("cut").alias("held"))
        before = Window.partitionBy("uid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        mine = chunks.select("uid", "k").join(failed, "uid", "left_semi")
        groups = materialize(
            mine.join(holds, ["uid", "k"], "left").select("uid", "k", F.coalesce(F.max("held").over(before), F.lit(0)).alias("grp")), "token-groups"
        )


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    limit: int = 512,
    step: int = 32768,
    overlap: int = 512,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Counts equal those of the tokenizer on the whole text, special strings
    inside texts as it takes them by default.  Texts of at most ``step`` code
    points are encoded whole; longer ones as overlapping chunks, each a row of
    its own, spliced at borders that are proven for both sides.  Null and empty
    texts have no tokens; rows that repeat an id, and rows without one, are
    counted each; empty tables give no rows.
    """
    if overlap <= GUARD or step < 2 * overlap:
        raise ValueError(f"overlap must be over {GUARD} and step at least twice the overlap")
    path = tokenizer or default_tokenizer()
    base = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = count_short(base.where(F.char_length("text") <= step), path)
    long = count_long(base.where(F.char_length("text") > step), path, step, overlap)
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op11_token_counts": op11_token_counts}
