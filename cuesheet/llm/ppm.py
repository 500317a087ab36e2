"""LM scoring: prediction by partial matching over the bytes of words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import encode, table, whole_runs
from cuesheet.session import materialize

#: Bytes that no word holds: the end of a word, the end of a text (a word of its own), the start of a word in contexts.
WORD_END, TEXT_END, START = 0x20, 0x0A, 0x09
END_TOKEN = bytes([TEXT_END])
ORDER = 5


def tokens(text: str | None) -> list[bytes]:
    """Words (A-Z lower-cased, split at ASCII white space) without the end."""
    return encode(text).lower().split()


def grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte that a word emits: the word, the context (``order`` bytes, base 256) and the byte.

    A word emits its bytes and ``WORD_END``; the end token emits ``TEXT_END``
    alone.  Contexts stop at the start of the word: they are filled with ``START``.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    is_end = np.fromiter((w == END_TOKEN for w in words), bool, len(words))
    pad = bytes([START]) * order
    data = np.frombuffer(b"".join(pad + w + b" " for w in words), np.uint8)
    start = np.cumsum(n + order + 1) - (n + order + 1)
    emitted = np.where(is_end, 1, n + 1)
    word = np.repeat(np.arange(len(words)), emitted)
    at = np.arange(len(word)) - np.repeat(np.cumsum(emitted) - emitted, emitted) + np.repeat(start + order, emitted)
    context = np.zeros(len(at), np.int64)
    for k in range(order, 0, -1):
        context = context * 256 + data[at - k]
    return word, context, data[at].astype(np.int64)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values[:0]


def chances(context: np.ndarray, byte: np.ndarray, count: np.ndarray, low: list[dict], order: int, top: int) -> np.ndarray:
    """log10 probability of each (context, byte), by partial matching with exclusion.

    The rows are all (context, byte) of all words whose contexts share the last
    ``top`` bytes, with their training counts (0 for those that only occur
    elsewhere).  At each order from ``order`` down, with the bytes seen in the
    longer context excluded: T occurrences of D distinct bytes give a byte
    count / (T + D), and an escape D / (T + D); a context without bytes left is
    passed over.  Orders below ``top`` are given: low[k] maps a context of k
    bytes to its byte counts.  After order 0 the bytes left are equally likely.
    """
    out = np.zeros(len(context))
    open_ = np.arange(len(context))
    longer: np.ndarray | None = None  # context + 1 bytes, of the rows that are open
    seen_pairs = np.zeros(0, np.int64)
    excluded = np.zeros(0)
    for k in range(order, top - 1, -1):
        part = context % 256**k
        pairs, counts = summed(part * 256 + byte, count)
        pairs, counts = pairs[counts > 0], counts[counts > 0]
        homes, totals = summed(pairs // 256, counts)
        _, kinds = summed(pairs // 256, np.ones(len(pairs), np.int64))
        if not len(homes):
            longer = None
            continue
        mine = part[open_]
        h = np.minimum(np.searchsorted(homes, mine), len(homes) - 1)
        known = homes[h] == mine
        total, kind = np.where(known, totals[h], 0).astype(float), np.where(known, kinds[h], 0).astype(float)
        if longer is not None and len(seen_pairs):
            # what the longer context has seen is excluded: its counts at this order, summed over its bytes
            up = seen_pairs // 256
            at = np.searchsorted(pairs, up % 256**k * 256 + seen_pairs % 256)
            ids, lost = summed(up, counts[at])
            _, gone = summed(up, np.ones(len(up), np.int64))
            u = context[open_] % 256 ** (k + 1)
            e = np.minimum(np.searchsorted(ids, u), len(ids) - 1)
            hit = ids[e] == u
            total -= np.where(hit, lost[e], 0)
            kind -= np.where(hit, gone[e], 0)
        p = np.minimum(np.searchsorted(pairs, mine * 256 + byte[open_]), len(pairs) - 1)
        found = pairs[p] == mine * 256 + byte[open_]
        use = kind > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            out[open_] += np.where(use, np.log10(np.where(found, counts[p], kind) / (total + kind)), 0)
        open_ = open_[~found]
        longer, seen_pairs = part, pairs
        excluded = seen_pairs
    seen: dict[int, set] = {}
    if longer is not None and len(open_):
        for x in excluded[np.isin(excluded // 256, np.unique(longer[open_]))].tolist():
            seen.setdefault(x // 256, set()).add(x % 256)
    memo: dict[tuple[int, int], float] = {}
    for r in open_.tolist():
        c, b = int(context[r] % 256**top), int(byte[r])
        if (c, b) not in memo:
            gone, score = seen.get(c, set()), 0.0
            for k in range(top - 1, -1, -1):
                here = {x: n for x, n in low[k].get(c % 256**k, {}).items() if x not in gone}
                if not here:
                    continue
                total = sum(here.values())
                if b in here:
                    score += math.log10(here[b] / (total + len(here)))
                    break
                score += math.log10(len(here) / (total + len(here)))
                gone = gone | here.keys()
            else:
                # bytes that can follow: all but the other white space; the end of the text only at a word's start
                score -= math.log10(max(1, 256 - 4 - len(gone)))
            memo[c, b] = score
        out[r] += memo[c, b]
    return out


def block_words(placed: DataFrame, classes: int) -> DataFrame:
    """(block, word, n_0, n_1, ...): the distinct words of each block of documents, and their training counts by class there."""
    names = ["block", "word", *(f"n_{k}" for k in range(classes))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(classes)]
        others: set[bytes] = set()
        current = None

        def flush():
            words = sorted(others.union(*counts))  # neighbours share prefixes: smaller tables and shuffle files
            for at in range(0, len(words), 100_000):
                part = words[at : at + 100_000]
                cols = [pa.array([current] * len(part), pa.int64()), pa.array(part, pa.binary())]
                cols += [pa.array([c.get(w, 0) for w in part], pa.int64()) for c in counts]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            for c in counts:
                c.clear()
            others.clear()

        for b in batches:
            for block, kind, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if block != current:
                    yield from flush()
                    current = block
                ws = tokens(text.as_py())
                ws.append(END_TOKEN)
                others.update(ws) if kind is None else counts[kind].update(ws)
        yield from flush()

    dealt = placed.select("block", "kind", "text").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(count, "block long, word binary" + "".join(f", n_{k} long" for k in range(classes)))


def word_scores(counts: DataFrame, classes: int, order: int = ORDER) -> DataFrame:
    """(word, c, s_0, s_1, ...): log10 probability of every word under the model of each class; c is its count in all.

    The tries are cut by the last two bytes of the contexts: a part holds all
    contexts of order 2 and more that end in them.  Orders 0 and 1 are at most
    256 x 256 counts a class and go to every part.
    """
    spark = counts.sparkSession
    ns = [f"n_{k}" for k in range(classes)]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, context, byte = grams(b.column(0).to_pylist(), order)
            keys = context * 256 + byte
            at = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.diff(keys[at], prepend=-1))
            cols = [pa.array(keys[at][first], pa.int64())]
            cols += [pa.array(np.add.reduceat(c.to_numpy(zero_copy_only=False)[word[at]], first), pa.int64()) for c in b.columns[1:]]
            yield pa.RecordBatch.from_arrays(cols, names=["gram", *ns])

    spelled = counts.select("word", *ns).mapInArrow(spell, "gram long" + "".join(f", {n} long" for n in ns))
    distinct = materialize(spelled.groupBy("gram").agg(*(F.sum(n).alias(n) for n in ns)), "grams")
    low: list[list[dict]] = [[{}, {}] for _ in ns]
    pairs = distinct.groupBy((F.col("gram") % 65536).alias("p")).agg(*(F.sum(n).alias(n) for n in ns))
    for r in pairs.collect():  # at most 65,536 rows
        c, b = r["p"] // 256, r["p"] % 256
        for k, n in enumerate(ns):
            if r[n]:
                low[k][1].setdefault(c, {})[b] = r[n]
                low[k][0].setdefault(0, {})[b] = low[k][0].get(0, {}).get(b, 0) + r[n]
    held = spark.sparkContext.broadcast(low)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_runs(batches, "part"):
            gram = t.column("gram").to_numpy()
            ps = [chances(gram // 256, gram % 256, t.column(n).to_numpy(), held.value[k], order, 2) for k, n in enumerate(ns)]
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), *map(pa.array, ps)], names=["gram", *(f"p_{k}" for k in range(classes))])

    parted = distinct.withColumn("part", F.expr("shiftright(gram, 8) % 65536")).repartition("part").sortWithinPartitions("part")
    model = materialize(parted.mapInArrow(predict, "gram long" + "".join(f", p_{k} double" for k in range(classes))), "model")

    # every part of the words asks for its distinct grams once
    parts = max(1, -(-counts.count() // 150_000))
    in_part = counts.select("word", sum(map(F.col, ns)).alias("c"), F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, "part"):
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                _, context, byte = grams(t.column("word").slice(lo, hi - lo).to_pylist(), order)
                keys = np.unique(context * 256 + byte)
                part = np.full(len(keys), t.column("part")[lo].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(keys, pa.int64())], names=["part", "gram"])

    asked = in_part.select("word", "part").repartition("part").sortWithinPartitions("part").mapInArrow(ask, "part long, gram long")
    answers = asked.join(model, "gram")

    def spell_out(words: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        gram = known["gram"].to_numpy()
        by_gram = np.argsort(gram)
        word, context, byte = grams([bytes(w) for w in words["word"]], order)
        at = by_gram[np.searchsorted(gram[by_gram], context * 256 + byte)] if len(gram) else context
        out = {"word": words["word"], "c": words["c"]}
        for k in range(classes):
            out[f"s_{k}"] = np.bincount(word, known[f"p_{k}"].to_numpy()[at], minlength=len(words))
        return pd.DataFrame(out)

    ddl = "word binary, c long" + "".join(f", s_{k} double" for k in range(classes))
    return in_part.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(spell_out, ddl)


def score_documents(
    docs: DataFrame,
    trains: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str | None = None,
    order: int = ORDER,
    block_bytes: int = 16_000_000,
    max_classes: int = 8,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    A text is its words and one end.  The model spells each token byte by byte
    with a trie of contexts of up to ``order`` bytes inside the word, trained on
    the rows where ``trains`` holds and fixed after that, so a word costs the
    same everywhere and is computed once.  With ``class_col`` there is one trie
    for each class of the training rows (the ``max_classes`` - 1 most frequent,
    and one for the rest), and ``score`` is the log10 probability of the text
    under their mixture, weighted by their shares; the class of the scored row
    is not looked at.  ``base_score`` is the smoothed unigram.  Counts cover all
    training rows.  Documents are dealt into blocks of about ``block_bytes``;
    only the distinct words of a block travel to the model and back.  Null and
    empty texts are the end alone; repeated rows are scored (and learned from)
    each; without training rows all bytes are equally likely.
    """
    label = F.coalesce(F.col(f"`{class_col}`").cast("string"), F.lit("")) if class_col else F.lit("")
    base = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        F.coalesce(trains, F.lit(False)).alias("train"),
        label.alias("label"),
    )
    stats = base.where("train").groupBy("label").agg(F.count("*").alias("n"))
    frequent = [(r["label"], r["n"]) for r in stats.orderBy(F.desc("n"), "label").limit(max_classes - 1).collect()]
    n_docs = stats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest = n_docs - sum(n for _, n in frequent)
    classes = max(1, len(frequent) + (rest > 0))
    share = np.array([n for _, n in frequent] + [rest] * (rest > 0) or [1]) + 0.5
    prior = np.log10(share / share.sum())
    kind = F.lit(classes - 1)
    for k, (name, _) in enumerate(frequent):
        kind = F.when(F.col("label") == name, k).otherwise(kind)
    size = base.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")))), F.lit(blocks))
    placed = base.select("doc_id", "text", F.when(F.col("train"), kind).alias("kind"), block.alias("block"))
    found = materialize(block_words(placed, classes), "block-words")
    ns = [f"n_{k}" for k in range(classes)]
    counts = materialize(found.groupBy("word").agg(*(F.sum(n).alias(n) for n in ns)), "word-counts")
    scores = materialize(word_scores(counts, classes, order), "word-scores")
    n_train, v = scores.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    # of all that is shuffled these rows are the most; seven digits of a word's score are enough
    short = scores.select("word", "c", *(F.col(f"s_{k}").cast("float").alias(f"s_{k}") for k in range(classes)))
    answers = found.select("block", "word").join(short, "word")

    def score(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        slot = {bytes(w): k for k, w in enumerate(known["word"])}
        c = known["c"].to_numpy()
        s = np.stack([known[f"s_{k}"].to_numpy(np.float64) for k in range(classes)])
        unigram = np.log10((c + 0.1) / (n_train + 0.1 * (v + 1)))
        rows = []
        for doc, text in zip(texts["doc_id"], texts["text"]):
            ws = tokens(text)
            ws.append(END_TOKEN)
            at = np.fromiter(map(slot.__getitem__, ws), np.int64, len(ws))
            each = prior + s[:, at].sum(axis=1)
            top = each.max()
            mixed = float(top + np.log10((10 ** (each - top)).sum()))
            rows.append((doc, len(ws), int((c[at] > 0).sum()), n_train, float(unigram[at].sum()), mixed))
        return pd.DataFrame(rows, columns=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # ids travel as strings: a null among them would turn the others into floats
    ddl = "doc_id string, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = placed.select("block", F.col("doc_id").cast("string").alias("doc_id"), "text")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, ddl)
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    scored = score_documents(table(spark, sf_dir, "documents"), ~held_out, class_col="lang")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op5_ppm": op5_ppm}
