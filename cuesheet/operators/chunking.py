"""Sentences and speakable chunks.

One script is one cell, so everything here happens inside the row: no shuffle,
order kept by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import fixed as V
from cuesheet.functions.text import MARK, strip
from cuesheet.plans.ordered import bind


def _not_an_end(fragment: Column, next_fragment: Column) -> Column:
    """The full stop of ``fragment`` belongs to an abbreviation."""
    token = F.lower(F.regexp_extract(fragment, V.TAIL_TOKEN, 1))
    before_upper = F.coalesce(next_fragment, F.lit("")).rlike(r"^\p{Lu}")
    return bind(
        token,
        lambda t: (t != "")
        & (
            t.contains(".")
            | (F.length(t) == 1)
            | t.isin(V.ABBREV_ALWAYS)
            | (t.isin(V.ABBREV_BEFORE_LOWER) & ~before_upper)
        ),
    )


def sentence_array(col: Column) -> Column:
    text = strip(F.translate(F.coalesce(col, F.lit("")), MARK, ""))
    fragments = F.split(F.regexp_replace(text, V.SENTENCE_END, f"$1{MARK}"), MARK, -1)

    def body(frags: Column) -> Column:
        closed = F.transform(
            frags,
            lambda f, i: F.when(_not_an_end(f, F.get(frags, i + 1)), f).otherwise(F.concat(f, F.lit(MARK))),
        )
        pieces = F.transform(F.split(F.array_join(closed, ""), MARK, -1), strip)
        return F.filter(pieces, lambda p: p != "")

    return bind(fragments, body)


def _pack(pieces: Column, limit: Column) -> Column:
    """Join neighbours with a blank while the result stays within ``limit``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def merge(acc: Column, p: Column) -> Column:
        fits = F.length(acc["cur"]) + 1 + F.length(p) <= limit
        empty = acc["cur"].isNull() | (acc["cur"] == "")
        return F.struct(
            F.when(empty | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"),
            F.when(empty, p).when(fits, F.concat_ws(" ", acc["cur"], p)).otherwise(p).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"].isNull() | (acc["cur"] == ""), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["cur"]))
        )

    return F.aggregate(pieces, start, merge, finish)


def _cut_at_blanks(piece: Column, limit: int) -> Column:
    """While more than twice the limit is left, cut at the last blank before it."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("cur"),
        F.length(piece).alias("left"),
    )

    def merge(acc: Column, w: Column) -> Column:
        cur = acc["cur"]
        cut = (
            cur.isNotNull()
            & (F.length(cur) > 0)
            & (acc["left"] > limit * 2)
            & (F.length(cur) + 1 + F.length(w) > limit - 1)
            & (F.length(cur) <= limit - 1)
        )
        return F.struct(
            F.when(cut, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"),
            F.when(cut | cur.isNull(), w).otherwise(F.concat(cur, F.lit(" "), w)).alias("cur"),
            F.when(cut, acc["left"] - F.length(cur) - 1).otherwise(acc["left"]).alias("left"),
        )

    cuts = F.aggregate(
        F.split(piece, " ", -1), start, merge, lambda acc: F.concat(acc["done"], F.array(acc["cur"]))
    )
    return F.when(F.length(piece) > limit * 2, cuts).otherwise(F.array(piece))


def long_split_array(sentence: Column, limit: int) -> Column:
    """Over twice the limit: split after soft breaks, then at blanks."""
    packed = _pack(F.split(sentence, V.SOFT_BREAK, -1), F.lit(limit))
    parts = F.filter(
        F.flatten(F.transform(packed, lambda p: _cut_at_blanks(p, limit))), lambda p: strip(p) != ""
    )
    return F.when(F.length(sentence) <= limit * 2, F.array(sentence)).otherwise(parts)


def _merge_once(pieces: Column, min_chars: int, ceiling: int) -> Column:
    """Join the first short piece that has a neighbour with room."""
    n = F.size(pieces)

    def room(i: Column) -> Column:
        me = F.length(F.get(pieces, i))
        prev = F.when(i > 0, F.length(F.get(pieces, i - 1)))
        nxt = F.when(i + 1 < n, F.length(F.get(pieces, i + 1)))
        ok = lambda other: F.coalesce((me < min_chars) & (other + 1 + me <= ceiling), F.lit(False))
        return F.struct(
            i.alias("i"),
            F.when(ok(prev) & ~(ok(nxt) & (nxt < prev)), i - 1).when(ok(nxt), i).alias("left"),
        )

    first = F.filter(F.transform(F.sequence(F.lit(0), n - 1), room), lambda s: s["left"].isNotNull())
    return bind(
        F.get(first, F.lit(0)),
        lambda s: F.when(s.isNull(), pieces).otherwise(
            F.concat(
                F.slice(pieces, 1, s["left"]),
                F.array(F.concat_ws(" ", F.get(pieces, s["left"]), F.get(pieces, s["left"] + 1))),
                F.slice(pieces, s["left"] + 3, n),
            )
        ),
    )


def merge_short_array(pieces: Column, min_chars: int, ceiling: int) -> Column:
    """Repeat :func:`_merge_once` as often as there can be short pieces."""
    rounds = lambda p: F.filter(p, lambda x: F.length(x) < min_chars)
    return bind(
        pieces,
        lambda p: F.when(F.size(p) < 2, p).otherwise(
            F.aggregate(rounds(p), p, lambda acc, _: _merge_once(acc, min_chars, ceiling))
        ),
    )


def with_sentences(df: DataFrame, text: str = "text", out: str = "sentences") -> DataFrame:
    return df.withColumn(out, sentence_array(F.col(text)))


def split_sentences(df: DataFrame, key: str = "script_id", text: str = "text") -> DataFrame:
    """``(key, sentence_no, sentence)`` rows in reading order."""
    return df.select(key, F.posexplode(sentence_array(F.col(text))).alias("sentence_no", "sentence"))


def split_long(sentences: DataFrame, limit: int = 200, col: str = "sentence") -> DataFrame:
    """One row per part of every sentence."""
    keep = [c for c in sentences.columns if c != col]
    return sentences.select(*keep, F.posexplode(long_split_array(F.col(col), limit)).alias("part_no", col))


def _balanced(sentences: Column, max_chars: int) -> Column:
    """Pack sentences towards the even share of the whole text; no sentences, no chunks."""

    def body(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x)) + F.greatest(F.size(parts) - 1, F.lit(0))
        chunks = lambda t: F.greatest(F.ceil(t / F.lit(max_chars)), F.lit(1))
        target = bind(total, lambda t: F.greatest(F.ceil(t / chunks(t)), F.lit(1)))
        return bind(target, lambda limit: _pack(parts, limit))

    return bind(sentences, body)


def chunk_array(col: Column, max_chars: int = 200, min_chars: int | None = None) -> Column:
    """Evenly sized groups of whole sentences of one text."""
    low = max(40, max_chars // 3) if min_chars is None else min_chars

    def body(text: Column) -> Column:
        sentences = F.flatten(F.transform(sentence_array(text), lambda x: long_split_array(x, max_chars)))
        chunks = merge_short_array(_balanced(sentences, max_chars), low, int(max_chars * 1.6))
        whole = F.array(text)
        return (
            F.when(text == "", F.array().cast("array<string>"))
            .when(F.length(text) <= max_chars, whole)
            .otherwise(bind(chunks, lambda c: F.when(F.size(c) == 0, whole).otherwise(c)))
        )

    return bind(strip(F.coalesce(col, F.lit(""))), body)


def chunk_arrays(df: DataFrame, max_chars: int = 200, min_chars: int | None = None, text: str = "text") -> DataFrame:
    """Add ``chunks`` to a script table."""
    return df.withColumn("chunks", chunk_array(F.col(text), max_chars, min_chars))


def chunk_scripts(
    df: DataFrame, key: str = "script_id", max_chars: int = 200, min_chars: int | None = None, text: str = "text"
) -> DataFrame:
    """``(key, chunk_no, text, n_chars)`` rows."""
    chunks = chunk_array(F.col(text), max_chars, min_chars)
    return df.select(key, F.posexplode(chunks).alias("chunk_no", "text")).withColumn("n_chars", F.length("text"))


def chunk_sentences(df: DataFrame, max_chars: int = 200) -> DataFrame:
    """Balanced packing alone: ``sentences`` arrays to ``chunks`` arrays."""
    return df.withColumn("chunks", _balanced(F.col("sentences"), max_chars))


def merge_short(df: DataFrame, min_chars: int, ceiling: int, col: str = "chunks") -> DataFrame:
    return df.withColumn(col, merge_short_array(F.col(col), min_chars, ceiling))


def padding_overhead(chunks: DataFrame, sizes: list[int], key: str = "script_id") -> DataFrame:
    """Share of padded work when chunks run in document order, per batch size.

    ``chunks`` holds ``(key, chunk_no, n_chars)``.
    """
    sized = chunks.withColumn("batch", F.explode(F.array(*[F.lit(int(b)) for b in sizes])))
    groups = sized.groupBy(key, "batch", F.floor(F.col("chunk_no") / F.col("batch")).alias("g")).agg(
        F.max("n_chars").alias("longest"), F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("used")
    )
    return groups.groupBy(key, "batch").agg(
        F.sum(F.col("longest") * F.col("n") - F.col("used")).alias("padding"), F.sum("used").alias("used")
    ).withColumn("overhead", F.col("padding") / F.col("used"))
