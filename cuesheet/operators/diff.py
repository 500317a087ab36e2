"""Sent against heard: which words were dropped, added or misheard.

The words of one clip come from two text cells, so one clip is never larger
than a cell.  A diff therefore stays in the clip's row: word arrays, the
alignment, gaps and the final lists, without a shuffle.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.functions import fixed as V
from cuesheet.functions import words as W
from cuesheet.operators.normalize import normalize_scripts
from cuesheet.plans.ordered import bind, dealt

SENT, SPOKEN = 0, 1
LISTS = ("dropped", "inserted", "tail_inserted", "hard_dropped", "hard_inserted", "missing", "extra")
WORDS = "array<string>"


def token_lists(
    pairs: DataFrame,
    spoken_form: bool = True,
    key: str = "clip_id",
    sent: str = "sent",
    spoken: str = "spoken",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(clip, ..., a, b)``: the words of both texts, in the clip's row.

    With ``spoken_form`` both sides first go through the script rules, so that
    "90" and "ninety" compare equal.
    """
    rows = pairs.select(key, *carry, F.col(sent).alias("a"), F.col(spoken).alias("b"))
    for side in ("a", "b") if spoken_form else ():
        rows = normalize_scripts(rows, text=side, out="__said").drop("notes", "lang_code").withColumn(side, F.coalesce("__said", side)).drop("__said")
    return rows.select(key, *carry, W.diff_tokens(F.col("a")).alias("a"), W.diff_tokens(F.col("b")).alias("b"))


def _sided(a: Column, b: Column) -> Column:
    one = lambda words, side: F.transform(
        words, lambda w, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), w.alias("w"))
    )
    return F.concat(one(a, SENT), one(b, SPOKEN))


def tokens(
    pairs: DataFrame, spoken_form: bool = True, key: str = "clip_id", sent: str = "sent", spoken: str = "spoken"
) -> DataFrame:
    """``(clip, side, pos, w)`` for both texts of every clip.

    The clips are dealt by key before their words become rows: groupings and
    windows over the clip stay in a task of some thousand clips, however many there are.
    """
    lists = token_lists(dealt(pairs, key), spoken_form, key, sent, spoken)
    return lists.select(key, F.explode(_sided(F.col("a"), F.col("b"))).alias("t")).select(key, "t.side", "t.pos", "t.w")


def number_occurrences(tok: DataFrame, key: str = "clip_id") -> DataFrame:
    """Add ``k``: this is the k-th time the word appears on its side."""
    w = Window.partitionBy(key, "side", "w").orderBy("pos")
    return tok.withColumn("k", F.row_number().over(w))


def match_occurrences(tok: DataFrame, key: str = "clip_id") -> DataFrame:
    """Pair the k-th sent with the k-th spoken occurrence of every word.

    A full join on ``(clip, w, k)``, written as one grouping because both sides
    sit in the same table.
    """
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("pos")))
    return number_occurrences(tok, key).groupBy(key, "w", "k").agg(at(SENT).alias("sent_pos"), at(SPOKEN).alias("spoken_pos"))


def reordered(matches: DataFrame, key: str = "clip_id") -> DataFrame:
    """Matched words said behind a word that was sent before them."""
    both = matches.filter(F.col("sent_pos").isNotNull() & F.col("spoken_pos").isNotNull())
    before = Window.partitionBy(key).orderBy("sent_pos").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.col("spoken_pos") < F.max("spoken_pos").over(before)
    return both.withColumn("behind", behind).groupBy(key).agg(F.count_if("behind").alias("reordered"))


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence.

    Read from the start: equal words match; else the heard word is skipped if
    that loses nothing, else the sent one.  Lengths come from bit rows (one
    bit per heard word, one addition per sent word); only every k-th row is
    kept, and the rows between are made again on the way, so memory grows with
    the square root of the rows.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    n, m = len(a) - head, len(b) - head
    out = [(i, i) for i in range(head)]
    if not n or not m:
        return out
    masks: dict[str, int] = {}
    for j, w in enumerate(reversed(b[head:])):
        masks[w] = masks.get(w, 0) | 1 << j
    full = (1 << m) - 1
    back = [masks.get(w, 0) for w in reversed(a[head:])]

    def after(row: int, mask: int) -> int:
        hit = row & mask
        return ((row + hit) | (row - hit)) & full

    step = math.isqrt(n) + 1
    kept, row = [], full
    for i, mask in enumerate(back):
        if i % step == 0:
            kept.append(row)
        row = after(row, mask)
    block: list[int] = []
    i, j, at = n, m, -1
    while i and j:
        if at != (i - 1) // step:
            at = (i - 1) // step
            block = [kept[at]]
            for mask in back[at * step : min(n, (at + 1) * step)]:
                block.append(after(block[-1], mask))
        if back[i - 1] >> (j - 1) & 1:
            out.append((len(a) - i, len(b) - j))
            i, j = i - 1, j - 1
        elif block[i - at * step] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out


_INT = T.IntegerType()
_SPAN = T.StructType([T.StructField(n, _INT) for n in ("gap", "a_from", "a_to", "b_from", "b_to")])
_ALIGNED = T.StructType([T.StructField("matched", _INT), T.StructField("moved", _INT), T.StructField("gaps", T.ArrayType(_SPAN))])


@F.arrow_udf(_ALIGNED)
def _align(a: pa.Array, b: pa.Array) -> pa.Array:
    """Words are compared as numbers and gaps are kept as flat numbers, so a batch holds no Python object per word."""
    bounds = [pc.cumulative_sum(pc.fill_null(pc.list_value_length(side), 0)).to_pylist() for side in (a, b)]
    numbers = pc.dictionary_encode(pa.concat_arrays([a.flatten(), b.flatten()]), null_encoding="encode").indices.to_numpy()
    first_b = bounds[0][-1] if len(a) else 0
    matched, moved, spans, ends = array("i"), array("i"), array("i"), array("i", [0])
    i0 = j0 = 0
    for i1, j1 in zip(*bounds):
        sent, heard = numbers[i0:i1].tolist(), numbers[first_b + j0 : first_b + j1].tolist()
        i0, j0 = i1, j1
        pairs = _common(sent, heard)
        i = j = 0
        for g, (i_to, j_to) in enumerate((*pairs, (len(sent), len(heard)))):
            if i < i_to or j < j_to:
                spans.extend((g, i, i_to, j, j_to))
            i, j = i_to + 1, j_to + 1
        matched.append(len(pairs))
        moved.append((Counter(sent) & Counter(heard)).total() - len(pairs) if len(pairs) < min(len(sent), len(heard)) else 0)
        ends.append(len(spans) // len(_SPAN.names))
    none = a.is_null()
    flat = np.array(spans, np.int32).reshape(-1, len(_SPAN.names))
    gap_rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(len(_SPAN.names))], _SPAN.names)
    counts = [pc.if_else(none, None, pa.array(c, pa.int32())) for c in (matched, moved)]
    return pa.StructArray.from_arrays([*counts, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), gap_rows, mask=none)], _ALIGNED.names)


def _sealed(c: Column) -> Column:
    """A value that the optimizer does not write out again wherever it is used."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def align(lists: DataFrame) -> DataFrame:
    """Add the alignment of ``a`` and ``b``: ``matched``, ``moved`` and ``gaps``.

    Words match in order, as many as can (see ``_common``).  ``moved`` counts the
    words that are missing at one place and said at another.  A gap is what lies
    between two matches: ``gap`` (how many matches come before it), its words
    ``a`` and ``b``, and ``b_from``, the position of its first heard word.  Clips
    whose words are equal have no gaps and are not sent to the aligner.
    """
    same = F.col("a") == F.col("b")
    found = lists.withColumn("__al", _sealed(_align(F.when(~same, F.col("a")), F.when(~same, F.col("b")))))
    al = F.col("__al")
    cut = lambda words, lo, hi: F.slice(F.col(words), lo + 1, hi - lo).alias(words)
    gaps = F.transform(
        al["gaps"],
        lambda g: F.struct(g["gap"].alias("gap"), cut("a", g["a_from"], g["a_to"]), cut("b", g["b_from"], g["b_to"]), g["b_from"].alias("b_from")),
    )
    none = F.array().cast("array<struct<gap:int,a:array<string>,b:array<string>,b_from:int>>")
    return found.withColumns(
        {"matched": F.coalesce(al["matched"], F.size("a")), "moved": F.coalesce(al["moved"], F.lit(0)), "gaps": F.coalesce(gaps, none)}
    ).drop("__al")


def gaps(aligned: DataFrame, key: str = "clip_id") -> DataFrame:
    """Unmatched words between the same two matches, one row per gap that has any."""
    return aligned.select(key, F.explode("gaps").alias("g")).select(key, "g.gap", "g.a", "g.b")


def _pairs(a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("sent"), b.alias("heard")), lambda p: F.struct(p["sent"].alias("sent"), p["heard"].alias("heard")))


def _kind(a: Column, b: Column, threshold: float) -> Column:
    both = (F.size(a) > 0) & (F.size(b) > 0)
    alike = (F.size(a) == F.size(b)) & F.forall(_pairs(a, b), lambda p: W.likely_misheard(p["sent"], p["heard"], threshold))
    return F.when(both & W.same_spoken_form(a, b), "respaced").when(both & alike, "misheard").otherwise("defect")


def _misheard(kind: Column, a: Column, b: Column) -> Column:
    none = F.array().cast("array<struct<sent:string,heard:string>>")
    respaced = F.array(F.struct(F.array_join(a, " ").alias("sent"), F.array_join(b, " ").alias("heard")))
    return F.when(kind == "respaced", respaced).when(kind == "misheard", _pairs(a, b)).otherwise(none)


def pair_substitutions(gap_rows: DataFrame, threshold: float = V.SIMILARITY) -> DataFrame:
    """Split every gap into missing, extra and misheard words."""
    a, b, kind = F.col("a"), F.col("b"), F.col("kind")
    defect, empty = kind == "defect", F.array().cast(WORDS)
    return gap_rows.withColumn("kind", _kind(a, b, threshold)).withColumns(
        {"missing": F.when(defect, a).otherwise(empty), "extra": F.when(defect, b).otherwise(empty), "misheard": _misheard(kind, a, b)}
    )


def diff_lists(lists: DataFrame, key: str = "clip_id", threshold: float = V.SIMILARITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """The word diff of every clip of a table ``(clip, ..., a, b)``: no shuffle, everything stays in the clip's row.

    ``keep`` names columns of the alignment (``b``, ``gaps``) to be kept as well.
    """
    carried = [c for c in lists.columns if c not in ("a", "b")]

    def told(g: Column) -> Column:
        a, b = g["a"], g["b"]
        parts = [g[f].alias(f) for f in ("gap", "a", "b", "b_from")]
        return bind(_kind(a, b, threshold), lambda k: F.struct(*parts, k.alias("kind"), _misheard(k, a, b).alias("misheard")))

    rows = align(lists).withColumn("gaps", _sealed(F.transform("gaps", told)))
    every = lambda field, keep=None: F.flatten(F.transform(F.filter("gaps", keep) if keep else F.col("gaps"), lambda g: g[field]))
    defect = lambda g: g["kind"] == "defect"
    last = F.try_element_at(F.col("gaps"), F.lit(-1))
    tail = F.when((last["gap"] == F.col("matched")) & (F.size(last["a"]) == 0), last["b"])
    staged = rows.select(
        *carried,
        *keep,
        F.size("a").alias("sent_words"),
        F.size("b").alias("spoken_words"),
        every("a").alias("dropped"),
        every("b").alias("inserted"),
        F.coalesce(tail, F.array().cast(WORDS)).alias("tail_inserted"),
        every("a", defect).alias("missing"),
        every("b", defect).alias("extra"),
        every("misheard").alias("misheard"),
        F.bround(F.col("matched") / F.greatest(F.size("a"), F.lit(1)), 4).alias("word_accuracy"),
        F.col("moved").alias("reordered"),
    )
    return staged.select(
        *carried,
        *keep,
        *("sent_words", "spoken_words", "dropped", "inserted", "tail_inserted"),
        *(W.strip_soft(F.col(c)).alias(n) for n, c in (("hard_dropped", "dropped"), ("hard_inserted", "inserted"), ("missing", "missing"), ("extra", "extra"))),
        *("misheard", "word_accuracy", "reordered"),
    ).withColumn("ok", (F.size("hard_dropped") == 0) & (F.size("hard_inserted") == 0))


def word_diff(pairs: DataFrame, spoken_form: bool = True, key: str = "clip_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Word diff of ``(clip_id, sent, spoken)`` rows, counts and order respected.

    As many words as can match in order do (see ``align``): a moved word is
    dropped at one place and inserted at another; ``reordered`` counts those.
    ``carry`` names columns that stay in the row.
    """
    return diff_lists(token_lists(pairs, spoken_form, key, carry=carry), key)


def word_counts(pairs: DataFrame, spoken_form: bool = True, key: str = "clip_id") -> DataFrame:
    """Counts of the diff only: no positions, so words are merged before the shuffle."""
    n = lambda side: F.count_if(F.col("side") == side)
    per_word = tokens(pairs, spoken_form, key).groupBy(key, "w").agg(n(SENT).alias("s"), n(SPOKEN).alias("h"))
    both = F.least("s", "h")
    return per_word.groupBy(key).agg(
        F.sum("s").alias("sent_words"),
        F.sum("h").alias("spoken_words"),
        F.sum(both).alias("matched"),
        F.sum(F.col("s") - both).alias("dropped"),
        F.sum(F.col("h") - both).alias("inserted"),
    )


def membership_diff(tok: DataFrame, key: str = "clip_id") -> DataFrame:
    """Sent words that appear nowhere in the spoken text (blind to counts)."""
    spoken = tok.filter(F.col("side") == SPOKEN).select(key, "w").distinct()
    lost = tok.filter(F.col("side") == SENT).join(spoken, [key, "w"], "left_anti")
    return lost.groupBy(key).agg(F.count(F.lit(1)).alias("absent"))


def bigram_accuracy(tok: DataFrame, key: str = "clip_id") -> DataFrame:
    """Occurrence matching of neighbouring word pairs: an order-aware check."""
    order = Window.partitionBy(key, "side").orderBy("pos")
    pairs = tok.withColumn("w", F.concat_ws(" ", "w", F.lead("w").over(order)))
    pairs = pairs.filter(F.col("w").contains(" "))
    n = lambda side: F.count_if(F.col("side") == side)
    per = pairs.groupBy(key, "w").agg(n(SENT).alias("s"), n(SPOKEN).alias("h"))
    return per.groupBy(key).agg(
        F.bround(F.sum(F.least("s", "h")) / F.greatest(F.sum("s"), F.lit(1)), 4).alias("bigram_accuracy")
    )


def with_verdicts(diffs: DataFrame) -> DataFrame:
    """passed, clean, worth_regenerating and only_tail_is_wrong per diff."""
    col, size = F.col, F.size
    clean = (size("missing") == 0) & (size("extra") == 0)
    garbled = (size("misheard") >= 3) & (size("misheard") / F.greatest("sent_words", F.lit(1)) > 0.5)
    non_tail = F.filter("extra", lambda w: ~F.array_contains(col("tail_inserted"), w))
    return diffs.withColumns(
        {
            "passed": (size("hard_dropped") == 0)
            & (size("hard_inserted") == 0)
            & (col("word_accuracy") >= V.MIN_ACCURACY),
            "clean": clean,
            "worth_regenerating": ~clean | garbled,
            "only_tail_is_wrong": (size("missing") == 0) & (size("tail_inserted") > 0) & (size(non_tail) == 0),
        }
    )


def describe(diffs: DataFrame, limit: int = 6) -> DataFrame:
    names = ("missing", "extra", "tail_inserted", "misheard", "word_accuracy")
    return diffs.withColumns(
        {
            "summary": W.describe({n: F.col(n) for n in names}, limit),
            "note": W.pronunciation_note(F.col("misheard")),
        }
    )


DIFF = ("sent_words", "spoken_words", *LISTS[:5], "missing", "extra", "misheard", "word_accuracy", "reordered", "ok")


def _without_unsaid_marks(spoken: Column, b: Column, gaps: Column) -> Column:
    """The text without the currency marks whose unit word matches nothing; null where all of them match.

    A mark before a number makes one unit word, behind its amount.  The unit
    words of the reading ``b``, in order, are those of the marks and those
    that were written out, in order; where their numbers differ (a
    unit inside something that is not read), all marks go.
    """
    events = F.regexp_extract_all(spoken, F.lit(f"({V.CURRENCY_MARK})(?=\\s?[0-9])|(?i)(?<![\\w'])(?:{'|'.join(V.UNIT_WORDS)})(?![\\w'])"), F.lit(0))
    units = F.array_compact(F.transform(b, lambda w, i: F.when(w.isin(*V.UNIT_WORDS), i)))
    unsaid = lambda at: F.exists(gaps, lambda g: (at >= g["b_from"]) & (at < g["b_from"] + F.size(g["b"])))
    told = F.transform(F.arrays_zip(events.alias("e"), units.alias("u")), lambda z: F.when(z["e"].rlike(f"^{V.CURRENCY_MARK}"), unsaid(z["u"])))
    marks = F.regexp_extract_all(spoken, F.lit(f"({V.CURRENCY_MARK})(?=\\s?[0-9])"), F.lit(1))
    drop = F.when(F.size(events) == F.size(units), F.array_compact(told)).otherwise(F.transform(marks, lambda m: F.lit(True)))
    parts = F.split(spoken, f"{V.CURRENCY_MARK}(?=\\s?[0-9])", -1)

    def text(v: Column) -> Column:
        rest = F.transform(F.slice(v["parts"], 2, F.size(v["parts"])), lambda p, i: F.concat(F.when(F.get(v["drop"], i), F.lit("")).otherwise(F.get(v["marks"], i)), p))
        return F.when(F.exists(v["drop"], lambda d: d), F.concat(F.get(v["parts"], F.lit(0)), F.array_join(rest, "")))

    return bind(F.struct(parts.alias("parts"), marks.alias("marks"), drop.alias("drop")), text)


def best_reading(pairs: DataFrame, key: str = "clip_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Word diff with the transcriber read charitably, and which ``reading`` was taken.

    Clips that fail as written (0) are read with clock dots as colons (1) and
    without the currency marks whose unit was not said (2); a reading is taken
    only when it has fewer errors than those before it.  Each clip stays in its row.
    """
    lists = token_lists(pairs, True, key, carry=(*carry, "spoken"))
    rows = diff_lists(lists.withColumn("a_words", F.col("a")), key, keep=("b", "gaps"))
    spoken, failed = F.col("spoken"), ~F.col("ok")
    clock = F.when(failed & spoken.rlike(V.CLOCK_DOT), F.regexp_replace(spoken, V.CLOCK_DOT, "$1:$2"))
    money = F.when(failed & spoken.rlike(V.CURRENCY_MARK), _without_unsaid_marks(spoken, F.col("b"), F.col("gaps")))
    own = [key, *carry, "a_words"]
    rows = rows.select(*own, _sealed(F.struct(*DIFF, F.lit(0).alias("reading"))).alias("d0"), _sealed(clock).alias("t1"), _sealed(money).alias("t2"))
    for n in (1, 2):
        held = [c for c in rows.columns if c not in ("a_words", f"t{n}")]
        said = normalize_scripts(rows, text=f"t{n}", out="__said").drop("notes", "lang_code")
        other = W.diff_tokens(F.coalesce("__said", f"t{n}"))
        tried = said.select(*held, "a_words", F.col("a_words").alias("a"), F.when(F.col(f"t{n}").isNull(), F.col("a_words")).otherwise(other).alias("b"), F.col(f"t{n}").isNotNull().alias("tried_on"))
        rows = diff_lists(tried, key).select(*held, "a_words", _sealed(F.when(F.col("tried_on"), F.struct(*DIFF, F.lit(n).alias("reading")))).alias(f"d{n}"))
    errors = lambda d: W.diff_errors(d["hard_dropped"], d["hard_inserted"])
    ranked = F.array_compact(F.array(*(F.when(F.col(d).isNotNull(), F.struct(errors(F.col(d)).alias("errors"), F.lit(n).alias("n"))) for n, d in enumerate(("d0", "d1", "d2")))))
    best = F.array_min(ranked)["n"]
    return rows.select(key, *carry, _sealed(F.when(best == 0, F.col("d0")).when(best == 1, F.col("d1")).otherwise(F.col("d2"))).alias("d")).select(key, *carry, "d.*")
