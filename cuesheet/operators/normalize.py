"""The corpus clean-up job: script table in, spoken text and notes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import fixed as V
from cuesheet.functions import numbers as N
from cuesheet.functions import text as X

NOTE = "array<struct<rule:string,hits:bigint>>"


def language_code(label: Column, text: Column, extra: dict[str, str] | None = None) -> Column:
    """Number-word language of a script; null means clean up only.

    A label resolves through ``extra``, then the built-in names, then itself.
    No label: English unless the text holds any non-Latin letter.
    """
    known = sorted(set(V.LANGUAGE_CODES.values()))
    name = F.lower(X.strip(label))
    base = lambda c: F.regexp_extract(c, "^[^_-]*", 0)
    valid = lambda c: F.when(c.isin(known), c).when(base(c).isin(known), base(c))
    options = [F.element_at(X.literal_map(m), name) for m in (extra or {}, V.LANGUAGE_CODES) if m] + [name]
    auto = F.when(~X.has_non_latin_letters(text), F.lit("en"))
    return F.when(label.isNull() | (label == "") | (label == "Auto"), auto).otherwise(
        F.coalesce(*[valid(c) for c in options])
    )


def resolve_lang(df: DataFrame, language: str = "language", text: str = "text") -> DataFrame:
    return df.withColumn("lang_code", language_code(F.col(language), F.col(text)))


def _replace(pattern: str, repl: str):
    return lambda t: F.regexp_replace(t, pattern, repl)


def _matches(pattern: str):
    return lambda t: F.regexp_count(t, F.lit(pattern))


def _found(pattern: str, gate=None):
    return lambda t: (gate(t) & t.rlike(pattern) if gate else t.rlike(pattern)).cast("int")


def _sanitize_steps() -> list:
    """Rule, count and change; a fourth part makes a value that both share.

    Every search is behind a cheap test that holds for all texts with a match.
    """
    none = F.lit(0)
    counted = lambda gate, pattern: X.gated(gate, _matches(pattern), none)
    swap = lambda pattern, repl, gate: ("cleaned", counted(gate, pattern), X.gated(gate, _replace(pattern, repl)))
    entities = lambda t: F.when(t.contains("&"), X.decode_entities(t)).otherwise(t)
    emphasis = X.has("*", "__")
    host = lambda t: t.contains("://") | t.rlike(r"[wW]{3}\.")
    return [
        swap(V.HTML_TAG, " ", X.has("<")),
        ("cleaned", lambda t: t.rlike("&(?:#[0-9xX]|[A-Za-z])").cast("int"), entities),
        swap(V.MD_IMAGE, " ", X.has("![")),
        swap(V.MD_LINK, "$1", X.has("](")),
        swap(V.MD_RULE, " ", X.has("-", "*", "_")),
        swap(V.MD_HEAD, "", X.has("#")),
        swap(V.MD_QUOTE, "", X.has(">")),
        swap(V.MD_CODE, "$1", X.has("`")),
        swap(V.MD_EMPHASIS, "$2", emphasis),
        swap(V.MD_EMPHASIS, "$2", emphasis),
        ("cleaned", lambda v: F.size(F.filter(v, lambda x: x["stop"])), X.join_lines, X.structural_lines),
        swap(V.BRACKETED, " ", X.has("[")),
        ("cleaned", counted(X.has("@"), V.EMAIL), X.gated(X.has("@"), X.speak_email)),
        ("cleaned", counted(host, V.URL), X.gated(host, X.speak_url)),
        swap(V.DOT_RUN, "...", X.has("....")),
        swap(V.REPEAT_PUNCT, "$1", X.has("!!", "!?", "?!", "??")),
        ("all_caps_run", lambda t: X.has_caps_run(t).cast("int"), X.fold_chars),
    ]


class _Stages:
    """One projection per rule, so that no expression is written out twice."""

    def __init__(self, df: DataFrame, text: str):
        live = F.coalesce(F.col(text).rlike(r"(?U)\S"), F.lit(False))
        self.df = df.withColumns({"__t": F.col(text), "__live": live})
        self.rules: list[str] = []

    def run(self, steps: list, when: Column) -> None:
        t = F.col("__t")
        for rule, count, change, *make in steps:
            v = t
            if make:
                self.df, v = self.df.withColumn("__made", F.when(when, make[0](t))), F.col("__made")
            new = {"__t": F.when(when, change(v)).otherwise(t)}
            if count is not None:
                n = F.when(when, count(v)).otherwise(0)
                name = f"__n_{rule}"
                if rule in self.rules:
                    new[name] = F.col(name) + n
                else:
                    self.rules.append(rule)
                    new[name] = n
            self.df = self.df.withColumns(new)

    def finish(self, out: str, extra: list[Column]) -> DataFrame:
        notes = [_note(rule, F.col(f"__n_{rule}")) for rule in self.rules]
        keep = [c for c in self.df.columns if not c.startswith("__")]
        found = F.array_compact(F.array(*notes, *extra)).cast(NOTE)
        # A filter on the result must not be pushed below: it would be written
        # out once per rule.  A projection with a row id is never crossed.  Text
        # and notes are sealed apart, so unused notes cost nothing.
        seal = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
        return self.df.select(*keep, seal(F.col("__t")).alias(out), seal(found).alias("notes"))


def _note(rule: str, hits: Column) -> Column:
    return F.when(hits > 0, F.struct(F.lit(rule).alias("rule"), hits.cast("long").alias("hits")))


def normalize_scripts(
    df: DataFrame,
    level: str = "full",
    years: bool = True,
    text: str = "text",
    language: str | None = None,
    lexicon: dict[str, str] | DataFrame | None = None,
    spaced_punct: bool = False,
    out: str = "spoken",
) -> DataFrame:
    """Add ``spoken``, ``lang_code`` and ``notes`` to a script table.

    Levels: ``off`` leaves the text alone, ``basic`` folds characters and reads
    bare numbers, ``full`` runs every rule.  ``lexicon`` is a dict, or a table
    ``(key, spoken)`` read as one scalar row.  Languages other than English get
    the clean-up only.
    """
    if level not in ("off", "basic", "full"):
        raise ValueError(f"unknown level {level!r}")
    if level == "off":
        nothing = F.array().cast(NOTE)
        return df.withColumns({out: F.col(text), "lang_code": F.lit(None).cast("string"), "notes": nothing})
    label = F.col(language) if language else F.lit(None).cast("string")
    s, live, t = _Stages(df, text), F.col("__live"), F.col("__t")
    s.run(_sanitize_steps() if level == "full" else [("fold", None, X.fold_chars)], live)
    s.run([("pauses", None, step) for step in X.pause_steps()], live)
    junk = lambda c: F.struct(X.drop_junk(c).alias("t"), c.alias("was"))
    dropped = lambda v: F.when(v["t"] != F.replace(v["was"], F.lit("\t"), F.lit(" ")), F.size(X.junk_chars(v["was"]))).otherwise(0)
    s.run([("dropped_chars", dropped, lambda v: v["t"], junk)], live)
    s.df = s.df.withColumn("lang_code", F.when(live, language_code(label, t)))
    coded, english = F.col("lang_code").isNotNull(), F.coalesce(F.col("lang_code") == "en", F.lit(False))
    if level == "full":
        lex = _lexicon_columns(lexicon)
        if lex is not None:
            pattern, mapping = lex
            if isinstance(lexicon, DataFrame):
                # A subquery may not stand inside a lambda: give it columns first.
                s.df = s.df.withColumns({"__pattern": pattern, "__mapping": mapping})
                pattern, mapping = F.col("__pattern"), F.col("__mapping")
            replaced = lambda n: F.when(n > 0, X.apply_lexicon(t, pattern, mapping)).otherwise(t)
            s.run([("lexicon", lambda n: n, replaced, lambda c: F.regexp_count(c, pattern))], coded)
        same = lambda c: c
        s.run(
            [
                ("and", None, X.gated(X.has("&"), _replace(r"(?U)\s*&\s*", " and "))),
                ("currency", _found(V.CURRENCY, X.finds(f"[{''.join(V.CURRENCY_NAMES)}]")), same),
                ("percent", lambda c: c.contains("%").cast("int"), same),
                ("times", _found(V.CLOCK, X.has(":")), same),
                ("dates", _found(V.MONTH_DAY, X.finds(r"(?U)[0-9](?<=\s[0-9])")), same),
                ("ordinals", _found(V.ORDINAL, X.finds("[0-9][sSnNrRtT\u017f]")), N.speak_forms),
            ],
            english,
        )
    s.run([("numbers", _found("[0-9](?<![A-Za-z][0-9])"), lambda c: N.speak_number(c, years))], english)
    s.run([("collapse", None, step) for step in X.collapse_steps()], live)
    extra = [_note("punctuation", F.when(live & ~coded & (t != X.strip(F.col(text))), 1).otherwise(0))]
    if spaced_punct:
        s.run([("spaced", None, X.space_before_punct)], coded)
        extra.append(_note("spaced_punctuation", F.when(coded, 1).otherwise(0)))
    return s.finish(out, extra)


def _lexicon_columns(lexicon) -> tuple[Column, Column] | None:
    if isinstance(lexicon, DataFrame):
        pairs = F.map_from_entries(F.collect_list(F.struct("key", "spoken")))
        row = lexicon.agg(pairs.alias("m")).select(
            F.struct(X.lexicon_pattern(F.map_keys("m")).alias("pattern"), F.col("m").alias("mapping")).alias("lexicon")
        )
        one = row.scalar()
        return one["pattern"], one["mapping"]
    values = V.DEFAULT_LEXICON if lexicon is None else lexicon
    return X.lexicon_columns(values) if values else None


def cleaning_report(df: DataFrame, *by: str) -> DataFrame:
    """Rule hits per group with subtotals (null group columns are totals)."""
    notes = df.select(*by, F.explode("notes").alias("note"))
    return notes.rollup(*by, F.col("note.rule").alias("rule")).agg(
        F.count(F.lit(1)).alias("scripts"), F.sum("note.hits").alias("hits")
    )


def gate_size(df: DataFrame, queued: bool = False, text: str = "text") -> DataFrame:
    """Characters are checked before words; ``size_reason`` is null when accepted."""
    max_chars, max_words = (V.QUEUED_CHARS, V.QUEUED_WORDS) if queued else (V.SYNC_CHARS, V.SYNC_WORDS)
    advice = (
        "Split it into separate projects."
        if queued
        else "Send it to POST /api/tts/async instead, which queues the work and has a far higher limit."
    )
    sized = df.withColumn("size_chars", F.length(F.coalesce(text, F.lit("")))).withColumn(
        "size_words", X.word_count(F.col(text))
    )
    say = lambda n, unit, cap: F.concat(
        F.lit("text is "), n.cast("string"), F.lit(f" {unit}; the limit is {cap}. {advice}")
    )
    reason = F.when(F.col("size_chars") > max_chars, say(F.col("size_chars"), "characters", max_chars)).when(
        F.col("size_words") > max_words, say(F.col("size_words"), "words", max_words)
    )
    return sized.withColumn("size_reason", reason)


def with_vram_estimate(df: DataFrame, text: str = "text") -> DataFrame:
    words = F.size(X.blank_words(F.col(text)))
    return df.withColumn("vram_mb", F.lit(V.MIN_FREE_MB) + words / 100.0 * V.MB_PER_100_WORDS)


def with_safe_name(df: DataFrame, col: str, out: str = "safe_name") -> DataFrame:
    return df.withColumn(out, X.safe_name(F.col(col)))


def export_texts(df: DataFrame, col: str, limit: int = 480) -> DataFrame:
    """The text as it may be sent, and whether it had to change."""
    clean = X.safe_export(F.col(col), limit)
    return df.withColumn("exported", clean).withColumn("changed", clean != F.coalesce(col, F.lit("")))
