"""Comparing a word that was sent with the word that was heard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesheet.functions import fixed as V
from cuesheet.plans.ordered import bind


def diff_tokens(col: Column) -> Column:
    """Lower-case words of ``a-z0-9'``; hyphens split, outer quotes go."""
    plain = F.translate(F.lower(F.coalesce(col, F.lit(""))), "’-", "' ")
    spaced = F.regexp_replace(plain, "[^a-z0-9' ]", " ")
    # quotes at either end of a word, sought in the text: no search per word
    unquoted = F.regexp_replace(spaced, "'(?:'*(?= |$)|(?<![^ ]')'*)", "")
    return F.array_remove(F.split(unquoted, " +"), "")


def stem(word: Column) -> Column:
    """Without one ordinary inflection, when three letters stay."""
    out = None
    for suffix in V.INFLECTIONS:
        keep = F.length(word) - len(suffix)
        base = F.substr(word, F.lit(1), keep)
        hit = word.endswith(suffix) & (keep >= 3)
        result = F.concat(base, F.lit("y")) if suffix == "ies" else base
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise(word)


def sound_key(word: Column) -> Column:
    """First letter, then consonant classes without vowels, h and doubles."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    rest = F.translate(F.translate(F.substr(letters, F.lit(2)), V.SOUND_FROM, V.SOUND_TO), "aeiouh", "")
    return F.regexp_replace(F.concat(F.substring(letters, 1, 1), rest), r"(.)\1+", "$1")


def is_critical(word: Column) -> Column:
    return word.isin(V.CRITICAL_WORDS)


def similar(a: Column, b: Column, threshold: float = V.SIMILARITY) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return 1 - F.levenshtein(a, b) / longest >= threshold


def likely_misheard(sent: Column, heard: Column, threshold: float = V.SIMILARITY) -> Column:
    """The transcriber wrote the same word its own way."""
    key = sound_key(sent)
    return (
        F.when(sent == heard, True)
        .when(is_critical(sent) | is_critical(heard), False)
        .when(stem(sent) == stem(heard), True)
        .when(similar(sent, heard, threshold), True)
        .otherwise((key != "") & (key == sound_key(heard)))
    )


def strip_soft(tokens: Column) -> Column:
    """An array without the filler words nobody counts."""
    return F.filter(tokens, lambda w: ~w.isin(V.SOFT_TOKENS))


def same_spoken_form(sent: Column, heard: Column) -> Column:
    """Only the blanks differ."""
    return (F.size(sent) > 0) & (F.size(heard) > 0) & (F.array_join(sent, "") == F.array_join(heard, ""))


def diff_errors(hard_dropped: Column, hard_inserted: Column) -> Column:
    return F.size(hard_dropped) + F.size(hard_inserted)


def pronunciation_note(misheard: Column, limit: int = 4) -> Column:
    shown = F.array_join(
        F.transform(F.slice(misheard, 1, limit), lambda p: F.concat_ws(" heard as ", p["sent"], p["heard"])), "; "
    )
    extra = F.size(misheard) - limit
    more = F.when(extra > 0, F.concat(F.lit(" (+"), extra.cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(
        F.size(misheard) > 0,
        F.concat(
            F.lit("check pronunciation: "),
            shown,
            more,
            F.lit(" — add it to the lexicon if it is really being said wrong"),
        ),
    )


def _shown(label: str, words: Column, limit: int) -> Column:
    text = F.concat(
        F.lit(label),
        F.array_join(F.slice(words, 1, limit), " "),
        F.when(F.size(words) > limit, F.lit("…")).otherwise(""),
    )
    return F.when(F.size(words) > 0, text)


def describe(diff: dict[str, Column], limit: int = 6) -> Column:
    """One readable line for a log or a job card."""
    tail = diff["tail_inserted"]
    extra = F.filter(diff["extra"], lambda w: ~F.array_contains(tail, w))
    bits = F.concat_ws(
        "; ",
        _shown("not spoken: ", diff["missing"], limit),
        _shown("extra at end: ", tail, limit),
        _shown("extra: ", extra, limit),
    )
    verified = F.concat(F.lit("verified "), F.format_number(diff["word_accuracy"] * 100, 1), F.lit("%"))
    return bind(
        bits,
        lambda b: F.when(b != "", b).otherwise(F.coalesce(pronunciation_note(diff["misheard"], limit), verified)),
    )
