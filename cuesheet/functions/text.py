"""Script clean-up rules as column expressions (no shuffle, no Python)."""

from __future__ import annotations

import json
import re
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesheet.functions import fixed as V
from cuesheet.plans.ordered import bind

# A noncharacter that never survives the clean-up; marks match borders.
MARK = "\ufdd0"


def rewrite(col: Column, pattern: str, body, gate: str | None = None) -> Column:
    """Replace every match of ``pattern`` by ``body(match)``, in context.

    ``gate`` is a cheap pattern found in every text that has a match.
    """
    marked = F.regexp_replace(F.replace(col, F.lit(MARK), F.lit("")), pattern, f"{MARK}$0{MARK}")
    pieces = F.transform(
        F.split(marked, MARK, -1), lambda p, i: F.when(i % 2 == 1, body(p)).otherwise(p)
    )
    return F.when(col.rlike(gate or pattern), F.array_join(pieces, "")).otherwise(col)


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, V.HTML_TAG, " ")


def _entity_table() -> Column:
    """Name to characters: all named entities of HTML 5, from the standard library."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _windows_table() -> Column:
    """Code points 128 to 159, which browsers read as Windows-1252; undefined ones stand for themselves."""
    codes = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
    return F.from_json(F.lit(json.dumps(codes)), "map<string,string>")


def decode_entities(col: Column) -> Column:
    """Named (HTML 5) and numeric entities of any length; unknown ones stay as they are.

    A name that begins with a legacy one (those without semicolon) is that one
    and the rest; control characters and noncharacters are dropped.
    """
    digits = lambda e: F.regexp_extract(e, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    code = lambda e: bind(
        digits(e),
        lambda d: F.when(F.length(d) > 8, F.lit(0x110000))
        .when(e.rlike("^&#[xX]"), F.coalesce(F.conv(d, 16, 10).try_cast("int"), F.when(d == "", 0).otherwise(0x110000)))
        .otherwise(F.coalesce(d.try_cast("int"), F.lit(0))),
    )
    char = lambda n: F.decode(
        F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"
    )
    dropped = lambda n: (
        n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 65534)
    )
    numeric = lambda e: bind(
        code(e),
        lambda n: F.when((n <= 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd")
        .when(n.between(128, 159), F.try_element_at(_windows_table(), n.cast("string")))
        .when(dropped(n), "")
        .otherwise(char(n)),
    )
    longest = max(len(n) for n in html5 if not n.endswith(";"))
    name = lambda e: F.substr(e, F.lit(2))
    legacy = lambda e: [
        F.concat(F.try_element_at(_entity_table(), F.substring(e, 2, k)), F.substr(e, F.lit(k + 2))) for k in range(longest, 1, -1)
    ]
    body = lambda e: F.when(e.rlike("^&#"), numeric(e)).otherwise(
        F.coalesce(F.try_element_at(_entity_table(), name(e)), *legacy(e), e)
    )
    return rewrite(col, r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)", body, gate="&")


def strip_markdown(col: Column) -> Column:
    for pattern, repl in (
        (V.MD_IMAGE, " "),
        (V.MD_LINK, "$1"),
        (V.MD_RULE, " "),
        (V.MD_HEAD, ""),
        (V.MD_QUOTE, ""),
        (V.MD_CODE, "$1"),
        (V.MD_EMPHASIS, "$2"),
        (V.MD_EMPHASIS, "$2"),
    ):
        col = F.regexp_replace(col, pattern, repl)
    return col


def structural_lines(col: Column) -> Column:
    """Lines without bullets and speaker labels, and whether each gained a stop."""
    head = r"^[ \t]{0,3}#{1,6}[ \t]*"
    blank = lambda x: strip(x) == ""

    def body(all_lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            ends = (
                line.rlike(V.BULLET)
                | line.rlike(head)
                | line.rlike(V.SPEAKER)
                | F.coalesce(blank(F.get(all_lines, i + 1)), F.lit(False))
            )
            bare = strip(F.regexp_replace(F.regexp_replace(line, V.BULLET, ""), V.SPEAKER, ""))
            stopped = lambda s: F.concat(F.regexp_replace(s, "[,;:]+$", ""), F.lit("."))
            return bind(
                F.struct(bare.alias("s"), ends.alias("e")),
                lambda v: bind(
                    v["e"] & (v["s"] != "") & ~v["s"].rlike(r"[.!?]$"),
                    lambda add: F.struct(
                        F.when(add, stopped(v["s"])).otherwise(v["s"]).alias("line"), add.alias("stop")
                    ),
                ),
            )

        return F.transform(all_lines, one)

    return bind(F.split(col, "\n", -1), body)


def join_lines(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")


def structural_stops(col: Column) -> Column:
    """Bullets and speaker labels go; the ends of thoughts gain a full stop."""
    return join_lines(structural_lines(col))


def strip_brackets(col: Column) -> Column:
    return F.regexp_replace(col, V.BRACKETED, " ")


def speak_email(col: Column) -> Column:
    return rewrite(
        col,
        V.EMAIL,
        lambda m: F.concat(
            F.substring_index(m, "@", 1),
            F.lit(" at "),
            F.replace(F.substring_index(m, "@", -1), F.lit("."), F.lit(" dot ")),
        ),
        gate="@",
    )


def spoken_host(url: Column) -> Column:
    host = F.regexp_replace(url, "(?i)^https?://", "")
    host = F.regexp_extract(host, "^[^/?#]*", 0)
    host = F.regexp_replace(F.regexp_replace(host, r"(?i)^www\.", ""), "[.,;:]+$", "")
    return F.replace(host, F.lit("."), F.lit(" dot "))


def speak_url(col: Column) -> Column:
    return rewrite(col, V.URL, spoken_host, gate=r"(?i)://|www\.")


def calm_punct(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, V.DOT_RUN, "..."), V.REPEAT_PUNCT, "$1")


def has_caps_run(col: Column) -> Column:
    return col.rlike(V.CAPS_RUN)


def fold_chars(col: Column) -> Column:
    lines = F.replace(F.replace(col, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(col.rlike(f"[{V.FOLD_FROM}]"), F.translate(lines, V.FOLD_FROM, V.FOLD_TO)).otherwise(lines)


def has(*marks: str):
    """A cheap test: the text holds one of these strings."""
    return lambda t: reduce(lambda x, y: x | y, (t.contains(m) for m in marks))


def finds(pattern: str):
    return lambda t: t.rlike(pattern)


def gated(gate, change, otherwise=None):
    """``change(t)`` where ``gate(t)`` holds; a text that fails the gate has nothing to change."""
    return lambda t: F.when(gate(t), change(t)).otherwise(t if otherwise is None else otherwise)


PAUSES = ((V.ELLIPSIS, ". "), (V.DASH, ", "), (V.ASCII_DASH, ", "), (V.SPACED_HYPHEN, ", "))


def _replaced(col: Column, rules) -> Column:
    for pattern, repl in rules:
        col = F.regexp_replace(col, pattern, repl)
    return col


def _breaks(col: Column) -> Column:
    for mark, repl in ((";", ","), ('"', " "), ("\n", " ")):
        col = F.replace(col, F.lit(mark), F.lit(repl))
    return col


def pauses(col: Column) -> Column:
    return _breaks(_replaced(col, (*PAUSES, (V.LONE_COLON, ","))))


def pause_steps() -> list:
    """:func:`pauses` in steps for a column each: a text without the rules' marks is passed over."""
    dashes = lambda t: t.rlike("[…—–―⸺⸻]") | has("--", " - ")(t)
    colon = gated(has(":"), lambda t: F.regexp_replace(t, V.LONE_COLON, ","))
    return [gated(dashes, lambda t: _replaced(t, PAUSES)), lambda t: _breaks(colon(t))]


def junk_chars(col: Column) -> Column:
    """Distinct characters that :func:`drop_junk` would remove."""
    return F.array_distinct(F.regexp_extract_all(F.replace(col, F.lit("\t"), F.lit(" ")), F.lit(V.JUNK), F.lit(0)))


def drop_junk(col: Column) -> Column:
    return F.regexp_replace(F.replace(col, F.lit("\t"), F.lit(" ")), V.JUNK, "")


def space_before_punct(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)(?<=\w)([,.])(\s|$)", " $1$2")


BLANKS = (r"[ \t]+", " ")
MARKS = (
    (r"(?U)\s+([,.!?])", "$1"),
    (r"(?U),\s*,[\s,]*", ", "),
    (r"(?U),\s*([.!?])", "$1"),
    (r"(?U)([.!?])\s*,", "$1 "),
    (r"(?U)([,.!?])(?=[^\s,.!?'\")\]])", "$1 "),
)


def collapse(col: Column) -> Column:
    return strip(_replaced(col, (BLANKS, *MARKS, BLANKS)))


def collapse_steps() -> list:
    """:func:`collapse` in steps for a column each: a text in which a rule finds nothing is passed over."""
    wide = has("  ", "\t")
    marks = lambda t: t.rlike(r"(?U)[,.!?](?:(?<=\s[,.!?])|\s*[,.!?]|[^\s,.!?'\")\]])")
    edge = lambda t: wide(t) | F.left(t, F.lit(1)).rlike(r"(?U)\s") | F.right(t, F.lit(1)).rlike(r"(?U)\s")
    return [
        gated(wide, lambda t: _replaced(t, (BLANKS,))),
        gated(marks, lambda t: _replaced(t, MARKS)),
        gated(edge, lambda t: strip(_replaced(t, (BLANKS,)))),
    ]


LEXICON_HEAD, LEXICON_TAIL = r"(?U)(?<![\w'])(?:", r")(?!\w)"


def lexicon_pattern(keys: Column) -> Column:
    """Whole-word alternation over an array of keys, longest key first."""
    by_length = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    escaped = F.transform(by_length, lambda s: F.regexp_replace(s["k"], r"([^\p{L}\p{N} ])", r"\\$1"))
    return F.concat(F.lit(LEXICON_HEAD), F.array_join(escaped, "|"), F.lit(LEXICON_TAIL))


def lexicon_columns(lexicon: dict[str, str]) -> tuple[Column, Column]:
    """Pattern and map of a lexicon given as a dict, both constants."""
    keys = sorted(lexicon, key=lambda k: (-len(k), k))
    pattern = LEXICON_HEAD + "|".join(re.escape(k) for k in keys) + LEXICON_TAIL
    return F.lit(pattern), literal_map(lexicon)


def apply_lexicon(col: Column, pattern: Column, lexicon: Column) -> Column:
    """Replace whole words by the map ``lexicon``; replaced text is not read again."""
    marked = F.regexp_replace(col, pattern, F.lit(f"{MARK}$0{MARK}"))
    pieces = F.transform(
        F.split(marked, MARK, -1), lambda p, i: F.when(i % 2 == 1, F.element_at(lexicon, p)).otherwise(p)
    )
    return F.array_join(pieces, "")


def literal_map(values: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def word_count(col: Column) -> Column:
    """Letter runs with at most one inner apostrophe, or digit runs."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"(?U)[^\W\d_]+(?:'[^\W\d_]+)?|\d+"))


def blank_words(col: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_prefix(col: Column, n: int) -> Column:
    return F.array_join(F.slice(blank_words(col), 1, n), " ")


def has_non_latin_letters(col: Column) -> Column:
    return col.rlike(r"[\p{L}&&[^\x{0000}-\x{02FF}]]")


def safe_name(col: Column, default: str = "voiceover") -> Column:
    kept = strip(F.regexp_replace(strip(F.coalesce(col, F.lit(""))), r"(?U)[^\w\- ]+", ""))
    named = F.replace(kept, F.lit(" "), F.lit("_"))
    return F.when(named == "", default).otherwise(named)


def safe_export(col: Column, limit: int = 480) -> Column:
    """Printable ASCII only: replace, cut, then trim, in this order."""
    text = F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), r"[^\x{0000}-\x{007F}]", "?")
    return strip(F.substring(F.regexp_replace(text, r"[^ -~]", " "), 1, limit))


def sha32(col: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(col, F.lit("")), 256), 1, 32)
