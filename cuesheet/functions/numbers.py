"""English number speech as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesheet.functions import fixed as V
from cuesheet.functions.text import literal_map, rewrite
from cuesheet.plans.ordered import bind

_ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen"
).split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_HUNDRED = _ONES + [t if u == 0 else f"{t}-{_ONES[u]}" for t in _TENS for u in range(10)]
_THOUSAND = {
    joint: _HUNDRED + [f"{_ONES[h]} hundred" + (joint + _HUNDRED[r] if r else "") for h in range(1, 10) for r in range(100)]
    for joint in (" ", " and ")
}
_SCALES = [""] + [
    f" {s}illion" if s != "thousand" else " thousand"
    for s in "thousand m b tr quadr quint sext sept oct non dec".split()
]
_LAST_ORDINAL = {
    "one": "first", "two": "second", "three": "third", "five": "fifth",
    "eight": "eighth", "nine": "ninth", "twelve": "twelfth",
}
MAX_DIGITS = 3 * len(_SCALES)


def _ordinal_of(words: str) -> str:
    last = re.search("[a-z]+$", words)[0]
    form = _LAST_ORDINAL.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return words[: -len(last)] + form


_ORDINALS = [_ordinal_of(w) for w in _HUNDRED]


def _words_list(values: list[str]) -> Column:
    return F.split(F.lit("|".join(values)), r"\|")


def _below_hundred(n: Column) -> Column:
    return F.get(_words_list(_HUNDRED), n)


def _below_thousand(n: Column, joint: str) -> Column:
    hundreds, rest = F.floor(n / 100).cast("int"), n % 100
    tail = F.when(rest > 0, F.concat(F.lit(joint), _below_hundred(rest))).otherwise("")
    return F.when(n < 100, _below_hundred(n)).otherwise(
        F.concat(_below_hundred(hundreds), F.lit(" hundred"), tail)
    )


def cardinal(digits: Column, style: str = "us") -> Column:
    """``'1234'`` to words; null beyond the named scales."""
    joint = " and " if style == "uk" else " "

    def spoken(groups: Column) -> Column:
        n = F.size(groups)
        last = F.element_at(groups, -1)
        upper = F.filter(
            F.transform(
                F.slice(groups, 1, n - 1),
                lambda g, i: F.when(
                    g > 0, F.concat(_below_thousand(g, joint), F.get(_words_list(_SCALES), n - 1 - i))
                ),
            ),
            lambda w: w.isNotNull(),
        )
        return bind(
            upper,
            lambda u: F.when(F.size(u) == 0, _below_thousand(last, joint))
            .when(last == 0, F.array_join(u, ", "))
            .otherwise(
                F.concat(
                    F.array_join(u, ", "),
                    F.when(last < 100, F.lit(" and ")).otherwise(F.lit(", ")),
                    _below_thousand(last, joint),
                )
            ),
        )

    def grouped(d: Column) -> Column:
        width = (F.ceil(F.length(d) / 3) * 3).cast("int")
        padded = F.lpad(d, width, F.lit("0"))
        return bind(
            padded,
            lambda p: F.transform(
                F.sequence(F.lit(1), F.length(p), F.lit(3)), lambda i: F.substr(p, i, F.lit(3)).cast("int")
            ),
        )

    def small(n: Column) -> Column:
        """Below a million: two words from a table."""
        word = lambda k: F.get(_words_list(_THOUSAND[joint]), k)
        rest = n % 1000
        tail = F.when(rest == 0, F.lit("")).otherwise(F.concat(F.when(rest < 100, F.lit(" and ")).otherwise(F.lit(", ")), word(rest)))
        return F.when(n < 1000, word(n)).otherwise(F.concat(word(F.floor(n / 1000).cast("int")), F.lit(" thousand"), tail))

    def large(digits: Column) -> Column:
        trimmed = F.regexp_replace(digits, "^0+(?=[0-9])", "")
        return bind(trimmed, lambda d: F.when(d.rlike(f"^[0-9]{{1,{MAX_DIGITS}}}$"), bind(grouped(d), spoken)))

    return bind(digits, lambda d: F.when(d.rlike("^[0-9]{1,6}\\z"), bind(d.cast("int"), small)).otherwise(large(d)))


def _as_ordinal(words: Column) -> Column:
    last = F.regexp_extract(words, "[a-z]+$", 0)
    form = F.coalesce(
        F.element_at(literal_map(_LAST_ORDINAL), last),
        F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", ""), F.lit("ieth"))),
        F.concat(last, F.lit("th")),
    )
    return F.concat(F.regexp_replace(words, "[a-z]+$", ""), form)


def ordinal(digits: Column) -> Column:
    return bind(cardinal(digits), _as_ordinal)


def digit_words(digits: Column) -> Column:
    chars = F.filter(F.split(digits, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: _below_hundred(c.cast("int"))), " ")


def _year(digits: Column) -> Column:
    """Two pairs of digits; round thousands are read as cardinals elsewhere."""
    low = F.substring(digits, 3, 2).cast("int")
    tail = (
        F.when(low == 0, "hundred")
        .when(low < 10, F.concat(F.lit("oh-"), _below_hundred(low)))
        .otherwise(_below_hundred(low))
    )
    return F.concat_ws(" ", _below_hundred(F.substring(digits, 1, 2).cast("int")), tail)


def number_words(raw: Column, years: bool = True) -> Column:
    """Words of a written number, null when it is not one.

    Four digits from 1100 to 2099 read as a year, except ``x00y`` ones.
    """

    def body(n: Column) -> Column:
        whole = cardinal(F.substring_index(n, ".", 1))
        fraction = F.regexp_replace(F.substring_index(n, ".", -1), "(?<=[0-9])0+$", "")
        spoken = F.when(n.rlike(r"^[0-9]+$"), whole).when(
            n.rlike(r"^[0-9]+\.[0-9]+$"), F.concat(whole, F.lit(" point "), digit_words(fraction))
        )
        return F.when(n.rlike("^(?:1[1-9]|20)[0-9]{2}$") & ~n.rlike("^200"), _year(n)).otherwise(spoken) if years else spoken

    return bind(F.replace(raw, F.lit(","), F.lit("")), body)


def speak_currency(col: Column) -> Column:
    one = literal_map({k: v[0] for k, v in V.CURRENCY_NAMES.items()})
    many = literal_map({k: v[1] for k, v in V.CURRENCY_NAMES.items()})

    def body(m: Column) -> Column:
        sign = F.substring(m, 1, 1)
        amount = F.regexp_extract(m, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0)
        scale = F.lower(F.regexp_extract(m, "(?i)(?:" + V.SCALE_WORDS + ")$", 0))
        single = (scale == "") & (F.replace(amount, F.lit(","), F.lit("")).cast("double") == 1.0)
        unit = F.when(single, F.element_at(one, sign)).otherwise(F.element_at(many, sign))
        words = number_words(amount, years=False)
        return F.coalesce(F.concat_ws(" ", words, F.when(scale != "", scale), unit), m)

    return rewrite(col, V.CURRENCY, body)


def speak_percent(col: Column) -> Column:
    spoken = rewrite(
        col,
        V.PERCENT,
        lambda m: F.coalesce(
            F.concat(number_words(F.regexp_extract(m, r"^[0-9][0-9,.]*", 0), years=False), F.lit(" percent")), m
        ),
    )
    return F.replace(spoken, F.lit("%"), F.lit(" percent"))


def speak_time(col: Column) -> Column:
    def body(m: Column) -> Column:
        hour, minute = F.substring_index(m, ":", 1), F.substring_index(m, ":", -1)
        m_int = minute.cast("int")
        return F.concat(
            cardinal(hour),
            F.when(m_int == 0, F.lit(" o'clock"))
            .when(m_int < 10, F.concat(F.lit(" oh "), cardinal(minute)))
            .otherwise(F.concat(F.lit(" "), cardinal(minute))),
        )

    return rewrite(col, V.CLOCK, body)


def speak_date(col: Column) -> Column:
    def body(m: Column) -> Column:
        month, day = F.regexp_extract(m, "^[A-Za-z]+", 0), F.regexp_extract(m, "[0-9]+$", 0)
        return F.when(day.cast("int").between(1, 31), F.concat_ws(" ", month, ordinal(day))).otherwise(m)

    return rewrite(col, V.MONTH_DAY, body)


def speak_ordinal(col: Column) -> Column:
    return rewrite(col, V.ORDINAL, lambda m: F.coalesce(ordinal(F.regexp_extract(m, "^[0-9]+", 0)), m))


def _grouped_digits(token: Column) -> Column:
    digits = F.regexp_replace(token, "[^0-9]", "")
    parts = F.filter(F.split(token, "[^0-9]+"), lambda g: g != "")
    plain = F.when(
        F.length(digits) == 10,
        F.array(F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 4)),
    ).otherwise(F.regexp_extract_all(digits, F.lit("[0-9]{1,3}"), F.lit(0)))
    groups = F.when(F.size(parts) < 2, plain).otherwise(parts)
    return F.array_join(F.transform(groups, digit_words), ", ")


def speak_forms(col: Column) -> Column:
    """Money, percentages, clock times, dates and ordinals in one pass.

    Every kind of match needs the words of at most one whole number, so the
    number is spelled once and the kind only picks what stands around it.
    """
    one = literal_map({k: v[0] for k, v in V.CURRENCY_NAMES.items()})
    many = literal_map({k: v[1] for k, v in V.CURRENCY_NAMES.items()})

    def body(m: Column) -> Column:
        amount = F.replace(F.regexp_extract(m, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0), F.lit(","), F.lit(""))
        return bind(F.struct(m.alias("m"), amount.alias("n")), shaped)

    def shaped(v: Column) -> Column:
        m, n = v["m"], v["n"]
        whole = cardinal(F.substring_index(n, ".", 1))
        return bind(whole, lambda w: F.coalesce(kind(m, n, w), m))

    def kind(m: Column, n: Column, w: Column) -> Column:
        fraction = F.regexp_replace(F.substring_index(n, ".", -1), "(?<=[0-9])0+$", "")
        number = F.when(n.contains("."), F.concat(w, F.lit(" point "), digit_words(fraction))).otherwise(w)
        sign = F.substring(m, 1, 1)
        scale = F.lower(F.regexp_extract(m, "(?i)(?:" + V.SCALE_WORDS + ")$", 0))
        nth = F.when(n.rlike("^[0-9]{1,2}\\z"), F.get(_words_list(_ORDINALS), n.cast("int"))).otherwise(_as_ordinal(w))
        unit = F.when((scale == "") & (n.cast("double") == 1.0), F.element_at(one, sign)).otherwise(
            F.element_at(many, sign)
        )
        minute = F.substring_index(m, ":", -1)
        minutes = (
            F.when(minute == "00", F.lit(" o'clock"))
            .when(minute.startswith("0"), F.concat(F.lit(" oh "), _below_hundred(minute.cast("int"))))
            .otherwise(F.concat(F.lit(" "), _below_hundred(minute.cast("int"))))
        )
        return (
            F.when(sign.isin(*V.CURRENCY_NAMES), F.concat_ws(" ", number, F.when(scale != "", scale), unit))
            .when(m.endswith("%"), F.concat(number, F.lit(" percent")))
            .when(m.contains(":"), F.concat(w, minutes))
            .when(m.rlike("^[A-Za-z]") & n.cast("int").between(1, 31), F.concat_ws(" ", F.regexp_extract(m, "^[A-Za-z]+", 0), nth))
            .when(m.rlike("(?i)^[0-9]+(?:st|nd|rd|th)$"), nth)
        )

    return F.replace(rewrite(col, V.SPOKEN_FORMS, body, gate="[0-9]"), F.lit("%"), F.lit(" percent"))


def speak_number(col: Column, years: bool = True, digit_run: int = V.DIGIT_RUN) -> Column:
    """Bare numbers; long runs digit by digit, ranges and ordinals left alone."""

    def body(m: Column) -> Column:
        n_digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
        short = m.rlike("^[0-9]{1,3}\\z") & F.lit(digit_run > 3)
        return (
            F.when(short, F.get(_words_list(_THOUSAND[" "]), m.cast("int")))
            .when(m.rlike("[A-Za-z]$"), m)
            .when(n_digits >= digit_run, _grouped_digits(m))
            .when(m.contains("-"), m)
            .otherwise(F.coalesce(number_words(m, years), m))
        )

    return rewrite(col, V.NUMBER_NOT_ORDINAL, body, gate="[0-9]")
