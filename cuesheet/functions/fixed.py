"""Word lists, patterns and limits that define the results.

Everything in this file is data.  The patterns are written for Java regular
expressions.
"""

# Script clean-up patterns.
HTML_TAG = r"<[^<>\n]{1,200}>"
MD_IMAGE = r"!\[([^\]\n]{0,200})\]\([^)\n]{1,500}\)"
MD_LINK = r"\[([^\]\n]{1,200})\]\([^)\n]{1,500}\)"
MD_RULE = r"(?md)^[ \t]{0,3}(?:[-*_][ \t]*){3,}$"
MD_HEAD = r"(?md)^[ \t]{0,3}#{1,6}[ \t]*"
MD_QUOTE = r"(?md)^[ \t]{0,3}>[ \t]?"
MD_CODE = r"`{1,3}([^`\n]{1,500})`{1,3}"
MD_EMPHASIS = r"(?sU)(\*\*\*|\*\*|\*|___|__)(?=\S)(.+?)(?<=\S)\1"
BULLET = r"^[ \t]{0,8}(?:[-*•‣▪·]|[0-9]{1,3}[.)]|[a-zA-Z][.)])[ \t]+"
SPEAKER = r"^[ \t]{0,6}[A-Z][A-Z0-9 _-]{1,23}:[ \t]+"
BRACKETED = r"\[[^\]\n]{0,80}\]"
URL = r"(?iU)\b(?:https?://|www\.)[^\s<>\"']{2,}"
EMAIL = r"(?U)\b[\w.+-]{1,64}@([\w-]+(?:\.[\w-]+)+)\b"
REPEAT_PUNCT = r"([!?])[!?]+"
DOT_RUN = r"\.{4,}"
CAPS_RUN = r"\b[A-Z]{2,}\b[ ,]+[A-Z]{2,}\b[ ,]+[A-Z]{2,}\b"

# Character folding.
FOLD_FROM = (
    "\u2018\u2019\u201a\u201b\u2032"
    "\u201c\u201d\u201e\u201f\u2033\u00ab\u00bb"
    "\u00a0\u202f\u2009\u200a\u2007\u3000"
    "\u2212\u2010\u2011"
    "\u200b\u200c\u200d\ufeff\u00ad"
)
FOLD_TO = "'" * 5 + '"' * 7 + " " * 6 + "-" * 3
ELLIPSIS = r"(?U)\s*…\s*"
DASH = r"(?U)\s*[—–―⸺⸻]+\s*"
ASCII_DASH = r"(?U)\s*--+\s*"
SPACED_HYPHEN = r"(?U)(?<=\S) +- +(?=\S)"
LONE_COLON = r"(?<![0-9]):(?![0-9])"
# The first class only passes over common characters that are in none of the others.
JUNK = r"[[^ -\]_a-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]&&[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}\p{So}\p{Sk}]]"

# Numbers in text.
CURRENCY_NAMES = {
    "$": ("dollar", "dollars"),
    "£": ("pound", "pounds"),
    "€": ("euro", "euros"),
    "¥": ("yen", "yen"),
    "₹": ("rupee", "rupees"),
    "₩": ("won", "won"),
}
SCALE_WORDS = "hundred|thousand|million|billion|trillion"
CURRENCY = r"(?iU)([$£€¥₹₩])\s?([0-9][0-9,]*(?:\.[0-9]+)?)(?:\s*(" + SCALE_WORDS + r")\b)?"
PERCENT = r"(?U)([0-9][0-9,]*(?:\.[0-9]+)?)\s*%"
CLOCK = r"(?U)\b([01]?[0-9]|2[0-3]):([0-5][0-9])\b"
ORDINAL = r"(?iU)\b([0-9]+)(st|nd|rd|th)\b"
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
MONTH_DAY = r"(?iU)\b(" + MONTHS + r")\.?\s+([0-9]{1,2})\b(?!\s*(?:st|nd|rd|th)\b)(?!\s*,?\s*[0-9]{3})"
NUMBER = r"[0-9][0-9.,\-]*[0-9]|[0-9]"
NUMBER_NOT_ORDINAL = r"(?:[0-9][0-9.,\-]*[0-9]|[0-9])(?:(?iU:st|nd|rd|th)\b)?"
# One pass reads money, percentages, clock times, dates and ordinals.  The rules
# once ran one after the other in that order, so a clock time or a date gives
# way where a later sign belongs to an earlier rule.
SPOKEN_FORMS = (
    r"(?iU)(?<money>[$£€¥₹₩]\s?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s*(?:" + SCALE_WORDS + r")\b)?)"
    r"|(?<percent>[0-9][0-9,]*(?:\.[0-9]+)?\s*%)"
    r"|(?<clock>\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\b(?![0-9,.]*\s*%))"
    r"|(?<day>\b(?:" + MONTHS + r")\.?\s+[0-9]{1,2}\b(?!\s*(?:st|nd|rd|th)\b)(?!\s*,?\s*[0-9]{3})"
    r"(?![0-9,.]*\s*%)(?!:[0-5][0-9]\b))"
    r"|(?<ordinal>\b[0-9]+(?:st|nd|rd|th)\b)"
)
DIGIT_RUN = 7
CLOCK_DOT = r"(?U)\b([01]?[0-9]|2[0-3])\.([0-5][0-9])\b"
CURRENCY_MARK = r"[$£€¥]"
#: What those marks are read as.
UNIT_WORDS = sorted({w for sign, names in CURRENCY_NAMES.items() if sign in CURRENCY_MARK for w in names})
MONEY_SIGN = r"^[$£€¥₹₩]"

# Acronyms read as a word.
DEFAULT_LEXICON = {
    "MAGA": "Maga",
    "NASA": "Nasa",
    "NATO": "Nato",
    "OPEC": "Opec",
    "NAFTA": "Nafta",
    "FEMA": "Fema",
    "UNESCO": "Unesco",
    "UNICEF": "Unicef",
    "SCOTUS": "Scotus",
    "POTUS": "Potus",
    "FIFA": "Fifa",
}

# Sentence ends.
SENTENCE_END = r"(?U)([.!?。！？]+[\"')\]]*(?:\s+|$))"
TAIL_TOKEN = r"(?U)([A-Za-z][A-Za-z.]*)\.\s*$"
ABBREV_ALWAYS = (
    "mr mrs ms dr prof st mt vs approx cf eg ie fig gen gov hon lt maj rep sen sgt col "
    "capt cmdr adm no vol"
).split()
ABBREV_BEFORE_LOWER = "jr sr inc ltd co corp dept est etc al min max sec hr hrs ft".split()
SOFT_BREAK = r"(?U)(?<=[,;:])\s+"

# Word comparison.
SOFT_TOKENS = ["and", "a", "ah", "uh", "um"]
CRITICAL_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty "
    "ninety hundred thousand million billion trillion point percent dollar dollars pound pounds "
    "euro euros first second third fourth fifth sixth seventh eighth ninth tenth not no never "
    "none nothing cannot without nor"
).split()
INFLECTIONS = ["'s", "ies", "es", "s", "ed", "ing"]
SOUND_FROM, SOUND_TO = "kqzjywv", "ccsgiuf"
SIMILARITY = 0.70

# Language labels and codes.
LANGUAGE_CODES = {
    "english": "en", "spanish": "es", "french": "fr", "german": "de",
    "italian": "it", "portuguese": "pt", "russian": "ru", "japanese": "ja",
    "korean": "ko", "chinese": "zh", "mandarin": "zh", "arabic": "ar",
    "hindi": "hi", "urdu": "ur", "dutch": "nl", "polish": "pl",
    "turkish": "tr", "indonesian": "id", "vietnamese": "vi", "thai": "th",
    "ukrainian": "uk", "czech": "cs", "danish": "dk", "finnish": "fi",
    "hebrew": "he", "hungarian": "hu", "norwegian": "no", "romanian": "ro",
    "serbian": "sr", "slovene": "sl", "slovenian": "sl", "swedish": "sv",
    "lithuanian": "lt", "latvian": "lv", "kazakh": "kz", "persian": "fa",
    "farsi": "fa", "catalan": "ca", "croatian": "hr", "bulgarian": "bg",
    "greek": "el", "estonian": "et", "icelandic": "is", "tamil": "ta",
    "telugu": "te", "kannada": "kn", "malay": "ms",
}

# Limits.
SYNC_CHARS, SYNC_WORDS = 8000, 1300
QUEUED_CHARS, QUEUED_WORDS = 100000, 18000
MIN_FREE_MB, MB_PER_100_WORDS = 700.0, 60.0
RTF_NORMAL_MAX = 0.26
RATE_LOW, RATE_HIGH = 0.75, 1.40
WPM_FLOOR, WPM_CEILING = 50.0, 280.0
MIN_ACCURACY, REFERENCE_ACCURACY = 0.995, 0.90
