"""Queries over scripts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.catalog.base import long, pages, scripts, spread, table
from cuesheet.functions import fixed as V
from cuesheet.functions import numbers as N
from cuesheet.functions import text as X
from cuesheet.operators import chunking as C
from cuesheet.operators import normalize as NZ

QUERIES, ORACLE = {}, {}


def _digest(src, key, col, fn):
    def run(spark, sf):
        out = src(spark, sf).withColumn("t", fn(F.col(col)))
        return out.select(F.col(key), long(F.length("t")).alias("n_chars"), F.md5(F.col("t")).alias("digest"))

    return run


def _digest_sql(tab, key, expr, alias=None):
    return f"SELECT {key} AS {alias or key}, length(t) AS n_chars, md5(t) AS digest FROM (SELECT {key}, {expr} AS t FROM {tab})"


def _doc(name, fn, expr=None):
    QUERIES[name] = _digest(scripts, "script_id", "text", fn)
    if expr:
        ORACLE[name] = _digest_sql("documents", "doc_id", expr, "script_id")


def _page(name, fn, expr=None, col="html"):
    QUERIES[name] = _digest(pages, "page_id", col, fn)
    if expr:
        ORACLE[name] = _digest_sql("pages", "page_id", expr)


def _marked(text, pattern, body):
    """SQL: rewrite every match of a pattern with a list lambda."""
    return (
        f"array_to_string(list_transform(string_split(regexp_replace({text}, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)), "
        f"lambda p, i: CASE WHEN i % 2 = 0 THEN {body} ELSE p END), '')"
    )


TAGS = "regexp_replace(html, '<[^<>\\n]{1,200}>', ' ', 'g')"
_page("strip_tags", X.strip_tags, TAGS)
_page(
    "decode_entities",
    lambda c: X.decode_entities(X.strip_tags(c)),
    f"replace(replace(replace(replace({TAGS}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')",
)
_doc("strip_markdown", X.strip_markdown)
_STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
_LINES = f"""
  list_transform(string_split(text, chr(10)), lambda line, i:
    {{'s': {_STRIP.format("regexp_replace(regexp_replace(line, '" + V.BULLET + "', ''), '" + V.SPEAKER + "', '')")},
      'e': regexp_matches(line, '{V.BULLET}') OR regexp_matches(line, '^[ \\t]{{0,3}}#{{1,6}}[ \\t]*') OR regexp_matches(line, '{V.SPEAKER}')
           OR coalesce({_STRIP.format("string_split(text, chr(10))[i + 1]")} = '', FALSE)}})"""
_doc(
    "structural_stops",
    X.structural_stops,
    f"""array_to_string(list_transform({_LINES}, lambda v:
      CASE WHEN v.s <> '' AND v.e AND NOT regexp_matches(v.s, '[.!?]$') THEN regexp_replace(v.s, '[,;:]+$', '') || '.' ELSE v.s END), chr(10))""",
)
_doc("strip_brackets", X.strip_brackets, "regexp_replace(text, '\\[[^\\]\\n]{0,80}\\]', ' ', 'g')")
_doc(
    "speak_email",
    X.speak_email,
    _marked("text", "\\b[\\w.+-]{1,64}@[\\w-]+(\\.[\\w-]+)+\\b", "split_part(p, '@', 1) || ' at ' || replace(split_part(p, '@', 2), '.', ' dot ')"),
)
_page(
    "speak_url",
    X.speak_url,
    "replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '^https?://', '', 'i'), '^[^/?#]*'), '^www\\.', '', 'i'), '[.,;:]+$', ''), '.', ' dot ')",
    "url",
)
_doc("calm_punct", X.calm_punct, "regexp_replace(regexp_replace(text, '\\.{4,}', '...', 'g'), '([!?])[!?]+', '\\1', 'g')")
_doc("fold_chars", X.fold_chars, f"translate(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{V.FOLD_FROM.replace(chr(39), chr(39) * 2)}', '{V.FOLD_TO.replace(chr(39), chr(39) * 2)}')")
_PAUSES = "text"
for _p, _r in (
    ("\\s*…\\s*", ". "),
    ("\\s*[—–―⸺⸻]+\\s*", ", "),
    ("\\s*--+\\s*", ", "),
    ("(\\S) +- +(\\S)", "\\1, \\2"),
    ("(\\S) +- +(\\S)", "\\1, \\2"),
    ("([^0-9]|^):([^0-9]|$)", "\\1,\\2"),
    ("([^0-9]|^):([^0-9]|$)", "\\1,\\2"),
):
    _PAUSES = f"regexp_replace({_PAUSES}, '{_p}', '{_r}', 'g')"
_doc("pauses", X.pauses, f"translate({_PAUSES}, ';\"' || chr(10), ',  ')")
_JUNK = "[\\p{Cc}\\p{Cf}\\p{Co}\\p{So}\\p{Sk}]"
_doc("drop_junk", X.drop_junk, f"regexp_replace(replace(text, chr(9), ' '), '{_JUNK}', '', 'g')")
_doc("space_before_punct", X.space_before_punct, "regexp_replace(text, '([\\p{L}\\p{M}\\p{N}_])([,.])(\\s|$)', '\\1 \\2\\3', 'g')")
_COLLAPSE = "text"
for _p, _r in (
    ("[ \\t]+", " "),
    ("\\s+([,.!?])", "\\1"),
    (",\\s*,[\\s,]*", ", "),
    (",\\s*([.!?])", "\\1"),
    ("([.!?])\\s*,", "\\1 "),
    ("([,.!?])([^\\s,.!?''\")\\]])", "\\1 \\2"),
    ("[ \\t]+", " "),
):
    _COLLAPSE = f"regexp_replace({_COLLAPSE}, '{_p}', '{_r}', 'g')"
_doc("collapse", X.collapse, _STRIP.format(_COLLAPSE))
_doc("safe_export", lambda c: X.safe_export(c, 480), _STRIP.format("left(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), '[^ -~]', ' ', 'g'), 480)"))
_doc("word_prefix", lambda c: X.word_prefix(c, 60), "array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), 1, 60), ' ')")
_doc("speak_number", N.speak_number)
_doc("speak_percent", N.speak_percent)


def has_caps_run(spark, sf):
    return scripts(spark, sf).groupBy("language").agg(
        F.count_if(X.has_caps_run(F.col("text"))).alias("caps_scripts"), F.count(F.lit(1)).alias("scripts")
    )


QUERIES["has_caps_run"] = has_caps_run
ORACLE["has_caps_run"] = """
SELECT lang AS language, count(*) FILTER (WHERE regexp_matches(text,
  '(?:^|[^\\p{L}\\p{N}_])[A-Z]{2,}[ ,]+[A-Z]{2,}[ ,]+[A-Z]{2,}(?:$|[^\\p{L}\\p{N}_])')) AS caps_scripts, count(*) AS scripts
FROM documents GROUP BY lang"""


def junk_chars(spark, sf):
    n = F.size(X.junk_chars(F.col("text")))
    return scripts(spark, sf).select("script_id", long(n).alias("dropped")).filter("dropped > 0")


QUERIES["junk_chars"] = junk_chars
ORACLE["junk_chars"] = f"""
SELECT script_id, dropped FROM (SELECT doc_id AS script_id,
  len(list_distinct(regexp_extract_all(replace(text, chr(9), ' '), '{_JUNK}'))) AS dropped FROM documents) WHERE dropped > 0"""

_WORDS = "len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nl}]+(?:''[\\p{L}\\p{M}\\p{Nl}]+)?|\\p{Nd}+'))"


def word_count(spark, sf):
    return scripts(spark, sf).select("script_id", long(X.word_count(F.col("text"))).alias("words"))


QUERIES["word_count"] = word_count
ORACLE["word_count"] = f"SELECT doc_id AS script_id, {_WORDS} AS words FROM documents"


def gate_size(spark, sf):
    out = NZ.gate_size(scripts(spark, sf))
    return out.select("script_id", long("size_chars").alias("size_chars"), long("size_words").alias("size_words"), "size_reason")


QUERIES["gate_size"] = gate_size
ORACLE["gate_size"] = f"""
SELECT script_id, size_chars, size_words,
  CASE WHEN size_chars > 8000 THEN 'text is ' || size_chars || ' characters; the limit is 8000. ' || advice
       WHEN size_words > 1300 THEN 'text is ' || size_words || ' words; the limit is 1300. ' || advice END AS size_reason
FROM (SELECT doc_id AS script_id, length(text) AS size_chars, {_WORDS} AS size_words,
  'Send it to POST /api/tts/async instead, which queues the work and has a far higher limit.' AS advice FROM documents)"""


def vram_estimate(spark, sf):
    return NZ.with_vram_estimate(scripts(spark, sf)).select("script_id", F.round("vram_mb", 4).alias("vram_mb"))


QUERIES["vram_estimate"] = vram_estimate
ORACLE["vram_estimate"] = """
SELECT doc_id AS script_id, round(700 + len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 100.0 * 60.0, 4) AS vram_mb
FROM documents"""


def safe_names(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    raw = F.concat_ws("/", F.col("o_orderpriority"), F.lit(" Clip: "), F.col("o_orderstatus"))
    named = NZ.with_safe_name(o.withColumn("raw", F.when(F.col("o_orderkey") % 3 == 0, "!? ").otherwise(raw)), "raw")
    return named.groupBy("safe_name").agg(F.count(F.lit(1)).alias("jobs"))


QUERIES["safe_name"] = safe_names
ORACLE["safe_name"] = """
SELECT CASE WHEN s = '' THEN 'voiceover' ELSE replace(s, ' ', '_') END AS safe_name, count(*) AS jobs
FROM (SELECT trim(regexp_replace(trim(CASE WHEN o_orderkey % 3 = 0 THEN '!? ' ELSE o_orderpriority || '/ Clip: /' || o_orderstatus END),
  '[^\\w\\- ]+', '', 'g')) AS s FROM orders) GROUP BY 1"""


def export_changes(spark, sf):
    out = NZ.export_texts(scripts(spark, sf), "text")
    return out.groupBy("project").agg(F.count_if("changed").alias("changed"), F.count(F.lit(1)).alias("texts"))


QUERIES["export_changes"] = export_changes
ORACLE["export_changes"] = f"""
SELECT source AS project, count(*) FILTER (WHERE {_STRIP.format("left(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), '[^ -~]', ' ', 'g'), 480)")} <> text) AS changed,
  count(*) AS texts FROM documents GROUP BY source"""


def text_hash(spark, sf):
    return scripts(spark, sf).select("script_id", X.sha32(F.col("text")).alias("text_sha256"))


QUERIES["text_hash"] = text_hash
ORACLE["text_hash"] = "SELECT doc_id AS script_id, left(sha256(text), 32) AS text_sha256 FROM documents"


def resolve_lang(spark, sf):
    out = NZ.resolve_lang(scripts(spark, sf).withColumn("language", F.when(F.col("script_id") % 2 == 0, F.col("language"))))
    return out.groupBy("language", "lang_code").agg(F.count(F.lit(1)).alias("scripts"))


QUERIES["resolve_lang"] = resolve_lang
ORACLE["resolve_lang"] = """
SELECT language, CASE WHEN language IS NULL THEN CASE WHEN NOT non_latin THEN 'en' END ELSE language END AS lang_code, count(*) AS scripts
FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN lang END AS language,
  len(list_filter(regexp_extract_all(text, '\\p{L}'), lambda c: unicode(c) > 767)) > 0 AS non_latin FROM documents)
GROUP BY 1, 2"""

# Word tables for the number queries: a rule, not a list.
_H = "string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' ')"
_T = "string_split('twenty thirty forty fifty sixty seventy eighty ninety', ' ')"
SPELL_SQL = f"""
hundred AS (
  SELECT n, CASE WHEN n < 20 THEN {_H}[n + 1]
    ELSE {_T}[n // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || {_H}[n % 10 + 1] ELSE '' END END AS w FROM range(100) t(n)),
thousand AS (
  SELECT h.n * 100 + r.n AS n, CASE WHEN h.n > 0 THEN h.w || ' hundred' || CASE WHEN r.n > 0 THEN ' ' || r.w ELSE '' END ELSE r.w END AS w
  FROM (SELECT * FROM hundred WHERE n < 10) h, hundred r)"""


def number_words(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderdate")
    whole = F.floor("o_totalprice").cast("string")
    return o.select(
        "o_orderkey",
        N.number_words(whole, years=False).alias("cardinal"),
        N.ordinal(F.dayofmonth("o_orderdate").cast("string")).alias("day"),
        N.number_words(F.year("o_orderdate").cast("string")).alias("year_words"),
    )


QUERIES["number_words"] = number_words
ORACLE["number_words"] = f"""
WITH {SPELL_SQL},
o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p, day(o_orderdate) AS d, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey,
  CASE WHEN p < 1000 THEN lo.w
       ELSE hi.w || ' thousand' || CASE WHEN p % 1000 = 0 THEN '' WHEN p % 1000 < 100 THEN ' and ' || lo.w ELSE ', ' || lo.w END END AS cardinal,
  regexp_replace(dw.w, '[a-z]+$', '') || CASE regexp_extract(dw.w, '[a-z]+$')
    WHEN 'one' THEN 'first' WHEN 'two' THEN 'second' WHEN 'three' THEN 'third' WHEN 'five' THEN 'fifth' WHEN 'eight' THEN 'eighth'
    WHEN 'nine' THEN 'ninth' WHEN 'twelve' THEN 'twelfth'
    ELSE CASE WHEN dw.w LIKE '%y' THEN regexp_replace(regexp_extract(dw.w, '[a-z]+$'), 'y$', 'ieth') ELSE regexp_extract(dw.w, '[a-z]+$') || 'th' END END AS day,
  CASE WHEN y BETWEEN 2000 AND 2009 THEN 'two thousand' || CASE WHEN y > 2000 THEN ' and ' || yl.w ELSE '' END
       ELSE yh.w || ' ' || CASE WHEN y % 100 = 0 THEN 'hundred' WHEN y % 100 < 10 THEN 'oh-' || yl.w ELSE yl.w END END AS year_words
FROM o JOIN thousand lo ON lo.n = p % 1000 JOIN thousand hi ON hi.n = p // 1000
JOIN hundred dw ON dw.n = d JOIN hundred yh ON yh.n = y // 100 JOIN hundred yl ON yl.n = y % 100"""


def _order_lines(spark, sf):
    """Order facts written as sentences with money, shares, dates and times."""
    o = spread(table(spark, sf, "orders"))
    month = F.date_format("o_orderdate", "MMMM")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("script_id"),
        F.concat(
            F.lit("On "), month, F.lit(" "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" at "),
            (k % 12 + 1).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"),
            F.lit(" the "), (k % 30 + 1).cast("string"), F.lit("th order cost $"), F.floor("o_totalprice").cast("string"),
            F.lit(" plus "), (k % 100).cast("string"), F.lit("% tax, ref "), (k % 900 + 100).cast("string"), F.lit("."),
        ).alias("text"),
    )


def normalize_orders(spark, sf):
    return NZ.normalize_scripts(_order_lines(spark, sf)).select("script_id", "spoken")


QUERIES["normalize_orders"] = normalize_orders
_ORD = """regexp_replace({0}, '[a-z]+$', '') || CASE regexp_extract({0}, '[a-z]+$')
    WHEN 'one' THEN 'first' WHEN 'two' THEN 'second' WHEN 'three' THEN 'third' WHEN 'five' THEN 'fifth' WHEN 'eight' THEN 'eighth'
    WHEN 'nine' THEN 'ninth' WHEN 'twelve' THEN 'twelfth'
    ELSE CASE WHEN {0} LIKE '%y' THEN regexp_replace(regexp_extract({0}, '[a-z]+$'), 'y$', 'ieth') ELSE regexp_extract({0}, '[a-z]+$') || 'th' END END"""
ORACLE["normalize_orders"] = f"""
WITH {SPELL_SQL},
o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p, day(o_orderdate) AS d, monthname(o_orderdate) AS m FROM orders)
SELECT k AS script_id, 'On ' || m || ' ' || {_ORD.format("dw.w")} || ' at ' || hw.w ||
  CASE WHEN k % 60 = 0 THEN ' o''clock' WHEN k % 60 < 10 THEN ' oh ' || mw.w ELSE ' ' || mw.w END ||
  ' the ' || {_ORD.format("ow.w")} || ' order cost ' ||
  CASE WHEN p < 1000 THEN lo.w ELSE hi.w || ' thousand' || CASE WHEN p % 1000 = 0 THEN '' WHEN p % 1000 < 100 THEN ' and ' || lo.w ELSE ', ' || lo.w END END ||
  CASE WHEN p = 1 THEN ' dollar' ELSE ' dollars' END || ' plus ' || pw.w || ' percent tax, ref ' || rw.w || '.' AS spoken
FROM o JOIN thousand lo ON lo.n = p % 1000 JOIN thousand hi ON hi.n = p // 1000 JOIN hundred dw ON dw.n = d
JOIN hundred hw ON hw.n = k % 12 + 1 JOIN hundred mw ON mw.n = k % 60 JOIN hundred ow ON ow.n = k % 30 + 1
JOIN hundred pw ON pw.n = k % 100 JOIN thousand rw ON rw.n = k % 900 + 100"""


def normalize_full(spark, sf):
    out = NZ.normalize_scripts(scripts(spark, sf), language="language")
    return out.select("script_id", "lang_code", long(F.length("spoken")).alias("n_chars"), F.md5(F.col("spoken")).alias("digest"))


QUERIES["normalize_scripts"] = normalize_full


def normalize_basic(spark, sf):
    """Level basic over languages that only get the clean-up."""
    docs = scripts(spark, sf).filter(F.col("language") != "en")
    out = NZ.normalize_scripts(docs, level="basic", language="language")
    return out.select("script_id", "lang_code", F.md5(F.col("spoken")).alias("digest"))


QUERIES["normalize_basic"] = normalize_basic
_b = f"translate({_PAUSES.replace('(text,', '(folded,')}, ';\"' || chr(10), ',  ')"
ORACLE["normalize_basic"] = f"""
WITH a AS (SELECT doc_id AS script_id, lang AS lang_code,
  translate(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{V.FOLD_FROM}', '{V.FOLD_TO.replace(chr(39), chr(39) * 2)}') AS folded
  FROM documents WHERE lang <> 'en'),
b AS (SELECT *, regexp_replace(replace({_b}, chr(9), ' '), '{_JUNK}', '', 'g') AS text FROM a)
SELECT script_id, lang_code, md5({_STRIP.format(_COLLAPSE)}) AS digest FROM b"""


def cleaning_report(spark, sf):
    out = NZ.normalize_scripts(scripts(spark, sf), language="language")
    return NZ.cleaning_report(out, "language")


QUERIES["cleaning_report"] = cleaning_report


def pages_spoken(spark, sf):
    """Pasted HTML through the whole clean-up."""
    out = NZ.normalize_scripts(pages(spark, sf), text="html")
    return out.select("page_id", long(F.length("spoken")).alias("n_chars"), F.md5(F.col("spoken")).alias("digest"))


QUERIES["pages_spoken"] = pages_spoken


def apply_lexicon(spark, sf):
    lex = table(spark, sf, "nation").select(
        F.col("n_name").alias("key"), F.concat(F.lit("Nation "), F.col("n_nationkey")).alias("spoken")
    )
    texts = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    texts = texts.select(
        F.col("c_custkey").alias("script_id"), F.concat_ws(" ", F.lit("To"), "n_name", F.lit("and X"), "n_name", F.lit("now")).alias("text")
    )
    return NZ.normalize_scripts(texts, lexicon=lex, years=False).select("script_id", "spoken")


QUERIES["apply_lexicon"] = apply_lexicon
ORACLE["apply_lexicon"] = f"""
WITH {SPELL_SQL}
SELECT c_custkey AS script_id, 'To Nation ' || h.w || ' and X Nation ' || h.w || ' now' AS spoken
FROM customer JOIN hundred h ON h.n = c_nationkey"""

_SENT = """
frags AS (SELECT doc_id, string_split(regexp_replace({strip}, '([.!?。！？]+["'')\\]]*(?:\\s+|$))', '\\1' || chr(1), 'g'), chr(1)) AS f FROM documents),
flags AS (SELECT doc_id, i, f[i] AS frag, f[i + 1] AS nxt, regexp_extract(f[i], '([A-Za-z][A-Za-z.]*)\\.\\s*$', 1) AS tok
  FROM frags, range(1, len(f) + 1) r(i)),
ends AS (SELECT *, NOT (tok <> '' AND (contains(tok, '.') OR length(tok) = 1 OR lower(tok) IN ({always})
   OR (lower(tok) IN ({lower_only}) AND NOT regexp_matches(coalesce(nxt, ''), '^\\p{{Lu}}')))) AS real_end FROM flags),
grp AS (SELECT *, coalesce(sum(CASE WHEN real_end THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ends),
joined AS (SELECT doc_id, g, {strip2} AS sentence FROM (SELECT doc_id, g, string_agg(frag, '' ORDER BY i) AS s FROM grp GROUP BY doc_id, g)),
sentences AS (SELECT doc_id AS script_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS sentence_no, sentence FROM joined WHERE sentence <> '')
""".format(
    strip=_STRIP.format("text"),
    strip2=_STRIP.format("s"),
    always=", ".join(f"'{w}'" for w in V.ABBREV_ALWAYS),
    lower_only=", ".join(f"'{w}'" for w in V.ABBREV_BEFORE_LOWER),
)


def split_sentences(spark, sf):
    out = C.split_sentences(scripts(spark, sf))
    return out.select("script_id", long("sentence_no").alias("sentence_no"), "sentence")


QUERIES["split_sentences"] = split_sentences
ORACLE["split_sentences"] = f"WITH {_SENT} SELECT script_id, sentence_no, sentence FROM sentences"


def split_long(spark, sf):
    s = C.split_sentences(scripts(spark, sf))
    out = C.split_long(s, 100)
    return out.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("parts"), long(F.max(F.length("sentence"))).alias("longest"), long(F.sum(F.length("sentence"))).alias("n_chars")
    )


QUERIES["split_long"] = split_long


def chunk_scripts(spark, sf):
    out = C.chunk_scripts(scripts(spark, sf))
    return out.select("script_id", long("chunk_no").alias("chunk_no"), long("n_chars").alias("n_chars"), F.md5(F.col("text")).alias("digest"))


QUERIES["chunk_scripts"] = chunk_scripts


def chunk_sentences(spark, sf):
    """Greedy packing of whole sentences, before short chunks are merged."""
    out = C.chunk_sentences(C.with_sentences(scripts(spark, sf)), max_chars=400)
    rows = out.select("script_id", F.posexplode(F.array_compact("chunks")).alias("chunk_no", "chunk"))
    return rows.select("script_id", long("chunk_no").alias("chunk_no"), F.md5(F.col("chunk")).alias("digest"))


QUERIES["chunk_sentences"] = chunk_sentences
ORACLE["chunk_sentences"] = f"""
WITH RECURSIVE {_SENT},
tot AS (SELECT script_id, greatest(ceil(t / ceil(t / 400.0)), 1) AS target, n FROM (
  SELECT script_id, sum(length(sentence)) + count(*) - 1 AS t, count(*) AS n FROM sentences GROUP BY script_id)),
pack AS (
  SELECT s.script_id, s.sentence_no, 0 AS chunk_no, length(s.sentence) AS cur FROM sentences s WHERE s.sentence_no = 0
  UNION ALL
  SELECT s.script_id, s.sentence_no,
    CASE WHEN p.cur + 1 + length(s.sentence) <= t.target THEN p.chunk_no ELSE p.chunk_no + 1 END,
    CASE WHEN p.cur + 1 + length(s.sentence) <= t.target THEN p.cur + 1 + length(s.sentence) ELSE length(s.sentence) END
  FROM pack p JOIN sentences s ON s.script_id = p.script_id AND s.sentence_no = p.sentence_no + 1 JOIN tot t ON t.script_id = s.script_id)
SELECT p.script_id, CAST(p.chunk_no AS BIGINT) AS chunk_no, md5(string_agg(s.sentence, ' ' ORDER BY s.sentence_no)) AS digest
FROM pack p JOIN sentences s ON s.script_id = p.script_id AND s.sentence_no = p.sentence_no GROUP BY p.script_id, p.chunk_no"""


def merge_short(spark, sf):
    out = C.merge_short(C.chunk_sentences(C.with_sentences(scripts(spark, sf)), max_chars=200), 66, 320)
    return out.select("script_id", long(F.size("chunks")).alias("chunks"), F.md5(F.array_join("chunks", "|")).alias("digest"))


QUERIES["merge_short"] = merge_short


def padding_overhead(spark, sf):
    """Sentences as the unit of a batch."""
    s = C.split_sentences(scripts(spark, sf)).select("script_id", F.col("sentence_no").alias("chunk_no"), F.length("sentence").alias("n_chars"))
    out = C.padding_overhead(s, [2, 4, 8])
    return out.select("script_id", long("batch").alias("batch"), long("padding").alias("padding"), long("used").alias("used"), F.round("overhead", 6).alias("overhead"))


QUERIES["padding_overhead"] = padding_overhead
ORACLE["padding_overhead"] = f"""
WITH {_SENT},
g AS (SELECT script_id, b AS batch, sentence_no // b AS g, max(length(sentence)) AS longest, count(*) AS n, sum(length(sentence)) AS used
  FROM sentences, (VALUES (2), (4), (8)) v(b) GROUP BY ALL)
SELECT script_id, CAST(batch AS BIGINT) AS batch, CAST(sum(longest * n - used) AS BIGINT) AS padding, CAST(sum(used) AS BIGINT) AS used,
  round(sum(longest * n - used) / sum(used), 6) AS overhead FROM g GROUP BY script_id, batch"""
