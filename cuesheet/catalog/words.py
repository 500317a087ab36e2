"""Queries over sent and heard texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.catalog.base import PAIRS_SQL, long, spread, table, turn_pairs
from cuesheet.functions import fixed as V
from cuesheet.functions import words as W
from cuesheet.operators import audit as A
from cuesheet.operators import diff as D

QUERIES, ORACLE = {}, {}

# The tests tables hold unrelated turns, so the plain form of the words is
# compared; spelled numbers are covered by the text queries.
_TOK = "list_filter(list_transform(string_split_regex(regexp_replace(translate(lower({0}), '’-', ''' '), '[^a-z0-9'' ]', ' ', 'g'), ' +'), lambda w: regexp_replace(w, '^''+|''+$', '', 'g')), lambda w: w <> '')"
_SOFT = ", ".join(f"'{w}'" for w in V.SOFT_TOKENS)
_CRIT = ", ".join(f"'{w}'" for w in V.CRITICAL_WORDS)
def _stem_sql(x):
    out = "CASE"
    for s in V.INFLECTIONS:
        q = s.replace("'", "''")
        out += f" WHEN suffix({x}, '{q}') AND length({x}) - {len(s)} >= 3 THEN left({x}, length({x}) - {len(s)})" + (" || 'y'" if s == "ies" else "")
    return out + f" ELSE {x} END"


def _sound_sql(x):
    """Doubles are collapsed letter by letter: RE2 has no back-reference."""
    key = f"(left(regexp_replace({x}, '[^a-z]', '', 'g'), 1) || translate(translate(substr(regexp_replace({x}, '[^a-z]', '', 'g'), 2), '{V.SOUND_FROM}', '{V.SOUND_TO}'), 'aeiouh', ''))"
    for c in "abcdefghijklmnopqrstuvwxyz":
        key = f"regexp_replace({key}, '{c}+', '{c}', 'g')"
    return key


_ALIKE = f"""CASE WHEN p.s = p.h THEN TRUE WHEN p.s IN ({_CRIT}) OR p.h IN ({_CRIT}) THEN FALSE
  WHEN ps = hs THEN TRUE WHEN 1 - levenshtein(p.s, p.h) / CAST(greatest(length(p.s), length(p.h)) AS DOUBLE) >= {V.SIMILARITY} THEN TRUE
  ELSE pk <> '' AND pk = hk END"""


def _chain(pairs_sql):
    """The SQL of the diff over any ``pairs`` table, cut at its four stages."""
    tok = f"""{pairs_sql},
lists AS (SELECT clip_id, voice_id, 0 AS side, {_TOK.format("sent")} AS t FROM pairs
  UNION ALL SELECT clip_id, voice_id, 1, {_TOK.format("spoken")} FROM pairs),
tok AS MATERIALIZED (SELECT clip_id, voice_id, side, i - 1 AS pos, t[i] AS w FROM lists, range(1, len(t) + 1) r(i)),
num AS (SELECT *, row_number() OVER (PARTITION BY clip_id, side, w ORDER BY pos) AS k FROM tok),
m AS (SELECT coalesce(a.clip_id, b.clip_id) AS clip_id, coalesce(a.w, b.w) AS w, coalesce(a.k, b.k) AS k, a.pos AS sp, b.pos AS hp
  FROM (SELECT * FROM num WHERE side = 0) a FULL JOIN (SELECT * FROM num WHERE side = 1) b
  ON a.clip_id = b.clip_id AND a.w = b.w AND a.k = b.k)"""
    # the longest common subsequence by thresholds: for the sent words from i on, t[l] is the least number of last
    # heard words that has l in common with them; then the way from the start
    gap = f"""RECURSIVE {tok},
w AS MATERIALIZED (SELECT clip_id, voice_id, {_TOK.format("sent")} AS a, {_TOK.format("spoken")} AS b, list_reverse({_TOK.format("spoken")}) AS rb FROM pairs),
lengths AS MATERIALIZED (SELECT clip_id, CAST(len(a) + 1 AS BIGINT) AS i, []::BIGINT[] AS t FROM w
  UNION ALL
  SELECT clip_id, i, list_filter(list_transform(range(1, len(t) + 2), lambda n: least(coalesce(t[n], 1000000000),
      coalesce(list_min(list_filter(p, lambda k: k > coalesce(t[n - 1], 0))), 1000000000))), lambda x: x < 1000000000)
  FROM (SELECT l.clip_id, l.i - 1 AS i, t, list_filter(range(1, len(rb) + 1), lambda k: rb[k] = a[l.i - 1]) AS p
    FROM lengths l JOIN w ON w.clip_id = l.clip_id WHERE l.i > 1)),
walk AS (SELECT clip_id, 1::BIGINT AS i, 1::BIGINT AS j, NULL::BIGINT AS sp, NULL::BIGINT AS hp FROM w
  UNION ALL
  SELECT clip_id, CASE WHEN same OR NOT skip THEN i + 1 ELSE i END, CASE WHEN same OR skip THEN j + 1 ELSE j END,
    CASE WHEN same THEN i - 1 END, CASE WHEN same THEN j - 1 END
  FROM (SELECT k.clip_id, k.i, k.j, a[k.i] = b[k.j] AS same, NOT list_contains(l.t, len(b) - k.j + 1) AS skip
    FROM walk k JOIN w ON w.clip_id = k.clip_id JOIN lengths l ON l.clip_id = k.clip_id AND l.i = k.i WHERE k.i <= len(a) AND k.j <= len(b))),
hits AS MATERIALIZED (SELECT clip_id, sp, hp FROM walk WHERE sp IS NOT NULL),
marked AS (SELECT t.*, y.sp IS NOT NULL AS hit, count(y.sp) OVER (PARTITION BY t.clip_id, side ORDER BY pos) AS gap
  FROM tok t LEFT JOIN hits y ON y.clip_id = t.clip_id AND t.pos = CASE side WHEN 0 THEN y.sp ELSE y.hp END),
gaps AS (SELECT clip_id, CAST(gap AS BIGINT) AS gap,
    coalesce(list(w ORDER BY pos) FILTER (WHERE NOT hit AND side = 0), []) AS a, coalesce(list(w ORDER BY pos) FILTER (WHERE NOT hit AND side = 1), []) AS b
  FROM marked GROUP BY clip_id, gap HAVING count(*) FILTER (WHERE NOT hit) > 0),
bags AS (SELECT clip_id, sum(least(s, h)) AS common FROM (SELECT clip_id, w, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS h FROM tok GROUP BY clip_id, w) GROUP BY clip_id),
told AS (SELECT w.clip_id, len(w.a) AS sent_words, len(w.b) AS spoken_words, coalesce(n, 0) AS matched, coalesce(common, 0) - coalesce(n, 0) AS reordered
  FROM w LEFT JOIN (SELECT clip_id, count(*) AS n FROM hits GROUP BY clip_id) h ON h.clip_id = w.clip_id LEFT JOIN bags ON bags.clip_id = w.clip_id)"""

    whole = f"""{gap},
zipped AS (SELECT clip_id, gap, i, {{'s': a[i], 'h': b[i]}} AS p FROM gaps, range(1, len(a) + 1) r(i) WHERE len(a) = len(b) AND len(a) > 0),
keyed AS (SELECT *, {_stem_sql("p.s")} AS ps, {_stem_sql("p.h")} AS hs, {_sound_sql("p.s")} AS pk, {_sound_sql("p.h")} AS hk FROM zipped),
alike AS (SELECT clip_id, gap, bool_and({_ALIKE}) AS ok FROM keyed GROUP BY clip_id, gap),
kinds AS (SELECT g.*, CASE
    WHEN len(a) > 0 AND len(b) > 0 AND array_to_string(a, '') = array_to_string(b, '') THEN 'respaced'
    WHEN len(a) > 0 AND len(b) > 0 AND coalesce(alike.ok, FALSE) THEN 'misheard' ELSE 'defect' END AS kind
  FROM gaps g LEFT JOIN alike ON alike.clip_id = g.clip_id AND alike.gap = g.gap),
diff0 AS (SELECT clip_id,
    flatten(list(a ORDER BY gap)) AS dropped, flatten(list(b ORDER BY gap)) AS inserted,
    flatten(list(CASE WHEN kind = 'defect' THEN a ELSE [] END ORDER BY gap)) AS missing0,
    flatten(list(CASE WHEN kind = 'defect' THEN b ELSE [] END ORDER BY gap)) AS extra0,
    flatten(list(CASE WHEN kind = 'respaced' THEN [{{'s': array_to_string(a, ' '), 'h': array_to_string(b, ' ')}}]
      WHEN kind = 'misheard' THEN list_transform(a, lambda x, i: {{'s': x, 'h': b[i]}}) ELSE [] END ORDER BY gap)) AS misheard,
    arg_max({{'gap': gap, 'a': a, 'b': b}}, gap) AS last
  FROM kinds GROUP BY clip_id),
diff AS (SELECT p.clip_id, p.voice_id, sent_words, spoken_words, CAST(reordered AS BIGINT) AS reordered, coalesce(dropped, []) AS dropped, coalesce(inserted, []) AS inserted,
    CASE WHEN last.gap = matched AND len(last.a) = 0 THEN last.b ELSE [] END AS tail_inserted,
    list_filter(coalesce(dropped, []), lambda w: w NOT IN ({_SOFT})) AS hard_dropped,
    list_filter(coalesce(inserted, []), lambda w: w NOT IN ({_SOFT})) AS hard_inserted,
    list_filter(coalesce(missing0, []), lambda w: w NOT IN ({_SOFT})) AS missing,
    list_filter(coalesce(extra0, []), lambda w: w NOT IN ({_SOFT})) AS extra,
    coalesce(misheard, []) AS misheard,
    coalesce(round_even(matched / CAST(greatest(sent_words, 1) AS DOUBLE), 4), 0) AS word_accuracy
  FROM pairs p JOIN told USING (clip_id) LEFT JOIN diff0 USING (clip_id))"""
    return tok, gap, whole


TOK_SQL, GAP_SQL, CLASS_SQL = _chain(PAIRS_SQL)


def _tok(spark, sf):
    return D.tokens(turn_pairs(spark, sf), spoken_form=False)


def _diffs(spark, sf, spoken_form=False):
    return D.word_diff(turn_pairs(spark, sf), spoken_form)


def diff_tokens(spark, sf):
    return _tok(spark, sf).groupBy("clip_id", "side").agg(
        F.count(F.lit(1)).alias("words"), F.sum(F.length("w") * (F.col("pos") + 1)).cast("long").alias("weight")
    ).select("clip_id", long("side").alias("side"), "words", "weight")


QUERIES["diff_tokens"] = diff_tokens
ORACLE["diff_tokens"] = f"""
WITH {TOK_SQL} SELECT clip_id, CAST(side AS BIGINT) AS side, count(*) AS words, CAST(sum(length(w) * (pos + 1)) AS BIGINT) AS weight FROM tok GROUP BY clip_id, side"""


def number_occurrences(spark, sf):
    num = D.number_occurrences(_tok(spark, sf))
    return num.select("clip_id", long("side").alias("side"), long("pos").alias("pos"), "w", long("k").alias("k"))


QUERIES["number_occurrences"] = number_occurrences
ORACLE["number_occurrences"] = f"WITH {TOK_SQL} SELECT clip_id, CAST(side AS BIGINT) AS side, pos, w, k FROM num"


def word_diff(spark, sf):
    d = _diffs(spark, sf)
    lists = [F.array_join(c, " ").alias(c) for c in D.LISTS]
    heard = F.array_join(F.transform("misheard", lambda p: F.concat_ws(">", p["sent"], p["heard"])), " ").alias("misheard")
    return d.select("clip_id", long("sent_words").alias("sent_words"), long("spoken_words").alias("spoken_words"), *lists, heard, "word_accuracy", "ok", long("reordered").alias("reordered"))


QUERIES["word_diff"] = word_diff
ORACLE["word_diff"] = f"""
WITH {CLASS_SQL}
SELECT clip_id, CAST(sent_words AS BIGINT) AS sent_words, CAST(spoken_words AS BIGINT) AS spoken_words,
  {", ".join(f"array_to_string({c}, ' ') AS {c}" for c in D.LISTS)},
  array_to_string(list_transform(misheard, lambda p: p.s || '>' || p.h), ' ') AS misheard, word_accuracy,
  len(hard_dropped) = 0 AND len(hard_inserted) = 0 AS ok, CAST(reordered AS BIGINT) AS reordered FROM diff"""


def word_counts(spark, sf):
    c = D.word_counts(turn_pairs(spark, sf), spoken_form=False)
    return c.select("clip_id", *[long(x).alias(x) for x in ("sent_words", "spoken_words", "matched", "dropped", "inserted")])


QUERIES["word_counts"] = word_counts
ORACLE["word_counts"] = f"""
WITH {TOK_SQL}, c AS (SELECT clip_id, w, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS h FROM tok GROUP BY clip_id, w)
SELECT clip_id, CAST(sum(s) AS BIGINT) AS sent_words, CAST(sum(h) AS BIGINT) AS spoken_words, CAST(sum(least(s, h)) AS BIGINT) AS matched,
  CAST(sum(s - least(s, h)) AS BIGINT) AS dropped, CAST(sum(h - least(s, h)) AS BIGINT) AS inserted FROM c GROUP BY clip_id"""


def pair_substitutions(spark, sf):
    rows = D.pair_substitutions(D.gaps(D.align(D.token_lists(turn_pairs(spark, sf), False))))
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("gaps"), F.sum(F.size("a")).alias("sent"), F.sum(F.size("b")).alias("heard")
    )


QUERIES["pair_substitutions"] = pair_substitutions
ORACLE["pair_substitutions"] = f"""
WITH {CLASS_SQL} SELECT kind, count(*) AS gaps, CAST(sum(len(a)) AS BIGINT) AS sent, CAST(sum(len(b)) AS BIGINT) AS heard FROM kinds GROUP BY kind"""


def word_sets(spark, sf):
    t = _tok(spark, sf)
    return t.groupBy("clip_id").agg(
        F.count_if(F.col("w").isin(V.SOFT_TOKENS)).alias("soft"), F.count_if(W.is_critical(F.col("w"))).alias("critical")
    )


QUERIES["word_sets"] = word_sets
ORACLE["word_sets"] = f"""
WITH {TOK_SQL} SELECT clip_id, count(*) FILTER (WHERE w IN ({_SOFT})) AS soft, count(*) FILTER (WHERE w IN ({_CRIT})) AS critical FROM tok GROUP BY clip_id"""


def word_forms(spark, sf):
    """Stem and sound key of every distinct word."""
    words = _tok(spark, sf).select("w").distinct()
    return words.select("w", W.stem(F.col("w")).alias("stem"), W.sound_key(F.col("w")).alias("sound"))


QUERIES["word_forms"] = word_forms
ORACLE["word_forms"] = f"WITH {TOK_SQL} SELECT w, {_stem_sql('w')} AS stem, {_sound_sql('w')} AS sound FROM (SELECT DISTINCT w FROM tok)"


def similar_words(spark, sf):
    """Words against the next word of the same text."""
    t = _tok(spark, sf)
    nxt = t.select("clip_id", "side", (F.col("pos") - 1).alias("pos"), F.col("w").alias("w2"))
    both = t.join(nxt, ["clip_id", "side", "pos"])
    return both.groupBy("clip_id").agg(
        F.count_if(W.similar(F.col("w"), F.col("w2"))).alias("similar"),
        F.count_if(W.likely_misheard(F.col("w"), F.col("w2"))).alias("alike"),
    )


QUERIES["similar_words"] = similar_words
ORACLE["similar_words"] = f"""
WITH {TOK_SQL}, nx AS (SELECT a.clip_id, {{'s': a.w, 'h': b.w}} AS p FROM tok a JOIN tok b ON a.clip_id = b.clip_id AND a.side = b.side AND b.pos = a.pos + 1),
keyed AS (SELECT *, {_stem_sql("p.s")} AS ps, {_stem_sql("p.h")} AS hs, {_sound_sql("p.s")} AS pk, {_sound_sql("p.h")} AS hk FROM nx)
SELECT clip_id, count(*) FILTER (WHERE 1 - levenshtein(p.s, p.h) / CAST(greatest(length(p.s), length(p.h)) AS DOUBLE) >= {V.SIMILARITY}) AS similar,
  count(*) FILTER (WHERE {_ALIKE}) AS alike FROM keyed GROUP BY clip_id"""


def reordered(spark, sf):
    return D.reordered(D.match_occurrences(_tok(spark, sf)))


QUERIES["reordered"] = reordered
ORACLE["reordered"] = f"""
WITH {TOK_SQL} SELECT clip_id, count(*) FILTER (WHERE b) AS reordered FROM (
  SELECT clip_id, hp < max(hp) OVER (PARTITION BY clip_id ORDER BY sp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM m WHERE sp IS NOT NULL AND hp IS NOT NULL) GROUP BY clip_id"""


def membership_diff(spark, sf):
    return D.membership_diff(_tok(spark, sf))


QUERIES["membership_diff"] = membership_diff
ORACLE["membership_diff"] = f"""
WITH {TOK_SQL} SELECT clip_id, count(*) AS absent FROM tok a WHERE side = 0
  AND NOT EXISTS (SELECT 1 FROM tok b WHERE b.side = 1 AND b.clip_id = a.clip_id AND b.w = a.w) GROUP BY clip_id"""


def bigram_accuracy(spark, sf):
    return D.bigram_accuracy(_tok(spark, sf))


QUERIES["bigram_accuracy"] = bigram_accuracy
ORACLE["bigram_accuracy"] = f"""
WITH {TOK_SQL}, b AS (SELECT clip_id, side, w || ' ' || lead(w) OVER (PARTITION BY clip_id, side ORDER BY pos) AS w FROM tok),
c AS (SELECT clip_id, w, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS h FROM b WHERE w IS NOT NULL GROUP BY clip_id, w)
SELECT clip_id, round_even(sum(least(s, h)) / CAST(greatest(sum(s), 1) AS DOUBLE), 4) AS bigram_accuracy FROM c GROUP BY clip_id"""


def verdicts(spark, sf):
    v = D.with_verdicts(_diffs(spark, sf))
    return v.select("clip_id", "passed", "clean", "worth_regenerating", "only_tail_is_wrong", long(W.diff_errors(F.col("hard_dropped"), F.col("hard_inserted"))).alias("errors"))


QUERIES["diff_verdicts"] = verdicts
_VERDICTS = """len(hard_dropped) = 0 AND len(hard_inserted) = 0 AND word_accuracy >= 0.995 AS passed,
  len(missing) = 0 AND len(extra) = 0 AS clean,
  NOT (len(missing) = 0 AND len(extra) = 0) OR (len(misheard) >= 3 AND len(misheard) / greatest(sent_words, 1) > 0.5) AS worth_regenerating,
  len(missing) = 0 AND len(tail_inserted) > 0 AND len(list_filter(extra, lambda w: NOT list_contains(tail_inserted, w))) = 0 AS only_tail_is_wrong"""
ORACLE["diff_verdicts"] = f"WITH {CLASS_SQL} SELECT clip_id, {_VERDICTS}, len(hard_dropped) + len(hard_inserted) AS errors FROM diff"


def describe(spark, sf):
    return D.describe(_diffs(spark, sf)).select("clip_id", "summary")


QUERIES["describe_diff"] = describe
_SHOW = "CASE WHEN len({0}) > 0 THEN '{1}' || array_to_string({0}[1:6], ' ') || CASE WHEN len({0}) > 6 THEN '…' ELSE '' END END"
ORACLE["describe_diff"] = f"""
WITH {CLASS_SQL}, x AS (SELECT *, list_filter(extra, lambda w: NOT list_contains(tail_inserted, w)) AS other FROM diff),
y AS (SELECT *, concat_ws('; ', {_SHOW.format("missing", "not spoken: ")}, {_SHOW.format("tail_inserted", "extra at end: ")}, {_SHOW.format("other", "extra: ")}) AS bits FROM x)
SELECT clip_id, CASE WHEN bits <> '' THEN bits
  WHEN len(misheard) > 0 THEN 'check pronunciation: ' || array_to_string(list_transform(misheard[1:6], lambda p: p.s || ' heard as ' || p.h), '; ')
    || CASE WHEN len(misheard) > 6 THEN ' (+' || (len(misheard) - 6) || ' more)' ELSE '' END || ' — add it to the lexicon if it is really being said wrong'
  ELSE 'verified ' || printf('%.1f', word_accuracy * 100) || '%' END AS summary FROM y"""

_TOTALS = """count(*) AS clips, CAST(sum(sent_words) AS BIGINT) AS sent_words, CAST(sum(spoken_words) AS BIGINT) AS spoken_words,
  CAST(sum(len(ra)) AS BIGINT) AS added, CAST(sum(len(rd)) AS BIGINT) AS dropped, count(*) FILTER (WHERE len(tail_inserted) > 0) AS clips_with_tail,
  count(*) FILTER (WHERE len(ra) = 0 AND len(rd) = 0) AS clean_clips,
  round(count(*) FILTER (WHERE len(tail_inserted) > 0) / CAST(count(*) AS DOUBLE), 4) AS tail_share,
  CASE WHEN sum(len(ra)) = 0 AND sum(len(rd)) = 0 THEN 0 ELSE 1 END AS exit_code"""
REAL_SQL = f"""{CLASS_SQL}, owned AS (SELECT *, flatten(list_transform(misheard, lambda p: [p.s, p.h])) AS own FROM diff),
reals AS (SELECT *, list_filter(hard_dropped, lambda w: NOT list_contains(own, w)) AS rd, list_filter(hard_inserted, lambda w: NOT list_contains(own, w)) AS ra FROM owned)"""


def audit_totals(spark, sf):
    return A.audit_totals(D.word_diff(turn_pairs(spark, sf), spoken_form=False, carry=("voice_id",)), "voice_id")


QUERIES["audit_totals"] = audit_totals
ORACLE["audit_totals"] = f"WITH {REAL_SQL} SELECT voice_id, {_TOTALS} FROM reals GROUP BY voice_id"


def audit_spoken(spark, sf):
    """The flagship with numbers read as they are spoken."""
    return A.audit_totals(_diffs(spark, sf, True))


QUERIES["audit_totals_spoken_form"] = audit_spoken
# the turns hold no figures: of the script rules only the one on list marks changes their words; charitable_money has figures
_MARKS_OFF = "regexp_replace({0}, '(?m)^[ \\t]{{0,8}}(?:[-*•‣▪·]|[0-9]{{1,3}}[.)]|[a-zA-Z][.)])[ \\t]+', '', 'g')"
_SAID = f"""pairs AS (
  SELECT a.conv_id * 100 + a.turn AS clip_id, a.role AS voice_id, {_MARKS_OFF.format("a.text")} AS sent, {_MARKS_OFF.format("b.text")} AS spoken
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""
SAID_SQL = _chain(_SAID)[2]
ORACLE["audit_totals_spoken_form"] = f"""WITH {SAID_SQL}, owned AS (SELECT *, flatten(list_transform(misheard, lambda p: [p.s, p.h])) AS own FROM diff),
reals AS (SELECT *, list_filter(hard_dropped, lambda w: NOT list_contains(own, w)) AS rd, list_filter(hard_inserted, lambda w: NOT list_contains(own, w)) AS ra FROM owned)
SELECT {_TOTALS} FROM reals"""


def audit_rows(spark, sf):
    r = A.audit_rows(_diffs(spark, sf))
    return r.select("clip_id", long("added").alias("added"), long("dropped_n").alias("dropped"), "word_accuracy", F.array_join("real_dropped", " ").alias("words"))


QUERIES["audit_rows"] = audit_rows
ORACLE["audit_rows"] = f"""
WITH {REAL_SQL} SELECT clip_id, len(ra) AS added, len(rd) AS dropped, word_accuracy, array_to_string(rd, ' ') AS words FROM reals"""


def top_dropped(spark, sf):
    return A.top_words(A.real_errors(_diffs(spark, sf)), "real_dropped")


QUERIES["top_dropped_words"] = top_dropped
ORACLE["top_dropped_words"] = f"""
WITH {REAL_SQL} SELECT word, count(*) AS times FROM (SELECT unnest(rd) AS word FROM reals) GROUP BY word ORDER BY times DESC, word LIMIT 8"""


def top_tail(spark, sf):
    return A.top_words(_diffs(spark, sf), "tail_inserted")


QUERIES["top_leaked_words"] = top_tail
ORACLE["top_leaked_words"] = f"""
WITH {CLASS_SQL} SELECT word, count(*) AS times FROM (SELECT unnest(tail_inserted) AS word FROM diff) GROUP BY word ORDER BY times DESC, word LIMIT 8"""


def top_misheard(spark, sf):
    return A.top_misheard(_diffs(spark, sf))


QUERIES["top_misheard_pairs"] = top_misheard
ORACLE["top_misheard_pairs"] = f"""
WITH {CLASS_SQL} SELECT x.s AS sent, x.h AS heard, count(*) AS times FROM (SELECT unnest(misheard) AS x FROM diff) GROUP BY 1, 2 ORDER BY times DESC, sent, heard LIMIT 8"""


def _reread(spark, sf):
    """Documents read back: every 17th word lost, every 11th without its last letter."""
    docs = spread(table(spark, sf, "documents").filter("lang = 'en'"), rows=2_000)
    words = W.diff_tokens(F.col("text"))
    heard = F.filter(
        F.transform(
            words,
            lambda w, i: F.when(i % 17 == 5, F.lit("")).when((i % 11 == 3) & (F.length(w) > 4), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w),
        ),
        lambda w: w != "",
    )
    return docs.select(F.col("doc_id").alias("clip_id"), F.col("text").alias("sent"), F.array_join(heard, " ").alias("spoken"))


def transcriber_agreement(spark, sf):
    a = _diffs(spark, sf)
    flipped = turn_pairs(spark, sf).withColumn("spoken", F.concat("sent", F.lit(" "), F.substring_index("spoken", " ", 2)))
    return A.compare_transcribers(a, D.word_diff(flipped, spoken_form=False))


QUERIES["compare_transcribers"] = transcriber_agreement
_OTHER = """pairs AS (SELECT a.conv_id * 100 + a.turn AS clip_id, a.role AS voice_id, a.text AS sent,
  a.text || ' ' || array_to_string(string_split(b.text, ' ')[1:2], ' ') AS spoken
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""
_BOTH = f"""(SELECT a.clip_id, a.word_accuracy AS a_accuracy, a.clean AS a_clean, b.word_accuracy AS b_accuracy, b.clean AS b_clean, a.clean = b.clean AS agree
  FROM (WITH {CLASS_SQL} SELECT *, len(missing) = 0 AND len(extra) = 0 AS clean FROM diff) a
  JOIN (WITH {_chain(_OTHER)[2]} SELECT *, len(missing) = 0 AND len(extra) = 0 AS clean FROM diff) b ON a.clip_id = b.clip_id)"""
ORACLE["compare_transcribers"] = f"SELECT * FROM {_BOTH}"


def agreement_summary(spark, sf):
    s = A.agreement_summary(transcriber_agreement(spark, sf))
    return s.withColumns({c: F.round(c, 6) for c in ("a_accuracy", "b_accuracy")})


QUERIES["agreement_summary"] = agreement_summary
ORACLE["agreement_summary"] = f"""
SELECT count(*) AS clips, count(*) FILTER (WHERE a_clean) AS a_clean, count(*) FILTER (WHERE b_clean) AS b_clean,
  round(avg(a_accuracy), 6) AS a_accuracy, round(avg(b_accuracy), 6) AS b_accuracy, count(*) FILTER (WHERE agree) AS agree FROM {_BOTH}"""


def reread_audit(spark, sf):
    """Audit totals of documents against a damaged copy of themselves."""
    return A.audit_totals(D.word_diff(_reread(spark, sf), spoken_form=False))


QUERIES["reread_audit"] = reread_audit
_REREAD = f"""pairs AS (SELECT doc_id AS clip_id, '' AS voice_id, text AS sent,
  array_to_string(list_filter(list_transform({_TOK.format("text")}, lambda w, i: CASE WHEN (i - 1) % 17 = 5 THEN ''
    WHEN (i - 1) % 11 = 3 AND length(w) > 4 THEN left(w, length(w) - 1) ELSE w END), lambda w: w <> ''), ' ') AS spoken
  FROM documents WHERE lang = 'en')"""


_REAL = """, owned AS (SELECT *, flatten(list_transform(misheard, lambda p: [p.s, p.h])) AS own FROM diff),
reals AS (SELECT *, list_filter(hard_dropped, lambda w: NOT list_contains(own, w)) AS rd, list_filter(hard_inserted, lambda w: NOT list_contains(own, w)) AS ra FROM owned)"""


def reread_counts(spark, sf):
    c = D.word_counts(_reread(spark, sf), spoken_form=False)
    return c.select("clip_id", *[long(x).alias(x) for x in ("sent_words", "matched", "dropped", "inserted")])


QUERIES["reread_counts"] = reread_counts
ORACLE["reread_counts"] = f"""
WITH s AS (SELECT doc_id AS clip_id, {_TOK.format("text")} AS t FROM documents WHERE lang = 'en'),
tok AS (SELECT clip_id, t[i] AS w, 1 AS s, 0 AS h FROM s, range(1, len(t) + 1) r(i)
  UNION ALL SELECT clip_id, CASE WHEN (i - 1) % 11 = 3 AND length(t[i]) > 4 THEN regexp_replace(left(t[i], length(t[i]) - 1), '''+$', '') ELSE t[i] END, 0, 1
  FROM s, range(1, len(t) + 1) r(i) WHERE (i - 1) % 17 <> 5),
c AS (SELECT clip_id, w, sum(s) AS s, sum(h) AS h FROM tok GROUP BY clip_id, w)
SELECT clip_id, CAST(sum(s) AS BIGINT) AS sent_words, CAST(sum(least(s, h)) AS BIGINT) AS matched, CAST(sum(s - least(s, h)) AS BIGINT) AS dropped,
  CAST(sum(h - least(s, h)) AS BIGINT) AS inserted FROM c GROUP BY clip_id"""


def plan_actions(spark, sf):
    """Clips of user turns are taken to have a tail segment."""
    pairs = turn_pairs(spark, sf)
    out = A.plan_actions(D.word_diff(pairs, spoken_form=False), pairs.filter("voice_id = 'user'"))
    return out.groupBy("action", "reason").agg(F.count(F.lit(1)).alias("clips"))


QUERIES["plan_actions"] = plan_actions
ORACLE["plan_actions"] = f"""
WITH {CLASS_SQL}, v AS (SELECT *, {_VERDICTS} FROM diff),
a AS (SELECT *, CASE WHEN only_tail_is_wrong AND voice_id = 'user' THEN 'trim' WHEN worth_regenerating THEN 'regenerate' ELSE 'ship' END AS action FROM v)
SELECT action, CASE WHEN action = 'regenerate' THEN CASE WHEN len(missing) > 0 THEN 'dropped_words' WHEN len(extra) > 0 THEN 'extra_words' ELSE 'unclear' END END AS reason,
  count(*) AS clips FROM a GROUP BY 1, 2"""


def choose_attempt(spark, sf):
    """All turn pairs of a conversation as attempts at the same clip."""
    d = _diffs(spark, sf)
    attempts = d.withColumns({"conv_id": F.floor(F.col("clip_id") / 100), "attempt": F.col("clip_id") % 100})
    out = A.choose_attempt(attempts, ["conv_id"])
    return out.select("conv_id", "attempt", long("errors").alias("errors"))


QUERIES["choose_attempt"] = choose_attempt
ORACLE["choose_attempt"] = f"""
WITH {CLASS_SQL} SELECT clip_id // 100 AS conv_id, arg_min(clip_id % 100, (len(missing) + len(extra)) * 1000 + clip_id % 100) AS attempt,
  min(len(missing) + len(extra)) AS errors FROM diff GROUP BY 1"""


def best_reading(spark, sf):
    b = D.best_reading(turn_pairs(spark, sf))
    return b.select("clip_id", long("reading").alias("reading"), "word_accuracy", "ok")


QUERIES["best_reading"] = best_reading
ORACLE["best_reading"] = f"WITH {SAID_SQL} SELECT clip_id, 0::BIGINT AS reading, word_accuracy, len(hard_dropped) = 0 AND len(hard_inserted) = 0 AS ok FROM diff"


def charitable_money(spark, sf):
    """Three amounts of an order: some were sent with a unit, all were written down with a mark; one order in eleven has a word more."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    amounts = [k % 90 + 3, F.floor(k / 90) % 90 + 3, F.col("o_custkey") % 90 + 3]
    sent, spoken = [F.lit("order ")], [F.lit("order ")]
    for i, (a, joint) in enumerate(zip(amounts, (" then ", " and ", ""))):
        sent += [a.cast("string"), F.when(F.floor(k / 2**i) % 2 == 1, " dollars").otherwise(""), F.lit(joint)]
        spoken += [F.lit("$"), a.cast("string"), F.lit(joint)]
    spoken.append(F.when(k % 11 == 0, " indeed").otherwise(""))
    pairs = o.select(k.alias("clip_id"), F.concat(*sent).alias("sent"), F.concat(*spoken).alias("spoken"))
    b = D.best_reading(spread(pairs))
    return b.select("clip_id", long("reading").alias("reading"), "word_accuracy", "ok", F.array_join("dropped", " ").alias("dropped"), F.array_join("inserted", " ").alias("inserted"))


QUERIES["charitable_money"] = charitable_money
ORACLE["charitable_money"] = """
SELECT o_orderkey AS clip_id, CAST(CASE WHEN o_orderkey % 8 = 7 THEN 0 ELSE 2 END AS BIGINT) AS reading, 1.0::DOUBLE AS word_accuracy, o_orderkey % 11 <> 0 AS ok,
  '' AS dropped, CASE WHEN o_orderkey % 11 = 0 THEN 'indeed' ELSE '' END AS inserted FROM orders"""


def staged_verify(spark, sf):
    """Conversations as clips, turn pairs as their chunks."""
    chunks = turn_pairs(spark, sf).select(
        F.floor(F.col("clip_id") / 100).alias("clip_id"), (F.col("clip_id") % 100).alias("chunk_no"), "sent", "spoken"
    )
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", c))), lambda s: s[c]), " ").alias(c)
    clips = chunks.groupBy("clip_id").agg(in_order("sent"), in_order("spoken"))
    return A.staged_verify(clips, chunks, spoken_form=False)


QUERIES["staged_verify"] = staged_verify
_CLIPS = """pairs AS (SELECT a.conv_id AS clip_id, '' AS voice_id, string_agg(a.text, ' ' ORDER BY a.turn) AS sent, string_agg(b.text, ' ' ORDER BY a.turn) AS spoken
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 GROUP BY a.conv_id)"""
ORACLE["staged_verify"] = f"""
WITH w AS (SELECT clip_id, word_accuracy, len(missing) = 0 AND len(extra) = 0 AS clean FROM (WITH {_chain(_CLIPS)[2]} SELECT * FROM diff)),
c AS (SELECT clip_id // 100 AS clip_id, count(*) AS chunks, count(*) FILTER (WHERE NOT (len(missing) = 0 AND len(extra) = 0)) AS bad FROM (WITH {CLASS_SQL} SELECT * FROM diff) GROUP BY 1)
SELECT w.clip_id, CASE WHEN clean THEN 'whole-clip' ELSE 'per-chunk' END AS verify_mode, CASE WHEN NOT clean AND chunks > 1 THEN chunks + 1 ELSE 1 END AS passes,
  CASE WHEN clean THEN 0 WHEN chunks > 1 THEN bad ELSE 1 END AS bad_chunks, word_accuracy FROM w JOIN c USING (clip_id)"""
