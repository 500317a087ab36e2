"""Script clean-up, number speech, sentences and chunks: literal cases and invariants."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cuesheet.catalog.base import spread
from cuesheet.catalog.text import QUERIES as text_queries
from cuesheet.functions import numbers as N
from cuesheet.functions import text as X
from cuesheet.operators import chunking as C
from cuesheet.operators import normalize as NZ

FULL = [
    ("The castle sold for $320 million.", "The castle sold for three hundred twenty million dollars."),
    ("A ticket is £1.", "A ticket is one pound."),
    ("The twins won €2.5 billion there.", "The twins won two point five billion euros there."),
    ("Rain fell by 30 to 45%.", "Rain fell by thirty to forty-five percent."),
    ("It grew from 12,000 plants to 60,000.", "It grew from twelve thousand plants to sixty thousand."),
    ("My 3rd and 12th and 40th tries.", "My third and twelfth and fortieth tries."),
    ("a 33rd birthday", "a thirty-third birthday"),
    ("The May 9th market was loud.", "The May ninth market was loud."),
    ("The May 9 market was loud.", "The May ninth market was loud."),
    ("We counted 240 geese.", "We counted two hundred forty geese."),
    ("Floods of 2019 and 1807 and 2003", "Floods of twenty nineteen and eighteen oh-seven and two thousand and three"),
    ("Ring 555-867-5309 today.", "Ring five five five, eight six seven, five three zero nine today."),
    ("Rows 7-8 are empty", "Rows 7-8 are empty"),
    ("Tea is served at 4:20.", "Tea is served at four twenty."),
    ("Tea is served at 6:00.", "Tea is served at six o'clock."),
    ("Tea is served at 6:07.", "Tea is served at six oh seven."),
    ("behind the barn\u2014the dog", "behind the barn, the dog"),
    ("one warning: wet paint", "one warning, wet paint"),
    ("Nora\u2019s 12,000 bees", "Nora's twelve thousand bees"),
    ('Labels such as "fragile" help.', "Labels such as fragile help."),
    ("Good \U0001f600 morning.", "Good morning."),
    ("\u6625\u5929 77 \u6735\u82b1", "\u6625\u5929 77 \u6735\u82b1"),
    ("## Our Garden\n\nRoses are **thirsty**. Weeds *never* are.", "Our Garden. Roses are thirsty. Weeds never are."),
    ("- Buy soap\n- Buy string\n1. Wash\n2. Dry", "Buy soap. Buy string. Wash. Dry."),
    ("The boat was a\nvery old boat.", "The boat was a very old boat."),
    ("See [a map](https://example.org/map) first.", "See a map first."),
    ("<p>Salt &amp; pepper</p><br>", "Salt and pepper"),
    ("ANNA: Rain again.\nBEN: So soon?", "Rain again. So soon?"),
    ("The choir [coughs] sang on [2].", "The choir sang on."),
    ("Look at https://www.example.org/a?b=2 later.", "Look at example dot org later."),
    ("Write to bee@example.org soon.", "Write to bee at example dot org soon."),
    ("   ", "   "),
]


def test_full_level(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(FULL)], "script_id long, text string, want string")
    bad = [(r.text, r.spoken, r.want) for r in NZ.normalize_scripts(df).collect() if r.spoken != r.want]
    assert not bad


def test_basic_level_off_and_opt_in(spark):
    df = spark.createDataFrame([("on the 1st of March it ran to 90 pages",)], "text string")
    assert NZ.normalize_scripts(df, level="basic").first().spoken == "on the 1st of March it ran to ninety pages"
    src = "$500 million—now"
    assert NZ.normalize_scripts(spark.createDataFrame([(src,)], "text string"), level="off").first().spoken == src
    es = spark.createDataFrame([("Hola, esto es una prueba.", "Spanish")], "text string, language string")
    assert NZ.normalize_scripts(es, language="language", spaced_punct=True).first().spoken == "Hola , esto es una prueba ."
    assert NZ.normalize_scripts(es, language="language").first().lang_code == "es"


def test_user_lexicon_as_dict_and_as_table(spark):
    df = spark.createDataFrame([("Bessent and Don Jr spoke with Don.",)], "text string")
    rows = {"Bessent": "Bess ent", "Don Jr": "Donald Junior", "Don": "Donald"}
    want = "Bess ent and Donald Junior spoke with Donald."
    assert NZ.normalize_scripts(df, lexicon=rows).first().spoken == want
    table = spark.createDataFrame(list(rows.items()), "key string, spoken string")
    assert NZ.normalize_scripts(df, lexicon=table).first().spoken == want


def test_notes_name_the_rules(spark):
    df = spark.createDataFrame([("THIS IS VERY IMPORTANT NEWS: **pay** $5 \U0001f600",)], "text string")
    notes = {n.rule: n.hits for n in NZ.normalize_scripts(df).first().notes}
    assert notes["all_caps_run"] == 1 and notes["dropped_chars"] == 1 and notes["currency"] == 1 and notes["cleaned"] == 1


def test_filter_on_the_result_is_not_multiplied_out(spark):
    df = spark.createDataFrame([("It cost $1.",), ("no",)], "text string")
    assert NZ.normalize_scripts(df).filter("spoken like '%dollar%'").count() == 1


@pytest.mark.parametrize(
    ("n", "words"),
    [
        ("0", "zero"),
        ("100", "one hundred"),
        ("1001", "one thousand and one"),
        ("21000", "twenty-one thousand"),
        ("1100000", "one million, one hundred thousand"),
        ("1000000000000", "one trillion"),
    ],
)
def test_cardinals(spark, n, words):
    assert spark.range(1).select(N.cardinal(F.lit(n))).first()[0] == words


def test_export_text_has_no_outer_blanks(spark):
    text = "".join(f"{i % 10} word here, " for i in range(200))
    limits = spark.range(1, 300).select("id", F.lit(text).alias("t"))
    cols = [X.safe_export(F.col("t"), n) for n in range(1, 300, 7)]
    for value in limits.limit(1).select(*cols).first():
        assert value == value.strip()
    for raw in ("a\nb", "a\rb", "a\tb", "a\x00b", "a\x7fb"):
        assert spark.createDataFrame([(raw,)], "t string").select(X.safe_export(F.col("t"))).first()[0] == "a b"
    assert spark.createDataFrame([(None,)], "t string").select(X.safe_export(F.col("t"))).first()[0] == ""


def test_sentence_ends(spark):
    cases = [
        ("Surrender to U.S. Marshals, said Don Jr. He then left.", 2),
        ("Donald J. Trump spoke today.", 1),
        ("One. Two. Three.", 3),
        ("He met Dr. Who. Then left?", 2),
        ("", 0),
    ]
    df = spark.createDataFrame(cases, "text string, n int")
    assert all(len(r.sentences) == r.n for r in C.with_sentences(df).collect())


TEXTS = [
    "Alpha bravo charlie delta echo foxtrot. " * 4 + "Golf hotel india.",
    "A" * 95 + ". Ok.",
    ("word " * 200).strip(),
    "Hello there.",
    "This is a complete sentence of moderate length. " * 20,
    "Absolutely damning. Yes. He knew. " + "This is a much longer sentence that carries most of the text. " * 3,
    ("word " * 60).strip() + ". Short.",
    "x" * 900,
]




def test_chunks_keep_every_word_and_stay_in_bounds(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "script_id long, text string")
    for row in C.chunk_arrays(df, 100).collect():
        assert " ".join(row.chunks).split() == row.text.split()
        assert max(len(c) for c in row.chunks) <= 260 or " " not in row.text
        if len(row.text.strip()) > 200 and " " in row.text:
            assert len(row.chunks) > 1


def test_no_undersized_chunk_next_to_room(spark):
    df = spark.createDataFrame([(0, TEXTS[5]), (1, "Me. Yes. No. Stop. Go."), (2, TEXTS[1])], "script_id long, text string")
    rows = {r.script_id: r.chunks for r in C.chunk_arrays(df, 200).collect()}
    assert all(len(c) >= 60 for c in rows[0])
    assert len(rows[1]) == 1
    assert all(len(c) > 10 for c in {r.script_id: r.chunks for r in C.chunk_arrays(df, 100).collect()}[2])


#: Texts without a sentence: null, nothing, blanks, marks that the splitter takes out.
BLANK = [None, "", " \n\t", "\ufdd0" * 500]


def test_sentences_are_packed_beside_texts_without_any(spark):
    texts = [*BLANK, "One. Two.", "Alpha bravo. Charlie delta. Echo."]
    df = C.with_sentences(spark.createDataFrame(list(enumerate(texts)), "script_id long, text string"))
    rows = {r.script_id: r.chunks for r in C.chunk_sentences(df, 20).collect()}
    assert rows == {0: [], 1: [], 2: [], 3: [], 4: ["One. Two."], 5: ["Alpha bravo.", "Charlie delta.", "Echo."]}
    assert spark.createDataFrame([(BLANK[3],)], "t string").select(C.chunk_array(F.col("t"))).first()[0] == [BLANK[3]]


def test_short_chunks_are_merged_beside_texts_without_any(spark):
    texts = [*BLANK, "Me. Yes. " + "Absolutely nothing else was said. " * 2 + "No."]
    df = C.with_sentences(spark.createDataFrame(list(enumerate(texts)), "script_id long, text string"))
    out = C.merge_short(C.chunk_sentences(df, 40), 20, 60)
    rows = {r.script_id: r.chunks for r in out.collect()}
    long = "Absolutely nothing else was said."
    assert rows == {0: [], 1: [], 2: [], 3: [], 4: [f"Me. Yes. {long}", f"{long} No."]}


def test_blank_scripts_keep_their_row_in_merge_short(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*BLANK, "One. Two.", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.script_id: (r.chunks, r.digest) for r in text_queries["merge_short"](spark, str(tmp_path)).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {**dict.fromkeys((0, 1, 2, 3, 5), (0, md5(""))), 4: (1, md5("One. Two."))}


def test_size_gate_checks_characters_first(spark):
    df = spark.createDataFrame([("a " * 5000,), ("b " * 1500,), ("ok",)], "text string")
    reasons = [r.size_reason for r in NZ.gate_size(df).collect()]
    assert "10000 characters" in reasons[0] and "1500 words" in reasons[1] and reasons[2] is None


def test_entities_like_a_browser(spark):
    import html

    cases = [
        "it&#146;s &#151; so &dollar;5", "&#00000000065;&#x00000041;", "&notit; &copyright &ampere", "&NotEqualTilde; &fjlig; &CounterClockwiseContourIntegral;",
        "&#0; &#x110000; &#xD800; &#99999999999999999999; &#x;", "a&#1;b&#11;c&#127;d", "&unknown; &; &#; & x", "&eacute&hellip;", "&#128;&#129;&#159;",
    ]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(X.decode_entities(F.col("t"))).collect()] == [html.unescape(c) for c in cases]


def test_gated_steps_equal_the_whole_rules(spark):
    texts = ["a  b\t, c ,, d . e!x", " lead", "tail \n", "x -- y - z — q…r", "a:b 5:30 c", '"q"; r\ns', "", "  ", "plain words", "a ,.b", "é ñ — ^ ` ☃", "a ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    for whole, steps in ((X.pauses, X.pause_steps()), (X.collapse, X.collapse_steps())):
        out = df
        for step in steps:
            out = out.withColumn("t", step(F.col("t")))
        want = [r.t for r in df.select("k", whole(F.col("t")).alias("t")).orderBy("k").collect()]
        assert [r.t for r in out.orderBy("k").collect()] == want


def test_small_numbers_by_table_equal_the_spelled_ones(spark):
    rows = [(s,) for s in ("0", "007", "21", "100", "105", "999", "1000", "1005", "1105", "20000", "999999", "1000000", "0001000000")]
    got = [r.w for r in spark.createDataFrame(rows, "d string").select(N.cardinal(F.col("d")).alias("w")).collect()]
    assert got == [
        "zero", "seven", "twenty-one", "one hundred", "one hundred five", "nine hundred ninety-nine", "one thousand", "one thousand and five",
        "one thousand, one hundred five", "twenty thousand", "nine hundred ninety-nine thousand, nine hundred ninety-nine", "one million", "one million",
    ]


def test_a_task_does_not_grow_with_the_input(spark, tmp_path):
    spark.range(900).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert spread(spark.read.parquet(str(tmp_path / "t")), rows=10).rdd.getNumPartitions() == 90
