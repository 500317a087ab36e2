"""Registered queries against DuckDB, and the shape of their plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
CHECKED = [
    "audit_totals", "word_counts", "number_occurrences", "strip_tags", "collapse", "split_sentences", "padding_overhead",
    "voice_stats", "explain_rtf", "queue_board", "assign_unique_names", "silent_runs", "gated_loudness", "null_distances", "rtf_ladder",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["chunk_scripts", "voice_stats", "silent_runs", "match_levels", "join_timeline", "null_distances", "explain_rtf"])
def test_plans_stay_in_the_jvm_without_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(entry.queries()["overall_rtf"](spark, SF))
    scan = text[text.index("ReadSchema") :].split("\n")[0]
    assert "event_type" not in scan and "ts" not in scan.replace("struct", "")


@pytest.mark.parametrize("spoken_form", [False, True])
def test_the_diff_stays_in_its_row(spark, spoken_form):
    """One aligner and no shuffle; another reading is another aligner in the same row."""
    from cuesheet.operators import diff as D

    pairs = spark.createDataFrame([(1, "a b", "b a")], "clip_id long, sent string, spoken string")
    text = plan(D.word_diff(pairs, spoken_form))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1
    text = plan(D.best_reading(pairs))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 3
