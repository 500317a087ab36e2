"""Streams against the batch answer, late data, replay state, sources and sinks."""

import datetime as dt
import json

from pyspark.sql import functions as F

from cuesheet.operators import renders as R
from cuesheet.session import scratch_dir
from cuesheet.sources import tables as S
from cuesheet.streaming import live as L

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def events(spark, rows):
    data = [(T0 + dt.timedelta(seconds=s), status, gen, audio) for s, status, gen, audio in rows]
    return spark.createDataFrame(data, "ts timestamp, status string, gen_sec double, audio_sec double")


def feed(spark, *batches):
    path = scratch_dir(spark, "feed")
    for i, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_batch(spark):
    rows = events(spark, [(i * 700, "Error" if i % 5 == 0 else "Done", i * 0.5, i + 1.0) for i in range(40)])
    got = L.latest(L.run_available(L.live_metrics(feed(spark, rows)), scratch_dir(spark, "m"), "update"), ["window_start"])
    want = L.live_metrics(rows)
    key = lambda df: sorted(map(tuple, df.select("window_start", "generations", "failures", "rtf_overall").collect()))
    assert key(got) == key(want)


def test_late_rows_are_dropped_and_the_batch_replay_has_them(spark):
    first = events(spark, [(0, "Done", 1.0, 4.0), (7200, "Done", 1.0, 4.0)])
    second = events(spark, [(7300, "Done", 1.0, 4.0)])
    late = events(spark, [(60, "Done", 1.0, 4.0)])
    out = L.latest(L.run_available(L.live_metrics(feed(spark, first, second, late)), scratch_dir(spark, "late"), "update"), ["window_start"])
    assert out.agg(F.sum("generations")).first()[0] == 3
    full = L.live_metrics(first.unionByName(second).unionByName(late))
    assert full.agg(F.sum("generations")).first()[0] == 4


def test_replays(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    steps = [
        ("a", 0, "request"), ("a", 1, "request"), ("a", 2, "done"), ("a", 3, "request"),
        ("b", 0, "request"), ("b", 5, "failed"), ("b", 6, "request"),
        ("a", 90000, "request"),
    ]
    rows = [(k, T0 + dt.timedelta(seconds=s), i, kind) for i, (k, s, kind) in enumerate(steps)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq long, kind string")
    split = [df.filter("seq < 4"), df.filter("seq >= 4")]
    out = L.run_available(L.classify_replays(feed(spark, *split)), scratch_dir(spark, "r"))
    got = {r.seq: r.verdict for r in out.collect()}
    assert got == {0: "new", 1: "busy", 3: "replay", 4: "new", 6: "new", 7: "new"}


def test_sessions_and_states(spark):
    rows = [(T0 + dt.timedelta(seconds=s), "h") for s in (0, 50, 160, 500)]
    out = L.busy_sessions(spark.createDataFrame(rows, "ts timestamp, host string")).collect()
    assert sorted(r.events for r in out) == [1, 3]
    old = spark.createDataFrame(rows, "ts timestamp, host string")
    new = spark.createDataFrame([(T0 + dt.timedelta(hours=3), "h")], "ts timestamp, host string")
    seen = L.run_available(L.busy_sessions(feed(spark, old, new)), scratch_dir(spark, "s")).collect()
    batch = L.busy_sessions(old).collect()
    key = lambda rs: sorted((r.session_start, r.session_end, r.events) for r in rs)
    assert key(seen) == key(batch)
    jobs = [(1, T0, 1, "Queued"), (1, T0, 2, "Processing"), (2, T0, 3, "Queued")]
    df = spark.createDataFrame(jobs, "job_id int, ts timestamp, seq long, status string")
    now = L.latest(L.run_available(L.job_state(feed(spark, df)), scratch_dir(spark, "j"), "update"), ["job_id"])
    assert {r.job_id: r.status for r in now.collect()} == {1: "Processing", 2: "Queued"}


def test_rate_warning(spark):
    cases = [(104.0, 100.0, False), (150.0, 100.0, True), (140.0, 210.0, True), (175.0, 210.0, False), (204.0, 147.0, False),
             (230.0, 147.0, True), (95.0, 147.0, True), (310.0, None, True), (40.0, None, True), (204.0, None, False), (0.0, 100.0, False)]
    df = spark.createDataFrame(cases, "m double, b double, want boolean")
    bad = df.filter(R.rate_warning(F.col("m"), F.col("b")).isNotNull() != F.col("want")).collect()
    assert not bad


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"file": "a.wav", "text": "one, \"two\""}, {"file": "b.wav", "text": "x\ny"}]))
    (tmp_path / "m.csv").write_text('file,text\na.wav,"one, ""two"""\nb.wav,"x\ny"\n')
    rows = [sorted(map(tuple, S.read_manifest(spark, str(tmp_path / n)).collect())) for n in ("m.json", "m.csv")]
    assert rows[0] == rows[1] == [("a.wav", 'one, "two"'), ("b.wav", "x\ny")]


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "lex.json").write_text(json.dumps({"_comment": "x", "MAGA": "", "NASA": "Nassa", "Bessent": "Bess ent"}))
    got = {r.key: r.spoken for r in S.read_lexicon(spark, str(tmp_path / "lex.json")).collect()}
    assert "MAGA" not in got and got["NASA"] == "Nassa" and got["Bessent"] == "Bess ent" and got["FIFA"] == "Fifa" and "_comment" not in got


def test_voice_index(spark, tmp_path):
    index = {"ann": {"path": "a.wav", "owner": None, "baseline_wpm": 140.5, "warnings": ["w"]}, "bob": {"path": "gone.wav"}}
    (tmp_path / "voices.json").write_text(json.dumps(index))
    files = spark.createDataFrame([("a.wav",)], "path string")
    have, skipped = S.read_voices(spark, str(tmp_path / "voices.json"), files)
    row = have.first()
    assert (row.voice_id, row.baseline_wpm, row.warnings, row.ref_text) == ("ann", 140.5, ["w"], "")
    assert [r.voice_id for r in skipped.collect()] == ["bob"]


def test_audit_log_keeps_no_text_and_counts_broken_lines(spark, tmp_path):
    path = str(tmp_path / "audit")
    df = spark.createDataFrame([(T0, "generation", "secret words", None)], "ts timestamp, event string, text string, tenant string")
    S.write_audit(df, path)
    raw = spark.read.text(path).first().value
    assert "secret" not in raw and "tenant" not in raw and "text_sha256" in raw
    (tmp_path / "audit" / "part-broken.json").write_text("{not json\n")
    back = S.read_audit(spark, path).cache()
    assert back.filter("_corrupt_record is not null").count() == 1 and back.filter("text_chars = 12").count() == 1


def test_bulk_table(spark):
    rows = [("s1", " Intro ", " hello "), ("s1", None, "NaN"), ("s1", "x", None), ("s2", "big", "a" * 100001), ("s2", "ok", "fine")]
    out = S.load_bulk_scripts(spark.createDataFrame(rows, "submission_id string, project string, script string")).collect()
    assert sorted((r.submission_id, r.project, r.accepted) for r in out) == [("s1", "Intro", True), ("s2", "big", False), ("s2", "ok", False)]
