"""Ranged computations against brute force, with one hot key."""

import numpy as np
from pyspark.sql import functions as F

from cuesheet.operators import jobs as J
from cuesheet.plans import ordered as O


def rows(n=600):
    rng = np.random.default_rng(3)
    keys = ["hot" if rng.random() < 0.4 else f"k{rng.integers(20)}" for _ in range(n)]
    return [(k, i, int(rng.integers(0, 9))) for i, k in enumerate(keys)]


def test_prefix_sum_and_row_numbers(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, pos long, v long")
    out = O.prefix_sum(df, ["k"], "pos", F.col("v"), "s", O.by_range("pos", 16), total="t")
    got = {(r.k, r.pos): (r.s, r.t) for r in out.collect()}
    num = {(r.k, r.pos): r.n for r in O.row_numbers(df, ["k"], "pos", "n", O.by_range("pos", 16)).collect()}
    seen, count, total = {}, {}, {}
    for k, _, v in data:
        total[k] = total.get(k, 0) + v
    for k, pos, v in data:
        seen[k], count[k] = seen.get(k, 0) + v, count.get(k, 0) + 1
        assert got[(k, pos)] == (seen[k], total[k]) and num[(k, pos)] == count[k]


def test_islands_cross_range_borders(spark):
    flags = [i % 50 < 30 for i in range(400)]
    df = spark.createDataFrame([("c", i, f) for i, f in enumerate(flags)], "clip string, pos long, f boolean")
    got = sorted((r.start_frame, r.end_frame) for r in O.islands(df, ["clip"], "pos", F.col("f"), width=8).collect())
    assert got == [(s, s + 30) for s in range(0, 400, 50)]


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    data = [("a", float(x)) for x in rng.normal(-30, 12, 301)] + [("b", -240.0)] * 50 + [("b", -10.0)] * 3 + [("c", 1.0)]
    df = spark.createDataFrame(data, "k string, v double")
    points = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    got = {r.k: r for r in O.grouped_percentiles(df, ["k"], "v", points).collect()}
    for k in "abc":
        xs = [v for kk, v in data if kk == k]
        for name, p in points.items():
            assert abs(got[k][name] - np.percentile(xs, p * 100)) < 1e-9
    every = O.grouped_percentiles(df, [], "v", {"p": 0.5}).first().p
    assert abs(every - np.percentile([v for _, v in data], 50)) < 1e-9


def test_unique_names_never_collide(spark):
    bases = ["a", "a", "b", "a", "a_2", "a", "b", "a_2"] + ["voiceover"] * 40
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bases)], "id long, base string")
    taken = ["b", "a_3", "voiceover_2", "voiceover_7"]
    have = spark.createDataFrame([(t,) for t in taken], "name string")
    got = {r.id: r.unique_name for r in J.assign_unique(df, have, "base", "id", width=4).collect()}
    names = list(got.values())
    assert len(set(names)) == len(bases) and not set(names) & set(taken)
    assert got[0] == "a" and got[1] == "a_4" and got[2] == "b_2" and got[4] == "a_2"
    for i, b in enumerate(bases):
        assert got[i] == b or got[i].startswith(b + "_")


def test_failure_streak_is_a_plain_scan(spark):
    rng = np.random.default_rng(9)
    calls = [(f"h{rng.integers(3)}", i, bool(rng.random() < 0.6), bool(rng.random() < 0.2)) for i in range(300)]
    df = spark.createDataFrame(calls, "host string, event_id long, ok boolean, sticky boolean")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 977))
    got = {r.event_id: (r.streak, r.healthy) for r in J.failure_streak(df, seconds=10000.0).collect()}
    state = {}
    for host, i, ok, sticky in calls:
        streak, stuck = state.get(host, (0, False))
        state[host] = (0, False) if ok else (streak + 1, stuck or sticky)
        streak, stuck = state[host]
        assert got[i] == (streak, streak < 2 and not stuck)
