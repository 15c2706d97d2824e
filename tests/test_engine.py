"""Directions and invariants: a corrupted copy must measure worse, units and offsets must not matter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlens import model as m
from trajlens.functions import language, spectral
from trajlens.operators import batch, harness, metrics, scoring, signals
from trajlens.sources import sinks
from trajlens.streaming import windowed_activity

FPS = 30.0


def smooth(n=300, dims=2, offset=0.0, scale=1.0):
    t = np.arange(n) / n
    return [[float(offset + scale * (d + 1) * (0.5 - 0.5 * math.cos(2 * math.pi * x))) for d in range(dims)] for x in t]


def frames(spark, episodes):
    data = [(e, i, a, a) for e, rows in episodes.items() for i, a in enumerate(rows)]
    return spark.createDataFrame(data, "episode_id long, idx int, action array<double>, state array<double>")


def values(df):
    return {r.episode_id: r.value for r in df.collect()}


def test_jitter_is_rougher_and_units_do_not_matter(spark):
    clean = frames(spark, {1: smooth(), 2: smooth(scale=1000.0, offset=5.0)})
    speed = signals.group_speed(clean, [0, 1], FPS)
    got = values(metrics.ldlj(speed, FPS, "arm"))
    assert got[1] == pytest.approx(got[2], rel=1e-6)
    shaken = signals.group_speed(harness.jitter(clean, 0.05), [0, 1], FPS)
    bad = values(metrics.ldlj(shaken, FPS, "arm"))
    assert bad[1] < got[1]
    sparc = {r.episode_id: r.v for r in spectral.window_arc_length(signals.windows(speed, FPS, 3, 16), FPS).groupBy("episode_id").agg(F.median("v").alias("v")).collect()}
    rough = {r.episode_id: r.v for r in spectral.window_arc_length(signals.windows(shaken, FPS, 3, 16), FPS).groupBy("episode_id").agg(F.median("v").alias("v")).collect()}
    assert rough[1] < sparc[1]


def test_idle_starts_and_ends_are_seen(spark):
    clean = frames(spark, {1: smooth()})
    time = lambda f: {r.metric: r.value for r in metrics.time_metrics(spectral.filtered_speed(signals.group_speed(f, [0, 1], FPS), FPS), FPS).collect()}
    a, b, c = time(clean), time(harness.idle_start(clean, 60)), time(harness.idle_end(clean, 60))
    assert b["idle_lead_s"] >= a["idle_lead_s"] + 1.8
    assert c["idle_trail_s"] >= a["idle_trail_s"] + 1.8
    assert time(harness.mid_pause(clean, 90))["longest_pause_s"] > 1.5


def test_filter_keeps_constants_and_drops_fast_parts():
    assert np.allclose(spectral.lowpass(np.full(100, 3.0), 10, 30), 3.0)
    b, a = spectral.butterworth(10, 30)
    assert b.sum() / a.sum() == pytest.approx(1) and abs(np.polyval(b, np.exp(2j * np.pi / 3)) / np.polyval(a, np.exp(2j * np.pi / 3))) ** 2 == pytest.approx(0.5)
    t = np.arange(300) / 30
    fast = spectral.lowpass(np.sin(2 * np.pi * 13 * t), 10, 30)[50:-50]
    assert np.abs(fast).max() < 0.1
    assert np.isnan(spectral.arc_length(np.zeros(50), 30, 10)) and np.isnan(spectral.power_ratio(np.zeros(5), 30))


def test_hysteresis_ignores_noise(spark):
    one = lambda xs: frames(spark, {1: [[float(x)] for x in xs]})
    at = lambda xs: [r.idx for r in signals.gripper_transitions(signals.gripper_unit(one(xs), [0])).orderBy("idx").collect()]
    assert at([0] * 100 + [1] * 100 + [0] * 100) == [100, 200]
    assert at([0] + [1] + [0.45, 0.55] * 50) == [1]
    assert at([2] * 50) == []


def test_zero_inflated_scale_lands_on_warn(spark):
    v = [0.0] * 90 + [1.0] * 5 + [4.0] * 5
    df = spark.createDataFrame([("g", "x", "", x) for x in v], "group_label string, metric string, signal string, value double")
    s = scoring.fit(df).first()
    assert (2.5 - s["median"]) / s["scale_high"] == pytest.approx(2.0) and s["scale_low"] == m.MIN_SCALE


def test_groups_need_enough_episodes(spark):
    rows = [(i, "a" if i < 20 else "b" if i < 39 else "") for i in range(70)]
    found = scoring.assign_groups(spark.createDataFrame(rows, "episode_id long, task_key string")).groupBy("group_label").count().collect()
    assert {r.group_label: r["count"] for r in found} == {"task:a": 20, m.POOLED: 50}


def test_profile_takes_the_worst_group(spark):
    z = spark.createDataFrame([(1, "g", "sparc", "", 0.5, 0.5), (1, "g", "idle_lead_s", "", 4.0, 4.0), (1, "g", "length_z", "", 0.1, 0.1)], "episode_id long, group_label string, metric string, signal string, z double, value double")
    r = scoring.profile_scores(scoring.worst_signals(z)).first()
    assert (r.score, r.n_flags, r.driver, r.verdict) == (4.0, 1, "time", "fail")


def test_lag_and_offset(spark):
    a = [[math.sin(0.7 * i) + 0.4 * math.sin(0.23 * i + d) for d in range(2)] for i in range(300)]
    late = [(1, i, a[i], [x + 7.0 for x in a[max(0, i - 5)]]) for i in range(len(a))]
    df = spark.createDataFrame(late, "episode_id long, idx int, action array<double>, state array<double>")
    lag = metrics.track_lag(df, [0, 1], FPS)
    assert lag.first().lag == 5
    assert values(metrics.track_resid(df, lag, [0, 1], "arm"))[1] < 0.05


def test_spikes(spark):
    a = smooth()
    b = [[x + (3.0 if i in (100, 200) else 0.0) for x in r] for i, r in enumerate(a)]
    acc = lambda rows: metrics.accel_spikes(signals.acceleration(frames(spark, {1: rows}), [0, 1], FPS))
    assert values(metrics.accel_spike_frac(acc(a)))[1] == 0
    assert values(metrics.accel_spike_frac(acc(b)))[1] > 0
    assert metrics.spike_clusters(acc(b), FPS).count() == 2


def test_integrity_counts(spark):
    rows = [(1, i, i, [0.0]) for i in range(40)] + [(2, i, f, [float("nan") if i == 3 else 0.0]) for i, f in enumerate([1, 2, 2, 5, 4])]
    df = spark.createDataFrame(rows, "episode_id long, idx int, frame_index long, action array<double>")
    got = {r.episode_id: r for r in metrics.integrity(df, FPS).collect()}
    assert got[1].verdict == "pass" and got[1].frame_gaps == 0 and got[1].note is None
    assert got[2].frame_gaps == 4 and got[2].nonfinite_values == 1 and got[2].too_short == 1 and got[2].verdict == "fail"


def test_language(spark):
    weak = ["Hold", "Up", "task desc", "Task", "the red box on the left table"]
    fine = ["stack cube left", "Picking up the cube and placing it in the box", "把 红 色"]
    df = spark.createDataFrame([(t,) for t in weak + fine + ["  ", None]], "t string")
    got = {r.t: r for r in df.select("t", language.task_generic(F.col("t")).alias("g"), language.task_missing(F.col("t")).alias("m")).collect()}
    assert all(got[t].g == 1 for t in weak) and all(got[t].g == 0 for t in fine)
    assert got["  "].g is None and got["  "].m == 1 and got[None].m == 1
    key = spark.createDataFrame([(["Pick  up, Ünder!", "a-b", "pick up under", " "],)], "t array<string>").select(language.canonical_task(F.col("t")).alias("k")).first().k
    assert key == "a b | pick up under | pick up ünder"


def test_leverage_and_divergence(spark):
    eps = {i: smooth(60, 2) for i in range(6)}
    eps[5] = [[r[0] + (9.0 if j == 3 else 0.0), r[1]] for j, r in enumerate(eps[5])]
    df = frames(spark, eps)
    src = spark.createDataFrame([(i, "s") for i in range(6)], "episode_id long, source_id string")
    got = {r.episode_id: r.leverage for r in batch.stats_leverage(df, src).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 2}
    contrary = df.withColumn("action", F.when(F.col("episode_id") == 4, F.transform("action", lambda x: -x)).otherwise(F.col("action")))
    d = values(batch.action_divergence(batch.aux_sample(contrary), src.withColumnRenamed("source_id", "grp")))
    assert max(d, key=d.get) in (4, 5) and d[4] > d[0]


def test_outlier_has_the_highest_scores(spark):
    rng = np.random.default_rng(0)
    rows = [("g", i, rng.normal(size=3).tolist()) for i in range(60)] + [("g", 99, [9.0, 9.0, 9.0])] + [("small", 100 + i, [float(i)] * 3) for i in range(7)]
    df = spark.createDataFrame(rows, "grp string, episode_id long, x array<double>")
    for f in (batch.novelty, batch.isolation_scores):
        got = values(f(df))
        assert max(got, key=got.get) == 99 and len(got) == 61


def test_upsert_clears_stale_fields(spark):
    old = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "episode_id long, a double, b double")
    new = spark.createDataFrame([(1, 9.0, 8.0)], "episode_id long, a double, c double")
    got = {r.episode_id: r.asDict() for r in sinks.upsert(old, new).collect()}
    assert got[1] == {"episode_id": 1, "a": 9.0, "b": None, "c": 8.0} and got[2] == {"episode_id": 2, "a": 3.0, "b": 4.0, "c": None}
    again = sinks.upsert(sinks.upsert(old, new), new)
    assert sorted(again.collect()) == sorted(sinks.upsert(old, new).collect())


def test_tags(spark):
    spans = spark.createDataFrame([(1, 1.0, 1.0, "idle", "warn"), (1, 0.5, 2.5, "rough", None)], "episode_id long, start_s double, end_s double, label string, severity string")
    got = sorted((r.start_ns, r.end_ns, r.tag) for r in sinks.temporal_tags(spans).collect())
    assert got == [(500000000, 2500000000, "rough"), (1000000000, 1000000001, "idle:warn")]
    old = spark.createDataFrame([(1, "auto", "x"), (1, "hand", "y"), (2, "auto", "z")], "episode_id long, anchor string, tag string")
    new = spark.createDataFrame([(1, "n")], "episode_id long, tag string")
    got = sinks.replace_own_tags(old, new, "auto", spark.createDataFrame([(1,)], "episode_id long"))
    assert sorted(map(tuple, got.collect())) == [(1, "auto", "n"), (1, "hand", "y"), (2, "auto", "z")]


def test_spearman_and_truncation(spark):
    df = spark.createDataFrame([("m", float(i), float(i**3)) for i in range(9)], "metric string, a double, b double")
    assert harness.spearman(df).first().rho == pytest.approx(1.0)
    f = frames(spark, {1: smooth(100), 2: smooth(20)})
    assert [(r.episode_id, r["count"]) for r in harness.truncate(f, 1.0, FPS).groupBy("episode_id").count().collect()] == [(1, 30)]


def test_every_scored_metric_has_a_group():
    assert {x.name for x in m.METRICS if x.kind == "value"} >= {x.name for x in m.METRICS if x.group and x.kind == "value"}
    assert len(m.METRICS) == 38 and m.GROUPS == ["motion", "time", "tracking", "gripper", "consistency", "camera"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_activity(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 day", "30 days")
    q = stream.writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda rows: sorted((r.start, r.frames) for r in rows)
    assert key(spark.table("act").collect()) == key(windowed_activity(events, "1 day").collect())


def test_corruptions_do_what_they_say(spark):
    f = frames(spark, {1: smooth(300), 2: smooth(200)})
    n = lambda d: {r.episode_id: r["count"] for r in d.groupBy("episode_id").count().collect()}
    assert n(harness.identity(f)) == {1: 300, 2: 200} and n(harness.one_frame(f)) == {1: 1, 2: 1}
    assert n(harness.abandoned(f)) == {1: 75, 2: 50}
    cut = n(harness.cut_off(f, FPS))
    assert 90 < cut[1] < 211 and 60 < cut[2] < 141
    path = lambda d: values(metrics.path_length(signals.group_speed(d, [0, 1], FPS), FPS))
    assert path(harness.wander(f, 2.0))[1] > path(f)[1]
    assert values(metrics.ldlj(signals.group_speed(harness.stop_and_go(f, FPS), [0, 1], FPS), FPS, "arm"))[1] < values(metrics.ldlj(signals.group_speed(f, [0, 1], FPS), FPS, "arm"))[1]
    assert harness.nan_values(f).where("exists(action, x -> isnan(x))").count() == 2
    busy = spark.createDataFrame([(1, i, [math.sin(0.7 * i) + 0.4 * math.sin(0.23 * i)], [math.sin(0.7 * i) + 0.4 * math.sin(0.23 * i)]) for i in range(300)], "episode_id long, idx int, action array<double>, state array<double>")
    assert metrics.track_lag(harness.lagged_state(busy, FPS), [0], FPS).first().lag == 8
    assert values(metrics.accel_spike_frac(metrics.accel_spikes(signals.acceleration(harness.jolts(f, 0, 2.0), [0, 1], FPS))))[1] > 0
    bounds = spark.createDataFrame([(0, 0.0, 1.0)], 'dim int, lo double, hi double')
    assert values(metrics.joint_limit_frac(harness.at_limits(f, 0, 1.0), [0], bounds))[1] > values(metrics.joint_limit_frac(f, [0], bounds))[1]
    assert not metrics.joint_limit_frac(f, [0]).count()
    flips = lambda d: values(metrics.gripper_flips(signals.gripper_unit(d, [1]), FPS, "g"))
    assert flips(harness.gripper_chatter(f, 1, 0.0, 2.0))[1] > flips(f)[1] + 1
    stalled = values(metrics.track_resid(harness.stalled_joint(busy, 0), metrics.track_lag(busy, [0], FPS), [0], "arm"))
    assert stalled[1] > values(metrics.track_resid(busy, metrics.track_lag(busy, [0], FPS), [0], "arm"))[1]
    df = spark.createDataFrame([(1, i, i, [0.0]) for i in range(40)], "episode_id long, idx int, frame_index long, action array<double>")
    assert metrics.integrity(harness.duplicate_frame(df), FPS).first().frame_gaps == 2
