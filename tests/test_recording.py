"""Recordings end to end: low-passed times, spans, spectra, corruptions and rankings against plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trajlens import model as m
from trajlens import storage
from trajlens.functions import spectral
from trajlens.operators import batch, camera, harness, metrics, registry, scoring, signals, spans, video
from trajlens.picks import Group, Picks, assemble, infer, labels, picked
from trajlens.plans import quality
from trajlens.sources import episodes, layout, sinks

SF, FPS = "/root/testdata/sf0.001", 30.0


@pytest.fixture(scope="module")
def recording(spark):
    return quality.recording(spark, SF)


def _collected(df, value):
    out = {}
    for r in df.orderBy("episode_id", "i").collect():
        out.setdefault(r.episode_id, []).append(r[value])
    return {e: np.array(x) for e, x in out.items()}


def _plain_lowpass(x, hz, fps):
    """One sample at a time, both ways, from the transfer function."""
    if len(x) <= 15 or not 0 < hz < fps / 2:
        return x
    b, a = spectral.butterworth(hz, fps)
    k = np.zeros((4, 4))
    k[:, 0] = -a[1:]
    k[:-1, 1:] = np.eye(3)
    steady = np.linalg.solve(np.eye(4) - k, b[1:] - a[1:] * b[0])

    def one_way(y):
        z, out = steady * y[0], []
        for v in y:
            o = b[0] * v + z[0]
            z = np.array([b[j + 1] * v + (z[j + 1] if j < 3 else 0.0) - a[j + 1] * o for j in range(4)])
            out.append(o)
        return np.array(out)

    long = np.concatenate([2 * x[0] - x[15:0:-1], x, 2 * x[-1] - x[-2:-17:-1]])
    return one_way(one_way(long)[::-1])[::-1][15:-15]


def _plain_times(f, recovered):
    """Thresholds, runs and spans of one filtered speed."""
    p = np.percentile(f, 90)
    moving = f[f > p / 2]
    ref = np.median(moving) if len(moving) else p
    thr = 0.05 * ref
    idle = f < thr if thr > 0 else f <= 0
    n, runs, start = len(f), [], None
    for i, x in enumerate([*idle, False]):
        if x and start is None:
            start = i
        elif not x and start is not None:
            runs.append((start, i))
            start = None
    lead = next((i for i in range(n) if not idle[i]), n)
    trail = next((i for i in range(n) if not idle[n - 1 - i]), n)
    inner = [(a, b) for a, b in runs if a > 0 and b < n and not any(a < c2 + 30 and b > c1 - 30 for c1, c2 in recovered)]
    longest = max(inner, key=lambda r: (r[1] - r[0], -r[0]), default=None)
    found = []
    if lead >= 15:
        found.append((0.0, lead / FPS, "idle"))
    if trail >= 15 and n - trail > lead:
        found.append(((n - trail) / FPS, n / FPS, "idle"))
    if longest and longest[1] - longest[0] >= 15:
        found.append((longest[0] / FPS, longest[1] / FPS, "pause"))
    return {"idle_lead_s": lead / FPS, "idle_trail_s": trail / FPS, "longest_pause_s": (longest[1] - longest[0]) / FPS if longest else 0.0, "idle_frac": idle.mean(), "end_motion_ratio": np.median(f[-30:]) / ref}, found


def still(spark, rests=True):
    """Recordings with stillness at the ends and in the middle, and one regrasp beside a pause; or without rests and regrasps."""
    rows = []
    for e in range(4):
        n = 400 + 20 * e
        moves = np.sin(np.arange(n) / (5.0 + e)) + 0.2 * np.sin(np.arange(n) / 3.0)
        for a, b in ((0, 30 + 5 * e), (150, 190 + 10 * e), (260, 300), (n - 25, n)) if rests else ():
            moves[a:b] = moves[min(a, n - 1)]
        grip = np.ones(n)
        grip[270:275] = 1.0 - rests
        grip[285:] = 0.0
        rows += [(e, i, [float(moves[i]), float(moves[i] * 0.5), float(grip[i])], [float(moves[max(0, i - 2)]), float(moves[max(0, i - 2)] * 0.5), float(grip[i])]) for i in range(n)]
    frames = spark.createDataFrame(rows, "episode_id long, idx int, action array<double>, state array<double>")
    who = spark.createDataFrame([(e, "s", "t") for e in range(4)], "episode_id long, source_id string, task_key string")
    return registry.Recording(frames, who, FPS, quality.PICKS)


def test_filtered_times_and_spans_equal_plain_loops(spark, recording):
    for r in (recording, still(spark)):
        speed = _collected(r.arm_speed(), "speed")
        recovered = {}
        for x in r.recoveries().collect():
            recovered.setdefault(x.episode_id, []).append((x.c1, x.c2))
        got, spanned, shown = {}, {}, {}
        for x in r.times().collect():
            got.setdefault(x.episode_id, {})[x.metric] = x.value
        every = spans.flagged_spans(r)
        for x in every.collect():
            spanned.setdefault(x.episode_id, []).append((x.start_s, x.end_s, x.kind))
        lengths = r.own.groupBy("episode_id").agg(F.count(F.lit(1)).alias("length"))
        for x in spans.shown_times(lengths, every, FPS).collect():
            shown[x.episode_id] = x.times
        for e, x in speed.items():
            f = np.abs(_plain_lowpass(x, 10.0, FPS))
            want, found = _plain_times(f, recovered.get(e, []))
            assert got[e] == pytest.approx(want, rel=1e-6, abs=1e-9)
            mine = sorted(s for s in spanned.get(e, []) if s[2] in ("idle", "pause"))
            assert [s[2] for s in mine] == [s[2] for s in sorted(found)] and np.allclose([s[:2] for s in mine], [s[:2] for s in sorted(found)])
            rank = ["spike", "rough", "pause", "recovery", "idle"]
            middles = [(a + b) / 2 for a, b, k in sorted(spanned.get(e, []), key=lambda s: (rank.index(s[2]), s[0]))]
            picked_times = []
            for t in [*middles, min(0.2, (len(x) + 1) / FPS), (len(x) + 1) / FPS / 2]:
                t = round(t, 1)
                if len(picked_times) < 4 and all(abs(t - p) >= 0.5 - 1e-9 for p in picked_times):
                    picked_times.append(t)
            assert np.allclose(shown[e], sorted(picked_times), atol=0.1001) and len(shown[e]) == len(picked_times)
    assert {k for s in spanned.values() for _, _, k in s} >= {"idle", "pause", "rough", "recovery"}


def test_pauses_beside_a_recovery_do_not_count(spark):
    flags = spark.createDataFrame([(1, i, 100, 20 <= i < 40 or 60 <= i < 70) for i in range(100)], "episode_id long, i int, n int, idle boolean")
    near = spark.createDataFrame([(1, 45, 50)], "episode_id long, c1 int, c2 int")
    assert [(r.start, r.stop) for r in metrics.pauses(flags, None, 10.0).orderBy("start").collect()] == [(20, 40), (60, 70)]
    assert [(r.start, r.stop) for r in metrics.pauses(flags, near, 10.0).collect()] == [(60, 70)]  # 45 - 10 < 40
    assert metrics.pauses(flags, near, 12.0).collect() == []


def test_spectra_equal_plain_loops(recording):
    arm = recording.picks.of("arm")[0]
    speed = _collected(recording.speed(arm), "speed")
    unit = _collected(recording.unit(recording.picks.of("gripper")[0]).withColumnRenamed("idx", "i"), "unit")
    cuts = {}
    for r in signals.gripper_transitions(recording.unit(recording.picks.of("gripper")[0])).collect():
        cuts.setdefault(r.episode_id, []).append(r.idx)
    got = {(r.episode_id, r.win): (r.jerk, r.ratio) for r in recording.spectra(arm).collect()}
    phase = {r.episode_id: (r.value, r.worst) for r in registry.compute_raw(recording, ["sparc_phase"])[0].collect()}
    seen = 0
    for e, x in speed.items():
        for w, a in enumerate([0] if len(x) < 90 else range(0, len(x) - 89, 45)):
            y = x[a : a + 90]
            f = _plain_lowpass(y, 10.0, FPS)
            t = min(len(f) // 4, 12)
            f = f[t : len(f) - t]
            jerk = math.sqrt(np.mean([((f[i] - 2 * f[i - 1] + f[i - 2]) * 900) ** 2 for i in range(2, len(f))]))
            window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 64) for i in range(64)]
            power = np.zeros(33)
            for s in range(0, len(y) - 63, 32):
                part = y[s : s + 64] - y[s : s + 64].mean()
                for k in range(33):
                    z = sum(window[i] * part[i] * complex(math.cos(2 * math.pi * k * i / 64), -math.sin(2 * math.pi * k * i / 64)) for i in range(64)) if e < 3 and w < 2 else 0
                    power[k] += abs(z) ** 2 * (1 if k in (0, 32) else 2)
            assert got[e, w][0] == pytest.approx(jerk, rel=1e-6)
            if e < 3 and w < 2:
                low = sum(power[k] for k in range(33) if k * FPS / 64 <= FPS / 4)
                assert got[e, w][1] == pytest.approx(math.log(low / (power.sum() - low)), rel=1e-6)
                seen += 1
        if e in unit:
            bounds = [0, *[c for c in sorted(cuts.get(e, [])) if 0 < c < len(x)], len(x)]
            values = [spectral.arc_length(x[a:b], FPS, 10.0) for a, b in zip(bounds[:-1], bounds[1:]) if b - a >= 16]
            values = [v for v in values if math.isfinite(v)]
            assert (e in phase) == bool(values)
            if values:
                assert phase[e] == pytest.approx((np.median(values), np.percentile(values, 5)))
    assert seen


def test_full_ranking_is_the_ranking_with_more_metrics(spark, recording):
    scored = registry.score(recording, list(registry.FUNCTIONS))
    assert not scored.failures.count()
    found = {r.metric for r in scored.raw.select("metric").distinct().collect()}
    assert found >= {"idle_lead_s", "longest_pause_s", "jerk_rms", "psd_lf_hf", "track_lag_ms", "recovery_count", *quality.RANKED}
    weights = {x.name: (x.group, x.weight) for x in m.METRICS if x.group}
    best = {}
    for r in scored.worst.collect():
        if r.metric in weights and r.z is not None:
            group, weight = weights[r.metric]
            best.setdefault(r.episode_id, {}).setdefault(group, []).append(weight * r.z)
    for r in scored.ranking().collect():
        groups = {g: max(v) for g, v in best[r.episode_id].items()}
        assert r.score == pytest.approx(max(groups.values())) and groups[r.driver] == pytest.approx(r.score)
        assert r.n_flags == sum(v >= 2 for v in groups.values()) and r.verdict == ("fail" if r.score >= 3 else "warn" if r.score >= 2 else "pass")


def test_a_failing_metric_is_reported_and_the_others_go_on(recording, monkeypatch):
    def broken(_):
        raise ZeroDivisionError("no")

    monkeypatch.setitem(registry.FUNCTIONS, "ldlj", broken)
    raw, failures = registry.compute_raw(recording, ["length_z", "ldlj"])
    lost = failures.collect()
    assert len(lost) == recording.episodes.count() and {r.metric for r in lost} == {"ldlj"} and "ZeroDivisionError" in lost[0].error
    assert {r.metric for r in raw.select("metric").distinct().collect()} == {"length_z"}
    assert {r.failed for r in registry.finalize(recording, raw, failures).ranking().collect()} == {"ldlj"}


def test_one_broken_episode_loses_one_metric(recording, monkeypatch):
    """A measure that fails inside a task for one episode costs that episode that metric alone, and its verdict says so."""
    bad = recording.episodes.agg({"episode_id": "min"}).first()[0]
    arm = recording.picks.of("arm")[0]

    def measure(x):
        if not x[-1] >= 0:
            raise ValueError("a broken series")
        return (float(x.sum()),)

    broken = recording.windows(arm).withColumn("speed", F.when((F.col("episode_id") == bad) & (F.col("win") == 1), -1.0).otherwise(F.col("speed")))
    found = storage.stored(spectral.by_window(broken, measure, ["v"]))
    monkeypatch.setitem(registry.FUNCTIONS, "sparc", lambda r: [metrics.windowed(found, "sparc", arm.signal)])
    monkeypatch.setitem(registry.ERRORS, "sparc", lambda r: [found])
    scored = registry.score(recording, ["sparc", "ldlj", "length_z"])
    assert [(r.episode_id, r.metric, r.error) for r in scored.failures.collect()] == [(bad, "sparc", "ValueError: a broken series")]
    have = {}
    for r in scored.raw.collect():
        have.setdefault(r.episode_id, set()).add(r.metric)
    assert have.pop(bad) == {"ldlj", "length_z"} and all(v == {"sparc", "ldlj", "length_z"} for v in have.values())
    assert {r.episode_id: r.failed for r in scored.ranking().collect() if r.failed} == {bad: "sparc"}


def test_low_pass_failures_are_rows(spark):
    df = spark.createDataFrame([(1, i, float(i % 7)) for i in range(60)] + [(2, i, float(i % 5)) for i in range(60)], "episode_id long, i int, speed double")
    whole = {r.episode_id: r for r in spectral.filtered_whole(df, FPS).collect()}
    assert all(len(r.f) == 60 and r.error is None for r in whole.values())


def test_a_failing_job_ends_the_run(recording, monkeypatch):
    from pyspark.errors import PySparkException

    def lost(_):
        raise PySparkException("a table is gone")

    monkeypatch.setitem(registry.FUNCTIONS, "ldlj", lost)
    with pytest.raises(PySparkException):
        registry.compute_raw(recording, ["ldlj"])


def test_opt_in_metrics_run_only_when_named(recording):
    names = set(registry.default_metrics())
    assert names == {n for n in registry.FUNCTIONS if not m.BY_NAME[n].opt_in} and "jerk_rms" not in names and "sparc" in names
    assert {r.metric for r in registry.compute_raw(recording)[0].select("metric").distinct().collect()} <= names


def test_gates_on_sizes_and_values(spark):
    """Episodes whose arrays don't fit a metric have no value of it; all others keep theirs."""
    wave = lambda i, d: [math.sin(0.3 * i + k) for k in range(d)]
    rows = [(e, i, wave(i, 3), wave(i, 3 if e else 2)) for e in range(7) for i in range(60)] + [(7, i, wave(i, 1), wave(i, 1)) for i in range(60)] + [(8, i, wave(i, 3), wave(i, 3)) for i in range(2)]
    rows[65] = (1, 5, [float("nan"), 0.0, 0.0], [0.0] * 3)
    frames = spark.createDataFrame(rows, "episode_id long, idx int, action array<double>, state array<double>")
    who = spark.createDataFrame([(e, "s", "t", "r") for e in range(9)], "episode_id long, source_id string, task_key string, robot string")
    raw, failures = registry.compute_raw(registry.Recording(frames, who, FPS, quality.PICKS, min_group=5), ["path_length_z", "track_resid", "action_divergence", "joint_limit_frac"])
    have = {}
    for r in raw.collect():
        have.setdefault(r.metric, set()).add(r.episode_id)
    assert not failures.count() and "joint_limit_frac" not in have
    assert have["path_length_z"] == set(range(7)) and 0 not in have["track_resid"] and {2, 3, 4, 5, 6} <= have["track_resid"]
    assert have["action_divergence"] == {2, 3, 4, 5, 6, 8}


def test_declared_ranges_count_where_sizes_match(spark):
    rows = [(e, i, [float(i), 2.0 * i], [float(i)]) for e in (1, 2, 3) for i in range(11)]
    frames = spark.createDataFrame(rows, "episode_id long, idx int, action array<double>, state array<double>")
    said = spark.createDataFrame([(1, "action", [10.0, 0.0]), (2, "action", [5.0]), (1, "state", [2.0])], "episode_id long, vector string, ranges array<double>")
    got = {r.episode_id: (r.u_action, r.u_state) for r in signals.with_units(frames, declared=said).where("idx = 10").collect()}
    assert got[1] == ([1.0, 20.0], [5.0]) and got[2] == got[3] == ([10 / 9, 20 / 18], [10 / 9])


def test_divergence_has_peers_in_the_pooled_group(spark):
    """Episodes of many small tasks share the pooled group, and are each other's peers there."""
    rows = [(e, i, [math.sin(0.1 * i + e), 0.1 * e], [math.sin(0.1 * i), 0.0]) for e in range(12) for i in range(40)]
    frames = spark.createDataFrame(rows, "episode_id long, idx int, action array<double>, state array<double>")
    who = spark.createDataFrame([(e, "s", f"t{e}", "a" if e < 9 else "b") for e in range(12)], "episode_id long, source_id string, task_key string, robot string")
    r = registry.Recording(frames, who, FPS, Picks("action", "state"))
    raw, _ = registry.compute_raw(r, ["action_divergence"])
    assert {x.episode_id for x in raw.collect()} == set(range(9))  # three of the other robot are too few


def test_missing_picks_switch_metrics_off(spark, recording):
    bare = registry.Recording(recording.frames, recording.episodes, FPS, Picks("action", "state"))
    raw, failures = registry.compute_raw(bare)
    assert not failures.count() and {r.metric for r in raw.select("metric").distinct().collect()} == {"length_z", "action_divergence", "frame_gaps", "timestamp_dev", "nonfinite_values", "too_short", "schema_mismatch"}
    assert [need for _, need in Picks().readiness(True)][:4] == ["pick the action array", "pick the action array", "pick the state and action arrays", "pick gripper joints"]
    assert all(need is None for _, need in quality.PICKS.readiness())


def test_picks():
    groups = assemble(True, {"left_arm": [0, 1], "left_gripper": [1, 2], "right_gripper": [5]})
    assert groups == (Group("left", "arm", (0, 1)), Group("left", "gripper", (2,), "left"), Group("right", "gripper", (5,)))
    p = Picks("a", "s", True, True, groups)
    assert p.arm_of(groups[1]) == groups[0] and p.arm_of(groups[2]) == groups[0] and groups[1].signal == "gripper_left"
    assert p.for_source(5).groups == groups[:2] and p.for_source(None).groups == () and p.joint_space(3, 3) and not p.joint_space(3, 4)
    assert labels(["x", "y", "x"], "a") == ["x (a[0])", "y", "x (a[2])"]
    assert infer({"act.a": 2, "obs": 2, "obs.b": 2}, {"action": ("action", "^act"), "state": ("obs", "^obs"), "c": ("c", "c$")}) == ({"action": "act.a", "state": "obs", "c": None}, ["c: no feature fit"])
    kept, notes = picked({"a": 6}, p)
    assert kept.state is None and kept.action == "a" and notes == ["state: the source has no s"]


def test_picks_back_and_why_metrics_are_off():
    from trajlens.picks import dims_labelled, fields_of, labelled, why_off

    fields = {"left_arm": [0, 1], "left_gripper": [2], "left_hand": [], "right_arm": [], "right_gripper": [5], "right_hand": []}
    assert fields_of(True, assemble(True, fields)) == fields and fields_of(False, assemble(False, {"arm": [3, 1]})) == {"arm": [1, 3], "gripper": [], "hand": []}
    assert labelled((5, 0, 1), ["x", "y", "z"]) == ["x", "y"] and dims_labelled(["z", "x", "?"], ["x", "y", "z"]) == [0, 2]
    every = {x.name: x.family for x in m.METRICS}
    assert why_off(quality.PICKS, {n: f for n, f in every.items() if f != "camera"}) == {}
    off = why_off(Picks("a", "s", None, None, (Group("all", "arm", (0,)),)), every)
    assert off["track_resid"] == "it is not said whether actions are joint positions" and off["gripper_flips_per_s"] == "no gripper joints are picked" and off["blur"] == "no camera is picked"
    assert not {"sparc", "length_z", "idle_lead_s", "frame_gaps", "task_generic", "action_divergence"} & set(off)
    assert set(why_off(Picks(), every)) == {n for n, f in every.items() if f not in ("integrity", "language", "outliers") and n != "length_z"}
    assert Picks(joint_positions=False, cameras=("front",)).assumptions() == {"joint_positions": False, "cameras": ["front"]}


def test_corruptions_are_caught(spark):
    r = still(spark, rests=False)
    names = ["idle_lead_s", "idle_trail_s", "longest_pause_s", "length_z", "ldlj", "sparc", "track_lag_ms"]
    clean = scoring.value_rows(registry.compute_raw(r, names)[0]).collect()
    clean = spark.createDataFrame(clean)
    for name, change in (("identity", harness.identity), ("idle_start", lambda f: harness.idle_start(f, 60)), ("idle_end", lambda f: harness.idle_end(f, 60)), ("mid_pause", lambda f: harness.mid_pause(f, 60)), ("abandoned", harness.abandoned), ("jitter", lambda f: harness.jitter(f, 0.05))):
        wanted = names if name == "identity" else list(harness.EXPECTED[name])
        raw = scoring.value_rows(registry.compute_raw(registry.Recording(change(r.frames), r.episodes, FPS, r.picks), wanted)[0])
        got = harness.judged(harness.compare(clean.where(F.col("metric").isin(wanted)), raw, harness.EXPECTED.get(name)), name).collect()
        assert got and all(x.status == "pass" for x in got), (name, got)


def test_polarity_of_comparisons(spark):
    values = lambda v: spark.createDataFrame([(1, "sparc", v), (1, "idle_frac", v), (1, "length_z", v), (1, "frame_gaps", v), (1, "action_divergence", v)], "episode_id long, metric string, value double")
    got = {r.metric: r.worse for r in harness.compare(values(1.0), values(2.0), {"length_z": -1}).collect()}
    assert got == {"sparc": 0, "idle_frac": 1, "length_z": 0, "frame_gaps": 1}
    got = {r.metric: r.worse for r in harness.compare(values(1.0), values(0.5), {"length_z": -1}).collect()}
    assert got == {"sparc": 1, "idle_frac": 0, "length_z": 1, "frame_gaps": 0}


def test_detail_thins_what_the_signals_hold(recording):
    speed = _collected(recording.arm_speed(), "speed")
    for r in spans.detail(recording, 50).collect():
        n = len(speed[r.episode_id]) + 1
        assert r.length == n and r.stride == max(1, math.ceil(n / 50)) and len(r.action) == len(range(0, n, r.stride)) == len(r.state)
        f = np.abs(_plain_lowpass(speed[r.episode_id], 10.0, FPS))
        assert np.allclose(r.speed, f[:: r.stride], atol=1e-4) and all(e.kind in ("open", "close") for e in r.gripper_right)


def test_outliers_of_the_feature_matrix(spark):
    rows = [(e, "g", "", 0.0, "x", float(e % 3) * 0.1 + (9.0 if e == 11 else 0.0)) for e in range(12)]
    worst = spark.createDataFrame([(e, "g", n, s, z + 0.01 * k, v) for e, _, s, v, _, z in rows for k, n in enumerate(("sparc", "ldlj", "length_z")) if (e, n) != (3, "ldlj")], "episode_id long, group_label string, metric string, signal string, z double, value double")
    x = scoring.feature_matrix(worst)
    filled = {r.episode_id: r.x for r in x.collect()}
    assert len(filled) == 12 and all(v is not None for v in filled[3])
    groups = worst.select("episode_id", "group_label").distinct()
    got = {r.episode_id: r for r in scoring.outliers(batch.novelty(x), batch.isolation_scores(x), groups).collect()}
    assert got[11].is_outlier == 1.0 and got[11].novelty_knn == max(r.novelty_knn for r in got.values()) and sum(r.is_outlier for r in got.values()) < 6


def test_integrity_verdicts(spark):
    frames = spark.createDataFrame([(1, i, i, [float(i)], [float("nan") if i == 3 else 0.0]) for i in range(40)] + [(2, i, i, [1.0], [1.0]) for i in range(40)], "episode_id long, idx int, frame_index long, action array<double>, state array<double>")
    expected = spark.createDataFrame([(1, 40), (2, 42), (3, 5)], "episode_id long, expected long")
    schema = spark.createDataFrame([(1, 0), (2, 1)], "episode_id long, mismatch long")
    got = {r.episode_id: r for r in metrics.integrity(frames, FPS, expected, None, schema).collect()}
    assert (got[1].nonfinite_values, got[1].verdict, got[1].failing) == (1, "fail", "nonfinite_values")
    assert (got[2].length_mismatch, got[2].verdict, got[2].failing) == (2, "fail", "length_mismatch,schema_mismatch") and got[3].verdict == "unknown"
    got = {r.episode_id: r for r in metrics.integrity(frames.where("episode_id = 2"), FPS, None, None, schema).collect()}
    assert got[2].verdict == "warn" and got[2].length_mismatch is None


def test_frozen_feeds_and_lags(spark):
    n = 300
    rng = np.random.default_rng(1)
    move = np.abs(np.convolve(rng.normal(size=n + 8), np.ones(9) / 3, "valid")) + 0.3
    images, speeds = [], [(0, i, float(move[i])) for i in range(n)]
    shown = np.cumsum(np.roll(move, 6)) * 3  # six frames late
    for i in range(n):
        images.append((0, "live", i / FPS, [int(shown[i]) % 250, int(shown[i] * 0.5) % 250]))
        images.append((0, "dead", i / FPS, [7, 7]))
    changes = camera.frame_changes(spark.createDataFrame(images, "episode_id long, camera string, t double, px array<int>"))
    smooth = spark.createDataFrame([(0, "live", i / FPS, float(np.roll(move, 6)[i])) for i in range(n)], "episode_id long, camera string, t double, v double")
    speed = spark.createDataFrame(speeds, "episode_id long, i int, speed double")
    windows = spark.createDataFrame([(0, c, 0.0, n / FPS) for c in ("live", "dead")], "episode_id long, camera string, from_s double, to_s double")
    frozen = {r.camera: r.value for r in camera.frozen_frac(changes, speed.withColumnRenamed("speed", "f"), windows, FPS).collect()}
    assert frozen == {"live": 0.0, "dead": 1.0}
    got = camera.action_lag_ms(smooth, speed, FPS).collect()
    assert len(got) == 1 and got[0].value == pytest.approx(1000 * 5 / FPS, abs=20)  # a step's speed belongs to its end
    steps = [(r.r, round(r.frame_t * FPS)) for r in video.dense_steps(spark.createDataFrame([(0, 1.0, 2.0)], "window_id long, from_s double, to_s double"), spark.createDataFrame([(0, i / FPS) for i in range(90)], "window_id long, frame_t double"), 10, 2).collect()]
    assert steps == [(0, 30), (1, 40)]


def test_windows_without_frames_have_none(spark):
    times = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.5)], "window_id long, k int, t double")
    have = spark.createDataFrame([(1, 0.4), (1, 0.6)], "window_id long, frame_t double")
    assert [(r.window_id, r.frame_t) for r in video.frames_at(times, have).collect()] == [(1, 0.6)]


def test_runs_tags_and_partial_episodes(spark, tmp_path):
    stats = spark.createDataFrame([("g", "sparc", "", 1.0)], "group_label string, metric string, signal string, median double")
    for run in ("r1", "r2"):
        sinks.write_run(str(tmp_path / "run"), stats, {"min_group": 20}, ["q_sparc"], run)
    run, config, fields, back = sinks.read_run(spark, str(tmp_path / "run"))
    assert (run, config, fields, back.count()) == ("r2", {"config_version": m.CONFIG_VERSION, "min_group": 20}, ["q_sparc"], 1)
    assert sinks.mixed_runs(spark.createDataFrame([("a",), ("b",)], "run_id string")).first().mixed
    e = spark.createDataFrame([(1, ["b"]), (2, None)], "episode_id long, tags array<string>")
    assert sorted((r.episode_id, r.tags) for r in sinks.tag_selection(e, e.where("episode_id = 1"), "a").collect()) == [(1, ["a", "b"]), (2, None)]
    refs = spark.createDataFrame([(0, 2), (1, 3), (2, None)], "episode_index long, expected long")
    frames = spark.createDataFrame([(e, i, i / 30, i, [0.0], [0.0]) for e in (0, 1, 2) for i in range(2)], "episode_index long, frame_index long, timestamp double, row_index long, action array<double>, state array<double>")
    built = layout.build_episodes(refs, frames)
    assert {r.episode_index: r.error for r in built.collect()} == {0: None, 1: "2 of 3 rows found", 2: None}
    assert layout.read_episode(refs, frames, 0).length == 2 and layout.failures(built).count() == 1
    with pytest.raises(LookupError):
        layout.read_episode(refs, frames, 1)


def test_streams_measure_whole_episodes(spark, tmp_path):
    """Sessions are emitted once and whole."""
    from trajlens import streaming

    rows = [(f"2024-01-01 00:{i:02d}:00", e, float(i)) for i in range(40) for e in (1, 2)]
    df = spark.createDataFrame(rows, "ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.episode_id, r.frames) for r in streaming.episode_lengths(df).collect()) == [(1, 40), (2, 40)]


def test_streams_keep_state_instead_of_history(spark, tmp_path):
    """Events in many micro-batches give the batch metrics of whole episodes, and each event is read once."""
    from trajlens import streaming

    source = str(tmp_path / "source")
    events = episodes.table(spark, SF, "events")
    ordered = events.withColumn("k", F.ntile(5).over(Window.orderBy("ts", "event_id")))
    for k in range(1, 6):
        ordered.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = streaming.score_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), FPS)
    query.awaitTermination()
    reads = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert len(reads) == 5 and sum(reads) == events.count()
    got = {r.episode_id: r for r in streaming.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    raw = {}
    for r in quality.event_raw(spark, SF).collect():
        raw.setdefault(r.episode_id, {})[r.metric] = (r.value, r.worst)
    assert got.keys() == raw.keys()
    ends = {r.user_id: (r.lo, r.hi) for r in events.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    for e, x in raw.items():
        assert got[e].length_s == pytest.approx(x["length_z"][0]) and (got[e].lo, got[e].hi) == ends[e] and got[e].late == 0
        assert (got[e].ldlj is None) == ("ldlj" not in x)
        if "ldlj" in x:  # it doesn't depend on the range
            assert (got[e].ldlj, got[e].ldlj_worst) == pytest.approx(x["ldlj"])


def test_stream_state_by_itself():
    from trajlens.streaming import EpisodeState, window_jerk

    rng = np.random.default_rng(9)
    x = np.cumsum(rng.normal(size=400))
    state = None
    for part in np.split(x, [1, 2, 50, 131, 300]):
        own = EpisodeState(state)
        own.add(part, FPS, 90)
        state = own.stored()
        assert len(own.tail) < 90
    speed = np.abs(np.diff(x)) * FPS
    assert state[9] == pytest.approx([window_jerk(speed[k : k + 90], FPS) for k in range(0, 399 - 89, 45)]) and state[6] == pytest.approx(speed.sum() / FPS)


def test_selection_and_panel_rows(spark):
    e = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "a")], "episode_id long, task_key string")
    ids = lambda df: [r.episode_id for r in df.collect()]
    assert sorted(ids(episodes.of_task(e, "a"))) == [1, 4] and sorted(ids(episodes.of_task(e, ""))) == [2, 3] and len(ids(episodes.of_task(e, None))) == 4
    assert ids(episodes.selected(e, [4, 9, 1, 4])) == [4, 1]
    worst = spark.createDataFrame([(1, "g", "sparc", "arm", 2.5, 0.5)], "episode_id long, group_label string, metric string, signal string, z double, value double")
    z = spark.createDataFrame([(1, "sparc", "arm", 0.5, 2.5), (1, "sparc", "hand", 0.25, 1.0)], "episode_id long, metric string, signal string, value double, z double")
    assert registry.metric_rows(worst, z).first().breakdown == "arm=500,hand=250"
    groups = spark.createDataFrame([(1, "g", "task"), (2, "g", "task")], "episode_id long, group_label string, basis string")
    rows = {r.episode_id: r for r in registry.panel(registry.Scored(z, groups, z, z, worst, scoring.profile_scores(worst), spark.createDataFrame([(2, 'ldlj', 'x')], registry.FAILED))).collect()}
    assert rows[1]["values"] == {"sparc": 0.5} and rows[1].z == {"sparc": 2.5} and rows[1].verdict == "warn" and rows[2].verdict == "unknown" and rows[2].failed == "ldlj"


def test_a_recordings_tables_are_not_mixed_up(recording):
    """Metrics asked for in other orders come from the same stored rows."""
    one = registry.compute_raw(recording, ["ldlj", "length_z"])[0].collect()
    two = registry.compute_raw(recording, ["length_z", "ldlj"])[0].collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))
