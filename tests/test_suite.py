"""The validation suite over recordings that have everything: frames, pictures, windows, promises and task texts."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlens import model as m
from trajlens import storage
from trajlens.operators import harness, registry, suite
from trajlens.picks import Group, Picks

FPS, SIDE = 30.0, 6
PICKS = Picks("action", "state", True, True, (Group("right", "arm", (0, 1)), Group("right", "gripper", (2,), "right")), ("front",))


@pytest.fixture(scope="module")
def whole(spark):
    rows, images, rng = [], [], np.random.default_rng(1)
    pattern = rng.uniform(0, 6, SIDE * SIDE)
    for e in range(6):
        n = 330 + 15 * e
        t = np.arange(n) / FPS
        x = np.sin(t * (1.1 + 0.1 * e)) + 0.5 * np.sin(2.3 * t + e)
        y = np.cos(t * (0.9 + 0.1 * e))
        ease = np.minimum(1.0, (n - 1 - np.arange(n)) / 60.0)
        x, y = x * ease, y * ease
        g = np.where((np.arange(n) // 110) % 2 == 0, 1.0, 0.0)
        a = np.stack([x, y, g], axis=1)
        s = a[np.maximum(0, np.arange(n) - 2)]
        rows += [(e, i, a[i].tolist(), s[i].tolist()) for i in range(n)]
        angle = np.cumsum(np.concatenate([[0.0], np.hypot(np.diff(x), np.diff(y))])) * 3
        for i in range(n):
            px = 128 + 90 * np.sin(pattern + angle[i])
            images.append((e, "front", i / FPS, [int(v) for v in px]))
    frames = spark.createDataFrame(rows, "episode_id long, idx int, action array<double>, state array<double>")
    n = frames.groupBy("episode_id").agg(F.count(F.lit(1)).alias("expected"))
    return registry.Recording(
        storage.stored(frames), spark.createDataFrame([(e, "s", "t", "Pick up the red block") for e in range(6)], "episode_id long, source_id string, task_key string, text string"), FPS, PICKS,
        bounds=spark.createDataFrame([(0, -1.6, 1.6), (1, -1.1, 1.1)], "dim int, lo double, hi double"), images=storage.stored(spark.createDataFrame(images, "episode_id long, camera string, t double, px array<int>")), side=SIDE,
        windows_of=storage.stored(n.select("episode_id", F.lit("front").alias("camera"), F.lit(5.0).alias("from_s"), (5 + F.col("expected") / FPS).alias("to_s"))), refs=storage.stored(n), min_group=3,
        ranges=spark.createDataFrame([(e, v, [2.4, 1.9, 1.0]) for e in range(6) for v in ("action", "state")], "episode_id long, vector string, ranges array<double>"),
    )


def test_all_corruptions_are_caught(whole, spark, tmp_path):
    got = storage.stored(suite.run(whole))
    rows = got.collect()
    assert [r.corruption for r in sorted(rows, key=lambda r: r.place)] == ["identity", *[c for c in harness.EXPECTED for _ in harness.EXPECTED[c]]]
    by = {(r.corruption, r.metric): r for r in rows}
    assert len({r.corruption for r in rows}) == 26
    assert {k: (r.pairs, r.pass_rate) for k, r in by.items() if r.status != "pass"} == {}
    assert by["identity", suite.CONTROL].pass_rate == 0 and by["at_limits", "joint_limit_frac"].pairs == 6


def test_what_a_recording_lacks_is_not_applicable(whole, spark, tmp_path):
    from dataclasses import replace

    bare = replace(whole, images=None, windows_of=None, bounds=None, episodes=whole.episodes.drop("text"), picks=Picks("action", "state", True, True, (Group("right", "arm", (0, 1)),)), _made={})
    got = storage.stored(suite.run(bare, ["idle_lead_s", "joint_limit_frac", "gripper_flips_per_s", "length_mismatch", "blur"]))
    by = {(r.corruption, r.metric): (r.status, r.pairs) for r in got.collect()}
    assert by["idle_start", "idle_lead_s"] == ("pass", 6) and by["at_limits", "joint_limit_frac"] == ("no data", 0) and by["length_mismatch", "length_mismatch"] == ("pass", 6)
    assert {by[c, k][0] for c, k in (("gripper_chatter", "gripper_flips_per_s"), ("blurry_camera", "blur"), ("generic_task", "task_generic"), ("video_off", "video_window_mismatch"))} == {"not applicable"}
    alarms = suite.false_alarms(registry.score(bare, ["too_short", "frame_gaps", "length_z"]))
    length = spark.createDataFrame([("sparc", 6, None, None, "too few episodes")], "metric string, n int, rho_kept double, rho_length double, status string")
    text = suite.report(got, alarms, length, str(tmp_path))
    assert "| idle_start | idle_lead_s | 6 | 100% | pass |" in text and "| too_short | 0% |" in text and "| sparc | 6 | n/a | n/a | too few episodes |" in text
    said = json.loads(spark.read.text(f"{tmp_path}/report.json").first()[0])
    assert len(said["corruptions"]) == 27 and spark.read.text(f"{tmp_path}/REPORT.md").count() > 30


def test_length_control_of_z_scores(spark):
    """Cut at max(3 s, the 10th percentile), scored anew, and correlated by ranks with before and with the duration."""
    rng = np.random.default_rng(2)
    rows = [(e, i, [float(v), float(v * 0.3), 1.0], [float(v), float(v * 0.3), 1.0]) for e in range(14) for i, v in enumerate(np.cumsum(rng.normal(size=80 + 12 * e)) * (1 + e % 3))]
    frames = spark.createDataFrame(rows, "episode_id long, idx int, action array<double>, state array<double>")
    r = registry.Recording(frames, spark.createDataFrame([(e, "s", "t") for e in range(14)], "episode_id long, source_id string, task_key string"), FPS, PICKS, min_group=3)
    names = ["sparc", "ldlj", "end_motion_ratio", "length_z", "blur"]
    scored = registry.score(r, names)
    got = {x.metric: x for x in suite.length_control(r, scored, names).collect()}
    n = {e: 80 + 12 * e for e in range(14)}
    common = max(3.0, float(np.percentile([v / FPS for v in n.values()], 10)))
    kept = [e for e in n if n[e] > int(common * FPS)]
    again = registry.score(registry.Recording(frames.where(F.col("idx") < int(common * FPS)).where(F.col("episode_id").isin(kept)), r.episodes.where(F.col("episode_id").isin(kept)), FPS, PICKS, min_group=3), names[:3])
    z = lambda s: {(x.episode_id, x.metric): x.z for x in s.worst.collect()}
    before, after = z(scored), z(again)
    rank = lambda v: np.array([(np.array(v) < x).sum() + ((np.array(v) == x).sum() + 1) / 2 for x in v])
    for k in names[:3]:
        own = [e for e in kept if (e, k) in before and (e, k) in after]
        assert got[k].n == len(own) >= 8
        assert got[k].rho_kept == pytest.approx(np.corrcoef(rank([before[e, k] for e in own]), rank([after[e, k] for e in own]))[0, 1])
        assert got[k].rho_length == pytest.approx(np.corrcoef(rank([before[e, k] for e in own]), rank([n[e] for e in own]))[0, 1])
        assert got[k].status == ("not judged: measures the end, which truncation removes" if k == "end_motion_ratio" else "length-confounded" if got[k].rho_kept < 0.5 else "ok")
    assert "length_z" not in got and got["blur"].status == "not judged: the video is not truncated" and got["blur"].rho_kept is None


def test_one_run_gives_all_verdicts(whole):
    """Every metric of the registry but the outlier scores comes out of one recording, and one row an episode reviews them."""
    scored = registry.score(whole, list(registry.FUNCTIONS))
    assert {x.name for x in m.METRICS} - set(registry.FUNCTIONS) == {"iforest_score", "novelty_knn", "is_outlier"}
    found = {r.metric for r in scored.raw.select("metric").distinct().collect()}
    assert found >= {"blur", "exposure_err", "clipped_frac", "frozen_frac", "video_action_lag_ms", "frame_gaps", "video_window_mismatch", "schema_mismatch", "task_generic"} and not scored.failures.count()
    rows = registry.reviews(whole, scored).collect()
    assert len(rows) == 6 and {(r.integrity, r.language, r.failing) for r in rows} == {("pass", "pass", "")} and all(math.isfinite(r.score) for r in rows)


def test_rows_as_they_are_written_back(whole, spark):
    from trajlens.operators import scoring

    names = ["sparc", "length_z", "recovery_count"]
    scored = registry.score(whole, names)
    rows = registry.result_rows(whole, scored, {"policy": scoring.profile_table(spark), "time": scoring.profile_table(spark, ["time"])}, names)
    first = rows.orderBy("episode_id").first()
    assert (first.group_n, first.config_version, first.integrity_verdict, first.language_verdict, first.failed) == (6, m.CONFIG_VERSION, "pass", "pass", "") and first.driver_time == "time" and first.q_sparc_on_arm_right == first.q_sparc
    fields = dict(registry.field_catalogue(rows))
    assert fields["score_policy"] == "float" and fields["nflags_time"] == "int" and fields["driver_policy"] == "str" and "episode_id" not in fields
    tags = spark.createDataFrame([(1, ["mine"], 2.0), (2, ["mine", "recovery"], 0.0), (3, ["recovery"], None), (4, None, 1.0)], "episode_id long, tags array<string>, q_recovery_count double")
    got = {r.episode_id: r.tags for r in registry.with_recovery_tags(tags).collect()}
    assert got == {1: ["mine", "recovery"], 2: ["mine"], 3: ["recovery"], 4: ["recovery"]}
