"""Fixed values of the engine: thresholds, metric registry, groups and profiles."""

from __future__ import annotations

from dataclasses import dataclass

CONFIG_VERSION = 1  # of the thresholds, the registry and the scoring that a run was made with
#: Fixed values.
WARN_Z, FAIL_Z, Z_CLIP, MAD_TO_STD, MIN_SCALE = 2.0, 3.0, 10.0, 1.4826, 1e-12
SIGNED_FLOOR, SIGNED_MIN = 0.05, 1e-9
MIN_GROUP, POOLED = 20, "__pooled__"
WINDOW_S, MIN_WINDOW, WORST_PERCENTILE = 3.0, 16, 0.05
IDLE_ALPHA, IDLE_REFERENCE, MIN_SPEED_SAMPLES = 0.05, 0.90, 8
GRIPPER_LOW, GRIPPER_HIGH = 0.4, 0.6
MAX_LAG_S, MIN_LAG_CORR, SPIKE_K, SPIKE_FLOOR = 1.0, 0.3, 8.0, 20.0
LIMIT_MARGIN, MIN_ACTIVE_SHARE = 0.02, 0.05
RECOVERY_REOPEN_S, RECOVERY_WINDOW_S, RECOVERY_DISTANCE, HOLD_S, HELD_GAP = 3.0, 6.0, 0.15, 0.5, 0.1
MIN_PEERS, NEIGHBORS, LEVERAGE_MARGIN, AUX_FRAMES = 5, 5, 0.05, 32
MIN_FRAMES, MIN_SECONDS, VIDEO_TOLERANCE, MIXED_SHARE = 10, 1.0, 2.0, 0.5
UNDER_COVERED, DOMINANT_SHARE, MIN_OUTLIER_GROUP = 5, 0.5, 8


@dataclass(frozen=True)
class MetricSpec:
    """One metric: its family, how it is normalised and which way is bad."""

    name: str
    family: str
    kind: str = "value"  # value, signed_z or flag
    higher_is_worse: bool = True
    group: str | None = None
    weight: float = 1.0
    check: str | None = None  # verdict of a flag above `above`
    above: float = 0.0
    opt_in: bool = False
    batch: bool = False


#: The metrics, their groups and weights.
METRICS = [
    MetricSpec("sparc", "motion", higher_is_worse=False, group="motion"),
    MetricSpec("ldlj", "motion", higher_is_worse=False, group="motion", weight=0.5),
    MetricSpec("sparc_phase", "motion", higher_is_worse=False, group="motion", opt_in=True),
    MetricSpec("jerk_rms", "motion", opt_in=True),
    MetricSpec("psd_lf_hf", "motion", higher_is_worse=False, opt_in=True),
    MetricSpec("idle_lead_s", "time", group="time"),
    MetricSpec("idle_trail_s", "time", group="time", weight=0.5),
    MetricSpec("longest_pause_s", "time", group="time"),
    MetricSpec("end_motion_ratio", "time", group="time", weight=0.5),
    MetricSpec("idle_frac", "time"),
    MetricSpec("length_z", "time", kind="signed_z", group="time"),
    MetricSpec("path_length_z", "time", kind="signed_z", opt_in=True),
    MetricSpec("track_lag_ms", "tracking", kind="signed_z"),
    MetricSpec("track_resid", "tracking", group="tracking"),
    MetricSpec("accel_spike_frac", "tracking", group="tracking"),
    MetricSpec("joint_limit_frac", "tracking", group="tracking", opt_in=True),
    MetricSpec("gripper_flips_per_s", "gripper", group="gripper"),
    MetricSpec("missed_grasp_frac", "gripper", group="gripper", opt_in=True),
    MetricSpec("recovery_count", "gripper", kind="flag"),
    MetricSpec("action_divergence", "consistency", group="consistency", batch=True),
    MetricSpec("stats_leverage", "consistency", kind="flag", batch=True),
    MetricSpec("blur", "camera", higher_is_worse=False, group="camera", opt_in=True),
    MetricSpec("exposure_err", "camera", group="camera", opt_in=True),
    MetricSpec("clipped_frac", "camera", group="camera", opt_in=True),
    MetricSpec("frozen_frac", "camera", group="camera", opt_in=True),
    MetricSpec("video_action_lag_ms", "camera", group="camera", opt_in=True),
    MetricSpec("frame_gaps", "integrity", kind="flag", check="fail"),
    MetricSpec("timestamp_dev", "integrity", kind="flag"),
    MetricSpec("length_mismatch", "integrity", kind="flag", check="fail"),
    MetricSpec("video_window_mismatch", "integrity", kind="flag", check="fail", above=2.0),
    MetricSpec("nonfinite_values", "integrity", kind="flag", check="fail"),
    MetricSpec("too_short", "integrity", kind="flag", check="fail"),
    MetricSpec("schema_mismatch", "integrity", kind="flag", check="warn", batch=True),
    MetricSpec("iforest_score", "outliers", kind="flag"),
    MetricSpec("novelty_knn", "outliers", kind="flag"),
    MetricSpec("is_outlier", "outliers", kind="flag"),
    MetricSpec("task_missing", "language", kind="flag"),
    MetricSpec("task_generic", "language", kind="flag"),
]
BY_NAME = {m.name: m for m in METRICS}
GROUPS = list(dict.fromkeys(m.group for m in METRICS if m.group))
