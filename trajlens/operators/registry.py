"""From recordings to scores: one function a metric, all run into one long table, and the batch finished over it.

Frames, with each dimension over its range, and every derived signal that several metrics use are stored once. A metric whose
picks are missing gives no rows. A failure is a row (episode_id, metric, error): what fails for one episode inside a task costs that
episode that metric, and a metric that can't be planned costs every episode that metric; all else goes on, and the ranking
names what each episode lacks. A job that fails (a lost table, a broken cluster) is not a metric's failure: it ends the run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import RLock

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as m
from ..functions import language, spectral
from ..picks import Group, Picks
from ..sources import sinks
from ..storage import stored
from . import batch, camera, metrics, scoring, signals, video

BY = metrics.BY
RAW = "episode_id long, metric string, signal string, value double, worst double"
SIDE_BY_SIDE = 4  # metrics that are planned and run at once
FAILED = "episode_id long, metric string, error string"


@dataclass
class Recording:
    """frames(episode_id, idx, action, state), episodes(episode_id, source_id, task_key) and what the picks say of them."""

    frames: DataFrame
    episodes: DataFrame
    fps: float
    picks: Picks
    bounds: DataFrame | None = None  # dim, lo, hi of the state, as the source declares them
    ranges: DataFrame | None = None  # episode_id, vector, ranges: an array's ranges, as the episode's source declares them
    images: DataFrame | None = None  # episode_id, camera, t (seconds in the episode), px: gray values of side * side pixels
    side: int = 0
    windows_of: DataFrame | None = None  # episode_id, camera, from_s, to_s: where the episode lies in each camera's video
    refs: DataFrame | None = None  # episode_id, expected: how many frames the dataset promises
    min_group: int = m.MIN_GROUP
    _made: dict = field(default_factory=dict)
    _locks: dict = field(default_factory=lambda: defaultdict(RLock), init=False, repr=False)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        with self._locks[""]:
            lock = self._locks[name]
        with lock:  # metrics that run side by side share what one of them makes
            if name not in self._made:
                self._made[name] = stored(make())
            return self._made[name]

    @property
    def own(self) -> DataFrame:
        """The frames with u_action and u_state, stored."""
        return self.once("own", lambda: signals.with_units(self.frames, declared=self.ranges))

    @property
    def joint(self) -> DataFrame:
        """The frames whose action is as large as their state: those that tell joint positions."""
        return self.own.where(F.size("action") == F.size("state"))

    @property
    def groups(self) -> DataFrame:
        """episode_id, group_label, basis: the normalisation group, which is also where an episode has its peers."""
        return self.once("groups", lambda: scoring.assign_groups(self.episodes, self.min_group))

    def speed(self, group: Group) -> DataFrame:
        return self.once(f"speed {group.signal}", lambda: signals.group_speed(self.own, list(group.dims), self.fps))

    def windows(self, group: Group) -> DataFrame:
        return signals.windows(self.speed(group), self.fps, m.WINDOW_S, m.MIN_WINDOW)

    def pieces(self, group: Group) -> DataFrame:
        """The group's speeds in rows that whole windows are cut from."""
        return self.once(f"pieces {group.signal}", lambda: spectral.pieces(self.speed(group), self.fps))

    def arm_speed(self) -> DataFrame | None:
        dims = self.picks.arm_dims()
        return self.once("arm speed", lambda: signals.group_speed(self.own, dims, self.fps)) if dims else None

    def _filtered(self) -> DataFrame | None:
        with self._locks["_filtered"]:
            return self._filtered_once()

    def _filtered_once(self) -> DataFrame | None:
        speed = self.arm_speed()
        if speed is None or "filtered" in self._made:
            return self._made.get("filtered")
        n = stored(speed.groupBy(BY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > spectral.LONG))
        if n.take(1):
            self.once("filtered chunks", lambda: spectral.filtered_chunks(speed.join(n, BY), self.fps))
            speed = speed.join(n, BY, "left_anti")
        return self.once("filtered", lambda: spectral.filtered_whole(speed, self.fps))

    def filtered(self) -> DataFrame | None:
        """The arm's low-passed speed; what is too long for one row is filtered in chunks."""
        whole = self._filtered()
        if whole is None:
            return None
        more = [self._made["filtered chunks"]] if "filtered chunks" in self._made else []
        out = whole.select(BY, F.posexplode("f").alias("i", "f"))
        return out.unionByName(more[0]) if more else out

    def unit(self, gripper: Group) -> DataFrame:
        return self.once(f"unit {gripper.signal}", lambda: signals.gripper_unit(self.own, list(gripper.dims)))

    def recoveries(self) -> DataFrame | None:
        """Regrasps of all grippers that have an arm; None where the open direction or the picks are missing."""
        pairs = [(g, self.picks.arm_of(g)) for g in self.picks.of("gripper")]
        pairs = [(g, a) for g, a in pairs if a is not None]
        if not pairs or self.picks.open_high is None:
            return None

        def make() -> DataFrame:
            parts = [metrics.recoveries(self.own, self.unit(g), list(a.dims), self.fps, self.picks.open_high) for g, a in pairs]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out

        return self.once("recoveries", make)

    def lags(self) -> DataFrame | None:
        dims = self.picks.arm_dims()
        parts = [list(g.dims) for g in self.picks.of("arm")]
        return self.once("lags", lambda: metrics.tracked(self.joint, dims, self.fps, parts)) if dims and self.picks.joint_positions else None

    def spikes(self) -> DataFrame | None:
        dims = self.picks.arm_dims()
        return self.once("spikes", lambda: metrics.frame_spikes(self.joint, dims, self.fps)) if dims and self.picks.joint_positions else None

    def arcs(self, group: Group) -> DataFrame:
        return self.once(f"arcs {group.signal}", lambda: spectral.window_arc_length(self.pieces(group), self.fps))

    def spectra(self, group: Group) -> DataFrame:
        return self.once(f"spectra {group.signal}", lambda: spectral.spectral_metrics(self.pieces(group), self.fps))

    def times(self) -> DataFrame | None:
        filtered = self.filtered()
        return self.once("times", lambda: metrics.time_metrics(filtered, self.fps, self.recoveries())) if filtered is not None else None

    def stills(self) -> DataFrame | None:
        """episode_id, camera and the still-frame measures of each."""
        if self.images is None or not self.side:
            return None
        key = F.concat_ws("|", BY, "camera")

        def make() -> DataFrame:
            stats = camera.still_stats(self.images.select(key.alias("camera"), F.col("t").alias("frame"), "px"), self.side)
            return camera.camera_metrics(stats).select(F.substring_index("camera", "|", 1).cast("long").alias(BY), F.regexp_replace("camera", r"^[^|]*\|", "").alias("signal"), *[c for c in CAMERA.values()], *[f"{w}" for w in CAMERA_WORST.values()])

        return self.once("stills", make)

    def changes(self) -> DataFrame | None:
        return self.once("changes", lambda: camera.frame_changes(self.images)) if self.images is not None else None

    def state_filtered(self) -> DataFrame | None:
        """The low-passed speed of the arm's state."""
        dims = self.picks.arm_dims()
        own = self.joint.select(BY, "idx", F.col("state").alias("action"), F.col("u_state").alias("u_action"))
        return self.once("state filtered", lambda: spectral.filtered_speed(signals.group_speed(own, dims, self.fps), self.fps)) if dims else None

    def integrity(self) -> DataFrame:
        """One row an episode: the integrity metrics, their verdict and the failing checks."""

        def make() -> DataFrame:
            frames = self.frames if "frame_index" in self.frames.columns else self.frames.withColumn("frame_index", F.col("idx").cast("long"))
            sizes = self.frames.groupBy(BY).agg(F.count(F.lit(1)).alias("length"), F.max(F.size("action")).alias("a"), F.max(F.size("state")).alias("s"))
            gaps, cameras = None, None
            if self.windows_of is not None:
                maps = self.windows_of.groupBy(BY).agg(F.map_from_entries(F.collect_list(F.struct("camera", F.struct("from_s", "to_s")))).alias("windows"))  # one entry a camera
                gaps = video.window_mismatch(sizes.join(maps, BY), self.fps)
                cameras = self.windows_of.groupBy(BY).agg(F.array_join(F.sort_array(F.collect_set("camera")), ",").alias("cameras"))
            sizes = sizes.join(cameras, BY, "left") if cameras is not None else sizes.withColumn("cameras", F.lit(None).cast("string"))
            schema = batch.majority_schema(sizes.select(BY, F.concat_ws("/", "a", "s", F.coalesce("cameras", F.lit("-"))).alias("sig")))
            return metrics.integrity(frames, self.fps, self.refs, gaps, schema)

        return self.once("integrity", make)

    def aux(self) -> DataFrame:
        return self.once("aux", lambda: batch.aux_sample(self.own))


#: Camera metrics and the columns of their values and worst values.
CAMERA = {"blur": "blur", "exposure_err": "exposure_err", "clipped_frac": "clipped_frac"}
CAMERA_WORST = {"blur": "blur_worst", "exposure_err": "exposure_worst", "clipped_frac": "clipped_worst"}


def _by_camera(rows: DataFrame | None, metric: str, value: str = "value", worst: str | None = None) -> list[DataFrame]:
    """rows(episode_id, signal or camera, value[, worst]) as a metric with a signal a camera."""
    if rows is None:
        return []
    signal = F.col("signal" if "signal" in rows.columns else "camera")
    last = F.col(worst) if worst else F.lit(None)
    return [rows.select(BY, F.lit(metric).alias("metric"), signal.alias("signal"), F.col(value).cast("double").alias("value"), last.cast("double").alias("worst")).where("value is not null")]


def _still(name: str) -> Callable[[Recording], list[DataFrame]]:
    return lambda r: _by_camera(r.stills(), name, CAMERA[name], CAMERA_WORST[name])


def _frozen(r: Recording) -> list[DataFrame]:
    if r.changes() is None or r.windows_of is None or r.state_filtered() is None:
        return []
    zero = r.windows_of.select(BY, "camera", F.lit(0.0).alias("from_s"), (F.col("to_s") - F.col("from_s")).alias("to_s"))  # times of changes are the episode's
    return _by_camera(camera.frozen_frac(r.changes(), r.state_filtered(), zero, r.fps), "frozen_frac")


def _video_lag(r: Recording) -> list[DataFrame]:
    return _by_camera(camera.action_lag_ms(r.changes(), r.arm_speed(), r.fps), "video_action_lag_ms") if r.changes() is not None and r.arm_speed() is not None else []


def _check(name: str) -> Callable[[Recording], list[DataFrame]]:
    return lambda r: [metrics.named(r.integrity(), name, F.col(name))]


def _language(name: str, measure: Callable) -> Callable[[Recording], list[DataFrame]]:
    return lambda r: [metrics.named(r.episodes.withColumn("v", measure(F.col("text"))), name, F.col("v"))] if "text" in r.episodes.columns else []


def _moving(r: Recording) -> list[Group]:
    return r.picks.of("arm", "hand")


def _time(name: str) -> Callable[[Recording], list[DataFrame]]:
    return lambda r: [r.times().where(F.col("metric") == name)] if r.times() is not None else []


def _sparc_phase(r: Recording) -> list[DataFrame]:
    return [metrics.windowed(v, "sparc_phase", arm.signal) for arm, v in _phases(r)]


def _lag_ms(r: Recording) -> list[DataFrame]:
    return [metrics.named(r.lags(), "track_lag_ms", 1000.0 * F.col("lag") / r.fps)] if r.lags() is not None else []


def _missed(r: Recording) -> list[DataFrame]:
    if r.picks.open_high is None or not r.picks.joint_positions:
        return []
    pairs = [(g, r.picks.arm_of(g)) for g in r.picks.of("gripper")]
    return [metrics.missed_grasps(r.own, list(g.dims), r.fps, r.picks.open_high, a.signal, True) for g, a in pairs if a is not None]


def _phases(r: Recording) -> list[tuple[Group, DataFrame]]:
    """Each gripper's arm with the spectral arc lengths of its phases."""
    pairs = [(g, r.picks.arm_of(g)) for g in r.picks.of("gripper")]
    make = lambda g, a: lambda: spectral.window_arc_length(metrics.phases(r.speed(a), r.unit(g)), r.fps)
    return [(a, r.once(f"phases {g.signal}", make(g, a))) for g, a in pairs if a is not None]


def _divergence(r: Recording) -> list[DataFrame]:
    robot = [c for c in ("robot",) if c in r.episodes.columns]
    peers = r.groups.select(BY, F.col("group_label").alias("grp"))
    peers = peers.join(r.episodes.select(BY, *robot), BY) if robot else peers
    return [metrics.named(batch.action_divergence(r.aux(), peers), "action_divergence", F.col("value"))]


#: Name to the function that gives a metric's rows, one DataFrame a signal or so.
FUNCTIONS: dict[str, Callable[[Recording], list[DataFrame]]] = {
    "sparc": lambda r: [metrics.windowed(r.arcs(g), "sparc", g.signal) for g in _moving(r)],
    "ldlj": lambda r: [metrics.ldlj(r.pieces(g), r.fps, g.signal) for g in _moving(r)],
    "sparc_phase": _sparc_phase,
    "jerk_rms": lambda r: [metrics.windowed(r.spectra(g), "jerk_rms", g.signal, "jerk", 0.95) for g in _moving(r)],
    "psd_lf_hf": lambda r: [metrics.windowed(r.spectra(g), "psd_lf_hf", g.signal, "ratio") for g in _moving(r)],
    "idle_lead_s": _time("idle_lead_s"),
    "idle_trail_s": _time("idle_trail_s"),
    "longest_pause_s": _time("longest_pause_s"),
    "end_motion_ratio": _time("end_motion_ratio"),
    "idle_frac": _time("idle_frac"),
    "length_z": lambda r: [metrics.length(r.own.groupBy(BY).agg(F.count(F.lit(1)).alias("length")), r.fps)],
    "path_length_z": lambda r: [metrics.path_length(r.arm_speed(), r.fps)] if r.arm_speed() is not None else [],
    "track_lag_ms": _lag_ms,
    "track_resid": lambda r: [metrics.named(r.lags(), "track_resid", F.col("resid")[i], g.signal) for i, g in enumerate(r.picks.of("arm"))] if r.lags() is not None else [],
    "accel_spike_frac": lambda r: [metrics.accel_spike_frac(r.spikes())] if r.spikes() is not None else [],
    "joint_limit_frac": lambda r: [metrics.joint_limit_frac(r.joint, r.picks.arm_dims(), r.bounds)] if r.picks.joint_positions and r.picks.arm_dims() and r.bounds is not None else [],
    "gripper_flips_per_s": lambda r: [metrics.gripper_flips(r.unit(g), r.fps, g.signal) for g in r.picks.of("gripper")],
    "missed_grasp_frac": _missed,
    "recovery_count": lambda r: [metrics.recovery_count(r.episodes, r.recoveries())] if r.recoveries() is not None else [],
    "action_divergence": _divergence,
    "stats_leverage": lambda r: [metrics.named(batch.stats_leverage(r.own, r.episodes), "stats_leverage", F.col("leverage"))],
    **{n: _still(n) for n in CAMERA},
    "frozen_frac": _frozen,
    "video_action_lag_ms": _video_lag,
    **{n: _check(n) for n in ("frame_gaps", "timestamp_dev", "length_mismatch", "video_window_mismatch", "nonfinite_values", "too_short", "schema_mismatch")},
    "task_missing": _language("task_missing", language.task_missing),
    "task_generic": _language("task_generic", language.task_generic),
}


_TIMES = ("idle_lead_s", "idle_trail_s", "longest_pause_s", "end_motion_ratio", "idle_frac")
#: Name to the tables whose rows with an error cost their episode the metric.
ERRORS: dict[str, Callable[[Recording], list[DataFrame]]] = {
    "sparc": lambda r: [r.arcs(g) for g in _moving(r)],
    "sparc_phase": lambda r: [v for _, v in _phases(r)],
    "jerk_rms": lambda r: [r.spectra(g) for g in _moving(r)],
    "psd_lf_hf": lambda r: [r.spectra(g) for g in _moving(r)],
    **dict.fromkeys(_TIMES, lambda r: [r._filtered()] if r._filtered() is not None else []),
}


def default_metrics() -> list[str]:
    """The metrics that run where nobody chose: all but the opt-in ones."""
    return [n for n in FUNCTIONS if not m.BY_NAME[n].opt_in]


def compute_raw(recording: Recording, names: list[str] | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The long table of raw values (each metric's rows stored once), and the failures (episode_id, metric, error), stored.

    names: the metrics to run, default_metrics() without. digits: round the values, so that engines that add in another order
    agree on all that follows.
    """
    spark = recording.frames.sparkSession
    raw, failures = spark.createDataFrame([], RAW), spark.createDataFrame([], FAILED)

    def measured(name: str) -> tuple[list[DataFrame], list[DataFrame]]:
        failed = lambda rows, error: rows.select(F.col(BY).cast("long"), F.lit(name).alias("metric"), error.alias("error"))
        try:
            parts = [recording.once(f"raw {name} {i}", lambda part=part: part.select(BY, "metric", "signal", "value", "worst")) for i, part in enumerate(FUNCTIONS[name](recording))]
            return parts, [failed(rows.where("error is not null"), F.col("error")) for rows in ERRORS.get(name, lambda r: [])(recording)]
        except AnalysisException as e:
            return [], [failed(recording.episodes, F.lit(spectral.told(e)))]
        except (PySparkException, Py4JError):
            raise
        except Exception as e:  # noqa: BLE001  a metric that can't be planned is a fact about it, not the end of the others
            return [], [failed(recording.episodes, F.lit(spectral.told(e)))]

    wanted = default_metrics() if names is None else names
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:  # each metric's jobs are few and small beside a cluster: several are planned and run at once
        found = list(pool.map(inheritable_thread_target(spark)(measured), wanted))
    for parts, broken in found:
        for part in parts:
            raw = raw.unionByName(part)
        for rows in broken:
            failures = failures.unionByName(rows)
    failures = stored(failures.groupBy(BY, "metric").agg(F.min("error").alias("error")))
    if failures.take(1):
        raw = raw.join(failures, [BY, "metric"], "left_anti")
    return (raw.withColumn("value", F.round("value", digits) + F.lit(0.0)) if digits is not None else raw), failures


@dataclass
class Scored:
    """A finished batch."""

    raw: DataFrame
    groups: DataFrame
    stats: DataFrame
    z: DataFrame
    worst: DataFrame
    scores: DataFrame
    failures: DataFrame

    def ranking(self) -> DataFrame:
        """Every episode with its group, score, flags, driver, verdict and the metrics that failed for it, which its verdict doesn't know."""
        df = self.groups.join(self.scores, BY, "left")
        lost = self.failures.groupBy(BY).agg(F.array_join(F.sort_array(F.collect_set("metric")), ",").alias("failed"))
        df = df.join(lost, BY, "left")
        return df.select(BY, "group_label", "basis", "score", F.coalesce("n_flags", F.lit(0)).alias("n_flags"), "driver", F.coalesce("verdict", F.lit("unknown")).alias("verdict"), F.coalesce("failed", F.lit("")).alias("failed"))


def profiles(scored: Scored, named: dict[str, DataFrame]) -> DataFrame:
    """episode_id, profile, score, n_flags, driver, verdict: every episode under every profile (scoring.profile_table), unknown where none of its metrics has a z."""
    out = None
    for name, table in named.items():
        df = scored.groups.select(BY).join(scoring.profile_scores(scored.worst, table), BY, "left")
        df = df.select(BY, F.lit(name).alias("profile"), "score", F.coalesce("n_flags", F.lit(0)).alias("n_flags"), "driver", F.coalesce("verdict", F.lit("unknown")).alias("verdict"))
        out = df if out is None else out.unionByName(df)
    return out


def result_rows(recording: Recording, scored: Scored, named: dict[str, DataFrame], metrics_: list[str]) -> DataFrame:
    """One row an episode as it is written back: every metric's fields (sinks.flatten), each profile's, both verdicts, group, its size, version and notes."""
    flat = sinks.flatten(scored.raw, scored.worst, scored.z, metrics_, [g.signal for g in recording.picks.groups])
    per = profiles(scored, named).groupBy(BY).agg(*[F.max(F.when(F.col("profile") == p, F.col(c))).alias(f"{c.replace('_', '')}_{p}") for p in named for c in ("score", "n_flags", "driver", "verdict")])
    checked = recording.integrity().select(BY, F.col("verdict").alias("integrity_verdict"), F.col("note").alias("frame_gaps_note"))
    texts = recording.episodes.select(BY, F.col("text") if "text" in recording.episodes.columns else F.lit(None).cast("string").alias("text"))
    judged = "text" in recording.episodes.columns
    t = F.col("text")
    said = metrics.language_verdict(language.task_missing(t), language.task_generic(t)) if judged else F.lit("unknown")
    texts = texts.select(BY, said.alias("language_verdict"), (language.generic_reason(t) if judged else F.lit(None).cast("string")).alias("task_generic_note"))
    lost = scored.ranking().select(BY, "failed")
    groups = scoring.group_sizes(scored.groups).select(BY, "group_label", F.col("basis").alias("group_basis"), "group_n")
    df = groups.join(per, BY, "left").join(checked, BY, "left").join(texts, BY, "left").join(lost, BY, "left").join(flat, BY, "left")
    return df.na.fill("unknown", ["integrity_verdict", "language_verdict"]).withColumn("config_version", F.lit(m.CONFIG_VERSION))


def field_catalogue(rows: DataFrame, key: str = BY) -> list[tuple[str, str]]:
    """The fields of result rows and their types, as a store declares them: str, int, float or list of str."""
    kinds = {"string": "str", "double": "float", "float": "float", "bigint": "int", "int": "int", "boolean": "bool", "array<string>": "list<str>"}
    return [(c, kinds.get(t, t)) for c, t in rows.dtypes if c != key]


def with_recovery_tags(rows: DataFrame, tag: str = "recovery", count: str = "q_recovery_count") -> DataFrame:
    """rows(.., tags) whose tag says whether the episode recovered; where that wasn't measured tags stay as they are."""
    seen = F.col(count).isNotNull()
    return rows.withColumn("tags", F.when(seen & (F.col(count) > 0), sinks.with_tag(F.col("tags"), tag, F.lit(True))).when(seen, sinks.with_tag(F.col("tags"), tag, F.lit(False))).otherwise(F.col("tags")))


def outliers(scored: Scored) -> DataFrame:
    """episode_id, iforest_score, novelty_knn, is_outlier of a finished batch: information only, no part of the score."""
    x = stored(scoring.feature_matrix(scored.worst))
    return scoring.outliers(batch.novelty(x), batch.isolation_scores(x), scored.groups)


def reviews(recording: Recording, scored: Scored) -> DataFrame:
    """One row an episode: the ranking with the verdicts of integrity and language, the failing checks and the outlier flag."""
    checked = recording.integrity().select(BY, F.col("verdict").alias("integrity"), "failing")
    said = scored.raw.where(F.col("metric").isin("task_missing", "task_generic")).groupBy(BY).agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in ("task_missing", "task_generic")])
    said = said.select(BY, metrics.language_verdict(F.col("task_missing"), F.col("task_generic")).alias("language"))
    df = scored.ranking().join(checked, BY, "left").join(said, BY, "left").join(outliers(scored).select(BY, "is_outlier"), BY, "left")
    return df.na.fill("unknown", ["integrity", "language"])


def metric_rows(worst: DataFrame, z: DataFrame) -> DataFrame:
    """episode_id, metric, value, z, breakdown: a metric's worst signal, and its value on every signal in thousandths."""
    own = F.filter(F.sort_array(F.collect_list(F.struct("signal", "value"))), lambda s: s.signal != "")
    text = F.array_join(F.transform(own, lambda s: F.concat_ws("=", s.signal, F.round(s.value * 1000).cast("long").cast("string"))), ",")
    return worst.select(BY, "metric", "value", "z").join(z.groupBy(BY, "metric").agg(text.alias("breakdown")), [BY, "metric"])


def present_signals(raw: DataFrame) -> DataFrame:
    """metric, signals: the signals on which each metric has values, in order."""
    return raw.where("signal <> ''").groupBy("metric").agg(F.array_join(F.sort_array(F.collect_set("signal")), ",").alias("signals"))


def panel(scored: Scored) -> DataFrame:
    """One row an episode as a panel shows it: the ranking's columns, and its metrics' values and z as maps."""
    entries = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", c))))
    maps = scored.worst.groupBy(BY).agg(entries("value").alias("values"), entries("z").alias("z"))
    return scored.ranking().join(maps, BY, "left")


def finalize(recording: Recording, raw: DataFrame, failures: DataFrame) -> Scored:
    """Robust fit, z-scores, worst signals and profile scores of a batch's raw values within the recording's groups."""
    groups = recording.groups
    flags = [x.name for x in m.METRICS if x.kind == "flag"]
    values = raw.where(~F.col("metric").isin(flags)).join(groups.select(BY, "group_label"), BY)
    stats = stored(scoring.fit(values))
    z = stored(scoring.z_scores(raw, groups, stats))
    worst = stored(scoring.worst_signals(z, [g.signal for g in recording.picks.groups]))
    return Scored(raw, groups, stats, z, worst, scoring.profile_scores(worst), failures)


def score(recording: Recording, names: list[str] | None = None, digits: int | None = None) -> Scored:
    return finalize(recording, *compute_raw(recording, names, digits))
