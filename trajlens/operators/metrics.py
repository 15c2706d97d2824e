"""Metrics of single episodes, each as a DataFrame episode_id, metric, signal, value[, worst]."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as m
from ..functions import spectral
from . import signals

BY = "episode_id"


def named(df: DataFrame, metric: str, value: Column, signal: str = "", worst: Column | None = None) -> DataFrame:
    worst = F.lit(None).cast("double") if worst is None else worst
    out = df.select(BY, F.lit(metric).alias("metric"), F.lit(signal).alias("signal"), value.cast("double").alias("value"), worst.cast("double").alias("worst"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def length(episodes: DataFrame, fps: float) -> DataFrame:
    return named(episodes, "length_z", F.col("length") / fps)


def path_length(speed: DataFrame, fps: float) -> DataFrame:
    return named(speed.groupBy(BY).agg((F.sum("speed") / fps).alias("v")), "path_length_z", F.col("v"))


def ldlj(speed: DataFrame, fps: float, signal: str) -> DataFrame:
    """Log dimensionless jerk on 3 s windows: median, and the 5th percentile as the worst. speed(episode_id, i, speed), or its pieces."""
    per = spectral.window_jerk(speed if "piece" in speed.columns else spectral.pieces(speed, fps), fps)
    agg = per.groupBy(BY).agg(F.median("v").alias("v"), F.percentile("v", F.lit(m.WORST_PERCENTILE)).alias("worst"))
    return named(agg, "ldlj", F.col("v"), signal, F.col("worst"))


def moving_reference(filtered: DataFrame) -> DataFrame:
    """filtered (episode_id, i, f) with ref: the median of the episode's samples above half their 90th percentile, or that percentile."""
    every = Window.partitionBy(BY)
    df = filtered.withColumn("_p", F.percentile("f", F.lit(m.IDLE_REFERENCE)).over(every))
    return df.withColumn("ref", F.coalesce(F.median(F.when(F.col("f") > F.col("_p") / 2, F.col("f"))).over(every), F.col("_p"))).drop("_p")


def idle_flags(filtered: DataFrame) -> DataFrame:
    """filtered (episode_id, i, f) with ref, n and idle."""
    df = moving_reference(filtered).withColumn("thr", m.IDLE_ALPHA * F.col("ref"))
    idle = F.when(F.col("thr") > 0, F.col("f") < F.col("thr")).otherwise(F.col("f") <= 0)
    return df.withColumn("idle", idle).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(BY)))


def idle_runs(flags: DataFrame) -> DataFrame:
    """episode_id, start, stop (exclusive), n of every run of idle samples: gaps and islands."""
    w = Window.partitionBy(BY).orderBy("i")
    v = Window.partitionBy(BY, "idle").orderBy("i")
    runs = flags.withColumn("k", F.row_number().over(w) - F.row_number().over(v)).where("idle")
    return runs.groupBy(BY, "k").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.first("n").alias("n")).drop("k")


def pauses(flags: DataFrame, recovered: DataFrame | None, fps: float) -> DataFrame:
    """episode_id, start, stop, n of interior idle runs, without those that overlap a recovery(episode_id, c1, c2) widened by a second: an operator who regrasps isn't stalling."""
    inside = idle_runs(flags).where("start > 0 and stop < n")
    if recovered is None:
        return inside
    r = recovered.select(F.col(BY).alias("e"), (F.col("c1") - int(fps)).alias("r0"), (F.col("c2") + int(fps)).alias("r1"))
    return inside.join(r, (inside[BY] == r["e"]) & (F.col("start") < F.col("r1")) & (F.col("stop") > F.col("r0")), "left_anti")


def time_metrics(filtered: DataFrame, fps: float, recovered: DataFrame | None = None) -> DataFrame:
    """Idle lead, trail, longest interior pause (outside recoveries), idle share and end motion, from filtered speeds."""
    flags = idle_flags(filtered).where(F.col("n") >= m.MIN_SPEED_SAMPLES)
    tail = max(1, round(fps))
    per = flags.groupBy(BY).agg(
        F.first("n").alias("n"),
        F.min(F.when(~F.col("idle"), F.col("i"))).alias("first"),
        F.max(F.when(~F.col("idle"), F.col("i"))).alias("last"),
        F.avg(F.col("idle").cast("double")).alias("frac"),
        (F.median(F.when(F.col("i") >= F.col("n") - tail, F.col("f"))) / F.first(F.when(F.col("ref") > 0, F.col("ref")))).alias("end"),
    )
    pause = pauses(flags, recovered, fps).groupBy(BY).agg(F.max(F.col("stop") - F.col("start")).alias("pause"))
    per = per.join(pause, BY, "left")
    parts = [("idle_lead_s", F.coalesce("first", "n") / fps), ("idle_trail_s", F.coalesce(F.col("n") - 1 - F.col("last"), F.col("n")) / fps), ("longest_pause_s", F.coalesce("pause", F.lit(0)) / fps), ("idle_frac", F.col("frac")), ("end_motion_ratio", F.col("end"))]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in parts]))
    return per.select(BY, rows.alias("r")).select(BY, "r.metric", F.lit("").alias("signal"), "r.value", F.lit(None).cast("double").alias("worst")).where("value is not null")


def accel_spikes(acc: DataFrame, k: float = m.SPIKE_K, floor: float = m.SPIKE_FLOOR) -> DataFrame:
    """acc (episode_id, dim, i, acc) -> episode_id, i, spike: any joint above its own median + k MAD, floor at least."""
    med = acc.groupBy(BY, "dim").agg(F.median("acc").alias("med"))
    mad = acc.join(med, [BY, "dim"]).groupBy(BY, "dim").agg(F.first("med").alias("med"), F.median(F.abs(F.col("acc") - F.col("med"))).alias("mad"))
    limit = F.greatest(F.col("med") + k * m.MAD_TO_STD * F.col("mad"), F.lit(floor))
    return acc.join(mad, [BY, "dim"]).groupBy(BY, "i").agg(F.max(F.col("acc") > limit).alias("spike"))


def frame_spikes(frames: DataFrame, dims: list[int], fps: float, k: float = m.SPIKE_K, floor: float = m.SPIKE_FLOOR) -> DataFrame:
    """accel_spikes of frames with u_state, whose rows are dealt out once."""
    w, every = Window.partitionBy(BY).orderBy("idx"), Window.partitionBy(BY)
    u = lambda d, k: F.lag(F.col("u_state")[d], k).over(w) if k else F.col("u_state")[d]
    df = frames.where(F.size("state") > max(dims)).select(BY, "idx", *[(F.abs(u(d, 0) - 2 * u(d, 1) + u(d, 2)) * fps * fps).alias(f"a{j}") for j, d in enumerate(dims)]).where("idx > 1")
    at = range(len(dims))
    df = df.withColumns({f"m{j}": F.median(f"a{j}").over(every) for j in at})
    df = df.withColumns({f"d{j}": F.median(F.abs(F.col(f"a{j}") - F.col(f"m{j}"))).over(every) for j in at})
    over = [F.col(f"a{j}") > F.greatest(F.col(f"m{j}") + k * m.MAD_TO_STD * F.col(f"d{j}"), F.lit(floor)) for j in at]
    return df.select(BY, (F.col("idx") - 2).alias("i"), (F.greatest(*over) if len(over) > 1 else over[0]).alias("spike"))


def accel_spike_frac(spikes: DataFrame) -> DataFrame:
    return named(spikes.groupBy(BY).agg(F.avg(F.col("spike").cast("double")).alias("v")), "accel_spike_frac", F.col("v"))


def spike_clusters(spikes: DataFrame, fps: float) -> DataFrame:
    """episode_id, start_s, end_s of spike clusters (a gap over 3 frames parts them), the first 12; none where 30 % spike."""
    w = Window.partitionBy(BY).orderBy("i")
    share = F.avg(F.col("spike").cast("double")).over(Window.partitionBy(BY))
    at = spikes.withColumn("share", share).where("spike and share < 0.3")
    at = at.withColumn("new", F.coalesce((F.col("i") - F.lag("i").over(w) > 3).cast("int"), F.lit(1)))
    at = at.withColumn("k", F.sum("new").over(w)).where("k <= 12")
    return at.groupBy(BY, "k").agg(((F.min("i") + 1) / fps).alias("start_s"), ((F.max("i") + 2) / fps).alias("end_s")).drop("k")


def tracked(frames: DataFrame, dims: list[int], fps: float, parts: list[list[int]]) -> DataFrame:
    """episode_id, lag, resid: the shift that aligns state velocity with action velocity best, where it reaches the least correlation, and for
    each part (some of dims) the mean absolute gap between action and lag-shifted state, each joint's median gap taken out.

    An episode's series meet in one row, and every joint's correlations at all shifts are products of numpy arrays in Arrow batches.
    """
    frames = frames if "u_state" in frames.columns else signals.with_units(frames.select(BY, "idx", "action", "state"))
    some = lambda v: F.array(*[F.get(v, F.lit(d)) for d in dims])
    rows = frames.groupBy(BY).agg(F.sort_array(F.collect_list(F.struct("idx", some("u_action").alias("a"), some("u_state").alias("s")))).alias("x"))
    rows = rows.select(BY, F.flatten("x.a").alias("a"), F.flatten("x.s").alias("s"))
    places = [[dims.index(d) for d in part if d in dims] for part in parts]

    def best(a: np.ndarray, s: np.ndarray) -> int | None:
        a, s = np.diff(a, axis=0), np.diff(s, axis=0)
        if len(a) < 7:
            return None
        a, s = a - np.nanmean(a, axis=0), s - np.nanmean(s, axis=0)
        norm = np.sqrt(np.nansum(a * a, axis=0) * np.nansum(s * s, axis=0))
        n, most = len(a), min(int(round(m.MAX_LAG_S * fps)), len(a) // 3)
        fine = (norm > 1e-12) & np.isfinite(a).all(axis=0) & np.isfinite(s).all(axis=0)
        if not fine.any():
            return None
        a, s, norm = a[:, fine], s[:, fine], norm[fine]
        score = [float(((a[: n - k] * s[k:]).sum(axis=0) / norm * n / (n - k)).mean()) for k in range(most + 1)]
        lag = int(np.argmax(score))  # the first of the best
        return lag if score[lag] >= m.MIN_LAG_CORR else None

    def resid(gap: np.ndarray) -> float:
        gap = gap[:, np.isfinite(gap).any(axis=0)]
        return float(np.nanmean(np.abs(gap - np.nanmedian(gap, axis=0)))) if gap.size else math.nan

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, lags, gaps = [], [], []
            for e, a, s in zip(batch[BY], batch["a"], batch["s"]):
                a, s = (np.asarray(v, dtype=float).reshape(-1, len(dims)) for v in (a, s))
                lag = best(a, s)
                if lag is not None:
                    gap = a[: len(a) - lag] - s[lag:]
                    ids.append(e)
                    lags.append(lag)
                    gaps.append([resid(gap[:, at]) for at in places])
            yield pd.DataFrame({BY: pd.Series(ids, dtype=batch[BY].dtype), "lag": pd.Series(lags, dtype="int32"), "resid": pd.Series(gaps, dtype=object)})

    return rows.mapInPandas(run, f"{BY} {dict(frames.dtypes)[BY]}, lag int, resid array<double>")


def track_lag(frames: DataFrame, dims: list[int], fps: float) -> DataFrame:
    """episode_id, lag of tracked."""
    return tracked(frames, dims, fps, []).select(BY, "lag")


def track_resid(frames: DataFrame, lags: DataFrame, dims: list[int], signal: str) -> DataFrame:
    """Mean absolute gap between action and lag-shifted state, each joint's median gap taken out. One row a frame is joined, not one a joint."""
    frames = frames if "u_state" in frames.columns else signals.with_units(frames.select(BY, "idx", "action", "state"))
    some = lambda v: F.array(*[F.get(v, F.lit(d)) for d in dims])
    ahead = frames.join(lags, BY).select(BY, (F.col("idx") - F.col("lag")).alias("idx"), some("u_state").alias("s"))
    gap = frames.select(BY, "idx", some("u_action").alias("a")).join(ahead, [BY, "idx"]).select(BY, F.posexplode(F.zip_with("a", "s", lambda a, s: a - s)).alias("dim", "d"))
    med = gap.groupBy(BY, "dim").agg(F.median("d").alias("med"))
    per = gap.join(med, [BY, "dim"]).groupBy(BY).agg(F.avg(F.abs(F.col("d") - F.col("med"))).alias("v"))
    return named(per, "track_resid", F.col("v"), signal)


def joint_limit_frac(frames: DataFrame, dims: list[int], bounds: DataFrame | None = None) -> DataFrame:
    """Share of (frame, moving joint) near the joint's bounds(dim, lo, hi), as the source declares them; no value without."""
    if bounds is None:
        return named(frames.select(BY).where("false"), "joint_limit_frac", F.lit(None))
    said = F.struct(F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    one = bounds.where(F.col("dim").isin(dims)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("dim").cast("int").alias("dim"), said.alias("b")))).alias("_b"))
    df, counts = frames.crossJoin(F.broadcast(one)), []  # one row
    for d in dims:
        x, b = signals.finite(F.get("state", F.lit(d))), F.try_element_at("_b", F.lit(d))
        span = b["hi"] - b["lo"]
        near = (x <= b["lo"] + m.LIMIT_MARGIN * span) | (x >= b["hi"] - m.LIMIT_MARGIN * span)
        counts += [F.count(x).alias(f"n{d}"), F.count_if(near).alias(f"k{d}"), (F.max(x) - F.min(x)).alias(f"p{d}"), F.first(span).alias(f"s{d}")]
    per = df.groupBy(BY).agg(*counts)
    moved = {d: F.coalesce((F.col(f"s{d}") > 1e-9) & (F.col(f"p{d}") >= m.MIN_ACTIVE_SHARE * F.col(f"s{d}")), F.lit(False)) for d in dims}
    total = lambda c: F.aggregate(F.array(*[F.when(moved[d], F.col(f"{c}{d}")).otherwise(0) for d in dims]), F.lit(0).cast("long"), lambda s, x: s + x)
    return named(per, "joint_limit_frac", F.try_divide(total("k").cast("double"), total("n").cast("double")))


def gripper_flips(unit: DataFrame, fps: float, signal: str) -> DataFrame:
    n = unit.groupBy(BY).agg(F.count(F.lit(1)).alias("n"))
    flips = signals.gripper_transitions(unit).groupBy(BY).agg(F.count(F.lit(1)).alias("k"))
    return named(n.join(flips, BY, "left"), "gripper_flips_per_s", F.coalesce("k", F.lit(0)) * fps / F.col("n"), signal)


def recoveries(frames: DataFrame, unit: DataFrame, arm: list[int], fps: float, open_high: bool) -> DataFrame:
    """episode_id, c1, o, c2: close, reopen, close again soon and near the same arm position."""
    frames = frames if "u_action" in frames.columns else signals.with_units(frames.select(BY, "idx", "action"), ("action",))
    held = frames.select(BY, "idx", F.array(*[F.get("u_action", F.lit(d)) for d in arm]).alias("u"))
    events = signals.gripper_transitions(unit).withColumn("opens", F.col("high") == F.lit(open_high)).join(held, [BY, "idx"])  # with where the arm is
    after = Window.partitionBy(BY).orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    nxt = events.withColumn("next_open", F.min(F.when(F.col("opens"), F.col("idx"))).over(after)).withColumn("next_close", F.min(F.when(~F.col("opens"), F.struct("idx", "u"))).over(after))
    closes = nxt.where(~F.col("opens")).select(BY, F.col("idx").alias("c1"), F.col("next_open").alias("o"), F.col("u").alias("p"))
    reopened = nxt.where("opens").select(BY, F.col("idx").alias("o"), F.col("next_close.idx").alias("c2"), F.col("next_close.u").alias("q"))
    t = closes.join(reopened, [BY, "o"]).where("c2 is not null")
    t = t.where(((F.col("o") - F.col("c1")) / fps <= m.RECOVERY_WINDOW_S) & ((F.col("c2") - F.col("o")) / fps <= m.RECOVERY_REOPEN_S) & ((F.col("c2") - F.col("c1")) / fps <= m.RECOVERY_WINDOW_S))
    gaps = F.filter(F.zip_with("p", "q", lambda p, q: F.pow(p - q, 2)), lambda x: x.isNotNull())
    d = F.sqrt(F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x), F.size(gaps)))
    return t.where(d <= m.RECOVERY_DISTANCE).select(BY, "c1", "o", "c2")


def missed_grasps(frames: DataFrame, dims: list[int], fps: float, open_high: bool, signal: str, joint: bool = False) -> DataFrame:
    """Of the closes that can be judged half a second later, the share in which the gripper closed on nothing.

    joint: only frames whose action is as large as their state are compared. All is found where an episode's frames lie.
    """
    hold = max(1, round(m.HOLD_S * fps))
    w, every = Window.partitionBy(BY).orderBy("idx"), Window.partitionBy(BY)
    held = F.size("state") > min(dims)
    held = held & (F.size("action") == F.size("state")) if joint else held
    a, gap = signals.mean_of("action", dims), signals.mean_of("action", dims) - signals.mean_of("state", dims)
    pos = frames.where(F.size("action") > max(dims)).select(BY, "idx", a.alias("g"), F.when(held, F.struct(a.alias("a"), gap.alias("gap"))).alias("p"))
    pos = pos.withColumn("lo", F.min("g").over(every)).withColumn("hi", F.max("g").over(every)).where("hi - lo > 1e-9")
    pos = pos.withColumn("unit", (F.col("g") - F.col("lo")) / (F.col("hi") - F.col("lo"))).drop("g", "lo", "hi")
    is_open = F.col("p").isNotNull() & (F.col("unit") >= 0.5 if open_high else F.col("unit") < 0.5)
    pos = pos.withColumns({
        "span": F.max("p.a").over(every) - F.min("p.a").over(every),
        "n": F.count("p").over(every),
        "offset": F.median(F.when(is_open, F.col("p.gap"))).over(every),
        "k": F.count_if(is_open).over(every),
        "at": F.max(F.struct("idx", "p")).over(w.rangeBetween(hold, hold)),  # the frame half a second later
    })
    events = signals.gripper_states(pos).where("state <> before").withColumn("opens", (F.col("unit") > 0.5) == F.lit(open_high))
    after = w.rowsBetween(1, Window.unboundedFollowing)
    closes = events.withColumn("o", F.min(F.when(F.col("opens"), F.col("idx"))).over(after)).where(~F.col("opens"))
    judged = closes.where("at.p is not null and k >= 3").where(F.col("idx") + hold < F.coalesce("o", "n"))
    missed = F.abs(F.col("at.p.gap") - F.col("offset")) / F.col("span") <= m.HELD_GAP
    return named(judged.groupBy(BY).agg(F.avg(missed.cast("double")).alias("v")), "missed_grasp_frac", F.col("v"), signal)


def integrity(frames: DataFrame, fps: float, expected: DataFrame | None = None, video: DataFrame | None = None, schema: DataFrame | None = None) -> DataFrame:
    """One row an episode: the integrity metrics of frames(episode_id, idx, frame_index, action[, state][, timestamp]) and their verdict.

    expected(episode_id, expected): the promised lengths; without them there is no length_mismatch. video(episode_id,
    value): window gaps in frames; schema(episode_id, mismatch). An episode of expected without frames has no metrics:
    its verdict is unknown. Time steps come from timestamps where they are recorded, else from frame numbers.
    """
    w = Window.partitionBy(BY).orderBy("idx")
    df = frames.withColumn("step", F.col("frame_index") - F.lag("frame_index").over(w))
    seconds = F.col("timestamp") - F.lag("timestamp").over(w) if "timestamp" in frames.columns else F.col("step") / fps
    df = df.withColumn("dt", seconds)
    count = lambda v: F.size(F.filter(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    bad = F.greatest(count("action"), F.lit(0)) + (F.greatest(count("state"), F.lit(0)) if "state" in frames.columns else F.lit(0))
    per = df.groupBy(BY).agg(
        F.count(F.lit(1)).alias("length"),
        F.count_distinct("frame_index").alias("k"),
        F.min("frame_index").alias("lo"),
        F.max("frame_index").alias("hi"),
        F.count_if(F.col("step") < 0).alias("out_of_order"),
        F.max(F.abs(F.col("dt") - 1 / fps)).alias("timestamp_dev"),
        F.sum(bad).alias("nonfinite_values"),
    )
    per = per.withColumn("duplicated", F.col("length") - F.col("k")).withColumn("missing", F.col("hi") - F.col("lo") + 1 - F.col("k")).withColumn("offset", (F.col("lo") != 0).cast("long"))
    per = per.withColumn("frame_gaps", F.col("duplicated") + F.col("missing") + F.col("out_of_order") + F.col("offset"))
    per = per.withColumn("too_short", ((F.col("length") < m.MIN_FRAMES) | (F.col("length") / fps < m.MIN_SECONDS)).cast("long"))
    per = (expected.select(BY, "expected").join(per, BY, "full") if expected is not None else per.withColumn("expected", F.lit(None).cast("long"))).withColumn("length_mismatch", F.abs(F.col("length") - F.col("expected")))
    for name, other, column in (("video_window_mismatch", video, "value"), ("schema_mismatch", schema, "mismatch")):
        per = per.join(other.select(BY, F.col(column).alias(name)), BY, "left") if other is not None else per.withColumn(name, F.lit(None).cast("double"))
    note = F.concat_ws(", ", *[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c.replace('_', ' ')}"))) for c in ("duplicated", "missing", "out_of_order")], F.when(F.col("offset") > 0, F.lit("does not start at 0")))
    names = [x.name for x in m.METRICS if x.family == "integrity"]
    return per.select(BY, *names, F.when(note != "", note).alias("note"), check_verdict(names).alias("verdict"), failing_checks(names).alias("failing"))


def _hits(names: list[str]) -> list[tuple[m.MetricSpec, Column]]:
    return [(spec, F.coalesce(F.col(spec.name) > spec.above, F.lit(False))) for spec in (m.BY_NAME[n] for n in names) if spec.check]


def check_verdict(names: list[str]) -> Column:
    """The worst level among the metrics that have a check: fail, warn, pass, or unknown where none has a value."""
    hits = _hits(names)
    some = lambda level: [h for spec, h in hits if spec.check == level]
    seen = F.coalesce(*[F.col(spec.name).cast("double") for spec, _ in hits]).isNotNull()
    either = lambda xs: F.array_max(F.array(F.lit(False), *xs))
    return F.when(~seen, "unknown").when(either(some("fail")), "fail").when(either(some("warn")), "warn").otherwise("pass")


def failing_checks(names: list[str]) -> Column:
    """The names of the checks that a row fails, in the registry's order."""
    return F.concat_ws(",", *[F.when(hit, spec.name) for spec, hit in _hits(names)])


def language_verdict(missing: Column, generic: Column) -> Column:
    """warn where a task is missing or says little, unknown where neither was judged."""
    return F.when(missing.isNull() & generic.isNull(), "unknown").when((F.coalesce(missing, F.lit(0.0)) > 0) | (F.coalesce(generic, F.lit(0.0)) > 0), "warn").otherwise("pass")


def recovery_count(episodes: DataFrame, recovered: DataFrame) -> DataFrame:
    """How often each of episodes(episode_id) recovered."""
    n = recovered.groupBy(BY).agg(F.count(F.lit(1)).alias("k"))
    return named(episodes.select(BY).distinct().join(n, BY, "left"), "recovery_count", F.coalesce("k", F.lit(0)))


def windowed(values: DataFrame, metric: str, signal: str, column: str = "v", percentile: float = m.WORST_PERCENTILE) -> DataFrame:
    """values(episode_id, win, column) of windows as one metric: their median, and a percentile as the worst."""
    agg = values.where(F.col(column).isNotNull() & ~F.isnan(column)).groupBy(BY).agg(F.median(column).alias("m"), F.percentile(column, F.lit(percentile)).alias("p"))
    return named(agg, metric, F.col("m"), signal, F.col("p"))


def phases(speed: DataFrame, unit: DataFrame) -> DataFrame:
    """speed with win (the phase between gripper transitions) and size, phases of at least MIN_WINDOW samples."""
    last = Window.partitionBy(BY)
    cuts = signals.gripper_transitions(unit).where("idx > 0").select(BY, F.col("idx").alias("i"), F.lit(1).alias("cut"))
    df = speed.join(unit.select(BY).distinct(), BY).join(cuts, [BY, "i"], "left")
    df = df.withColumn("win", F.sum(F.coalesce("cut", F.lit(0))).over(last.orderBy("i"))).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(BY, "win")))
    return df.where(F.col("size") >= m.MIN_WINDOW).drop("cut")
