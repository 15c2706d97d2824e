"""Structured Streaming over frame events: activity as events arrive, and episodes measured once they are whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import model as m


def windowed_activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events(ts, user_id, value), a batch or a stream -> per window: episodes seen, frames and mean value."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    df = events.withWatermark("ts", late) if events.isStreaming else events
    per = df.groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.approx_count_distinct("user_id").alias("episodes"), F.avg("value").alias("mean_value"))
    return per.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", "episodes", "mean_value")


def episode_lengths(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """events(ts, user_id, value) -> episode_id, start, end, frames, path of every session that a gap has ended.

    A session window holds an episode's state until the watermark passes its end, so an episode that arrives in many
    micro-batches is one row, emitted once and whole.
    """
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withWatermark("ts", late) if events.isStreaming else df
    per = df.groupBy(F.col("user_id").alias("episode_id"), F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.sum(F.abs("value")).alias("path"))
    return per.select("episode_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", "path")


STATE = "n long, last double, last_ts long, last_id long, lo double, hi double, path double, tail array<double>, skipped int, jerks array<double>, late long"
MEASURED = "episode_id long, frames long, length_s double, lo double, hi double, path double, windows int, ldlj double, ldlj_worst double, late long"


def window_jerk(speed: np.ndarray, fps: float) -> float:
    """Log dimensionless jerk of one window of speeds; NaN where it doesn't move or its speed is even."""
    peak = np.abs(speed).max()
    jerk = np.square(np.diff(speed, n=2) * fps * fps).sum()
    d = ((len(speed) - 1) / fps) ** 3 / (peak * peak) * jerk / fps if peak > 0 else 0.0
    return -float(np.log(d)) if d > 0 else float("nan")


class EpisodeState:
    """What an episode's next events need of those before: sums, extremes, and the speeds of the window that isn't complete yet.

    Complete windows are measured and forgotten, all but their jerk (one number for each half window of an episode).
    """

    def __init__(self, state: tuple | None):
        self.n, self.last, self.last_ts, self.last_id, self.lo, self.hi, self.path, tail, self.skipped, jerks, self.late = state or (0, 0.0, -(2**63), -(2**63), float("inf"), float("-inf"), 0.0, [], 0, [], 0)
        self.tail, self.jerks = list(tail), list(jerks)

    def add(self, values: np.ndarray, fps: float, size: int) -> None:
        """More values in order. The window is size speeds long, windows overlap by half."""
        before = values[:0] if self.n == 0 else np.array([self.last])
        steps = np.abs(np.diff(np.concatenate([before, values])))
        self.n, self.last = self.n + len(values), float(values[-1])
        self.lo, self.hi, self.path = min(self.lo, float(values.min())), max(self.hi, float(values.max())), self.path + float(steps.sum())
        speeds, at, step = np.concatenate([self.tail, steps * fps]), 0, max(1, size // 2)
        while len(speeds) - at >= size:
            self.jerks.append(window_jerk(speeds[at : at + size], fps))
            at += step
        self.tail, self.skipped = speeds[at:].tolist(), self.skipped + at // step

    def stored(self) -> tuple:
        return (self.n, self.last, self.last_ts, self.last_id, self.lo, self.hi, self.path, self.tail, self.skipped, self.jerks, self.late)

    def measured(self, fps: float) -> tuple:
        """The episode's metrics over all its events so far; an episode shorter than a window is one window."""
        jerks = np.array(self.jerks if self.skipped else [window_jerk(np.array(self.tail), fps)] if len(self.tail) >= m.MIN_WINDOW else [])
        jerks = jerks[np.isfinite(jerks)]
        some = len(jerks) > 0
        return (self.n, self.n / fps, self.lo, self.hi, self.path, len(jerks), float(np.median(jerks)) if some else None, float(np.percentile(jerks, 100 * m.WORST_PERCENTILE)) if some else None, self.late)


def episode_metrics(events: DataFrame, fps: float) -> DataFrame:
    """A stream events(user_id, ts, event_id, value) -> the metrics of every episode that a micro-batch touches (update mode).

    Each event is read once: what earlier ones gave lies in the state store by episode. Within an episode events come in the order of
    (ts, event_id); one that comes after a later one has been taken is counted in late and left out. Null values are left out.
    """
    size = max(m.MIN_WINDOW, round(m.WINDOW_S * fps))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = EpisodeState(state.get if state.exists else None)
        new = pd.concat(list(frames)).sort_values(["at", "event_id"])
        late = (new["at"] < own.last_ts) | ((new["at"] == own.last_ts) & (new["event_id"] <= own.last_id))
        own.late += int(late.sum())
        new = new[~late]
        if len(new):
            own.last_ts, own.last_id = int(new["at"].iloc[-1]), int(new["event_id"].iloc[-1])
            own.add(new["value"].to_numpy(dtype=float), fps, size)
        state.update(own.stored())
        if own.n:
            yield pd.DataFrame([(int(key[0]), *own.measured(fps))], columns=[c.split()[0] for c in MEASURED.split(", ")])

    rows = events.where("user_id is not null and value is not null").select(F.col("user_id").cast("long").alias("episode_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("episode_id").applyInPandasWithState(update, MEASURED, STATE, "update", GroupStateTimeout.NoTimeout)


def score_stream(events: DataFrame, path: str, checkpoint: str, fps: float) -> StreamingQuery:
    """Keep episode_metrics of a stream in a table: every micro-batch writes the episodes that it touches to ``path/epoch=k``.

    The newest epoch of an episode counts (latest); a replayed epoch overwrites its own folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return episode_metrics(events, fps).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(metrics: DataFrame) -> DataFrame:
    """The rows of each episode's newest epoch."""
    newest = metrics.groupBy("episode_id").agg(F.max("epoch").alias("epoch"))
    return metrics.join(newest, ["episode_id", "epoch"], "left_semi").drop("epoch")
