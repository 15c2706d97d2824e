"""Frame times of video windows: sampling, nearest decodable frames, bursts, dense steps, window lengths, lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import MIN_LAG_CORR

TOLERANCE = 1e-3


def sample_times(windows: DataFrame, n: int) -> DataFrame:
    """windows(window_id, from_s, to_s) -> window_id, k, t: midpoints of n equal slices; none where the window is empty."""
    span = F.col("to_s") - F.col("from_s")
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("from_s") + span * (i + 0.5) / n)
    return windows.where(span > 0).select("window_id", F.posexplode(times).alias("k", "t"))


def frames_at(times: DataFrame, frames: DataFrame) -> DataFrame:
    """times(window_id, k, t), frames(window_id, frame_t) -> the first frame at or after t (1 ms early is allowed), else the last.

    An as-of join without a range join: both sides in one ordered pass by window.
    """
    w = Window.partitionBy("window_id").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy("window_id")
    ask = times.select("window_id", "k", "t", (F.col("t") - TOLERANCE).alias("at"), F.lit(0).alias("kind"))
    have = frames.select("window_id", F.lit(None).cast("int").alias("k"), F.col("frame_t").alias("t"), F.col("frame_t").alias("at"), F.lit(1).alias("kind"))
    both = ask.unionByName(have).withColumn("next", F.min(F.when(F.col("kind") == 1, F.col("t"))).over(w)).withColumn("last", F.max(F.when(F.col("kind") == 1, F.col("t"))).over(every))
    return both.where("kind = 0").select("window_id", "k", "t", F.coalesce("next", "last").alias("frame_t")).where("frame_t is not null")


def bursts(starts: DataFrame, frames: DataFrame, n: int) -> DataFrame:
    """starts(window_id, start, to_s) -> the first n frames from each start within the window."""
    df = frames.join(starts, "window_id").where((F.col("frame_t") >= F.col("start") - TOLERANCE) & (F.col("frame_t") < F.col("to_s")))
    return df.withColumn("r", F.row_number().over(Window.partitionBy("window_id", "start").orderBy("frame_t"))).where(F.col("r") <= n).select("window_id", "start", "r", "frame_t")


def dense_steps(windows: DataFrame, frames: DataFrame, step: int, max_frames: int | None = None) -> DataFrame:
    """windows(window_id, from_s, to_s), frames(window_id, frame_t) -> window_id, r, frame_t: every step-th frame within (1 ms early is allowed)."""
    df = frames.join(windows.select("window_id", "from_s", "to_s"), "window_id").where((F.col("frame_t") >= F.col("from_s") - TOLERANCE) & (F.col("frame_t") < F.col("to_s") - TOLERANCE))
    df = df.withColumn("q", F.row_number().over(Window.partitionBy("window_id").orderBy("frame_t")) - 1).where(F.col("q") % step == 0)
    df = df.select("window_id", (F.col("q") / step).cast("int").alias("r"), "frame_t")
    return df.where(F.col("r") < max_frames) if max_frames else df


def central(windows: DataFrame, seconds: float) -> DataFrame:
    """windows(window_id, from_s, to_s, ..) cut to their middle seconds."""
    cut = F.greatest((F.col("to_s") - F.col("from_s") - seconds) / 2, F.lit(0.0))
    return windows.withColumns({"from_s": F.col("from_s") + cut, "to_s": F.col("to_s") - cut})


def resampled(series: DataFrame, grid: DataFrame) -> DataFrame:
    """series(episode_id, t, v), grid(episode_id, t) -> episode_id, t, v: linear between neighbours, grid points outside a series left out.

    One ordered pass by episode brings every grid point its neighbours; no range join.
    """
    have = series.select("episode_id", "t", F.struct("t", "v").alias("p"), F.lit(False).alias("asked"))
    ask = grid.select("episode_id", "t", F.lit(None).cast(have.schema["p"].dataType).alias("p"), F.lit(True).alias("asked"))
    w = Window.partitionBy("episode_id").orderBy("t", "asked")
    both = have.unionByName(ask).withColumn("a", F.last("p", ignorenulls=True).over(w)).withColumn("b", F.first("p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    v = F.when(F.col("a.t") == F.col("t"), F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    return both.where("asked").withColumn("v", v).where("v is not null").select("episode_id", "t", "v")


def window_mismatch(episodes: DataFrame, fps: float) -> DataFrame:
    """episodes(episode_id, length, windows map<camera, struct<from_s, to_s>>) -> episode_id, value (frames), camera of the largest gap."""
    gap = F.abs((F.col("w.to_s") - F.col("w.from_s")) - F.col("length") / fps) * fps
    df = episodes.select("episode_id", "length", F.explode("windows").alias("camera", "w")).withColumn("gap", gap)
    best = F.min_by("camera", F.struct(-F.col("gap"), "camera"))
    return df.groupBy("episode_id").agg(F.max("gap").alias("value"), best.alias("camera"))


def best_lag(pairs: DataFrame, max_lag: int) -> DataFrame:
    """pairs(episode_id, i, x, y) -> episode_id, lag, corr: the shift of y against x whose correlation is largest, either way.

    Both series are standardised; flat ones and correlations below the least have no row. A parabola through the peak
    and its neighbours refines the shift by up to half a sample.
    """
    every = Window.partitionBy("episode_id")
    z = lambda c: (F.col(c) - F.avg(c).over(every)) / F.stddev_pop(c).over(every)
    flat = (F.stddev_pop("x").over(every) < 1e-12) | (F.stddev_pop("y").over(every) < 1e-12)
    df = pairs.withColumn("flat", flat).where("not flat").withColumn("x", z("x")).withColumn("y", z("y"))
    seq = df.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("s")).withColumn("n", F.size("s"))
    most = F.least(F.lit(max_lag), F.floor(F.col("n") / 3).cast("int"))
    seq = seq.select("episode_id", "n", most.alias("most"), F.col("s.x").alias("x"), F.col("s.y").alias("y"))
    at = "aggregate(zip_with(slice(x, greatest(1, 1 - k), n - abs(k)), slice(y, greatest(1, 1 + k), n - abs(k)), (a, b) -> a * b), 0D, (s, v) -> s + v) / (n - abs(k))"
    seq = seq.select("episode_id", "most", F.expr(f"transform(sequence(-most, most), k -> {at})").alias("cs"))
    peak = F.expr("array_max(transform(cs, (c, i) -> struct(c, -i as o)))")
    seq = seq.withColumn("o", -peak["o"]).select("episode_id", F.struct((F.col("o") - F.col("most")).alias("k"), F.get("cs", F.col("o")).alias("c"), F.get("cs", F.col("o") - 1).alias("l"), F.get("cs", F.col("o") + 1).alias("r")).alias("b"))
    top = seq
    bend = F.col("b.l") - 2 * F.col("b.c") + F.col("b.r")
    shift = F.when(bend < 0, F.greatest(F.least(0.5 * (F.col("b.l") - F.col("b.r")) / bend, F.lit(0.5)), F.lit(-0.5))).otherwise(0.0)
    return top.where(F.col("b.c") >= MIN_LAG_CORR).select("episode_id", (F.col("b.k") + F.coalesce(shift, F.lit(0.0))).alias("lag"), F.col("b.c").alias("corr"))
