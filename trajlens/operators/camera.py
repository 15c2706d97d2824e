"""Still-frame measures of gray images given as flat pixel arrays: sharpness, exposure, clipping. No Python.

Bursts tell frozen feeds, and changes from frame to frame tell how far the picture lags the action."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model as m
from ..functions import spectral
from . import metrics, video

#: Fixed values.
BURSTS, BURST_FRAMES, FROZEN_DIFF, MOVING_ALPHA, LAG_SPAN_S, LAG_MAX_S, MIN_SAMPLES = 6, 6, 0.05, 0.25, 30.0, 1.0, 20


def still_stats(images: DataFrame, side: int) -> DataFrame:
    """images(camera, frame, px: side*side gray values) -> camera, frame, sharp, exposure, clipped.

    sharp is the variance of the 4-neighbour Laplacian, borders mirrored without repeating the edge.
    """
    mirror = lambda e, d: f"if({e} + {d} < 0, 1, if({e} + {d} > {side - 1}, {side - 2}, {e} + {d}))"
    y, x = f"(p div {side})", f"(p % {side})"
    cell = lambda yy, xx: f"px[int(({yy}) * {side} + ({xx}))]"
    value = f"{cell(mirror(y, -1), x)} + {cell(mirror(y, 1), x)} + {cell(y, mirror(x, -1))} + {cell(y, mirror(x, 1))} - 4 * px[int(p)]"
    df = images.withColumn("lap", F.expr(f"transform(sequence(0, {side * side - 1}), p -> double({value}))"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    df = df.withColumn("m", mean(F.col("lap"))).withColumn("gray", mean(F.transform("px", lambda v: v.cast("double"))))
    sharp = F.aggregate("lap", F.lit(0.0), lambda s, v: s + (v - F.col("m")) * (v - F.col("m"))) / F.size("lap")
    clipped = F.size(F.filter("px", lambda v: (v == 0) | (v == 255))) / F.size("px")
    return df.select("camera", "frame", sharp.alias("sharp"), (F.abs(F.col("gray") - 127.5) / 127.5).alias("exposure"), clipped.alias("clipped"))


def camera_metrics(stats: DataFrame) -> DataFrame:
    """camera, blur, blur_worst, exposure_err, exposure_worst, clipped_frac, clipped_worst."""
    log = lambda c: F.log10(1 + c)
    return stats.groupBy("camera").agg(
        log(F.percentile("sharp", F.lit(0.1))).alias("blur"), log(F.min("sharp")).alias("blur_worst"), F.median("exposure").alias("exposure_err"), F.max("exposure").alias("exposure_worst"), F.avg("clipped").alias("clipped_frac"), F.max("clipped").alias("clipped_worst")
    )


def frame_changes(images: DataFrame) -> DataFrame:
    """images(episode_id, camera, t, px) -> episode_id, camera, t, v: the mean absolute change since the frame before."""
    w = Window.partitionBy("episode_id", "camera").orderBy("t")
    change = F.aggregate(F.zip_with("px", "before", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size("px")
    return images.withColumn("before", F.lag("px").over(w)).where("before is not null").select("episode_id", "camera", "t", change.alias("v"))


def frozen_frac(changes: DataFrame, filtered: DataFrame, windows: DataFrame, fps: float) -> DataFrame:
    """Of the bursts during which the robot moves, the share in which the picture stands still; none where it never moves.

    changes(episode_id, camera, t, v), filtered(episode_id, i, f): filtered state speeds, windows(episode_id, camera,
    from_s, to_s), times within the episode.
    """
    span = BURST_FRAMES / fps
    w = windows.select(F.concat_ws("|", "episode_id", "camera").alias("window_id"), "episode_id", "camera", "from_s", "to_s")
    at = video.sample_times(w, BURSTS).join(w, "window_id")
    start = F.greatest(F.col("from_s"), F.least(F.col("t") - span / 2, F.col("to_s") - 1.5 * span))
    bursts = at.select("episode_id", "camera", "k", start.alias("start"))
    seen = changes.join(bursts, ["episode_id", "camera"]).where((F.col("t") >= F.col("start") - video.TOLERANCE) & (F.col("t") < F.col("start") + span))
    seen = seen.groupBy("episode_id", "camera", "k").agg(F.max("v").alias("most"), F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    flags = metrics.moving_reference(filtered).where("ref > 0")
    moved = flags.join(seen, "episode_id").where((F.col("i") >= F.rint(F.col("a") * fps)) & (F.col("i") < F.rint(F.col("b") * fps)))
    moved = moved.groupBy("episode_id", "camera", "k").agg(F.median("f").alias("f"), F.first("ref").alias("ref"), F.first("most").alias("most")).where(F.col("f") >= MOVING_ALPHA * F.col("ref"))
    return moved.groupBy("episode_id", "camera").agg(F.avg((F.col("most") < FROZEN_DIFF).cast("double")).alias("value"))


def action_lag_ms(changes: DataFrame, speed: DataFrame, fps: float) -> DataFrame:
    """episode_id, camera, value: how far the picture's motion lies from the action's, either way; none where they don't correlate.

    changes(episode_id, camera, t, v), speed(episode_id, i, speed): both are brought to one grid over their common time
    (the middle 30 s at most), filtered, and shifted against each other by up to a second.
    """
    key = F.concat_ws("|", "episode_id", "camera").alias("e")
    energy = changes.select(key, "episode_id", "camera", "t", "v")
    act = speed.select("episode_id", ((F.col("i") + 1) / fps).alias("t"), F.col("speed").alias("v"))
    ends = lambda df, by: df.groupBy(*by).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SAMPLES).drop("n")
    own = ends(energy, ["e", "episode_id", "camera"])
    mid = (F.col("a") + F.col("b")) / 2
    own = own.withColumn("x", F.greatest("a", mid - LAG_SPAN_S / 2)).withColumn("y", F.least("b", mid + LAG_SPAN_S / 2)).drop("a", "b")
    both = own.join(ends(act, ["episode_id"]), "episode_id").withColumn("t0", F.greatest("x", "a")).withColumn("t1", F.least("y", "b"))
    steps = F.ceil((F.col("t1") - F.col("t0")) * fps).cast("int")
    grid = both.withColumn("k", steps).where(F.col("k") >= MIN_SAMPLES).select("e", "episode_id", "camera", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.col("t0") + i / fps)).alias("i", "t"))
    ids = grid.select(F.col("e").alias("key"), "episode_id").distinct()
    one = lambda series: spectral.filtered_keyed(video.resampled(series, grid.select(F.col("e").alias("episode_id"), "t")), fps)
    a = one(act.join(ids, "episode_id").select(F.col("key").alias("episode_id"), "t", "v"))
    e = one(energy.select(F.col("e").alias("episode_id"), "t", "v"))
    pairs = a.withColumnRenamed("f", "x").join(e.withColumnRenamed("f", "y"), ["episode_id", "i"])
    found = video.best_lag(pairs, int(round(LAG_MAX_S * fps))).where(F.col("corr") >= m.MIN_LAG_CORR)
    return found.select(F.substring_index("episode_id", "|", 1).cast("long").alias("episode_id"), F.substring_index("episode_id", "|", -1).alias("camera"), F.abs(1000.0 * F.col("lag") / fps).alias("value"))
