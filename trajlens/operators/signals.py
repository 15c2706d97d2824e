"""Signals out of frames: ranges, speeds, accelerations, gripper states; windows by episode, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import GRIPPER_HIGH, GRIPPER_LOW
from ..storage import stored
from .quantiles import DIRECT, percentiles


WIDE = 64  # dimensions of a vector whose ranges are columns of one pass


def long_form(frames: DataFrame, vector: str = "action", dims: list[int] | None = None) -> DataFrame:
    """episode_id, idx, dim, x; non-finite values become null."""
    df = frames.select("episode_id", "idx", F.posexplode(vector).alias("dim", "x"))
    df = df.where(F.col("dim").isin(dims)) if dims is not None else df
    return df.withColumn("x", F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x")))


def joint_ranges(values: DataFrame) -> DataFrame:
    """episode_id, dim, rng: the 5th to 95th percentile range; 1 where it is nearly 0 or a value isn't finite."""
    p = F.percentile("x", F.array(F.lit(0.05), F.lit(0.95)))
    spread = (F.col("p")[1] - F.col("p")[0]).alias("r")
    df = values.groupBy("episode_id", "dim").agg(p.alias("p"), F.count_if(F.col("x").isNull()).alias("bad"))
    return df.select("episode_id", "dim", F.when((F.col("bad") > 0) | (spread <= 1e-9), 1.0).otherwise(spread).alias("rng"))


def normalized(values: DataFrame) -> DataFrame:
    """values with x over its joint's range as u."""
    return values.join(joint_ranges(values), ["episode_id", "dim"]).withColumn("u", F.col("x") / F.col("rng"))


def with_units(frames: DataFrame, vectors: tuple[str, ...] = ("action", "state"), declared: DataFrame | None = None) -> DataFrame:
    """frames with u_<vector>, each dimension over its range: one row a frame, ranges as one array an episode.

    declared(episode_id, vector, ranges): the ranges that the episode's source declares, used where they are as many as the
    vector has dimensions; a declared range that isn't above 1e-9 is 1. All others are the episode's own (joint_ranges).
    """
    out = frames = stored(frames)
    vectors = tuple(v for v in vectors if v in frames.columns)
    per = frames.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.size(v)).alias(v) for v in vectors])
    longest, *most = per.agg(F.max("n"), *[F.max(v) for v in vectors]).first()
    if (longest or 0) <= DIRECT and max((x or 0 for x in most), default=0) <= WIDE:
        return _with_own_units(frames, dict(zip(vectors, (x or 0 for x in most))), declared)
    for v in vectors:
        x = stored(long_form(frames, v))
        bad = x.groupBy("episode_id", "dim").agg(F.count_if(F.col("x").isNull()).alias("bad"))
        own = bad.join(percentiles(x, ["episode_id", "dim"], "x", [0.05, 0.95]), ["episode_id", "dim"], "left")
        spread = F.col("q")[1] - F.col("q")[0]
        own = own.withColumn("rng", F.when((F.col("bad") > 0) | spread.isNull() | (spread <= 1e-9), 1.0).otherwise(spread))
        ranges = own.groupBy("episode_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "rng"))), lambda s: s.rng).alias("own"))  # one number a dimension
        out = _over_ranges(out.join(ranges, "episode_id", "left"), v, declared)
    return out


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def mean_of(vector: str, dims: list[int]) -> Column:
    """The mean of a frame's finite values of these dimensions."""
    xs = [finite(F.get(vector, F.lit(d))) for d in dims]
    if len(xs) == 1:
        return xs[0]
    return sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0))) / F.nullif(sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int")), F.lit(0))


def _over_ranges(df: DataFrame, v: str, declared: DataFrame | None) -> DataFrame:
    """df(.., own: the ranges of v's dimensions) with u_<v> in place of own."""
    if declared is not None:
        said = declared.where(F.col("vector") == v).select("episode_id", F.transform("ranges", lambda r: F.when(r > 1e-9, r).otherwise(1.0)).alias("said"))
        df = df.join(said, "episode_id", "left").withColumn("own", F.when(F.size("said") == F.size("own"), F.col("said")).otherwise(F.col("own"))).drop("said")
    return df.withColumn(f"u_{v}", F.zip_with(F.transform(v, finite), "own", lambda c, r: c / r)).drop("own")


def _with_own_units(frames: DataFrame, sizes: dict[str, int], declared: DataFrame | None) -> DataFrame:
    """with_units of episodes whose values fit a buffer: ranges are found where an episode's frames lie, so frames are dealt out once."""
    every = Window.partitionBy("episode_id")
    names, columns = list(frames.columns), {}
    for v, size in sizes.items():
        for d in range(size):
            x = finite(F.get(v, F.lit(d)))
            columns[f"_q_{v}_{d}"] = F.percentile(x, F.array(F.lit(0.05), F.lit(0.95))).over(every)
            columns[f"_b_{v}_{d}"] = F.count_if((F.size(v) > d) & x.isNull()).over(every)
        columns[f"_n_{v}"] = F.max(F.size(v)).over(every)
    df = frames.withColumns(columns) if columns else frames
    for v, size in sizes.items():
        spread = [F.col(f"_q_{v}_{d}")[1] - F.col(f"_q_{v}_{d}")[0] for d in range(size)]
        own = F.array(*[F.when((F.col(f"_b_{v}_{d}") > 0) | x.isNull() | (x <= 1e-9), 1.0).otherwise(x) for d, x in enumerate(spread)]).cast("array<double>")
        names = [*names, f"u_{v}"]
        df = _over_ranges(df.withColumn("own", F.when(F.col(f"_n_{v}") > 0, F.slice(own, F.lit(1), F.col(f"_n_{v}")))), v, declared)
    return df.select(*names)


def units(frames: DataFrame, vector: str, dims: list[int] | None = None) -> DataFrame:
    """episode_id, idx, dim, u: the vector's normalised values, from u_<vector> where the frames have it."""
    if f"u_{vector}" not in frames.columns:
        return normalized(long_form(frames, vector, dims)).select("episode_id", "idx", "dim", "u")
    df = frames.select("episode_id", "idx", F.posexplode(f"u_{vector}").alias("dim", "u"))
    return df.where(F.col("dim").isin(dims)) if dims is not None else df


def _large(frames: DataFrame, vector: str, dims: list[int]) -> DataFrame:
    """Frames whose vector has all of these dimensions."""
    return frames.where(F.size(vector) > max(dims, default=0))


def group_speed(frames: DataFrame, dims: list[int], fps: float, least: int = 3) -> DataFrame:
    """episode_id, i (0 is the move from frame 0 to 1), speed: the norm of the group's normalised steps a second.

    Episodes of fewer than `least` frames, or whose action lacks a dimension of the group, have none.
    """
    frames = _large(frames, "action", dims)
    w = Window.partitionBy("episode_id").orderBy("idx")
    n = F.count(F.lit(1)).over(Window.partitionBy("episode_id"))
    if "u_action" in frames.columns:
        step = [(F.col("u_action")[d] - F.lag(F.col("u_action")[d]).over(w)) * fps for d in dims]
        whole = F.coalesce(*step).isNotNull()  # a step without any value is none
        square = F.when(whole, sum((F.coalesce(x * x, F.lit(0.0)) for x in step[1:]), F.coalesce(step[0] * step[0], F.lit(0.0))))
        df = frames.select("episode_id", (F.col("idx") - 1).alias("i"), F.sqrt(square).alias("speed"), n.alias("n"))
        return df.where((F.col("i") >= 0) & (F.col("n") >= least)).drop("n")
    v = Window.partitionBy("episode_id", "dim").orderBy("idx")
    df = frames.withColumn("n", n).where(F.col("n") >= least).drop("n")
    u = units(df, "action", dims).withColumn("d", (F.col("u") - F.lag("u").over(v)) * fps).where("idx > 0")
    return u.groupBy("episode_id", (F.col("idx") - 1).alias("i")).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("speed"))


def acceleration(frames: DataFrame, dims: list[int], fps: float, vector: str = "state") -> DataFrame:
    """episode_id, dim, i, acc: absolute second difference of the normalised values a squared second."""
    frames = _large(frames, vector, dims)
    if f"u_{vector}" in frames.columns:
        w = Window.partitionBy("episode_id").orderBy("idx")
        x = lambda d, k: F.lag(F.col(f"u_{vector}")[d], k).over(w) if k else F.col(f"u_{vector}")[d]
        second = F.array(*[F.struct(F.lit(d).alias("dim"), (F.abs(x(d, 0) - 2 * x(d, 1) + x(d, 2)) * fps * fps).alias("acc")) for d in dims])
        df = frames.select("episode_id", "idx", second.alias("s")).where("idx > 1").select("episode_id", "idx", F.explode("s").alias("s"))
        return df.select("episode_id", "s.dim", (F.col("idx") - 2).alias("i"), "s.acc")
    w = Window.partitionBy("episode_id", "dim").orderBy("idx")
    u = units(frames, vector, dims)
    second = F.col("u") - 2 * F.lag("u", 1).over(w) + F.lag("u", 2).over(w)
    return u.withColumn("acc", F.abs(second) * fps * fps).where("idx > 1").select("episode_id", "dim", (F.col("idx") - 2).alias("i"), "acc")


def gripper_unit(frames: DataFrame, dims: list[int]) -> DataFrame:
    """episode_id, idx, unit: the gripper's mean position within its own range; episodes whose gripper stays are left out."""
    every = Window.partitionBy("episode_id")
    g = _large(frames, "action", dims).select("episode_id", "idx", mean_of("action", dims).alias("g"))
    g = g.withColumn("lo", F.min("g").over(every)).withColumn("hi", F.max("g").over(every)).where("hi - lo > 1e-9")
    return g.select("episode_id", "idx", ((F.col("g") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("unit"))


def gripper_states(unit: DataFrame) -> DataFrame:
    """unit with state and before: the gripper's state at each frame and at the one before, with hysteresis carried forward by a window."""
    w = Window.partitionBy("episode_id").orderBy("idx")
    said = F.when(F.col("unit") < GRIPPER_LOW, 0).when(F.col("unit") > GRIPPER_HIGH, 1)
    first = F.first("unit").over(w) >= 0.5
    state = F.coalesce(F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), first.cast("int"))
    df = unit.withColumn("state", state)
    before = F.coalesce(F.lag("state").over(w), (F.first("unit").over(w) >= 0.5).cast("int"))
    return df.withColumn("before", before)


def gripper_transitions(unit: DataFrame) -> DataFrame:
    """episode_id, idx, opens_high: places where the state flips."""
    return gripper_states(unit).where("state <> before").select("episode_id", "idx", (F.col("unit") > 0.5).alias("high"))


def windows(speed: DataFrame, fps: float, seconds: float, least: int) -> DataFrame:
    """speed with win, size: the complete windows (half overlapping) that hold each sample; one where an episode is short."""
    size, n = max(least, round(seconds * fps)), F.count(F.lit(1)).over(Window.partitionBy("episode_id"))
    step = max(1, size // 2)
    df = speed.withColumn("n", n).where(F.col("n") >= least)
    last = F.floor((F.col("n") - size) / step)
    lo, hi = F.greatest(F.ceil((F.col("i") - size + 1) / step), F.lit(0)), F.least(F.floor(F.col("i") / step), last)
    many = F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.expr("cast(array() as array<bigint>)"))
    df = df.withColumn("win", F.explode(F.when(F.col("n") < size, F.array(F.lit(0).cast("long"))).otherwise(many)))
    return df.withColumn("size", F.least(F.col("n"), F.lit(size)))
