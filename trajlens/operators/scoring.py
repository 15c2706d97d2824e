"""From raw metrics to a ranking: groups, robust fit, z-scores, worst signals, profile scores, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model as m
from ..storage import stored
from .quantiles import percentiles

KEY = ["group_label", "metric", "signal"]


def assign_groups(episodes: DataFrame, min_group: int = m.MIN_GROUP) -> DataFrame:
    """episode_id, group_label, basis: an episode's task where enough episodes share it, else pooled."""
    counts = episodes.groupBy("task_key").agg(F.count(F.lit(1)).alias("k"))
    df = episodes.join(counts, "task_key", "left")
    own = (F.coalesce("task_key", F.lit("")) != "") & (F.col("k") >= min_group)
    return df.select("episode_id", F.when(own, F.concat(F.lit("task:"), F.col("task_key"))).otherwise(m.POOLED).alias("group_label"), F.when(own, "task").otherwise("pooled").alias("basis"))


def fit(values: DataFrame) -> DataFrame:
    """Median, MAD and the two one-sided scales of each group, metric and signal of values(.., value)."""
    values = stored(values.select(*KEY, "value"))
    q = percentiles(values, KEY, "value", [0.25, 0.5, 0.75])
    dev = F.col("value") - F.col("q")[1]
    sides = F.array(F.struct(F.lit("mad").alias("side"), F.abs(dev).alias("d")), F.struct(F.when(dev > 0, "up").when(dev < 0, "down").alias("side"), F.abs(dev).alias("d")))
    away = values.join(q, KEY).select(*KEY, F.explode(sides).alias("s")).select(*KEY, "s.side", "s.d").where("side is not null")
    middle = percentiles(stored(away), [*KEY, "side"], "d", [0.5])
    tails = middle.groupBy(*KEY).agg(*[F.max(F.when(F.col("side") == side, F.col("q")[0])).alias(side) for side in ("mad", "up", "down")])
    scale = lambda gap, tail: F.when(gap > 0, gap * m.MAD_TO_STD).otherwise(F.coalesce(F.col(tail) / m.WARN_Z, F.lit(m.MIN_SCALE)))
    return q.join(tails, KEY).select(*KEY, F.col("q")[1].alias("median"), "mad", scale(F.col("q")[2] - F.col("q")[1], "up").alias("scale_high"), scale(F.col("q")[1] - F.col("q")[0], "down").alias("scale_low"), "n")


def _clip(z: Column) -> Column:
    return F.greatest(F.least(z, F.lit(m.Z_CLIP)), F.lit(-m.Z_CLIP))


def _among(column: str, names: list[str]) -> Column:
    return F.col(column).isin(names) if names else F.lit(False)


def z_scores(raw: DataFrame, groups: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """raw(episode_id, metric, signal, value) with group_label and z; positive is worse, flags have none.

    A signed metric's z is the distance from the median either way, over max(1.4826 MAD, 5 % of the median, 1e-9).
    """
    values = raw.join(groups.select("episode_id", "group_label"), "episode_id")
    lower = [x.name for x in m.METRICS if not x.higher_is_worse]
    signed = [x.name for x in m.METRICS if x.kind == "signed_z"]
    flags = [x.name for x in m.METRICS if x.kind == "flag"]
    df = values.where(~_among("metric", flags))
    df = df.join(fit(df) if stats is None else stats, KEY)
    away = F.col("value") - F.col("median")
    floor = F.greatest(m.MAD_TO_STD * F.col("mad"), m.SIGNED_FLOOR * F.abs("median"), F.lit(m.SIGNED_MIN))
    z = F.when(_among("metric", signed), F.abs(_clip(away / floor))).when(_among("metric", lower), _clip(-away / F.greatest("scale_low", F.lit(m.MIN_SCALE)))).otherwise(_clip(away / F.greatest("scale_high", F.lit(m.MIN_SCALE))))
    return df.select("episode_id", *KEY, "value", z.alias("z"))


def worst_signals(z: DataFrame, order: list[str] | None = None) -> DataFrame:
    """episode_id, group_label, metric, signal, z of the worst signal; at a tie the first in order, else by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("signal")) if order else F.lit(0)
    ranked = z.withColumn("o", -F.row_number().over(Window.partitionBy("episode_id", "metric").orderBy(place, "signal")))
    picked = F.max_by(F.struct("signal", "z", "value"), F.struct("z", "o")).alias("b")
    return ranked.groupBy("episode_id", "group_label", "metric").agg(picked).select("episode_id", "group_label", "metric", "b.signal", "b.z", "b.value")


def value_rows(raw: DataFrame) -> DataFrame:
    """episode_id, metric, value: of several signals the worst value."""
    lower = [x.name for x in m.METRICS if not x.higher_is_worse]
    both = raw.groupBy("episode_id", "metric").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    return both.select("episode_id", "metric", F.when(_among("metric", lower), F.col("lo")).otherwise(F.col("hi")).alias("value"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """groups with group_n, how many episodes the group has."""
    return groups.join(groups.groupBy("group_label").agg(F.count(F.lit(1)).alias("group_n")), "group_label")


def family_scores(worst: DataFrame) -> DataFrame:
    """episode_id, family, score (largest z of its scored metrics), n_flags: one row a family with values; worst first is descending score."""
    members = [(x.name, x.family) for x in m.METRICS if x.group]
    dim = worst.sparkSession.createDataFrame(members, "metric string, family string")  # one row a metric
    return worst.join(F.broadcast(dim), "metric").groupBy("episode_id", "family").agg(F.max("z").alias("score"), F.count_if(F.col("z") >= m.WARN_Z).alias("n_flags"))


def feature_matrix(worst: DataFrame) -> DataFrame:
    """grp, episode_id, x: z-scores of the scored metrics, gaps filled with the group's median; a metric that a group lacks is 0 for all its rows."""
    names = [x.name for x in m.METRICS if x.group and x.kind != "flag"]
    df = worst.where(F.col("metric").isin(names)).groupBy(F.col("group_label").alias("grp"), "episode_id").pivot("metric", names).agg(F.first("z"))
    long = worst.where(F.col("metric").isin(names) & F.col("z").isNotNull()).select(F.col("group_label").alias("grp"), "metric", "z")
    middle = percentiles(stored(long), ["grp", "metric"], "z", [0.5]).groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("q")[0].alias("v")))).alias("middle"))
    gap = lambda n: F.coalesce(F.col(f"`{n}`"), F.element_at("middle", n), F.lit(0.0))
    return df.join(middle, "grp").select("grp", "episode_id", F.array(*[gap(n) for n in names]).alias("x"))


def outliers(novelty: DataFrame, isolation: DataFrame, groups: DataFrame) -> DataFrame:
    """episode_id, iforest_score, novelty_knn, is_outlier: either score is at warn within its group. Information only."""
    long = isolation.select("episode_id", F.lit("iforest_score").alias("metric"), "value").unionByName(novelty.select("episode_id", F.lit("novelty_knn").alias("metric"), "value"))
    v = long.join(groups.select("episode_id", "group_label"), "episode_id").withColumn("signal", F.lit(""))
    z = v.join(fit(v), KEY).withColumn("z", _clip((F.col("value") - F.col("median")) / F.greatest("scale_high", F.lit(m.MIN_SCALE))))
    pick = lambda name, c: F.max(F.when(F.col("metric") == name, F.col(c)))
    return z.groupBy("episode_id").agg(pick("iforest_score", "value").alias("iforest_score"), pick("novelty_knn", "value").alias("novelty_knn"), (F.max("z") >= m.WARN_Z).cast("double").alias("is_outlier"))


def profile_table(spark: SparkSession, groups: list[str] | None = None) -> DataFrame:
    """metric, grp, weight, ordinal of the registry's groups (all without): a profile as profile_scores takes it, to be changed at will."""
    wanted = m.GROUPS if groups is None else groups
    members = [(x.name, x.group, x.weight, wanted.index(x.group)) for x in m.METRICS if x.group in wanted]
    return spark.createDataFrame(members, "metric string, grp string, weight double, ordinal int")  # one row a metric


def profile_scores(worst: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """episode_id, score, n_flags, driver, verdict: groups take the largest weighted z, the score the largest group.

    profile(metric, grp, weight, ordinal): which metrics count, in which group and how much; at a tie the group of the least ordinal drives.
    """
    dim = profile_table(worst.sparkSession) if profile is None else profile
    g = worst.join(F.broadcast(dim), "metric").groupBy("episode_id", "grp", "ordinal").agg(F.max(F.col("weight") * F.col("z")).alias("v"))
    per = g.groupBy("episode_id").agg(F.max("v").alias("score"), F.count_if(F.col("v") >= m.WARN_Z).alias("n_flags"), F.max_by("grp", F.struct("v", -F.col("ordinal"))).alias("driver"))
    return per.withColumn("verdict", severity(F.col("score")))


def severity(z: Column) -> Column:
    return F.when(z.isNull(), "unknown").when(z >= m.FAIL_Z, "fail").when(z >= m.WARN_Z, "warn").otherwise("pass")


def thresholds(stats: DataFrame, z: float = m.WARN_Z) -> DataFrame:
    """The raw value at which each metric reaches z, on its bad side."""
    lower = [x.name for x in m.METRICS if not x.higher_is_worse]
    bad = F.when(_among("metric", lower), F.col("median") - z * F.col("scale_low")).otherwise(F.col("median") + z * F.col("scale_high"))
    return stats.select(*KEY, bad.alias("warn_at"))


def bin_of(bins: DataFrame, at: float) -> DataFrame:
    """The bin of histogram(..) that holds a threshold: half open, the last one closed; none outside the range."""
    last = F.max("bin").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a few bins
    return bins.withColumn("last", last).where((F.col("lo") <= at) & ((F.col("hi") > at) | ((F.col("bin") == F.col("last")) & (F.col("hi") == at)))).drop("last")


def histogram(values: DataFrame, bins: int = 20) -> DataFrame:
    """bin, lo, hi, k over values(v): equal bins over the range, the last one closed; every bin has a row."""
    ends = values.agg(F.min("v").alias("a"), F.max("v").alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("a")) / ((F.col("b") - F.col("a")) / bins))).cast("int")
    counts = values.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("k"))  # ends is one row
    every = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("b") - F.col("a")) / bins
    return every.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("k", F.lit(0)).cast("long").alias("k"))
