"""Write-back: wide results, upserts that clear stale fields, temporal tags, run records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CONFIG_VERSION


def wide(values: DataFrame, metrics: list[str], prefix: str = "q_") -> DataFrame:
    """episode_id and one column a metric, from the long table; the columns are fixed so that plans don't depend on data."""
    df = values.groupBy("episode_id").pivot("metric", metrics).agg(F.first("value"))
    return df.select("episode_id", *[F.col(f"`{m}`").alias(prefix + m) for m in metrics])


def flatten(raw: DataFrame, worst: DataFrame, z: DataFrame, metrics: list[str], signals: list[str], prefix: str = "q_") -> DataFrame:
    """episode_id and, for each metric, its value, worst, z, worst signal and value on every signal; absent ones are null.

    raw(episode_id, metric, signal, value, worst), worst(.., metric, signal, z, value), z(.., metric, signal, value). The
    columns follow from the names given, never from the data.
    """
    chosen = worst.select("episode_id", "metric", F.col("signal").alias("s"), F.col("z").alias("top")).join(raw.select("episode_id", "metric", F.col("signal").alias("s"), "value", "worst"), ["episode_id", "metric", "s"])
    flags = raw.join(chosen.select("episode_id", "metric"), ["episode_id", "metric"], "left_anti").select("episode_id", "metric", "value")  # flags have no z
    is_ = lambda m: F.col("metric") == m
    per = chosen.groupBy("episode_id").agg(*[F.max(F.when(is_(m), F.col(c))).alias(f"{prefix}{m}{tail}") for m in metrics for c, tail in (("value", ""), ("worst", "_worst"), ("top", "_z"), ("s", "_signal"))])
    plain = flags.groupBy("episode_id").agg(*[F.max(F.when(is_(m), F.col("value"))).alias(f"flag_{m}") for m in metrics])
    on = z.groupBy("episode_id").agg(*[F.max(F.when(is_(m) & (F.col("signal") == s), F.col("value"))).alias(f"{prefix}{m}_on_{s}") for m in metrics for s in signals])
    df = per.join(plain, "episode_id", "full").join(on, "episode_id", "full")
    named = []
    for m in metrics:
        named.append(F.coalesce(f"{prefix}{m}", f"flag_{m}").alias(f"{prefix}{m}"))
        named.append(F.nullif(F.col(f"{prefix}{m}_signal"), F.lit("")).alias(f"{prefix}{m}_signal"))
        named += [F.col(f"{prefix}{m}{tail}") for tail in ("_worst", "_z")] + [F.col(f"{prefix}{m}_on_{s}") for s in signals]
    return df.select("episode_id", *named)


def write_run(path: str, stats: DataFrame, config: dict, fields: list[str], run_id: str) -> None:
    """The run that a dataset's scores come from, overwritten each time: its normalisation as a table, all else as one JSON row."""
    spark = stats.sparkSession
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    spark.createDataFrame([(run_id, json.dumps({"config_version": CONFIG_VERSION, **config}, sort_keys=True), fields)], "run_id string, config string, fields array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/run")


def read_run(spark: SparkSession, path: str) -> tuple[str, dict, list[str], DataFrame]:
    row = spark.read.schema("run_id string, config string, fields array<string>").json(f"{path}/run").first()
    return row["run_id"], json.loads(row["config"]), row["fields"], spark.read.parquet(f"{path}/stats")


def mixed_runs(results: DataFrame, column: str = "run_id") -> DataFrame:
    """One row: how many runs (or versions) the results come from, and whether they are mixed."""
    return results.agg(F.count_distinct(column).alias("runs"), (F.count_distinct(column) > 1).alias("mixed"))


def tag_selection(episodes: DataFrame, ids: DataFrame | None, tag: str) -> DataFrame:
    """episodes(episode_id, tags) with tag on those of ids(episode_id), on all where no ids are given."""
    if ids is None:
        return episodes.withColumn("tags", with_tag(F.col("tags"), tag, F.lit(True)))
    chosen = ids.select("episode_id", F.lit(True).alias("chosen")).distinct()
    df = episodes.join(chosen, "episode_id", "left")
    return df.withColumn("tags", F.when(F.col("chosen"), with_tag(F.col("tags"), tag, F.lit(True))).otherwise(F.col("tags"))).drop("chosen")


def upsert(old: DataFrame, new: DataFrame, key: str = "episode_id") -> DataFrame:
    """old with the fields of new on new's rows: fields that new lacks become null there, other rows keep theirs."""
    fields = list(dict.fromkeys([c for c in old.columns if c != key] + [c for c in new.columns if c != key]))
    mine = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    df = old.join(mine, old[key] == mine["_k"], "left")
    scored = F.col("_k").isNotNull()

    def field(c: str) -> Column:
        fresh = F.col(f"_n_{c}") if c in new.columns else F.lit(None)
        return F.when(scored, fresh).otherwise(old[c] if c in old.columns else F.lit(None)).alias(c)

    return df.select(old[key], *[field(c) for c in fields])


def temporal_tags(spans: DataFrame) -> DataFrame:
    """spans(episode_id, start_s, end_s, label, severity) -> episode_id, start_ns, end_ns, tag; never of zero length."""
    ns = lambda c: F.rint(F.col(c) * 1e9).cast("long")
    tag = F.concat_ws(":", "label", "severity")
    return spans.select("episode_id", ns("start_s").alias("start_ns"), F.greatest(ns("end_s"), ns("start_s") + 1).alias("end_ns"), tag.alias("tag"))


def replace_own_tags(old: DataFrame, new: DataFrame, anchor: str, scope: DataFrame) -> DataFrame:
    """old without this anchor's tags on the episodes in scope, with new's; tags of other anchors stay."""
    mine = scope.select("episode_id").distinct().withColumn("anchor", F.lit(anchor))
    return old.join(mine, ["episode_id", "anchor"], "left_anti").unionByName(new.withColumn("anchor", F.lit(anchor)).select(*old.columns))


def with_tag(tags: Column, tag: str, present: Column) -> Column:
    """A tag set with tag added where present, else removed."""
    base = F.coalesce(tags, F.array().cast("array<string>"))
    return F.sort_array(F.when(present, F.array_union(base, F.array(F.lit(tag)))).otherwise(F.array_remove(base, tag)))
