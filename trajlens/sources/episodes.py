"""Episodes out of frame tables: one row a frame, ``episode_id, idx, action[, state]``, and one row an episode.

A frame table is any DataFrame with an episode key and an order; the adapters here view the order-line and event tables
as episodes. Frames are dealt by episode once; later windows and aggregates by episode reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FPS = 30.0
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STATE_DELAY = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_of(df: DataFrame, episode: str, order: list[str], vectors: dict[str, list[str]]) -> DataFrame:
    """Frames in order with dense vectors: episode_id, idx (from 0) and one array<double> a vector."""
    w = Window.partitionBy("episode_id").orderBy(*order)
    arrays = [F.array(*[F.col(c).cast("double") for c in cols]).alias(v) for v, cols in vectors.items()]
    return df.withColumn("episode_id", F.col(episode).cast("long")).select("episode_id", (F.row_number().over(w) - 1).alias("idx"), *arrays)


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], {"action": ["value"]})


def event_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, length, task_key: the most frequent event type, the smaller one at a tie."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode_id"), "event_type").count()
    best = F.min_by("event_type", F.struct(-F.col("count"), "event_type"))
    return counts.groupBy("episode_id").agg(F.sum("count").alias("length"), best.alias("task_key"))


def supplier_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """action: quantity, price, discount, tax; state: the action some frames before."""
    df = frames_of(table(spark, sf_dir, "lineitem"), "l_suppkey", LINE_ORDER, {"action": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]})
    w = Window.partitionBy("episode_id").orderBy("idx")
    return df.withColumn("state", F.coalesce(F.lag("action", STATE_DELAY).over(w), F.first("action").over(w)))


def supplier_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, source_id (nation), task_key (region)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").cast("long").alias("episode_id"), F.col("n_name").alias("source_id"), F.col("r_name").alias("task_key"))


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short episodes with repeated frame numbers: episode_id, idx (recorded order), frame_index, action."""
    w = Window.partitionBy("episode_id").orderBy(*LINE_ORDER)
    df = table(spark, sf_dir, "lineitem").withColumn("episode_id", F.col("l_orderkey").cast("long"))
    return df.select("episode_id", (F.row_number().over(w) - 1).alias("idx"), F.col("l_linenumber").cast("long").alias("frame_index"), F.array("l_quantity", "l_extendedprice").alias("action"))


def of_task(episodes: DataFrame, task: str | None) -> DataFrame:
    """The episodes of exactly this task; "" is no task, None is all."""
    return episodes if task is None else episodes.where(F.coalesce("task_key", F.lit("")) == task)


def selected(episodes: DataFrame, ids: list[int]) -> DataFrame:
    """The episodes of these ids with place, their place among the ids; unknown ids have no row."""
    order = episodes.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(ids))), "place int, episode_id long")
    return episodes.join(F.broadcast(order), "episode_id").orderBy("place")  # as many rows as a caller names
