"""Metrics that need all episodes: leverage on the normalisation, divergence from peers, novelty, majority schema, balance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model as m
from ..storage import stored
from .neighbors import nearest_foreign
from .signals import long_form, with_units

BY = "episode_id"
SCORED_ROWS = 65_536


def stats_leverage(frames: DataFrame, sources: DataFrame, vectors: tuple[str, ...] = ("action", "state")) -> DataFrame:
    """episode_id, leverage: dimensions that an episode alone stretches by over 5 % of its source's other episodes' range.

    The others' extremes come from the two smallest and two largest values of a source: without the own value, the next.
    """
    parts = [long_form(frames, v).withColumn("vector", F.lit(v)) for v in vectors]
    x = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    own = x.groupBy(BY, "vector", "dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).join(sources.select(BY, "source_id"), BY)
    key = ["source_id", "vector", "dim"]
    first = own.groupBy(*key).agg(F.count(F.lit(1)).alias("k"), F.min("lo").alias("l1"), F.max("hi").alias("h1")).where("k >= 3")
    df = own.join(first, key)
    second = df.groupBy(*key).agg(F.count_if(F.col("lo") == F.col("l1")).alias("nl"), F.count_if(F.col("hi") == F.col("h1")).alias("nh"), F.min(F.when(F.col("lo") > F.col("l1"), F.col("lo"))).alias("l2"), F.max(F.when(F.col("hi") < F.col("h1"), F.col("hi"))).alias("h2"))
    df = df.join(second, key)
    lo = F.when((F.col("lo") == F.col("l1")) & (F.col("nl") == 1), F.col("l2")).otherwise(F.col("l1"))
    hi = F.when((F.col("hi") == F.col("h1")) & (F.col("nh") == 1), F.col("h2")).otherwise(F.col("h1"))
    df = df.withColumn("olo", lo).withColumn("ohi", hi).withColumn("span", F.greatest(F.col("ohi") - F.col("olo"), F.lit(1e-9)))
    beyond = (F.col("lo") < F.col("olo") - m.LEVERAGE_MARGIN * F.col("span")) | (F.col("hi") > F.col("ohi") + m.LEVERAGE_MARGIN * F.col("span"))
    return df.groupBy(BY).agg(F.count_if(beyond).alias("leverage"))


def aux_sample(frames: DataFrame, k: int = m.AUX_FRAMES) -> DataFrame:
    """episode_id, j, action, state: at most k evenly spaced frames, range-normalised; episodes with a value that isn't finite have none."""
    frames = frames if "u_action" in frames.columns else with_units(frames.select(BY, "idx", "action", "state"))
    broken = lambda v: F.col(v).isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n = frames.groupBy(BY).agg(F.count(F.lit(1)).alias("n"), F.count_if(broken("action") | broken("state")).alias("bad")).where("n >= 2 and bad = 0").withColumn("k", F.least("n", F.lit(k)))
    picks = n.select(BY, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.when(j == F.col("k") - 1, F.col("n") - 1).otherwise(F.floor(j * ((F.col("n") - 1) / (F.col("k") - 1)))))).alias("j", "idx"))
    return frames.join(picks, [BY, "idx"]).select(BY, "j", F.col("u_action").alias("action"), F.col("u_state").alias("state"))


def action_divergence(aux: DataFrame, groups: DataFrame, k: int = m.NEIGHBORS) -> DataFrame:
    """episode_id, value: how far an episode's actions are from those of its nearest peers in state space.

    groups(episode_id, grp[, robot]). Peers share group, robot and the sizes of state and action; fewer than MIN_PEERS have
    no value. Of an episode at most 32 frames are compared (aux_sample), each with its k nearest frames of other episodes.
    """
    robot = F.col("robot") if "robot" in groups.columns else F.lit(None).cast("string")
    rows = aux.join(groups.select(BY, F.col("grp").alias("label"), robot.alias("robot")), BY)
    peers = F.struct("label", "robot", F.size("state").alias("n_state"), F.size("action").alias("n_action"))
    rows = rows.withColumn("grp", F.to_json(peers))
    enough = rows.groupBy("grp").agg(F.count_distinct(BY).alias("e")).where(F.col("e") >= m.MIN_PEERS).select("grp")
    points = stored(rows.join(enough, "grp").select("grp", F.col(BY).alias("owner"), F.col("j").cast("int").alias("item"), F.col("state").alias("x"), F.col("action").alias("y")))
    per = nearest_foreign(points, k).groupBy("owner", "item").agg(F.avg("gap").alias("g"))
    return per.groupBy(F.col("owner").alias(BY)).agg(F.avg("g").alias("value"))


def novelty(points: DataFrame, k: int = m.NEIGHBORS, least: int = m.MIN_OUTLIER_GROUP) -> DataFrame:
    """episode_id, value: mean distance to the k nearest others of points(grp, episode_id, x) in groups of at least `least`."""
    enough = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("grp")
    rows = points.join(enough, "grp").select("grp", F.col(BY).alias("owner"), F.lit(0).alias("item"), "x", F.array().cast("array<double>").alias("y"))
    return nearest_foreign(stored(rows), k).groupBy(F.col("owner").alias(BY)).agg(F.avg(F.sqrt("d")).alias("value"))


def majority_schema(signatures: DataFrame) -> DataFrame:
    """signatures(episode_id, sig) -> episode_id, mismatch, mixed: who differs from the most common signature.

    Below half of all episodes the dataset is mixed and nobody is flagged; at a tie the smaller signature is the majority.
    """
    counts = stored(signatures.groupBy("sig").agg(F.count(F.lit(1)).alias("k")))
    most = counts.agg(F.max("k").alias("k"), F.sum("k").alias("n"))
    top = counts.join(F.broadcast(most), "k").agg(F.min("sig").alias("main"), F.first(F.col("k") / F.col("n")).alias("share"))  # one row each
    df = signatures.crossJoin(F.broadcast(top))
    mixed = F.col("share") < m.MIXED_SHARE
    return df.select(BY, (~mixed & (F.col("sig") != F.col("main"))).cast("long").alias("mismatch"), mixed.alias("mixed"))


def balance(episodes: DataFrame) -> DataFrame:
    """dimension, key, k, under_covered, dominant for tasks and sources."""
    total = episodes.agg(F.count(F.lit(1)).alias("n"))
    one = lambda c: episodes.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("k")).select(F.lit(c).alias("dimension"), "key", "k")
    df = one("task_key").unionByName(one("source_id")).crossJoin(F.broadcast(total))  # one row
    return df.select("dimension", "key", "k", (F.col("k") < m.UNDER_COVERED).alias("under_covered"), (F.col("k") > m.DOMINANT_SHARE * F.col("n")).alias("dominant"))


def isolation_scores(points: DataFrame, trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """episode_id, value: isolation forest anomaly scores (0 to 1) of points(grp, episode_id, x).

    Trees grow on the rows with the smallest keyed hashes of each tree and group (the forest's own bounded sample); all
    rows are scored. Groups below the least size have no score.
    """
    sizes = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= m.MIN_OUTLIER_GROUP)
    rows = points.join(sizes, "grp")
    share = F.least(F.lit(1.0), 4.0 * sample / F.col("n"))
    # only the trees that draw a row see it: hashes are compared before rows are copied
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(BY, t, F.lit(seed)).alias("h"))), lambda s: F.pmod(s.h, F.lit(1_000_000)) / 1_000_000 < share)
    each = rows.select("grp", BY, "x", F.explode(drawn).alias("s")).select("grp", BY, "x", "s.tree", "s.h")
    picked = each.withColumn("r", F.row_number().over(Window.partitionBy("grp", "tree").orderBy("h"))).where(F.col("r") <= sample)

    def grow(key, own: pd.DataFrame) -> pd.DataFrame:
        x, rng = np.stack(own.sort_values("h")["x"].tolist()), np.random.default_rng([seed, int(key[1])])
        limit, nodes, stack = int(np.ceil(np.log2(max(2, len(x))))), [], [(np.arange(len(x)), 0, -1, 0)]
        while stack:
            at, depth, parent, side = stack.pop()
            node = len(nodes)
            if parent >= 0:
                nodes[parent][side] = node
            spread = np.ptp(x[at], axis=0) if len(at) else np.zeros(x.shape[1])
            if depth >= limit or len(at) <= 1 or not spread.max() > 0:
                size = len(at)
                extra = 2 * (np.log(size - 1) + 0.5772156649) - 2 * (size - 1) / size if size > 2 else float(size == 2)
                nodes.append([-1, -1, -1.0, depth + extra, -1])
                continue
            dim = int(rng.choice(np.flatnonzero(spread > 0)))
            cut = float(rng.uniform(x[at, dim].min(), x[at, dim].max()))
            nodes.append([-1, -1, cut, 0.0, dim])
            below = x[at, dim] < cut
            stack += [(at[below], depth + 1, node, 0), (at[~below], depth + 1, node, 1)]
        return pd.DataFrame({"grp": [key[0]], "tree": [int(key[1])], "size": [len(x)], "nodes": [[list(map(float, n)) for n in nodes]]})

    grp = points.schema["grp"].dataType.simpleString()
    forest = picked.groupBy("grp", "tree").applyInPandas(grow, f"grp {grp}, tree int, size int, nodes array<array<double>>")
    # a task holds one block of rows and its group's forest (`trees` trees of at most 2*sample nodes)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(BY), F.ceil(F.col("n") / SCORED_ROWS)).cast("int")).select("grp", "block", BY, "x")
    woods = forest.join(sizes.select("grp", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SCORED_ROWS).cast("int") - 1)).alias("block")), "grp").select("grp", "block", "size", "nodes")

    def walk(_key, own: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(forest):
            return pd.DataFrame({BY: [], "value": []}).astype({BY: "int64"})
        x, depth, norm = np.stack(own["x"].tolist()), np.zeros(len(own)), 0.0
        for size, listed in zip(forest["size"], forest["nodes"]):
            nodes = np.array([np.asarray(n) for n in listed])
            at = np.zeros(len(x), dtype=np.int64)
            while (live := np.flatnonzero(nodes[at, 4] >= 0)).size:
                here = nodes[at[live]]
                left = x[live, here[:, 4].astype(int)] < here[:, 2]
                at[live] = np.where(left, here[:, 0], here[:, 1]).astype(int)
            depth += nodes[at, 3]
            norm += 2 * (np.log(size - 1) + 0.5772156649) - 2 * (size - 1) / size if size > 2 else 1.0
        return pd.DataFrame({BY: own[BY], "value": 2 ** (-depth / norm)})

    return rows.groupBy("grp", "block").cogroup(woods.groupBy("grp", "block")).applyInPandas(walk, f"{BY} long, value double")
