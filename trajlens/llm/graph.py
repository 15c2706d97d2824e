"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

HOT, TASK_EDGES = 1000, 2_000_000


def joined_by(left: DataFrame, right: DataFrame, key: str, k: str = "k", hot: int = HOT) -> DataFrame:
    """left joined with right, which has one row a key and in column k (not returned) how often the key occurs in left.

    Rows of keys that occur more often than hot stay where they are and meet the few hot rows of right, a stored table
    whose size Spark knows: it sends it to all tasks while it is below its broadcast limit, and shuffles (splitting what
    is skewed) beyond it. Only the other keys' rows are dealt out by key.
    """
    few = stored(right.where(F.col(k) > hot).drop(k))
    if not few.take(1):
        return left.join(right.drop(k), key)
    near = left.join(few, key)
    return near.unionByName(left.join(few, key, "left_anti").join(right.drop(k), key))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every u has one edge, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return not ends.groupBy("x").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a + b > 1 and a > 0").take(1)


def _codes(nodes: pa.Array) -> np.ndarray:
    """Numbers in the order of the nodes, equal for equal ones."""
    codes = np.zeros(len(nodes), np.int64)
    for field in nodes.flatten() if pa.types.is_struct(nodes.type) else [nodes]:
        own, distinct = pd.factorize(field.to_pandas(), sort=True)
        codes = np.unique(codes * (len(distinct) + 1) + own, return_inverse=True)[1]
    return codes


def _smallest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of nodes 0 to n - 1 that each one's edges reach."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges u, v with the same components: each task's own edges (TASK_EDGES at a time) become stars around the smallest nodes, with smaller v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def out() -> pa.RecordBatch:
            nodes = pa.concat_arrays([b.column(i) for i in (0, 1) for b in held])
            code = _codes(nodes)
            label = _smallest(code[:waiting], code[waiting:], int(code.max()) + 1)
            place = np.unique(code, return_index=True)[1]
            far = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(place[far])), nodes.take(pa.array(place[label[far]]))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= TASK_EDGES:
                yield out()
                held, waiting = [], 0
        if held:
            yield out()

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that its edges reach) for every node of edges(u, v).

    Rounds of three steps: tasks contract the edges they read; every node's neighbours hang on the smallest of them (a
    node has one a task at most by then); pointers go to where their ends point. Connections stay, labels only fall, and
    it ends when all that is left are stars around roots. A hub is its neighbours' v, so no list of its neighbours is made;
    the join that moves pointers deals them out by it, and Spark splits such a partition where it finds it skewed.
    """
    now = stored(contracted(stored(edges.where(F.col("u") != F.col("v")).select("u", "v"))))
    while not _is_forest_of_stars(now):
        least = now.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))
        hung = least.select(F.explode(F.array_union("vs", F.array("u"))).alias("x"), "m").where(F.col("x") != F.col("m"))
        up = least.select(F.col("u").alias("m"), F.col("m").alias("to"))
        now = stored(contracted(stored(hung.join(up, "m", "left").select(F.col("x").alias("u"), F.coalesce("to", "m").alias("v")))))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
