"""Exact top-k search by inner product: a KD-tree per shard, best-first, with the kth score handed on.

1. Shards are parts of space: a bounded sample (SAMPLE_ROWS rows, the smallest hashes) gives median splits, and every row
   goes to the part that it falls into. A part that no split can make small enough (rows that are all alike) is dealt to
   several shards by id. There are at most MAX_SHARDS shards or so, however large the table.
2. Each shard's task builds its KD-tree once (median split on the widest side) and stores its leaves in the tree's order
   with their tight bounding boxes; the boxes above are minima and maxima of neighbours.
3. The table of the shards' own boxes (one row a shard) goes to the tasks. A query first asks the shard whose box promises
   most; its kth score there goes with it to those other shards alone whose box can reach it. A box promises the sum over
   sides of max(q*lo, q*hi). Within a shard the search is best-first, and ends when no box can beat the kth score.

Queries of a shard travel in blocks of at most about QUERY_BLOCK, and a shard's leaves are copied once a block that asks it, so a
task holds one shard and one block. Ties go to the smaller id, so boxes that only equal the kth score are still opened.

Cases: components become floor(scale * x) as longs (beyond 2**53 they are clipped there, scores at the limits of long);
vectors that are null, or hold null or non-finite components, take no part; vectors of another length are never
compared; the empty vector scores 0. Rows that repeat (same id and vector) count once; a row with the query's own id is
never its candidate. Null ids take no part. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK, SAMPLE_ROWS, MAX_SHARDS = 8192, 64, 4096, 20_000, 8192
LIMIT, NOTHING = float(2**53), -(2**63)
FOUND = "query_id long, vec_id long, score long"
LEAF = "shard int, dim int, leaf int, lo array<long>, hi array<long>, ids array<long>, v array<long>, all_lo array<long>, all_hi array<long>"


def _matrix(vectors: list | pd.Series, dim: int) -> np.ndarray:
    return np.array([np.asarray(v) for v in vectors], dtype=np.int64).reshape(len(vectors), dim)


def _exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The matrices as doubles where products stay below 2**53, else as Python integers."""
    peak = max((int(np.abs(p).max()) for p in parts if p.size), default=0)
    fine = peak**2 * max(1, parts[0].shape[1]) < 2**53
    return [p.astype(np.float64 if fine else object) for p in parts]


class Space:
    """Parts of space by median splits of a sample; parts of rows that are alike are dealt to several shards by id."""

    def __init__(self, sample: list[np.ndarray], rows: int, shard_rows: int):
        """sample: matrices of one length each; rows: how many the whole table has."""
        self.trees: dict[int, tuple[np.ndarray, ...]] = {}
        every = sum(len(m) for m in sample)
        enough = max(1, -(-every * shard_rows // max(1, rows)), -(-every // MAX_SHARDS))  # sampled rows of a shard
        self.shards = 0
        for m in sample:
            side, cut, child, first, deal = [], [], [], [], []
            stack = [(np.arange(len(m)), -1, 0)]
            while stack:
                own, parent, which = stack.pop()
                if parent >= 0:
                    child[parent][which] = len(side)
                part = m[own]
                width = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(m.shape[1])
                widest = int(width.argmax()) if width.size else 0
                at = np.sort(part[:, widest])[len(part) // 2] if width.size and width[widest] > 0 else None
                if at is not None and at == part[:, widest].min():
                    at += 1  # more than half are at the least value: what is above it goes right
                child.append([-1, -1])
                if len(own) <= enough or at is None:
                    side.append(0), cut.append(0), first.append(self.shards), deal.append(-(-len(own) // enough))
                    self.shards += max(1, deal[-1])
                    continue
                side.append(widest), cut.append(int(at)), first.append(0), deal.append(0)
                left = part[:, widest] < at
                stack += [(own[~left], len(side) - 1, 1), (own[left], len(side) - 1, 0)]
            self.trees[m.shape[1]] = tuple(np.array(x, dtype=np.int64) for x in (side, cut, child, first, deal))
        self.rest = self.shards  # lengths that the sample doesn't have
        self.shards += 1

    def shard(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if vectors.shape[1] not in self.trees:
            return np.full(len(ids), self.rest)
        side, cut, child, first, deal = self.trees[vectors.shape[1]]
        node, rows = np.zeros(len(ids), np.int64), np.arange(len(ids))
        while (inner := child[node, 0] >= 0).any():
            at = node[inner]
            node[inner] = child[at, (vectors[rows[inner], side[at]] >= cut[at]).astype(int)]
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return first[node] + (mixed % np.maximum(deal[node], 1).astype(np.uint64)).astype(np.int64)


def leaves_of(vectors: np.ndarray) -> list[np.ndarray]:
    """Rows of each leaf in the order of the tree."""
    out, stack = [], [np.arange(len(vectors))]
    while stack:
        rows = stack.pop()
        own = vectors[rows]
        width = own.max(axis=0) - own.min(axis=0)
        if len(rows) <= LEAF_ROWS or not width.size or width.max() == 0:  # equal vectors stay together: no box can be tighter
            out += [rows[k : k + LEAF_ROWS] for k in range(0, len(rows), LEAF_ROWS)]
            continue
        by = own[:, width.argmax()].argsort(kind="stable")
        half = len(rows) // 2
        stack += [rows[by[half:]], rows[by[:half]]]
    return out


class KDTree:
    """A shard's leaves and the boxes above them: nodes by level, each over two neighbours of the level below."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, ids: list[np.ndarray], vectors: list[np.ndarray]):
        self.ids, self.vectors, self.children = ids, vectors, [None] * len(lo)
        los, his, level = [lo], [hi], np.arange(len(lo))
        while len(level) > 1:
            base, below_lo, below_hi = level[-1] + 1, los[-1], his[-1]
            pairs = np.arange(0, len(level), 2)
            los.append(np.minimum.reduceat(below_lo, pairs, axis=0))
            his.append(np.maximum.reduceat(below_hi, pairs, axis=0))
            self.children += [level[p : p + 2].tolist() for p in pairs]
            level = base + np.arange(len(pairs))
        self.lo, self.hi = np.concatenate(los), np.concatenate(his)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, kth: list[int]) -> list[list[tuple[int, int]]]:
        """For each query up to k (score, -id), best first, of those at or above the kth score handed in."""
        out = []
        for start in range(0, len(queries), 256):
            part = queries[start : start + 256]
            bound = promised(part, self.lo, self.hi)
            out += [self._best(part[i], bound[i], own[start + i], k, kth[start + i]) for i in range(len(part))]
        return out

    def _best(self, query: np.ndarray, bound: np.ndarray, own: int, k: int, floor: int) -> list[tuple[int, int]]:
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its least is the kth
        heap = [(-bound[-1], len(bound) - 1)]
        while heap:
            most, node = heapq.heappop(heap)
            if -most < floor:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            scores = self.vectors[node] @ query
            for i in np.flatnonzero(scores >= floor):
                if (vec := int(self.ids[node][i])) == own:
                    continue
                item = (int(scores[i]), -vec)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    floor = max(floor, best[0][0])
        return sorted(best, reverse=True)


def promised(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The most that any vector of each box can score with each query."""
    return np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T


def integer_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) as longs; null where the vector takes no part."""
    x = vector.cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.greatest(F.least(F.floor(v * scale).cast("double"), F.lit(LIMIT)), F.lit(-LIMIT)).cast("long")))


def _leaf_frame(rows: pd.DataFrame) -> pd.DataFrame:
    """The leaves of one shard."""
    shard, frames = int(rows["shard"].iloc[0]), []
    for dim, group in rows.groupby(rows["v"].map(len)):  # lengths that the sample hadn't share a shard
        v, ids = _matrix(group["v"], dim), group["vec_id"].to_numpy()
        own = leaves_of(v)
        frames.append(pd.DataFrame({
            "shard": shard, "dim": dim, "leaf": range(len(own)), "lo": [v[r].min(axis=0) for r in own], "hi": [v[r].max(axis=0) for r in own], "ids": [ids[r] for r in own], "v": [v[r].ravel() for r in own],
            "all_lo": [v.min(axis=0)] + [None] * (len(own) - 1), "all_hi": [v.max(axis=0)] + [None] * (len(own) - 1),
        }))
    return pd.concat(frames)


def _searched(leaves: pd.DataFrame, asked: pd.DataFrame, k: int) -> Iterator[tuple[int, int, int]]:
    dim = int(asked["dim"].iloc[0])
    leaves = leaves.sort_values("leaf")
    sizes = [len(x) for x in leaves["ids"]]
    q, v, lo, hi = _exact(_matrix(asked["v"], dim), _matrix(np.concatenate([np.zeros(0, np.int64), *leaves["v"]]).reshape(-1, dim) if dim else [[]] * sum(sizes), dim), _matrix(leaves["lo"], dim), _matrix(leaves["hi"], dim))
    tree = KDTree(lo, hi, list(leaves["ids"]), np.split(v, np.cumsum(sizes)[:-1]))
    for query, best in zip(asked["query_id"], tree.search(q, asked["query_id"].to_numpy(), k, [int(x) for x in asked["kth"]])):
        for score, minus in best:
            yield int(query), -minus, max(min(score, 2**63 - 1), NOTHING)


def routed(queries: DataFrame, boxes, first: bool) -> DataFrame:
    """queries(query_id, v, dim, kth, asked) with the shard to ask: the most promising one, or all others that reach kth."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, group in frame.groupby("dim"):
                shards, lo, hi = boxes.value[dim]
                for at in range(0, len(group), 512):
                    part = group.iloc[at : at + 512]
                    q, low, high = _exact(_matrix(part["v"], dim), lo, hi)
                    bound = promised(q, low, high)
                    if first:
                        yield part.assign(shard=shards[bound.argmax(axis=1)])
                        continue
                    reach = (bound >= part["kth"].to_numpy().astype(object if bound.dtype == object else float)[:, None]) & (shards[None] != part["asked"].to_numpy()[:, None])
                    row, to = np.nonzero(reach)
                    yield part.iloc[row].assign(shard=shards[to])

    return queries.mapInPandas(run, "query_id long, v array<long>, dim int, kth long, asked int, shard int")


def top_k(table: DataFrame, is_query: Column, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), integer_components(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("v is not null and vec_id is not null").groupBy("vec_id", "v").agg(F.max("asks").alias("asks"))
    rows = stored(rows.withColumn("dim", F.size("v")))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    space = spark.sparkContext.broadcast(Space([_matrix(v, d) for d, v in sorted(by_dim.items())], rows.count(), shard_rows))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, group in frame.groupby("dim"):
                yield pd.DataFrame({"vec_id": group["vec_id"], "v": group["v"], "shard": space.value.shard(_matrix(group["v"], dim), group["vec_id"].to_numpy())})

    dealt = rows.select("vec_id", "v", "dim").mapInPandas(deal, "vec_id long, v array<long>, shard int")
    leaves = stored(dealt.groupBy("shard").applyInPandas(_leaf_frame, LEAF))
    found: dict[int, list] = {}
    for r in leaves.where("leaf = 0").select("dim", "shard", "all_lo", "all_hi").orderBy("dim", "shard").collect():  # one row a shard
        found.setdefault(r["dim"], []).append((r["shard"], r["all_lo"], r["all_hi"]))
    boxes = spark.sparkContext.broadcast({d: (np.array([x[0] for x in xs]), _matrix([x[1] for x in xs], d), _matrix([x[2] for x in xs], d)) for d, xs in found.items()})

    def search(_key, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = list(_searched(own, asked, k)) if len(own) and len(asked) else []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    def answered(asked: DataFrame) -> DataFrame:
        """The best of every shard asked. A shard is copied for each block of queries that ask it."""
        blocks = asked.groupBy("shard", "dim").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
        asked = asked.join(blocks, ["shard", "dim"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
        data = leaves.drop("all_lo", "all_hi").join(blocks, ["shard", "dim"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])
        key = ["shard", "dim", "block"]
        return data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, FOUND)

    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v", "dim")
    first = stored(routed(queries.withColumn("kth", F.lit(NOTHING).cast("long")).withColumn("asked", F.lit(-1)), boxes, True))
    hits = stored(answered(first))
    if space.value.shards > 1:
        reached = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
        kth = F.coalesce(F.when(F.col("n") >= k, F.col("s")), F.lit(NOTHING).cast("long"))
        again = first.join(reached, "query_id", "left").select("query_id", "v", "dim", kth.alias("kth"), F.col("shard").alias("asked"))
        hits = hits.unionByName(answered(stored(routed(again, boxes, False))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
