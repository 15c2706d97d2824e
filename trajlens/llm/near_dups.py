"""MinHash near-duplicate detection with tensored banding; every link is confirmed on full shingle sets.

1. Each whole text becomes its set of hashed word shingles. Two collections of ``m`` half keys, each of ``ROWS``
   minhashes, are computed; a table key is a pair of one half key of either collection, so m*m tables of 2*ROWS rows
   cost only 2*m*ROWS minhashes. ``m`` is the least number at which a pair exactly at the threshold shares no table
   with a chance below ``MISS``.
2. Texts of equal sets are one class. Half keys that only one class has can form no shared table key, so pairs are
   formed from shared half keys alone. The classes of a table key hang on its smallest one; the components of these
   edges are clusters of candidates.
3. Each cluster's texts (one a class) are dealt to tasks in blocks of about ``BLOCK`` classes (fewer, if they are long) and
   all pairs of a block are compared exactly on their sets, in memory, without emitting pairs: a class gets the smallest
   class it is linked to. The blocks of a larger cluster hold classes of one band of set sizes; sets of bands that are
   not neighbours can't be alike. There a few well linked classes of each block, and at last every class outside its
   cluster's largest component, ask those other blocks of neighbouring bands that hold a class with which they share a
   table key. Asking texts stream past a block, so a task holds one block. After that, no two classes that share a table
   key and lie in different components are left uncompared.
4. Components of the links; each document gets the smallest id of its component.

Hashes of shingles have 64 bits, of sets 128. Cases: null and blank texts have no shingles and stay alone (kept); texts
shorter than a shingle are one shingle of all their words; null ids take part, the component's id is its smallest
non-null id; rows that repeat exactly share a class; extra columns are no matter; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, stored, text_of, unpacked
from .graph import components, joined_by

ROWS, MISS, BLOCK, BLOCK_SHINGLES, PROBES = 3, 1e-4, 512, 2_000_000, 4
_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_POWERS = np.cumprod(np.full(1 << 12, 0xD1342543DE82EF95, dtype=np.uint64))
_MUL = _RNG.integers(0, 2**64, 512, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, 512, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def collection_size(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** rows))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words are hashed for all texts at once."""
    raw = [t.encode("utf-8", "surrogatepass").lower() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if not len(data):
        return [np.zeros(0, np.uint64) for _ in texts]
    word = ~_SPACE[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    at = np.flatnonzero(word)
    first = np.searchsorted(at, starts)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    # far into a very long word the powers start anew, with another byte table value for the lap
    value = _mix(_BYTE[data[at]] + (place >> 12).astype(np.uint64)) * _POWERS[place & 4095]
    words = _mix(np.add.reduceat(value, first))
    ends = np.cumsum([len(r) for r in raw])
    bound = np.searchsorted(starts, np.concatenate([[0], ends]))
    out = []
    for a, b in zip(bound[:-1], bound[1:]):
        own, size = words[a:b], min(k, b - a)
        if not size:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.full(len(own) - size + 1, size, dtype=np.uint64)
        for j in range(size):
            h = _mix(h + own[j : len(own) - size + 1 + j] * _MUL[500 + j % 12])
        out.append(np.unique(h))
    return out


def set_digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set that don't depend on order."""
    c = [np.add.reduce(_mix(s + np.uint64(1))) if len(s) else np.uint64(0) for s in sets]
    d = [np.add.reduce(_mix(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else np.uint64(0) for s in sets]
    return np.array(c, dtype=np.uint64).view(np.int64), np.array(d, dtype=np.uint64).view(np.int64)


def half_keys(sets: list[np.ndarray], m: int) -> list[np.ndarray]:
    """2*m half keys of each set that isn't empty."""
    some = [s for s in sets if len(s)]
    if not some:
        return [np.zeros(0, np.int64) for _ in sets]
    flat, starts = np.concatenate(some), np.concatenate([[0], np.cumsum([len(s) for s in some])[:-1]])
    keys = np.empty((len(some), 2 * m), dtype=np.uint64)
    for half in range(2 * m):
        h = np.full(len(some), half + 1, dtype=np.uint64)
        for row in range(ROWS):
            f = half * ROWS + row
            h = _mix(h + np.minimum.reduceat(flat * _MUL[f] + _ADD[f], starts))
        keys[:, half] = h
    found = iter(keys.view(np.int64))
    return [next(found) if len(s) else np.zeros(0, np.int64) for s in sets]


def sketches(docs: DataFrame, k: int, m: int) -> DataFrame:
    """doc_id, rk (hash of the row's id and text), n, c, d (size and digests of the set), half (its half keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 256):
                batch = big.slice(start, 256)
                sets = shingle_sets(batch.column(2).to_pylist(), k)
                c, d = set_digests(sets)
                half = [x.tolist() for x in half_keys(sets, m)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(c), pa.array(d), pa.array(half, pa.list_(pa.int64()))],
                    names=["doc_id", "rk", "n", "c", "d", "half"],
                )

    text = text_of(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("rk"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rk long, n long, c long, d long, half array<long>")


def table_keys(classes: DataFrame, m: int) -> DataFrame:
    """c, keys: the tables' keys of each class digest (m*m at most), made of half keys that another class has too."""
    halves = classes.select("c", F.posexplode("half").alias("i", "h"))
    shared = halves.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    mine = joined_by(halves, shared, "h").groupBy("c").agg(F.collect_list(F.struct("i", "h")).alias("x"))  # at most 2*m
    mine = mine.select("c", F.filter("x", lambda y: y.i < m).alias("a"), F.filter("x", lambda y: y.i >= m).alias("b"))
    return stored(mine.select("c", F.flatten(F.transform("a", lambda y: F.transform("b", lambda z: F.xxhash64(y.h, z.h)))).alias("keys")))


def candidate_edges(keys: DataFrame) -> DataFrame:
    """Edges u, v between class digests: each class of a table key with the key's smallest one."""
    keys = keys.select("c", F.explode("keys").alias("key"))
    least = keys.groupBy("key").agg(F.min("c").alias("v"), F.max("c").alias("top"), F.count(F.lit(1)).alias("k")).where("v < top").drop("top")
    return joined_by(keys, least, "key").where("c <> v").select(F.col("c").alias("u"), "v").distinct()


class Links:
    """Which of some sets are alike, exactly."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes, self.percent = np.array([len(s) for s in sets], dtype=np.int64), percent
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.flat = np.concatenate(sets)

    def of(self, s: np.ndarray) -> np.ndarray:
        """Indices of the sets whose intersection with s is large enough."""
        at = np.searchsorted(s, self.flat)
        inside = s[np.minimum(at, len(s) - 1)] == self.flat
        both = np.add.reduceat(inside.astype(np.int64), self.starts)
        return np.flatnonzero(100 * both >= self.percent * (self.sizes + len(s) - both))


def _groups(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches sorted by key."""
    kept = None
    for frame in frames:
        frame = frame if kept is None else pd.concat([kept, frame])
        if not len(frame):
            continue
        last = frame[key].iloc[-1]
        is_last = (frame[key] == last).all(axis=1)
        for _, group in frame[~is_last].groupby(key, sort=False):
            yield group
        kept = frame[is_last]
    if kept is not None and len(kept):
        yield kept


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_clusters(members: DataFrame, k: int, percent: int) -> DataFrame:
    """members(root, block, blocks, c, d, text) -> c, d, lc, ld (the smallest class linked to it within its block), probe."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, ["root", "block"]):
            group = group.drop_duplicates(["c", "d"]).sort_values(["c", "d"])
            sets = shingle_sets(group["text"].tolist(), k)
            links, parent, degree = Links(sets, percent), list(range(len(sets))), []
            for i, s in enumerate(sets):
                near = links.of(s)
                degree.append(len(near))
                for j in near.tolist():
                    a, b = _root(parent, i), _root(parent, j)
                    parent[max(a, b)] = min(a, b)
            roots = [_root(parent, i) for i in range(len(sets))]
            c, d = group["c"].to_numpy(), group["d"].to_numpy()
            rank = pd.Series(-np.array(degree)).groupby(roots).rank(method="first").to_numpy()
            yield pd.DataFrame({"root": group["root"], "block": group["block"], "blocks": group["blocks"], "c": c, "d": d, "lc": c[roots], "ld": d[roots], "probe": rank <= PROBES})

    rows = members.repartition("root", "block").sortWithinPartitions("root", "block")
    return rows.mapInPandas(run, "root long, block int, blocks int, c long, d long, lc long, ld long, probe boolean")


def link_across(asking: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between asking(root, block, c, d, label, text: what to compare with block) and the blocks of texts, as uc, ud, vc, vd."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own, links = None, [], None
        for frame in frames:  # by root, block, and the block's own classes before those that ask
            for place, group in frame.groupby(["root", "block"], sort=False):
                if place != now:
                    now, own, links = place, [], None
                mine, asks = group[~group["asks"]], group[group["asks"]]
                if len(mine):
                    own.append(mine)
                if not len(asks) or not own:
                    continue
                if links is None:
                    whole = pd.concat(own).drop_duplicates(["c", "d"])
                    c, d, label = (whole[x].to_numpy() for x in ("c", "d", "label"))
                    links = Links(shingle_sets(whole["text"].tolist(), k), percent)
                found = []
                for start in range(0, len(asks), BLOCK):
                    part = asks.iloc[start : start + BLOCK]
                    for s, uc, ud, theirs in zip(shingle_sets(part["text"].tolist(), k), part["c"], part["d"], part["label"]):
                        near = links.of(s)
                        near = near[label[near] != theirs]
                        for j in near[np.unique(label[near], return_index=True)[1]].tolist():  # one link a component is enough
                            found.append((uc, ud, int(c[j]), int(d[j])))
                yield pd.DataFrame(found, columns=["uc", "ud", "vc", "vd"]).astype("int64")

    both = texts.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)))
    return both.repartition("root", "block").sortWithinPartitions("root", "block", "asks").mapInPandas(run, "uc long, ud long, vc long, vd long")


def _node(c: str, d: str):
    return F.struct(F.col(c).alias("c"), F.col(d).alias("d"))


def dealt(members: DataFrame, percent: int) -> DataFrame:
    """members(root, c, d, n, ..) with blocks (of the cluster), band and block (a number of its own in the cluster)."""
    many = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    sizes = members.groupBy("root").agg(many().alias("blocks"), F.count(F.lit(1)).alias("k"))
    members = joined_by(members, sizes, "root").withColumn("band", F.when(F.col("blocks") > 1, band).otherwise(0))
    per = members.groupBy("root", "band").agg(many().alias("subs"))
    first = F.coalesce(F.sum("subs").over(Window.partitionBy("root").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # bands are few: sizes grow by a factor
    per = per.withColumn("first", first)
    return members.join(per, ["root", "band"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("c", "d"), F.col("subs"))).cast("int")).drop("subs", "first")


def class_components(docs: DataFrame, classes: DataFrame, k: int, percent: int, m: int) -> DataFrame:
    """c, d, label: a struct of the component's smallest class, for the classes of candidate clusters."""
    keys = table_keys(classes, m)
    clusters = components(candidate_edges(keys)).select(F.col("node").alias("c"), "root")
    members = stored(dealt(clusters.join(classes.select("c", "d", "n", F.col("rep.rk").alias("rk")), "c"), percent))
    text = text_of(F.col("text"))
    # always by a merge: what travels then grows evenly, and repeated rows meet before they are compared
    texts = docs.select(F.xxhash64("doc_id", text).alias("rk"), text.alias("text")).join(members.hint("merge"), "rk").dropDuplicates(["rk", "c", "d"])
    texts = stored(texts.select("root", "band", "block", "blocks", "c", "d", "text"))  # of candidates only; read again below
    linked = stored(link_clusters(texts, k, percent))
    edges = linked.where("blocks > 1").select(_node("c", "d").alias("u"), _node("lc", "ld").alias("v"))
    if not edges.take(1):
        return linked.select("c", "d", _node("lc", "ld").alias("label"))
    texts = texts.where("blocks > 1")
    # where to ask: blocks of neighbouring bands that hold a class of a common table key
    placed = members.where("blocks > 1").select("c", "root", "band", "block")
    held = keys.join(placed, "c").select(F.explode("keys").alias("key"), "root", F.col("band").alias("at_band"), F.col("block").alias("at_block")).distinct()

    def compare(labelled: DataFrame, chosen: DataFrame) -> DataFrame:
        own = texts.join(labelled, ["c", "d"])
        asks = chosen.select("c").distinct().join(placed, "c").join(keys, "c").withColumn("key", F.explode("keys")).drop("keys").join(held, ["key", "root"])
        asks = asks.where((F.abs(F.col("band") - F.col("at_band")) <= 1) & (F.col("block") != F.col("at_block"))).select("c", "at_block").distinct()
        pick = ["root", "block", "c", "d", F.xxhash64("label").alias("label"), "text"]
        asking = own.join(chosen, ["c", "d"], "left_semi").drop("block").join(asks, "c").withColumnRenamed("at_block", "block")
        found = link_across(asking.select(*pick), own.select(*pick), k, percent)
        return found.select(_node("uc", "ud").alias("u"), _node("vc", "vd").alias("v"))

    local = linked.where("blocks > 1").select("c", "d", _node("lc", "ld").alias("label"))
    edges = stored(edges.unionByName(compare(local, linked.where("blocks > 1 and probe"))))

    def labels(edges: DataFrame) -> DataFrame:
        found = components(edges).select(F.col("node.c").alias("c"), F.col("node.d").alias("d"), F.col("root").alias("to"))
        return local.join(found, ["c", "d"], "left").select("c", "d", F.coalesce("to", _node("c", "d")).alias("label"))

    now = stored(labels(edges))
    sized = linked.where("blocks > 1").join(now, ["c", "d"]).groupBy("root", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = sized.groupBy("root").agg(F.max(F.struct("k", "label"))["label"].alias("main"), F.sum("k").alias("k"))
    outside = joined_by(linked.where("blocks > 1").join(now, ["c", "d"]), largest, "root").where(F.col("label") != F.col("main"))
    more = stored(compare(now, outside.select("c", "d")))
    if more.take(1):
        now = labels(edges.unionByName(more))
    return now.unionByName(linked.where("blocks = 1").select("c", "d", _node("lc", "ld").alias("label")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, rk, n_shingles, component_id, rep (struct doc_id, rk of the row that stands for the component)."""
    m = collection_size(percent)
    rows = stored(sketches(docs, shingle, m))
    first = F.struct("doc_id", "rk")
    classes = rows.where("n > 0").groupBy("c", "d", "n").agg(F.min("doc_id").alias("id"), F.min(first).alias("rep"), F.first("half").alias("half"))
    classes = stored(classes)
    labelled = class_components(docs, classes, shingle, percent, m)
    classes = classes.drop("half").join(labelled, ["c", "d"], "left").withColumn("label", F.coalesce("label", _node("c", "d")))
    least = classes.groupBy("label").agg(F.min("id").alias("component_id"), F.min("rep").alias("rep"))
    classes = stored(classes.select("c", "d", "n", "label").join(least, "label").drop("label"))
    found = rows.drop("half").join(classes, ["c", "d", "n"], "left")
    alone = F.col("n") == 0
    return found.select(
        "doc_id", "rk", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, first).otherwise(F.col("rep")).alias("rep")
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each group, columns of any names; rows without words stay."""
    found = near_duplicates(docs, shingle, percent)
    stay = found.where((F.col("n_shingles") == 0) | (F.col("rk") == F.col("rep.rk"))).groupBy("rk").agg(F.max("n_shingles").alias("n"))
    df = packed(docs, F.xxhash64("doc_id", text_of(F.col("text"))).alias("rk"), F.col("doc_id")).join(stay, "rk")
    once = df.where("n > 0").dropDuplicates(["rk", "doc_id"])
    return unpacked(once.unionByName(df.where("n = 0")), docs)
