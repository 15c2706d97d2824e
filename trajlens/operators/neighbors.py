"""Exact nearest neighbours among rows of other owners, by cells around pivots that distances rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

ROWS, CELL, PIVOTS = 8192, 512, 1024  # rows of a task's block, of a cell as aimed at, pivots of a group at most
WHOLE = 8192  # rows of a group that are one cell: comparing them all costs less than placing them
FLAT = 16  # dimensions above which pivots rule out next to nothing: such a group is one cell, whose blocks meet in pairs
SLACK = 1e-9  # of a bound, for rounding
ROW = ["owner", "item", "x", "y"]
FOUND = "owner long, item int, d double, near long, near_item int, gap double"


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.tolist()) if len(values) else np.zeros((0, 0))


def _foreign(own: np.ndarray, owner: np.ndarray, rows: np.ndarray, rows_owner: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of own: the k nearest rows of other owners and their squared distances."""
    fine = np.isfinite(own).all() and np.isfinite(rows).all()
    step = max(1, 4_000_000 // max(1, len(rows) if fine else rows.size))
    squares, k = (rows * rows).sum(axis=1), min(k, len(rows))
    for start in range(0, len(own), step):
        part = own[start : start + step]
        if fine:  # products tell who may be near, within rounding; only those are compared by their differences
            d = part @ rows.T
            d *= -2
            d += squares
            size = (part * part).sum(axis=1)
            d += size[:, None]
            room = 1e-10 * (size + squares.max())
        else:
            d = ((rows[None] - part[:, None]) ** 2).sum(axis=2)
            room = np.zeros(len(part))
        d[owner[start : start + step, None] == rows_owner[None]] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1] + room
        for i in range(len(part)):
            near = np.flatnonzero(d[i] <= last[i])
            near = near[np.isfinite(d[i, near])]
            own_d = ((rows[near] - part[i]) ** 2).sum(axis=1)
            order = np.argsort(own_d, kind="stable")[:k]
            yield start + i, near[order], own_d[order]


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (row, pivot), a few rows at a time."""
    out, step = np.empty((len(x), len(pivots))), max(1, 2_000_000 // max(1, pivots.size))
    for at in range(0, len(x), step):
        out[at : at + step] = np.sqrt(((x[at : at + step, None] - pivots[None]) ** 2).sum(axis=2))
    return out


class Cells:
    """The rows of points(grp, owner, item, x, y) in the cells of their group's pivots, stored.

    Pivots are the group's rows with the smallest hashes, one for CELL rows, PIVOTS at most; every row belongs to the nearest. All
    tasks work on blocks of about ROWS rows of a group or a cell, so that neither a large group nor a cell of rows that are
    alike comes together in one.
    """

    def __init__(self, points: DataFrame):
        grp = dict(points.dtypes)["grp"]
        sizes = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("wide"))
        wanted = F.when((F.col("n") <= WHOLE) | (F.col("wide") > FLAT), 1).otherwise(F.least(F.ceil(F.col("n") / CELL), F.lit(PIVOTS))).cast("int")
        sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("n") / ROWS).cast("int")).withColumn("wanted", wanted).drop("wide"))
        self.sizes, self.grp = sizes, grp
        self.split = bool(sizes.where("wanted > 1").take(1))  # a group of several cells
        if not self.split:
            self.rows = stored(points.select("grp", *ROW, F.lit(0).alias("cell"), F.lit(0.0).alias("r")))
            self.cells = sizes.select("grp", F.lit(0).alias("cell"), "n", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.col("blocks").alias("parts"))
            return
        rows = points.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("owner", "item"), F.col("blocks")).cast("int"))
        by_hash = Window.partitionBy("grp").orderBy(F.xxhash64("owner", "item", F.lit(3)), "owner", "item")
        ranked = rows.withColumn("p", F.row_number().over(by_hash)).where(F.col("p") <= PIVOTS).where(F.col("p") <= F.col("wanted"))
        self.pivots = stored(ranked.select("grp", (F.col("p") - 1).cast("int").alias("p"), "x"))

        def nearest(_key, own: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame({c: [] for c in ["grp", *ROW, "cell", "r"]}).astype({"owner": "int64", "item": "int32", "x": object, "y": object, "cell": "int32", "r": "float64"})
            pivots = pivots.sort_values("p")
            d = _to_pivots(_matrix(own["x"]), _matrix(pivots["px"]))
            cell = d.argmin(axis=1)
            return own[["grp", *ROW]].assign(cell=pivots["p"].to_numpy()[cell], r=d[np.arange(len(d)), cell])

        dealt = rows.select("grp", "block", *ROW).groupBy("grp", "block").cogroup(self._copies(self.pivots.withColumnRenamed("x", "px")).groupBy("grp", "block"))
        found = dealt.applyInPandas(nearest, f"grp {grp}, owner long, item int, x array<double>, y array<double>, cell int, r double")
        self.rows = stored(found)
        cells = self.rows.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
        self.cells = stored(cells.withColumn("parts", F.ceil(F.col("n") / ROWS).cast("int")))

    def _copies(self, per_group: DataFrame) -> DataFrame:
        """Rows that belong to a group, once for each of its blocks."""
        return per_group.join(self.sizes.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "grp")

    def answered(self, asked: DataFrame, k: int) -> DataFrame:
        """asked(grp, cell, owner, item, x, y): the k nearest rows of other owners in each cell asked."""
        parts = self.cells.select("grp", "cell", "parts")
        held = self.rows.join(parts, ["grp", "cell"]).select("grp", "cell", F.pmod(F.xxhash64("owner", "item"), F.col("parts")).cast("int").alias("part"), *ROW)
        # the askers of a cell come in blocks as well; each block meets each part
        blocks = asked.groupBy("grp", "cell").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("blocks"))
        held = held.join(blocks, ["grp", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        asked = asked.join(parts, ["grp", "cell"]).join(blocks, ["grp", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = asked.select("grp", "cell", "part", F.pmod(F.xxhash64("owner", "item", F.lit(5)), F.col("blocks")).cast("int").alias("block"), *[F.col(c).alias(f"q_{c}") for c in ROW])
        held = held.select(*[F.col(c).alias(c) for c in held.columns])  # columns of its own beside asked's

        def near(_key, asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(asking) and len(own):
                own = own.sort_values(["owner", "item"])
                y, mine = _matrix(own["y"]), _matrix(asking["q_y"])
                e, f, o, oj = asking["q_owner"].to_numpy(), asking["q_item"].to_numpy(), own["owner"].to_numpy(), own["item"].to_numpy()
                for i, at, d in _foreign(_matrix(asking["q_x"]), e, _matrix(own["x"]), o, k):
                    gap = ((y[at] - mine[i]) ** 2).sum(axis=1)
                    out += [(int(e[i]), int(f[i]), float(x), int(o[t]), int(oj[t]), float(g)) for x, t, g in zip(d, at, gap)]
            return pd.DataFrame(out, columns=["owner", "item", "d", "near", "near_item", "gap"]).astype({"owner": "int64", "item": "int32", "near": "int64", "near_item": "int32"})

        key = ["grp", "cell", "part", "block"]
        return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(near, FOUND)

    def in_reach(self, kth: DataFrame) -> DataFrame:
        """grp, cell, owner, item, x, y: the other cells that may hold a row at or below kth(owner, item, d) of each row.

        By the triangle inequality a cell's rows are at least |distance to its pivot - their distance to it| away, and at least
        half of how much further its pivot is than the nearest one.
        """
        rows = self.rows.join(kth, ["owner", "item"], "left").join(self.sizes.select("grp", "blocks"), "grp")
        rows = rows.select("grp", F.pmod(F.xxhash64("owner", "item"), F.col("blocks")).cast("int").alias("block"), *ROW, "cell", "r", F.coalesce("d", F.lit(float("inf"))).alias("d"))
        bounds = self._copies(self.pivots.withColumnRenamed("p", "c").join(self.cells.select(F.col("grp").alias("g"), F.col("cell").alias("c2"), "lo", "hi"), (F.col("grp") == F.col("g")) & (F.col("c") == F.col("c2"))).select("grp", "c", F.col("x").alias("px"), "lo", "hi"))

        def reach(_key, own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(own) and len(cells):
                cells = cells.sort_values("c")
                ids, lo, hi, px = cells["c"].to_numpy(), cells["lo"].to_numpy(), cells["hi"].to_numpy(), _matrix(cells["px"])
                for at in range(0, len(own), 512):
                    part = own.iloc[at : at + 512]
                    to = _to_pivots(_matrix(part["x"]), px)
                    gap = np.maximum(np.maximum(to - hi, lo - to), (to - part["r"].to_numpy()[:, None]) / 2)
                    limit = np.sqrt(part["d"].to_numpy())[:, None]
                    meets = (gap <= limit + SLACK * (1 + to)) & (ids[None] != part["cell"].to_numpy()[:, None])
                    out.append(part[["grp", *ROW]].assign(cells=[ids[np.flatnonzero(x)] for x in meets])[meets.any(axis=1)])
            return pd.concat(out) if out else own.iloc[:0][["grp", *ROW]].assign(cells=None)

        met = rows.groupBy("grp", "block").cogroup(bounds.groupBy("grp", "block")).applyInPandas(reach, f"grp {self.grp}, owner long, item int, x array<double>, y array<double>, cells array<int>")
        return stored(met).select("grp", *ROW, F.explode("cells").alias("cell"))  # a row is stored once, however many cells it asks


def nearest_foreign(points: DataFrame, k: int) -> DataFrame:
    """owner, item, rank, d, near, near_item, gap: each row's k nearest rows of other owners in its group.

    points(grp, owner, item, x, y): owner and item name a row; d is the squared distance of x, gap that of y. Ties go to the smaller
    (near, near_item). A row asks its own cell first; what it finds there rules out all cells beyond that distance.
    """
    cells = Cells(points)
    best = Window.partitionBy("owner", "item").orderBy("d", "near", "near_item")
    first = cells.answered(cells.rows.select("grp", "cell", *ROW), k)
    if not cells.split:
        return first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = stored(first)
    ranked = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kth = ranked.where(F.col("rank") == k).select("owner", "item", "d")
    more = cells.answered(cells.in_reach(kth), k)
    return first.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
