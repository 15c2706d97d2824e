"""Whitening of embeddings from exact integer scatter, counted on bit planes.

Components become long x = floor(scale * c) + SHIFT. Each task takes blocks of rows, moves every dimension by its least value in the
block, and packs each dimension's bits across the rows into 64-bit words, one plane a bit. The product sum of two dimensions is the
sum over pairs of planes of 2**(a+b) times the number of ones in their AND; with the block's sums this gives the exact
product sums of x. Blocks and tasks are added up as whole numbers, the covariance is centred as a whole number
(n * product sum - sum * sum), and only then divided for the eigenvectors of a symmetric matrix.

A task holds one block: about PLANE_WORDS words of planes and as many again for one AND. What tasks return, and the driver
gathers, are sums by pair of dimensions: its size is fixed by the dimension (d * (d + 1) / 2 numbers), not by the rows. The model
(sums, up to `components` vectors) goes back to the tasks, which project every row.

Cases: vectors that are null or hold null or non-finite entries are dropped; so are empty ones. Vectors of each length are
fitted and whitened among themselves. Components c beyond 2**52 / scale are clipped there. A component without variance
(eigenvalue at the rounding error of the largest) has null in `whitened`, and identity_error leaves it out; with one row
or rows that are all alike everything is without variance, and `explained` is null too. Rows that repeat count each time, ids may be
null, other columns are ignored, an empty table gives an empty table. An eigenvector's sign makes its entry of largest size positive.
`deviation` is a decimal, as it outgrows a long with n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
PLANE_WORDS = 1 << 19
LIMIT = float(2**52)
LOW = 62  # bits of the lower of two longs that hold a sum


def integers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift of every entry as longs; null where the vector takes no part."""
    c = vector.cast("array<double>")
    fine = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(c.isNotNull() & fine, F.transform(c, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(LIMIT)), F.lit(-LIMIT))).cast("long") + shift))


def planes_of(rows: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes (dimension, bit, word) of non-negative rows (row, dimension)."""
    words = -(-len(rows) // 64)
    out = np.zeros((rows.shape[1], bits, words), np.uint64)
    for b in range(bits):
        packed = np.zeros((rows.shape[1], words * 8), np.uint8)
        ones = np.packbits(((rows >> b) & 1).astype(bool).T, axis=1)
        packed[:, : ones.shape[1]] = ones
        out[:, b] = packed.view(np.uint64)
    return out


def scatter(rows: np.ndarray) -> np.ndarray:
    """Exact product sums of all pairs of dimensions (upper triangle) of non-negative rows, as Python integers."""
    dim, bits = rows.shape[1], max(1, int(rows.max()).bit_length())
    planes = planes_of(rows, bits)
    flat, words = planes.reshape(dim * bits, -1), planes.shape[2]
    small = 2 * bits + int(len(rows)).bit_length() < 62
    weight = np.array([1 << b for b in range(bits)], dtype=np.int64 if small else object)
    out = np.zeros((dim, dim), dtype=object)
    step = max(1, PLANE_WORDS // (words * bits))  # dimensions that one AND covers
    for i in range(dim):
        for first in range(i, dim, step):
            there = flat[first * bits : (first + step) * bits]
            for a in range(bits):
                ones = np.bitwise_count(there & planes[i, a]).sum(axis=1, dtype=np.int64).reshape(-1, bits)
                sums = ones.astype(weight.dtype) @ weight
                out[i, first : first + len(sums)] += np.array([int(s) << a for s in sums], dtype=object)
    return out


def _product_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """dim, i, j, hi, lo: a task's product sums of x; j = -1: the sums of x; i = -1: its rows."""
    every: dict[int, list] = {}
    waiting: dict[int, list[np.ndarray]] = {}

    def settle(dim: int) -> None:
        x = np.concatenate(waiting.pop(dim))
        n, s, p = every.get(dim, (0, np.zeros(dim, object), np.zeros((dim, dim), object)))
        for at in range(0, len(x), block_rows(dim)):
            part = x[at : at + block_rows(dim)]
            low = part.min(axis=0)
            moved = part - low
            own = moved.astype(object).sum(axis=0) if int(moved.max()) > 1 << 40 else moved.sum(axis=0).astype(object)
            low = low.astype(object)
            p = p + scatter(moved) + np.outer(low, own) + np.outer(own, low) + len(part) * np.outer(low, low)
            n, s = n + len(part), s + own + len(part) * low
        every[dim] = [n, s, p]

    for frame in frames:
        for dim, group in frame["x"].groupby(frame["x"].map(len)):
            waiting.setdefault(dim, []).append(np.stack(group.tolist()).astype(np.int64))
            if sum(map(len, waiting[dim])) >= block_rows(dim):
                settle(dim)
    for dim in list(waiting):
        settle(dim)
    for dim, (n, s, p) in every.items():
        i, j = np.triu_indices(dim)
        value = [n, *s, *p[i, j]]
        yield pd.DataFrame({"dim": dim, "i": [-1, *range(dim), *i], "j": [-1, *[-1] * dim, *j], "hi": [int(v) >> LOW for v in value], "lo": [int(v) & ((1 << LOW) - 1) for v in value]})


def block_rows(dim: int) -> int:
    return max(64, min(65_536, PLANE_WORDS * 64 // (dim * 16) // 64 * 64))


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """For each length of vectors(x): n, sums, vectors (component, dimension), eigenvalues, explained and identity_error."""
    longs = vectors.select("x").mapInPandas(_product_sums, "dim int, i int, j int, hi long, lo long")
    sums = longs.groupBy("dim", "i", "j").agg(F.sum(F.col("hi").cast("decimal(38,0)")).alias("hi"), F.sum(F.col("lo").cast("decimal(38,0)")).alias("lo"))
    by: dict[int, dict[tuple[int, int], int]] = {}
    for r in sums.collect():  # d * (d + 3) / 2 + 1 numbers a length
        by.setdefault(r["dim"], {})[r["i"], r["j"]] = (int(r["hi"]) << LOW) + int(r["lo"])
    return {dim: model(dim, found, components) for dim, found in by.items()}


def model(dim: int, sums: dict[tuple[int, int], int], components: int) -> dict:
    n, s = sums[-1, -1], [sums[i, -1] for i in range(dim)]
    v = np.empty((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = (n * sums[i, j] - s[i] * s[j]) / (n * n)  # whole numbers: the quotient is rounded once
    values, vectors = np.linalg.eigh(v)
    k = min(components, dim)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k].T
    vectors = vectors * np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])[:, None]
    trace = float(np.trace(v))
    alive = values > max(values[0], 0) * dim * np.finfo(float).eps
    spread = vectors[alive] / np.sqrt(values[alive])[:, None]
    error = np.abs(spread.astype(np.longdouble) @ v.astype(np.longdouble) @ spread.T.astype(np.longdouble) - np.eye(int(alive.sum()))).max(initial=0.0)
    return {"n": n, "sums": s, "vectors": vectors, "values": values, "alive": alive, "explained": values / trace if trace > 0 else np.full(k, np.nan), "identity_error": float(error)}


def projected(x: np.ndarray, m: dict) -> tuple[list[Decimal], np.ndarray]:
    """Each row's exact deviation and its whitened components (NaN where there is no variance)."""
    fits = (int(np.abs(x).max(initial=0)) * m["n"] + max(map(abs, m["sums"]))) < 2**62
    away = x * np.int64(m["n"]) - np.array(m["sums"], np.int64) if fits else x.astype(object) * m["n"] - np.array(m["sums"], object)
    square = int(np.abs(away).max(initial=0)) ** 2 * x.shape[1] < 2**62
    deviation = ((away if square else away.astype(object)) ** 2).sum(axis=1)
    out = (away / m["n"]).astype(float) @ m["vectors"].T
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(m["alive"], out / np.sqrt(m["values"]), np.nan)
    return [Decimal(int(d)) for d in deviation], out


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each vector and component."""
    spark = table.sparkSession
    kind = table.schema[id_col].dataType
    rows = stored(table.select(F.col(id_col).cast("string").alias("vec_id"), integers(F.col(vector_col), scale, shift).alias("x")).where("x is not null"))
    models = spark.sparkContext.broadcast(fitted(rows, components))  # components + 1 vectors a length

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, group in frame.groupby(frame["x"].map(len)):
                m = models.value[dim]
                k = len(m["values"])
                deviation, white = projected(np.stack(group["x"].tolist()).astype(np.int64), m)
                yield pd.DataFrame({"vec_id": group["vec_id"].repeat(k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(group)), "n": m["n"], "deviation": np.repeat(np.array(deviation, object), k), "whitened": white.ravel(), "explained": np.tile(m["explained"], len(group)), "identity_error": m["identity_error"]})

    out = rows.mapInPandas(run, "vec_id string, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    number = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c)
    return out.select(F.col("vec_id").cast(kind), "component", "n", "deviation", number("whitened"), number("explained"), "identity_error")
