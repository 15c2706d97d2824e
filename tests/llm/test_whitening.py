"""Whitening against exact integers and a plain eigendecomposition."""

import math
from decimal import Decimal

import numpy as np
import pytest

from trajlens.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, dim string")


def vectors(n=400, d=12, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).astype(np.float32)


@pytest.mark.parametrize("peak", [1, 2, 1000, 2**31, 2**50])
def test_bit_planes_give_exact_product_sums(peak):
    x = np.random.default_rng(1).integers(0, peak, (333, 7))
    big = x.astype(object)
    assert (whitening.scatter(x) == np.triu(big.T @ big)).all()


def test_sums_over_blocks_and_tasks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PLANE_WORDS", 32)  # the smallest blocks; tasks that import anew keep the large ones
    v = vectors()
    x = [[math.floor(1024 * float(c)) + 100_000 for c in r] for r in v]
    df = spark.createDataFrame([(r,) for r in x], "x array<long>").repartition(5)
    m = whitening.fitted(df)[12]
    big = np.array(x, dtype=object)
    n, s, p = len(x), big.sum(axis=0), big.T @ big
    assert m["n"] == n and m["sums"] == list(s)
    own = {(-1, -1): 0}
    for f in whitening._product_sums(iter([__import__("pandas").DataFrame({"x": x[:150]}), __import__("pandas").DataFrame({"x": x[150:]})])):
        for _, i, j, hi, lo in f.itertuples(index=False):
            own[i, j] = (hi << whitening.LOW) + lo
    assert own[-1, -1] == n and all(own[i, -1] == s[i] for i in range(12)) and all(own[i, j] == p[i, j] for i in range(12) for j in range(i, 12))


def test_rows_are_white(spark):
    v = vectors()
    rows = [(i, r.tolist(), 1, "k") for i, r in enumerate(v)] + [(-1, None, 1, "k"), (-2, [float("nan")] * 12, 1, "k"), (-3, [None] + [1.0] * 11, 1, "k"), (-4, [float("inf")] * 12, 1, "k"), (-5, [], 1, "k")]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert len(got) == 400 * 8 and set(got["vec_id"]) == set(range(400)) and (got["n"] == 400).all()
    x = np.floor(1024 * v.astype(float)).astype(np.int64) + 100_000
    big = x.astype(object)
    s = big.sum(axis=0)
    dev = ((400 * big - s) ** 2).sum(axis=1)
    assert all(int(d) == dev[i] for i, d in zip(got["vec_id"], got["deviation"]))
    cov = (400 * (big.T @ big) - np.outer(s, s)).astype(float) / 400**2
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:8], w[:, ::-1][:, :8]
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    plain = (x - s.astype(float) / 400) @ w / np.sqrt(e)
    assert np.abs(np.abs(white) - np.abs(plain)).max() < 1e-8
    assert np.abs(white.T @ white / 400 - np.eye(8)).max() < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), e / np.trace(cov), rtol=1e-10) and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


def test_query_has_whole_table(spark):
    got = queries.op13_embedding_whitening(spark, SF)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert got.count() == 500 * 8


def test_cases_without_variance_or_rows(spark):
    assert whitening.whiten(frame(spark, []).where("false")).collect() == []
    one = whitening.whiten(frame(spark, [(None, [1.0, 2.0], 1, "k")])).collect()
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(None, c, 1, 0, None, None, 0.0) for c in (1, 2)]
    flat = whitening.whiten(frame(spark, [(2**60 + 1, [float(i), 3.0, float(i)], 1, "k") for i in range(5)] + [(7, [1.0], 1, "k")] * 2 + [(None, [0.5], 1, "k")])).collect()
    assert len(flat) == 5 * 3 + 3
    line = [r for r in flat if r.vec_id == 2**60 + 1]
    assert sum(r.whitened is None for r in line) == 10 and all(abs(r.explained - 1) < 1e-12 for r in line if r.component == 1)
    assert {r.n for r in flat if r.vec_id in (7, None)} == {3}


def test_values_beyond_longs_stay_exact(spark):
    rows = [(i, [1e30 if i else -1e30, float(i)], 1, "k") for i in range(3)]
    got = whitening.whiten(frame(spark, rows)).collect()
    x = [[(2**52 if i else -(2**52)) + 100_000, 1024 * i + 100_000] for i in range(3)]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: r.deviation for r in got} == {i: Decimal(sum((3 * a - b) ** 2 for a, b in zip(x[i], s))) for i in range(3)}
