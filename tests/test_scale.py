"""Operators that no group may bring into one task: exact results, and how much each task gets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlens.functions import spectral
from trajlens.operators import batch, harness, neighbors, quantiles, scoring
from trajlens.storage import stored


def shuffled_rows(spark, since):
    """Rows that the stages after stage `since` read from shuffles, the most of any one, and the last stage's number."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    found = [(stages.apply(i).stageId(), stages.apply(i).shuffleReadRecords()) for i in range(stages.size())]
    return max([n for k, n in found if k > since], default=0), max((k for k, _ in found), default=-1)


def test_percentiles_of_a_group_of_a_million(spark, monkeypatch):
    n = 1_000_000
    x = F.when(F.col("id") % 10 == 0, 0.25).otherwise(F.exp(F.rand(7) * 40 - 20))
    values = stored(spark.range(0, n, 1, 8).select(F.lit("big").alias("k"), x.alias("x")).unionByName(spark.range(5).select(F.lit("small").alias("k"), F.col("id").cast("double").alias("x"))))
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    _, since = shuffled_rows(spark, -1)
    got = {r.k: r for r in quantiles.percentiles(values, ["k"], "x", probs).collect()}
    most, _ = shuffled_rows(spark, since)
    assert got["big"].n == n and most < n / 10  # no stage, so no task, saw more than a tenth of the group
    assert got["big"].q == np.percentile(np.array([r.x for r in values.where("k = 'big'").collect()]), [100 * p for p in probs]).tolist()
    assert got["small"].q == [0.0, 0.2, 1.0, 2.0, 3.0, 3.8, 4.0]


@pytest.mark.parametrize("direct,buckets,small", [(10, 64, 8), (100_000, 4096, 4096)])
def test_percentiles_at_ties_outliers_and_extremes(spark, monkeypatch, direct, buckets, small):
    for name, value in (("DIRECT", direct), ("BUCKETS", buckets), ("SMALL", small)):
        monkeypatch.setattr(quantiles, name, value)
    rng = np.random.default_rng(3)
    keys = {"ties": [2.0] * 70 + [3.0] * 31, "spread": (10.0 ** rng.uniform(-300, 300, 41)).tolist(), "signs": [-1.7e308, 1.7e308, 0.0, -0.5, *rng.normal(size=60)], "tiny": [5e-324 * i for i in range(40)], "one": [7.0], "few": [1.0, 2.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in keys.items() for v in vs] + [("few", None)], "k string, x double")
    got = {r.k: r.q for r in quantiles.percentiles(df, ["k"], "x", [0.05, 0.5, 0.77]).collect()}
    for k, vs in keys.items():
        v = sorted(map(float, vs))
        for p, q in zip([0.05, 0.5, 0.77], got[k]):
            at = p * (len(v) - 1)
            lo, hi = v[math.floor(at)], v[math.ceil(at)]
            assert q == (lo if lo == hi or math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi), (k, p)


def test_fit_is_the_same_by_histograms(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("g", "sparc", s, float(v)) for s in ("a", "b") for v in rng.normal(size=400)] + [("h", "ldlj", "", 1.0)] * 30 + [("h", "ldlj", "", 4.0)] * 3
    df = spark.createDataFrame(rows, "group_label string, metric string, signal string, value double")
    plain = sorted(map(tuple, scoring.fit(df).collect()))
    monkeypatch.setattr(quantiles, "DIRECT", 20)
    monkeypatch.setattr(quantiles, "SMALL", 10)
    assert sorted(map(tuple, scoring.fit(df).collect())) == plain


def test_ranks_without_one_task_for_a_metric(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 300, 3000).astype(float), rng.normal(size=3000)
    df = spark.createDataFrame([("m", float(x), float(x + 40 * y)) for x, y in zip(a, b)] + [("k", float(i), float(-i)) for i in range(9)] + [("flat", 1.0, float(i)) for i in range(4)], "metric string, a double, b double")
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    got = {r.metric: r.rho for r in harness.spearman(df).collect()}
    assert got["m"] == pytest.approx(np.corrcoef(rank(a), rank(a + 40 * b))[0, 1]) and got["k"] == pytest.approx(-1) and got["flat"] is None
    ranks = {r.a: r["rank"] for r in quantiles.mean_ranks(df.where("metric = 'm'"), ["metric"], "a").collect()}
    assert all(ranks[x] == y for x, y in zip(a, rank(a)))


def plain_neighbours(rows, k):
    out = {}
    for g, o, i, x, y in rows:
        near = sorted((float(((np.array(x) - np.array(p)) ** 2).sum()), q, j) for h, q, j, p, _ in rows if h == g and q != o)[:k]
        out[o, i] = [(q, j) for _, q, j in near]
    return out


@pytest.mark.parametrize("whole,rows_,cell,pivots", [(8192, 50, 512, 1024), (0, 20, 8, 64), (10, 7, 5, 3)])
def test_neighbours_equal_all_pairs(spark, monkeypatch, whole, rows_, cell, pivots):
    for name, value in (("WHOLE", whole), ("ROWS", rows_), ("CELL", cell), ("PIVOTS", pivots)):
        monkeypatch.setattr(neighbors, name, value)
    rng = np.random.default_rng(6)
    rows = [(g, 100 * int(g == "b") + o, i, (rng.normal(size=3) + 8 * (o % 4)).round(2).tolist(), [float(o), float(i)]) for g, n in (("a", 30), ("b", 9)) for o in range(n) for i in range(4)]
    rows += [("a", 50 + o, 0, [1.0, 1.0, 1.0], [0.0, 0.0]) for o in range(25)] + [("c", 300, 0, [0.0] * 3, [0.0, 0.0]), ("c", 300, 1, [1.0] * 3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "grp string, owner long, item int, x array<double>, y array<double>")
    got = {}
    for r in neighbors.nearest_foreign(df, 5).orderBy("owner", "item", "rank").collect():
        got.setdefault((r.owner, r.item), []).append((r.near, r.near_item))
    plain = plain_neighbours(rows, 5)
    assert got == {k: v for k, v in plain.items() if v}


def test_neighbours_leave_far_cells_alone(spark, monkeypatch):
    """In clusters, a row asks few of its group's cells, and blocks stay bounded."""
    monkeypatch.setattr(neighbors, "CELL", 50)
    monkeypatch.setattr(neighbors, "WHOLE", 100)
    rng = np.random.default_rng(7)
    rows = [("g", o, 0, (rng.normal(size=4) * 0.1 + 20 * (o % 40)).tolist(), []) for o in range(4000)]
    df = stored(spark.createDataFrame(rows, "grp string, owner long, item int, x array<double>, y array<double>"))
    cells = neighbors.Cells(df)
    n = cells.cells.count()
    first = cells.answered(cells.rows.select("grp", "cell", *neighbors.ROW), 5)
    best = first.groupBy("owner", "item").agg(F.get(F.sort_array(F.collect_list("d")), F.lit(4)).alias("d")).where("d is not null")
    asked = cells.in_reach(best).count() / 4000
    assert n >= 70 and asked < n / 4
    assert batch.novelty(df.select("grp", F.col("owner").alias("episode_id"), "x")).count() == 4000


@pytest.mark.parametrize("fps", [30.0, 50.0])
def test_low_pass_over_chunk_borders(spark, monkeypatch, fps):
    """Series cut into chunks are filtered as if they were whole."""
    monkeypatch.setattr(spectral, "CHUNK", 64)
    monkeypatch.setattr(spectral, "LONG", 100)
    rng = np.random.default_rng(8)
    series = {e: np.cumsum(rng.normal(size=n)) for e, n in enumerate((20, 100, 101, 128, 191, 192, 1000, 5003))}
    df = spark.createDataFrame([(e, i, float(v)) for e, x in series.items() for i, v in enumerate(x)], "episode_id long, i int, speed double")
    got = {}
    for r in spectral.filtered_speed(df, fps).orderBy("episode_id", "i").collect():
        got.setdefault(r.episode_id, []).append((r.i, r.f))
    for e, x in series.items():
        assert [i for i, _ in got[e]] == list(range(len(x)))
        assert np.abs(np.array([f for _, f in got[e]]) - np.abs(spectral.lowpass(x, spectral.cutoff(fps), fps))).max() < 1e-9
