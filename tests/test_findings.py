"""Queries against their SQL on small tables that the generated ones have nothing like."""

import threading
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlens import storage
from trajlens.functions import spectral
from trajlens.operators import metrics, neighbors, registry, signals
from trajlens.plans import quality
from trajlens.plans.sql import ORACLE


def _lines(order: int, values: list[tuple[float, float]]) -> list[tuple]:
    return [(order, 1, 1, k + 1, q, p, 0.0, 0.0, datetime(2001, 1, 1) + timedelta(days=k)) for k, (q, p) in enumerate(values)]


@pytest.fixture(scope="module")
def long_orders(spark, tmp_path_factory):
    """An order of 60 lines, which a low-pass would change, with still stretches; one of two equal lines; two plain ones."""
    moving = [(float(k * 7 % 11), 100.0 + (k * 13 % 17)) for k in range(20)]
    rows = _lines(1, moving + [(3.0, 104.0)] * 12 + moving[::-1] + [(5.0, 110.0)] * 8) + _lines(2, [(4.0, 9.0)] * 2) + _lines(3, moving[:5]) + _lines(4, moving[:12])
    d = str(tmp_path_factory.mktemp("long") / "d")
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return d


def _same(spark, d: str, name: str, least: int) -> None:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet/*.parquet'")
    df, found = quality.queries()[name](spark, d), con.execute(ORACLE[name])
    names = sorted(x[0] for x in found.description)
    at = [[x[0] for x in found.description].index(c) for c in names]
    expected = sorted(tuple(r[i] for i in at) for r in found.fetchall())
    assert sorted(df.columns) == names and len(expected) >= least
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == expected


def test_time_metrics_of_long_orders(spark, long_orders):
    _same(spark, long_orders, "time_metrics", 10)


def test_temporal_tags_of_long_orders(spark, long_orders):
    _same(spark, long_orders, "temporal_tags", 3)


def test_idle_spans_of_long_orders(spark, long_orders):
    _same(spark, long_orders, "idle_spans", 3)


def test_windows_of_one_length_are_measured_together(monkeypatch):
    rows = np.abs(np.random.default_rng(0).normal(size=(200, 90)))
    rows[3, 7], rows[5] = np.nan, 0.0
    calls, filtered = [], spectral._filter
    monkeypatch.setattr(spectral, "_filter", lambda *a: calls.append(1) or filtered(*a))
    jerk = spectral.jerks(rows, 30.0)
    assert len(calls) == 2  # forward and back, not twice a window
    plain = lambda f, *a: np.array([f(x, 30.0, *a) for x in rows])
    assert np.allclose(jerk, plain(spectral.jerk_rms), equal_nan=True)
    assert np.allclose(spectral.power_ratios(rows, 30.0), plain(spectral.power_ratio), equal_nan=True)
    assert np.allclose(spectral.arc_lengths(rows, 30.0, 10.0), plain(spectral.arc_length, 10.0), equal_nan=True)


def test_pieces_have_the_windows_of_whole_episodes(spark):
    """Episodes shorter than a window, of one, just below two, and over several pieces."""
    rows = [(e, i, float((i * 37 + e * 11) % 101)) for e, n in enumerate([10, 16, 89, 90, 134, 135, 900, 2500]) for i in range(n)]
    speed = spark.createDataFrame(rows, "episode_id long, i int, speed double")
    found = {(r.episode_id, r.win): r.v for r in spectral.window_arc_length(spectral.pieces(speed, 30.0), 30.0).collect()}
    plain = {(r.episode_id, r.win): r.v for r in spectral.window_arc_length(signals.windows(speed, 30.0, 3.0, 16), 30.0).collect()}
    assert found.keys() == plain.keys() and len(found) > 60
    assert all(abs(found[k] - plain[k]) < 1e-9 for k in plain)


def _dealt(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_units_spikes_and_grasps_deal_frames_out_once(spark):
    rows = [(e, i, [float((i * k + e) % 17) for k in (3, 5, 7)], [float((i * k + e) % 13) for k in (3, 5, 7)]) for e in range(3) for i in range(40)]
    frames = spark.createDataFrame(rows, "episode_id long, idx int, action array<double>, state array<double>")
    own = signals.with_units(frames)
    assert _dealt(own) == 1
    own = storage.stored(own)
    for df in (metrics.frame_spikes(own, [0, 1], 30.0, 1.0, 1.0), metrics.missed_grasps(own, [2], 30.0, True, "arm"), metrics.tracked(own, [0, 1], 30.0, [[0, 1]]), metrics.idle_flags(signals.group_speed(own, [0], 30.0).withColumnRenamed("speed", "f"))):
        assert _dealt(df) == 1
    plain = metrics.accel_spikes(signals.acceleration(own, [0, 1], 30.0), 1.0, 1.0)
    assert sorted(map(tuple, metrics.frame_spikes(own, [0, 1], 30.0, 1.0, 1.0).collect())) == sorted(map(tuple, plain.collect()))


def test_metrics_run_side_by_side(spark, monkeypatch):
    """Two metrics that wait for each other; they share what one of them makes."""
    frames = spark.createDataFrame([(1, i, [float(i % 5)], [float(i % 3)]) for i in range(20)], "episode_id long, idx int, action array<double>, state array<double>")
    r = registry.Recording(frames, spark.createDataFrame([(1, "s", "t")], "episode_id long, source_id string, task_key string"), 30.0, quality.PICKS)
    both, made = threading.Barrier(2, timeout=60), []

    def met(name):
        both.wait()
        own = r.once("shared", lambda: made.append(1) or r.own)
        return [metrics.named(own.groupBy("episode_id").count(), name, F.col("count"))]

    for name in ("length_z", "ldlj"):
        monkeypatch.setitem(registry.FUNCTIONS, name, lambda _, name=name: met(name))
    raw, failures = registry.compute_raw(r, ["length_z", "ldlj"])
    assert failures.count() == 0 and len(made) == 1
    assert sorted((x.metric, x.value) for x in raw.collect()) == [("ldlj", 20.0), ("length_z", 20.0)]


def test_neighbours_of_wide_rows_travel_by_blocks(spark, monkeypatch):
    """A group of many dimensions is one cell: no row travels once for every cell that pivots don't rule out. Found rows equal those of all pairs."""
    monkeypatch.setattr(neighbors, "WHOLE", 100)
    monkeypatch.setattr(neighbors, "ROWS", 150)
    x = np.random.default_rng(1).normal(size=(400, 32)) * 1e-3 + 5.0  # far from 0: products alone would round the order away
    x[7] = x[300]
    df = spark.createDataFrame([("g", i, 0, [float(v) for v in r], []) for i, r in enumerate(x)], "grp string, owner long, item int, x array<double>, y array<double>")
    assert not neighbors.Cells(df).split
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for r in neighbors.nearest_foreign(df, 5).collect():
        assert r.near == np.argsort(d[r.owner], kind="stable")[r.rank - 1] and abs(r.d - d[r.owner, r.near]) < 1e-15
