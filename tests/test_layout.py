"""A small recorded dataset on disk: declared features, recorded order, missing episodes and unreadable files."""

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trajlens.sources import layout


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("dataset")
    (d / "meta").mkdir()
    features = {
        "action": {"dtype": "float32", "shape": [2], "names": {"motors": ["a", "b"]}},
        "observation.state": {"dtype": "float32", "shape": [2]},
        "timestamp": {"dtype": "float32", "shape": [1]},
        "annotation.x": {"dtype": "float32", "shape": [3]},
        "cam": {"dtype": "video", "shape": [4, 4, 3]},
    }
    (d / "meta/info.json").write_text(json.dumps({"fps": 20, "robot_type": "arm", "data_path": "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet", "features": features}))
    (d / "meta/stats.json").write_text(json.dumps({"action": {"min": [0, 1], "max": [2, 3]}}))
    rows = [(e, i, i / 20.0, [float(100 * e + i), 0.0], [float(-i), 1.0]) for e in (0, 1) for i in ([0, 1, 3, 2] if e else range(3))]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp float, action array<float>, `observation.state` array<float>")
    df.coalesce(1).write.parquet(str(d / "data/chunk-000/file-000.parquet"))
    return str(d)


def test_declared_facts(spark, root):
    s = layout.open_source(spark, "s1", root)
    assert (s.fps, s.robot_type, s.vector_features(), s.cameras()) == (20.0, "arm", {"action": 2, "observation.state": 2}, ["cam"])
    assert s.dim_names("action") == ["a", "b"] and s.dim_names("observation.state") == ["observation.state[0]", "observation.state[1]"]
    assert layout.feature_bounds(spark, s, "action") == ([0.0, 1.0], [2.0, 3.0]) and layout.feature_bounds(spark, s, "observation.state") is None


def test_episodes_and_errors(spark, root):
    s = layout.open_source(spark, "s1", root)
    refs = spark.createDataFrame([(0, 0, 0, 3), (1, 0, 0, 4), (7, 0, 9, 5)], "episode_index long, chunk int, file int, expected long")
    files = layout.data_files(refs, s)
    paths = [r.path for r in files.select("path").distinct().collect()]
    assert any(p.endswith("data/chunk-000/file-009.parquet") for p in paths)
    frames = layout.read_frames(spark, s, "action", "missing", [p for p in paths if p.endswith("file-000.parquet")])
    got = {r.episode_index: r for r in layout.build_episodes(refs, frames).collect()}
    assert got[0].length == 3 and got[1].length == 4 and got[7].length is None and "7" in got[7].error
    assert [f.frame_index for f in got[1].frames] == [0, 1, 2, 3] and [f.action[0] for f in got[1].frames] == [100.0, 101.0, 102.0, 103.0]
    rows = sorted((r.row_index, r.frame_index) for r in frames.where("episode_index = 1").collect())
    assert [f for _, f in rows] == [0, 1, 3, 2] and frames.where(F.col("state").isNotNull()).count() == 0


def test_many_sources_in_one_read(spark, root, tmp_path):
    """Three sources of two layouts: one can't be opened, one is unknown; a broken file, a missing one and odd sizes are rows."""
    other = tmp_path / "other"
    (other / "meta").mkdir(parents=True)
    (other / "meta/info.json").write_text(json.dumps({"fps": 10, "data_path": "rows/{chunk_index}/part-{file_index:02d}.parquet", "features": {"action": {"dtype": "float32", "shape": [2]}}}))
    rows = [(e, i, i / 10.0, [1.0 * i] * (3 if e == 6 else 2)) for e in (5, 6) for i in range(4)]
    spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double, action array<double>").coalesce(1).write.parquet(str(other / "rows/0/part-00.parquet"))
    (other / "rows/0/part-01.parquet").mkdir()
    (other / "rows/0/part-01.parquet/part.parquet").write_bytes(b"not a table")
    whole = str(other / "rows/0/part-00.parquet")
    names = {n: str(next(p for p in Path(n).glob("*.parquet"))) for n in (whole, f"{root}/data/chunk-000/file-000.parquet")}
    flat = lambda n, to: shutil.copy(names[n], to)  # noqa: E731  one file each, as datasets have
    (tmp_path / "a/data/chunk-000").mkdir(parents=True)
    (tmp_path / "b/rows/0").mkdir(parents=True)
    shutil.copytree(f"{root}/meta", tmp_path / "a/meta")
    shutil.copytree(other / "meta", tmp_path / "b/meta")
    flat(f"{root}/data/chunk-000/file-000.parquet", tmp_path / "a/data/chunk-000/file-000.parquet")
    flat(whole, tmp_path / "b/rows/0/part-00.parquet")
    (tmp_path / "b/rows/0/part-01.parquet").write_bytes(b"not a table")
    sources, broken = layout.open_sources(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b"), "gone": str(tmp_path / "nowhere")})
    assert [s.source_id for s in sources] == ["a", "b"] and list(broken) == ["gone"]
    refs = spark.createDataFrame([("a", 0, 0, 0, 3), ("a", 1, 0, 0, 5), ("a", 9, 0, 0, 1), ("a", 2, 0, 7, 1), ("b", 5, 0, 0, 4), ("b", 6, 0, 0, 4), ("b", 8, 0, 1, 4), ("gone", 0, 0, 0, 1), ("who", 0, 0, 0, 1)], "source_id string, episode_index long, chunk int, file int, expected long")
    got = {(r.source_id, r.episode_index): r for r in layout.read_many(spark, sources, broken, refs, "action", "observation.state").collect()}
    assert len(got) == 9 and got["a", 0].error is None and got["a", 0].length == 3 and got["a", 0].fps == 20.0 and got["a", 0].frames[2].state == [-2.0, 1.0]
    assert got["b", 5].error is None and [f.action for f in got["b", 5].frames] == [[float(i)] * 2 for i in range(4)] and got["b", 5].frames[0].state is None
    said = {k: r.error for k, r in got.items() if r.error}
    assert said.pop(("gone", 0)).startswith("source can't be opened")
    assert said == {("a", 1): "4 of 5 rows found", ("a", 9): "no rows for episode 9", ("a", 2): "file-007.parquet: missing or unreadable", ("b", 6): "action has 3 to 3 values, 2 are declared", ("b", 8): "part-01.parquet: missing or unreadable", ("who", 0): "unknown source who"}
    none = layout.read_many(spark, [], {}, refs.where("source_id = 'who'"), "action", None).collect()
    assert [r.error for r in none] == ["unknown source who"]
