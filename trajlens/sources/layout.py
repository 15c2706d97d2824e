"""Recorded datasets on disk: declared features, episode references, frames, and failures as rows.

A dataset root holds ``meta/info.json`` (frame rate, robot, path templates, features), optionally ``meta/stats.json``,
and Parquet files of frames, several episodes a file. Any store that Spark reads will do.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Columns that describe a frame and are no feature, and types of vector features.
BOOKKEEPING = ("timestamp", "frame_index", "episode_index", "index", "task_index")
NUMERIC = ("float16", "float32", "float64", "int8", "int16", "int32", "int64")


@dataclass(frozen=True)
class Source:
    """What a dataset root declares."""

    source_id: str
    loc: str
    fps: float
    robot_type: str
    data_path: str
    features: dict = field(default_factory=dict)

    def vector_features(self) -> dict[str, int]:
        """Numeric features of one dimension and their sizes; bookkeeping and annotations are none."""
        found = {}
        for name, f in self.features.items():
            shape = f.get("shape") or []
            if name not in BOOKKEEPING and not name.startswith("annotation") and f.get("dtype") in NUMERIC and len(shape) == 1:
                found[name] = int(shape[0])
        return found

    def cameras(self) -> list[str]:
        return sorted(k for k, f in self.features.items() if f.get("dtype") == "video")

    def dim_names(self, feature: str) -> list[str]:
        """Declared names of a feature's dimensions, else feature[i]."""
        names, n = self.features[feature].get("names"), self.vector_features().get(feature, 0)
        if isinstance(names, dict):
            names = next((v for v in names.values() if isinstance(v, list)), None)
        return [str(x) for x in names] if isinstance(names, list) and len(names) == n else [f"{feature}[{i}]" for i in range(n)]


def _document(spark: SparkSession, path: str) -> dict | None:
    rows = spark.read.text(path, wholetext=True).collect()  # one metadata file
    return json.loads(rows[0][0]) if rows else None


def open_source(spark: SparkSession, source_id: str, loc: str) -> Source:
    info = _document(spark, f"{loc}/meta/info.json")
    return Source(source_id, loc.rstrip("/"), float(info["fps"]), info.get("robot_type") or "", info["data_path"], info.get("features", {}))


def feature_bounds(spark: SparkSession, source: Source, feature: str) -> tuple[list[float], list[float]] | None:
    """Declared minimum and maximum of a feature; None where the statistics are missing or unreadable."""
    try:
        stats = _document(spark, f"{source.loc}/meta/stats.json")
        return [float(x) for x in stats[feature]["min"]], [float(x) for x in stats[feature]["max"]]
    except Exception:  # noqa: BLE001  a dataset without statistics is no error
        return None


def data_files(refs: DataFrame, source: Source) -> DataFrame:
    """refs(episode_index, chunk, file) with path: the template's file of each episode."""
    template = source.data_path
    parts = F.lit(template)
    for name, col in (("chunk_index", "chunk"), ("file_index", "file")):
        for width in range(6, -1, -1):
            token = "{" + name + (f":0{width}d" if width else "") + "}"
            if token in template:
                parts = F.replace(parts, F.lit(token), F.lpad(F.col(col).cast("string"), width, "0") if width else F.col(col).cast("string"))
    return refs.withColumn("path", F.concat(F.lit(source.loc + "/"), parts))


def video_files(refs: DataFrame, source: Source, camera: str, template: str) -> DataFrame:
    """refs(episode_index, chunk, file) with path: the video file of each episode's camera."""
    return data_files(refs, replace(source, data_path=template.replace("{video_key}", camera)))


def read_frames(spark: SparkSession, source: Source, action: str | None, state: str | None, paths: list[str], episodes: DataFrame | None = None) -> DataFrame:
    """One row a frame in recorded order: only the bookkeeping and the picked vectors are read; unreadable files are skipped.

    episodes(episode_index): only these; Spark filters the scan with them where they are few. An episode that lost frames
    to an unreadable file is found by build_episodes, which knows how many were promised.
    """
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    df = reader.parquet(*paths)
    vector = lambda name: F.col(f"`{name}`").cast("array<double>") if name and name in df.columns else F.lit(None).cast("array<double>")
    df = df.select(F.lit(source.source_id).alias("source_id"), F.col("episode_index").cast("long"), F.col("frame_index").cast("long"), F.col("timestamp").cast("double"), F.col("_metadata.row_index").alias("row_index"), vector(action).alias("action"), vector(state).alias("state"))
    return df.join(episodes.select("episode_index").distinct(), "episode_index", "left_semi") if episodes is not None else df


def build_episodes(refs: DataFrame, frames: DataFrame) -> DataFrame:
    """refs(episode_index, expected) -> one row an episode: frames sorted by number (recorded order at ties), length, error.

    An episode without frames, or with fewer than expected, is a row with an error, not an exception; the frames that
    were found stay. A null expected promises nothing.
    """
    ordered = F.sort_array(F.collect_list(F.struct("frame_index", "row_index", "timestamp", "action", "state")))
    built = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"), ordered.alias("frames"))
    df = refs.join(built, "episode_index", "left")
    none = F.concat(F.lit("no rows for episode "), F.col("episode_index").cast("string"))
    fewer = F.format_string("%d of %d rows found", "length", "expected")
    return df.withColumn("error", F.when(F.col("length").isNull(), none).when(F.col("length") < F.col("expected"), fewer))


def read_episode(refs: DataFrame, frames: DataFrame, episode_index: int) -> Row:
    """One episode; raises where it can't be read whole."""
    row = build_episodes(refs.where(F.col("episode_index") == episode_index), frames.where(F.col("episode_index") == episode_index)).first()
    if row is None or row["error"]:
        raise LookupError(row["error"] if row else f"unknown episode {episode_index}")
    return row


def failures(episodes: DataFrame) -> DataFrame:
    """error, k: how many episodes failed in each way (digits aside)."""
    return episodes.where("error is not null").groupBy(F.regexp_replace("error", "[0-9]+", "n").alias("error")).agg(F.count(F.lit(1)).alias("k"))


def open_sources(spark: SparkSession, locs: dict[str, str]) -> tuple[list[Source], dict[str, str]]:
    """The sources that can be opened, and why each of the others can't; metadata is one small file a source."""
    found, broken = [], {}
    for source_id, loc in locs.items():
        try:
            found.append(open_source(spark, source_id, loc))
        except Exception as e:  # noqa: BLE001  a source that can't be opened is a row for each of its episodes
            broken[source_id] = f"source can't be opened: {type(e).__name__}"
    return found, broken


def _plain(path: Column) -> Column:
    """A path without scheme and host, as a reference and a scan both name it."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def read_many(spark: SparkSession, sources: list[Source], broken: dict[str, str], refs: DataFrame, action: str | None, state: str | None) -> DataFrame:
    """refs(source_id, episode_index, chunk, file, expected) of any sources -> one row each with length, frames, fps, robot_type and error.

    Sources whose files have the same picked arrays are one scan over their folders; a frame finds its reference by the path of its
    file, which is never listed on the driver. Errors are rows: an unknown source or one that can't be opened, a file that is
    missing or unreadable, an episode without rows or with fewer than promised, vectors of another size than declared.
    """
    size = lambda s, name: s.vector_features().get(name) if name else None
    known = spark.createDataFrame([(s.source_id, s.loc + "/" + s.data_path, s.fps, s.robot_type, size(s, action), size(s, state)) for s in sources], "source_id string, template string, fps double, robot_type string, a int, s int")  # one row a source
    why = spark.createDataFrame(list(broken.items()), "source_id string, why string")
    path = F.col("template")
    for name, col in (("chunk_index", "chunk"), ("file_index", "file")):
        for width in range(7):
            token = "{" + name + (f":0{width}d" if width else "") + "}"
            path = F.replace(path, F.lit(token), F.lpad(F.col(col).cast("string"), width, "0") if width else F.col(col).cast("string"))
    asked = refs.join(known, "source_id", "left").join(why, "source_id", "left").withColumn("path", _plain(path))
    groups: dict[tuple[bool, bool], list[str]] = {}
    for s in sources:
        root = f"{s.loc}/{s.data_path.split('{')[0].rpartition('/')[0]}".rstrip("/")
        groups.setdefault((size(s, action) is not None, size(s, state) is not None), []).append(root)
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true")
    frames = None
    for (has_action, has_state), roots in groups.items():
        df = reader.parquet(*sorted(set(roots)))
        column = lambda name, has, df=df: F.col(f"`{name}`").cast("array<double>") if has and name in df.columns else F.lit(None).cast("array<double>")
        part = df.select(_plain(F.col("_metadata.file_path")).alias("path"), F.col("episode_index").cast("long"), F.col("frame_index").cast("long"), F.col("timestamp").cast("double"), F.col("_metadata.row_index").alias("row_index"), column(action, has_action).alias("action"), column(state, has_state).alias("state"))
        frames = part if frames is None else frames.unionByName(part)
    key = ["path", "episode_index"]
    if frames is None:
        built, seen = asked.select(*key).where("false").withColumn("length", F.lit(0)).withColumn("frames", F.lit(None)).withColumn("sizes", F.lit(None)), asked.select("path").where("false")
    else:
        ordered = F.sort_array(F.collect_list(F.struct("frame_index", "row_index", "timestamp", "action", "state")))
        ends = F.struct(*[f(F.size(v)).alias(f"{f.__name__}_{v}") for v in ("action", "state") for f in (F.min, F.max)])
        built = frames.join(asked.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("length"), ordered.alias("frames"), ends.alias("sizes"))
        seen = frames.select("path").distinct()
    df = asked.join(built, key, "left").join(seen.withColumn("read", F.lit(True)), "path", "left")
    odd = lambda v, c: F.when(F.col(c).isNotNull() & ((F.col(f"sizes.min_{v}") != F.col(c)) | (F.col(f"sizes.max_{v}") != F.col(c))), F.format_string(f"{v} has %d to %d values, %d are declared", f"sizes.min_{v}", f"sizes.max_{v}", c))
    error = F.coalesce(
        F.col("why"),
        F.when(F.col("template").isNull(), F.concat(F.lit("unknown source "), F.coalesce("source_id", F.lit("")))),
        F.when(F.col("read").isNull(), F.concat(F.element_at(F.split("path", "/"), -1), F.lit(": missing or unreadable"))),
        F.when(F.col("length").isNull(), F.concat(F.lit("no rows for episode "), F.col("episode_index").cast("string"))),
        F.when(F.col("length") < F.col("expected"), F.format_string("%d of %d rows found", "length", "expected")),
        *([odd("action", "a"), odd("state", "s")] if frames is not None else []),
    )
    return df.select(*refs.columns, "fps", "robot_type", "length", "frames", error.alias("error"))
