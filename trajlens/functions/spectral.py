"""Spectral measures of speed profiles: zero-phase low-pass and spectral arc length, as small numpy helpers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as m
from ..storage import stored

ORDER = 4
PAD = 3 * (ORDER + 1)
BATCH = 256
CHUNK = 4096
LONG = 4 * CHUNK  # samples of an episode that are one row while it is filtered
PIECE = 20  # windows that begin in one row of an episode's speeds


def cutoff(fps: float) -> float:
    return min(10.0, 0.4 * fps)


def butterworth(hz: float, fps: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass coefficients by the bilinear transform of the analog poles."""
    w = 2 * fps * math.tan(math.pi * hz / fps)
    poles = w * np.exp(1j * np.pi * (2 * np.arange(1, ORDER + 1) + ORDER - 1) / (2 * ORDER))
    a = np.real(np.poly((2 * fps + poles) / (2 * fps - poles)))
    b = np.real(np.poly(-np.ones(ORDER)))
    return b * a.sum() / b.sum(), a


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of x filtered, and the state behind its end; rows advance together, one sample a step."""
    z, out = state.copy(), np.empty_like(x)
    for i in range(x.shape[1]):
        v = x[:, i]
        y = out[:, i] = b[0] * v + z[0]
        for k in range(ORDER - 1):
            z[k] = b[k + 1] * v + z[k + 1] - a[k + 1] * y
        z[ORDER - 1] = b[ORDER] * v - a[ORDER] * y
    return out, z


def _advance(a: np.ndarray) -> np.ndarray:
    """What one sample does to the state, without its own value."""
    companion = np.zeros((ORDER, ORDER))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(ORDER - 1)
    return companion


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state in which a constant 1 stays as it is."""
    return np.linalg.solve(np.eye(ORDER) - _advance(a), b[1:] - a[1:] * b[0])


def lowpass_many(series: list[np.ndarray], hz: float, fps: float) -> list[np.ndarray]:
    """Forward and backward with odd padding; too short a series, or too high a cutoff, stays as it is.

    All series advance together, filled up with zeros behind their ends, which no earlier sample sees.
    """
    at = [i for i, x in enumerate(series) if len(x) > PAD] if 0 < hz < fps / 2 else []
    if not at:
        return list(series)
    b, a = butterworth(hz, fps)
    steady = _steady(b, a)
    long = [np.concatenate([2 * x[0] - x[PAD:0:-1], x, 2 * x[-1] - x[-2 : -PAD - 2 : -1]]) for x in (series[i] for i in at)]

    def one_way(rows: list[np.ndarray]) -> list[np.ndarray]:
        filled = np.zeros((len(rows), max(map(len, rows))))
        for row, x in zip(filled, rows):
            row[: len(x)] = x
        done, _ = _filter(b, a, filled, steady[:, None] * filled[:, 0])
        return [y[: len(x)][::-1] for y, x in zip(done, rows)]

    out = list(series)
    for i, y in zip(at, one_way(one_way(long))):
        out[i] = y[PAD:-PAD]
    return out


def lowpass(x: np.ndarray, hz: float, fps: float) -> np.ndarray:
    return lowpass_many([x], hz, fps)[0]


def arc_length(speed: np.ndarray, fps: float, hz: float, least: float = 0.05, padding: int = 4) -> float:
    """Negative arc length of the normalised amplitude spectrum over the band that carries movement."""
    if len(speed) < 4 or not np.all(np.isfinite(speed)):
        return math.nan
    n = int(2 ** (math.ceil(math.log2(len(speed))) + padding))
    amplitude = np.abs(np.fft.fft(speed, n))[: n // 2]
    freq = np.arange(n // 2) * fps / n
    if not amplitude.max() > 0:
        return math.nan
    amplitude = amplitude / amplitude.max()
    band = np.flatnonzero((freq <= hz) & (amplitude >= least))
    if not len(band) or band[-1] == band[0]:
        return math.nan
    lo, hi = band[0], band[-1] + 1
    step = np.diff(freq[lo:hi]) / (freq[hi - 1] - freq[lo])
    return float(-np.sqrt(step**2 + np.diff(amplitude[lo:hi]) ** 2).sum())


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e)[:200]}"


def filtered_whole(speed: DataFrame, fps: float) -> DataFrame:
    """speed(episode_id, i, speed) -> episode_id, f (the absolute low-passed speeds in order), error: why an episode has none."""

    def one(x: np.ndarray) -> tuple[np.ndarray | None, str | None]:
        try:
            return np.abs(lowpass(np.asarray(x, dtype=float), cutoff(fps), fps)), None
        except Exception as e:  # noqa: BLE001  the episode's own failure
            return None, told(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            order = frame["x"].map(len).argsort(kind="stable").to_numpy()
            for k in range(0, len(frame), BATCH):  # episodes of like length together
                part = frame.iloc[order[k : k + BATCH]]
                try:
                    found = [(np.abs(y), None) for y in lowpass_many([np.asarray(x, dtype=float) for x in part["x"]], cutoff(fps), fps)]
                except Exception:  # noqa: BLE001  one of them failed: each alone
                    found = [one(x) for x in part["x"]]
                yield pd.DataFrame({"episode_id": part["episode_id"].tolist(), "f": [f for f, _ in found], "error": [e for _, e in found]})

    whole = speed.groupBy("episode_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "speed"))), lambda s: s.speed).alias("x"))
    return whole.mapInPandas(run, f"episode_id {dict(speed.dtypes)['episode_id']}, f array<double>, error string")


def filtered_speed(speed: DataFrame, fps: float) -> DataFrame:
    """speed(episode_id, i, speed) -> episode_id, i, f: the absolute low-passed speed of each episode, however long."""
    speed = stored(speed.select("episode_id", "i", "speed"))
    n = stored(speed.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG))
    if not n.take(1):
        return filtered_whole(speed, fps).select("episode_id", F.posexplode("f").alias("i", "f"))
    short = filtered_whole(speed.join(n, "episode_id", "left_anti"), fps)
    return short.select("episode_id", F.posexplode("f").alias("i", "f")).unionByName(filtered_chunks(speed.join(n, "episode_id"), fps))


def filtered_chunks(speed: DataFrame, fps: float) -> DataFrame:
    """speed(episode_id, i, speed, n) of long episodes -> episode_id, i, f, filtered in chunks of CHUNK samples.

    A recursive filter is a linear map of its state, so what a chunk does to any state is a fixed matrix power and what it adds
    by itself. Each chunk adds up its own part from rest; an episode's few sums, one a chunk, give every chunk the state that it
    begins with; then each chunk is filtered for good. The same again from the end. Samples are numbered from 0 without gaps.
    """
    hz = cutoff(fps)
    key = dict(speed.dtypes)["episode_id"]
    b, a = butterworth(hz, fps) if 0 < hz < fps / 2 else (np.eye(1, ORDER + 1)[0], np.eye(1, ORDER + 1)[0])
    advance, steady = _advance(a), _steady(b, a)
    last = F.floor(F.col("n") / CHUNK) - 1  # the last chunk takes what is left, so every chunk is longer than the padding
    parts = speed.withColumn("chunk", F.least(F.floor(F.col("i") / CHUNK), last).cast("int")).groupBy("episode_id", "chunk", (last.cast("int")).alias("last"))
    chunks = parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "speed"))), lambda s: s.speed).alias("x"))
    schema = f"episode_id {key}, chunk int, last int, x array<double>, end array<double>, first double"

    def alike(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for size, part in frame.groupby(frame["x"].map(len)):
            for at in range(0, len(part), BATCH):
                own = part.iloc[at : at + BATCH]
                yield own, np.stack(own["x"].tolist()).astype(float).reshape(len(own), size)

    def summed(own: pd.DataFrame, rows: np.ndarray) -> pd.DataFrame:
        """rows in the order in which they are filtered, with the state that they leave behind from rest."""
        _, z = _filter(b, a, rows, np.zeros((ORDER, len(rows))))
        return pd.DataFrame({"episode_id": own["episode_id"].tolist(), "chunk": own["chunk"].to_numpy(), "last": own["last"].to_numpy(), "x": list(rows), "end": list(z.T), "first": rows[:, 0]})

    def padded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.copy()
            xs = [np.asarray(x, dtype=float) for x in frame["x"]]
            xs = [np.concatenate([2 * x[0] - x[PAD:0:-1], x]) if c == 0 else x for x, c in zip(xs, frame["chunk"])]
            frame["x"] = [np.concatenate([x, 2 * x[-1] - x[-2 : -PAD - 2 : -1]]) if c == e else x for x, c, e in zip(xs, frame["chunk"], frame["last"])]
            for own, rows in alike(frame):
                yield summed(own, rows)

    def begun(sums: pd.DataFrame, forward: bool) -> pd.DataFrame:
        """The state with which each chunk of an episode begins."""
        sums = sums.sort_values("chunk", ascending=forward)
        state, out = steady * sums["first"].iloc[0], []
        for size, end in zip(sums["size"], sums["end"]):
            out.append(state)
            state = np.linalg.matrix_power(advance, int(size)) @ state + np.asarray(end)
        return pd.DataFrame({"episode_id": sums["episode_id"].tolist(), "chunk": sums["chunk"].to_numpy(), "state": out})

    def one_way(blocks: DataFrame, forward: bool) -> DataFrame:
        sums = blocks.select("episode_id", "chunk", F.size("x").alias("size"), "end", "first")
        states = sums.groupBy("episode_id").applyInPandas(lambda own: begun(own, forward), f"episode_id {key}, chunk int, state array<double>")
        return blocks.drop("end", "first").join(states, ["episode_id", "chunk"])

    def filtered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, rows in alike(frame):
                y, _ = _filter(b, a, rows, np.stack(own["state"].tolist()).astype(float).T)
                yield own.assign(x=list(y[:, ::-1]))

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in filtered(frames):
            for own, rows in alike(frame):
                yield summed(own, rows)

    def done(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in filtered(frames):
            cut = [np.abs(x[PAD * (c == 0) : len(x) - PAD * (c == e)]) for x, c, e in zip(own["x"], own["chunk"], own["last"])]
            yield pd.DataFrame({"episode_id": own["episode_id"].tolist(), "chunk": own["chunk"].to_numpy(), "f": cut})

    forth = stored(one_way(stored(chunks.mapInPandas(padded, schema)), True).mapInPandas(back, schema))
    out = one_way(forth, False).mapInPandas(done, f"episode_id {key}, chunk int, f array<double>")
    return out.select("episode_id", "chunk", F.posexplode("f").alias("i", "f")).select("episode_id", (F.col("i") + F.col("chunk") * CHUNK).cast("int").alias("i"), "f")


def filtered_keyed(series: DataFrame, fps: float) -> DataFrame:
    """series(episode_id, t, v) -> episode_id, i, f in the order of t."""
    return filtered_speed(series.select("episode_id", F.col("t").alias("i"), F.col("v").alias("speed")), fps)


def by_window(windows: DataFrame, measure: Callable[[np.ndarray], tuple], names: list[str]) -> DataFrame:
    """windows(episode_id, [signal,] win, i, speed) -> their keys, what measure says of each window's speeds, and error where it failed.

    An episode's windows may lie in many tasks. A window that fails is a row with an error, not the end of the task.
    """
    key = [c for c in ("episode_id", "signal", "win") if c in windows.columns]

    def one(x: np.ndarray) -> tuple:
        try:
            return (*measure(np.asarray(x)), None)
        except Exception as e:  # noqa: BLE001  the window's own failure
            return (*[math.nan] * len(names), told(e))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = pd.DataFrame([one(x) for x in frame["x"]], columns=[*names, "error"], index=frame.index).astype(dict.fromkeys(names, float))
            yield pd.concat([frame[key], found], axis=1)

    whole = windows.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "speed"))), lambda s: s.speed).alias("x"))
    types = dict(windows.dtypes)
    return whole.mapInPandas(run, ", ".join([f"{c} {types[c]}" for c in key] + [f"{c} double" for c in names] + ["error string"]))


def _cut(fps: float) -> tuple[int, int]:
    """Samples of a window, and from one's start to the next's."""
    size = max(m.MIN_WINDOW, round(m.WINDOW_S * fps))
    return size, max(1, size // 2)


def pieces(speed: DataFrame, fps: float) -> DataFrame:
    """speed(episode_id, i, speed) -> episode_id, piece, x: the speeds in order, a row for every PIECE windows.

    A row also has the samples in which its last windows end, so every complete window lies in one row, and no row grows with its
    episode. Samples are numbered from 0 without gaps.
    """
    size, step = _cut(fps)
    own = F.floor(F.col("i") / (PIECE * step))
    ends = (own > 0) & (F.col("i") - own * (PIECE * step) < size - step)
    rows = speed.select("episode_id", "i", "speed", F.explode(F.when(ends, F.array(own - 1, own)).otherwise(F.array(own))).alias("piece"))
    return rows.groupBy("episode_id", "piece").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "speed"))), lambda s: s.speed).alias("x"))


def _by_rows(table: DataFrame, measure: Callable[[np.ndarray], tuple], names: list[str], fps: float) -> DataFrame:
    """Like by_window, but measure takes windows of one length as rows of a matrix, and gives a column for each name.

    table has pieces(episode_id, piece, x), or windows(episode_id, win, i, speed) of any length.
    """
    packed = "piece" in table.columns
    size, step = _cut(fps)
    key = ["episode_id", "win"]

    def windows(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        xs = [np.asarray(x, dtype=float) for x in frame["x"]]
        if not packed:
            return frame["episode_id"].to_numpy(), frame["win"].to_numpy(), xs
        cuts: list[tuple[int, int, np.ndarray]] = []
        for at, (x, piece) in enumerate(zip(xs, frame["piece"])):
            if len(x) >= size:
                cuts += [(at, piece * PIECE + k, x[k * step : k * step + size]) for k in range((len(x) - size) // step + 1)]
            elif piece == 0 and len(x) >= m.MIN_WINDOW:
                cuts.append((at, 0, x))
        return frame["episode_id"].to_numpy()[[c[0] for c in cuts]], np.array([c[1] for c in cuts], dtype=np.int64), [c[2] for c in cuts]

    def measured(rows: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
        try:
            return np.column_stack(measure(rows)), [None] * len(rows)
        except Exception as e:  # noqa: BLE001  the window's own failure, or that of one among many: each alone
            if len(rows) == 1:
                return np.full((1, len(names)), math.nan), [told(e)]
            alone = [measured(rows[i : i + 1]) for i in range(len(rows))]
            return np.concatenate([v for v, _ in alone]), [e[0] for _, e in alone]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, wins, xs = windows(frame)
            sizes = np.array([len(x) for x in xs])
            for length in np.unique(sizes):
                like = np.flatnonzero(sizes == length)
                for k in range(0, len(like), BATCH):
                    at = like[k : k + BATCH]
                    values, errors = measured(np.stack([xs[i] for i in at]))
                    yield pd.DataFrame({"episode_id": ids[at], "win": wins[at], **{n: values[:, c] for c, n in enumerate(names)}, "error": pd.Series(errors, dtype=object)})

    if not packed:
        table = table.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "speed"))), lambda s: s.speed).alias("x"))
    types = dict(table.dtypes)
    return table.mapInPandas(run, f"episode_id {types['episode_id']}, win long, " + ", ".join(f"{c} double" for c in names) + ", error string")


def arc_lengths(rows: np.ndarray, fps: float, hz: float, least: float = 0.05, padding: int = 4) -> np.ndarray:
    """arc_length of every row."""
    out, length = np.full(len(rows), math.nan), rows.shape[1]
    fine = np.flatnonzero(np.isfinite(rows).all(axis=1)) if length >= 4 else np.zeros(0, dtype=int)
    if not len(fine):
        return out
    n = int(2 ** (math.ceil(math.log2(length)) + padding))
    amplitude = np.abs(np.fft.rfft(rows[fine], n))[:, : n // 2]
    most = amplitude.max(axis=1)
    fine, amplitude, most = fine[most > 0], amplitude[most > 0], most[most > 0]
    freq = np.arange(n // 2) * fps / n
    freq = freq[freq <= hz]
    amplitude = amplitude[:, : len(freq)] / most[:, None]
    carries = amplitude >= least
    lo, hi = carries.argmax(axis=1), len(freq) - 1 - carries[:, ::-1].argmax(axis=1)
    some = carries.any(axis=1) & (hi > lo)
    fine, amplitude, lo, hi = fine[some], amplitude[some], lo[some], hi[some]
    if not len(fine):
        return out
    step = np.diff(freq)[None] / (freq[hi] - freq[lo])[:, None]
    at = np.arange(len(freq) - 1)[None]
    length = np.sqrt(step**2 + np.diff(amplitude, axis=1) ** 2)
    out[fine] = -np.where((at >= lo[:, None]) & (at < hi[:, None]), length, 0.0).sum(axis=1)
    return out


def window_arc_length(windows: DataFrame, fps: float) -> DataFrame:
    """pieces(episode_id, piece, x) or windows(episode_id, win, i, speed) -> episode_id, win, v, error."""
    hz = cutoff(fps)
    return _by_rows(windows, lambda rows: (arc_lengths(rows, fps, hz),), ["v"], fps).where("error is not null or not isnan(v)")


def window_jerk(windows: DataFrame, fps: float) -> DataFrame:
    """pieces or windows -> episode_id, win, v: the log dimensionless jerk of each window that moves."""

    def measure(rows: np.ndarray) -> tuple[np.ndarray]:
        jerk, peak = np.diff(rows, n=2, axis=1) * fps * fps, np.max(np.abs(np.nan_to_num(rows)), axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = ((rows.shape[1] - 1) / fps) ** 3 / (peak * peak) * np.nansum(jerk * jerk, axis=1) / fps
            return (np.where((peak > 0) & (d > 0), -np.log(d), math.nan),)

    return _by_rows(windows, measure, ["v"], fps).where("error is null and not isnan(v)").drop("error")


def jerk_rms(speed: np.ndarray, fps: float, hz: float = 10.0) -> float:
    if len(speed) < 5:
        return math.nan
    applied = 0 < hz < fps / 2 and len(speed) > PAD
    x = lowpass(speed, hz, fps)
    trim = min(len(x) // 4, 3 * ORDER) if applied else 0
    x = x[trim : len(x) - trim]
    return float(np.sqrt(np.mean((np.diff(x, n=2) * fps**2) ** 2))) if len(x) >= 5 else math.nan


def power_ratio(speed: np.ndarray, fps: float) -> float:
    """Log of low over high band power, split at fps/4: Hann segments of 64, half overlapping, means removed."""
    n = min(len(speed), 64)
    if len(speed) < 8:
        return math.nan
    window = np.hanning(n + 1)[:-1]
    parts = [speed[k : k + n] for k in range(0, len(speed) - n + 1, n - n // 2)]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts], axis=0)
    power[1 : -1 if n % 2 == 0 else None] *= 2
    freq = np.fft.rfftfreq(n, 1 / fps)
    low, high = power[freq <= fps / 4].sum(), power[freq > fps / 4].sum()
    return float(np.log(low / high)) if low > 0 and high > 0 else math.nan


def jerks(rows: np.ndarray, fps: float, hz: float = 10.0) -> np.ndarray:
    """jerk_rms of every row."""
    if rows.shape[1] < 5:
        return np.full(len(rows), math.nan)
    applied = 0 < hz < fps / 2 and rows.shape[1] > PAD
    x = np.stack(lowpass_many(list(rows), hz, fps))
    trim = min(x.shape[1] // 4, 3 * ORDER) if applied else 0
    x = x[:, trim : x.shape[1] - trim]
    return np.sqrt(np.mean((np.diff(x, n=2, axis=1) * fps**2) ** 2, axis=1)) if x.shape[1] >= 5 else np.full(len(rows), math.nan)


def power_ratios(rows: np.ndarray, fps: float) -> np.ndarray:
    """power_ratio of every row."""
    length = rows.shape[1]
    n = min(length, 64)
    if length < 8:
        return np.full(len(rows), math.nan)
    window = np.hanning(n + 1)[:-1]
    parts = [rows[:, k : k + n] for k in range(0, length - n + 1, n - n // 2)]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean(axis=1, keepdims=True)) * window)) ** 2 for p in parts], axis=0)
    power[:, 1 : -1 if n % 2 == 0 else None] *= 2
    freq = np.fft.rfftfreq(n, 1 / fps)
    low, high = power[:, freq <= fps / 4].sum(axis=1), power[:, freq > fps / 4].sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((low > 0) & (high > 0), np.log(low / high), math.nan)


def spectral_metrics(windows: DataFrame, fps: float) -> DataFrame:
    """pieces or windows -> episode_id, win, jerk, ratio, error."""
    return _by_rows(windows, lambda rows: (jerks(rows, fps), power_ratios(rows, fps)), ["jerk", "ratio"], fps)
