"""Structured Streaming twins of the sequence operators.

Frames of a stream are assumed ordered within a trigger's files, as the batch operators define them; every
micro-batch sorts its rows by time before it touches state. A watermark (an addition) bounds the state of
windowed counts; keyed state keeps at most what its ``ttl`` allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerograph.config import DEFAULT
from aerograph.scratch import remove


def read_frames(spark: SparkSession, path: str, schema: str, per_trigger: int = 100, archive: str | None = None) -> DataFrame:
    """Files that appear (by atomic rename) in a folder, oldest first; each is read once, as the checkpoint records, and then moved to ``archive`` (if given)."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("latestFirst", "false")
    reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive) if archive else reader
    return reader.parquet(path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and keys; rows later than ``late`` are dropped and closed windows leave the state."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def label_statistics(detections: DataFrame, label: str, conf: str) -> DataFrame:
    """Running counts and means per label (update mode)."""
    return detections.groupBy(label).agg(F.count("*").alias("n"), F.avg(conf).alias("mean"), F.min(conf).alias("lo"), F.max(conf).alias("hi"))


def novelty_stream(tiles: DataFrame, key: str = "stream_id", frame: str = "frame_seq", tile: str = "det_id", cells: str = "cells", threshold: float = DEFAULT.initial_threshold, ttl: str | None = None, promoted: str | None = None) -> DataFrame:
    """stream, tile, overlap, foreground of every tile as its frame arrives; cells (bigint) are marked at frame ends.

    ``promoted``: a boolean column of tiles that hold a cell of an active track; they are foreground. State: one stream's seen cells. With ``ttl`` a stream that is silent for so long is forgotten.
    """
    import pandas as pd

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(parts)).sort_values([frame, tile], kind="stable")
        out = []
        for _, group in rows.groupby(frame, sort=True):
            marked = set()
            for t, own, held in zip(group[tile], group[cells], group[promoted] if promoted else repeat(False)):
                own = [] if own is None else own
                share = sum(c in seen for c in own) / len(own) if len(own) else 0.0
                out.append((k[0], t, share, bool(held) or share < threshold))
                marked.update(own)
            seen |= marked
        state.update(([int(c) for c in sorted(seen)],))
        if ttl:
            state.setTimeoutDuration(ttl)
        yield pd.DataFrame(out, columns=[key, tile, "overlap", "foreground"])

    kind = tiles.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    return tiles.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {tile} long, overlap double, foreground boolean", "cells array<long>", "append", timeout)


def threshold_stream(frames: DataFrame, key: str = "stream_id", frame: str = "frame_seq", tile_m: float = 40.0) -> DataFrame:
    """stream, frame, ema_m, threshold per frame; state: the last centre and the smoothed shift."""
    import math

    import pandas as pd

    s = DEFAULT

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get if state.exists else None
        rows, out = pd.concat(list(parts)).sort_values(frame, kind="stable"), []
        for f, lat, lon in zip(rows[frame], rows.lat, rows.lon):
            ema, level = None, s.initial_threshold
            if at is not None:
                shift = metres(at[0], at[1], lat, lon)
                ema = shift if at[2] == 0 else s.novelty_alpha * shift + (1 - s.novelty_alpha) * at[2]
                level = max(s.threshold_low, min(s.threshold_high, 1 - max(s.min_novelty, 0.5 * ema / tile_m)))
            at = (float(lat), float(lon), float(ema or 0.0))
            out.append((k[0], f, ema, level))
        state.update(at)
        yield pd.DataFrame(out, columns=[key, frame, "ema_m", "threshold"])

    kind = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {frame} long, ema_m double, threshold double", "lat double, lon double, ema double", "append", GroupStateTimeout.NoTimeout)


def state_of(state: GroupState, made):
    """``made`` with the plain values that a state holds, if there are any."""
    import pickle

    vars(made).update(pickle.loads(state.get[0]) if state.exists else {})
    return made


def values_of(made) -> tuple[bytes]:
    """The plain values of an object, without its settings, for a state."""
    import pickle

    return (pickle.dumps({k: v for k, v in vars(made).items() if k != "s"}),)


def track_stream(dets: DataFrame, keys: tuple[str, ...] = (), label: str = "label") -> DataFrame:
    """keys, label, det_id, track_no, speed_ms (at that detection) of every detection as it arrives: the tracker of ``track_velocity`` in keyed state.

    A micro-batch goes on where the last one ended, so no history is tracked anew; the state of a key and label is its open tracks.
    """
    import pandas as pd

    from aerograph.operators.sequences import Tracker

    group = [*keys, label]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = state_of(state, Tracker())
        rows = pd.concat(list(parts)).sort_values(["ts_ms", "frame_seq", "det_id"], kind="stable")
        out = [(*k, d, *tracker.add(f, float(t), float(a), float(b))) for d, f, t, a, b in zip(rows.det_id, rows.frame_seq, rows.ts_ms, rows.lat, rows.lon)]
        state.update(values_of(tracker))
        yield pd.DataFrame(out, columns=[*group, "det_id", "track_no", "speed_ms"])

    kinds = ", ".join(f"{c} {dets.schema[c].dataType.simpleString()}" for c in group)
    rows = dets.select(*group, "det_id", "frame_seq", "ts_ms", "lat", "lon")
    return rows.groupBy(*group).applyInPandasWithState(step, f"{kinds}, det_id long, track_no long, speed_ms double", "tracks binary", "append", GroupStateTimeout.NoTimeout)


def motion_stream(blobs: DataFrame, stream: str = "stream_id", match_px: float = 20.0, persist: int = DEFAULT.persist, orphan: int = DEFAULT.orphan_frames) -> DataFrame:
    """stream, track_id, hit_count, first_frame, last_frame, confirmed, open: tracks that a micro-batch retires, and those that are open after it.

    State goes on across segments and is never reset: live tracks, and the blobs of the last frame, which the next one completes. A track leaves it
    after ``orphan`` misses, not by a timer; the last row of a track holds.
    """
    import pandas as pd

    from aerograph.operators.sequences import Blobs

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = state_of(state, Blobs(match_px, persist, orphan))
        rows, out = pd.concat(list(parts)).sort_values(["frame_seq", "det_id"], kind="stable"), []
        for f, x, y in zip(rows.frame_seq, rows.cx, rows.cy):
            out += [(*k, *r, False) for r in live.add(int(f), float(x), float(y))]
        kept = values_of(live)
        out += [(*k, *r, True) for r in live.finish()]  # as things stand; the state goes on from before
        state.update(kept)
        yield pd.DataFrame(out, columns=[stream, "track_id", "hit_count", "first_frame", "last_frame", "confirmed", "open"])

    kind = blobs.schema[stream].dataType.simpleString()
    schema = f"{stream} {kind}, track_id long, hit_count long, first_frame long, last_frame long, confirmed boolean, open boolean"
    return blobs.select(stream, "frame_seq", "det_id", "cx", "cy").groupBy(stream).applyInPandasWithState(step, schema, "live binary", "append", GroupStateTimeout.NoTimeout)


def latest(df: DataFrame, keys: list[str], order: Column | str | None = None) -> DataFrame:
    """One row of each key: the last by ``order`` (by all columns where none is given)."""
    rest = [c for c in df.columns if c not in keys]
    by = order if order is not None else F.struct(*rest)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("__r")).select(*keys, "__r.*").select(*df.columns)


class Versions:
    """A table of which every micro-batch writes a version; a repeated batch writes the same one again, and versions before the last two are removed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def before(self, number: int) -> DataFrame | None:
        """The newest version below ``number``."""
        known = [v for v in self.numbers() if v < number]
        return self.spark.read.parquet(f"{self.path}/{known[-1]}") if known else None

    def numbers(self) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.numbers()[-1]}")

    def write(self, number: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{number}")
        for old in [v for v in self.numbers() if v < number - 1]:
            remove(self.spark, f"{self.path}/{old}")


def upsert_into(path: str, keys: list[str], order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges a micro-batch into versioned Parquet tables; of a batch's rows with one key the last by ``order`` holds."""
    from aerograph.operators.detections import upsert

    def write(batch: DataFrame, number: int) -> None:
        table = Versions(batch.sparkSession, path)
        new, old = latest(batch, keys, order), table.before(number)
        table.write(number, new if old is None else upsert(old, new, keys))

    return write


def publish_into(path: str, keys: tuple[str, ...] = (), label: str = "label") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over tracked detections (keys, label, det_id, track_no, speed_ms, ...): the published set (one row per track) is
    replaced after each micro-batch, under ids that stay the same. Counts and last places are added to, so no history is read again."""
    group = [*keys, label, "track_no"]

    def write(batch: DataFrame, number: int) -> None:
        table = Versions(batch.sparkSession, path)
        new = batch.groupBy(*group).agg(F.count("*").alias("n"), F.min("det_id").alias("first_det"), F.max_by("speed_ms", "det_id").alias("speed_ms"), F.max("det_id").alias("last_det"))
        old = table.before(number)
        both = new if old is None else old.select(*new.columns).unionByName(new)
        merged = both.groupBy(*group).agg(F.sum("n").alias("n"), F.min("first_det").alias("first_det"), F.max_by("speed_ms", "last_det").alias("speed_ms"), F.max("last_det").alias("last_det"))
        table.write(number, merged.withColumn("id", F.concat_ws("_", *(F.col(c).cast("string") for c in group))).withColumn("is_moving", F.col("speed_ms") > DEFAULT.moving_ms))

    return write


def route_into(foreground: str, background: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that parts judged tiles: the novel ones go to one folder and the others to a second one, which a query of
    its own reads when it gets to it (the deferred queue). A repeated batch writes the same files again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("foreground").write.mode("overwrite").parquet(f"{foreground}/{number}")
        batch.filter("NOT foreground").write.mode("overwrite").parquet(f"{background}/{number}")
        batch.unpersist()

    return write


def record_into(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps what reached each stage (run_id, stage, conf); ``run_statistics`` sums it up at any time."""
    return lambda batch, number: batch.select("run_id", "stage", "conf").write.mode("overwrite").parquet(f"{path}/{number}")


def run_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of a stream so far: the batch operator's statistics, with percentiles, histogram and funnel."""
    from aerograph.operators import runs

    return runs.summary(spark.read.schema("run_id string, stage string, conf double").parquet(f"{path}/*"))


def every_nth(frames: DataFrame, n: int = 5, frame: str = "frame_seq") -> DataFrame:
    """The frames after which a periodic analysis runs: each ``n``-th, counted from the first."""
    return frames.filter(F.pmod(F.col(frame), F.lit(n)) == n - 1)


def with_pose(frames: DataFrame, lat: float, lon: float, alt_m: float = 80.0) -> DataFrame:
    """One relation of frames from both kinds of stream: those with telemetry of their own keep it, others stand at a fixed anchor, looking down."""
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    pick = lambda c, other: F.when(own, F.col(c)).otherwise(F.lit(float(other)))
    return frames.withColumns({"lat": pick("lat", lat), "lon": pick("lon", lon), "alt_m": pick("alt_m", alt_m), "pitch": pick("pitch", -90.0), "yaw": pick("yaw", 0.0), "embedded": own})


def replay(df: DataFrame, folder: str, order: str = "frame_seq", fps: float = 30.0, speed: float = 1.0, per_file: int = 30, loops: int = 1, start: int = 0, sleep: Callable[[float], None] | None = None) -> int:
    """Drop the frames of a recording (from ``start`` on, ``loops`` times) as files into a folder at ``fps * speed`` frames a second; the files written.

    For tests and demonstrations: files appear by rename, oldest first; frame numbers go on from loop to loop.
    """
    import time

    span = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    first, n, files = max(start, span["a"]), span["b"] + 1 - max(start, span["a"]), 0
    for k in range(loops):
        for at in range(first, first + n, per_file):
            part = df.filter((F.col(order) >= at) & (F.col(order) < min(at + per_file, first + n))).withColumn(order, F.col(order) + k * n)
            part.coalesce(1).write.mode("append").parquet(folder)
            files += 1
            (sleep or time.sleep)(per_file / (fps * speed))
    return files


def run_every(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 10.0, mode: str = "append") -> StreamingQuery:
    """Flush micro-batches to ``write`` at most every so many seconds; what is left is flushed when the query is stopped by ``finish``."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(processingTime=f"{seconds} seconds").start()


def finish(query: StreamingQuery) -> None:
    """Flush what has arrived, then stop."""
    query.processAllAvailable()
    query.stop()


def each_once(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Give everything that is there to ``write``, then stop."""
    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there, then stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
