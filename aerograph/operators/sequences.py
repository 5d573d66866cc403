"""Time series: interpolation, speed, thresholds, islands, trackers and the world-fixed test."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aerograph.config import DEFAULT, EARTH_RADIUS_M, M_PER_DEG
from aerograph.functions import geo as G


def interpolate(samples: DataFrame, requests: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """As-of interpolation of ``columns`` at the requests' times, clamped to the series' ends.

    Both sides meet in one sorted pass per series: the last sample at or before and the first
    one at or after a request, by windows that ignore NULLs.
    """
    pack = F.struct(F.col(time).alias("t"), *columns)
    extra = [c for c in requests.columns if c not in (key, time)]
    both = samples.select(key, time, pack.alias("s"), F.lit(None).cast("boolean").alias("q"), *(F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in extra))
    both = both.unionByName(requests.select(key, time, F.lit(None).cast(samples.select(pack.alias("s")).schema["s"].dataType).alias("s"), F.lit(True).alias("q"), *extra))
    w = W.partitionBy(key).orderBy(time)
    both = both.withColumn("a", F.last("s", True).over(w.rangeBetween(W.unboundedPreceding, 0))).withColumn("b", F.first("s", True).over(w.rangeBetween(0, W.unboundedFollowing)))
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    rows = both.filter("q").withColumn("__a", a).withColumn("__b", b)
    gap = (F.col("__b.t") - F.col("__a.t")).cast("double")
    share = F.when(gap > 0, (F.col(time) - F.col("__a.t")) / gap).otherwise(F.lit(0.0))
    return rows.select(key, time, *extra, *((F.col(f"__a.{c}") + share * (F.col(f"__b.{c}") - F.col(f"__a.{c}"))).alias(c) for c in columns))


def ground_speed(df: DataFrame, key: str, order: list[str], time_ms: str, first: int = 15, least_m: float = 0.2) -> DataFrame:
    """key, speed_ms from the first two consecutive samples (of the first 15) that are apart in time and place."""
    w = W.partitionBy(key).orderBy(*order)
    lag = lambda c: F.lag(c).over(w)
    rows = df.withColumns({"rn": F.row_number().over(w), "dt": (F.col(time_ms) - lag(time_ms)) / 1000.0, "plat": lag("lat"), "plon": lag("lon")})
    east = (F.col("lon") - F.col("plon")) * M_PER_DEG * F.cos(F.radians((F.col("lat") + F.col("plat")) / 2))
    dist = F.hypot((F.col("lat") - F.col("plat")) * M_PER_DEG, east)
    rows = rows.withColumn("dist", dist).filter((F.col("rn") <= first) & (F.col("dt") > 0) & (F.col("dist") > least_m))
    return rows.groupBy(key).agg(F.min_by(F.col("dist") / F.col("dt"), "rn").alias("speed_ms"))


#: A shift that lies so many frames back weighs less than a double can tell.
MEMORY = 80


def adaptive_thresholds(df: DataFrame, key: str, order: list[str], tile_m, alpha: float = DEFAULT.novelty_alpha) -> DataFrame:
    """key, seq, shift_m, ema_m, threshold per frame: shifts by lag, and their EMA by a fold over the last MEMORY shifts of each frame.

    The first shift that is not 0 seeds the average. No row holds a whole series.
    """
    w = W.partitionBy(key).orderBy(*order)
    rows = df.withColumn("seq", F.row_number().over(w)).withColumn("shift_m", G.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"))
    last = F.collect_list("shift_m").over(w.rowsBetween(-MEMORY, 0))
    ema = F.aggregate(last, F.lit(0.0), lambda acc, x: F.when(acc == 0, x).otherwise(alpha * x + (1 - alpha) * acc))
    out = rows.select(key, "seq", "shift_m", F.when(F.col("shift_m").isNotNull(), ema).alias("ema_m"))
    novelty = F.greatest(F.lit(DEFAULT.min_novelty), 0.5 * F.col("ema_m") / tile_m)
    level = F.greatest(F.lit(DEFAULT.threshold_low), F.least(F.lit(DEFAULT.threshold_high), 1 - novelty))
    return out.withColumn("threshold", F.when(F.col("ema_m").isNull(), F.lit(DEFAULT.initial_threshold)).otherwise(level))


def islands(df: DataFrame, key: str, frame: str) -> DataFrame:
    """Runs of consecutive frames: key, first_frame, last_frame, frames."""
    w = W.partitionBy(key).orderBy(frame)
    rows = df.select(key, frame).distinct().withColumn("g", F.col(frame) - F.row_number().over(w))
    return rows.groupBy(key, "g").agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count("*").alias("frames")).drop("g")


def cell_key(tiles: DataFrame, cells: str) -> Column:
    """A tile's cells as numbers: those that are pairs (r, c) are packed."""
    if isinstance(tiles.schema[cells].dataType.elementType, StructType):
        return F.transform(cells, lambda x: F.shiftleft(x["r"].cast("long"), 32) + x["c"])
    return F.col(cells)


def novelty(tiles: DataFrame, cells: str, frame: str, key: str, threshold, tracks: DataFrame | None = None, cell: str = "cell") -> DataFrame:
    """key, overlap, foreground: share of a tile's cells seen in an earlier frame; marks fall at frame ends.

    ``threshold`` is a number or a column of ``tiles`` (one level per frame). A tile without cells, one of which nothing was
    seen, and one that holds a cell of an active track (``tracks``: frame, cell) in its frame are foreground.
    """
    level = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else F.col(threshold)
    pairs = tiles.select(frame, key, F.explode(cell_key(tiles, cells)).alias("__cell"))
    seen = pairs.groupBy("__cell").agg(F.min(frame).alias("first_seen"))
    shares = pairs.join(seen, "__cell").groupBy(key).agg(F.avg((F.col("first_seen") < F.col(frame)).cast("double")).alias("overlap"))
    out = tiles.select(key, level.alias("__level")).join(shares, key, "left")
    promoted = F.lit(False)
    if tracks is not None:
        held = tracks.select(frame, F.col(cell).alias("__cell")).distinct()
        out = out.join(pairs.join(held, [frame, "__cell"], "left_semi").select(key).distinct().withColumn("__held", F.lit(True)), key, "left")
        promoted = F.coalesce("__held", F.lit(False))
    return out.select(key, F.coalesce("overlap", F.lit(0.0)).alias("overlap"), ((F.coalesce("overlap", F.lit(0.0)) < F.col("__level")) | promoted).alias("foreground"))


def by_key(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable, step: Callable, end: Callable) -> DataFrame:
    """One forward pass over the rows of each key in order, with the state of one key at a time and no group held in memory.

    ``start()`` makes a key's state; ``step(state, row)`` and ``end(state)`` give result rows, which follow the key in ``schema``.
    """
    import pandas as pd

    columns = [c for c in df.columns if c not in keys]
    dealt = df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names, width = [*keys, *(c.split()[0] for c in schema.split(", "))], len(keys)
    same = lambda a, b: all(x == y or x != x and y != y or x is None and y is None for x, y in zip(a, b))

    def run(parts):
        now, state, out = None, None, []
        for pdf in parts:
            for row in pdf.itertuples(index=False, name=None):
                if now is None or not same(now, row[:width]):
                    if now is not None:
                        out += [(*now, *r) for r in end(state)]
                    now, state = row[:width], start()
                out += [(*now, *r) for r in step(state, row[width:])]
            yield pd.DataFrame(out, columns=names)
            out = []
        if now is not None:
            yield pd.DataFrame([(*now, *r) for r in end(state)], columns=names)

    return dealt.mapInPandas(run, f"{kinds}, {schema}")


class Tracker:
    """Open tracks of one key as growing arrays; a detection takes the nearest track within its gate, or starts one."""

    def __init__(self, settings=DEFAULT):
        self.s, self.n = settings, 0
        self.at = np.zeros((16, 7))  # lat, lon, velocities of both (degrees a second), time, hits, speed
        self.frames: list = []

    def add(self, frame, ts: float, lat: float, lon: float) -> tuple[int, float]:
        """(track number from 1, its speed after this detection)."""
        s, t = self.s, self.at[: self.n]
        k = -1
        if self.n:
            dt = (ts - t[:, 4]) / 1000.0
            gate = s.gate_base_m + np.where(t[:, 5] < 2, s.gate_cold_ms, t[:, 6] * s.gate_speed_factor) * np.abs(dt)
            away = metres(t[:, 0] + t[:, 2] * dt, t[:, 1] + t[:, 3] * dt, lat, lon)
            away[(away >= gate) | np.fromiter((f == frame for f in self.frames), bool, self.n)] = np.inf
            k = int(away.argmin())
            k = k if away[k] < np.inf else -1
        if k < 0:
            if self.n == len(self.at):
                self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            k, self.n = self.n, self.n + 1
            self.frames.append(frame)
            self.at[k] = (lat, lon, 0.0, 0.0, ts, 1, 0.0)
        else:
            t, dt = self.at[k], (ts - self.at[k, 4]) / 1000.0
            if dt > 0:
                t[2] = s.velocity_alpha * (lat - t[0]) / dt + (1 - s.velocity_alpha) * t[2]
                t[3] = s.velocity_alpha * (lon - t[1]) / dt + (1 - s.velocity_alpha) * t[3]
            t[0], t[1], t[4], t[5] = lat, lon, ts, t[5] + 1
            t[6] = math.hypot(t[2] * M_PER_DEG, t[3] * M_PER_DEG * math.cos(math.radians(lat)))
            self.frames[k] = frame
        return k + 1, float(self.at[k, 6])


def metres(lat, lon, to_lat: float, to_lon: float):
    """Haversine distances from arrays of places to one place."""
    a, b = np.radians(lat), math.radians(to_lat)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * math.cos(b) * np.sin(np.radians(to_lon - lon) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))


def canonical(label: str | Column, canonical_label: str | Column | None = None) -> Column:
    """The name under which detections are tracked: the canonical label if there is one, in lower case."""
    label = F.col(label) if isinstance(label, str) else label
    better = F.col(canonical_label) if isinstance(canonical_label, str) else canonical_label
    return F.lower(label if better is None else F.coalesce(F.nullif(better, F.lit("")), label))


def track_velocity(dets: DataFrame, label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, label, det_id, track_no (from 1 in order of creation), speed_ms (the track's last): one greedy pass in time order per key and label.

    Order decides the result, so a label of a key (a mission, say) is one forward pass; only its open tracks are in memory. A track's frames stand
    together in time order, so the last one tells whether a detection is of the same frame.
    """
    group = [*keys, label]
    order = ["ts_ms", "frame_seq", "det_id"]

    def step(tracker: Tracker, row: tuple):
        ts, frame, det_id, lat, lon = row
        number, speed = tracker.add(frame, float(ts), float(lat), float(lon))
        return [(det_id, ts, frame, number, speed)]

    frame_kind, time_kind = (dets.schema[c].dataType.simpleString() for c in ("frame_seq", "ts_ms"))
    found = by_key(dets.select(*group, *order, "lat", "lon"), group, order, f"det_id long, ts_ms {time_kind}, frame_seq {frame_kind}, track_no long, now double", Tracker, step, lambda tracker: [])
    last = F.max_by("now", F.struct(*order)).over(W.partitionBy(*group, "track_no"))
    return found.select(*group, "det_id", "track_no", last.alias("speed_ms"))


class Blobs:
    """Live tracks of one stream, in order of age, and the blobs of the frame that is being read."""

    def __init__(self, match_px: float, persist: int, orphan: int):
        self.match_px, self.persist, self.orphan = match_px, persist, orphan
        self.live, self.made, self.frame, self.blobs = [], 0, None, []

    def retired(self):
        gone = [t for t in self.live if t["missed"] >= self.orphan]
        self.live = [t for t in self.live if t["missed"] < self.orphan]
        return [(t["id"], t["hits"], t["first"], t["last"], t["hits"] >= self.persist) for t in gone]

    def close(self):
        """Associate the frame that is complete; the tracks that this retires."""
        free = np.array(self.blobs, float).reshape(-1, 2)
        for t in self.live:
            away = np.hypot(free[:, 0] - t["x"], free[:, 1] - t["y"])
            i = int(away.argmin()) if len(away) else -1
            if i >= 0 and away[i] < self.match_px:
                t |= {"x": free[i, 0], "y": free[i, 1], "hits": t["hits"] + 1, "last": self.frame, "missed": 0}
                free = np.delete(free, i, axis=0)
            else:
                t["missed"] += 1
        out = self.retired()
        for x, y in free:
            self.made += 1
            self.live.append({"id": self.made, "x": x, "y": y, "hits": 1, "first": self.frame, "last": self.frame, "missed": 0})
        self.blobs = []
        return out

    def add(self, frame: int, x: float, y: float):
        """Take a blob; what a new frame retires."""
        out = []
        if self.frame is not None and frame != self.frame:
            out = self.close()
            for t in self.live:  # frames without blobs are misses too
                t["missed"] += frame - self.frame - 1
            out += self.retired()
        self.frame = frame
        self.blobs.append((x, y))
        return out

    def finish(self):
        out = self.close() if self.frame is not None else []
        return out + [(t["id"], t["hits"], t["first"], t["last"], t["hits"] >= self.persist) for t in self.live]


def motion_tracks(blobs: DataFrame, stream: str = "stream_id", match_px: float = 20.0, persist: int = DEFAULT.persist, orphan: int = DEFAULT.orphan_frames) -> DataFrame:
    """stream, track_id, hit_count, first_frame, last_frame, confirmed: tracks take the nearest free blob in order of age.

    Hits are cumulative; a track that misses ``orphan`` frames in a row is retired. A stream is one forward pass; only its
    live tracks and one frame's blobs are in memory.
    """
    rows = blobs.select(stream, F.col("frame_seq").cast("long").alias("frame_seq"), "det_id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    schema = "track_id long, hit_count long, first_frame long, last_frame long, confirmed boolean"
    return by_key(rows, [stream], ["frame_seq", "det_id"], schema, lambda: Blobs(match_px, persist, orphan), lambda s, r: s.add(r[0], r[2], r[3]), lambda s: s.finish())


def world_fixed(obs: DataFrame, key: str = "track_id", scan: int = DEFAULT.wf_scan, fine: int = DEFAULT.wf_fine, least: int = DEFAULT.wf_min_frames) -> DataFrame:
    """key, height_m, spread_m: the height at which a track's world position spreads least.

    ``obs`` has alt_m and metres from the first camera: cam_e, cam_n, geo_e, geo_n. A scan of heights,
    then a finer one around the best, which wins only where it is strictly better. At height h a place is ``g - h q`` with
    ``q = (g - c) / alt``, so the variance over the observations above h is a quadratic in h: observations are summed by
    the step of the scan below which they drop out, and sums run over at most ``scan`` rows of a track.
    """
    spans = obs.groupBy(key).agg(F.max("alt_m").alias("top"), F.count("*").alias("n"), F.avg("geo_e").alias("mid_e"), F.avg("geo_n").alias("mid_n")).filter(F.col("n") >= least)

    def scanned(grid: DataFrame, steps: int) -> DataFrame:
        """grid: key, lo, step, mid_e, mid_n. The best of the heights lo + i * step, i below ``steps``."""
        rows = obs.filter("alt_m > 0").join(grid, key)
        below = F.when(F.col("step") > 0, F.ceil((F.col("alt_m") - F.col("lo")) / F.col("step"))).otherwise(F.when(F.col("alt_m") > F.col("lo"), steps).otherwise(0))
        rows = rows.withColumn("steps", F.least(F.lit(steps), below).cast("int")).filter("steps > 0")
        terms, sums = {}, {}
        for a in ("e", "n"):
            g, q = F.col(f"geo_{a}") - F.col(f"mid_{a}"), (F.col(f"geo_{a}") - F.col(f"cam_{a}")) / F.col("alt_m")
            terms |= {f"g_{a}": g, f"q_{a}": q, f"gg_{a}": g * g, f"gq_{a}": g * q, f"qq_{a}": q * q}
        sums = rows.select(key, "lo", "step", "steps", *(v.alias(k) for k, v in terms.items())).groupBy(key, "lo", "step", "steps").agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in terms))
        down = W.partitionBy(key).orderBy(F.desc("steps")).rowsBetween(W.unboundedPreceding, 0)
        before = F.coalesce(F.lag("steps").over(W.partitionBy(key).orderBy("steps")), F.lit(0))
        sums = sums.select(key, "lo", "step", "steps", before.alias("from"), *(F.sum(c).over(down).alias(c) for c in ("n", *terms))).filter("n >= 3")
        heights = sums.withColumn("i", F.explode(F.sequence(F.col("from"), F.col("steps") - 1))).withColumn("h", F.col("i") * F.col("step") + F.col("lo"))
        m = lambda c: F.col(c) / F.col("n")
        spread = lambda a: m(f"gg_{a}") - m(f"g_{a}") ** 2 - 2 * F.col("h") * (m(f"gq_{a}") - m(f"g_{a}") * m(f"q_{a}")) + F.col("h") ** 2 * (m(f"qq_{a}") - m(f"q_{a}") ** 2)
        var = heights.select(key, "h", F.greatest(F.lit(0.0), spread("e") + spread("n")).alias("v"))
        return var.groupBy(key).agg(F.min_by("h", F.struct("v", "h")).alias("h"), F.min("v").alias("v"))

    limit = F.col("top") * 0.95
    grid = spans.select(key, F.lit(0.0).alias("lo"), (limit / (scan - 1)).alias("step"), "mid_e", "mid_n")
    rough = scanned(grid, scan)
    around = rough.join(spans, key).withColumn("lo", F.greatest(F.lit(0.0), F.col("h") - limit / (scan - 1))).withColumn("hi", F.least(limit, F.col("h") + limit / (scan - 1)))
    second = scanned(around.select(key, "lo", ((F.col("hi") - F.col("lo")) / (fine - 1)).alias("step"), "mid_e", "mid_n"), fine).withColumnsRenamed({"h": "h2", "v": "v2"})
    both = rough.join(second, key, "left")
    better = F.col("v2") < F.col("v")
    return both.select(key, F.when(better, F.col("h2")).otherwise(F.col("h")).alias("height_m"), F.sqrt(F.when(better, F.col("v2")).otherwise(F.col("v"))).alias("spread_m"))
