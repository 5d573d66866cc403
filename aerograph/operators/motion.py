"""The motion processor: blobs and frame poses of a stream to judged tracks, frame by frame.

The order of frames decides every step, so a stream is one forward pass; its state is the live tracks and
their ground and camera positions. Streams run in parallel.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerograph.config import DEFAULT, Camera, Settings
from aerograph.operators.sequences import by_key

OUTPUT = "track_id long, hit_count long, first_frame long, last_frame long, confirmed boolean, suppressed boolean, suppressed_by string, spread_m double, height_m double, confidence double"


def pixel_ray(px: float, py: float, pose, camera: Camera) -> tuple[float, float, float]:
    """(east, north, up) of a pixel's ray from a pose."""
    scale = camera.sensor_w_mm / camera.focal_mm / pose.img_w
    x, y = (px - pose.img_w / 2) * scale, (py - pose.img_h / 2) * scale
    pitch, yaw = math.radians(pose.pitch), math.radians(pose.yaw)
    ahead = math.cos(pitch) + y * math.sin(pitch)
    return ahead * math.sin(yaw) + x * math.cos(yaw), ahead * math.cos(yaw) - x * math.sin(yaw), math.sin(pitch) - y * math.cos(pitch)


def footprint_offsets(pose, camera: Camera) -> np.ndarray:
    """(east, north) metres of the corners nw, ne, se, sw: along their rays, or of the level frame where one shows sky."""
    rays = np.array([pixel_ray(x, y, pose, camera) for x, y in ((0, 0), (pose.img_w, 0), (pose.img_w, pose.img_h), (0, pose.img_h))])
    if (rays[:, 2] >= 0).any():
        rays = np.array([pixel_ray(x, y, pose._replace(pitch=-90.0), camera) for x, y in ((0, 0), (pose.img_w, 0), (pose.img_w, pose.img_h), (0, pose.img_h))])
    return rays[:, :2] * (pose.alt_m / -rays[:, 2])[:, None]


def spread(ground: np.ndarray, camera: np.ndarray, alt: np.ndarray, s: Settings) -> tuple[float, float]:
    """(spread, height) of the height at which the world position spreads least; (inf, 0) for too few observations.

    At height h an observation's place is ``g - h q`` with ``q = (g - c) / alt``, so its variance over the observations above h is a
    quadratic in h, whose coefficients are running sums from the highest observation down.
    """
    if len(ground) < s.wf_min_frames:
        return math.inf, 0.0
    order = np.argsort(-alt, kind="stable")
    order = order[alt[order] > 0]
    if not len(order):
        return math.inf, 0.0
    down = alt[order]
    g = ground[order] - ground[order].mean(0)
    q = (ground[order] - camera[order]) / down[:, None]
    n = np.arange(1, len(down) + 1)
    means = [np.cumsum(x, axis=0) / n[:, None] for x in (g, q, g * g, g * q, q * q)]
    steady, cross, square = ((means[2] - means[0] ** 2).sum(1), (means[3] - means[0] * means[1]).sum(1), (means[4] - means[1] ** 2).sum(1))

    def least(heights: np.ndarray) -> tuple[float, float]:
        above = np.searchsorted(-down, -heights)  # observations above each height
        at = np.maximum(above, 1) - 1
        variance = np.where(above < 3, math.inf, np.maximum(steady[at] - 2 * heights * cross[at] + heights**2 * square[at], 0.0))
        k = int(variance.argmin())
        return math.sqrt(variance[k]), float(heights[k])

    top = 0.95 * alt.max()
    width = top / max(s.wf_scan - 1, 1)
    found = least(np.linspace(0, top, s.wf_scan))
    closer = least(np.linspace(max(0.0, found[1] - width), min(top, found[1] + width), s.wf_fine))
    return closer if closer[0] < found[0] else found


class Pose(NamedTuple):
    frame_seq: int
    lat: float
    alt_m: float
    pitch: float
    yaw: float
    dx: float
    dy: float
    img_w: float
    img_h: float


class Track:
    def __init__(self, number: int, frame: int, x: float, y: float):
        self.number, self.first, self.last, self.x, self.y = number, frame, frame, x, y
        self.hits, self.misses, self.in_a_row = 1, 0, 0
        self.confirmed, self.by, self.spread, self.height, self.confidence = False, None, None, None, 0.0
        self.ground: list[tuple[float, float]] = []
        self.camera: list[tuple[float, float, float]] = []

    def row(self) -> tuple:
        return self.number, self.hits, self.first, self.last, self.confirmed, self.by is not None, self.by, self.spread, self.height, self.confidence

    def judge(self, s: Settings) -> None:
        n = len(self.ground)
        if self.by == "world_fixed" or n < s.wf_min_frames or (n - s.wf_min_frames) % s.wf_retest:
            return
        k = min(n, len(self.camera))
        cam = np.array(self.camera[-k:])
        self.spread, self.height = spread(np.array(self.ground[-k:]), cam[:, :2], cam[:, 2], s)
        if self.spread < s.wf_threshold_m:
            self.by = "world_fixed"
        else:
            part = min(1.0, max(0.0, (self.spread - s.wf_threshold_m) / (2 * s.wf_threshold_m)))
            self.confidence = 0.65 * part + 0.25 * min(1.0, self.hits / 60) + 0.10 * (1 - self.misses / max(self.hits + self.misses, 1))


def associate(live: list[Track], blobs: list[tuple[float, float]], frame: int, reach: float) -> list[tuple[float, float]]:
    """Tracks by age take their nearest free blob within reach; what is left is returned."""
    free = list(blobs)
    for t in live:
        near = min(((math.hypot(x - t.x, y - t.y), k) for k, (x, y) in enumerate(free)), default=(math.inf, -1))
        if near[0] < reach:
            t.x, t.y = free.pop(near[1])
            t.hits, t.last, t.in_a_row = t.hits + 1, frame, 0
        else:
            t.misses, t.in_a_row = t.misses + 1, t.in_a_row + 1
    return free


class Processor:
    """State of one stream: live tracks with their ground and camera positions, and where the camera is."""

    def __init__(self, s: Settings = DEFAULT, max_range_m: float = 0.0):
        self.s, self.max_range_m = s, max_range_m
        self.live: list[Track] = []
        self.made, self.east, self.north, self.anchored = 0, 0.0, 0.0, False
        self.pose, self.blobs = None, []

    def read(self, row: tuple) -> list[tuple]:
        """Take a pose or a blob, in order of frames, a frame's pose first; the tracks that the frame before retired."""
        frame, is_pose, det_id, cx, cy, *pose = row
        out = []
        if is_pose:
            out = self.close()
            self.pose, self.blobs = Pose(frame, *pose), []
        elif self.pose is not None and self.pose.frame_seq == frame:
            self.blobs.append((cx, cy))
        return out

    def close(self) -> list[tuple]:
        """Process the frame that is complete."""
        if self.pose is None:
            return []
        s, pose = self.s, self.pose
        gsd = pose.alt_m * s.camera.sensor_w_mm / (s.camera.focal_mm * pose.img_w) if pose.alt_m > 0 else 0.05
        self.east, self.north = self.east - pose.dx * gsd, self.north + pose.dy * gsd
        speed = math.hypot(pose.dx, pose.dy)
        persist = s.persist + min(int(max(0.0, speed - s.scene_speed) / s.scene_step), s.scene_extra)
        for x, y in associate(self.live, self.blobs, pose.frame_seq, max(20.0, s.match_m / gsd)):
            self.made += 1
            self.live.append(Track(self.made, pose.frame_seq, x, y))
        gone = [t for t in self.live if t.in_a_row >= s.orphan_frames]
        self.live = [t for t in self.live if t.in_a_row < s.orphan_frames]
        for t in self.live:
            t.confirmed |= t.hits >= persist and t.last == pose.frame_seq
        self.anchored |= pose.lat != 0 and pose.alt_m > 0
        if self.anchored and pose.alt_m > 0:
            corners = footprint_offsets(pose, s.camera)
            for t in self.live:
                self.place(t, pose, corners, speed)
        self.pose = None
        return [t.row() for t in gone]

    def place(self, t: Track, pose, corners: np.ndarray, speed: float) -> None:
        """Add a new hit's ground and camera position, unless it is out of range, and judge the track."""
        if len(t.ground) < t.hits:
            u, v = t.x / pose.img_w, t.y / pose.img_h
            weights = np.array([(1 - u) * (1 - v), u * (1 - v), u * v, (1 - u) * v])
            e, n, up = pixel_ray(t.x, t.y, pose, self.s.camera)
            if self.max_range_m > 0 and speed > 1.0 and (up >= 0 or math.hypot(e, n) * pose.alt_m / -up > self.max_range_m):
                t.by = t.by or "range"
                return
            t.ground.append(tuple(weights @ corners + (self.east, self.north)))
        if len(t.camera) < t.hits:
            t.camera.append((self.east, self.north, pose.alt_m))
        t.judge(self.s)

    def finish(self) -> list[tuple]:
        return self.close() + [t.row() for t in self.live]


def motion_process(blobs: DataFrame, frames: DataFrame, key: str = "stream_id", settings: Settings = DEFAULT, max_range_m: float = 0.0) -> DataFrame:
    """Tracks of every stream with hits, confirmation, suppression (sticky once world-fixed), spread and confidence.

    ``blobs``: key, frame_seq, det_id, cx, cy (px). ``frames``: key, frame_seq (one row each), lat, alt_m, pitch, yaw, dx, dy (px the
    scene moved since the last frame), img_w, img_h. Frames without blobs count as misses. A stream is one forward pass over its poses and
    blobs; only its live tracks are in memory.
    """
    poses = ("lat", "alt_m", "pitch", "yaw", "dx", "dy", "img_w", "img_h")
    number = lambda c: F.col(c).cast("double").alias(c)
    seen = blobs.select(key, F.col("frame_seq").cast("long").alias("frame_seq"), F.lit(False).alias("is_pose"), F.col("det_id").cast("long").alias("det_id"), number("cx"), number("cy"), *(F.lit(0.0).alias(c) for c in poses))
    held = frames.dropDuplicates([key, "frame_seq"]).select(key, F.col("frame_seq").cast("long").alias("frame_seq"), F.lit(True).alias("is_pose"), F.lit(-1).cast("long").alias("det_id"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), *map(number, poses))
    rows = seen.unionByName(held).withColumn("__order", F.when(F.col("is_pose"), 0).otherwise(1))
    return by_key(rows, [key], ["frame_seq", "__order", "det_id"], OUTPUT, lambda: Processor(settings, max_range_m), lambda p, row: p.read(row[:-1]), lambda p: p.finish())
