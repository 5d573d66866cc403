"""Relations that geometry makes: tile grids and flight paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerograph.config import DEFAULT
from aerograph.functions import geo as G


def tile_grid(frames: DataFrame, w: str = "w", h: str = "h", size: int = DEFAULT.tile_px, stride: int = DEFAULT.tile_px - DEFAULT.overlap_px) -> DataFrame:
    """Tiles of every frame; tiles at the right and bottom edges are clipped, slivers kept."""
    steps = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1, F.lit(stride).cast("long"))
    grid = frames.filter((F.col(w) > 0) & (F.col(h) > 0)).withColumn("tile_x", F.explode(steps(w))).withColumn("tile_y", F.explode(steps(h)))
    return grid.withColumns({"tile_w": F.least(F.lit(size), F.col(w) - F.col("tile_x")), "tile_h": F.least(F.lit(size), F.col(h) - F.col("tile_y"))})


def lawnmower(spark: SparkSession, lat: float, lon: float, lanes: int, spacing_m: float, points: int, step_m: float) -> DataFrame:
    """Serpentine lanes to the north of a start point."""
    rows = spark.range(lanes).withColumnRenamed("id", "lane").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    east = F.when(F.col("lane") % 2 == 0, F.col("i")).otherwise(points - 1 - F.col("i")) * step_m
    a, b = G.metres_to_latlon(F.col("lane") * spacing_m, east, F.lit(lat), F.lit(lon))
    return rows.select("lane", (F.col("lane") * points + F.col("i")).alias("seq"), a.alias("lat"), b.alias("lon"))


def linear_target(frames: DataFrame, lat: float, lon: float, bearing: float, speed: float, time_s: str = "t") -> DataFrame:
    """Where a target that moves in a straight line is at every frame."""
    a, b = G.move(F.lit(lat), F.lit(lon), F.lit(bearing), F.col(time_s) * speed)
    return frames.withColumns({"target_lat": a, "target_lon": b})


def tile_count(w: str | Column, h: str | Column, size: int = DEFAULT.tile_px, overlap: float = 0.2) -> Column:
    """How many tiles of ``size``, of which neighbours share ``overlap``, an image gives."""
    step = int(size * (1 - overlap))
    along = lambda c: F.ceil(F.greatest(F.lit(0), G.col(c)) / step)
    return (along(w) * along(h)).cast("long")


def diagonal(df: DataFrame, speed_ms: float) -> DataFrame:
    """seq, lat, lon, t_s: one straight pass over bounds (south, west, north, east), from the south-west to the north-east corner."""
    mid = (F.col("south") + F.col("north")) / 2
    length = F.hypot((F.col("north") - F.col("south")) * G.M_PER_DEG, (F.col("east") - F.col("west")) * G.m_per_deg_lon(mid))
    ends = F.array(F.struct(F.lit(0).alias("seq"), F.col("south").alias("lat"), F.col("west").alias("lon"), F.lit(0.0).alias("t_s")), F.struct(F.lit(1).alias("seq"), F.col("north").alias("lat"), F.col("east").alias("lon"), (length / speed_ms).alias("t_s")))
    return df.withColumn("__e", F.explode(ends)).select(*df.columns, "__e.*")


def ground_truth(targets: DataFrame, frames: DataFrame, fps: float, out_w: int = 640, out_h: int = 480) -> DataFrame:
    """id, frame, visible, lat, lon, px, py of every target in its active frames.

    targets: id, lat, lon (at its first frame), bearing, speed_ms, first_frame, last_frame. frames: frame, lat, lon of the camera, ground_w_m,
    ground_h_m; a level view to the north.
    """
    rows = targets.withColumn("frame", F.explode(F.sequence("first_frame", "last_frame")))
    cam = frames.select("frame", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "ground_w_m", "ground_h_m")
    lat, lon = G.move("lat", "lon", "bearing", (F.col("frame") - F.col("first_frame")) / fps * F.col("speed_ms"))
    rows = rows.withColumns({"lat": lat, "lon": lon}).join(cam, "frame")
    north, east = G.latlon_to_metres("lat", "lon", "__lat", "__lon")
    px, py = F.floor((east / F.col("ground_w_m") + 0.5) * out_w), F.floor((0.5 - north / F.col("ground_h_m")) * out_h)
    seen = (px >= 0) & (px < out_w) & (py >= 0) & (py < out_h)
    return rows.select("id", "frame", seen.alias("visible"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), px.alias("px"), py.alias("py"))


def place_targets(targets: DataFrame, frames: DataFrame, fps: float, least: int = 5, tries: int = 50, around: int = 30, seed: int = 0) -> DataFrame:
    """``targets`` (id, bearing, speed_ms, first_frame, last_frame) with lat, lon of their first frame, and ``placed``.

    Each try puts a target off the camera's middle (by 0.1 to 0.4 of the view's half) in one of its frames and moves it back to its first one; the first try
    with ``least`` frames in view around it holds. Else the target starts below the camera. Tries depend on id and seed alone. frames: as ``ground_truth``.
    """
    uniform = lambda n: F.pmod(F.xxhash64("id", "k", F.lit(seed), F.lit(n)), F.lit(1 << 30)) / float(1 << 30)
    cam = frames.select(F.col("frame").alias("anchor"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), "ground_w_m", "ground_h_m")
    span = F.col("last_frame") - F.col("first_frame") + 1
    t = targets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("anchor", (F.col("first_frame") + F.floor(uniform(0) * span)).cast("long"))
    share, angle = 0.1 + 0.3 * uniform(1), uniform(2) * 6.283185307179586
    t = t.withColumns({"__north": share * F.cos(angle) / 2, "__east": share * F.sin(angle) / 2}).join(cam, "anchor")
    lat, lon = G.metres_to_latlon(F.col("__north") * F.col("ground_h_m"), F.col("__east") * F.col("ground_w_m"), "a_lat", "a_lon")
    back = -(F.col("anchor") - F.col("first_frame")) / fps * F.col("speed_ms")
    t = t.withColumns({"__lat": lat, "__lon": lon})
    s_lat, s_lon = G.move("__lat", "__lon", "bearing", back)
    t = t.withColumns({"s_lat": s_lat, "s_lon": s_lon})
    near = t.withColumn("frame", F.explode(F.sequence(F.greatest("first_frame", F.col("anchor") - around), F.least("last_frame", F.col("anchor") + around - 1))))
    now_lat, now_lon = G.move("s_lat", "s_lon", "bearing", (F.col("frame") - F.col("first_frame")) / fps * F.col("speed_ms"))
    near = near.select("id", "k", "frame", "s_lat", "s_lon", now_lat.alias("__lat"), now_lon.alias("__lon"), "ground_w_m", "ground_h_m").join(frames.select("frame", "lat", "lon"), "frame")
    north, east = G.latlon_to_metres("__lat", "__lon", "lat", "lon")
    counted = near.filter((F.abs(north) <= F.col("ground_h_m") / 2) & (F.abs(east) <= F.col("ground_w_m") / 2)).groupBy("id", "k").agg(F.count("*").alias("n"), F.first("s_lat").alias("s_lat"), F.first("s_lon").alias("s_lon"))
    good = counted.filter(F.col("n") >= least).groupBy("id").agg(F.min_by(F.struct("s_lat", "s_lon"), "k").alias("__s"))
    start = frames.select(F.col("frame").alias("first_frame"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    out = targets.join(good, "id", "left").join(start, "first_frame", "left")
    return out.select(*targets.columns, F.coalesce("__s.s_lat", "__lat").alias("lat"), F.coalesce("__s.s_lon", "__lon").alias("lon"), F.col("__s").isNotNull().alias("placed"))


def cells_of(df: DataFrame, lat_cols: list[str], lon_cols: list[str], cell_m: float = DEFAULT.cell_m, ref_lat: float | None = None, most: int = DEFAULT.max_cells_per_axis) -> DataFrame:
    """``df`` with ``cells``: the grid cells (row, column) of a footprint's bounding box; none where it is missing or too large.

    Columns are as wide as rows at ``ref_lat``; where it is not given, at the southern edge of the data.
    """
    import math

    if ref_lat is None:
        ref_lat = df.agg(F.min(F.least(*lat_cols))).first()[0] or 0.0
    lat_scale, lon_scale = 111_320.0 / cell_m, 111_320.0 * math.cos(math.radians(ref_lat)) / cell_m
    cut = lambda x, scale: (x * scale).cast("int")
    r0, r1 = cut(F.least(*lat_cols), lat_scale), cut(F.greatest(*lat_cols), lat_scale) + 1
    c0, c1 = cut(F.least(*lon_cols), lon_scale), cut(F.greatest(*lon_cols), lon_scale) + 1
    ok = (r1 - r0 + 1 <= most) & (c1 - c0 + 1 <= most)
    pairs = F.flatten(F.transform(F.sequence(r0, r1), lambda r: F.transform(F.sequence(c0, c1), lambda c: F.struct(r.alias("r"), c.alias("c")))))
    return df.withColumn("cells", F.when(ok, pairs))


def auto_params(df: DataFrame, alt: str = "alt_m", width: str = "img_w", fastest: str | None = None, fps: int = 10, cross_s: float = 20.0, least_frames: int = 30) -> DataFrame:
    """``df`` with fps, speed_ms, gsd_cm_px, fp_w_m and fp_h_m for one straight pass that crosses a view in ``cross_s`` seconds.

    Slower where a target (``fastest``: its speed) that comes head-on would be in view for under ``least_frames`` frames, but not below half a metre a second.
    """
    w, h = G.ground_size(alt)
    speed = w / cross_s
    if fastest is not None:
        toward = F.coalesce(F.col(fastest), F.lit(0.0))
        slow = F.greatest(F.lit(0.5), w / (least_frames / fps) - toward)
        speed = F.when(F.col(fastest).isNotNull() & (w / (speed + toward) * fps < least_frames), slow).otherwise(speed)
    return df.withColumns({"fps": F.lit(fps), "speed_ms": F.round(speed, 2), "gsd_cm_px": F.round(w / F.col(width) * 100, 2), "fp_w_m": F.round(w, 1), "fp_h_m": F.round(h, 1)})
