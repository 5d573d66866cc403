"""Geometry and camera-model column expressions; all closed-form, none a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerograph.config import DEFAULT, EARTH_RADIUS_M, M_PER_DEG, Camera

CORNERS = ("nw", "ne", "se", "sw")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def m_per_deg_lon(lat) -> Column:
    return M_PER_DEG * F.cos(F.radians(col(lat)))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def flat_distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Planar distance with metres a degree taken at the first point."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    return F.hypot((lat2 - lat1) * M_PER_DEG, (lon2 - lon1) * m_per_deg_lon(lat1))


def latlon_to_metres(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """(north, east) of a point from an anchor."""
    return (col(lat) - col(lat0)) * M_PER_DEG, (col(lon) - col(lon0)) * m_per_deg_lon(lat0)


def metres_to_latlon(north, east, lat0, lon0) -> tuple[Column, Column]:
    return col(lat0) + col(north) / M_PER_DEG, col(lon0) + col(east) / m_per_deg_lon(lat0)


def ground_size(alt, camera: Camera = DEFAULT.camera) -> tuple[Column, Column]:
    """Width and height in metres that a nadir frame covers."""
    return col(alt) * camera.sensor_w_mm / camera.focal_mm, col(alt) * camera.sensor_h_mm / camera.focal_mm


def _placed(lat, lon, yaw, offsets) -> dict[str, Column]:
    """Corners from (east, north) offsets, turned clockwise by yaw."""
    c, s = F.cos(F.radians(col(yaw))), F.sin(F.radians(col(yaw)))
    out = {}
    for name, (e, n) in zip(CORNERS, offsets):
        north, east = n * c - e * s, n * s + e * c
        out[f"fp_{name}_lat"] = col(lat) + north / M_PER_DEG
        out[f"fp_{name}_lon"] = col(lon) + east / m_per_deg_lon(lat)
    return out


def frame_footprint(lat, lon, alt, yaw, img_w, camera: Camera = DEFAULT.camera) -> dict[str, Column]:
    """Corners of a nadir frame, ground size and GSD (2 digits); all NULL where alt <= 0."""
    ok = col(alt) > 0
    w, h = ground_size(alt, camera)
    x, y = w / 2, h / 2
    out = _placed(lat, lon, yaw, ((-x, y), (x, y), (x, -y), (-x, -y)))
    out |= {"ground_w_m": F.round(w, 2), "ground_h_m": F.round(h, 2), "gsd_cm_px": F.round(w * 100 / col(img_w), 2)}
    return {k: F.when(ok, v) for k, v in out.items()}


def aspect_corners(lat, lon, alt, yaw, img_w, img_h, camera: Camera = DEFAULT.camera) -> dict[str, Column]:
    """Corners of a nadir frame whose sensor height follows the image's aspect ratio."""
    w = col(alt) * camera.sensor_w_mm / camera.focal_mm
    h = w * col(img_h) / col(img_w)
    x, y = w / 2, h / 2
    return _placed(lat, lon, yaw, ((-x, y), (x, y), (x, -y), (-x, -y)))


def _ray(pitch, yaw, x, y) -> tuple[Column, Column, Column]:
    """(east, north, up) of a pixel's ray; x right and y down on a sensor at unit distance."""
    p, a = F.radians(col(pitch)), F.radians(col(yaw))
    forward = F.cos(p) + y * F.sin(p)
    up = F.sin(p) - y * F.cos(p)
    return forward * F.sin(a) + x * F.cos(a), forward * F.cos(a) - x * F.sin(a), up


def oblique_corners(lat, lon, alt, pitch, yaw, img_w, img_h, camera: Camera = DEFAULT.camera) -> dict[str, Column]:
    """Ground corners of a pitched frame; all NULL where a corner's ray does not meet the ground."""
    half_w = F.lit(camera.sensor_w_mm / camera.focal_mm / 2)
    half_h = half_w * col(img_h) / col(img_w)
    rays = {n: _ray(pitch, yaw, half_w * sx, half_h * sy) for n, sx, sy in (("nw", -1, -1), ("ne", 1, -1), ("se", 1, 1), ("sw", -1, 1))}
    ok = col(alt) > 0
    for _, _, up in rays.values():
        ok = ok & (up < -1e-9)
    out = {}
    for n, (e, north, up) in rays.items():
        t = col(alt) / -up
        out[f"fp_{n}_lat"] = F.when(ok, col(lat) + north * t / M_PER_DEG)
        out[f"fp_{n}_lon"] = F.when(ok, col(lon) + e * t / m_per_deg_lon(lat))
    return out


def pixel_ground_range(alt, pitch, px, py, img_w, img_h, camera: Camera = DEFAULT.camera) -> Column:
    """Horizontal distance to the ground point of a pixel; NULL where the pixel shows sky."""
    half_w = camera.sensor_w_mm / camera.focal_mm / 2
    x = (col(px) / col(img_w) * 2 - 1) * half_w
    y = (col(py) / col(img_h) * 2 - 1) * half_w * col(img_h) / col(img_w)
    e, n, up = _ray(pitch, F.lit(0.0), x, y)
    return F.when((up < -1e-9) & (col(alt) > 0), F.hypot(e, n) * col(alt) / -up)


def bilinear(u, v, nw, ne, se, sw) -> Column:
    """Value at (u right, v down) of four corner values."""
    u, v = col(u), col(v)
    return (1 - u) * (1 - v) * col(nw) + u * (1 - v) * col(ne) + u * v * col(se) + (1 - u) * v * col(sw)


def pixel_to_geo(u, v, prefix: str = "fp") -> tuple[Column, Column]:
    """(lat, lon) at (u, v) of the footprint columns ``<prefix>_<corner>_lat`` and ``_lon``."""
    return tuple(bilinear(u, v, *(f"{prefix}_{c}_{axis}" for c in CORNERS)) for axis in ("lat", "lon"))


def geo_to_pixel(lat, lon, prefix: str = "fp", steps: int = 12) -> Column:
    """struct<u, v> of a point in a footprint: Newton's method from the centre, as a fold of ``steps`` steps."""
    corner = {axis: [col(f"{prefix}_{c}_{axis}") for c in CORNERS] for axis in ("lat", "lon")}

    def step(s, _):
        u, v = s["u"], s["v"]
        f = [bilinear(u, v, *corner[a]) - col(x) for a, x in (("lat", lat), ("lon", lon))]
        du = [(1 - v) * (c[1] - c[0]) + v * (c[2] - c[3]) for c in corner.values()]
        dv = [(1 - u) * (c[3] - c[0]) + u * (c[2] - c[1]) for c in corner.values()]
        det = du[0] * dv[1] - du[1] * dv[0]
        stop = (F.abs(det) < 1e-20) | (F.greatest(F.abs(f[0]), F.abs(f[1])) < 1e-9)
        new_u = u - (f[0] * dv[1] - f[1] * dv[0]) / det
        new_v = v - (f[1] * du[0] - f[0] * du[1]) / det
        return F.struct(F.when(stop, u).otherwise(new_u).alias("u"), F.when(stop, v).otherwise(new_v).alias("v"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.5).alias("u"), F.lit(0.5).alias("v")), step)


def tile_footprint(x, y, w, h, img_w, img_h, prefix: str = "fp", out: str = "tile") -> dict[str, Column]:
    """Footprint of a tile from that of its frame."""
    u0, v0 = col(x) / col(img_w), col(y) / col(img_h)
    u1, v1 = (col(x) + col(w)) / col(img_w), (col(y) + col(h)) / col(img_h)
    made = {}
    for c, (u, v) in zip(CORNERS, ((u0, v0), (u1, v0), (u1, v1), (u0, v1))):
        made[f"{out}_{c}_lat"], made[f"{out}_{c}_lon"] = pixel_to_geo(u, v, prefix)
    return made


def tile_centre(prefix: str = "fp") -> tuple[Column, Column]:
    return tuple(sum((col(f"{prefix}_{c}_{a}") for c in CORNERS[1:]), col(f"{prefix}_{CORNERS[0]}_{a}")) / 4 for a in ("lat", "lon"))


def geolocate(x1, y1, x2, y2, tile_w, tile_h, mask_cx=None, mask_cy=None, prefix: str = "fp") -> tuple[Column, Column]:
    """(lat, lon) of a detection: its mask's centroid where there is one, else its box centre, clamped to the tile."""
    cx, cy = (col(x1) + col(x2)) / 2, (col(y1) + col(y2)) / 2
    if mask_cx is not None:
        cx, cy = F.coalesce(col(mask_cx), cx), F.coalesce(col(mask_cy), cy)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return pixel_to_geo(clamp(cx / col(tile_w)), clamp(cy / col(tile_h)), prefix)


def gsd_m_px(alt, img_w, camera: Camera = DEFAULT.camera) -> Column:
    """Metres a pixel; .05 where altitude or width is not positive."""
    return F.when((col(alt) > 0) & (col(img_w) > 0), col(alt) * camera.sensor_w_mm / (camera.focal_mm * col(img_w))).otherwise(F.lit(0.05))


def sky_boundary_row(pitch, img_h) -> Column:
    return (F.greatest(F.lit(0.0), (90 - F.abs(col(pitch))) / 90) * 0.6 * col(img_h)).cast("int")


def motion_gates(gsd, min_m=1.0, max_m=30.0, match_m: float = DEFAULT.match_m) -> dict[str, Column]:
    """Per-frame pixel gates from physical sizes."""
    g = col(gsd)
    return {
        "min_area_px": F.greatest(F.lit(DEFAULT.min_area_px), F.pow(col(min_m) / g, 2)),
        "max_area_px": F.pow(col(max_m) / g, 2),
        "match_dist_px": F.greatest(F.lit(20.0), F.lit(match_m) / g),
    }


def inverse_web_mercator(x, y) -> tuple[Column, Column]:
    """(lat, lon) of Web-Mercator metres."""
    r = 20037508.342789244
    return F.degrees(2 * F.atan(F.exp(col(y) / r * F.lit(3.141592653589793))) - 1.5707963267948966), col(x) / r * 180


def move(lat, lon, bearing_deg, distance_m) -> tuple[Column, Column]:
    """A point moved along a bearing."""
    b = F.radians(col(bearing_deg))
    return metres_to_latlon(col(distance_m) * F.cos(b), col(distance_m) * F.sin(b), lat, lon)


def dms_to_decimal(d, m, s, ref) -> Column:
    return (col(d) + col(m) / 60 + col(s) / 3600) * F.when(F.upper(col(ref)).isin("S", "W"), -1).otherwise(1)
