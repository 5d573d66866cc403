"""Positions from a still image's metadata: EXIF directories and XMP attributes, read from its first bytes."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerograph.sources.telemetry import parse_xmp

HEAD = 65_536  # bytes that are looked at
#: Tags of the format, and the bytes of its value types.
GPS_IFD, EXIF_IFD, WIDTH, HEIGHT, EXIF_WIDTH, EXIF_HEIGHT = 0x8825, 0x8769, 0x0100, 0x0101, 0xA002, 0xA003
LAT_REF, LAT, LON_REF, LON, ALT_REF, ALT = 1, 2, 3, 4, 5, 6
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def directory(data: bytes, start: int, at: int, order: str) -> dict[int, list]:
    """Tag to values of the directory at an offset; what lies outside the bytes is left out."""
    out: dict[int, list] = {}
    try:
        (n,) = struct.unpack_from(order + "H", data, start + at)
        for i in range(n):
            entry = start + at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            size = SIZES.get(kind, 0) * count
            where = entry + 8 if size <= 4 else start + struct.unpack_from(order + "I", data, entry + 8)[0]
            if not size or where + size > len(data):
                continue
            if kind in (5, 10):
                pairs = struct.unpack_from(order + ("II" if kind == 5 else "ii") * count, data, where)
                out[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
            elif kind == 2:
                out[tag] = [data[where : where + count].split(b"\0")[0].decode("latin-1")]
            else:
                out[tag] = list(struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * count, data, where))
    except struct.error:
        pass
    return out


def read_exif(data: bytes | None) -> dict[str, float | None]:
    """lat, lon (degrees), alt_m, img_w_px, img_h_px of an image's first bytes; None where they are not told."""
    none = dict.fromkeys(("lat", "lon", "alt_m", "img_w_px", "img_h_px"))
    at = data.find(b"Exif\0\0") if data else -1
    if at < 0 or (order := {b"II": "<", b"MM": ">"}.get(data[at + 6 : at + 8])) is None or len(data) < at + 14:
        return none
    start = at + 6
    main = directory(data, start, struct.unpack_from(order + "I", data, start + 4)[0], order)
    sub = lambda tag: directory(data, start, main[tag][0], order) if main.get(tag) else {}
    gps, more = sub(GPS_IFD), sub(EXIF_IFD)

    def degrees(tag: int, ref: int) -> float | None:
        v = gps.get(tag, [])
        sign = -1 if (gps.get(ref) or [""])[0] in ("S", "W") else 1
        return sign * (v[0] + v[1] / 60 + v[2] / 3600) if len(v) == 3 else None

    first = lambda *found: next((float(x[0]) for x in found if x), None)
    return {"lat": degrees(LAT, LAT_REF), "lon": degrees(LON, LON_REF), "alt_m": first(gps.get(ALT)), "img_w_px": first(more.get(EXIF_WIDTH), main.get(WIDTH)), "img_h_px": first(more.get(EXIF_HEIGHT), main.get(HEIGHT))}


def parse_image(df: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Pose entries of still images (``binaryFile`` rows): the altitude is the relative one of the XMP attributes if that is not zero, else the EXIF one."""
    import pandas as pd

    names = ["lat", "lon", "alt_m", "img_w_px", "img_h_px"]

    def run(parts):
        for pdf in parts:
            rows = [read_exif(None if c is None else bytes(c)) for c in pdf["head"]]
            yield pd.concat([pdf, pd.DataFrame(rows, columns=[f"exif_{n}" for n in names] if not rows else None).rename(columns={n: f"exif_{n}" for n in names}).astype(float)], axis=1)

    heads = df.select(F.col(path).alias("full_path"), F.substring(content, 1, HEAD).alias("head"))
    rows = parse_xmp(heads.mapInPandas(run, f"full_path {df.schema[path].dataType.simpleString()}, head binary, " + ", ".join(f"exif_{n} double" for n in names)), "head", HEAD)
    z = F.when(F.coalesce("rel_alt", F.lit(0.0)) != 0, F.col("rel_alt")).otherwise(F.coalesce("exif_alt_m", F.lit(0.0)))
    return rows.select(
        "full_path", F.coalesce("exif_lat", "lat").alias("lat"), F.coalesce("exif_lon", "lon").alias("lon"), z.alias("z"), F.coalesce("gimbal_pitch", F.lit(-90.0)).alias("gimbal_pitch"),
        F.coalesce("gimbal_yaw", F.lit(0.0)).alias("gimbal_yaw"), F.coalesce("gimbal_roll", F.lit(0.0)).alias("gimbal_roll"),
        F.coalesce(F.col("exif_img_w_px").cast("int"), F.lit(4000)).alias("img_w_px"), F.coalesce(F.col("exif_img_h_px").cast("int"), F.lit(3000)).alias("img_h_px"),
    )
