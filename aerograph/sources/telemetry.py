"""Telemetry and metadata sources, parsed with column expressions.

``load_text`` reads whole files; every parser takes a DataFrame with a text
column, so that it works on any table of texts. Malformed blocks, missing fields
and NULL texts give no rows or NULL fields, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerograph.functions import scalar as S

NUMBER = r"([-+]?\d+(?:\.\d+)?)"


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    """The number at a group of the first match; NULL where there is none."""
    return F.regexp_extract(text, f"(?i){pattern}", group).try_cast("double")


def srt_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns of ``df`` with block (ordinal), index, timestamp_ms and content of every SRT block of three lines and more."""
    blocks = F.split(F.regexp_replace(F.trim(text), "\r", ""), r"\n[ \t]*\n")
    rows = df.select("*", F.posexplode(blocks).alias("block", "__b")).withColumn("__l", F.split(F.trim("__b"), "\n"))
    rows = rows.filter((F.size("__l") >= 3) & F.trim(F.col("__l")[0]).rlike(r"^\d+$") & F.col("__l")[1].rlike(r"\d+:\d+:\d+[,.]\d+"))
    content = F.array_join(F.slice("__l", F.lit(3), F.size("__l") - 2), " ")
    return rows.withColumns({"index": F.trim(F.col("__l")[0]).cast("int") - 1, "timestamp_ms": S.timecode_ms(F.col("__l")[1]), "content": S.strip_tags(content)}).drop("__b", "__l", text)


def parse_srt(df: DataFrame, text: str = "text", rel_alt: bool = False) -> DataFrame:
    """Telemetry of the three bracket and FPV dialects; blocks without a position are dropped.

    A block with an FPV position has its altitude from the height field alone, and any other one from its brackets. With
    ``rel_alt`` a bracketed relative altitude stands in for a missing one.
    """
    rows, c = srt_blocks(df, text), F.col("content")
    fpv = lambda i: _number(c, rf"GPS\s*\(\s*{NUMBER}\s*,\s*{NUMBER}", i)
    field = lambda name: _number(c, rf"\[{name}\s*:\s*{NUMBER}")
    gimbal = lambda name: _number(c, rf"[\[\s]{name}\s*:\s*{NUMBER}")  # angles may share one bracket
    rows = rows.withColumns({"__a": fpv(1), "__b": fpv(2)})
    flown = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    alt = F.coalesce(field("altitude"), field("rel_alt")) if rel_alt else field("altitude")
    rows = rows.withColumns(
        {
            "lat": F.when(flown, F.col("__a")).otherwise(field("latitude")),
            "lon": F.when(flown, F.col("__b")).otherwise(field("longitude")),
            "alt_m": F.coalesce(F.when(flown, _number(c, rf"(?:^|[,\s])H\s+{NUMBER}\s*m")).otherwise(alt), F.lit(0.0)),
            "gimbal_pitch": F.coalesce(gimbal("gb_pitch"), F.lit(-90.0)),
            "gimbal_yaw": F.coalesce(gimbal("gb_yaw"), F.lit(0.0)),
            "gimbal_roll": F.coalesce(gimbal("gb_roll"), F.lit(0.0)),
            "flight_yaw": F.lit(0.0),
        }
    )
    return rows.filter("lat IS NOT NULL AND lon IS NOT NULL").drop("content", "__a", "__b")


def to_poses(df: DataFrame, path: str | Column, width: int, height: int) -> DataFrame:
    """Telemetry rows as the entries of a pose file: full_path, lat, lon, z, gimbal angles, flight_yaw and the image's size."""
    where = F.col(path) if isinstance(path, str) else path
    return df.select(where.alias("full_path"), "lat", "lon", F.col("alt_m").alias("z"), "gimbal_pitch", "gimbal_yaw", "gimbal_roll", "flight_yaw", F.lit(width).alias("img_w_px"), F.lit(height).alias("img_h_px"))


def parse_srt_json(df: DataFrame, text: str = "text") -> DataFrame:
    """SRT blocks that hold one JSON object each: its fields as a map, and other content as ``raw_subtitle``."""
    rows = srt_blocks(df, text)
    fields = F.from_json("content", "map<string,string>")
    return rows.withColumn("fields", F.when(F.trim("content").startswith("{"), fields)).withColumn("raw_subtitle", F.when(F.col("fields").isNull(), F.col("content"))).drop("content")


#: Keys under which exiftool reports a quantity, the best first.
EXIF_KEYS = {
    "lat": ("GPSLatitude",), "lon": ("GPSLongitude",), "alt_m": ("RelativeAltitude", "AbsoluteAltitude", "GPSAltitude"),
    "gimbal_pitch": ("GimbalPitchDegree", "GimbalPitch"), "gimbal_yaw": ("GimbalYawDegree", "GimbalYaw"), "gimbal_roll": ("GimbalRollDegree", "GimbalRoll"),
}


def parse_exif_json(df: DataFrame, text: str = "text") -> DataFrame:
    """Records of an exiftool JSON dump that have a position."""
    rows = df.select("*", F.posexplode(F.from_json(text, "array<map<string,string>>")).alias("record", "__m")).drop(text)
    first = lambda keys: F.coalesce(*(F.col("__m")[k].try_cast("double") for k in keys))
    rows = rows.withColumns({k: first(v) for k, v in EXIF_KEYS.items()}).drop("__m")
    return rows.filter("lat IS NOT NULL AND lon IS NOT NULL").fillna({"alt_m": 0.0, "gimbal_pitch": -90.0, "gimbal_yaw": 0.0, "gimbal_roll": 0.0})


def parse_pose_json(df: DataFrame, text: str = "text") -> DataFrame:
    """Frames of pose files (name to pose), in key order; ``alt_m`` is accepted for ``z``, and a 0 position is NULL."""
    pose = "full_path: string, lat: double, lon: double, z: double, alt_m: double, gimbal_pitch: double, gimbal_yaw: double, gimbal_roll: double, flight_yaw: double, img_w_px: int, img_h_px: int"
    rows = df.select("*", F.posexplode(F.array_sort(F.map_entries(F.from_json(text, f"map<string,struct<{pose}>>")))).alias("ordinal", "__e")).drop(text)
    rows = rows.select("*", F.col("__e.key").alias("frame_name"), "__e.value.*").drop("__e")
    zero = lambda c: F.when(F.col(c) != 0, F.col(c))
    return rows.withColumns({"z": F.coalesce("z", "alt_m"), "lat": zero("lat"), "lon": zero("lon"), "flight_yaw": F.coalesce("flight_yaw", F.lit(0.0)), "img_w_px": F.coalesce("img_w_px", F.lit(4000)), "img_h_px": F.coalesce("img_h_px", F.lit(3000))}).drop("alt_m")


#: XMP attributes and their columns.
XMP_FIELDS = {
    "RelativeAltitude": "rel_alt", "AbsoluteAltitude": "abs_alt", "GimbalPitchDegree": "gimbal_pitch", "GimbalYawDegree": "gimbal_yaw", "GimbalRollDegree": "gimbal_roll",
    "FlightYawDegree": "flight_yaw", "FlightPitchDegree": "flight_pitch", "FlightRollDegree": "flight_roll", "GpsLatitude": "lat", "GpsLongitude": "lon",
}


def parse_xmp(df: DataFrame, content: str = "content", window: int = 131_072) -> DataFrame:
    """XMP attributes in the first bytes of an image (``binaryFile`` content)."""
    head = F.decode(F.substring(content, 1, window), "ISO-8859-1")
    return df.withColumns({c: _number(head, rf'{k}\s*=\s*"\s*{NUMBER}') for k, c in XMP_FIELDS.items()})


def parse_objects(df: DataFrame, spec: str = "spec", radius: float = 1.0) -> DataFrame:
    """``lat,lon,colour[,r];...`` as rows."""
    rows = df.select("*", F.posexplode(F.split(spec, ";")).alias("ordinal", "__o")).withColumn("__p", F.transform(F.split("__o", ","), lambda x: F.trim(x)))
    at = lambda i: F.get("__p", F.lit(i))
    rows = rows.withColumns({"lat": at(0).try_cast("double"), "lon": at(1).try_cast("double"), "colour": at(2), "radius_m": F.coalesce(at(3).try_cast("double"), F.lit(radius))})
    return rows.filter("lat IS NOT NULL AND lon IS NOT NULL AND colour <> ''").drop("__o", "__p")


#: The fields of the dialects, and the decimals of their numbers.
DIALECTS = {
    "plain": (("[latitude: ", "lat", 6, "]"), (" [longitude: ", "lon", 6, "]"), (" [altitude: ", "alt_m", 3, "]")),
    "gimbal": (
        ("[latitude: ", "lat", 6, "]"), (" [longitude: ", "lon", 6, "]"), (" [altitude: ", "alt_m", 3, "]"),
        (" [gb_yaw: ", "gimbal_yaw", 1, "]"), (" [gb_pitch: ", "gimbal_pitch", 1, "]"), (" [gb_roll: ", "gimbal_roll", 1, "]"),
    ),
    "fpv": (("GPS (", "lat", 6, ""), (", ", "lon", 6, ", 0), D 0.00m"), (", H ", "alt_m", 2, "m, H.S 0.0m/s, V.S 0.00m/s")),
}


def write_srt(df: DataFrame, order: str = "timestamp_ms", key: str = "stream_id", dialect: str = "gimbal", per_part: int = 10_000) -> DataFrame:
    """(key, part, text): SRT files of a dialect, ``per_part`` blocks each; blocks are numbered through a series."""
    number = lambda c, d: F.call_function("format_number", F.col(c), F.lit(f"0.{'0' * d}"))
    line = F.concat(*(x for before, c, d, after in DIALECTS[dialect] for x in (F.lit(before), number(c, d), F.lit(after))))
    rows = df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order)))
    block = F.concat(F.col("__n").cast("string"), F.lit("\n"), S.ms_timecode(order), F.lit(" --> "), S.ms_timecode(F.col(order) + 100), F.lit("\n"), line, F.lit("\n"))
    parts = rows.select(key, F.floor((F.col("__n") - 1) / per_part).alias("part"), F.struct("__n", block.alias("text")).alias("b"))
    return parts.groupBy(key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["text"]), "\n").alias("text"))


def world_file(df: DataFrame, text: str = "text", width: int = 1000, height: int = 1000, mercator: bool | None = None) -> DataFrame:
    """Bounds of a world file's image in degrees.

    A world file does not name its projection: ``mercator`` says whether the values are Web-Mercator metres; if it is None, they are
    recognised by their size, so degrees of longitude that run on beyond 180 need False.
    """
    from aerograph.functions import geo as G

    v = F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double"))
    at = lambda i: F.get(v, F.lit(i))
    west, north = at(4) - at(0) / 2, at(5) - at(3) / 2
    east, south = west + at(0) * width, north + at(3) * height
    metres = (F.abs(west) > 180) | (F.abs(north) > 90) if mercator is None else F.lit(mercator)
    (lat_n, lon_w), (lat_s, lon_e) = G.inverse_web_mercator(west, north), G.inverse_web_mercator(east, south)
    pick = lambda a, b: F.when(metres, a).otherwise(b)
    return df.withColumns({"north": pick(lat_n, north), "south": pick(lat_s, south), "west": pick(lon_w, west), "east": pick(lon_e, east)})


def first_source(key: str, *sources: DataFrame) -> DataFrame:
    """Rows of each key's first source that has any (subtitles before packets before metadata dumps), with ``source_rank``."""
    ranked = None
    for rank, df in enumerate(sources):
        df = df.withColumn("source_rank", F.lit(rank))
        ranked = df if ranked is None else ranked.unionByName(df, allowMissingColumns=True)
    best = ranked.groupBy(key).agg(F.min("source_rank").alias("source_rank"))
    return ranked.join(best, [key, "source_rank"], "left_semi")


#: Packet variants that share one field layout.
COMPATIBLE_VARIANTS = ("wm265e", "wm265", "wm265m", "wm267")


def packet_variant(handler: Column) -> Column:
    """The packet variant that a track's handler name tells; empty where it tells none."""
    return F.lower(F.regexp_extract(handler, r"(?i)dvtm_(\w+)", 1))


def known_variant(handler: Column) -> Column:
    return packet_variant(handler).isin(*COMPATIBLE_VARIANTS)
