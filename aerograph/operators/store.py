"""Tables of a mission: segments, detections and motion tracks, as scans, sinks and map features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_SCHEMA = "frame_path string, seg_idx int, bbox array<int>, area double, vector array<float>"


def segments_of(segments: DataFrame, frame: str) -> DataFrame:
    """One frame's segments in order; the filter reaches the scan."""
    return segments.filter(F.col("frame_path") == frame).orderBy("seg_idx")


def segments_for(frames: DataFrame, segments: DataFrame, key: str = "frame_path") -> DataFrame:
    """Every asked frame with the array of its segments in order (empty where it has none)."""
    columns = [c for c in segments.columns if c != key]
    own = segments.join(frames.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg_idx", *(c for c in columns if c != "seg_idx")))).alias("segments"))
    return frames.select(key).distinct().join(own, key, "left").withColumn("segments", F.coalesce("segments", F.array().cast(own.schema["segments"].dataType)))


def has_frame(frames: DataFrame, segments: DataFrame, key: str = "frame_path") -> DataFrame:
    """Asked frames with ``has_segments``."""
    known = segments.select(key).distinct().withColumn("has_segments", F.lit(True))
    return frames.join(known, key, "left").withColumn("has_segments", F.coalesce("has_segments", F.lit(False)))


def insert_segments(path: str, segments: DataFrame) -> int:
    """Append segments, numbered within their frame by their order; the count. Nothing is written for none."""
    n = segments.count()
    if n:
        segments.write.mode("append").parquet(path)
    return n


def save_json(df: DataFrame, path: str, without: tuple[str, ...] = ("img_urls",)) -> None:
    """Overwrite a table of JSON rows; columns that are made anew for each view are left out."""
    df.drop(*without).write.mode("overwrite").json(path)


def load_json(spark, path: str, schema: str, needs: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a JSON table; those without a value that they need are dropped, and unreadable ones too."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.dropna(subset=list(needs)) if needs else rows


def features(detections: DataFrame, tracks: DataFrame | None = None, least_points: int = 3) -> DataFrame:
    """kind, id, geometry (GeoJSON): a point for each detection, and a line for each track of ``least_points`` places and more.

    tracks: id, seq, lat, lon.
    """
    at = lambda lat, lon: F.array(lon, lat)
    point = F.to_json(F.struct(F.lit("Point").alias("type"), at(F.col("lat"), F.col("lon")).alias("coordinates")))
    out = detections.filter("lat IS NOT NULL AND lon IS NOT NULL").select(F.lit("detection").alias("kind"), F.col("id").cast("string").alias("id"), point.alias("geometry"))
    if tracks is None:
        return out
    line = tracks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p")).filter(F.size("p") >= least_points)
    coordinates = F.transform("p", lambda x: at(x["lat"], x["lon"]))
    lines = line.select(F.lit("track").alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))).alias("geometry"))
    return out.unionByName(lines)
