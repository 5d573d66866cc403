"""The detection pipeline over relations: suppression, size, verdicts, places, times, tracks, and what each stage let through."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerograph.config import DEFAULT, Settings
from aerograph.functions import geo as G
from aerograph.operators import detections as D
from aerograph.operators import records as X
from aerograph.operators import sequences as T

NO_REPLY = "no reply"


@dataclass(frozen=True)
class Found:
    """confirmed: placed and tracked detections. rejected: those that a verdict turned down, with the reason. stages: stage, label, conf of every row that reached a stage."""

    confirmed: DataFrame
    rejected: DataFrame
    stages: DataFrame


def suppressed_then_sized(raw: DataFrame, settings: Settings = DEFAULT, key: str = "det_id") -> tuple[DataFrame, DataFrame]:
    """(rows that suppression keeps, those of them that are large enough): a small box suppresses before it is dropped."""
    kept = raw.join(D.nms(raw, key=key, overlap=settings.nms_overlap).select(key), key, "left_semi")
    return kept, D.valid_boxes(kept, settings.min_bbox_px)


def judged(candidates: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with confirmed, confidence and reason; one without a reply is unconfirmed."""
    made = replies if "reason" in replies.columns else replies.withColumn("reason", F.lit(None).cast("string"))
    one = made.groupBy(*keys).agg(F.max_by(F.struct("confirmed", "confidence", "reason"), "seq").alias("__r"))
    out = candidates.join(one, keys, "left")
    reason = F.when(F.col("__r").isNull(), NO_REPLY).otherwise(F.col("__r.reason"))
    return out.withColumns({"confirmed": F.coalesce("__r.confirmed", F.lit(False)), "confidence": F.coalesce("__r.confidence", F.lit(0.0)), "reason": reason}).drop("__r")


def placed(rows: DataFrame) -> DataFrame:
    """lat and lon of the boxes' centres, from their tiles' footprints."""
    lat, lon = G.geolocate("x1", "y1", "x2", "y2", "tile_w", "tile_h")
    return rows.withColumns({"lat": lat, "lon": lon})


def detection_pipeline(raw: DataFrame, replies: DataFrame, frames: DataFrame | None = None, keys: tuple[str, ...] = (), reply_keys: tuple[str, ...] = ("det_id",), settings: Settings = DEFAULT) -> Found:
    """Raw detections to tracked ones.

    raw: keys, parent_path, det_id, label, canonical_label (if any), conf, x1 to y2 in pixels of the frame, and lat, lon or the tile's size and
    footprint. replies: reply_keys, seq, confirmed, confidence, reason (if any). frames: parent_path, ts_ms; frames without a time have 0.
    """
    kept, sized = suppressed_then_sized(raw, settings)
    checked = judged(sized, replies, list(reply_keys))
    good = checked.filter("confirmed")
    good = good if {"lat", "lon"} <= set(good.columns) else placed(good)
    timed = D.frame_times(good, frames, "parent_path") if frames is not None else good.withColumn("ts_ms", F.coalesce("ts_ms", F.lit(0)) if "ts_ms" in good.columns else F.lit(0).cast("long"))
    name = T.canonical("label", "canonical_label" if "canonical_label" in timed.columns else None)
    named = timed.withColumn("track_label", name)
    tracks = T.track_velocity(named.withColumn("frame_seq", F.col("parent_path")), "track_label", keys).select("det_id", "track_no", "speed_ms")
    confirmed = named.join(tracks, "det_id").withColumn("is_moving", F.col("speed_ms") > settings.moving_ms)
    stage = lambda name, df, conf="conf": df.select(F.lit(name).alias("stage"), "label", F.col(conf).cast("double").alias("conf"))
    stages = stage("detected", raw).unionByName(stage("suppressed", kept)).unionByName(stage("sized", sized)).unionByName(stage("confirmed", good, "confidence"))
    return Found(confirmed, checked.filter("NOT confirmed").drop("confirmed"), stages)


def records(confirmed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per track: track_id (from its first detection), place of the most confident one, first and last time, detections, speed."""
    group = [*keys, "track_label", "track_no"]
    anchor = F.min_by(F.struct("parent_path", "x1", "y1", "x2", "y2", "det_id"), F.struct("ts_ms", "parent_path", "det_id")).alias("__a")
    best = F.max_by(F.struct("lat", "lon", "confidence"), F.struct("confidence", -F.col("det_id"))).alias("__b")
    rows = confirmed.groupBy(*group).agg(
        anchor, best, F.count("*").alias("n"), F.countDistinct("parent_path").alias("frames"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.max("speed_ms").alias("speed_ms"), F.max("is_moving").alias("is_moving"),
    )
    key = F.concat_ws("|", *(F.col(f"__a.{c}").cast("string") for c in ("parent_path", "x1", "y1", "x2", "y2")))
    return rows.select(*group, F.substring(F.sha1(key.cast("binary")), 1, 8).alias("track_id"), "__b.*", "n", "frames", "first_ms", "last_ms", F.round("speed_ms", 2).alias("speed_ms"), "is_moving", (F.col("frames") > 1).alias("is_multiangle"))


def commit(known: DataFrame | None, tracks: DataFrame, replace: bool = False, run: str = "", keys: tuple[str, ...] = ()) -> DataFrame:
    """Published detections after a commit. ``replace``: these tracks alone, under ids that stay the same from commit to commit
    (label and track_id). Else they are added to ``known``, under ids of the run, so that runs accumulate and a repeated commit adds nothing."""
    own = F.concat_ws("_", *keys, "track_label", "track_id")
    if replace:
        return tracks.withColumn("id", own)
    new = tracks.withColumn("id", F.substring(F.md5(F.concat_ws("|", F.lit(run), own).cast("binary")), 1, 10))
    return new if known is None else D.upsert(known, new.select(*known.columns), ["id"])


def accumulate(known: DataFrame | None, confirmed: DataFrame, key: str = "det_id") -> DataFrame:
    """Confirmed detections of a stream so far; one that comes again replaces its row."""
    return confirmed if known is None else D.upsert(known, confirmed, [key])


def nearest_snapshot(movers: DataFrame, snapshots: DataFrame, key: str, frame: str = "last_frame", snap: str = "snap") -> DataFrame:
    """``movers`` with ``snap``, their series' snapshot nearest to ``frame`` (ties: the earlier; null where the series has none), by windows that ignore nulls."""
    extra = [c for c in movers.columns if c != key]
    both = movers.select(key, *extra, F.col(frame).cast("long").alias("__at"), F.lit(None).cast("long").alias("__s"), F.lit(True).alias("__q"))
    kinds = {f.name: f.dataType for f in movers.schema}
    both = both.unionByName(snapshots.select(key, F.col(snap).cast("long").alias("__at"), F.col(snap).cast("long").alias("__s"), F.lit(False).alias("__q"), *(F.lit(None).cast(kinds[c]).alias(c) for c in extra)))
    w = W.partitionBy(key).orderBy("__at")
    both = both.withColumns({"__a": F.last("__s", True).over(w.rangeBetween(W.unboundedPreceding, 0)), "__b": F.first("__s", True).over(w.rangeBetween(0, W.unboundedFollowing))})
    near = F.when(F.col("__b") - F.col("__at") < F.col("__at") - F.col("__a"), F.col("__b")).otherwise(F.coalesce("__a", "__b"))
    return both.filter("__q").select(key, *extra, near.alias(snap))


def batches_of(movers: DataFrame, keys: list[str], order: str, size: int = 25) -> DataFrame:
    """``movers`` with ``batch``: their calls' numbers, of ``size`` rows each, per snapshot."""
    return movers.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1) / size))
