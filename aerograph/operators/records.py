"""Joins, gates and reports over records: replies, masks, sidecars, timelines, ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerograph.config import M_PER_DEG
from aerograph.functions import geo as G
from aerograph.functions import scalar as S


def join_replies(candidates: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with the reply at their position; a missing one is unconfirmed with confidence 0."""
    one = replies.groupBy(*keys).agg(F.max_by(F.struct("confirmed", "confidence"), "seq").alias("__r"))
    out = candidates.join(one, keys, "left")
    return out.withColumns({"confirmed": F.coalesce("__r.confirmed", F.lit(False)), "confidence": F.coalesce("__r.confidence", F.lit(0.0))}).drop("__r")


def join_by_name(targets: DataFrame, candidates: DataFrame, path: str, order: str) -> DataFrame:
    """Targets with the last candidate of the same file name; misses are left out."""
    last = candidates.groupBy(S.basename(path).alias("filename")).agg(F.max_by(F.struct(*candidates.columns), order).alias("__c"))
    return targets.join(last, "filename").select(*targets.columns, "__c.*")


def mask_gate(df: DataFrame, inside: str = "mask_inside", area: str = "mask_area", least: float = 0.15) -> DataFrame:
    return df.filter((F.col(area) > 0) & (F.col(inside) / F.col(area) >= least))


def touching(tiles: DataFrame, cells: str, tracks: DataFrame, cell: str) -> DataFrame:
    """Tiles with a cell of an active track."""
    keyed = tiles.withColumn("__c", F.explode(cells))
    hit = keyed.join(tracks.select(F.col(cell).alias("__c")).distinct(), "__c", "left_semi")
    return hit.select(*tiles.columns).dropDuplicates()


def clip_ranges(df: DataFrame, key: str, frame: str, padding: int, total: Column) -> DataFrame:
    """First and last visible frame, padded and clamped to the clip."""
    out = df.groupBy(key).agg(F.min(frame).alias("lo"), F.max(frame).alias("hi"), F.first(total).alias("__n"))
    return out.select(key, F.greatest(F.lit(0), F.col("lo") - padding).alias("first_frame"), F.least(F.col("__n") - 1, F.col("hi") + padding).alias("last_frame"))


def sample_cadence(df: DataFrame, key: str, time: str, interval_ms: int) -> DataFrame:
    """The first frame of every interval of a series."""
    w = W.partitionBy(key, F.floor(F.col(time) / interval_ms)).orderBy(time)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def point_grid(df: DataFrame, n: int, w: str = "w", h: str = "h") -> DataFrame:
    """Centres of an n by n grid over an image."""
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    out = df.withColumn("i", at).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumns({"px": (F.col("i") + 0.5) * F.col(w) / n, "py": (F.col("j") + 0.5) * F.col(h) / n})


def camera_path(df: DataFrame, key: str, order: str, dx: str = "dx", dy: str = "dy", gsd: str = "gsd") -> DataFrame:
    """Camera positions from frame-to-frame shifts, summed since the first frame, from the first known anchor on."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumns({"east_m": -F.sum(F.col(dx) * F.col(gsd)).over(w), "north_m": F.sum(F.col(dy) * F.col(gsd)).over(w), "lat0": F.first("lat", True).over(w), "lon0": F.first("lon", True).over(w)})
    lat, lon = G.metres_to_latlon("north_m", "east_m", "lat0", "lon0")
    return rows.withColumns({"cam_lat": lat, "cam_lon": lon}).drop("lat0", "lon0")


def visible(df: DataFrame, lat: str, lon: str, target_lat: str, target_lon: str, width_m, height_m) -> DataFrame:
    """Rows whose target lies in the frame's ground box."""
    north = F.abs(F.col(target_lat) - F.col(lat)) * M_PER_DEG
    east = F.abs(F.col(target_lon) - F.col(lon)) * G.m_per_deg_lon(lat)
    return df.filter((north <= height_m / 2) & (east <= width_m / 2))


def floats_of(blob: str, dim: int) -> Column:
    """Little-endian 32-bit floats of a binary column, decoded from their bits; NaN and infinities are NULL."""

    def one(i):
        byte = lambda k: F.conv(F.hex(F.substring(blob, i * 4 + k + 1, 1)), 16, 10).cast("long")
        bits = byte(0) + byte(1) * 256 + byte(2) * 65_536 + byte(3) * 16_777_216
        sign = F.when(bits >= 2**31, -1.0).otherwise(1.0)
        exponent, fraction = F.floor(bits / 2**23) % 256, bits % 2**23
        normal = F.pow(F.lit(2.0), exponent - 127) * (1 + fraction / 2**23)
        return F.when(exponent == 255, None).otherwise(sign * F.when(exponent == 0, fraction * 2.0**-149).otherwise(normal)).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)


def nested_report(df: DataFrame, outer: str, inner: str, value: Column) -> DataFrame:
    """outer, map of inner to value: one row per outer key."""
    return df.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner), value.alias("v"))))).alias("frames"))


def numbered(df: DataFrame, group: str, order: list[str], out: str = "pos") -> DataFrame:
    """``df`` with each row's place (from 1) in its group by ``order``.

    Rows are dealt out by ranges of group and order and numbered in their range; the ranges' counts per group then shift them, so a group of any size
    is numbered by many tasks. Each row's range is written with it, since ranges are drawn anew in every run.
    """
    from aerograph.scratch import cut

    dealt = cut(df.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "__part").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), before.alias("__before"))
    own = F.row_number().over(W.partitionBy("__part", group).orderBy(*order))
    rows = dealt.withColumn("__own", own)
    shifted = rows.join(starts, rows[group].eqNullSafe(starts["__g"]) & (F.col("__part") == F.col("__p")))
    return shifted.withColumn(out, (F.col("__own") + F.col("__before")).cast("long")).select(*df.columns, out)


def settled(files: DataFrame, folder: str, modified: str, now, grace_ms: int | None = 7000) -> DataFrame:
    """Files of which a writer without renames is surely done: all of a folder but the newest, and that one too once it is older than ``grace_ms`` (never for None)."""
    newest = files.groupBy(F.col(folder).alias("__f")).agg(F.max(modified).alias("__top"))
    rows = files.join(newest, files[folder].eqNullSafe(newest["__f"]))
    done = F.col(modified) < F.col("__top")
    if grace_ms is not None:
        done = done | (F.lit(now) - F.col(modified) > grace_ms)
    return rows.filter(done).select(*files.columns)
