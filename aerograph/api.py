"""The engine's session: ingest, query, stream and report over tables under one path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerograph.config import DEFAULT, DIFFICULTY_THRESHOLD, Settings
from aerograph.functions import geo as G
from aerograph.functions import models
from aerograph.functions import scalar as S
from aerograph.operators import catalog, detections, pipeline, retrieval, runs, store
from aerograph.operators import geometry as geom
from aerograph.scratch import cut
from aerograph.sources import telemetry


def parse_query(text: str) -> dict:
    """A question's parameters by keywords alone: anomaly phrases, else an object query of medium difficulty."""
    low = text.lower()
    if any(p in low for p in S.ANOMALY_PHRASES):
        return {"intent": "anomaly_detection", "hint": text, "margin": DEFAULT.margin, "confidence": 0.55}
    return {"intent": "object_detection", "label": text, "difficulty": "medium", "threshold": DIFFICULTY_THRESHOLD["medium"], "confidence": 0.5}


class Session:
    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULT):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        self.catalog = catalog.Catalog(spark, f"{self.path}/catalog")
        self.vocabulary, self.asked = models.Vocabulary(), {}

    def _table(self, mission: str, name: str) -> str:
        return f"{self.path}/missions/{mission}/{name}"

    def read(self, mission: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self._table(mission, name))

    def exists(self, mission: str, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._table(mission, name)}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def ingest(self, mission: str, frames: DataFrame, backend: str = "encoder") -> int:
        """Add the tiles of frames (parent_path, lat, lon, alt_m, yaw, img_w, img_h and, if known, ts_ms) that are not there yet; the number added.

        Frames without position or with an altitude that is not positive are left out.
        """
        timed = frames if "ts_ms" in frames.columns else frames.withColumn("ts_ms", F.lit(0).cast("long"))
        good = timed.filter("lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0 AND alt_m > 0")
        if self.exists(mission, "tiles"):
            good = detections.not_yet(good, self.read(mission, "tiles"), "parent_path")
        placed = good.withColumns(G.frame_footprint("lat", "lon", "alt_m", "yaw", "img_w"))
        tiles = geom.tile_grid(placed, "img_w", "img_h", self.settings.tile_px, self.settings.tile_px - self.settings.overlap_px)
        tiles = tiles.withColumns(G.tile_footprint("tile_x", "tile_y", "tile_w", "tile_h", "img_w", "img_h"))
        tiles = tiles.drop(*(f"fp_{c}_{a}" for c in G.CORNERS for a in ("lat", "lon"))).withColumnsRenamed({f"tile_{c}_{a}": f"fp_{c}_{a}" for c in G.CORNERS for a in ("lat", "lon")})
        tiles = tiles.withColumn("image_path", F.concat(S.stem("parent_path"), F.lit("_t"), F.col("tile_x").cast("string"), F.lit("_"), F.col("tile_y").cast("string"), F.lit(".jpg")))
        before = self.read(mission, "tiles").count() if self.exists(mission, "tiles") else 0
        models.encode(tiles, "image_path", "vector", backend).write.mode("append").parquet(self._table(mission, "tiles"))
        return self.read(mission, "tiles").count() - before

    def add_segments(self, mission: str, segments: DataFrame) -> int:
        """Segments (frame_path, seg_idx, bbox, area, vector) of frames that have none yet; the number added."""
        if self.exists(mission, "segments"):
            segments = detections.not_yet(segments, self.read(mission, "segments"), "frame_path")
        return store.insert_segments(self._table(mission, "segments"), segments)

    def search(self, mission: str, text: str, k: int = DEFAULT.search_limit, frames: int = DEFAULT.search_frames, backend: str = "encoder") -> DataFrame:
        return retrieval.knn_diverse(self.read(mission, "tiles"), retrieval.vector(models.encode_query(text, backend)), k, frames, key="image_path", column="vector")

    def params(self, mission: str, text: str) -> dict:
        """What a question asks for; kept for each mission and question."""
        at = (mission, text.strip().lower())
        if at not in self.asked:
            self.asked[at] = parse_query(text)
        return self.asked[at]

    def query(self, mission: str, text: str) -> DataFrame:
        """Confirmed and placed detections for a question: tracked ones of objects, or the segments that stand out."""
        if self.params(mission, text)["intent"] == "anomaly_detection":
            return self.anomalies(mission, text)
        return self.objects(mission, text).confirmed

    def objects(self, mission: str, text: str) -> pipeline.Found:
        """The detection pipeline over a mission's tiles. Boxes are suppressed in pixels of the frame, so that those of overlapping tiles meet."""
        params = self.params(mission, text)
        tiles = self.read(mission, "tiles")
        kept = retrieval.prefilter(tiles, retrieval.vector(models.encode_query(text)), params.get("difficulty") == "hard", "image_path", "vector")
        found = models.detect(kept, "image_path", text).filter(F.col("confidence") >= params.get("threshold", 0.0))
        found = found.withColumn("det_id", F.xxhash64("image_path", "x1", "y1", "x2", "y2")).withColumnRenamed("confidence", "conf").join(kept.drop("vector", "sim"), "image_path")
        in_tile = ("x1", "y1", "x2", "y2")
        framed = found.withColumns({f"tile_{n}": F.col(n) for n in in_tile}).withColumns({n: F.col(n) + F.col("tile_x" if n[0] == "x" else "tile_y") for n in in_tile})
        lat, lon = G.geolocate(*(f"tile_{n}" for n in in_tile), "tile_w", "tile_h")
        # Written, since every stage reads the detector's answers.
        raw = cut(framed.withColumns({"lat": lat, "lon": lon}), "detections")
        _, sized = pipeline.suppressed_then_sized(raw, self.settings)
        verdicts = models.verify(sized.select("det_id", "image_path", "parent_path", F.col("conf").alias("confidence"), "label", *in_tile), "image_path")
        replies = cut(verdicts.select("det_id", F.lit(0).alias("seq"), "confirmed", F.col("vlm_confidence").alias("confidence"), F.col("vlm_reason").alias("reason")), "verdicts")
        return pipeline.detection_pipeline(raw, replies, settings=self.settings)

    def anomalies(self, mission: str, text: str, scene: str = "ground") -> DataFrame:
        """The segments of the frames nearest to the question that stand out most, judged, with their frame's place; none where the mission has no segments."""
        params, near = self.params(mission, text), self.search(mission, text)
        if not self.exists(mission, "segments"):
            empty = "frame_path string, seg_idx int, bbox array<int>, area double, label string, score double, confirmed boolean, vlm_confidence double, vlm_reason string, lat double, lon double"
            return self.spark.createDataFrame([], empty)
        frames = near.select(F.col("parent_path").alias("frame_path"), "dist", "image_path", "lat", "lon")
        own = self.read(mission, "segments").join(frames.select("frame_path").distinct(), "frame_path", "left_semi")
        own = own.withColumn("segment", F.concat_ws("#", "frame_path", F.col("seg_idx").cast("string")))
        top = retrieval.top_segments(own, self.vocabulary.frame(self.spark, scene, params.get("hint", text)), self.settings.top_segments, "segment", "vector", params.get("margin", self.settings.margin))
        checked = models.verify(top.select("frame_path", "seg_idx", "bbox", "area", "segment", F.lit(text).alias("label"), "score", F.col("best_anomaly").alias("confidence")), "segment").filter("confirmed")
        return detections.first_match(checked.drop("segment", "confidence"), frames, "frame_path", ["dist", "image_path"], ["lat", "lon"])

    def commit(self, mission: str, found: DataFrame, replace: bool = False, run: str = "") -> int:
        """Publish the tracks of confirmed detections, in place of those that are there or beside them; how many are published now."""
        schema = "published"
        known = self.catalog.read(f"{schema}-{mission}", self.PUBLISHED)
        made = pipeline.commit(known, pipeline.records(found), replace, run)
        self.catalog.write(f"{schema}-{mission}", made.select(*known.columns))
        return self.published(mission).count()

    PUBLISHED = "id string, track_id string, track_label string, lat double, lon double, confidence double, n long, frames long, first_ms long, last_ms long, speed_ms double, is_moving boolean, is_multiangle boolean"

    def published(self, mission: str) -> DataFrame:
        return self.catalog.read(f"published-{mission}", self.PUBLISHED)

    def record(self, mission: str, found: pipeline.Found, run: str, query: str) -> None:
        """Append a run's statistics to the mission's."""
        stages = found.stages.withColumns({"run_id": F.lit(run), "query": F.lit(query)})
        runs.append(self._table(mission, "runs"), runs.summary(stages))

    def load(self, mission: str, path: str) -> DataFrame:
        """Telemetry of a file, read by what its name ends in: subtitles, pose or metadata dumps (JSON), world files, images."""
        kind = path.rsplit(".", 1)[-1].lower()
        if kind == "srt":
            return telemetry.parse_srt(telemetry.load_text(self.spark, path))
        if kind == "json":
            text = telemetry.load_text(self.spark, path)
            return telemetry.parse_exif_json(text) if (text.select("text").first() or [""])[0].lstrip().startswith("[") else telemetry.parse_pose_json(text)
        if kind in ("jgw", "tfw", "pgw", "wld"):
            return telemetry.world_file(telemetry.load_text(self.spark, path))
        if kind in ("jpg", "jpeg", "png", "tif", "tiff"):
            return telemetry.parse_xmp(self.spark.read.format("binaryFile").load(path).select("path", "content")).drop("content")
        raise ValueError(f"no reader for .{kind}")

    def stats(self, found: DataFrame, label: str = "label", conf: str = "confidence") -> DataFrame:
        return detections.describe(found, [label], conf)
