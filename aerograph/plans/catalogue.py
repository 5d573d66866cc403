"""The registered queries, their SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerograph.operators import detections as D
from aerograph.operators import retrieval as R
from aerograph.plans import detection_queries, geometry_queries, pipeline_queries, record_queries, sequence_queries, source_queries  # noqa: F401  they fill the registry
from aerograph.plans import relations as rel
from aerograph.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank tiles against a query vector, keep the top fraction, suppress overlapping detections, report confidence per label."""
    tiles = rel.tiles(spark, sf_dir)
    kept = R.prefilter(tiles, detection_queries.first_vector(tiles)).select(F.concat(F.lit("frame_"), F.col("vec_id").cast("string")).alias("parent_path"))
    boxes = D.valid_boxes(rel.boxes(spark, sf_dir)).join(kept, "parent_path", "left_semi")
    return D.describe(boxes.join(D.nms(boxes).select("det_id"), "det_id", "left_semi"), ["label"], "conf")
