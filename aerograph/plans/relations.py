"""Relations that the registered queries bind the operators to, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Milliseconds of a time, by the rule of ``epoch_ms``: rounded, halves away from 0."""
    return F.expr(f"round(unix_micros(cast({ts} AS timestamp)), -3) div 1000")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    x1, y1 = (F.col("event_id") * 7919) % 560, (F.col("event_id") * 104729) % 400
    return e.select(
        F.col("event_id").alias("det_id"), F.concat(F.lit("frame_"), F.floor(F.col("event_id") / 25).cast("string")).alias("parent_path"),
        F.col("event_type").alias("label"), (F.col("value") / 500).alias("conf"), x1.alias("x1"), y1.alias("y1"),
        (x1 + 24 + F.col("user_id") % 90).alias("x2"), (y1 + 24 + F.col("event_id") % 70).alias("y2"),
    )


BOXES = """boxes AS (SELECT event_id AS det_id, 'frame_' || CAST(event_id // 25 AS VARCHAR) AS parent_path, event_type AS label, value / 500 AS conf,
  (event_id * 7919) % 560 AS x1, (event_id * 104729) % 400 AS y1, (event_id * 7919) % 560 + 24 + user_id % 90 AS x2, (event_id * 104729) % 400 + 24 + event_id % 70 AS y2 FROM events)"""


def dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("frame_seq", F.floor(F.col("event_id") / 10))
    slot = (F.col("event_id") % 10).cast("double")
    return e.select(
        F.col("event_id").alias("det_id"), "frame_seq", (F.col("frame_seq") * 2000).alias("ts_ms"),
        (F.lit(32.0) + F.lit(0.001) * slot + F.lit(0.00001) * F.col("frame_seq")).alias("lat"), (F.lit(34.8) + F.lit(0.0005) * slot).alias("lon"),
        F.col("event_type").alias("label"), (F.col("value") / 500).alias("conf"),
    )


DETS = """dets AS (SELECT event_id AS det_id, event_id // 10 AS frame_seq, (event_id // 10) * 2000 AS ts_ms,
  CAST(32.0 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (event_id % 10) + CAST(0.00001 AS DOUBLE) * (event_id // 10) AS lat,
  CAST(34.8 AS DOUBLE) + CAST(0.0005 AS DOUBLE) * (event_id % 10) AS lon, event_type AS label, value / 500 AS conf FROM events)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        "event_id", F.col("user_id").alias("stream_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("frame_seq"),
        (F.lit(32.0) + F.lit(0.00001) * (n % 997)).alias("lat"), (F.lit(34.8) + F.lit(0.00001) * (n % 991)).alias("lon"), (F.lit(40.0) + F.col("value") / 5).alias("alt_m"),
        (F.lit(-90.0) + n % 60).alias("pitch"), ((n * 37) % 360).cast("double").alias("yaw"), millis("ts").alias("ts_ms"), "event_type", "value",
    )


TELEMETRY = """telemetry AS (SELECT event_id, user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_seq,
  CAST(32.0 AS DOUBLE) + CAST(0.00001 AS DOUBLE) * (event_id % 997) AS lat, CAST(34.8 AS DOUBLE) + CAST(0.00001 AS DOUBLE) * (event_id % 991) AS lon, CAST(40.0 AS DOUBLE) + value / 5 AS alt_m,
  CAST(-90.0 AS DOUBLE) + event_id % 60 AS pitch, CAST((event_id * 37) % 360 AS DOUBLE) AS yaw, epoch_ms(ts) AS ts_ms, event_type, value FROM events)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").withColumn("parent_path", F.concat(F.lit("p"), F.col("label").cast("string")))


TILES = "tiles AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, 'p' || CAST(label AS VARCHAR) AS parent_path FROM embeddings)"


def missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "O", "ready").otherwise("created")
    intents = F.when(k % 2 == 0, F.array(F.lit("object_detection"))).otherwise(F.array(F.lit("object_detection"), F.lit("motion_detection")))
    return o.select(
        k.alias("id"), F.concat(F.lit(" Survey #"), k.cast("string"), F.lit(" / "), F.col("o_orderpriority")).alias("name"), status.alias("status"), intents.alias("allowed_intents"),
        F.col("o_orderdate").cast("date").alias("created_at"), F.when(k % 7 != 0, k * 1000).alias("last_accessed"), F.round("o_totalprice").cast("long").alias("tile_count"),
    )


MISSIONS = """missions AS (SELECT o_orderkey AS id, ' Survey #' || CAST(o_orderkey AS VARCHAR) || ' / ' || o_orderpriority AS name,
  CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'O' THEN 'ready' ELSE 'created' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN ['object_detection'] ELSE ['object_detection', 'motion_detection'] END AS allowed_intents,
  CAST(o_orderdate AS DATE) AS created_at, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey * 1000 END AS last_accessed, CAST(round(o_totalprice) AS BIGINT) AS tile_count FROM orders)"""
