"""Queries over records: replies, masks, sidecars, timelines, ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerograph.functions import geo as G
from aerograph.operators import records as X
from aerograph.plans import relations as rel
from aerograph.plans.registry import query


@query(f"""WITH {rel.BOXES}, r AS (SELECT parent_path, label, arg_max(conf > 0.4, det_id) AS confirmed, arg_max(conf, det_id) AS confidence FROM boxes WHERE det_id % 3 = 0 GROUP BY parent_path, label)
SELECT det_id, coalesce(confirmed, false) AS confirmed, round(coalesce(confidence, 0), 6) AS confidence FROM boxes LEFT JOIN r USING (parent_path, label)""")
def reply_join(spark, d):
    b = rel.boxes(spark, d)
    r = b.filter("det_id % 3 = 0").select("parent_path", "label", (F.col("conf") > 0.4).alias("confirmed"), F.col("conf").alias("confidence"), F.col("det_id").alias("seq"))
    return X.join_replies(b.select("det_id", "parent_path", "label"), r, ["parent_path", "label"]).select("det_id", "confirmed", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {rel.BOXES}, c AS (SELECT parent_path || '.jpg' AS filename, max(det_id) AS last_id FROM boxes WHERE label <> 'click' GROUP BY ALL) SELECT event_id, last_id FROM events JOIN c ON filename = 'frame_' || CAST(event_id % 500 AS VARCHAR) || '.jpg'""")
def candidate_by_filename(spark, d):
    c = rel.boxes(spark, d).filter("label <> 'click'").select(F.concat(F.lit("/data/x/"), "parent_path", F.lit(".jpg")).alias("path"), F.col("det_id").alias("last_id"))
    t = rel.read(spark, d, "events").select("event_id", F.concat(F.lit("frame_"), (F.col("event_id") % 500).cast("string"), F.lit(".jpg")).alias("filename"))
    return X.join_by_name(t, c, "path", "last_id").select("event_id", "last_id")


@query("SELECT event_id FROM events WHERE event_id % 50 > 0 AND user_id % 20 / CAST(event_id % 50 AS DOUBLE) >= 0.15")
def mask_containment(spark, d):
    e = rel.read(spark, d, "events").select("event_id", (F.col("event_id") % 50).alias("mask_area"), (F.col("user_id") % 20).alias("mask_inside"))
    return X.mask_gate(e).select("event_id")


@query(f"""WITH {rel.DETS} SELECT det_id FROM dets WHERE CAST(floor(lat * 2000) AS BIGINT) IN (SELECT CAST(floor(lat * 2000) AS BIGINT) FROM dets WHERE det_id % 1000 = 7) OR CAST(floor(lat * 2000) AS BIGINT) + 1 IN (SELECT CAST(floor(lat * 2000) AS BIGINT) FROM dets WHERE det_id % 1000 = 7)""")
def track_cell_tiles(spark, d):
    cell = F.floor(F.col("lat") * 2000)
    t = rel.dets(spark, d).select("det_id", cell.alias("cell"), F.array(cell, cell + 1).alias("cells"))
    return X.touching(t.select("det_id", "cells"), "cells", t.filter("det_id % 1000 = 7"), "cell").select("det_id")


@query("SELECT user_id, greatest(0, min(event_id // 10) - 15) AS first_frame, least((SELECT max(event_id) // 10 FROM events), max(event_id // 10) + 15) AS last_frame FROM events WHERE value > 400 GROUP BY user_id")
def clip_ranges(spark, d):
    e = rel.read(spark, d, "events")
    top = (e.agg(F.max("event_id")).first()[0] or 0) // 10 + 1
    return X.clip_ranges(e.filter("value > 400").withColumn("f", F.floor(F.col("event_id") / 10)), "user_id", "f", 15, F.lit(top))


@query(f"""WITH {rel.TELEMETRY}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, ts_ms // 86400000 ORDER BY ts_ms) AS rn FROM telemetry) SELECT event_id, stream_id FROM r WHERE rn = 1""")
def sample_cadence(spark, d):
    return X.sample_cadence(rel.telemetry(spark, d), "stream_id", "ts_ms", 86_400_000).select("event_id", "stream_id")


@query("SELECT r_regionkey, i, j, round((i + 0.5) * 1920 / 4, 4) AS px, round((j + 0.5) * 1080 / 4, 4) AS py FROM region, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j)")
def point_grid(spark, d):
    r = rel.read(spark, d, "region").select("r_regionkey", F.lit(1920).alias("w"), F.lit(1080).alias("h"))
    return X.point_grid(r, 4).select("r_regionkey", "i", "j", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query("""WITH c AS (SELECT event_id, -sum((event_id % 7 - 3) * 0.05) OVER w AS e, sum((event_id % 5 - 2) * 0.05) OVER w AS n, first_value(CASE WHEN event_id % 4 = 0 THEN 32.0 + user_id / 1000.0 END IGNORE NULLS) OVER w AS lat0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, round(CAST(e AS DOUBLE), 4) AS east_m, round(CAST(n AS DOUBLE), 4) AS north_m, round(lat0 + CAST(n AS DOUBLE) / 111320.0, 6) AS cam_lat FROM c""")
def camera_path(spark, d):
    n = F.col("event_id")
    anchor = F.when(n % 4 == 0, F.lit(32.0).cast("double") + F.col("user_id") / 1000.0)
    e = rel.read(spark, d, "events").select("event_id", "user_id", (n % 7 - 3).alias("dx"), (n % 5 - 2).alias("dy"), F.lit(0.05).cast("double").alias("gsd"), anchor.alias("lat"), F.when(n % 4 == 0, F.lit(34.8).cast("double")).alias("lon"))
    return X.camera_path(e, "user_id", "event_id").select("event_id", F.round("east_m", 4).alias("east_m"), F.round("north_m", 4).alias("north_m"), F.round("cam_lat", 6).alias("cam_lat"))


@query(f"""WITH {rel.DETS}, t AS (SELECT det_id, lat, lon, 32.0 + 2.0 * frame_seq * cos(radians(30.0)) / 111320.0 AS tlat, 34.8 + 2.0 * frame_seq * sin(radians(30.0)) / (111320.0 * cos(radians(32.0))) AS tlon FROM dets)
SELECT det_id, round(tlat, 6) AS target_lat, round(tlon, 6) AS target_lon FROM t WHERE abs(tlat - lat) * 111320.0 <= 400 AND abs(tlon - lon) * 111320.0 * cos(radians(lat)) <= 300""")
def ground_truth_visibility(spark, d):
    from aerograph.operators.geometry import linear_target

    t = linear_target(rel.dets(spark, d).withColumn("t", F.col("frame_seq").cast("double")), 32.0, 34.8, 30.0, 2.0)
    return X.visible(t, "lat", "lon", "target_lat", "target_lon", 600.0, 800.0).select("det_id", F.round("target_lat", 6).alias("target_lat"), F.round("target_lon", 6).alias("target_lon"))


@query("SELECT r_regionkey, 1.5 AS v0, -0.25 AS v1, 1024.0 AS v2, 0.0 AS v3 FROM region")
def vector_unpack(spark, d):
    import struct

    raw = struct.pack("<4f", 1.5, -0.25, 1024.0, 0.0)
    r = rel.read(spark, d, "region").select("r_regionkey", F.lit(raw).alias("blob"))
    v = r.select("r_regionkey", X.floats_of("blob", 4).alias("v"))
    return v.select("r_regionkey", *(F.col("v")[i].cast("double").alias(f"v{i}") for i in range(4)))


@query(f"""WITH {rel.BOXES}, f AS (SELECT DISTINCT 'frame_' || CAST(p_partkey AS VARCHAR) AS parent_path FROM part) SELECT parent_path, count(det_id) AS segments FROM f LEFT JOIN boxes USING (parent_path) GROUP BY parent_path""")
def segments_for_frames(spark, d):
    f = rel.read(spark, d, "part").select(F.concat(F.lit("frame_"), F.col("p_partkey").cast("string")).alias("parent_path")).distinct()
    return f.join(rel.boxes(spark, d), "parent_path", "left").groupBy("parent_path").agg(F.count("det_id").alias("segments"))


@query("SELECT p_partkey FROM part WHERE 'IMG_' || CAST(p_partkey AS VARCHAR) NOT IN (SELECT 'IMG_' || CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity > 48)")
def uncovered_stills(spark, d):
    name = lambda c: F.concat(F.lit("IMG_"), F.col(c).cast("string")).alias("name")
    covered = rel.read(spark, d, "lineitem").filter("l_quantity > 48").select(name("l_partkey"))
    return rel.read(spark, d, "part").select("p_partkey", name("p_partkey")).join(covered, "name", "left_anti").select("p_partkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON lower('Clip_' || CAST(s_suppkey AS VARCHAR)) = 'clip_' || CAST(c_custkey AS VARCHAR)")
def video_sidecars(spark, d):
    v = rel.read(spark, d, "supplier").select("s_suppkey", F.lower(F.concat(F.lit("Clip_"), F.col("s_suppkey").cast("string"))).alias("stem"))
    s = rel.read(spark, d, "customer").select("c_custkey", F.concat(F.lit("clip_"), F.col("c_custkey").cast("string")).alias("stem"))
    return v.join(s, "stem").select("s_suppkey", "c_custkey")


@query(f"""WITH {rel.TELEMETRY} SELECT round(avg(alt_m), 6) AS mean_alt, count(*) AS n FROM telemetry WHERE lat <> 0 AND lon <> 0 AND alt_m > 60""")
def mean_altitude(spark, d):
    return rel.telemetry(spark, d).filter("lat <> 0 AND lon <> 0 AND alt_m > 60").agg(F.round(F.avg("alt_m"), 6).alias("mean_alt"), F.count("*").alias("n"))


@query(f"""WITH {rel.DETS} SELECT label, count(*) AS frames, round(sum(x), 4) AS conf_sum FROM (SELECT label, frame_seq, max(conf) AS x FROM dets GROUP BY ALL) GROUP BY label""")
def nested_report(spark, d):
    one = rel.dets(spark, d).groupBy("label", "frame_seq").agg(F.max("conf").alias("c"))
    m = X.nested_report(one, "label", "frame_seq", F.col("c"))
    return m.select("label", F.size("frames").cast("long").alias("frames"), F.round(F.aggregate(F.map_values("frames"), F.lit(0.0), lambda a, b: a + b), 4).alias("conf_sum"))


@query(f"""WITH {rel.BOXES} SELECT det_id, CASE label WHEN 'click' THEN 'easy' WHEN 'view' THEN 'medium' ELSE 'hard' END AS difficulty FROM boxes WHERE conf >= CASE label WHEN 'click' THEN 0.30 WHEN 'view' THEN 0.20 ELSE 0.03 END""")
def difficulty_threshold(spark, d):
    from aerograph.config import DIFFICULTY_THRESHOLD

    level = F.when(F.col("label") == "click", "easy").when(F.col("label") == "view", "medium").otherwise("hard")
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in DIFFICULTY_THRESHOLD.items() for x in kv)), level)
    return rel.boxes(spark, d).filter(F.col("conf") >= limit).select("det_id", level.alias("difficulty"))


@query(f"WITH {rel.BOXES} SELECT det_id, label, row_number() OVER (PARTITION BY label ORDER BY parent_path, det_id) AS pos FROM boxes")
def image_order(spark, d):
    """Each image's place by name among those of its label."""
    return X.numbered(rel.boxes(spark, d).select("det_id", "label", "parent_path"), "label", ["parent_path", "det_id"]).select("det_id", "label", "pos")


@query(f"""WITH {rel.TELEMETRY}, s AS (SELECT event_id, alt_m * 6.3 / 4.5 AS w, alt_m * 4.7 / 4.5 AS h, lat, lon FROM telemetry)
SELECT event_id, round(lat + 1.5 * h / 111320.0, 6) AS north, round(lat - 1.5 * h / 111320.0, 6) AS south, round(lon + 1.5 * w / (111320.0 * cos(radians(lat))), 6) AS east, round(lon - 1.5 * w / (111320.0 * cos(radians(lat))), 6) AS west FROM s""")
def synthetic_bounds(spark, d):
    t = rel.telemetry(spark, d)
    w, h = G.ground_size("alt_m")
    (n, e), (s, x) = G.metres_to_latlon(1.5 * h, 1.5 * w, "lat", "lon"), G.metres_to_latlon(-1.5 * h, -1.5 * w, "lat", "lon")
    return t.select("event_id", *(F.round(v, 6).alias(k) for k, v in (("north", n), ("south", s), ("east", e), ("west", x))))
