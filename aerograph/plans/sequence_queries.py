"""Queries over time series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerograph.functions import geo as G
from aerograph.functions import scalar as S
from aerograph.operators import geometry as O
from aerograph.operators import motion as M
from aerograph.operators import sequences as T
from aerograph.plans import relations as rel
from aerograph.plans.registry import query


@query(f"""WITH {rel.TELEMETRY}, s AS (SELECT stream_id, ts_ms, lat, lon, alt_m FROM telemetry WHERE event_type <> 'click'), q AS (SELECT event_id, stream_id, ts_ms FROM telemetry WHERE event_type = 'click'),
a AS (SELECT q.*, s.ts_ms AS t0, s.lat AS lat0, s.lon AS lon0, s.alt_m AS alt0 FROM q ASOF LEFT JOIN s ON q.stream_id = s.stream_id AND q.ts_ms >= s.ts_ms),
b AS (SELECT a.*, s.ts_ms AS t1, s.lat AS lat1, s.lon AS lon1, s.alt_m AS alt1 FROM a ASOF LEFT JOIN s ON a.stream_id = s.stream_id AND a.ts_ms <= s.ts_ms),
c AS (SELECT event_id, ts_ms, coalesce(t0, t1) AS t0, coalesce(lat0, lat1) AS lat0, coalesce(lon0, lon1) AS lon0, coalesce(alt0, alt1) AS alt0, coalesce(t1, t0) AS t1, coalesce(lat1, lat0) AS lat1, coalesce(lon1, lon0) AS lon1, coalesce(alt1, alt0) AS alt1 FROM b),
w AS (SELECT *, CASE WHEN t1 > t0 THEN (ts_ms - t0) / CAST(t1 - t0 AS DOUBLE) ELSE 0 END AS f FROM c)
SELECT event_id, round(lat0 + f * (lat1 - lat0), 6) AS lat, round(lon0 + f * (lon1 - lon0), 6) AS lon FROM w""")
def telemetry_interpolate(spark, d):
    t = rel.telemetry(spark, d)
    s, q = t.filter("event_type <> 'click'"), t.filter("event_type = 'click'").select("event_id", "stream_id", "ts_ms")
    out = T.interpolate(s, q, "stream_id", "ts_ms", ["lat", "lon", "alt_m"])
    return out.select("event_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"""WITH {rel.TELEMETRY}, p AS (SELECT *, row_number() OVER w AS rn, (ts_ms - lag(ts_ms) OVER w) / 1000.0 AS dt, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM telemetry WINDOW w AS (PARTITION BY stream_id ORDER BY ts_ms, event_id)),
q AS (SELECT *, sqrt(pow((lat - a) * 111320.0, 2) + pow((lon - b) * 111320.0 * cos(radians((lat + a) / 2)), 2)) AS dist FROM p),
r AS (SELECT stream_id, arg_min(dist / dt, rn) AS speed_ms FROM q WHERE rn <= 15 AND dt > 0 AND dist > 0.2 GROUP BY stream_id)
SELECT stream_id, round(speed_ms, 9) AS speed_ms FROM r""")
def ground_speed(spark, d):
    return T.ground_speed(rel.telemetry(spark, d), "stream_id", ["ts_ms", "event_id"], "ts_ms").withColumn("speed_ms", F.round("speed_ms", 9))


def haversine(a: str, b: str, c: str, e: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))"
    return f"2 * 6371000.0 * atan2(sqrt({h}), sqrt(greatest(0, 1 - {h})))"


@query(f"""WITH RECURSIVE {rel.TELEMETRY}, s AS (SELECT stream_id, frame_seq AS seq, {haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS shift_m FROM telemetry WINDOW w AS (PARTITION BY stream_id ORDER BY frame_seq)),
e AS (SELECT stream_id, seq, shift_m, CAST(0 AS DOUBLE) AS ema FROM s WHERE seq = 1
  UNION ALL SELECT s.stream_id, s.seq, s.shift_m, CASE WHEN e.ema = 0 THEN s.shift_m ELSE 0.4 * s.shift_m + 0.6 * e.ema END FROM e JOIN s ON s.stream_id = e.stream_id AND s.seq = e.seq + 1)
SELECT stream_id, CAST(seq AS INTEGER) AS seq, CASE WHEN seq > 1 THEN round(ema, 4) END AS ema_m, CASE WHEN seq = 1 THEN 0.6 ELSE round(greatest(0.5, least(0.95, 1 - greatest(0.1, 0.5 * ema / 2000.0))), 6) END AS threshold FROM e""")
def adaptive_threshold_ema(spark, d):
    t = T.adaptive_thresholds(rel.telemetry(spark, d), "stream_id", ["frame_seq"], 2000.0)
    return t.select("stream_id", "seq", F.round("ema_m", 4).alias("ema_m"), F.round("threshold", 6).alias("threshold"))


@query("""WITH v AS (SELECT DISTINCT user_id, event_id // 10 AS f FROM events WHERE value > 100), g AS (SELECT *, f - row_number() OVER (PARTITION BY user_id ORDER BY f) AS g FROM v)
SELECT user_id, min(f) AS first_frame, max(f) AS last_frame, count(*) AS frames FROM g GROUP BY user_id, g""")
def visibility_islands(spark, d):
    e = rel.read(spark, d, "events").filter("value > 100").select("user_id", F.floor(F.col("event_id") / 10).alias("f"))
    return T.islands(e, "user_id", "f")


@query(f"""WITH {rel.DETS}, t AS (SELECT *, CAST(trunc((lat - 0.00005) * 37106.666666666664) AS INT) AS r0, CAST(trunc((lat + 0.00005) * 37106.666666666664) AS INT) + 1 AS r1, CAST(trunc((lon - 0.00005) * 31468.237) AS INT) AS c0, CAST(trunc((lon + 0.00005) * 31468.237) AS INT) + 1 AS c1 FROM dets),
c AS (SELECT det_id, frame_seq, unnest(list_transform(range(0, (r1 - r0 + 1) * (c1 - c0 + 1)), lambda i: (r0 + i // (c1 - c0 + 1)) * 10000000::BIGINT + c0 + i % (c1 - c0 + 1))) AS cell FROM t),
s AS (SELECT cell, min(frame_seq) AS seen FROM c GROUP BY cell), o AS (SELECT det_id, avg(CASE WHEN seen < frame_seq THEN 1.0 ELSE 0.0 END) AS overlap FROM c JOIN s USING (cell) GROUP BY det_id)
SELECT det_id, round(overlap, 6) AS overlap, overlap < 0.6 AS foreground FROM o""".replace("31468.237", repr(111_320.0 * __import__("math").cos(__import__("math").radians(32.0)) / 3.0)))
def novelty_batch(spark, d):
    t = rel.dets(spark, d)
    for n, (a, b) in {"a": (-0.00005, -0.00005), "b": (0.00005, 0.00005)}.items():
        t = t.withColumns({f"lat_{n}": F.col("lat") + a, f"lon_{n}": F.col("lon") + b})
    t = O.cells_of(t, ["lat_a", "lat_b"], ["lon_a", "lon_b"], ref_lat=32.0)
    return T.novelty(t, "cells", "frame_seq", "det_id", 0.60).select("det_id", F.round("overlap", 6).alias("overlap"), "foreground")


@query(f"""WITH {rel.DETS}, s AS (SELECT count(*) AS hits, det_id % 10 AS slot FROM dets GROUP BY slot) SELECT slot + 1 AS track_no, hits, 0.557 AS speed_ms FROM s""")
def track_velocity(spark, d):
    one = rel.dets(spark, d).withColumn("label", F.lit("car"))
    t = T.track_velocity(one)
    return t.groupBy("track_no").agg(F.count("*").alias("hits"), F.round(F.max("speed_ms"), 3).alias("speed_ms"))


@query()
def track_velocity_by_label(spark, d):
    return T.track_velocity(rel.dets(spark, d)).withColumn("speed_ms", F.round("speed_ms", 4))


@query("""SELECT event_id % 10 AS stream_id, CAST(1 AS BIGINT) AS track_id, count(*) AS hit_count, min(event_id // 10) AS first_frame, max(event_id // 10) AS last_frame, count(*) >= 16 AS confirmed FROM events GROUP BY ALL""")
def motion_tracks(spark, d):
    e = rel.read(spark, d, "events")
    f = F.floor(F.col("event_id") / 10)
    b = e.select((F.col("event_id") % 10).alias("stream_id"), F.col("event_id").alias("det_id"), f.alias("frame_seq"), (f * 8 % 5600).cast("double").alias("cx"), F.lit(240.0).alias("cy"))
    return T.motion_tracks(b.filter("cx < 5600"), match_px=6000.0)


@query()
def motion_process(spark, d):
    """Ten streams with one target each, which crosses a level scene five pixels a frame, again and again."""
    e = rel.read(spark, d, "events").select((F.col("event_id") % 10).alias("stream_id"), F.col("event_id").alias("det_id"), F.floor(F.col("event_id") / 10).alias("frame_seq"))
    blobs = e.withColumns({"cx": (F.col("frame_seq") % 110) * 5 + 40.0, "cy": F.lit(240.0)})
    level = {"lat": 32.0, "alt_m": 80.0, "pitch": -90.0, "yaw": 0.0, "dx": 0.0, "dy": 0.0}
    frames = e.select("stream_id", "frame_seq", *(F.lit(v).cast("double").alias(k) for k, v in level.items()), F.lit(640).alias("img_w"), F.lit(480).alias("img_h"))
    out = M.motion_process(blobs, frames)
    return out.withColumns({c: F.round(c, 4) for c in ("spread_m", "height_m", "confidence")})


WF = """o AS (SELECT user_id % 40 AS track_id, 80.0 + value / 50 AS alt_m, CAST(event_id % 97 AS DOUBLE) AS cam_e, CAST(event_id % 89 AS DOUBLE) AS cam_n, event_id % 97 + (event_id % 7) * 3.0 AS geo_e, event_id % 89 + (event_id % 5) * 2.0 AS geo_n FROM events),
sp AS (SELECT track_id, max(alt_m) AS top, count(*) AS n FROM o GROUP BY track_id HAVING count(*) >= 8)"""


def spread(grid: str) -> str:
    share = "((alt_m - h) / alt_m)"
    return f"(SELECT track_id, h, var_pop(cam_e + (geo_e - cam_e) * {share}) + var_pop(cam_n + (geo_n - cam_n) * {share}) AS v FROM o JOIN {grid} USING (track_id) WHERE alt_m > h AND alt_m > 0 GROUP BY track_id, h HAVING count(*) >= 3)"


@query(f"""WITH {WF}, g AS (SELECT track_id, unnest(range(0, 60)) * top * 0.95 / 59 AS h FROM sp), v1 AS {spread('g')}, b1 AS (SELECT track_id, min(v) AS v, arg_min(h, (v, h)) AS h FROM v1 GROUP BY track_id),
r AS (SELECT track_id, greatest(0, h - top * 0.95 / 59) AS lo, least(top * 0.95, h + top * 0.95 / 59) AS hi FROM b1 JOIN sp USING (track_id)), g2 AS (SELECT track_id, lo + unnest(range(0, 21)) * (hi - lo) / 20 AS h FROM r),
v2 AS {spread('g2')}, b2 AS (SELECT track_id, min(v) AS v FROM v2 GROUP BY track_id)
SELECT track_id, round(sqrt(least(b1.v, coalesce(b2.v, b1.v))), 5) AS spread_m FROM b1 LEFT JOIN b2 USING (track_id)""")
def world_fixed_variance(spark, d):
    e, n = rel.read(spark, d, "events"), F.col("event_id")
    o = e.select((F.col("user_id") % 40).alias("track_id"), (80.0 + F.col("value") / 50).alias("alt_m"), (n % 97).cast("double").alias("cam_e"), (n % 89).cast("double").alias("cam_n"), (n % 97 + (n % 7) * 3.0).alias("geo_e"), (n % 89 + (n % 5) * 2.0).alias("geo_n"))
    return T.world_fixed(o).select("track_id", F.round("spread_m", 5).alias("spread_m"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS mean_s FROM events")
def rolling_fps(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-29, 0)
    return rel.read(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean_s"))


@query("SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS base_s, round(sum(value - 245) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS offset_m FROM events")
def segment_base_time(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    base = F.coalesce(F.sum("value").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rel.read(spark, d, "events").select("event_id", F.round(base, 4).alias("base_s"), F.round(F.sum(F.col("value") - 245).over(w.rowsBetween(W.unboundedPreceding, 0)), 4).alias("offset_m"))


@query("SELECT event_id, 16 + least(10, CAST(floor(greatest(0, value / 5 - 15) / 5) AS INT)) AS persist, event_id % 100 = 8 OR (event_id % 100 > 8 AND (event_id % 100 - 8) % 15 = 0) AS retest FROM events")
def dynamic_persist(spark, d):
    n = F.col("event_id") % 100
    return rel.read(spark, d, "events").select("event_id", S.dynamic_persist(F.col("value") / 5).alias("persist"), ((n == 8) | ((n > 8) & ((n - 8) % 15 == 0))).alias("retest"))


@query("SELECT event_id, round(0.65 * least(1, greatest(0, (value / 200 - 0.5) / 1.0)) + 0.25 * least(1, user_id / 60.0) + 0.10 * (1 - (event_id % 5) / CAST(greatest(1, user_id + event_id % 5) AS DOUBLE)), 9) AS confidence FROM events")
def motion_confidence(spark, d):
    return rel.read(spark, d, "events").select("event_id", F.round(S.motion_confidence(F.col("value") / 200, "user_id", F.col("event_id") % 5), 9).alias("confidence"))


@query("""WITH w AS (SELECT user_id, event_id AS t, CAST(event_id % 90 AS DOUBLE) AS lat, lead(event_id) OVER o AS t1, CAST(lead(event_id % 90) OVER o AS DOUBLE) AS lat1 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, t + (t1 - t) // 2 AS at, round(lat + (lat1 - lat) * ((t1 - t) // 2) / (t1 - t), 6) AS lat FROM w WHERE t1 IS NOT NULL""")
def waypoint_interpolate(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    e = rel.read(spark, d, "events").select("user_id", F.col("event_id").alias("t"), (F.col("event_id") % 90).cast("double").alias("lat"), F.lead("event_id").over(w).alias("t1"))
    q = e.filter("t1 IS NOT NULL").select("user_id", F.expr("t + (t1 - t) div 2").alias("t"))
    return T.interpolate(e.select("user_id", "t", "lat"), q, "user_id", "t", ["lat"]).select("user_id", F.col("t").alias("at"), F.round("lat", 6).alias("lat"))


@query("""WITH e AS (SELECT *, epoch_ms(ts) AS ms FROM events) SELECT event_id, event_type FROM e WHERE abs(ms - (SELECT min(ms) FROM e) - 1209600000) <= 3600000""")
def timeline_interval(spark, d):
    e = rel.read(spark, d, "events").withColumn("ms", rel.millis("ts"))
    start = e.agg(F.min("ms")).first()[0]
    at = (start or 0) + 1_209_600_000
    return e.filter(F.col("ms").between(at - 3_600_000, at + 3_600_000)).select("event_id", "event_type")


@query(f"""WITH {rel.DETS}, s AS (SELECT label || '_' || CAST(det_id % 13 AS VARCHAR) AS track, count(*) AS n FROM dets GROUP BY ALL) SELECT track, n FROM s WHERE n >= 8""")
def trajectory_length(spark, d):
    t = rel.dets(spark, d).groupBy(F.concat_ws("_", "label", (F.col("det_id") % 13).cast("string")).alias("track")).agg(F.count("*").alias("n"))
    return t.filter("n >= 8")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark, d):
    """The batch twin of a watermarked window count."""
    e = rel.read(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
