"""Queries over tiles and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerograph.functions import scalar as S
from aerograph.operators import detections as D
from aerograph.operators import retrieval as R
from aerograph.plans import relations as rel
from aerograph.plans.registry import query

Q = "q AS (SELECT v AS q FROM tiles ORDER BY vec_id LIMIT 1)"


def first_vector(tiles: DataFrame):
    """The query vector: that of the smallest id."""
    return R.vector(tiles.orderBy("vec_id").select("embedding").first()[0])


@query(f"WITH {rel.TILES}, {Q} SELECT vec_id, round(list_distance(v, q), 6) AS dist FROM tiles, q ORDER BY list_distance(v, q), vec_id LIMIT 20")
def knn_l2_topk(spark, d):
    t = rel.tiles(spark, d)
    return R.knn(t, first_vector(t), 20).select("vec_id", F.round("dist", 6).alias("dist"))


@query(f"""WITH {rel.TILES}, {Q}, k AS (SELECT vec_id, parent_path, list_distance(v, q) AS dist FROM tiles, q ORDER BY dist, vec_id LIMIT 20),
f AS (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY dist, vec_id) AS rn FROM k)
SELECT vec_id, parent_path, round(dist, 6) AS dist FROM f WHERE rn = 1 ORDER BY f.dist, vec_id LIMIT 8""")
def knn_diverse_per_parent(spark, d):
    t = rel.tiles(spark, d)
    return R.knn_diverse(t, first_vector(t), 20, 8).select("vec_id", "parent_path", F.round("dist", 6).alias("dist"))


@query(f"""WITH {rel.TILES}, {Q}, s AS (SELECT vec_id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)) + 1e-9) AS sim FROM tiles, q),
r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS rn, count(*) OVER () AS n FROM s)
SELECT vec_id, round(sim, 6) AS sim FROM r WHERE rn <= CASE WHEN n < 4 THEN n WHEN n <= 20 THEN greatest(2, CAST(floor(0.6 * n) AS INT)) ELSE greatest(20, CAST(floor(0.3 * n) AS INT)) END""")
def prefilter_cosine_fraction(spark, d):
    t = rel.tiles(spark, d)
    return R.prefilter(t, first_vector(t)).select("vec_id", F.round("sim", 6).alias("sim"))


@query(f"""WITH {rel.TILES}, e AS (SELECT v AS ev FROM tiles WHERE label = 0 ORDER BY vec_id LIMIT 5), a AS (SELECT v AS av FROM tiles WHERE label = 1 ORDER BY vec_id LIMIT 5),
b AS (SELECT vec_id, (SELECT max(list_cosine_similarity(v, av)) FROM a) AS ba, (SELECT max(list_cosine_similarity(v, ev)) FROM e) AS be FROM tiles),
s AS (SELECT *, CASE WHEN be > 0.01 THEN (ba - be) / be ELSE ba - be END AS score FROM b)
SELECT vec_id, round(ba, 6) AS best_anomaly, round(be, 6) AS best_expected, round(score, 6) AS score FROM s WHERE score > 0.03""")
def segment_margin_score(spark, d):
    t = rel.tiles(spark, d)
    side = lambda n, name: t.filter(F.col("label") == n).orderBy("vec_id").limit(5).select(F.lit(name).alias("side"), F.col("embedding").alias("vec"))
    s = R.score_segments(t, side(0, "expected").unionByName(side(1, "anomaly")))
    return s.select("vec_id", *(F.round(c, 6).alias(c) for c in ("best_anomaly", "best_expected", "score")))


NMS = """g AS (SELECT parent_path, list({'c': -conf, 'k': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY conf DESC, det_id) AS b FROM boxes GROUP BY parent_path),
f AS (SELECT parent_path, list_reduce(list_transform(b, lambda x: [x]), lambda acc, d: CASE WHEN len(list_filter(acc, lambda a: greatest(
  greatest(0, least(a.x2, d[1].x2) - greatest(a.x1, d[1].x1)) * greatest(0, least(a.y2, d[1].y2) - greatest(a.y1, d[1].y1)) / CAST(greatest(1, (a.x2 - a.x1) * (a.y2 - a.y1) + (d[1].x2 - d[1].x1) * (d[1].y2 - d[1].y1)
    - greatest(0, least(a.x2, d[1].x2) - greatest(a.x1, d[1].x1)) * greatest(0, least(a.y2, d[1].y2) - greatest(a.y1, d[1].y1))) AS DOUBLE),
  greatest(0, least(a.x2, d[1].x2) - greatest(a.x1, d[1].x1)) * greatest(0, least(a.y2, d[1].y2) - greatest(a.y1, d[1].y1)) / CAST(greatest(1, least((a.x2 - a.x1) * (a.y2 - a.y1), (d[1].x2 - d[1].x1) * (d[1].y2 - d[1].y1))) AS DOUBLE)) > 0.5)) > 0
  THEN acc ELSE list_concat(acc, d) END) AS kept FROM g)"""


@query(f"WITH {rel.BOXES}, {NMS}, u AS (SELECT parent_path, unnest(kept) AS d FROM f) SELECT parent_path, d.k AS det_id, round(-d.c, 6) AS conf FROM u WHERE d.x2 - d.x1 >= 30 AND d.y2 - d.y1 >= 30")
def nms_class_agnostic(spark, d):
    """Small boxes suppress before they are dropped."""
    return D.valid_boxes(D.nms(rel.boxes(spark, d)), 30).select("parent_path", "det_id", F.round("conf", 6).alias("conf"))


@query(f"WITH {rel.BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY parent_path, label ORDER BY conf DESC, det_id) AS rn FROM boxes WHERE x2 - x1 >= 40 AND y2 - y1 >= 40) SELECT det_id, parent_path, label FROM r WHERE rn <= 3")
def min_size_and_tile_cap(spark, d):
    return D.tile_cap(D.valid_boxes(rel.boxes(spark, d), 40), ["parent_path", "label"], 3).select("det_id", "parent_path", "label")


def near(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return f"2 * 6371000.0 * atan2(sqrt({h}), sqrt(greatest(0, 1 - {h}))) <= 3.0"


@query(f"""WITH {rel.DETS}, o AS (SELECT *, (frame_seq // 20) * 10 + det_id % 10 AS block FROM dets),
g AS (SELECT block, list({{'c': -conf, 'k': det_id, 'lat': lat, 'lon': lon, 'f': frame_seq}} ORDER BY conf DESC, det_id) AS b FROM o GROUP BY block),
s AS (SELECT block, b, list_reduce(list_transform(b, lambda x: [x]), lambda acc, d: CASE WHEN len(list_filter(acc, lambda a: {near("a", "d[1]")})) > 0 THEN acc ELSE list_concat(acc, d) END) AS seeds FROM g),
u AS (SELECT block, seeds, unnest(b) AS d FROM s),
m AS (SELECT block, list_position(list_transform(seeds, lambda a: {near("a", "d")}), true) AS instance_id, d.k AS det_id, -d.c AS conf, d.f AS frame_seq FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY block, instance_id, frame_seq ORDER BY conf DESC, det_id) AS rn FROM m),
t AS (SELECT *, row_number() OVER (PARTITION BY block, instance_id ORDER BY conf DESC, det_id) AS rk FROM r WHERE rn = 1)
SELECT block, instance_id, det_id, round(conf, 6) AS conf, frame_seq, count(*) OVER (PARTITION BY block, instance_id) > 1 AS is_multiangle FROM t WHERE rk <= 3""")
def geo_cluster_multiangle(spark, d):
    near = rel.dets(spark, d).withColumn("block", F.floor(F.col("frame_seq") / 20) * 10 + F.col("det_id") % 10)
    return D.merge_angles(near, "block").select("block", "instance_id", "det_id", F.round("conf", 6).alias("conf"), "frame_seq", "is_multiangle")


@query()
def geo_cluster_whole(spark, d):
    """The clusters of all detections, not of blocks."""
    return D.merge_detections(rel.dets(spark, d)).select("instance_id", "det_id", F.round("conf", 6).alias("conf"), "frame_seq", "is_multiangle")


@query(f"""WITH {rel.BOXES}, b AS (SELECT det_id, parent_path, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy FROM boxes)
SELECT det_id, parent_path FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.parent_path = b.parent_path AND o.det_id <> b.det_id AND sqrt((o.cx - b.cx) ** 2 + (o.cy - b.cy) ** 2) <= 60)""")
def isolation_gate(spark, d):
    b = rel.boxes(spark, d).withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    return D.isolation_gate(b, 60.0, frame="parent_path").select("det_id", "parent_path")


@query(f"""WITH {rel.BOXES}, b AS (SELECT det_id, x2 - x1 AS w, y2 - y1 AS h FROM boxes)
SELECT det_id, w * h AS area FROM b WHERE w * h BETWEEN 900 AND 6000 AND greatest(w, h) / CAST(greatest(least(w, h), 1) AS DOUBLE) <= 2.5""")
def blob_gate(spark, d):
    b = rel.boxes(spark, d).withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}).withColumn("area", F.col("w") * F.col("h"))
    return D.blob_gate(b, 900, 6000, 2.5).select("det_id", "area")


STATS = "count(value) AS n, round(min(value), 4) AS lo, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.9), 4) AS p90, round(avg(value), 4) AS mean, round(max(value), 4) AS hi"


@query(f"SELECT event_type, {STATS} FROM events GROUP BY event_type")
def percentile_stats_by_label(spark, d):
    return D.describe(rel.read(spark, d, "events"), ["event_type"], "value")


@query(f"""WITH {rel.BOXES}, {NMS}, u AS (SELECT unnest(kept) AS d FROM f), k AS (SELECT d.k AS det_id FROM u),
s AS (SELECT b.label, count(*) AS pre, count(k.det_id) AS post, count(k.det_id) FILTER (x2 - x1 >= 30 AND y2 - y1 >= 30) AS sized FROM boxes b LEFT JOIN k USING (det_id) GROUP BY b.label)
SELECT label, pre, post, sized, pre - post AS suppressed, CASE WHEN pre = 0 THEN 0 ELSE round((pre - post) / CAST(pre AS DOUBLE), 4) END AS rejection_rate FROM s""")
def stage_funnel(spark, d):
    """What suppression, and then the size limit, let through."""
    b = rel.boxes(spark, d)
    kept = D.nms(b).select("det_id", F.lit(True).alias("k"))
    sized = F.col("k") & (F.col("x2") - F.col("x1") >= 30) & (F.col("y2") - F.col("y1") >= 30)
    s = b.join(kept, "det_id", "left").groupBy("label").agg(F.count("*").alias("pre"), F.count("k").alias("post"), F.count_if(F.coalesce(sized, F.lit(False))).alias("sized"))
    lost = F.col("pre") - F.col("post")
    return s.select("label", "pre", "post", "sized", lost.alias("suppressed"), F.when(F.col("pre") == 0, 0.0).otherwise(F.round(lost / F.col("pre"), 4)).alias("rejection_rate"))


@query("SELECT least(25, CAST(floor(value / 500 * 25) AS INT) + 1) AS bin, count(*) AS n FROM events WHERE value / 500 BETWEEN 0 AND 1 GROUP BY ALL")
def confidence_histogram(spark, d):
    return D.histogram(rel.read(spark, d, "events").select((F.col("value") / 500).alias("conf")), "conf")


@query(f"WITH {rel.BOXES} SELECT parent_path, arg_max(det_id, (conf, -det_id)) AS det_id, round(max(conf), 6) AS conf FROM boxes GROUP BY parent_path")
def best_detection(spark, d):
    return D.best_row(rel.boxes(spark, d), ["parent_path"], "conf", "det_id", ["det_id", "conf"]).withColumn("conf", F.round("conf", 6))


@query(f"""WITH {rel.BOXES}, t AS (SELECT 'frame_' || CAST(o_orderkey AS VARCHAR) AS parent_path, epoch_ms(o_orderdate) AS ts FROM orders WHERE o_orderkey % 3 <> 0)
SELECT det_id, coalesce(ts, 0) AS ts_ms FROM boxes LEFT JOIN t USING (parent_path)""")
def frame_timestamp_join(spark, d):
    o = rel.read(spark, d, "orders").filter("o_orderkey % 3 <> 0")
    t = o.select(F.concat(F.lit("frame_"), F.col("o_orderkey").cast("string")).alias("parent_path"), F.expr("unix_millis(cast(o_orderdate AS timestamp))").alias("ts_ms"))
    return D.frame_times(rel.boxes(spark, d), t, "parent_path").select("det_id", "ts_ms")


@query(f"""WITH {rel.DETS}, r AS (SELECT frame_seq, label, lat, lon FROM dets QUALIFY row_number() OVER (PARTITION BY label ORDER BY frame_seq, det_id) = 1)
SELECT e.event_id, coalesce(round(r.lat, 6), 0) AS lat, coalesce(round(r.lon, 6), 0) AS lon FROM events e LEFT JOIN r ON e.event_type = r.label AND e.user_id % 2 = 0""")
def segment_first_match(spark, d):
    e = rel.read(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("label"))
    return D.first_match(e, rel.dets(spark, d), "label", ["frame_seq", "det_id"], ["lat", "lon"]).select("event_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"""WITH {rel.DETS}, m AS (SELECT label, quantile_cont(lat, 0.5) AS a, quantile_cont(lon, 0.5) AS b FROM dets GROUP BY label)
SELECT det_id FROM dets, (SELECT quantile_cont(lat, 0.5) AS a, quantile_cont(lon, 0.5) AS b FROM dets) WHERE abs(lat - a) < 0.004 AND abs(lon - b) < 0.002""")
def coverage_outlier_filter(spark, d):
    p = rel.dets(spark, d)
    scaled = p.withColumns({"a": F.col("lat") * 37.5, "b": F.col("lon") * 75})
    return D.coverage_outliers(scaled, "a", "b", 0.15).select("det_id")


@query()
def coverage_hull(spark, d):
    h = D.hull_frame(rel.dets(spark, d), "label")
    return h.select("label", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


ZOOM = "CASE WHEN span <= 0 THEN 17 WHEN span <= 0.002 THEN 18 WHEN span <= 0.005 THEN 17 WHEN span <= 0.01 THEN 16 WHEN span <= 0.02 THEN 15 WHEN span <= 0.05 THEN 14 WHEN span <= 0.1 THEN 13 WHEN span <= 0.2 THEN 12 WHEN span <= 0.5 THEN 11 WHEN span <= 1 THEN 10 WHEN span <= 2 THEN 9 WHEN span <= 5 THEN 8 ELSE 7 END"


@query(f"""WITH {rel.DETS}, s AS (SELECT label, avg(lat) AS lat, avg(lon) AS lon, greatest((max(lat) - min(lat)) * 1.3, (max(lon) - min(lon)) * 1.3) AS span FROM dets GROUP BY label)
SELECT label, round(lat, 6) AS lat, round(lon, 6) AS lon, {ZOOM} AS zoom FROM s""")
def recenter_zoom(spark, d):
    return D.recentre(rel.dets(spark, d), ["label"]).select("label", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "zoom")


@query(f"""WITH {rel.DETS}, f AS (SELECT frame_seq, arg_min(lat, det_id) AS lat, arg_min(lon, det_id) AS lon FROM dets GROUP BY frame_seq)
SELECT round(quantile_cont(lat, 0.5), 6) AS lat, round(quantile_cont(lon, 0.5), 6) AS lon, count(*) AS frames FROM f""")
def first_then_median(spark, d):
    f = rel.dets(spark, d).groupBy("frame_seq").agg(F.min_by("lat", "det_id").alias("lat"), F.min_by("lon", "det_id").alias("lon"))
    return f.agg(F.round(F.expr("percentile(lat, 0.5D)"), 6).alias("lat"), F.round(F.expr("percentile(lon, 0.5D)"), 6).alias("lon"), F.count("*").alias("frames"))


@query(f"WITH {rel.BOXES} SELECT label, count(DISTINCT parent_path) AS frames, count(*) AS segments FROM boxes GROUP BY label")
def distinct_frames(spark, d):
    return rel.boxes(spark, d).groupBy("label").agg(F.countDistinct("parent_path").alias("frames"), F.count("*").alias("segments"))


@query(f"WITH {rel.BOXES} SELECT det_id, x1, x2 FROM boxes WHERE parent_path = 'frame_3'")
def tiles_for_frame(spark, d):
    return rel.boxes(spark, d).filter("parent_path = 'frame_3'").select("det_id", "x1", "x2")


@query(f"""WITH {rel.BOXES}, a AS (SELECT parent_path AS id, count(*) AS n, 'old' AS run FROM boxes WHERE det_id % 2 = 0 GROUP BY parent_path),
b AS (SELECT parent_path AS id, count(*) AS n, 'new' AS run FROM boxes WHERE conf > 0.9 GROUP BY parent_path HAVING count(*) >= 2)
SELECT * FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT * FROM b""")
def upsert_tracks(spark, d):
    count = lambda x, run: x.groupBy(F.col("parent_path").alias("id")).agg(F.count("*").alias("n")).withColumn("run", F.lit(run))
    b = rel.boxes(spark, d)
    return D.upsert(count(b.filter("det_id % 2 = 0"), "old"), count(b.filter("conf > 0.9"), "new").filter("n >= 2"), ["id"])


@query(f"WITH {rel.TILES} SELECT vec_id, parent_path FROM tiles WHERE parent_path NOT IN (SELECT parent_path FROM tiles WHERE vec_id % 97 = 0)")
def idempotent_ingest(spark, d):
    t = rel.tiles(spark, d)
    return D.not_yet(t, t.filter("vec_id % 97 = 0"), "parent_path").select("vec_id", "parent_path")


@query(f"""WITH {rel.BOXES} SELECT det_id, substr(sha1(parent_path || '|' || CAST(x1 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || '|[' || concat_ws(', ', x1, y1, x2, y2) || ']'), 1, 8) AS track_id FROM boxes""")
def stable_track_id(spark, d):
    return rel.boxes(spark, d).select("det_id", S.stable_id("parent_path", "x1", "y1", F.array("x1", "y1", "x2", "y2")).alias("track_id"))


@query(f"""WITH {rel.DETS} SELECT label, list({{'det': det_id, 'c': round(conf, 4)}} ORDER BY det_id)[1].det AS first_det, count(*) AS n, list(round(conf, 4) ORDER BY det_id)[1] AS first_conf, max(round(conf, 4)) AS top FROM dets GROUP BY label HAVING count(*) >= 2""")
def published_records(spark, d):
    c = F.round("conf", 4)
    g = rel.dets(spark, d).groupBy("label").agg(F.min("det_id").alias("first_det"), F.count("*").alias("n"), F.min_by(c, "det_id").alias("first_conf"), F.max(c).alias("top"))
    return g.filter("n >= 2")


@query(f"""WITH {rel.BOXES}, t AS (SELECT label || '_' || CAST(det_id % 7 AS VARCHAR) AS track, count(*) AS n, count(DISTINCT parent_path) AS frames FROM boxes GROUP BY ALL)
SELECT track, n FROM t WHERE frames > 1 ORDER BY n DESC, track LIMIT 3""")
def top_tracks(spark, d):
    t = rel.boxes(spark, d).groupBy(F.concat_ws("_", "label", (F.col("det_id") % 7).cast("string")).alias("track")).agg(F.count("*").alias("n"), F.countDistinct("parent_path").alias("frames"))
    return t.filter("frames > 1").orderBy(F.desc("n"), "track").limit(3).select("track", "n")


@query("""WITH t AS (SELECT event_id, value / 500 AS c, CASE WHEN event_id % 3 = 0 THEN [0.1, 0.2, 0.1 + value / 600, 0.9] WHEN event_id % 3 = 1 THEN [100.0, 200.0, 100 + value * 2, 900.0] ELSE [10.0, 20.0, 5 + value, 700.0] END AS b FROM events),
n AS (SELECT event_id, c, list_transform(b, lambda x: CASE WHEN list_max(b) <= 1 THEN x * 640 WHEN event_id % 3 = 1 THEN x / 1000 * 640 ELSE x END) AS b FROM t),
k AS (SELECT event_id, c, list_transform(b, lambda x: least(640.0, greatest(0.0, x))) AS b FROM n)
SELECT event_id, round(b[1], 4) AS x1, round(b[2], 4) AS y1, round(b[3], 4) AS x2, round(b[4], 4) AS y2 FROM k WHERE c >= 0.10 AND b[3] > b[1] AND b[4] > b[2]""")
def reply_box_repair(spark, d):
    """Boxes of 0 to 1 or 0 to 1000 to pixels, clamped, without faint and inverted ones."""
    e, v, m = rel.read(spark, d, "events"), F.col("value"), F.col("event_id") % 3
    arr = lambda *x: F.array(*(F.lit(y) if isinstance(y, float) else y for y in x))
    box = F.when(m == 0, arr(0.1, 0.2, 0.1 + v / 600, 0.9)).when(m == 1, arr(100.0, 200.0, 100 + v * 2, 900.0)).otherwise(arr(10.0, 20.0, 5 + v, 700.0))
    rows = e.select("event_id", (v / 500).alias("c"), m.alias("m"), box.alias("b"))
    rows = rows.withColumn("b", F.transform("b", lambda x: F.when(F.array_max("b") <= 1, x * 640).when(F.col("m") == 1, x / 1000 * 640).otherwise(x)))
    rows = rows.withColumn("b", F.transform("b", lambda x: S.clamp(x, 0.0, 640.0)))
    at = lambda i: F.col("b")[i]
    rows = rows.filter((F.col("c") >= 0.10) & (at(2) > at(0)) & (at(3) > at(1)))
    return rows.select("event_id", *(F.round(at(i), 4).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


@query("""SELECT event_id, tile_x + CAST(100.7 AS INT) - 1 AS frame_x1, CAST(floor(100.7 + value) AS INT) AS x2 FROM (SELECT event_id, value, (event_id % 4) * 576 AS tile_x FROM events) WHERE CAST(floor(100.7 + value) AS INT) > 100 AND event_id % 5 <> 0""")
def detector_output_parse(spark, d):
    e = rel.read(spark, d, "events").select("event_id", "value", ((F.col("event_id") % 4) * 576).alias("tile_x"), F.lit(0).alias("tile_y"))
    good = F.concat(F.lit('{"detections": [{"bbox": [100.7, 5, '), (100.7 + F.col("value")).cast("string"), F.lit(', 50], "confidence": 0.5, "label": "car"}, {"bbox": [1, 2], "confidence": 1}]}'))
    return D.parse_detector_output(e.withColumn("reply", F.when(F.col("event_id") % 5 == 0, "no JSON").otherwise(good))).select("event_id", "frame_x1", "x2")


@query("""WITH s AS (SELECT user_id % 20 AS hits, count(*) AS n, sum(CASE WHEN value > 350 THEN 1 ELSE 0 END) AS confirmed, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS suppressed FROM events GROUP BY ALL)
SELECT hits, n, CAST(confirmed AS BIGINT) AS confirmed, CAST(suppressed AS BIGINT) AS suppressed FROM s""")
def motion_run_counters(spark, d):
    c = lambda x, name: F.count_if(x).alias(name)
    return rel.read(spark, d, "events").groupBy((F.col("user_id") % 20).alias("hits")).agg(F.count("*").alias("n"), c(F.col("value") > 350, "confirmed"), c(F.col("event_type") == "click", "suppressed"))


@query(f"WITH {rel.BOXES} SELECT det_id, parent_path FROM boxes WHERE conf >= 0.70 AND label <> 'click'")
def confident_tracks(spark, d):
    return rel.boxes(spark, d).filter("conf >= 0.70 AND label <> 'click'").select("det_id", "parent_path")


@query(f"""WITH {rel.DETS}, s AS (SELECT DISTINCT frame_seq AS snap FROM dets WHERE frame_seq % 90 = 0), x AS (SELECT label, max(frame_seq) AS f FROM dets GROUP BY label)
SELECT label, f, arg_min(snap, (abs(snap - f), snap)) AS snap FROM x, s GROUP BY label, f""")
def nearest_snapshot(spark, d):
    x = rel.dets(spark, d)
    last = x.groupBy("label").agg(F.max("frame_seq").alias("f"))
    low = F.floor(F.col("f") / 90) * 90  # snapshots stand at every ninetieth frame, so two can be nearest
    both = last.select("label", "f", F.explode(F.array(low, low + 90)).alias("snap"))
    known = x.filter("frame_seq % 90 = 0").select(F.col("frame_seq").alias("snap")).distinct()
    return both.join(known, "snap", "left_semi").groupBy("label", "f").agg(F.min_by("snap", F.struct(F.abs(F.col("snap") - F.col("f")), "snap")).alias("snap"))
