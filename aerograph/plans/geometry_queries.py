"""Queries over camera geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerograph.functions import geo as G
from aerograph.functions import scalar as S
from aerograph.operators import geometry as O
from aerograph.plans import relations as rel
from aerograph.plans.registry import query


def rounded(names, digits=6):
    return [F.round(c, digits).alias(c) for c in names]


CORNER_COLUMNS = [f"fp_{c}_{a}" for c in G.CORNERS for a in ("lat", "lon")]

# Corners as (east, north) signs; a corner is the centre plus the offsets turned by yaw.
SIGNS = {"nw": (-1, 1), "ne": (1, 1), "se": (1, -1), "sw": (-1, -1)}


def placed(w: str, h: str) -> str:
    out = []
    for c, (x, y) in SIGNS.items():
        e, n = f"({x} * {w} / 2)", f"({y} * {h} / 2)"
        out.append(f"lat + ({n} * cos(radians(yaw)) - {e} * sin(radians(yaw))) / 111320.0 AS fp_{c}_lat")
        out.append(f"lon + ({n} * sin(radians(yaw)) + {e} * cos(radians(yaw))) / (111320.0 * cos(radians(lat))) AS fp_{c}_lon")
    return ", ".join(out)


ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in CORNER_COLUMNS)
NADIR = f"nadir AS (SELECT *, {placed('(alt_m * 6.3 / 4.5)', '(alt_m * 4.7 / 4.5)')} FROM telemetry)"


@query(f"WITH {rel.TELEMETRY}, {NADIR} SELECT event_id, {ROUND}, round(alt_m * 6.3 / 4.5, 2) AS ground_w_m, round(alt_m * 4.7 / 4.5, 2) AS ground_h_m, round(alt_m * 6.3 / 4.5 * 100 / 1920, 2) AS gsd_cm_px FROM nadir")
def frame_footprint(spark, d):
    t = rel.telemetry(spark, d)
    t = t.withColumns(G.frame_footprint("lat", "lon", "alt_m", "yaw", F.lit(1920)))
    return t.select("event_id", *rounded(CORNER_COLUMNS), "ground_w_m", "ground_h_m", "gsd_cm_px")


def ray(x: str, y: str) -> tuple[str, str, str]:
    p, a = "radians(pitch)", "radians(yaw)"
    f = f"(cos({p}) + ({y}) * sin({p}))"
    return f"({f} * sin({a}) + ({x}) * cos({a}))", f"({f} * cos({a}) - ({x}) * sin({a}))", f"(sin({p}) - ({y}) * cos({p}))"


def oblique_sql() -> str:
    hx, hy = "(6.3 / 4.5 / 2)", "(6.3 / 4.5 / 2 * 1080 / 1920)"
    rays = {c: ray(f"{x} * {hx}", f"{-y} * {hy}") for c, (x, y) in SIGNS.items()}
    ok = " AND ".join(f"{u} < -1e-9" for _, _, u in rays.values())
    flat = f"fl AS (SELECT *, {placed('(alt_m * 6.3 / 4.5)', '(alt_m * 6.3 / 4.5 * 1080 / 1920)')} FROM telemetry)"
    cols = []
    for c, (e, n, u) in rays.items():
        cols.append(f"round(CASE WHEN {ok} THEN lat + {n} * alt_m / -{u} / 111320.0 ELSE fp_{c}_lat END, 6) AS fp_{c}_lat")
        cols.append(f"round(CASE WHEN {ok} THEN lon + {e} * alt_m / -{u} / (111320.0 * cos(radians(lat))) ELSE fp_{c}_lon END, 6) AS fp_{c}_lon")
    return f"WITH {rel.TELEMETRY}, {flat} SELECT event_id, {ok} AS oblique, {', '.join(cols)} FROM fl"


@query(oblique_sql())
def oblique_footprint(spark, d):
    t = rel.telemetry(spark, d)
    slanted = G.oblique_corners("lat", "lon", "alt_m", "pitch", "yaw", F.lit(1920), F.lit(1080))
    flat = G.aspect_corners("lat", "lon", "alt_m", "yaw", F.lit(1920), F.lit(1080))
    return t.select("event_id", slanted["fp_nw_lat"].isNotNull().alias("oblique"), *(F.round(F.coalesce(slanted[c], flat[c]), 6).alias(c) for c in CORNER_COLUMNS))


E, N, U = ray("(x / 1920 * 2 - 1) * (6.3 / 4.5 / 2)", "(y / 1080 * 2 - 1) * (6.3 / 4.5 / 2) * 1080 / 1920")


@query(f"WITH {rel.TELEMETRY}, p AS (SELECT *, CAST(event_id % 1920 AS DOUBLE) AS x, CAST(event_id % 1080 AS DOUBLE) AS y FROM telemetry) SELECT event_id, CASE WHEN {U} < -1e-9 THEN round(sqrt({E} ** 2 + {N} ** 2) * alt_m / -{U}, 3) END AS range_m FROM p")
def pixel_ground_range(spark, d):
    t = rel.telemetry(spark, d)
    r = G.pixel_ground_range("alt_m", "pitch", (F.col("event_id") % 1920).cast("double"), (F.col("event_id") % 1080).cast("double"), F.lit(1920), F.lit(1080))
    return t.select("event_id", F.round(r, 3).alias("range_m"))


@query("""WITH f AS (SELECT p_partkey AS frame, 1920 + (p_partkey % 5) * 500 AS w, 1080 + (p_partkey % 3) * 400 AS h FROM part),
x AS (SELECT *, unnest(range(0, w, 576)) AS tile_x FROM f), y AS (SELECT *, unnest(range(0, h, 576)) AS tile_y FROM x)
SELECT frame, tile_x, tile_y, least(640, w - tile_x) AS tile_w, least(640, h - tile_y) AS tile_h FROM y""")
def tile_grid(spark, d):
    p = rel.read(spark, d, "part").select(F.col("p_partkey").alias("frame"), (1920 + (F.col("p_partkey") % 5) * 500).alias("w"), (1080 + (F.col("p_partkey") % 3) * 400).alias("h"))
    return O.tile_grid(p).select("frame", "tile_x", "tile_y", "tile_w", "tile_h")


BILINEAR = "(1 - u) * (1 - v) * fp_nw_{a} + u * (1 - v) * fp_ne_{a} + u * v * fp_se_{a} + (1 - u) * v * fp_sw_{a}"


@query(f"""WITH {rel.TELEMETRY}, {NADIR}, p AS (SELECT *, greatest(0, least(1, CASE WHEN event_id % 3 = 0 THEN event_id % 700 ELSE event_id % 500 + 20.0 END / 640)) AS u, greatest(0, least(1, CASE WHEN event_id % 3 = 0 THEN event_id % 650 ELSE event_id % 400 + 30.0 END / 640)) AS v FROM nadir)
SELECT event_id, round({BILINEAR.format(a='lat')}, 6) AS lat, round({BILINEAR.format(a='lon')}, 6) AS lon FROM p""")
def geolocate(spark, d):
    n = F.col("event_id")
    t = rel.telemetry(spark, d).withColumns(G.frame_footprint("lat", "lon", "alt_m", "yaw", F.lit(1920)))
    mask = lambda m: F.when(n % 3 == 0, (n % m).cast("double"))
    lat, lon = G.geolocate(n % 500, n % 400, n % 500 + 40, n % 400 + 60, F.lit(640), F.lit(640), mask(700), mask(650))
    return t.select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"WITH {rel.TELEMETRY}, {NADIR} SELECT event_id, round((event_id % 100) / 100.0, 4) AS u, round((event_id % 77) / 77.0, 4) AS v FROM nadir")
def geo_to_pixel(spark, d):
    n = F.col("event_id")
    t = rel.telemetry(spark, d).withColumns(G.frame_footprint("lat", "lon", "alt_m", "yaw", F.lit(1920)))
    lat, lon = G.pixel_to_geo((n % 100) / 100.0, (n % 77) / 77.0)
    t = t.withColumns({"plat": lat, "plon": lon}).withColumn("p", G.geo_to_pixel("plat", "plon"))
    return t.select("event_id", F.round("p.u", 4).alias("u"), F.round("p.v", 4).alias("v"))


@query(f"""WITH {rel.TELEMETRY}, {NADIR}, t AS (SELECT *, (event_id % 3) * 576 AS x, (event_id % 2) * 576 AS y FROM nadir), c AS (SELECT *, x / 1920.0 + 640 / 1920.0 / 2 AS u, y / 1080.0 + 640 / 1080.0 / 2 AS v FROM t)
SELECT event_id, round({BILINEAR.format(a='lat')}, 6) AS lat, round({BILINEAR.format(a='lon')}, 6) AS lon FROM c""")
def tile_centre(spark, d):
    n = F.col("event_id")
    t = rel.telemetry(spark, d).withColumns(G.frame_footprint("lat", "lon", "alt_m", "yaw", F.lit(1920)))
    t = t.withColumns(G.tile_footprint((n % 3) * 576, (n % 2) * 576, F.lit(640), F.lit(640), F.lit(1920), F.lit(1080)))
    lat, lon = G.tile_centre("tile")
    return t.select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


GSD = "(alt_m * 6.3 / (4.5 * 960))"


@query(f"""WITH {rel.TELEMETRY} SELECT event_id, round({GSD}, 10) AS gsd_m, floor(greatest(0, (90 - abs(pitch)) / 90) * 0.6 * 540) AS sky_row, round(greatest(4, pow(1 / {GSD}, 2)), 4) AS min_area_px, round(pow(30 / {GSD}, 2), 4) AS max_area_px, round(greatest(20, 6 / {GSD}), 4) AS match_dist_px FROM telemetry""")
def gsd_and_gates(spark, d):
    t = rel.telemetry(spark, d).withColumn("gsd", G.gsd_m_px("alt_m", F.lit(960)))
    gates = G.motion_gates("gsd")
    return t.select("event_id", F.round("gsd", 10).alias("gsd_m"), G.sky_boundary_row("pitch", F.lit(540)).cast("double").alias("sky_row"), *(F.round(v, 4).alias(k) for k, v in gates.items()))


@query(f"""WITH {rel.TELEMETRY}, s AS (SELECT event_id, value / 100 AS speed, alt_m FROM telemetry)
SELECT event_id, round(CASE WHEN speed > 0.5 THEN least(10, greatest(0.5, 0.4 * alt_m * 6.3 / 4.5 / speed)) WHEN alt_m <= 30 THEN 1 WHEN alt_m <= 60 THEN 2 WHEN alt_m <= 120 THEN 3 ELSE 5 END, 6) AS interval_s FROM s""")
def sampling_interval(spark, d):
    t = rel.telemetry(spark, d)
    speed = F.when(F.col("value") / 100 > 0.5, F.col("value") / 100).otherwise(0.0)
    return t.select("event_id", F.round(S.adaptive_interval("alt_m", speed), 6).alias("interval_s"))


@query(f"""WITH {rel.TELEMETRY}, p AS (SELECT event_id, lat, lon, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM telemetry WINDOW w AS (PARTITION BY stream_id ORDER BY frame_seq)),
h AS (SELECT *, pow(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin(radians(lon - b) / 2), 2) AS h FROM p)
SELECT event_id, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(greatest(0, 1 - h))), 4) AS step_m FROM h""")
def haversine_steps(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("stream_id").orderBy("frame_seq")
    return rel.telemetry(spark, d).select("event_id", F.round(G.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"), 4).alias("step_m"))


@query("""SELECT event_id, CASE WHEN v > 1 AND v < 10000 THEN v WHEN v / 1000 > 1 AND v / 1000 < 10000 THEN v / 1000 WHEN v / 100 > 1 AND v / 100 < 10000 THEN v / 100 WHEN v / 10 > 1 AND v / 10 < 10000 THEN v / 10 END AS alt_m
FROM (SELECT event_id, CAST(event_id * event_id AS DOUBLE) AS v FROM events)""")
def altitude_rescue(spark, d):
    return rel.read(spark, d, "events").select("event_id", S.rescale_altitude((F.col("event_id") * F.col("event_id")).cast("double")).alias("alt_m"))


@query("""SELECT event_id, round(degrees(2 * atan(exp((value * 20000 - 5000000) / 20037508.342789244 * pi())) - pi() / 2), 6) AS lat, round(event_id * 1000 / 20037508.342789244 * 180, 6) AS lon, round((event_id % 90 + (event_id % 60) / 60.0 + 30 / 3600.0) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END, 6) AS dms FROM events""")
def map_projections(spark, d):
    n = F.col("event_id")
    lat, lon = G.inverse_web_mercator(n * 1000, F.col("value") * 20000 - 5000000)
    dms = G.dms_to_decimal(n % 90, n % 60, F.lit(30.0), F.when(n % 2 == 0, "S").otherwise("N"))
    return rel.read(spark, d, "events").select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.round(dms, 6).alias("dms"))


@query("""WITH l AS (SELECT unnest(range(0, 12)) AS lane), p AS (SELECT lane, unnest(range(0, 20)) AS i FROM l)
SELECT lane, lane * 20 + i AS seq, round(32.0 + lane * 30 / 111320.0, 7) AS lat, round(34.8 + (CASE WHEN lane % 2 = 0 THEN i ELSE 19 - i END) * 10 / (111320.0 * cos(radians(32.0))), 7) AS lon FROM p""")
def lawnmower_path(spark, d):
    return O.lawnmower(spark, 32.0, 34.8, lanes=12, spacing_m=30.0, points=20, step_m=10.0).select("lane", "seq", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("""SELECT event_id, greatest(30, CAST(floor(200 * pow(100.0 / a, 2)) AS INT)) AS min_area, greatest(200, CAST(floor(50000 * pow(100.0 / a, 2)) AS INT)) AS max_area FROM (SELECT event_id, 40 + value / 5 AS a FROM events)""")
def shape_priors(spark, d):
    a = F.lit(40.0) + F.col("value") / 5
    return rel.read(spark, d, "events").select("event_id", S.shape_scale(F.lit(200), a, 30).alias("min_area"), S.shape_scale(F.lit(50000), a, 200).alias("max_area"))
