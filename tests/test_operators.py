import math
import random

import pytest
from pyspark.sql import functions as F

from aerograph.functions import geo as G
from aerograph.functions import scalar as S
from aerograph.operators import catalog as C
from aerograph.operators import detections as D
from aerograph.operators import geometry as O
from aerograph.operators import retrieval as R
from aerograph.operators import sequences as T


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_hand_computed(spark):
    foot = spark.range(1).select(*(v.alias(k) for k, v in G.frame_footprint(F.lit(32.0), F.lit(34.8), F.lit(80.0), F.lit(0.0), F.lit(1920)).items())).first()
    assert (foot.ground_w_m, foot.ground_h_m) == (112.0, 83.56)
    assert foot.fp_nw_lat > foot.fp_sw_lat and foot.fp_ne_lon > foot.fp_nw_lon
    assert value(spark, G.frame_footprint(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(10))["fp_nw_lat"]) is None
    assert value(spark, S.adaptive_interval(F.lit(80.0), F.lit(8.0))) == pytest.approx(5.6)
    assert [value(spark, S.adaptive_interval(F.lit(float(a)), F.lit(0.0))) for a in (30, 31, 60, 120, 121)] == [1, 2, 2, 3, 5]
    assert value(spark, S.dynamic_persist(F.lit(32.0))) == 19
    assert value(spark, S.margin(F.lit(0.30), F.lit(0.25))) == pytest.approx(0.2)
    assert value(spark, S.margin(F.lit(0.30), F.lit(0.0))) == pytest.approx(0.3)
    assert [value(spark, S.rescale_altitude(F.lit(x))) for x in (80.0, 80_000.0, 0.5, 1e9)] == [80, 80, None, None]
    assert [value(spark, S.cell(F.lit(x), F.lit(1.0))) for x in (-0.5, 0.5, -1.5)] == [0, 0, -1]
    assert value(spark, S.timecode_ms(F.lit("01:02:03,004"))) == 3_723_004 == value(spark, S.timecode_ms(S.ms_timecode(F.lit(3_723_004))))
    assert value(spark, S.strip_fence(F.lit('> ```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(spark, S.slug(F.lit("  My  Survey/№1 "), F.lit("0123456789"))) == "my_survey_1_01234567"
    assert value(spark, S.slug(F.lit("///"), F.lit("ab"))) == "mission_ab"
    assert [value(spark, S.zoom(F.lit(x), F.lit(0.0))) for x in (0.0, 0.001, 0.3, 9.0)] == [17, 18, 11, 7]
    assert value(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert value(spark, S.shape_scale(F.lit(200), F.lit(1000.0), 30)) == 30
    assert value(spark, S.any_phrase(F.lit("Anything OUT OF PLACE?"))) and not value(spark, S.any_phrase(F.lit("find cars")))


def test_stats(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 10)], "l string, v double")
    r = D.describe(df, ["l"], "v").first()
    assert (r.n, r.p90, r.p50, r.mean) == (5, 7.6, 3, 4)


def test_pixels(spark):
    rng = random.Random(1)
    rows = [(i, 32.0, 34.8, rng.uniform(20, 200), rng.uniform(0, 360), rng.random(), rng.random()) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, lat double, lon double, alt double, yaw double, u double, v double")
    df = df.withColumns(G.frame_footprint("lat", "lon", "alt", "yaw", F.lit(1920)))
    lat, lon = G.pixel_to_geo("u", "v")
    df = df.withColumns({"plat": lat, "plon": lon}).withColumn("p", G.geo_to_pixel("plat", "plon"))
    for r in df.collect():
        assert r.p.u == pytest.approx(r.u, abs=1e-4) and r.p.v == pytest.approx(r.v, abs=1e-4)
    corner = df.select(*(x.alias(n) for n, x in zip(("a", "b"), G.pixel_to_geo(F.lit(1.0), F.lit(1.0)))), "fp_se_lat", "fp_se_lon").first()
    assert (corner.a, corner.b) == (corner.fp_se_lat, corner.fp_se_lon)
    flat = G.aspect_corners("lat", "lon", "alt", "yaw", F.lit(1920), F.lit(1080))
    nadir = G.oblique_corners("lat", "lon", "alt", F.lit(-90.0), "yaw", F.lit(1920), F.lit(1080))
    worst = df.select(F.max(F.greatest(*(F.abs(flat[k] - nadir[k]) for k in flat))).alias("d")).first().d
    assert worst < 1e-9
    assert df.select(G.oblique_corners("lat", "lon", "alt", F.lit(-5.0), "yaw", F.lit(1920), F.lit(1080))["fp_nw_lat"].alias("x")).filter("x IS NOT NULL").isEmpty()


def overlap(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    return max(w * h / max(1, area(a) + area(b) - w * h), w * h / max(1, min(area(a), area(b))))


def test_nms_is_independent_and_maximal(spark):
    rng = random.Random(2)
    boxes = {i: (x := rng.randrange(200), y := rng.randrange(200), x + rng.randrange(10, 80), y + rng.randrange(10, 80)) for i in range(200)}
    conf = {i: rng.random() for i in boxes}
    df = spark.createDataFrame([(i, "f", conf[i], *b) for i, b in boxes.items()], "det_id long, parent_path string, conf double, x1 long, y1 long, x2 long, y2 long")
    kept = {r.det_id for r in D.nms(df).collect()}
    assert all(overlap(boxes[a], boxes[b]) <= 0.5 for a in kept for b in kept if a < b)
    assert all(any(conf[a] >= conf[b] and overlap(boxes[a], boxes[b]) > 0.5 for a in kept) for b in boxes if b not in kept)
    nested = spark.createDataFrame([(1, "f", 0.9, 0, 0, 100, 100), (2, "f", 0.8, 10, 10, 20, 20)], df.schema)
    assert [r.det_id for r in D.nms(nested).collect()] == [1]


def test_isolation_and_hull(spark):
    rng = random.Random(3)
    pts = [(i, i % 5, rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(200)]
    df = spark.createDataFrame(pts, "det_id long, frame_seq long, cx double, cy double")
    got = {r.det_id for r in D.isolation_gate(df, 25.0).collect()}
    assert got == {a[0] for a in pts if not any(a[0] != b[0] and a[1] == b[1] and math.dist(a[2:], b[2:]) <= 25 for b in pts)}
    assert D.isolation_gate(df, 0).count() == 200
    hull = D.hull_frame(df, "frame_seq", "cx", "cy").orderBy("frame_seq", "seq").collect()
    for f in range(5):
        c = [(r.cx, r.cy) for r in hull if r.frame_seq == f]
        for _, g, x, y in pts:
            if g == f:
                assert all((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= -1e-9 for p, q in zip(c, c[1:] + c[:1]))


def test_tracker_gates(spark):
    rows = [(1, 0, 0, 0.0), (2, 1, 10_000, 300.0), (3, 2, 20_000, 600.0), (4, 3, 20_000, 2000.0)]
    df = spark.createDataFrame([("car", i, f, t, 32.0 + m / 111_320.0, 34.8) for i, f, t, m in rows], "label string, det_id long, frame_seq long, ts_ms long, lat double, lon double")
    got = {r.det_id: r for r in T.track_velocity(df).collect()}
    assert [got[i].track_no for i in (1, 2, 3, 4)] == [1, 1, 1, 2]  # 300 m within the cold gate of 305 m
    assert got[1].speed_ms == pytest.approx(0.6 * 30 + 0.4 * 0.6 * 30, rel=1e-6)
    far = df.withColumn("lat", F.when(F.col("det_id") == 2, F.lit(32.0) + 306 / 111_320.0).otherwise(F.col("lat"))).filter("det_id <= 2")
    assert {r.track_no for r in T.track_velocity(far).collect()} == {1, 2}


def test_motion_tracker(spark):
    rows = [(0, i, i, (i - 15) * 8 + 40.0, 240.0) for i in range(15, 50)] + [(0, 100, 20, 5000.0, 0.0)]
    df = spark.createDataFrame(rows, "stream_id long, det_id long, frame_seq long, cx double, cy double")
    got = {r.track_id: r for r in T.motion_tracks(df).collect()}
    assert got[1].hit_count == 35 and got[1].confirmed and got[2].hit_count == 1 and not got[2].confirmed


def test_world_fixed_point_does_not_spread(spark):
    rows, h = [], 20.0
    for i in range(30):
        e, n, alt = i * 3.0, i * 1.0, 80.0
        rows.append((1, alt, e, n, e + (5.0 - e) * alt / (alt - h), n + (7.0 - n) * alt / (alt - h)))
    df = spark.createDataFrame(rows + [(2, 80.0, 0.0, 0.0, 0.0, 0.0)], "track_id long, alt_m double, cam_e double, cam_n double, geo_e double, geo_n double")
    r = T.world_fixed(df).collect()
    assert len(r) == 1 and r[0].spread_m < 0.2 and abs(r[0].height_m - h) < 0.5


def test_interpolation_hits_samples(spark):
    s = spark.createDataFrame([("a", t, float(t * t)) for t in (0, 10, 20)], "k string, t long, v double")
    q = spark.createDataFrame([("a", t) for t in (-5, 0, 5, 10, 15, 99)] + [("b", 1)], "k string, t long")
    got = {(r.k, r.t): r.v for r in T.interpolate(s, q, "k", "t", ["v"]).collect()}
    assert got == {("a", -5): 0, ("a", 0): 0, ("a", 5): 50, ("a", 10): 100, ("a", 15): 250, ("a", 99): 400, ("b", 1): None}


def test_tiles_and_prefilter(spark):
    assert O.tile_grid(spark.createDataFrame([(1920, 1080), (0, 5)], "w long, h long")).count() == 8
    for n, keep in ((3, 3), (8, 4), (20, 12), (21, 20), (100, 30)):
        t = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
        assert R.prefilter(t, R.vector([1.0, 0.0])).count() == keep
    none = spark.createDataFrame([], "side string, vec array<double>")
    assert R.score_segments(t, none).count() == 0


def test_catalog(spark, tmp_path):
    c = C.Catalog(spark, f"file://{tmp_path}/c")
    assert c.missions().count() == 0 and c.get_or_create("m1", " One ") == "m1" == c.get_or_create("mx", "x")
    c.create("m2", "Two")
    c.touch("m2", 5)
    assert [r.id for r in C.active(c.missions()).collect()] == ["m2", "m1"]
    c.archive("m2")
    assert [r.id for r in C.archived(c.missions()).collect()] == ["m2"] and c.get_or_create("x", "x") == "m1"
    with pytest.raises(ValueError):
        c.delete("m1", "wrong")
    c.delete("m1", "One")
    assert c.missions().count() == 1
    c.set_state("k", "1")
    c.set_state("k", "2", ignore=True)
    assert c.state().first().value == "1"
    c.set_state("k", "3")
    assert [r.value for r in c.state().collect()] == ["3"]


def test_merge_detections_of_the_whole_table(spark):
    rng = random.Random(8)
    rows = [(i, i // 3, 32.0 + 0.00001 * (i // 3), 34.8 + 0.0005 * (i % 3), rng.randrange(50) / 50) for i in range(240)]  # 1.1 m apart, over 20-frame borders
    rows += [(1000 + i, i, 0.0, 180.0 if i % 2 else -180.0, rng.random()) for i in range(4)] + [(2000 + i, i, 89.99999, 90.0 * i, rng.random()) for i in range(4)] + [(3000, 1, None, None, 0.5)]

    def metres(p, q):
        (a, b), (c, d) = (map(math.radians, x[2:4]) for x in (p, q))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    near = lambda p, q: p[2] is not None and q[2] is not None and metres(p, q) <= 3.0
    seeds, groups = [], {}
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        first = next((s for s in seeds if near(s, r)), None)
        if first is None:
            seeds.append(first := r)
        frames = groups.setdefault(first[0], {})
        frames.setdefault(r[1], r[0])
    want = sorted((s, d, len(f) > 1) for s, f in groups.items() for d in list(f.values())[:3])
    df = spark.createDataFrame(rows, "det_id long, frame_seq long, lat double, lon double, conf double")
    got = sorted((r.instance_id, r.det_id, r.is_multiangle) for r in D.merge_detections(df).collect())
    assert got == want


def test_merge_detections_sends_no_table_to_the_driver(spark):
    rows = [(i, i // 3, 32.0 + 0.00001 * (i // 3), 34.8 + 0.0005 * (i % 3), i * 7 % 50 / 50) for i in range(240)]
    df = spark.createDataFrame(rows, "det_id long, frame_seq long, lat double, lon double, conf double")
    out = D.merge_detections(df)
    assert out.count() and "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rounds", [12, 2, 0])
def test_merge_detections_of_a_long_chain(spark, monkeypatch, rounds):
    """With equal confidences each row waits for the one before it; the rounds are bounded all the same."""
    from aerograph import scratch

    n, written, write = 300, [], scratch.cut
    monkeypatch.setattr(scratch, "cut", lambda df, label: (written.append(label), write(df, label))[1])
    monkeypatch.setattr(D, "ROUNDS", rounds, raising=False)
    rows = [(i, i, 32.0 + 0.00001 * i, 34.8, 0.5) for i in range(n)]  # 1.1 m apart
    df = spark.createDataFrame(rows, "det_id long, frame_seq long, lat double, lon double, conf double")
    got = sorted((r.instance_id, r.det_id) for r in D.merge_detections(df).collect())
    assert got == [(i - i % 3, i) for i in range(n)]
    assert len(written) <= 2 + 3 * rounds + 1


def test_generator_settings(tmp_path):
    from aerograph import config

    (tmp_path / "a.json").write_text('{"fps": 25, "targets": [{"id": 1}]}')
    assert config.load_generator(str(tmp_path / "a.json")) == config.GENERATOR | {"fps": 25, "targets": [{"id": 1}]}
    (tmp_path / "b.json").write_text('{"speed": 1}')
    with pytest.raises(ValueError):
        config.load_generator(str(tmp_path / "b.json"))


def test_settled_files(spark):
    from aerograph.operators import records as X

    files = spark.createDataFrame([("a", 1, 100), ("a", 2, 900), ("b", 3, 950), (None, 4, 10)], "folder string, id long, at long")
    ids = lambda *args: sorted(r.id for r in X.settled(files, "folder", "at", 1000, *args).collect())
    assert ids(80) == [1, 2, 4] and ids(None) == [1]
