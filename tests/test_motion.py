from aerograph.operators import motion as M

FRAMES = "stream_id long, frame_seq long, lat double, alt_m double, pitch double, yaw double, dx double, dy double, img_w int, img_h int"


def run(spark, blobs, dx=0.0, n=40, pitch=-90.0, **more):
    frames = spark.createDataFrame([(1, f, 32.0, 80.0, pitch, 0.0, dx, 0.0, 640, 480) for f in range(n)], FRAMES)
    b = spark.createDataFrame([(1, f, i, float(x), 240.0) for i, (f, x) in enumerate(blobs)], "stream_id long, frame_seq long, det_id long, cx double, cy double")
    return {r.track_id: r for r in M.motion_process(b, frames, **more).collect()}


def test_mover_is_kept(spark):
    # a height near the camera shrinks any path to a twentieth, so under a hovering camera only fast movers stay
    t = run(spark, [(f, 20 + 30 * f) for f in range(20)], n=20)[1]
    assert t.hit_count == 20 and t.confirmed and not t.suppressed and 0.5 < t.spread_m < 0.7 and 0 < t.confidence < 1


def test_static_is_suppressed_and_stays_so(spark):
    t = run(spark, [(f, 300) for f in range(40)])[1]
    assert t.confirmed and t.suppressed_by == "world_fixed" and t.spread_m < 0.01 and t.confidence == 0


def test_still_object_under_a_moving_camera(spark):
    # the scene moves two pixels a frame, and so does a blob that stands on the ground
    t = run(spark, [(f, 400 + 2 * f) for f in range(40)], dx=2.0)[1]
    assert t.suppressed_by == "world_fixed"


def test_misses_retire_and_restart(spark):
    got = run(spark, [(f, 300) for f in range(5)] + [(f, 300) for f in range(20, 25)])
    assert {k: (r.first_frame, r.last_frame, r.confirmed) for k, r in got.items()} == {1: (0, 4, False), 2: (20, 24, False)}


def test_range_gate(spark):
    t = run(spark, [(f, 300 + 3 * f) for f in range(40)], dx=3.0, pitch=-35.0, max_range_m=50.0)[1]
    assert t.suppressed_by == "range" and t.spread_m is None
