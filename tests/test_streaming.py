from pyspark.sql import functions as F

from aerograph.api import Session, parse_query
from aerograph.operators import sequences as T
from aerograph.plans import relations as rel
from aerograph.streaming import streams as St

SF = "/root/testdata/sf0.001"


def dropped(spark, df, path, parts=3, order="frame_seq"):
    """``df`` as files in order of time, as a camera would drop them."""
    top = df.agg(F.max(order)).first()[0] + 1
    for k in range(parts):
        df.filter((F.col(order) >= top * k // parts) & (F.col(order) < top * (k + 1) // parts)).coalesce(1).write.parquet(f"{path}/{k}")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return St.read_frames(spark, f"{path}/*", ddl, 1)


def test_novelty_stream_equals_batch(spark, tmp_path):
    tiles = rel.dets(spark, SF).select((F.col("det_id") % 2).alias("stream_id"), "frame_seq", "det_id", F.array(F.floor(F.col("lat") * 20000), F.floor(F.col("lat") * 20000) + 1).alias("cells"))
    live = dropped(spark, tiles, f"file://{tmp_path}/in")
    St.run_once(St.novelty_stream(live), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.det_id, round(r.overlap, 6), r.foreground) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    keyed = tiles.withColumn("cells", F.transform("cells", lambda c: c * 2 + F.col("stream_id")))
    want = {(r.det_id, round(r.overlap, 6), r.foreground) for r in T.novelty(keyed, "cells", "frame_seq", "det_id", 0.60).collect()}
    assert got == want and len(got) == tiles.count()


def test_threshold_stream_equals_batch(spark, tmp_path):
    frames = rel.telemetry(spark, SF).select("stream_id", "frame_seq", "lat", "lon").filter("stream_id < 20")
    live = dropped(spark, frames, f"file://{tmp_path}/in")
    St.run_once(St.threshold_stream(live, tile_m=2000.0), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.stream_id, r.frame_seq, round(r.threshold, 6)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.stream_id, r.seq, round(r.threshold, 6)) for r in T.adaptive_thresholds(frames, "stream_id", ["frame_seq"], 2000.0).collect()}
    assert got == want


def test_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "event_type")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = St.read_frames(spark, f"{tmp_path}/in", "event_id long, ts timestamp_ntz, event_type string")
    St.run_once(St.windowed_counts(live, "ts", ["event_type"]), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.start, r.event_type, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.hour, r.event_type, r.n) for r in events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got <= want and len(want - got) <= 20  # the last windows stay open


def test_upsert_batches(spark, tmp_path):
    write = St.upsert_into(str(tmp_path / "t"), ["id"])
    make = lambda *rows: spark.createDataFrame(rows, "id long, v string")
    write(make((1, "a"), (2, "b")), 0)
    write(make((2, "c"), (3, "d")), 1)
    write(make((2, "c"), (3, "d")), 1)  # a repeated batch
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/1")).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_session(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}")
    frames = spark.createDataFrame([(f"f{i}.jpg", 32.0 + i * 1e-4, 34.8, 80.0, 0.0, 1920, 1080) for i in range(4)] + [("bad.jpg", 0.0, 0.0, 80.0, 0.0, 1920, 1080), ("low.jpg", 32.0, 34.8, 0.0, 0.0, 1920, 1080)], "parent_path string, lat double, lon double, alt_m double, yaw double, img_w int, img_h int")
    assert s.ingest("m", frames) == 32 and s.ingest("m", frames) == 0
    assert s.search("m", "car").count() <= 4
    found = s.query("m", "car")
    rows = found.collect()
    assert rows and all(r.confirmed and 31.9 < r.lat < 32.1 and r.track_no >= 1 for r in rows)
    assert s.stats(found).first().n == len(rows)
    assert parse_query("anything unusual?")["intent"] == "anomaly_detection" and parse_query("cars")["threshold"] == 0.20


def moving(spark, frames=40):
    """Two targets of two labels in two missions, of which one is missing now and then."""
    rows = [(m, "car" if k % 2 else "bus", 100 * m + 1000 * f + k, f, f * 1000, 32.0 + k * 1e-3, 34.8 + (k + 1) * m * 1.5 * f / 94_000) for m in (1, 2) for f in range(frames) for k in range(4) if (f + k) % 5]
    return spark.createDataFrame(rows, "mission long, label string, det_id long, frame_seq long, ts_ms long, lat double, lon double")


def test_track_stream_equals_batch(spark, tmp_path):
    dets = moving(spark)
    live = dropped(spark, dets, f"file://{tmp_path}/in", 4)
    St.run_once(St.track_stream(live, ("mission",)), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.det_id: (r.track_no, r.speed_ms) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = T.track_velocity(dets, keys=("mission",)).collect()
    assert {d: n for d, (n, _) in got.items()} == {r.det_id: r.track_no for r in want} and len(got) == dets.count()
    last = {}
    for r in sorted(want, key=lambda r: r.det_id):
        last[r.mission, r.label, r.track_no] = r
    assert all(abs(got[r.det_id][1] - r.speed_ms) < 1e-12 for r in last.values())


def test_published_set_is_replaced(spark, tmp_path):
    dets = moving(spark)
    live = dropped(spark, dets, f"file://{tmp_path}/in", 5)
    St.each_once(St.track_stream(live, ("mission",)), St.publish_into(f"file://{tmp_path}/pub", ("mission",)), f"{tmp_path}/cp")
    table = St.Versions(spark, f"file://{tmp_path}/pub")
    got = {r.id: (r.n, r.first_det, round(r.speed_ms, 9), r.is_moving) for r in table.read().collect()}
    whole = T.track_velocity(dets, keys=("mission",)).groupBy("mission", "label", "track_no").agg(F.count("*").alias("n"), F.min("det_id").alias("d"), F.max("speed_ms").alias("s")).collect()
    assert got == {f"{r.mission}_{r.label}_{r.track_no}": (r.n, r.d, round(r.s, 9), r.s > 1.0) for r in whole}
    assert any(m for *_, m in got.values()) and len(table.numbers()) <= 2


def test_motion_stream_equals_batch(spark, tmp_path):
    rows = [(s, f, 10 * f + k, 50.0 + (6 * f if k else 400 - 6 * f), 100.0 + 9 * k) for s in range(3) for f in range(60) for k in range(2) if not (20 <= f < 20 + 5 * s or (f + s + k) % 7 == 0)]
    blobs = spark.createDataFrame(rows, "stream_id long, frame_seq long, det_id long, cx double, cy double")
    live = dropped(spark, blobs, f"file://{tmp_path}/in", 4)
    St.run_once(St.motion_stream(live, persist=8), f"{tmp_path}/out", f"{tmp_path}/cp")
    ended = St.latest(spark.read.parquet(f"{tmp_path}/out"), ["stream_id", "track_id"], F.struct("last_frame", ~F.col("open"), "hit_count"))
    show = lambda df: sorted(tuple(r) for r in df.select("stream_id", "track_id", "hit_count", "first_frame", "last_frame", "confirmed").collect())
    assert show(ended) == show(T.motion_tracks(blobs, persist=8))


def test_promotion_and_deferred_queue(spark, tmp_path):
    tiles = spark.createDataFrame([(1, f, 10 * f + k, [k, k + 1], f == 2 and k == 0) for f in range(3) for k in range(3)], "stream_id long, frame_seq long, det_id long, cells array<long>, held boolean")
    live = dropped(spark, tiles, f"file://{tmp_path}/in")
    St.each_once(St.novelty_stream(live, promoted="held"), St.route_into(f"file://{tmp_path}/fg", f"file://{tmp_path}/bg"), f"{tmp_path}/cp")
    ids = lambda p: sorted(r.det_id for r in spark.read.parquet(f"{tmp_path}/{p}/*").collect())
    assert ids("fg") == [0, 1, 2, 20] and ids("bg") == [10, 11, 12, 21, 22]
    later = St.read_frames(spark, f"{tmp_path}/bg/*", "stream_id long, det_id long, overlap double, foreground boolean")
    St.run_once(later, f"{tmp_path}/late", f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/late").count() == 5


def test_stream_statistics_equal_batch(spark, tmp_path):
    from aerograph.operators import runs

    rows = [("r" + str(i % 2), runs.STAGES[i % (1 + i % 4)], (i * 37 % 100) / 100.0, i) for i in range(400)]
    df = spark.createDataFrame(rows, "run_id string, stage string, conf double, frame_seq long")
    live = dropped(spark, df, f"file://{tmp_path}/in")
    St.each_once(live, St.record_into(f"file://{tmp_path}/stats"), f"{tmp_path}/cp")
    assert sorted(map(str, St.run_statistics(spark, f"file://{tmp_path}/stats").collect())) == sorted(map(str, runs.summary(df.drop("frame_seq")).collect()))


def test_replay_poses_and_triggers(spark, tmp_path):
    waits, frames = [], spark.range(10).withColumnRenamed("id", "frame_seq")
    assert St.replay(frames, f"file://{tmp_path}/in", per_file=4, loops=2, start=2, fps=10, speed=2, sleep=waits.append) == 4 and waits == [0.2] * 4
    got = sorted(r.frame_seq for r in spark.read.parquet(f"{tmp_path}/in").collect())
    assert got == list(range(2, 10)) + list(range(10, 18))
    assert [r.frame_seq for r in St.every_nth(frames).collect()] == [4, 9]
    posed = St.with_pose(spark.createDataFrame([(1, 31.0, 35.0, 60.0, -45.0, 10.0), (2, None, None, None, None, None)], "f long, lat double, lon double, alt_m double, pitch double, yaw double"), 32.0, 34.8)
    assert [(r.lat, r.alt_m, r.pitch, r.embedded) for r in posed.orderBy("f").collect()] == [(31.0, 60.0, -45.0, True), (32.0, 80.0, -90.0, False)]
    query = St.run_every(St.read_frames(spark, f"{tmp_path}/in", "frame_seq long"), St.upsert_into(f"file://{tmp_path}/t", ["frame_seq"]), f"{tmp_path}/cp", 0.1)
    St.finish(query)
    assert St.Versions(spark, f"file://{tmp_path}/t").read().count() == 16


def test_moving_target_through_the_session(spark, tmp_path):
    from aerograph.functions import models

    frames = spark.createDataFrame([(f"m/f{i:02d}.jpg", 32.0, 34.8, 80.0, 0.0, 1920, 1080, i * 2000) for i in range(12)], "parent_path string, lat double, lon double, alt_m double, yaw double, img_w int, img_h int, ts_ms long")

    def detector():
        def detect(tile, query):
            import re

            f, x, y = map(int, re.search(r"f(\d+)_t(\d+)_(\d+)\.jpg$", tile).groups())
            cx = 200 + 120 * f  # seven metres a frame
            inside = x + 40 <= cx < x + 560 and y == 0
            car = {"x1": cx - x - 20, "y1": 100, "x2": cx - x + 20, "y2": 130, "confidence": 0.8, "label": "Car"}
            spot = {"x1": 10, "y1": 10, "x2": 15, "y2": 15, "confidence": 0.9, "label": "Car"}  # too small, after it suppresses what it lies in
            under = {"x1": 5, "y1": 5, "x2": 25, "y2": 25, "confidence": 0.5, "label": "Car"}
            return ([car] if inside else []) + ([spot, under] if (x, y) == (0, 0) else [])

        return detect

    models.register("detector", detector)
    models.register("verifier", lambda: lambda tile, found: [{"index": i, "confirmed": d["label"] == "Car" and "f05" not in tile, "confidence": 0.9, "reason": "seen"} for i, d in enumerate(found)])
    try:
        s = Session(spark, f"file://{tmp_path}")
        s.ingest("m", frames)
        s.params("m", "car")["difficulty"] = "hard"  # all tiles
        found = s.objects("m", "car")
        rows = found.confirmed.collect()
        assert len(rows) >= 9 and {r.track_no for r in rows} == {1} and all(r.is_moving and 3 < r.speed_ms < 4 for r in rows) and {r.track_label for r in rows} == {"car"}
        lost = found.rejected.collect()
        assert lost and all("f05" in r.parent_path and r.reason == "seen" for r in lost)
        counts = dict(found.stages.groupBy("stage").count().collect())
        assert counts["detected"] > counts["suppressed"] > counts["sized"] > counts["confirmed"] == len(rows)
        assert s.commit("m", found.confirmed, replace=True) == 1 and s.commit("m", found.confirmed, replace=True) == 1
        first = s.published("m").first()
        assert first.id == f"car_{first.track_id}" and first.n == len(rows) and first.is_moving and first.is_multiangle
        assert s.commit("m", found.confirmed, run="a") == 2 and s.commit("m", found.confirmed, run="a") == 2 and s.commit("m", found.confirmed, run="b") == 3
        s.record("m", found, "run1", "car")
        s.record("m", found, "run1", "car")
        stats = s.read("m", "runs").collect()
        assert len(stats) == 1 and stats[0].confirmed.n == len(rows) and stats[0].lost_confirmed > 0
    finally:
        models.register("detector", models.stub_detector)
        models.register("verifier", models.stub_verifier)


def test_anomalies_through_the_session(spark, tmp_path):
    from aerograph.functions import models

    s = Session(spark, f"file://{tmp_path}")
    frames = spark.createDataFrame([(f"f{i}.jpg", 32.0 + i, 34.8, 80.0, 0.0, 640, 640) for i in range(3)], "parent_path string, lat double, lon double, alt_m double, yaw double, img_w int, img_h int")
    s.ingest("m", frames)
    text = "anything unusual?"
    assert s.query("m", text).count() == 0
    odd, plain = models.stub_encoder()()("unusual"), models.stub_encoder()()("ground")
    segments = spark.createDataFrame([(f"f{i}.jpg", k, [k, k, k + 9, k + 9], 81.0, odd if k % 2 else plain) for i in range(3) for k in range(6)], "frame_path string, seg_idx int, bbox array<int>, area double, vector array<double>")
    assert s.add_segments("m", segments) == 18 and s.add_segments("m", segments) == 0
    got = s.query("m", text).collect()
    assert 0 < len(got) <= 5 and all(r.seg_idx % 2 and r.confirmed and r.label == text and r.lat == 32.0 + int(r.frame_path[1]) for r in got)
